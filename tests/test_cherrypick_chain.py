"""The chain of picked snapshots holds the whole log, and its table the log's state."""

import pytest

from rillstone.operators import netchange
from rillstone.plans import catalogue
from tests.fixtures import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_every_batch_is_in_the_chain(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "SIZE", 15)  # several batches a day
    plan = catalogue._plan(catalogue._log(spark, str(DATA)))
    batches, days = plan.select("bid").distinct().count(), plan.select("dt").distinct().count()
    assert batches > days > 3
    chain = catalogue.cherrypick_chain(spark, str(DATA)).collect()
    assert sum(len(r.squashed.split(",")) if r.squashed else 1 for r in chain) == batches
    assert sum(r.squashed is not None for r in chain) > 3 and sum(r.picked_from is not None for r in chain) > days / 3
    assert [r.parent for r in chain] == [*[r.id for r in chain[1:]], None]


def test_its_table_is_the_state_of_the_log(spark, rows, monkeypatch):
    monkeypatch.setattr(catalogue, "SIZE", 15)
    table, days = catalogue._state_table(spark, str(DATA))
    net = catalogue._net(spark, str(DATA))
    assert rows(table.read()) == rows(netchange.state(net, ["id"]).select("id", "v"))
    assert sum(len(day) for day in days) == net.select("bid").distinct().count()
