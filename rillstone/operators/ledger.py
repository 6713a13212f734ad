"""Each record is processed exactly once: a ledger of work items with leases and fencing tokens.

An item is pending, leased or done. A worker leases pending items for a limited time, renews the lease while it works, and
gets a fencing token, a number that grows with every lease of the ledger. An expired lease returns to pending, and whoever
held it is stale: completing an item asks for the token of its latest lease. Paths follow from item and token alone:
``out/table_name/run_id=.../token=...``. A retried write replaces itself, two writers never meet, results are read from the
path of the token that completed the item, and once an item is completed its other paths are removed.

The ledger is a chain of small files, one per change, created exclusively through the session's file system: of two
workers that change it at the same time one fails to create its file, reads again and retries. It holds metadata only
(one row per item), never records. Done items move to files of their own, which later changes only name, and versions that
no one needs are deleted, so that a change costs the same however many runs there were.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..files import Files
from ..session import micros
from .dedupe import frequency

PENDING, LEASED, DONE = "pending", "leased", "done"
#: Done items that a version itself holds before they move to a file of their own, and versions that stay.
DONE_ITEMS, VERSIONS = 500, 20


class StaleToken(RuntimeError):
    """The lease has passed to someone else, or was completed."""


@dataclass
class Item:
    """A window of arrival times of one table: after ``low`` (or from the start) up to ``high``, in microseconds."""

    item_id: str
    table_name: str
    run_id: int
    low: int | None
    high: int
    state: str = PENDING
    token: int = 0
    owner: str = ""
    until: float = 0.0


class Ledger:
    """Work items under ``root``; every method is one atomic change."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time):
        self.spark, self.files, self.root, self.clock = spark, Files(spark, f"{root}/ledger"), root, clock
        self._kept: dict[str, list[Item]] = {}

    def _archive(self, names: list[str]) -> dict[str, Item]:
        """Done items of the files that a version names; these never change."""
        for n in names:
            if n not in self._kept:
                self._kept[n] = [Item(**i) for i in json.loads(self.files.read(n))]
        return {i.item_id: i for n in names for i in self._kept[n]}

    def _load(self) -> tuple[int, dict[str, Item], list[str], int]:
        """The highest version there is, and what the highest whole one says."""
        version, text = self.files.latest("v")
        if text is None:
            return version, {}, [], 0
        got = json.loads(text)
        return version, {i["item_id"]: Item(**i) for i in got["items"]}, got["archive"], got["token"]

    def _change(self, edit: Callable[[dict[str, Item], int], tuple[int, object]]):
        """Apply ``edit`` to the items that aren't archived and write the next version, again until no other change came between."""
        while True:
            version, items, archive, token = self._load()
            now = self.clock()
            for i in items.values():
                if i.state == LEASED and i.until <= now:
                    i.state, i.owner, i.until = PENDING, "", 0.0
            token, out = edit(items, token)
            done = [i for i in items.values() if i.state == DONE]
            moved = None
            if len(done) > DONE_ITEMS:
                moved = f"d{version + 1:012d}-{token}.json"
                if self.files.create(moved, json.dumps([asdict(i) for i in done]) + "\n"):
                    archive, items = [*archive, moved], {k: i for k, i in items.items() if i.state != DONE}
            text = json.dumps({"token": token, "items": [asdict(i) for i in items.values()], "archive": archive}) + "\n"
            if self.files.create(f"v{version + 1:012d}.json", text):
                if version > VERSIONS:
                    self.files.delete(f"v{version - VERSIONS:012d}.json")
                return out
            if moved in archive:
                self.files.delete(moved)

    def items(self) -> list[Item]:
        _, items, archive, _ = self._load()
        return [*self._archive(archive).values(), *items.values()]

    def enqueue(self, new: list[Item]) -> int:
        """Add items the ledger doesn't know yet; known ones stay as they are. Gives how many were new."""

        def edit(items, token):
            known = self._archive(self._load()[2])
            fresh = [i for i in new if i.item_id not in items and i.item_id not in known]
            items.update((i.item_id, i) for i in fresh)
            return token, len(fresh)

        return self._change(edit)

    def lease(self, owner: str, most: int | None, seconds: float) -> list[Item]:
        """Up to ``most`` pending items (all if None), oldest windows first, under one new token."""

        def edit(items, token):
            got = sorted((i for i in items.values() if i.state == PENDING), key=lambda i: (i.high, i.item_id))[:most]
            for i in got:
                i.state, i.owner, i.token, i.until = LEASED, owner, token + 1, self.clock() + seconds
            return token + bool(got), got

        return self._change(edit)

    def renew(self, item_ids: list[str], token: int, seconds: float) -> None:
        """Keep the lease for longer; stale holders get :class:`StaleToken`."""
        self._with(item_ids, token, lambda i: setattr(i, "until", self.clock() + seconds))

    def complete(self, item_ids: list[str], token: int) -> None:
        """Mark items done; all of them or, with a stale token, none."""

        def done(i):
            i.state, i.until = DONE, 0.0

        self._with(item_ids, token, done)

    def _with(self, item_ids: list[str], token: int, act: Callable[[Item], None]) -> None:
        def edit(items, last):
            for k in item_ids:
                i = items.get(k)
                if i is None or i.token != token or i.state != LEASED:
                    raise StaleToken(f"item {k}: token {token}, ledger has {i.token if i else None} ({i.state if i else 'no item'})")
            for k in item_ids:
                act(items[k])
            return last, None

        self._change(edit)

    def _folder(self, table_name: str) -> str:
        return f"{self.root}/out/{self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(table_name)}"

    def path(self, item: Item) -> str:
        """Where the results of an item lie that its lease wrote."""
        return f"{self._folder(item.table_name)}/run_id={item.run_id}/token={item.token}"

    def prune(self, items: list[Item]) -> int:
        """Remove what other leases than the completing one wrote for done items; gives the number of folders."""
        gone = 0
        for i in items:
            whole = self.path(i)
            runs = Files(self.spark, whole.rpartition("/")[0], make=False)
            for n in runs.names():
                if n.startswith("token=") and n != whole.rpartition("/")[2]:
                    runs.delete(n)
                    gone += 1
        return gone

    def outputs(self, table_name: str, schema: str, upto: int | None = None) -> DataFrame | None:
        """What the completing leases of a table's done items wrote (of those whose windows end by ``upto``), None if nothing."""
        done = [i for i in self.items() if i.state == DONE and i.table_name == table_name and (upto is None or i.high <= upto)]
        folder = self._folder(table_name)
        if not done or not Files(self.spark, folder, make=False).exists(""):
            return None
        rows = self.spark.read.option("basePath", folder).schema(f"{schema}, run_id bigint, token bigint").parquet(folder)
        # a folder may hold what a lease wrote that another took over: only the token that completed an item counts
        held = self.spark.createDataFrame([(i.run_id, i.token) for i in done], "run_id bigint, token bigint")
        return rows.join(held, ["run_id", "token"], "left_semi").drop("token")

    def results(self, spark: SparkSession, schema: str) -> DataFrame:
        """Results of done items, each from the token that completed it: run_id, table_name, row_id."""
        out = spark.createDataFrame([], schema)
        for t in sorted({i.table_name for i in self.items()}):
            got = self.outputs(t, "row_id bigint")
            if got is not None:
                out = out.unionByName(got.select("run_id", F.lit(t).alias("table_name"), "row_id"))
        return out


def run_windows(log: list[tuple[int, int]], tables: list[str]) -> list[Item]:
    """An item per successful run and table from (run_id, read_upto); runs follow one another by read_upto, a repeated run counts once."""
    out: list[Item] = []
    runs = sorted(dict(sorted(log, key=lambda r: r[1], reverse=True)).items(), key=lambda r: (r[1], r[0]))
    for t in tables:
        low = None
        for run, upto in runs:
            out.append(Item(f"{t}:{run}", t, run, low, upto))
            low = upto
    return out


DAY = 86_400_000_000


def _windows(spark: SparkSession, items: list[Item]) -> DataFrame:
    """Windows spread over the days they touch: joining on the day keeps the interval join an equi-join of any size. A window without beginning stands at the day of its end, to which all earlier records are put."""
    rows = [(i.item_id, i.run_id, i.low, i.high) for i in items]
    df = spark.createDataFrame(rows, "item_id string, run_id bigint, low bigint, high bigint")
    days = F.sequence(F.expr(f"floor(least(coalesce(low, high), high) / {DAY})"), F.expr(f"floor(high / {DAY})"))
    return df.select("item_id", "run_id", "low", "high", F.explode(days).alias("day"))


@dataclass
class Source:
    """Rows of which several may be one record: the record is its first arrival by ``arrived``, then ``row_id``."""

    rows: DataFrame
    ident: list[str]
    arrived: str
    row_id: str


def _literal(df: DataFrame, column: str, us: int):
    """A time as the column has it, so that comparing with it needs no cast and reaches the files."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {us // 1_000_000}.{us % 1_000_000:06d})")
    return F.timestamp_micros(F.lit(us)) if isinstance(kind, T.TimestampType) else F.lit(us)


def first_new(ledger: Ledger, name: str, source: Source, items: list[Item]) -> DataFrame:
    """Records of a source that are new since what the ledger has done: (row_id, arrived_us) and their identifier.

    Only rows are read that arrived after the windows done without a gap and not after the last window leased; a record
    that one of those windows has brought already is no new one, however often it is delivered.
    """
    known = [i for i in ledger.items() if i.table_name == name]
    left = [i.low for i in known if i.state != DONE] + [i.low for i in items]
    low = None if any(x is None for x in left) else min(left)
    high = max(i.high for i in items)
    rows = source.rows.filter(F.col(source.arrived) <= _literal(source.rows, source.arrived, high))
    if low is not None:
        rows = rows.filter(F.col(source.arrived) > _literal(source.rows, source.arrived, low))
    ids = [f"id_{n}" for n in range(len(source.ident))]
    rows = rows.select(*[F.col(c).alias(i) for c, i in zip(source.ident, ids)], micros(source.rows, source.arrived).alias("arrived_us"), F.col(source.row_id).alias("row_id"))
    new = frequency(rows, ids, "arrived_us", "row_id").select("_first.row_id", "_first.arrived_us", *ids)
    seen = None if low is None else ledger.outputs(name, ", ".join(["row_id bigint", *[f"{i} {rows.schema[i].dataType.simpleString()}" for i in ids]]), low)
    if seen is None:
        return new
    seen = seen.select(*[F.col(i).alias(f"seen_{i}") for i in ids])
    return new.join(seen, reduce(and_, [F.col(i).eqNullSafe(F.col(f"seen_{i}")) for i in ids]), "left_anti")


class _Renewal:
    """Renews a lease from a thread of its own while a job runs; a lease that is lost is left to :meth:`Ledger.complete` to report."""

    def __init__(self, ledger: Ledger, items: list[Item], seconds: float):
        self.ledger, self.items, self.seconds, self.over = ledger, items, seconds, threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self.over.wait(self.seconds / 3):
            try:
                self.ledger.renew([i.item_id for i in self.items], self.items[0].token, self.seconds)
            except StaleToken:
                return

    def __enter__(self):
        self.thread.start()

    def __exit__(self, *_):
        self.over.set()
        self.thread.join()


def process(spark: SparkSession, ledger: Ledger, records: dict[str, DataFrame | Source], owner: str, *, most: int | None = None, seconds: float = 600.0) -> int:
    """Lease what is pending and process it in one job per table; gives the number of items completed.

    ``records``: per table a :class:`Source`, of which only what is new is read, or a frame (row_id bigint, arrived_us
    bigint) of each record once. A record belongs to the item whose window holds its time of arrival; those without one
    belong to none. The write goes to the lease's own paths, replacing what an earlier try left there; the lease is renewed
    until all of it is written and completed only then: a crash in between leaves the items leased until they expire.
    """
    got = ledger.lease(owner, most, seconds)
    if not got:
        return 0
    with _Renewal(ledger, got, seconds):
        for name, source in records.items():
            mine = [i for i in got if i.table_name == name]
            if not mine:
                continue
            rows = first_new(ledger, name, source, mine) if isinstance(source, Source) else source
            day = F.floor(F.col("arrived_us") / F.lit(DAY))
            first = [i.high // DAY for i in mine if i.low is None]
            if first:
                day = F.greatest(day, F.lit(min(first)).cast("bigint"))
            hit = rows.filter("arrived_us is not null").withColumn("day", day).join(_windows(spark, mine), "day").filter("(low is null or arrived_us > low) and arrived_us <= high")
            # an item's rows in few files, and those of a large item in several
            out = hit.select(*[c for c in rows.columns if c != "arrived_us"], "run_id", F.lit(mine[0].token).cast("bigint").alias("token")).hint("rebalance", "run_id")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "token").parquet(ledger._folder(name))
    ledger.complete([i.item_id for i in got], got[0].token)
    ledger.prune(got)
    return len(got)
