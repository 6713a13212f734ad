"""Queries over the reference's own operators: capture, planning, merge on read, history, types, schemas; with their SQL.

The change log is derived from ``events``: an error deletes a user's row, the next event creates it, others update it.
"""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime, timedelta, timezone
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Compaction, Stream
from ..functions import logical, time, transforms, wal
from ..operators import netchange
from ..operators.scan import cuts_of, running
from ..schema import derive, evolve
from ..session import load, materialise, micros, scratch_dir
from ..sources import avro, changelog, topics
from ..streaming.capture import Capture
from ..table import compact, upkeep
from ..table.log import DATA, SOURCE, SQUASHED, TS, Metadata, Snapshot, Table, by_partition, merge, part_value

SIZE = 1000
NOW = datetime(2024, 2, 10, 12, 14, 16, tzinfo=timezone.utc)
RULES = Compaction(timezone(timedelta(hours=7)))

LOG = """
 p0 as (select *, lag(event_type) over w pt, lag(value) over w pv from events window w as (partition by user_id order by event_id)),
 l0 as (select event_id + 1 lsn, event_id seq, user_id id, epoch_us(ts) // 1000 ts_ms, cast(ts as date) dt, value v, pv, user_id % 4 part,
   case when event_type = 'error' then 'd' when pt is null or pt = 'error' then 'c' else 'u' end op from p0 where not (event_type = 'error' and (pt is null or pt = 'error'))),
 log as (select *, row_number() over (partition by part order by seq) - 1 off from l0)"""


def _plan_sql(src: str, order: str = "seq", cut: str = "dt") -> str:
    """Batches and net changes of the relation ``src``."""
    return f"""
 m as (select *, case when max(ts_ms) over w > ts_ms or max(lsn) over w >= lsn then 1 else 0 end dup from {src} window w as (order by {order} rows between unbounded preceding and 1 preceding)),
 b0 as (select *, case when lag({cut}) over (order by {order}) is distinct from {cut} or row_number() over (order by {order}) = 1 then 1 else 0 end chg from m),
 b1 as (select *, sum(chg) over (order by {order}) run from b0),
 b2 as (select *, (row_number() over (partition by run order by {order}) - 1) // {SIZE} bi from b1),
 b as (select *, dense_rank() over (order by run, bi) bid from b2),
 l as (select *, lag(op) over (partition by bid, id order by {order}) pop, lead(op) over (partition by bid, id order by {order}) nop from b),
 e as (select *, case when pop in ('r', 'c', 'u') then 1 else 0 end pos, case when coalesce(pop, '-') not in ('r', 'c', 'u') and (op in ('u', 'd', 'r') or (op = 'c' and dup = 1)) then 1 else 0 end eq, case when nop is null and op <> 'd' then 1 else 0 end survives from l)"""


_STATE = "q as (select id, max(bid) ds from e where eq = 1 {q} group by id) select e.id, e.seq, e.v from e left join q on e.id = q.id where survives = 1 {w} and (q.ds is null or e.bid >= q.ds)"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _log(spark: SparkSession, d: str) -> DataFrame:
    return changelog.from_events(load(spark, d, "events"))


def _plan(log: DataFrame, order: str = "seq") -> DataFrame:
    cuts = cuts_of(log, order)
    marked = netchange.high_water(log, order, F.col("ts_ms"), F.col("lsn"), cuts=cuts)
    return netchange.batches(marked, order, SIZE, ["dt"], cuts=cuts)


def _net(spark: SparkSession, d: str) -> DataFrame:
    return netchange.net_changes(_plan(_log(spark, d)), ["id"], "seq")


# capture and planning ------------------------------------------------------------------------------------------------
@query(f"with {LOG} select lsn, seq, id, ts_ms, v, op, part, off from log")
def cdc_changelog_ops(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("lsn", "seq", "id", "ts_ms", "v", "op", F.col("kafka_partition").cast("bigint").alias("part"), F.col("kafka_offset").alias("off"))


@query(f"with {LOG}, {_plan_sql('log')}, {_STATE.format(q='', w='')}")
def cdc_current_state(spark: SparkSession, d: str) -> DataFrame:
    return netchange.state(_net(spark, d), ["id"]).select("id", "seq", "v")


@query(f"with {LOG}, {_plan_sql('log')}, {_STATE.format(q='and bid <= (select max(bid) // 2 from e)', w='and bid <= (select max(bid) // 2 from e)')}")
def cdc_state_as_of_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The state in the middle of the table's history."""
    net = materialise(_net(spark, d).select("id", "seq", "v", "bid", "eq", "survives"), "net")
    return netchange.state(net, ["id"], upto=(net.agg(F.max("bid")).head()[0] or 0) // 2).select("id", "seq", "v")


@query(f"with {LOG}, {_plan_sql('log')} select seq, bid from b")
def cdc_batch_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _plan(_log(spark, d)).select("seq", "bid")


@query(
    f"""with {LOG}, {_plan_sql('log')}, g as (select bid, count(*) n, cast(sum(pos) as bigint) pos, cast(sum(eq) as bigint) eq, cast(sum(survives) as bigint) "data", max(ts_ms) t, max(lsn) w from e group by bid),
 po as (select bid, part, max(off) + 1 nx from b group by 1, 2), gr as (select g.bid, x.part from g, (select distinct part from b) x),
 fo as (select gr.bid, gr.part, max(nx) over (partition by gr.part order by gr.bid) nx from gr left join po on po.bid = gr.bid and po.part = gr.part),
 tx as (select bid, '{{' || string_agg('"' || part || '":' || nx, ',' order by part) || '}}' offsets from fo where nx is not null group by bid)
 select g.bid, n, pos, eq, "data", max(t) over (order by g.bid) source_ts, max(w) over (order by g.bid) wal, offsets from g join tx on tx.bid = g.bid"""
)
def cdc_snapshot_summaries(spark: SparkSession, d: str) -> DataFrame:
    plan = _plan(_log(spark, d))
    return netchange.summaries(plan, netchange.net_changes(plan, ["id"], "seq"), "kafka_partition", "kafka_offset", "ts_ms", "lsn")


_REPLAY = "re as (select *, seq * 2 place from log union all select *, (seq + 800) * 2 + 1 from log where seq >= 3000 and seq < 3500)"


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return log.withColumn("place", F.col("seq") * 2).unionByName(log.filter("seq >= 3000 and seq < 3500").withColumn("place", (F.col("seq") + 800) * 2 + 1))


@query(f"with {LOG}, {_REPLAY}, {_plan_sql('re', 'place')} select place, seq, dup from m")
def cdc_maybe_duplicate(spark: SparkSession, d: str) -> DataFrame:
    return netchange.high_water(_replayed(spark, d), "place", F.col("ts_ms"), F.col("lsn")).select("place", "seq", F.col("dup").cast("int").alias("dup"))


@query(f"with {LOG}, {_REPLAY}, {_plan_sql('re', 'place')}, {_STATE.format(q='', w='')}")
def cdc_batch_retry_state(spark: SparkSession, d: str) -> DataFrame:
    return netchange.state(netchange.net_changes(_plan(_replayed(spark, d), "place"), ["id"], "place"), ["id"]).select("id", "seq", "v")


_READ = """rs as (select lsn, seq, id, ts_ms, dt, v, op, seq * 1000000 place from log
 union all select 0, -c_custkey, c_custkey, 0, null, c_acctbal, 'r', 5000000000 + c_custkey from customer)"""


@query(f"with {LOG}, {_READ}, {_plan_sql('rs', 'place')}, {_STATE.format(q='', w='')}")
def cdc_resnapshot_read(spark: SparkSession, d: str) -> DataFrame:
    """A new snapshot of all rows (reads) in the middle of the log: reads replace rows by force."""
    log = _log(spark, d).select("lsn", "seq", "id", "ts_ms", "dt", "v", "op", (F.col("seq") * 1_000_000).alias("place"))
    c = load(spark, d, "customer")
    zero = F.lit(0).cast("bigint")
    reads = c.select(zero.alias("lsn"), (-F.col("c_custkey")).alias("seq"), F.col("c_custkey").alias("id"), zero.alias("ts_ms"), F.lit(None).cast("date").alias("dt"), F.col("c_acctbal").alias("v"), F.lit("r").alias("op"), (F.lit(5_000_000_000) + F.col("c_custkey")).alias("place"))
    return netchange.state(netchange.net_changes(_plan(log.unionByName(reads), "place"), ["id"], "place"), ["id"]).select("id", "seq", "v")


@query(f"with {LOG}, tl as (select * from log where seq > 5000), {_plan_sql('tl')}, {_STATE.format(q='', w='')}")
def cdc_truncate(spark: SparkSession, d: str) -> DataFrame:
    """The state after a truncate at sequence 5000: only what came later."""
    log = _log(spark, d)
    cols = ["lsn", "seq", "id", "ts_ms", "dt", "v", "op"]
    # the truncate stands behind the record it follows and has its marks
    t = log.filter("seq <= 5000").groupBy().agg(F.max("lsn").alias("lsn"), F.max("ts_ms").alias("ts_ms"), F.max("dt").alias("dt")).select(
        "lsn", F.lit(5000).cast("bigint").alias("seq"), F.lit(None).cast("bigint").alias("id"), "ts_ms", "dt", F.lit(None).cast("double").alias("v"), F.lit("t").alias("op"), F.lit(10_001).cast("bigint").alias("place")
    )
    both = log.select(*cols, (F.col("seq") * 2).alias("place")).unionByName(t)
    plan = _plan(both, "place")
    return netchange.state(netchange.net_changes(plan, ["id"], "place"), ["id"], truncated=netchange.last_truncate(plan)).select("id", "seq", "v")


@query(f"with {LOG} select op, count(*) n from log group by op")
def cdc_tombstones_skipped(spark: SparkSession, d: str) -> DataFrame:
    """Every delete is followed by a tombstone, which changes nothing."""
    log = _log(spark, d).select("seq", "op")
    both = log.unionByName(log.filter("op = 'd'").select("seq", F.lit(None).cast("string").alias("op")))
    return netchange.known_ops(both).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {LOG} select seq, id, pv as before_v from log where op in ('u', 'd')")
def cdc_delete_before_image(spark: SparkSession, d: str) -> DataFrame:
    """The row that an update or delete takes away, from the envelope's before."""
    log = _log(spark, d).select("seq", "op", F.struct("id", F.col("pv").alias("v")).alias("before"))
    return log.filter(F.col("op").isin("u", "d")).select("seq", "before.id", F.col("before.v").alias("before_v"))


_JITTER = "jt as (select *, ts_ms + (seq * 7919) % 600000 js from log), jp as (select *, max(js) over (partition by part order by off) pm from jt)"


def _jittered(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).withColumn("js", F.col("ts_ms") + F.pmod(F.col("seq") * 7919, F.lit(600_000)))


@query(f"with {LOG}, {_JITTER} select seq, row_number() over (order by pm, part, off) place from jp")
def cdc_kway_merge_order(spark: SparkSession, d: str) -> DataFrame:
    return netchange.merge_order(_jittered(spark, d), "kafka_partition", "kafka_offset", "js").select("seq", "place")


@query(
    f"""with {LOG}, {_JITTER}, w as (select *, max(js) over o mt, max(lsn) over o mw from jt window o as (order by seq rows between unbounded preceding and 1 preceding))
 select strftime(dt, '%Y-%m-%d') "day", count(*) n, count(*) filter (where mt > js) ts_back, count(*) filter (where mw > lsn) wal_back, count(*) filter (where mt > js or mw >= lsn) dup from w group by dt"""
)
def cdc_out_of_order_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = netchange.high_water(_jittered(spark, d), "seq", F.col("js"), F.col("lsn"))
    count = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    return rows.groupBy(F.date_format("dt", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), count("ts_back"), count("wal_back"), count("dup"))


_OFFS = "la as (select part, max(off) + 1 nx from log group by 1), co as (select part, max(off) + 1 nx from log where seq < 4000 and part <> 3 group by 1)"


@query(f"with {LOG}, {_OFFS} select la.part, la.nx latest, coalesce(co.nx, 0) committed, la.nx - coalesce(co.nx, 0) lag from la left join co on co.part = la.part")
def cdc_partition_lag(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    got = changelog.lag(changelog.next_offsets(log), changelog.next_offsets(log.filter("seq < 4000 and kafka_partition <> 3")))
    return got.withColumn("part", F.col("part").cast("bigint"))


@query(f"with {LOG}, {_OFFS} select coalesce(co.part, la.part) part, coalesce(co.nx, la.nx) \"next\", co.nx is not null and co.nx is distinct from la.nx seeks from la full join co on co.part = la.part")
def cdc_offset_recovery(spark: SparkSession, d: str) -> DataFrame:
    """The table's offsets win over those of the broker."""
    log = _log(spark, d)
    got = changelog.resume_offsets(changelog.next_offsets(log.filter("seq < 4000 and kafka_partition <> 3")), changelog.next_offsets(log))
    return got.withColumn("part", F.col("part").cast("bigint"))


ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType())])
KEY = T.StructType([T.StructField("id", T.LongType())])


@query(f"with {LOG} select seq, id as key_id, op, case when op <> 'd' then id end after_id, case when op <> 'd' then v end after_v, ts_ms source_ts, lsn from log")
def cdc_envelope_json_decode(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    after = F.when(F.col("op") != "d", F.struct("id", "v"))
    value = F.to_json(F.struct("op", after.alias("after"), F.struct("ts_ms", "lsn").alias("source"), "ts_ms"))
    raw = log.select("seq", F.to_json(F.struct("id")).alias("key"), value.alias("value"))
    return changelog.decode_json(raw, ROW, KEY).select("seq", F.col("key.id").alias("key_id"), "op", F.col("after.id").alias("after_id"), F.col("after.v").alias("after_v"), F.col("source.ts_ms").alias("source_ts"), F.col("source.lsn").alias("lsn"))


@query(ORACLE["cdc_envelope_json_decode"])
def cdc_envelope_avro_decode(spark: SparkSession, d: str) -> DataFrame:
    """The log as framed Avro messages and read again."""
    import json

    pair = [{"name": "id", "type": "long"}, {"name": "v", "type": ["null", "double"]}]
    fields = [
        {"name": "op", "type": "string"}, {"name": "after", "type": ["null", {"type": "record", "name": "row", "fields": pair}]},
        {"name": "source", "type": {"type": "record", "name": "source", "fields": [{"name": "ts_ms", "type": "long"}, {"name": "lsn", "type": "long"}]}},
    ]
    schema = json.dumps({"type": "record", "name": "envelope", "fields": fields})
    rows = _log(spark, d).select("seq", F.col("id").alias("key_id"), F.struct("op", F.when(F.col("op") != "d", F.struct("id", "v")).alias("after"), F.struct("ts_ms", "lsn").alias("source")).alias("value"))
    got = changelog.decode_avro(avro.encode(rows, schema, "value", schema_id=1), {1: schema})
    return got.select("seq", "key_id", "op", F.col("after.id").alias("after_id"), F.col("after.v").alias("after_v"), F.col("source.ts_ms").alias("source_ts"), F.col("source.lsn").alias("lsn"))


# merge on read -------------------------------------------------------------------------------------------------------
@query("select l_orderkey, l_linenumber from lineitem l where not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey and 1 + o.o_orderkey % 7 > l.l_linenumber)")
def mor_equality_delete_scan(spark: SparkSession, d: str) -> DataFrame:
    """Line items (their number is the sequence) less those that a delete of their order hits later."""
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("bigint").alias("seq"))
    dels = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.pmod("o_orderkey", F.lit(7)) + 1).alias("seq"))
    return netchange.apply_equality_deletes(rows, dels, ["l_orderkey"], "seq").select("l_orderkey", "l_linenumber")


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 p from orders) where p % 5 <> 0")
def mor_position_delete_scan(spark: SparkSession, d: str) -> DataFrame:
    """Orders without every fifth row of their file."""
    rows = load(spark, d, "orders").select("o_orderkey", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_pos"))
    return rows.join(rows.filter("_pos % 5 = 0").select("_name", "_pos"), ["_name", "_pos"], "left_anti").select("o_orderkey")


@query(f"with {LOG}, {_plan_sql('log')} select distinct bid // 6 rng, id from e where eq = 1")
def mor_distinct_equality_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the equality deletes of each range of six batches."""
    return _net(spark, d).filter("eq = 1").select(_six("bid").alias("rng"), "id").distinct()


def _six(col: str) -> Column:
    """Number of the range of six snapshots that one is in."""
    return F.floor(F.col(col) / 6).cast("bigint")


_POS = """ev as (select *, lag(event_id) over (partition by user_id order by event_id) prv from events), fi as (select distinct event_id // 100 f, event_id // 500 s from events),
 po as (select prv // 100 f, event_id // 500 s from ev where event_type = 'error' and prv is not null)"""


def _manifest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files of a hundred events and snapshots of five hundred; an error points to the file of its user's event before."""
    from pyspark.sql import Window

    e = load(spark, d, "events").select("event_id", "user_id", "event_type", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("prv"))
    div = lambda c, n: F.floor(F.col(c) / n).cast("bigint")
    files = e.select(div("event_id", 100).alias("file_path"), div("event_id", 500).alias("snapshot")).distinct()
    pos = e.filter("event_type = 'error' and prv is not null").select(div("prv", 100).alias("file_path"), div("event_id", 500).alias("snapshot"))
    return files, pos


@query(f"with {_POS} select s // 6 rng, f file_path, count(*) n from po where not exists (select 1 from fi where fi.f = po.f and fi.s // 6 = po.s // 6) group by 1, 2")
def validate_pos_delete_in_range(spark: SparkSession, d: str) -> DataFrame:
    """Of every range of six snapshots the position deletes that point out of it."""
    files, pos = (x.withColumn("rng", _six("snapshot")) for x in _manifest(spark, d))
    return compact.dangling(pos, files, ("rng",)).groupBy("rng", "file_path").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_POS} select fi.s // 6 dead_in, po.f file_path, count(*) n from po join fi on fi.f = po.f and fi.f % 2 = 1 and po.s // 6 > fi.s // 6 group by 1, 2")
def validate_dead_file_refs(spark: SparkSession, d: str) -> DataFrame:
    """Of every range of six snapshots, of which a compaction loses every other file, the later position deletes that point to one lost."""
    files, pos = (x.withColumn("rng", _six("snapshot")) for x in _manifest(spark, d))
    return compact.dead_references(pos, files.filter("file_path % 2 = 1"), "rng").groupBy(F.col("range").alias("dead_in"), "file_path").agg(F.count(F.lit(1)).alias("n"))


_MAN = "fi as (select distinct event_id // 100 f from events), ma as (select f file_path, f // 5 s, 'added' change from fi union all select f, f // 5 + 1 + f % 7, 'removed' from fi where f % 3 = 0)"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "events").select(F.floor(F.col("event_id") / 100).cast("bigint").alias("file_path")).distinct()
    five = F.floor(F.col("file_path") / 5)
    return f.select("file_path", five.alias("snapshot"), F.lit("added").alias("change")).unionByName(f.filter("file_path % 3 = 0").select("file_path", (five + 1 + F.col("file_path") % 7).alias("snapshot"), F.lit("removed").alias("change")))


@query(f"""with {_MAN}, r as (select *, s // 6 rng from ma) select rng, file_path, change from r a where not exists (select 1 from r b where b.rng = a.rng and b.file_path = a.file_path and b.change <> a.change)""")
def squash_net_files(spark: SparkSession, d: str) -> DataFrame:
    """What every range of six snapshots adds and removes in the end."""
    return compact.net_changes_by(_changes(spark, d).withColumn("rng", _six("snapshot")), ("rng",))


@query(
    f"""with {_MAN}, g as (select s // 4 rng, count(*) filter (where change = 'added') a, count(*) filter (where change = 'removed') r from ma group by 1)
 select rng, case when a + r = 0 then 'noop' when a = 0 then 'delete' when r = 0 then 'append' else 'overwrite' end operation from g"""
)
def squash_operation(spark: SparkSession, d: str) -> DataFrame:
    g = _changes(spark, d).groupBy(F.floor(F.col("snapshot") / 4).alias("rng")).agg(F.count(F.when(F.col("change") == "added", 1)).alias("a"), F.count(F.when(F.col("change") == "removed", 1)).alias("r"))
    return g.select("rng", compact.net_operation_column(F.lit(False), F.col("a"), F.lit(0), F.col("r")).alias("operation"))


@query(f"with {LOG}, {_plan_sql('log')}, {_STATE.format(q='', w='')}")
def compacted_state_equals_state(spark: SparkSession, d: str) -> DataFrame:
    """Every six batches compacted into one that counts as their last, then the state."""
    net = materialise(_net(spark, d).select("id", "seq", "v", "bid", "eq", "survives", _six("bid").alias("rng")), "net")
    rows = netchange.state(net, ["rng", "id"]).select("id", "seq", "v", "rng", F.lit(0).alias("eq"), F.lit(1).alias("survives"))
    keys = net.filter("eq = 1").select("rng", "id").distinct().select("id", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("double").alias("v"), "rng", F.lit(1).alias("eq"), F.lit(0).alias("survives"))
    return netchange.state(rows.unionByName(keys).withColumnRenamed("rng", "bid"), ["id"]).select("id", "seq", "v")


# tables --------------------------------------------------------------------------------------------------------------
_ORDER = T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("status", T.StringType())])


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_orderstatus").alias("status"))


@query("select o_orderkey, o_orderstatus status from orders where o_orderkey % 5 <> 0")
def table_position_deletes(spark: SparkSession, d: str) -> DataFrame:
    """The orders as a table, every fifth of them deleted by its file and place there, read by merging."""
    table = Table.create(spark, scratch_dir(spark, "positions"), _ORDER, ["o_orderkey"])
    table.append(_orders(spark, d))
    meta = table.metadata()
    files = meta.live(meta.refs["main"])
    paths = spark.createDataFrame([(f.name, f.path) for f in files], "_name string, file_path string")  # one row per file
    dead = merge(spark, files, meta.schemas[meta.schema], meta.schemas, positions=True).filter("o_orderkey % 5 = 0").join(paths, "_name")
    table.row_delta(None, None, dead.select("file_path", F.col("_pos").alias("pos")))
    return table.read()


@query("select o_orderkey, case when o_orderkey % 6 = 0 then 'X' else o_orderstatus end status from orders where o_orderkey % 3 <> 0 or o_orderkey % 6 = 0")
def table_row_delta(spark: SparkSession, d: str) -> DataFrame:
    """A partitioned table, of which a third is deleted by key and half of that written anew in the same commit."""
    table = Table.create(spark, scratch_dir(spark, "delta"), _ORDER, ["o_orderkey"], ["bucket[4](o_orderkey)"])
    o = _orders(spark, d)
    table.append(o)
    third = o.filter("o_orderkey % 3 = 0")
    table.row_delta(third.filter("o_orderkey % 6 = 0").withColumn("status", F.lit("X")), third.select("o_orderkey"), None)
    return table.read()


@query("select o_orderkey, case when o_orderkey % 6 = 0 then 'X' else o_orderstatus end status from orders where o_orderkey % 3 <> 0 or o_orderkey % 6 = 0")
def table_orc_files(spark: SparkSession, d: str) -> DataFrame:
    """The same on files of another format."""
    table = Table.create(spark, scratch_dir(spark, "orc"), _ORDER, ["o_orderkey"], None, {"write.format.default": "orc"})
    o = _orders(spark, d)
    table.append(o)
    third = o.filter("o_orderkey % 3 = 0")
    table.row_delta(third.filter("o_orderkey % 6 = 0").withColumn("status", F.lit("X")), third.select("o_orderkey"), None)
    return table.read()


@query("select o_orderkey, o_orderstatus status from orders where o_orderkey % 2 = 1")
def table_truncate(spark: SparkSession, d: str) -> DataFrame:
    """A table that was truncated between its two halves."""
    table = Table.create(spark, scratch_dir(spark, "truncated"), _ORDER, ["o_orderkey"])
    table.append(_orders(spark, d).filter("o_orderkey % 2 = 0"))
    table.truncate()
    table.append(_orders(spark, d).filter("o_orderkey % 2 = 1"))
    return table.read()


@query("select o_orderkey, o_orderstatus status from orders where not (o_orderkey % 3 = 0 and o_orderkey % 8 < 7)")
def table_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Eight commits, each of which adds an eighth of the orders and deletes a third of the eighth before it; the third to the sixth compacted into one, the later ones picked anew."""
    table = Table.create(spark, scratch_dir(spark, "compacted"), _ORDER, ["o_orderkey"])
    o, ids = _orders(spark, d), []
    for k in range(8):
        gone = o.filter((F.col("o_orderkey") % 8 == k - 1) & (F.col("o_orderkey") % 3 == 0)).select("o_orderkey")
        ids.append(table.row_delta(o.filter(F.col("o_orderkey") % 8 == k), gone, None).id)
    compact.compact(table, ids[1], ids[5])
    return table.read()


@query("select o_orderkey, o_orderstatus status from orders where o_orderkey % 3 = 2 and o_orderstatus = 'F'")
def table_scan_after_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows of the files that came after a sequence, under a predicate that reaches them."""
    table = Table.create(spark, scratch_dir(spark, "sequences"), _ORDER, ["o_orderkey"])
    seqs = [table.append(_orders(spark, d).filter(F.col("o_orderkey") % 3 == k)).seq for k in range(3)]
    return table.scan(DATA, "c2 = 'F'", after_seq=seqs[1]).select(F.col("c1").alias("o_orderkey"), F.col("c2").alias("status"))


@query("select o_orderkey % 3 part, count(*) n from orders group by 1")
def table_files_by_partition(spark: SparkSession, d: str) -> DataFrame:
    """What a rewrite may put together: the files of each partition, and the rows they hold."""
    table = Table.create(spark, scratch_dir(spark, "parts"), T.StructType([*_ORDER.fields, T.StructField("part", T.LongType())]), ["o_orderkey"], ["part"])
    o = _orders(spark, d).withColumn("part", F.col("o_orderkey") % 3)
    for k in range(2):
        table.append(o.filter(F.col("o_orderkey") % 2 == k))
    meta = table.metadata()
    out = None
    for files in by_partition(meta.live(meta.refs["main"])).values():  # one frame per partition
        got = merge(spark, files, meta.schemas[meta.schema], meta.schemas).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        out = got if out is None else out.unionByName(got)
    return out


@query("select o_orderkey, o_orderstatus status, 'tag' seen from orders where o_orderkey % 2 = 0 union all select o_orderkey, o_orderstatus, 'head' from orders where o_orderkey % 4 <> 0")
def table_time_travel(spark: SparkSession, d: str) -> DataFrame:
    """A table as it was at a tag, and as it is after more rows, deletes and another name of a column."""
    table = Table.create(spark, scratch_dir(spark, "travelled"), _ORDER, ["o_orderkey"])
    o = _orders(spark, d)
    table.tag("even", table.append(o.filter("o_orderkey % 2 = 0")).id)
    table.rename("status", "state")
    table.row_delta(o.filter("o_orderkey % 2 = 1").withColumnRenamed("status", "state"), o.filter("o_orderkey % 4 = 0").select("o_orderkey"), None)
    return table.read("even").withColumn("seen", F.lit("tag")).unionByName(table.read().withColumnRenamed("state", "status").withColumn("seen", F.lit("head")))


# history -------------------------------------------------------------------------------------------------------------
_LOCAL = "(make_timestamp(t * 1000) + interval 7 hour)"


def _key_sql() -> str:
    p = upkeep.Points.at(NOW, RULES)
    ms = lambda x: int(x.timestamp() * 1000)
    raw = f"strftime({_LOCAL}, '%Y-%m-%dT%H:%M:%S') || case when t % 1000 > 0 then '.' || lpad(cast(t % 1000 as varchar), 3, '0') else '' end"
    return f"case when t >= {ms(p.hour)} then {raw} when t >= {ms(p.day)} then strftime({_LOCAL}, '%Y-%m-%dT%H') when t >= {ms(p.month)} then strftime({_LOCAL}, '%Y-%m-%d') when t >= {ms(p.year)} then strftime({_LOCAL}, '%Y-%m') else strftime({_LOCAL}, '%Y') end"


_SNAPS = "sn as (select bid id, max(ts_ms) t from b group by bid)"


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return _plan(_log(spark, d)).groupBy("bid").agg(F.max("ts_ms").alias("t"))


@query(f"with ts as (select user_id, max(epoch_us(ts) // 1000) t from events group by 1) select user_id, t, {_key_sql()} \"key\" from ts")
def compaction_points_keys(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    rows = e.select("user_id", F.call_function("div", micros(e, "ts"), F.lit(1000).cast("bigint")).alias("t")).groupBy("user_id").agg(F.max("t").alias("t"))
    return rows.select("user_id", "t", upkeep.Points.at(NOW, RULES).key_column(F.col("t")).alias("key"))


@query(
    f"""with {LOG}, {_plan_sql('log')}, {_SNAPS}, k as (select id, {_key_sql()} "key" from sn), c as (select *, case when lag("key") over (order by id) is not distinct from "key" and row_number() over (order by id) > 1 then 0 else 1 end ch, lag(id) over (order by id) prv from k),
 g as (select *, sum(ch) over (order by id) g from c) select "key", count(*) size, arg_min_null(prv, id) low, max(id) high from g group by g, "key\""""
)
def compaction_groups(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.groups_of(_snapshots(spark, d), upkeep.Points.at(NOW, RULES).key_column(F.col("t")), "bid", "bid")


@query()
def cherrypick_chain(spark: SparkSession, d: str) -> DataFrame:
    """The whole log as a table; of every three days the batches of the first two compacted, oldest first, and each time all later snapshots picked anew: its chain with what each snapshot came from. Other rows than before are an error."""
    table, days = _state_table(spark, d)
    before = table.metadata().refs.get("main")
    meta, ranges = table.metadata(), []
    for k in range(0, len(days), 3):
        run = [i for day in days[k : k + 2] for i in day]
        if len(run) > 1:
            ranges.append((meta.snapshots[run[0]].parent, run[-1]))
    compact.compact_all(table, ranges)
    meta = table.metadata()
    old, new = table.read(before).withColumn("_n", F.lit(1)), table.read().withColumn("_n", F.lit(-1))
    if before is not None and not old.unionByName(new).groupBy("id", "v").agg(F.sum("_n").alias("_n")).filter("_n <> 0").isEmpty():
        raise RuntimeError("the table's rows are others after the compactions")
    rows = [(s.id, s.parent, s.op, s.summary.get(SOURCE), s.summary.get(SQUASHED)) for s in meta.ancestors(meta.refs.get("main"))]
    return spark.createDataFrame(rows, "id bigint, parent bigint, op string, picked_from string, squashed string")


def _state_table(spark: SparkSession, d: str) -> tuple[Table, list[list[int]]]:
    """The log as a table, a commit per batch, and the snapshots of each day in order; a day that comes again later is another. As in a capture, one job writes the files of all commits."""
    net = materialise(_net(spark, d).select("bid", "dt", "ts_ms", "id", "v", "eq", "survives"), "net")
    table = Table.create(spark, scratch_dir(spark, "table"), T.StructType([T.StructField("id", T.LongType(), False), T.StructField("v", T.DoubleType())]), ["id"])
    files: dict[int, list] = defaultdict(list)
    written = table.write_data(net.filter("survives = 1").select("id", "v", "bid"), clustered=True, by="bid")
    for f in [*written, *table.write_equality_deletes(net.filter("eq = 1").select("id", "bid"), by="bid")]:
        files[int(part_value(f))].append(f)
    batches = net.groupBy("bid").agg(F.max("dt").alias("dt"), F.max("ts_ms").alias("t")).orderBy("bid").collect()  # one row per commit
    made = table.commit_all([(files[r.bid], {TS: str(r.t)}) for r in batches])
    return table, [[s.id for _, s in day] for _, day in groupby(zip(batches, made), key=lambda x: x[0].dt)]


@query(
    """with recursive s as (select distinct user_id id, case when user_id % 10 <> 0 then user_id - 1 end parent, user_id * 3600000 t from events),
 a(id) as (select id from s where id in (57, 33) union select s.parent from s join a on a.id = s.id where s.parent is not null)
 select id from s where id not in (select id from a where id is not null) and t < 100 * 3600000"""
)
def expire_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots out of reach of both refs and older than the age; ids and parents are derived from users."""
    rows = load(spark, d, "events").select("user_id").distinct().collect()  # one row per snapshot
    snaps = {r.user_id: Snapshot(r.user_id, r.user_id - 1 if r.user_id % 10 else None, r.user_id, r.user_id * 3_600_000, "append", 0) for r in rows}
    meta = Metadata({}, 0, 0, [], {}, 0, {}, snaps, {"main": 57, "kept": 33})
    return spark.createDataFrame([(i,) for i in upkeep.orphans(meta, 200 * 3_600_000, 100 * 3_600_000)], "id bigint")


@query(
    f"""with {LOG}, {_plan_sql('log')}, {_SNAPS}, k as (select *, {_key_sql()} "key" from sn), c as (select *, case when lag("key") over (order by id) is not distinct from "key" and row_number() over (order by id) > 1 then 0 else 1 end ch from k),
 g as (select *, sum(ch) over (order by id) g from c), r as (select g, "key", count(*) n, max(id) high, max(t) t from g group by g, "key"),
 o as (select *, min(case when n = 1 and t < {int(upkeep.Points.at(NOW, RULES).day.timestamp() * 1000)} and "key" not like '%T%' then 1 else 0 end) over (order by g) ok from r) select "key" tag, high as snapshot from o where ok = 1"""
)
def tag_days(spark: SparkSession, d: str) -> DataFrame:
    rows = _snapshots(spark, d).orderBy("bid").collect()  # one row per snapshot
    chain = [Snapshot(r.bid, r.bid - 1 if r.bid > 1 else None, r.bid, r.t, "append", 0, {TS: str(r.t)}) for r in reversed(rows)]
    return spark.createDataFrame(upkeep.day_tags(chain, upkeep.Points.at(NOW, RULES), []), "tag string, snapshot bigint")


# functions and types -------------------------------------------------------------------------------------------------
_D = "cast(o_orderdate as timestamp)"


@query(f"select o_orderkey, year({_D}) - 1970 y, (year({_D}) - 1970) * 12 + month({_D}) - 1 m, epoch_ms({_D}) // 86400000 \"day\", epoch_ms({_D}) // 3600000 h from orders")
def transform_year_month_day_hour(spark: SparkSession, d: str) -> DataFrame:
    o, c = load(spark, d, "orders"), F.col("o_orderdate")
    return o.select("o_orderkey", *[f(c).cast("bigint").alias(n) for n, f in (("y", transforms.year), ("m", transforms.month), ("day", transforms.day), ("h", transforms.hour))])


@query("select p_partkey, (p_partkey - 1000) - (((p_partkey - 1000) % 50) + 50) % 50 k, p_name[1:4] s from part")
def transform_truncate_int_string(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    return p.select("p_partkey", transforms.truncate_number(F.col("p_partkey") - 1000, 50).alias("k"), transforms.truncate_text(F.col("p_name"), 4).alias("s"))


_M = 4294967295


def _murmur_sql(x: str) -> str:
    mul = lambda a, k: f"(({a}) * {k}::hugeint & {_M})"
    rot = lambda a, n: f"(((({a}) << {n}) | (({a}) >> {32 - n})) & {_M})"
    steps = [f"c0 as (select *, ({x} & {_M})::hugeint lo, ({x} >> 32 & {_M})::hugeint hi from customer)"]
    steps.append(f"c1 as (select *, {mul('lo', 3432918353)} a1, {mul('hi', 3432918353)} b1 from c0)")
    steps.append(f"c2 as (select *, {mul(rot('a1', 15), 461845907)} a2, {mul(rot('b1', 15), 461845907)} b2 from c1)")
    steps.append(f"c3 as (select *, ({rot('a2', 13)} * 5 + 3864292196) & {_M} h1 from c2)")
    steps.append("c4 as (select *, xor(h1, b2) x1 from c3)")
    steps.append(f"c5 as (select *, xor(({rot('x1', 13)} * 5 + 3864292196) & {_M}, 8::hugeint) h2 from c4)")
    steps.append(f"c6 as (select *, {mul('xor(h2, h2 >> 16)', 2246822507)} h3 from c5)")
    steps.append(f"c7 as (select *, {mul('xor(h3, h3 >> 13)', 3266489909)} h4 from c6)")
    return "with " + ", ".join(steps) + " select c_custkey, cast((xor(h4, h4 >> 16) & 2147483647) % 16 as bigint) bucket from c7"


@query(_murmur_sql("c_custkey"))
def transform_bucket(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    return c.select("c_custkey", transforms.bucket(c, "c_custkey", 16).cast("bigint").alias("bucket"))


@query()
def transform_bucket_text(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    return c.select("c_name", transforms.bucket(c, "c_name", 16).alias("bucket"))


@query("select event_id, (x - ((x % 1000) + 1000) % 1000) // 1000 us, (x - ((x % 1000000) + 1000000) % 1000000) // 1000000 ms, x * 1000 up from (select event_id, (event_id - 5000) * 1234567 x from events)")
def type_time_precision(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("event_id") - 5000) * 1_234_567
    return load(spark, d, "events").select("event_id", time.convert(x, "NANOS", "MICROS").alias("us"), time.convert(x, "NANOS", "MILLIS").alias("ms"), time.convert(x, "MICROS", "NANOS").alias("up"))


_TF = "'%Y-%m-%d %H:%M:%S.%f'"


@query(
    f"""select event_id, strftime(make_timestamp(x * 1000), {_TF}) from_ms, strftime(make_timestamp(x * 7), {_TF}) from_us, strftime(make_timestamp(((x * 999) - (((x * 999) % 1000) + 1000) % 1000) // 1000), {_TF}) from_ns,
 strftime(date '1970-01-01' + cast(event_id - 5000 as int), '%Y-%m-%d') from_days from (select event_id, (event_id - 5000) * 86399999 x from events)"""
)
def type_timestamps(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("event_id") - 5000) * 86_399_999
    text = lambda c, n: F.date_format(logical.convert_column(c, n), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return load(spark, d, "events").select(
        "event_id", text(x, "io.debezium.time.Timestamp").alias("from_ms"), text(x * 7, "io.debezium.time.MicroTimestamp").alias("from_us"), text(x * 999, "io.debezium.time.NanoTimestamp").alias("from_ns"),
        F.date_format(logical.convert_column((F.col("event_id") - 5000).cast("int"), "io.debezium.time.Date"), "yyyy-MM-dd").alias("from_days"),
    )


_X = "cast(round(l_extendedprice * 100) as bigint) * case when l_linenumber % 2 = 0 then -1 else 1 end"


@query(f"select l_orderkey, l_linenumber, cast(cast({_X} * case l_linenumber % 5 when 0 then 10000 when 1 then 1000 when 2 then 100 when 3 then 10 else 1 end as decimal(18, 0)) * cast(0.0001 as decimal(20, 18)) as varchar) \"value\" from lineitem")
def type_decimal_variable_scale(spark: SparkSession, d: str) -> DataFrame:
    x = F.round(F.col("l_extendedprice") * 100).cast("bigint") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct((F.col("l_linenumber") % 5).alias("scale"), F.unhex(F.lpad(F.hex(x), 16, "0")).alias("value")).alias("n"))
    return rows.select("l_orderkey", "l_linenumber", logical.convert_column(F.col("n"), "io.debezium.data.VariableScaleDecimal").cast("string").alias("value"))


@query("select p_partkey, len(string_split(replace(p_type, ' ', ','), ',')) members, replace(p_type, ' ', '|') joined from part")
def type_enum_set_split(spark: SparkSession, d: str) -> DataFrame:
    members = logical.enum_set(F.regexp_replace("p_type", " ", ","))
    return load(spark, d, "part").select("p_partkey", F.size(members).cast("bigint").alias("members"), F.array_join(members, "|").alias("joined"))


@query(f"select o_orderkey, case when o_orderkey % 97 = 0 then 9223372036854775807 when o_orderkey % 89 = 0 then -9223372036854775808 else epoch_us({_D}) - 7 * 3600000000::bigint end us from orders")
def type_zoned_timestamp(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 97 == 0, "infinity").when(F.col("o_orderkey") % 89 == 0, "-infinity").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+07:00")))
    return load(spark, d, "orders").select("o_orderkey", logical.zoned_micros(text).alias("us"))


@query(
    """with f as (select event_id, case when event_id % 2 = 0 then 'mysql-bin.' else 'binlog.' end || lpad(cast(event_id * 37 % 1200000 as varchar), 6, '0') file, event_id * 13 % 1000 pos from events),
 n as (select event_id, cast(regexp_extract(file, '\\.(\\d+)$', 1) as bigint) file_no, pos from f)
 select event_id, file_no, coalesce((file_no, pos) > lag((file_no, pos)) over (order by event_id), false) forward from n"""
)
def wal_position_parse_compare(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    file = F.concat(F.when(e % 2 == 0, "mysql-bin.").otherwise("binlog."), F.expr("case when length(cast(event_id * 37 % 1200000 as string)) < 6 then lpad(cast(event_id * 37 % 1200000 as string), 6, '0') else cast(event_id * 37 % 1200000 as string) end"))
    rows = load(spark, d, "events").select("event_id", wal.mysql_position(file, e * 13 % 1000).alias("at"))
    rows = running(rows, ["event_id"], {"prev": ("lag", F.col("at"))})
    return rows.select("event_id", F.col("at.file").alias("file_no"), F.coalesce(F.col("at") > F.col("prev"), F.lit(False)).alias("forward"))


ORACLE["wal_position_parse_compare"] = ORACLE["wal_position_parse_compare"].replace("lpad(cast(event_id * 37 % 1200000 as varchar), 6, '0')", "case when event_id * 37 % 1200000 < 100000 then lpad(cast(event_id * 37 % 1200000 as varchar), 6, '0') else cast(event_id * 37 % 1200000 as varchar) end")


@query(
    f"""with {LOG}, o as (select dt, part, max(off) + 1 nx from log group by 1, 2), j as (select dt, '{{' || string_agg('"' || part || '":' || nx, ',' order by part) || '}}' js from o group by dt)
 select strftime(o.dt, '%Y-%m-%d') "day", js, part, nx as "next" from o join j on j.dt = o.dt"""
)
def offsets_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    o = _log(spark, d).groupBy("dt", "kafka_partition").agg((F.max("kafka_offset") + 1).alias("nx"))
    j = o.groupBy("dt").agg(wal.offsets_json(F.map_from_entries(F.collect_list(F.struct("kafka_partition", "nx")))).alias("js"))
    return j.select(F.date_format("dt", "yyyy-MM-dd").alias("day"), "js", F.explode(wal.offsets_map(F.col("js"))).alias("part", "next")).select("day", "js", F.col("part").cast("bigint").alias("part"), "next")


_DURATIONS = [("1 hour 200 minutes", 15_600_000_000_000, "4h20m"), ("3600 secs", 3_600_000_000_000, "1h"), ("2h3m4s5ms6us7ns", 7_384_005_006_007, "2h3m4s5ms6us7ns"), ("10M", 600_000_000_000, "10m"), ("3 days", None, None), ("", None, None), ("0s", 0, "0s"), ("1 millis", 1_000_000, "1ms")]


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "null" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


@query(f"select * from (values {_values(_DURATIONS)}) t(txt, nanos, shown)")
def duration_parse_format(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([(t,) for t, _, _ in _DURATIONS], "txt string")
    return df.select("txt", time.duration_nanos(F.col("txt")).alias("nanos")).select("txt", "nanos", time.duration_text(F.col("nanos")).alias("shown"))


_TOPICS = "select case when n_nationkey % 3 = 0 then 'debezium.mysql.' when n_nationkey % 3 = 1 then 'debezium.mysql.Shop.' else 'other.' end || n_name topic from nation"


def _topics(spark: SparkSession, d: str) -> DataFrame:
    prefix = F.when(F.col("n_nationkey") % 3 == 0, "debezium.mysql.").when(F.col("n_nationkey") % 3 == 1, "debezium.mysql.Shop.").otherwise("other.")
    return load(spark, d, "nation").select(F.concat(prefix, "n_name").alias("topic"))


@query(f"select topic from ({_TOPICS}) where starts_with(topic, 'debezium.mysql') and contains(topic[16:], '.') and topic <> 'debezium.mysql.Shop.BRAZIL'")
def topic_filter(spark: SparkSession, d: str) -> DataFrame:
    return topics.available(_topics(spark, d), "topic", "debezium.mysql.", exclude=["debezium.mysql.Shop.BRAZIL"])


@query(f"select topic, array_to_string(p[1:len(p) - 1], '.') namespace, p[-1] \"name\" from (select topic, string_split(case when starts_with(topic, 'debezium.') then topic[10:] else topic end, '.') p from ({_TOPICS}))")
def topic_to_table(spark: SparkSession, d: str) -> DataFrame:
    ns, name = topics.table_id(F.col("topic"), "debezium.")
    return _topics(spark, d).select("topic", ns.alias("namespace"), name.alias("name"))


@query(f"select topic, case when starts_with(topic, 'debezium.mysql.Shop.') then 'dvd.rental' else null end namespace, lower(string_split(topic, '.')[-1]) \"name\" from ({_TOPICS}) where starts_with(topic, 'debezium.mysql.Shop')")
def naming_adjust(spark: SparkSession, d: str) -> DataFrame:
    chain = topics.Chain(topics.ChangeCase("lower", "lower"), topics.MapNamespaces({"shop": "dvd.rental"}))
    ns, name = topics.table_id(F.col("topic"), "debezium.mysql.")
    return _topics(spark, d).filter(F.col("topic").startswith("debezium.mysql.Shop")).select("topic", chain.namespace(ns).alias("namespace"), chain.table(name).alias("name"))


# manifests, offsets, orders ------------------------------------------------------------------------------------------
@query(f"with {LOG} select part, max(off) + 1 as \"next\" from log group by part")
def src_latest_offsets(spark: SparkSession, d: str) -> DataFrame:
    return changelog.next_offsets(_log(spark, d)).select(F.col("part").cast("bigint").alias("part"), "next")


@query(f"with {LOG} select part, arg_min(seq, off) seq from log where op <> 'd' group by part")
def src_first_record_probe(spark: SparkSession, d: str) -> DataFrame:
    """Per partition the first record with a value, which tells the schema."""
    log = _log(spark, d).filter("op <> 'd'")
    return log.groupBy(F.col("kafka_partition").cast("bigint").alias("part")).agg(F.min_by("seq", "kafka_offset").alias("seq"))


@query(f"with {LOG}, {_plan_sql('log')} select bid, op, count(*) n from b group by bid, op")
def agg_op_counters(spark: SparkSession, d: str) -> DataFrame:
    return _plan(_log(spark, d)).groupBy("bid", "op").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_POS} select f file_path, s snapshot, row_number() over (partition by s order by f, p) pos_order, p pos from (select prv // 100 f, event_id // 500 s, prv % 100 p from ev where event_type = 'error' and prv is not null)")
def sort_position_deletes(spark: SparkSession, d: str) -> DataFrame:
    """Position deletes of each snapshot in the order their files hold them."""
    from pyspark.sql import Window

    e = load(spark, d, "events").select("event_id", "event_type", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("prv")).filter("event_type = 'error' and prv is not null")
    rows = e.select(F.floor(F.col("prv") / 100).alias("file_path"), F.floor(F.col("event_id") / 500).alias("snapshot"), (F.col("prv") % 100).alias("pos"))
    return rows.withColumn("pos_order", F.row_number().over(Window.partitionBy("snapshot").orderBy("file_path", "pos")).cast("bigint"))


@query(f"with {_MAN} select f file_path, f // 5 snapshot from fi where f // 5 > 4")
def manifest_after_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a manifest that came after a sequence."""
    return _changes(spark, d).filter("change = 'added' and snapshot > 4").select("file_path", "snapshot")


@query(f"with {_MAN} select f % 8 part, count(*) files, min(f) first, max(f) last from fi group by 1")
def group_files_by_partition(spark: SparkSession, d: str) -> DataFrame:
    """What a rewrite may put together: files per partition."""
    f = _changes(spark, d).filter("change = 'added'")
    return f.groupBy((F.col("file_path") % 8).alias("part")).agg(F.count(F.lit(1)).alias("files"), F.min("file_path").alias("first"), F.max("file_path").alias("last"))


@query(f"with {_MAN} select f file_path from fi where f % 3 = 0 and f % 6 <> 0")
def set_dead_files(spark: SparkSession, d: str) -> DataFrame:
    """Files added less those added again: difference and union of sets of paths."""
    gone = _changes(spark, d).filter("change = 'removed'").select("file_path")
    again = gone.filter("file_path % 6 = 0").unionByName(gone.filter("file_path % 12 = 0"))
    return gone.subtract(again)


@query(f"with {LOG}, {_plan_sql('log')}, g as (select bid, max(ts_ms) t from b group by bid), r as (select id, v, seq from log where op <> 'd') select id, seq, v from r where seq % 7 = 3 and v > 50")
def scan_residual_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a table's raw files under a predicate that reaches the files."""
    table = Table.create(spark, scratch_dir(spark, "raw"), T.StructType([T.StructField("id", T.LongType(), False), T.StructField("seq", T.LongType()), T.StructField("v", T.DoubleType())]), ["id"])
    table.append(_log(spark, d).filter("op <> 'd'").select("id", "seq", "v"))
    return table.scan(DATA, "c2 % 7 = 3 and c3 > 50").select(F.col("c1").alias("id"), F.col("c2").alias("seq"), F.col("c3").alias("v"))


# schemas -------------------------------------------------------------------------------------------------------------
def _orders_table(spark: SparkSession, d: str, late: T.StructType) -> Table:
    """Half of the orders in a narrow schema, the other half after a migration."""
    early = T.StructType([T.StructField("o_orderkey", T.IntegerType(), False), T.StructField("note", T.StringType()), T.StructField("price", T.FloatType())])
    o = load(spark, d, "orders")
    table = Table.create(spark, scratch_dir(spark, "orders"), early, ["o_orderkey"])
    table.append(o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderpriority").alias("note"), F.col("o_custkey").cast("float").alias("price")))
    table.evolve(late)
    return table


@query("select o_orderkey, cast(cast(o_custkey as float) as double) price, case when o_orderkey % 2 = 1 then o_orderstatus end status from orders")
def schema_promotion_read(spark: SparkSession, d: str) -> DataFrame:
    """Old files are read in wider types, added columns are null there."""
    late = T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("note", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("status", T.StringType())])
    table = _orders_table(spark, d, late)
    table.append(load(spark, d, "orders").filter("o_orderkey % 2 = 1").select("o_orderkey", F.col("o_orderpriority").alias("note"), F.col("o_custkey").cast("double").alias("price"), F.col("o_orderstatus").alias("status")))
    return table.read().select("o_orderkey", "price", "status")


@query("select o_orderkey, case when o_orderkey % 2 = 1 then o_custkey end note from orders")
def schema_replace_column_nulls(spark: SparkSession, d: str) -> DataFrame:
    """A column of a type that can't be promoted is another column of the same name: old files have nulls."""
    late = T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("note", T.LongType())])
    table = _orders_table(spark, d, late)
    table.append(load(spark, d, "orders").filter("o_orderkey % 2 = 1").select("o_orderkey", F.col("o_custkey").alias("note")))
    return table.read().select("o_orderkey", "note")


_OLD = "a int, b bigint, c struct<x:int,y:string>, d array<int>, e map<string,int>, f decimal(10,3), g string"
_NEW = "a bigint, c struct<x:bigint,z:string>, d array<string>, e map<string,bigint>, f decimal(20,3), g boolean, h double"
_DIFF = [
    ("promote", "a", "bigint"), ("drop", "b", ""), ("promote", "c.x", "bigint"), ("drop", "c.y", ""), ("add", "c.z", "optional string"), ("replace", "d", "array<string>"), ("promote", "e.value", "bigint"),
    ("promote", "f", "decimal(20,3)"), ("replace", "g", "boolean"), ("add", "h", "optional double"),
]


@query(f"select * from (values {_values(_DIFF)}) t(kind, \"path\", detail)")
def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    old, last = evolve.assign_ids(T.StructType.fromDDL(_OLD), 0)
    _, changes, _ = evolve.migrate(old, T.StructType.fromDDL(_NEW), last)
    return spark.createDataFrame([(c.kind, c.path, c.detail) for c in changes], "kind string, path string, detail string")


# end to end ----------------------------------------------------------------------------------------------------------
@query(f"with {LOG}, {_plan_sql('log')}, {_STATE.format(q='', w='').replace('e.id, e.seq, e.v', 'e.id, e.v')}")
def capture_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """JSON messages of the log captured into a table, in two micro-batches of which the second repeats a part of the first, and read by merging deletes."""
    row = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("v", T.DoubleType())])
    one = derive.message_schema(row)
    value = {"type": "struct", "version": 1, "fields": [{**one, "field": "before", "optional": True}, {**one, "field": "after", "optional": True}]}
    key = {"type": "struct", "version": 1, "fields": [{"field": "id", "type": "int64", "optional": False}]}
    import json

    log = _log(spark, d)
    wrap = lambda schema, payload: F.concat(F.lit(f'{{"schema":{json.dumps(schema)},"payload":'), payload, F.lit("}"))
    payload = F.to_json(F.struct("op", F.when(F.col("op") != "c", F.struct("id", F.col("pv").alias("v"))).alias("before"), F.when(F.col("op") != "d", F.struct("id", "v")).alias("after"), F.struct("ts_ms", "lsn").alias("source"), "ts_ms"))
    messages = log.select(
        F.lit("pg.public.users").alias("topic"), F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"), F.timestamp_millis("ts_ms").alias("timestamp"),
        wrap(key, F.to_json(F.struct("id"))).alias("key"), wrap(value, payload).alias("value"), "seq",
    )
    half = log.agg(F.max("seq")).head()[0] // 2
    capture = Capture(spark, "pg.public.users", scratch_dir(spark, "captured"), Stream("debezium", "postgres", commit_batch_size=100_000))
    capture(messages.filter(F.col("seq") <= half).drop("seq"), 0)
    capture(messages.filter(F.col("seq") > half - 300).drop("seq"), 1)
    return capture.table.read().select("id", "v")


__all__ = ["DATA", "ORACLE", "QUERIES"]
