"""Capture of a change topic into a table, micro-batch by micro-batch, each record's effect exactly once.

A micro-batch is ordered as a merge of its partitions, marked against the table's high-water marks, cut into commits and
planned as net changes in one pass; files of all commits are written by one job and then committed in order. Every
snapshot carries the offsets up to which it holds the topic, so that a micro-batch that is replayed after a crash, whole or
in part, skips what the table already has.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Stream
from ..functions.time import source_day
from ..functions.wal import file_index
from ..operators import netchange
from ..operators.scan import cuts_of
from ..schema import derive
from ..schema.evolve import should_migrate
from ..session import materialise
from ..table.log import OFFSETS, TS, WAL, File, Table, part_value

VERSION = "schema-version"
#: What is counted of each record.
COUNTS = {
    "reads": "op = 'r'", "creates": "op = 'c'", "updates": "op = 'u'", "deletes": "op = 'd'", "truncates": "op = 't'", "out_of_order": "ts_back or wal_back", "maybe_duplicates": "dup",
}


def json_type(schema: dict) -> T.DataType:
    """How a message schema's values stand in JSON: as their physical types, decimals as numbers."""
    if schema.get("name", "").endswith(".Decimal"):
        return derive.table_type(schema)
    kind = schema["type"]
    if kind == "struct":
        return T.StructType([T.StructField(f["field"], json_type(f)) for f in schema["fields"]])
    if kind == "array":
        return T.ArrayType(json_type(schema["items"]))
    if kind == "map":
        return T.MapType(json_type(schema["keys"]), json_type(schema["values"]))
    return derive.PHYSICAL[kind]


def _field(schema: dict, name: str) -> dict:
    return next(f for f in schema["fields"] if f["field"] == name)


class Capture:
    """The body of ``foreachBatch`` for one topic.

    Messages: topic string, partition int, offset bigint, timestamp timestamp, key and value string, each of which is JSON
    with ``schema`` and ``payload``; a null value is a tombstone.
    """

    def __init__(self, spark: SparkSession, topic: str, root: str, settings: Stream, *, spec: list[str] | None = None, properties: dict[str, str] | None = None):
        #: Since the start: records by operation, records out of order, likely duplicates, commits, schema migrations.
        self.metrics: dict[str, int] = defaultdict(int)
        self.spark, self.topic, self.table, self.settings, self.spec, self.properties = spark, topic, Table(spark, root), settings, spec, properties or {}
        self.query, self._again = None, None

    # planning
    def committed(self) -> dict[int, int]:
        """Next offset per partition, as the table has it."""
        if not self.table.exists():
            return {}
        return {int(k): v for k, v in json.loads(self.table.summary_of(OFFSETS) or "{}").items()}

    def last_source_ms(self) -> int | None:
        """The largest source time that the table has."""
        ts = self.table.summary_of(TS) if self.table.exists() else None
        return int(ts) if ts not in (None, "None") else None

    def lag(self, latest: dict[int, int]) -> int:
        """Offsets that the table is behind the next ones per partition."""
        done = self.committed()
        return sum(max(0, n - done.get(p, 0)) for p, n in latest.items())

    def _position(self, v: Column) -> Column:
        if self.settings.connector == "mysql":
            return F.struct(F.coalesce(file_index(v.getField("source").getField("file")), F.lit(0)).alias("f"), v.getField("source").getField("pos").alias("p"))
        return F.struct(F.lit(0).cast("bigint").alias("f"), v.getField("source").getField("lsn").alias("p"))

    def plan(self, batch: DataFrame) -> DataFrame:
        """The micro-batch's new records in order, with ``bid`` and their high-water marks; tombstones are left out."""
        own = batch.filter(F.col("topic") == self.topic)
        done = self.committed()
        if done:
            seen = F.create_map(*[F.lit(x) for kv in sorted(done.items()) for x in kv])
            own = own.filter(F.col("offset") >= F.coalesce(F.element_at(seen, F.col("partition")), F.lit(0)))
        v = F.from_json(F.get_json_object("value", "$.payload"), "op string, ts_ms bigint, source struct<ts_ms:bigint,file:string,pos:bigint,lsn:bigint>")
        rows = own.withColumn("_v", v).select(
            "partition", "offset", "key", "value", F.col("_v.op").alias("op"), F.col("_v.source.ts_ms").alias("ts"), self._position(F.col("_v")).alias("wal"),
            F.coalesce(F.col("_v.source.ts_ms"), F.unix_millis("timestamp")).alias("order_ts"),
            F.concat(F.lit("key="), F.coalesce(F.get_json_object("key", "$.schema.version"), F.lit("1")), F.lit(",value="), F.coalesce(F.get_json_object("value", "$.schema.version"), F.lit("1"))).alias("version"),
        )
        ordered = netchange.merge_order(rows, "partition", "offset", "order_ts")
        minutes = int(self.settings.rotate_tz.utcoffset(None).total_seconds() // 60)
        ordered = ordered.filter("value is not null and get_json_object(value, '$.payload') is not null").withColumn("day", source_day(F.col("ts"), minutes))
        seed_ts, seed_wal = self._seeds()
        cuts = cuts_of(ordered, "place")
        marked = netchange.high_water(ordered, "place", F.col("ts"), F.col("wal"), seed_ts=seed_ts, seed_wal=seed_wal, cuts=cuts)
        return netchange.batches(marked, "place", self.settings.commit_batch_size, ["day", "version"], cuts=cuts)

    def _seeds(self) -> tuple[int | None, Column | None]:
        if not self.table.exists():
            return None, None
        ts, wal = self.table.summary_of(TS), self.table.summary_of(WAL)
        seed = None
        if wal:
            w = json.loads(wal)
            seed = F.struct(F.lit(w["f"]).cast("bigint").alias("f"), F.lit(w["p"]).cast("bigint").alias("p"))
        return (int(ts) if ts else None), seed

    # applying
    def __call__(self, batch: DataFrame, batch_id: int = 0) -> int:
        """Apply a micro-batch; gives the number of commits."""
        batch = materialise(batch, "micro-batch")
        plan = materialise(self.plan(batch), "plan")
        # rows per commit, version and partition: metadata of the commits
        marks = plan.groupBy("bid", "version", "partition").agg(F.max("offset").alias("o"), F.max("ts").alias("ts"), F.max("wal").alias("wal"), F.max((F.col("op") == "t").cast("int")).alias("t"), *[F.count_if(F.expr(c)).alias(n) for n, c in COUNTS.items()]).orderBy("bid").collect()
        if not marks:
            return 0
        for m in marks:
            for n in COUNTS:
                self.metrics[n] += m[n]
        offsets, ts, wal = self.committed(), None, None
        if self.table.exists():
            ts = int(self.table.summary_of(TS) or 0) or None
            w = json.loads(self.table.summary_of(WAL) or "null")
            wal = (w["f"], w["p"]) if w else None
        per: dict[int, list] = defaultdict(list)
        for m in marks:
            per[m.bid].append(m)
        runs: list[tuple[str, list[int]]] = []
        for bid, ms in per.items():
            if not runs or runs[-1][0] != ms[0].version:
                runs.append((ms[0].version, []))
            runs[-1][1].append(bid)
        # tombstones behind the last record belong to its commit
        ends = {r.partition: r.o + 1 for r in batch.filter(F.col("topic") == self.topic).groupBy("partition").agg(F.max("offset").alias("o")).collect()}
        last = max(per)
        commits = 0
        for version, bids in runs:
            files = self._write(plan.filter((F.col("bid") >= bids[0]) & (F.col("bid") <= bids[-1])), version)
            for bid in bids:
                for m in per[bid]:
                    offsets[m.partition] = max(offsets.get(m.partition, 0), m.o + 1)
                    ts = m.ts if ts is None else max(ts, m.ts or ts)
                    if m.wal and m.wal.p is not None:
                        wal = max(wal, (m.wal.f, m.wal.p)) if wal else (m.wal.f, m.wal.p)
                if bid == last:
                    for k, v in ends.items():
                        offsets[k] = max(offsets.get(k, 0), v)
                summary = {OFFSETS: json.dumps({str(k): v for k, v in sorted(offsets.items())}), TS: str(ts), WAL: json.dumps({"f": wal[0], "p": wal[1]}) if wal else "null", VERSION: version}
                if any(m.t for m in per[bid]):
                    self.table.truncate(summary)
                else:
                    self.table.commit_files(files.get(bid, []), summary)
                commits += 1
                self.metrics["commits"] += 1
        return commits

    def _schemas(self, rows: DataFrame) -> tuple[dict, dict]:
        """Key and value schema of a version, from its first record."""
        r = rows.orderBy("place").select(F.get_json_object("key", "$.schema").alias("k"), F.get_json_object("value", "$.schema").alias("v")).first()
        if r.k is None:
            raise ValueError(f"{self.topic}: records without key can't be applied")
        return json.loads(r.k), json.loads(r.v)

    def _write(self, rows: DataFrame, version: str) -> dict[int, list[File]]:
        """Files of all commits of one schema version, after bringing the table to it."""
        key, value = self._schemas(rows)
        schema, keys = derive.table_schema(key, value)
        if not self.table.exists():
            self.table = Table.create(self.spark, self.table.root, schema, keys, self.spec, {**self.properties, "schema.version": version})
        elif should_migrate(self.table.metadata().properties.get("schema.version"), version, True, True):
            self.table.evolve(schema, keys, {"schema.version": version})
            self.metrics["schema_migrations"] += 1
        after = _field(value, "after") if any(f.get("field") == "after" for f in value.get("fields", [])) else value
        k = F.from_json(F.get_json_object("key", "$.payload"), json_type(key))
        rows = rows.withColumn("_k", F.to_json(k))
        net = netchange.net_changes(rows, ["_k"], "place")
        a = derive.convert(F.from_json(F.get_json_object("value", "$.payload.after"), json_type(after)), after)
        data = net.filter("survives = 1").select("bid", a.alias("_a")).select("bid", "_a.*")
        ks = derive.convert(k, key)
        gone = net.filter("eq = 1").select("bid", ks.alias("_kk")).select("bid", "_kk.*")
        out: dict[int, list[File]] = defaultdict(list)
        for f in [*self.table.write_data(data, by="bid"), *self.table.write_equality_deletes(gone, by="bid")]:
            out[int(part_value(f))].append(f)
        return out

    # running
    def start(self, messages: DataFrame, checkpoint: str, *, once: bool = True):
        """A streaming query over ``messages``: all there is and then an end, or forever at the examine interval."""
        w = messages.writeStream.foreachBatch(lambda df, i: self(df, i) and None).option("checkpointLocation", checkpoint).queryName(self.topic)
        w = w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{self.settings.examine_interval} seconds")
        self.query, self._again = w.start(), lambda: self.start(messages, checkpoint, once=once)
        return self.query

    def pause(self) -> bool:
        """Stop reading until :meth:`resume`; whether there was something to stop. A micro-batch that is cut off has committed whole commits or none, and is read again."""
        running = self.query is not None and self.query.isActive
        if running:
            self.query.stop()
        return running

    def resume(self):
        """Read on from where the checkpoint and the table stand; a query that still runs stays."""
        if self._again is None:
            raise RuntimeError("the capture was never started")
        return self.query if self.query.isActive else self._again()


def should_run(lag: int, last_source_ms: int | None, now_ms: int, settings: Stream) -> bool:
    """Whether a topic is due: never without lag, at once with more than a commit's worth, else if the last commit is old enough."""
    if lag <= 0:
        return False
    return lag > settings.commit_batch_size or last_source_ms is None or now_ms - last_source_ms > settings.commit_timespan * 1000


def can_end(suspended: bool, lag: int, last_ms: int, now_ms: int, settings: Stream) -> bool:
    """Whether an idle capture may be let go."""
    return suspended and lag <= 0 and now_ms - last_ms > settings.idle_timeout * 1000


#: Messages in a folder of JSON lines.
MESSAGES = "topic string, partition int, offset bigint, timestamp timestamp, key string, value string"


def latest_offsets(spark: SparkSession, path: str) -> dict[str, dict[int, int]]:
    """Per topic and partition the offset after the last in a folder of JSON lines; a folder that isn't there has none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return {}
    out: dict[str, dict[int, int]] = defaultdict(dict)
    rows = spark.read.schema(MESSAGES).json(path).filter("topic is not null").groupBy("topic", "partition").agg((F.max("offset") + 1).alias("n"))
    for r in rows.collect():  # one row per topic and partition
        out[r.topic][r.partition] = r.n or 0
    return dict(out)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of messages from a folder of JSON lines."""
    return spark.readStream.schema(MESSAGES).json(path)


def read_kafka(spark: SparkSession, servers: str, pattern: str, options: dict[str, str] | None = None) -> DataFrame:
    """A stream of messages from Kafka (its connector has to be on the class path), from the earliest offset on; offsets live in the checkpoint and the table, never with the broker."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribePattern", pattern).option("startingOffsets", "earliest")
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r.load().select("topic", "partition", "offset", "timestamp", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
