"""python tools/scale.py [ROWS]: operators on made-up tables of which a third has one key, with seconds, and of the stages of over a second the longest task against the median."""

import json
import shutil
import sys
import tempfile
import time
from collections import defaultdict
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rillstone.operators import dedupe, history, lww, netchange, orphans, reconcile  # noqa: E402

N = int(sys.argv[1]) if len(sys.argv) > 1 else 10_000_000


def tasks(log: Path, since: float) -> tuple[float, float, float]:
    """Longest task, the median of its stage and their ratio, of the stage since a time in which they are furthest apart."""
    took = defaultdict(list)
    for f in log.iterdir():
        for line in f.open():
            if '"SparkListenerTaskEnd"' in line:
                e = json.loads(line)
                i = e["Task Info"]
                if i["Launch Time"] / 1000 >= since:
                    took[e["Stage ID"]].append((i["Finish Time"] - i["Launch Time"]) / 1000)
    worst = max(((max(x), median(x)) for x in took.values() if len(x) > 3 and max(x) > 1), key=lambda x: x[0] / x[1], default=(0.0, 1.0))
    return *worst, worst[0] / worst[1]


def main() -> None:
    work = tempfile.mkdtemp(prefix="scale-")
    log = Path(work, "log")
    log.mkdir()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "32").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{log}").config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    hot = lambda key: F.when(F.col("id") % 3 == 0, F.lit(7).cast("bigint")).otherwise(key)
    base = spark.range(N)

    def run(name, make):
        t = time.time()
        rows = make().agg(F.count(F.lit(1))).head()[0]
        time.sleep(0.5)
        print(f"{name}: {rows} rows, {time.time() - t - 0.5:.1f} s; longest task {'%.1f s, median %.1f s, ratio %.1f' % tasks(log, t)}", flush=True)

    states = base.select(hot(F.xxhash64("id") % (N // 4)).alias("e"), F.timestamp_seconds(F.col("id")).alias("at"), (F.col("id") % 5).cast("string").alias("a"), F.lit(None).cast("timestamp").alias("gone"))
    run("versions", lambda: history.update_history(states, "e", F.col("a"), "at", "gone", chunk_rows=max(1000, N // 24)))
    messages = base.select(hot(F.xxhash64("id") % (N // 2)).alias("k"), (F.col("id") % 1000).alias("t"), F.col("id").alias("tie"))
    run("duplicates", lambda: dedupe.extra_copies(messages, ["k"], "t", "tie", group_rows=max(1000, N // 24)))
    children = base.select("id", hot(F.abs(F.xxhash64("id") % N)).alias("ref"), F.col("id").alias("loaded"), F.lit("2025-01").alias("period"))
    parents = base.filter("id % 4 <> 0 and id <> 7").select(F.col("id").alias("k"), F.lit(0).cast("bigint").alias("l"), F.lit(None).cast("bigint").alias("d"))
    run("references", lambda: orphans.orphans(children, orphans.parent_states(parents, "k", "l", "d"), "id", "ref", "loaded", "period", salt_rows=max(1000, N // 24)))
    changes = base.select(hot(F.xxhash64("id") % (N // 4)).alias("k"), F.col("id").alias("seq"), F.when(F.col("id") % 50 == 0, "d").otherwise("u").alias("op"), F.col("id").cast("string").alias("v"))
    run("changes", lambda: lww.apply_changes(changes, ["k"], "seq", "op", {"v": ("v", "v is not null")}, replace_ops=["c"], patch_ops=["u"], delete_ops=["d"]))
    ordered = base.select("id", hot(F.col("id")).alias("ts"), (F.col("id") % 4).cast("int").alias("part"))
    run("merge order", lambda: netchange.merge_order(ordered, "part", "id", "ts", chunk_rows=max(1000, N // 24)).agg(F.max("place")))
    full = spark.range(N // 10).select("id", F.xxhash64("id").cast("string").alias("a"))
    for lost in (0, 25, 50, 100):
        part = full.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) >= lost)
        run(f"differences, {N // 10} rows, {lost} % lost", lambda: reconcile.differences(full, part, "id", ["a"], ("left", "right")))
    spark.stop()
    shutil.rmtree(work)


if __name__ == "__main__":
    main()
