"""python -m rillstone.cli stream|manage CONFIG.yaml [--source FOLDER]: capture topics, or keep tables' history."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config, load_config
from .sources import topics
from .streaming.capture import Capture, can_end, latest_offsets, read_files, read_kafka, should_run
from .table.catalog import Catalog
from .table.upkeep import Manager


def adjusters(config: Config) -> topics.Chain:
    """Naming adjusters in order: entries with ``case`` change case, those with ``map`` map namespaces, those with ``class`` name a Python class."""
    out: list[topics.Adjuster] = []
    for a in config.source.adjusters:
        if "map" in a:
            out.append(topics.MapNamespaces(a["map"]))
        elif "case" in a:
            out.append(topics.ChangeCase(a["case"], a["case"], None))
        else:
            module, _, name = a["class"].rpartition(".")
            out.append(getattr(__import__(module, fromlist=[name]), name)(**{k: v for k, v in a.items() if k != "class"}))
    return topics.Chain(*out)


def table_paths(spark: SparkSession, names: list[str], config: Config) -> dict[str, str]:
    """Folder of each captured topic's table."""
    df = spark.createDataFrame([(n,) for n in names], "topic string")
    df = topics.available(df, "topic", config.source.topic_prefix, config.source.included, config.source.excluded)
    ns, name = topics.table_id(F.col("topic"), config.source.topic_prefix)
    adjust = adjusters(config)
    base = config.sink.base_location or config.sink.catalog.get("warehouse", "warehouse")
    rows = df.select("topic", adjust.namespace(ns).alias("ns"), adjust.table(name).alias("name")).filter("name is not null").collect()  # one row per topic
    return {r.topic: f"{base.rstrip('/')}/{r.ns.replace('.', '/')}/{r.name}" for r in rows}


def stream(spark: SparkSession, config: Config, source: str | None, *, forever: bool = True) -> None:
    """Capture every topic that is due with a query of its own; new topics are found at each examination and captures that stay idle are let go.

    From Kafka the included topics are captured at every examination, for what the broker holds isn't known here: without a
    list of them there would be nothing to do, which is an error.
    """
    if not source and not config.source.included:
        raise ValueError("Kafka needs the topics to capture in source.topicsIncluded; those with the prefix can't be listed")
    base = config.sink.catalog.get("warehouse", "warehouse").rstrip("/")
    running: dict = {}
    captures: dict[str, Capture] = {}
    while True:
        latest = latest_offsets(spark, source) if source else {}
        for topic, path in table_paths(spark, list(latest) if source else config.source.included, config).items():
            old = running.get(topic)
            if old is not None and old.isActive:
                continue
            if topic not in captures:
                spec = config.sink.partition_spec.get(path.rpartition("/")[2])
                captures[topic] = Capture(spark, topic, path, config.stream, spec=spec, properties=config.sink.properties)
            if source:
                lag, last, now = captures[topic].lag(latest[topic]), captures[topic].last_source_ms(), int(time.time() * 1000)
                if not should_run(lag, last, now, config.stream):
                    if can_end(True, lag, last or 0, now, config.stream):
                        captures.pop(topic)
                        running.pop(topic, None)
                    continue
            messages = read_files(spark, source) if source else read_kafka(spark, config.source.config["bootstrap.servers"], topic.replace(".", r"\."))
            running[topic] = captures[topic].start(messages, f"{base}/_checkpoints/{topic}")
        for q in running.values():
            q.awaitTermination()
        if not forever:
            return
        time.sleep(config.stream.examine_interval)


def manage(spark: SparkSession, config: Config, *, forever: bool = True) -> None:
    """Tag, expire and compact the tables of the managed namespaces."""
    catalog = Catalog(spark, config.sink.base_location or config.sink.catalog.get("warehouse", "warehouse"))
    while True:
        tables = {name: catalog.load(name) for ns in config.manager.namespace for name in catalog.tables(ns)}
        manager = Manager(tables, config.manager.compaction, config.manager.expiration)
        manager.examine()
        manager.lanes.close()
        for name, item, error in manager.lanes.failures:
            print(f"{name}: {item[0]} failed: {error}")
        if not forever:
            return
        time.sleep(config.manager.examine_interval)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["stream", "manage"])
    p.add_argument("config")
    p.add_argument("--source", help="folder of JSON messages instead of Kafka")
    p.add_argument("--once", action="store_true", help="end after one examination")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"rillstone-{a.command}").config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()
    config = load_config(a.config)
    if a.command == "stream":
        stream(spark, config, a.source, forever=not a.once)
    else:
        manage(spark, config, forever=not a.once)


if __name__ == "__main__":
    main()
