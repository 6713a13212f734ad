"""Upkeep of tables' history: retention points, groups, tags, expiry, and a manager with a lane per table."""

from __future__ import annotations

import time
from collections import defaultdict, deque
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from threading import Lock

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Compaction, Expiration
from .compact import compact
from .log import TS, Metadata, Snapshot, Table


@dataclass(frozen=True)
class Points:
    """Before each point, snapshots are kept per hour, day, month and year; from the hour point on every one is kept."""

    tz: timezone
    hour: datetime
    day: datetime
    month: datetime
    year: datetime

    @classmethod
    def at(cls, now: datetime, rules: Compaction) -> Points:
        now = now.astimezone(rules.tz)
        midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
        hour = (now - timedelta(hours=rules.retain_raw)).replace(minute=0, second=0, microsecond=0)
        day = (now - timedelta(hours=rules.retain_hour)).replace(hour=0, minute=0, second=0, microsecond=0)
        month = (midnight - timedelta(days=rules.retain_day)).replace(day=1)
        months = midnight.year * 12 + midnight.month - 1 - rules.retain_month
        return cls(rules.tz, hour, day, month, midnight.replace(year=months // 12, month=1, day=1))

    def key(self, ts_ms: int) -> str:
        """The group of a snapshot by its source time: its own time while it is young, then hour, day, month, year."""
        t = datetime.fromtimestamp(ts_ms / 1000, timezone.utc).astimezone(self.tz)
        if t >= self.hour:
            text = t.strftime("%Y-%m-%dT%H:%M:%S")
            ms = ts_ms % 1000
            return f"{text}.{ms:03d}" if ms else text
        for point, form in ((self.day, "%Y-%m-%dT%H"), (self.month, "%Y-%m-%d"), (self.year, "%Y-%m")):
            if t >= point:
                return t.strftime(form)
        return t.strftime("%Y")

    def key_column(self, ts_ms: Column) -> Column:
        """The same as a column expression."""
        local = ts_ms + F.lit(int(self.tz.utcoffset(None).total_seconds() * 1000))
        day = F.date_from_unix_date(F.floor(local / F.lit(86_400_000)).cast("int"))
        rest = F.pmod(local, F.lit(86_400_000))
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        hh, mm, ss, ms = (F.floor(rest / F.lit(3_600_000)), F.pmod(F.floor(rest / F.lit(60_000)), F.lit(60)), F.pmod(F.floor(rest / F.lit(1000)), F.lit(60)), F.pmod(rest, F.lit(1000)))
        date = F.date_format(day, "yyyy-MM-dd")
        raw = F.concat(date, F.lit("T"), two(hh), F.lit(":"), two(mm), F.lit(":"), two(ss), F.when(ms > 0, F.concat(F.lit("."), F.lpad(ms.cast("string"), 3, "0"))).otherwise(""))
        at = lambda p: F.lit(int(p.timestamp() * 1000))
        return F.when(ts_ms >= at(self.hour), raw).when(ts_ms >= at(self.day), F.concat(date, F.lit("T"), two(hh))).when(ts_ms >= at(self.month), date).when(ts_ms >= at(self.year), F.date_format(day, "yyyy-MM")).otherwise(F.date_format(day, "yyyy"))


@dataclass(frozen=True)
class Group:
    """Neighbouring snapshots of one key: those after ``low`` (from the root if None) up to ``high``."""

    key: str
    size: int
    low: int | None
    high: int
    high_seq: int = 0


def groups(chain: Iterable[Snapshot], key: Callable[[Snapshot], str]) -> list[Group]:
    """Groups of a chain given from the head to the root, newest first."""
    out: list[Group] = []
    run: list[Snapshot] = []
    k = None
    for s in chain:
        now = key(s)
        if run and now != k:
            out.append(Group(k, len(run), s.id, run[0].id, run[0].seq))
            run = []
        k = now
        run.append(s)
    if run:
        out.append(Group(k, len(run), None, run[0].id, run[0].seq))
    return out


def groups_of(snapshots: DataFrame, key: Column, order: str, ident: str) -> DataFrame:
    """The same over a frame of a chain's snapshots, as gaps and islands: key, size, low, high."""
    w = Window.orderBy("_o")  # one row per snapshot of a table
    rows = snapshots.select(F.col(ident).alias("_id"), F.col(order).alias("_o"), key.alias("key"))
    rows = rows.withColumns({"_chg": (~F.lag("key").over(w).eqNullSafe(F.col("key")) | F.lag("_o").over(w).isNull()).cast("int"), "_before": F.lag("_id").over(w)})
    rows = rows.withColumn("_g", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("_g", "key").agg(F.count(F.lit(1)).alias("size"), F.min_by("_before", "_o").alias("low"), F.max_by("_id", "_o").alias("high")).drop("_g")


def source_ms(s: Snapshot) -> int:
    """A snapshot's source time; its own if it carries none."""
    return int(s.summary.get(TS, s.ts_ms))


def day_tags(chain: list[Snapshot], points: Points, refs: Iterable[str]) -> list[tuple[str, int]]:
    """Tags to make, oldest first: of days that are down to one snapshot, until a group has several, is younger than the day point, or is of hours."""
    out = []
    at = points.day.timestamp() * 1000
    by = {s.id: s for s in chain}
    for g in reversed(groups(chain, lambda s: points.key(source_ms(s)))):
        if g.size > 1 or source_ms(by[g.high]) >= at or "T" in g.key:
            break
        if g.key not in refs:
            out.append((g.key, g.high))
    return out


def tag_days(table: Table, now: datetime, rules: Compaction) -> list[tuple[str, int]]:
    """Make the day tags that are due."""
    made: list[tuple[str, int]] = []

    def edit(meta: Metadata):
        made[:] = day_tags(meta.ancestors(meta.refs.get("main")), Points.at(now, rules), meta.refs)
        meta.refs.update(made)
        return bool(made)

    table.commit(edit)
    return made


def orphans(meta: Metadata, now_ms: int, age_ms: int, *, recent_only: bool = False) -> list[int]:
    """Snapshots that no branch or tag reaches and that are older than the age. ``recent_only`` gives the younger ones instead, for parity with managers that do."""
    kept = {s.id for r in meta.refs.values() for s in meta.ancestors(r)}
    return sorted(i for i, s in meta.snapshots.items() if i not in kept and (s.ts_ms >= now_ms - age_ms) == recent_only)


def expire(table: Table, rules: Expiration, now_ms: int | None = None) -> list[int]:
    """Forget orphan snapshots and delete the files that no snapshot left uses."""
    now = int(time.time() * 1000) if now_ms is None else now_ms
    gone: list[int] = []
    files: list[str] = []

    def edit(meta: Metadata):
        gone[:] = orphans(meta, now, int(rules.age * 1000))
        dead = [meta.snapshots.pop(i) for i in gone]
        used = {f.path for s in meta.snapshots.values() for f in s.added}
        files[:] = sorted({f.path for s in dead for f in s.added} - used)
        return bool(gone)

    table.commit(edit)
    for p in files:
        table._delete(p)
    return gone


class Lanes:
    """A FIFO lane per key over a shared pool: items of a key run one after the other, keys beside one another. A failing item doesn't stop its lane."""

    def __init__(self, run: Callable[[str, object], object], workers: int):
        self.run, self.pool, self.lock = run, ThreadPoolExecutor(workers), Lock()
        self.queues: dict[str, deque] = defaultdict(deque)
        self.running: dict[str, object] = {}
        self.listeners: list[Callable] = []
        self.failures: list[tuple[str, object, BaseException]] = []

    def enqueue(self, key: str, item: object) -> None:
        with self.lock:
            self.queues[key].append(item)
            self._next(key)

    def running_item(self, key: str) -> object | None:
        return self.running.get(key)

    def queue_size(self, key: str) -> int:
        return len(self.queues[key])

    def is_empty(self, key: str) -> bool:
        with self.lock:
            return not self.queues[key] and key not in self.running

    def _next(self, key: str) -> None:
        if key in self.running or not self.queues[key]:
            return
        item = self.running[key] = self.queues[key].popleft()
        self.pool.submit(self.run, key, item).add_done_callback(lambda f: self._done(key, item, f))

    def _done(self, key: str, item: object, f: Future) -> None:
        with self.lock:
            self.running.pop(key, None)
            if (e := f.exception()) is not None:
                self.failures.append((key, item, e))
            self._next(key)
        for tell in self.listeners:
            tell(key, item, f)

    def close(self) -> None:
        while True:
            with self.lock:
                if not self.running and not any(self.queues.values()):
                    break
            time.sleep(0.01)
        self.pool.shutdown()


class Manager:
    """Looks at tables and queues what is due: tags, expiry, and compaction of groups of several snapshots, oldest first."""

    def __init__(self, tables: dict[str, Table], compaction: Compaction, expiration: Expiration, workers: int = 8):
        self.tables, self.compaction, self.expiration = tables, compaction, expiration
        self.lanes = Lanes(self._work, workers)

    def examine(self, now: datetime | None = None) -> None:
        now = now or datetime.now(timezone.utc)
        for name, table in self.tables.items():
            if not self.lanes.is_empty(name):
                continue
            self.lanes.enqueue(name, ("tag", now))
            if self.expiration.enabled:
                self.lanes.enqueue(name, ("expire", now))
            self.lanes.enqueue(name, ("compact", now))

    def due(self, table: Table, now: datetime) -> list[Group]:
        """Groups to compact, by sequence."""
        meta, points = table.metadata(), Points.at(now, self.compaction)
        return sorted((g for g in groups(meta.ancestors(meta.refs.get("main")), lambda s: points.key(source_ms(s))) if g.size > 1), key=lambda g: g.high_seq)

    def _work(self, name: str, item: tuple[str, datetime]) -> None:
        task, now = item
        table = self.tables[name]
        if task == "tag":
            tag_days(table, now, self.compaction)
        elif task == "expire":
            expire(table, self.expiration, int(now.timestamp() * 1000))
        else:
            # compacting one group gives the later ones new ids, so that each is looked up anew
            while due := self.due(table, now):
                compact(table, due[0].low, due[0].high)
