"""Configuration from YAML: source, sink, stream, manager, telemetry."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import timedelta, timezone

from .functions.time import parse_duration


def _tz(text: str | timezone) -> timezone:
    if isinstance(text, timezone):
        return text
    if text in ("Z", "UTC", "+0", "-0"):
        return timezone.utc
    m = re.fullmatch(r"([+-])(\d{1,2})(?::?(\d{2}))?", str(text))
    if not m:
        raise ValueError(f"no offset from UTC: {text!r}")
    return timezone((1 if m[1] == "+" else -1) * timedelta(hours=int(m[2]), minutes=int(m[3] or 0)))


def _seconds(x) -> float:
    return parse_duration(x) if isinstance(x, str) else float(x)


def _needed(x: dict, key: str, what: str) -> str:
    if not x.get(key):
        raise ValueError(f"{what}.{key} cannot be empty")
    return x[key]


@dataclass
class Compaction:
    """How long snapshots are kept as they are (hours), then per hour (hours), per day (days), per month (months)."""

    tz: timezone = timezone.utc
    retain_raw: int = 3
    retain_hour: int = 24
    retain_day: int = 30
    retain_month: int = 12


@dataclass
class Expiration:
    """Whether orphan snapshots expire, and after how many seconds."""

    enabled: bool = True
    age: float = 86_400.0


@dataclass
class Source:
    kind: str
    topic_prefix: str
    excluded: list[str] = field(default_factory=list)
    included: list[str] = field(default_factory=list)
    config: dict[str, str] = field(default_factory=dict)
    adjusters: list[dict] = field(default_factory=list)

    @property
    def poll_timeout(self) -> float:
        return int(self.config.get("poll.timeout.ms", 1000)) / 1000


@dataclass
class Sink:
    kind: str
    catalog: dict[str, str] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)
    partition_spec: dict[str, list[str]] = field(default_factory=dict)
    base_location: str | None = None


@dataclass
class Stream:
    kind: str
    connector: str
    examine_interval: float = 180.0
    idle_timeout: float = 900.0
    commit_batch_size: int = 1000
    commit_timespan: float = 600.0
    rotate_tz: timezone = timezone.utc


@dataclass
class ManagerConfig:
    namespace: list[str]
    examine_interval: float = 1800.0
    compaction: Compaction = field(default_factory=Compaction)
    expiration: Expiration = field(default_factory=Expiration)


@dataclass
class Config:
    source: Source
    sink: Sink
    stream: Stream
    manager: ManagerConfig
    telemetry: dict


def parse(x: dict) -> Config:
    """The configuration of a parsed document; missing values take their defaults."""
    so, si, st, ma = x["source"], x["sink"], x["stream"], x.get("manager", {})
    creation = si.get("tableCreation", {})
    spec = {t: [f"{p['transform']}({p['column']})" for p in parts] for t, parts in creation.get("partitionSpec", {}).items()}
    co, ex = ma.get("compactSnapshots", {}), ma.get("expireOrphanSnapshots", {})
    names = {"retainRaw": "retain_raw", "retainHourCompact": "retain_hour", "retainDayCompact": "retain_day", "retainMonthCompact": "retain_month"}
    compaction = Compaction(_tz(co.get("tz", "UTC")), **{n: int(co[k]) for k, n in names.items() if k in co})
    times = {"examineInterval": "examine_interval", "idleTimeout": "idle_timeout", "commitTimespan": "commit_timespan"}
    return Config(
        Source(_needed(so, "kind", "source"), so["topicPrefix"], so.get("topicsExcluded", []), so.get("topicsIncluded", []), {k: str(v) for k, v in so.get("config", {}).items()}, so.get("namingAdjusters", [])),
        Sink(_needed(si, "kind", "sink"), {k: str(v) for k, v in si.get("catalog", {}).items()}, {k: str(v) for k, v in creation.get("properties", {}).items()}, spec, creation.get("baseLocation")),
        Stream(
            _needed(st, "kind", "stream"), _needed(st, "connector", "stream"), commit_batch_size=int(st.get("commitBatchSize", 1000)), rotate_tz=_tz(st.get("rotateByDateInTz", "UTC")),
            **{n: _seconds(st[k]) for k, n in times.items() if k in st},
        ),
        ManagerConfig(list(ma.get("namespace", [])), _seconds(ma.get("examineInterval", 1800)), compaction, Expiration(ex.get("enabled", True), _seconds(ex.get("age", 86_400)))),
        x.get("telemetry", {}),
    )


def load_config(path: str) -> Config:
    """The configuration in a YAML file."""
    import yaml

    with open(path) as f:
        return parse(yaml.safe_load(f))
