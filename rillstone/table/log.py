"""Tables as a log of snapshots over Parquet files, read by merging deletes.

A table is a folder: metadata/v{n}.json, written exclusively, one after the other, a manifest for each snapshot, and files of
rows, of keys deleted by equality, and of positions deleted. A version only names its snapshots' manifests, which never
change: a commit writes the manifests that are new and the names, and a reader keeps those it has read. A snapshot says which files it adds and removes; the table's content at a snapshot is
the rows of the files its ancestors left, without those that a later equality delete or a position delete hits. Metadata
is small and lives on the driver; rows never do. A commit applies an edit to the latest version and writes the next; if
another commit came between, the edit is applied anew to what that left.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..files import Files
from ..functions.transforms import transform
from ..operators.netchange import apply_equality_deletes
from ..schema import evolve

#: From the folder of one write on.
_BELOW = r"(?:data|deletes)/[0-9a-f]{32}/.*$"
DATA, EQ, POS = "data", "equality-deletes", "position-deletes"
#: Property that names the format of new data files: parquet, orc, or avro where its reader is installed.
FORMAT, FORMATS = "write.format.default", (".parquet", ".orc", ".avro")
#: Files up to which their list is sent to every executor; about 10 MB.
LISTED = 50_000
#: Bytes of files of deleted keys beyond which Spark may not broadcast them: by its estimate, which is the files' size, it would do so with keys that take up thirty times that.
KEY_BYTES = 1_000_000
#: Property that names the size that new data files should not much exceed, in bytes as rows take them up before compression.
TARGET = "write.target-file-size-bytes"
TS, WAL, OFFSETS, SQUASHED, SOURCE = "source-ts", "source-wal-position", "broker-offsets", "squash-snapshots-id", "source-snapshot-id"


class CommitConflict(RuntimeError):
    """What a commit relied on is gone from the table."""


@dataclass(frozen=True)
class File:
    """A file of the table; ``seq``: the sequence its rows or deletes count as; ``refs``: files that position deletes point into."""

    path: str
    content: str
    seq: int
    spec: int = 0
    partition: str = ""
    keys: tuple[str, ...] = ()
    refs: tuple[str, ...] = ()
    bytes: int = 0

    @property
    def format(self) -> str:
        return self.path.rpartition(".")[2]

    @property
    def name(self) -> str:
        """The path below the table, which tells files apart however a file system spells its root."""
        return re.search(_BELOW, self.path)[0]


@dataclass(frozen=True)
class Snapshot:
    """What one commit did."""

    id: int
    parent: int | None
    seq: int
    ts_ms: int
    op: str
    schema: int
    summary: dict = field(default_factory=dict)
    added: tuple[File, ...] = ()
    removed: tuple[str, ...] = ()


def snapshot_json(s: Snapshot) -> str:
    """Text of a snapshot's manifest."""
    return json.dumps(asdict(s), sort_keys=True) + "\n"


def snapshot_of(text: str) -> Snapshot:
    """The snapshot of a manifest."""
    x = json.loads(text)
    x["added"] = tuple(File(**f | {"keys": tuple(f["keys"]), "refs": tuple(f["refs"])}) for f in x["added"])
    x["removed"] = tuple(x["removed"])
    return Snapshot(**x)


@dataclass
class Metadata:
    """One version of a table's metadata."""

    schemas: dict[int, T.StructType]
    schema: int
    last_field: int
    keys: list[str]
    specs: dict[int, list[str]]
    spec: int
    properties: dict[str, str]
    snapshots: dict[int, Snapshot]
    refs: dict[str, int]
    last_seq: int = 0
    last_snapshot: int = 0

    def to_json(self, manifests: list[str]) -> str:
        out = {k: v for k, v in self.__dict__.items() if k not in ("schemas", "snapshots")}
        out["schemas"] = {k: s.jsonValue() for k, s in self.schemas.items()}
        out["snapshots"] = manifests
        return json.dumps(out) + "\n"

    @classmethod
    def from_json(cls, text: str, snapshot: Callable[[str], Snapshot]) -> Metadata:
        x = json.loads(text)
        x["schemas"] = {int(k): T.StructType.fromJson(s) for k, s in x["schemas"].items()}
        x["specs"] = {int(k): s for k, s in x["specs"].items()}
        x["snapshots"] = {s.id: s for s in map(snapshot, x["snapshots"])}
        return cls(**x)

    def head(self) -> Snapshot | None:
        return self.snapshots.get(self.refs.get("main", 0))

    def ancestors(self, snapshot: int | None) -> list[Snapshot]:
        """From the snapshot back to the root."""
        out = []
        while snapshot is not None and snapshot in self.snapshots:
            out.append(self.snapshots[snapshot])
            snapshot = out[-1].parent
        return out

    def live(self, snapshot: int | None) -> list[File]:
        """Files of the table at a snapshot."""
        files: dict[str, File] = {}
        for s in reversed(self.ancestors(snapshot)):
            for p in s.removed:
                files.pop(p, None)
            files.update((f.path, f) for f in s.added)
        return list(files.values())


class Table:
    """A table in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, f"{self.root}/metadata")
        #: Manifests read or written so far by name, and the name of each snapshot object among them.
        self._manifests: dict[str, Snapshot] = {}
        self._names: dict[int, str] = {}

    # metadata
    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], spec: list[str] | None = None, properties: dict[str, str] | None = None) -> Table:
        """A new table; an existing one is an error."""
        with_ids, last = evolve.assign_ids(schema, 0)
        table = cls(spark, root)
        first = Metadata({0: with_ids}, 0, last, list(keys), {0: list(spec or [])}, 0, dict(properties or {}), {}, {})
        if table._versions() or not table.files.create(f"v{1:010d}.json", first.to_json([])):
            raise FileExistsError(root)
        return table

    def _versions(self) -> list[str]:
        return [n for n in self.files.names() if n.startswith("v") and n.endswith(".json")]

    def _keep(self, name: str, s: Snapshot) -> Snapshot:
        self._manifests[name], self._names[id(s)] = s, name
        return s

    def _manifest(self, name: str) -> Snapshot:
        return self._manifests.get(name) or self._keep(name, snapshot_of(self.files.read(name)))

    def _name(self, s: Snapshot) -> str:
        """The name of a snapshot's manifest, which is written if this object has none yet. It follows from what the manifest says, so that writing it again does no harm."""
        name = self._names.get(id(s))
        if name is None or self._manifests.get(name) is not s:
            text = snapshot_json(s)
            name = f"s{s.id:010d}-{hashlib.sha256(text.encode()).hexdigest()[:32]}.json"
            self.files.create(name, text)
            self._keep(name, s)
        return name

    def _load(self) -> tuple[int, Metadata]:
        version, text = self.files.latest("v")
        if text is None:
            raise FileNotFoundError(self.root)
        return version, Metadata.from_json(text, self._manifest)

    def exists(self) -> bool:
        return bool(self._versions())

    def metadata(self) -> Metadata:
        return self._load()[1]

    def commit(self, edit: Callable[[Metadata], object]) -> object:
        """Apply ``edit`` to the latest metadata until its result is the next version. An edit that returns False changes nothing."""
        while True:
            version, meta = self._load()
            out = edit(meta)
            if out is False:
                return out
            if self.files.create(f"v{version + 1:010d}.json", meta.to_json([self._name(s) for s in meta.snapshots.values()])):
                return out

    def add_snapshot(self, meta: Metadata, op: str, added: Iterable[File], removed: Iterable[str], summary: dict, *, parent: int | None | str = "head", schema: int | None = None, ts_ms: int | None = None) -> Snapshot:
        """Put a snapshot into ``meta`` and move the main branch to it."""
        meta.last_seq += 1
        meta.last_snapshot += 1
        up = meta.refs.get("main") if parent == "head" else parent
        s = Snapshot(meta.last_snapshot, up, meta.last_seq, ts_ms if ts_ms is not None else int(time.time() * 1000), op, meta.schema if schema is None else schema, dict(summary), tuple(added), tuple(removed))
        meta.snapshots[s.id] = s
        meta.refs["main"] = s.id
        return s

    # writing
    def _partition(self, df: DataFrame, spec: list[str]) -> list[tuple[str, Column]]:
        return [transform(df, s) for s in spec]

    def _list(self, path: str) -> list[tuple[str, int]]:
        """Files of a write with their sizes."""
        hpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hpath.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.getUri().getScheme() == "file":  # Hadoop runs a command for each local file to learn its permissions
            walk = ((f"{at}/{n}", n) for at, _, names in os.walk(hpath.toUri().getPath()) for n in names)
            return sorted((f"file:{p}", os.path.getsize(p)) for p, n in walk if n.endswith(FORMATS) and not n.startswith(("_", ".")))
        it, out = fs.listFiles(hpath, True), []
        while it.hasNext():
            status = it.next()
            p = status.getPath().toString()
            if p.endswith(FORMATS) and not p.rpartition("/")[2].startswith(("_", ".")):
                out.append((p, status.getLen()))
        return sorted(out)

    def write_data(self, df: DataFrame, meta: Metadata | None = None, *, clustered: bool = False, max_records: int | None = None, by: str | None = None) -> list[File]:
        """Write rows as files of the current schema and spec; gives files without sequence (-1). ``clustered`` gathers each partition's rows first, so that every task writes few files; else each task fans out. ``by``: a column that splits files further (see :func:`part_value`)."""
        meta = meta or self.metadata()
        schema, spec = meta.schemas[meta.schema], meta.specs[meta.spec]
        parts = self._partition(df, spec)
        cols = [F.col(f"`{f.name}`").cast(_bare(f.dataType)).cast(evolve.physical(f.dataType)).alias(f"c{f.metadata[evolve.ID]}") for f in schema.fields]
        # names of the transforms may clash with columns: partitions go by number
        out = df.select(*cols, *[c.alias(f"_p{i}") for i, (_, c) in enumerate(parts)], *([F.col(by).alias("_by")] if by else []))
        names = [*(["_by"] if by else []), *[f"_p{i}" for i in range(len(parts))]]
        if clustered:
            # gathers a partition's rows and splits those of large partitions again, as sizes at run time say
            out = out.hint("rebalance", *names)
            out = out.sortWithinPartitions(*names) if names else out
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        w = out.write
        target = int(meta.properties.get(TARGET, 0))
        if target:
            rows = max(1, target // max(1, sum(_row_bytes(f.dataType) for f in schema.fields)))
            max_records = min(max_records or rows, rows)
        if max_records:
            w = w.option("maxRecordsPerFile", max_records)
        if names:
            w = w.partitionBy(*names)
        w.format(meta.properties.get(FORMAT, "parquet").lower()).save(path)
        return [File(p, DATA, -1, meta.spec, "/".join(x for x in p.split("/")[:-1] if x.startswith("_p")), bytes=n) for p, n in self._list(path)]

    def write_equality_deletes(self, keys: DataFrame, meta: Metadata | None = None, *, by: str | None = None) -> list[File]:
        """Write distinct keys (columns are the table's names), split by the column ``by`` if one is named."""
        meta = meta or self.metadata()
        schema = meta.schemas[meta.schema]
        path = f"{self.root}/deletes/{uuid.uuid4().hex}"
        names = [c for c in keys.columns if c != by]
        ids = [schema[c].metadata[evolve.ID] for c in names]
        out = keys.select(*[F.col(f"`{c}`").cast(schema[c].dataType).alias(f"c{i}") for c, i in zip(names, ids)], *([F.col(by).alias("_by")] if by else [])).distinct()
        # else every task has keys, and writes a file, of every value
        out = out.hint("rebalance", "_by").sortWithinPartitions("_by").write.partitionBy("_by") if by else out.write
        out.parquet(path)
        return [File(p, EQ, -1, meta.spec, "", tuple(f"c{i}" for i in ids), bytes=n) for p, n in self._list(path)]

    def write_position_deletes(self, positions: DataFrame) -> list[File]:
        """Write (file_path, pos), sorted by both. Only Parquet files know their rows' positions."""
        path = f"{self.root}/deletes/{uuid.uuid4().hex}"
        df = positions.select(F.col("file_path").cast("string"), F.col("pos").cast("bigint"))
        df.repartition("file_path").sortWithinPartitions("file_path", "pos").write.parquet(path)
        refs = tuple(sorted(r[0] for r in df.select("file_path").distinct().collect()))  # as many rows as files referred to
        if any(not r.endswith(".parquet") for r in refs):
            raise ValueError("position deletes need Parquet files")
        return [File(p, POS, -1, refs=refs, bytes=n) for p, n in self._list(path)]

    def append(self, df: DataFrame, summary: dict | None = None) -> Snapshot:
        return self.row_delta(df, None, None, summary)

    def row_delta(self, rows: DataFrame | None, equality: DataFrame | None, positions: DataFrame | None, summary: dict | None = None, *, base: int | None = None, rebase: bool = True) -> Snapshot:
        """Add rows and deletes in one snapshot on whatever is the head when it commits.

        Data files that position deletes point to must still be live. ``rebase=False`` asks that the head is still ``base``
        or has it among its ancestors.
        """
        files: list[File] = []
        try:
            files += self.write_data(rows) if rows is not None else []
            files += self.write_equality_deletes(equality) if equality is not None else []
            files += self.write_position_deletes(positions) if positions is not None else []
            return self.commit_files(files, summary, base=base, rebase=rebase)
        except Exception:
            self.abort(files)
            raise

    def abort(self, files: Iterable[File]) -> None:
        """Delete files that no commit holds."""
        for f in files:
            self._delete(f.path)

    def _delete(self, path: str) -> None:
        hpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hpath, False)

    def unreferenced(self, older_than_ms: int) -> list[str]:
        """Files in the table's folders that no snapshot knows and that were written before a time: what crashed writers left."""
        used = {f.name for s in self.metadata().snapshots.values() for f in s.added}
        out = []
        for part in ("data", "deletes"):
            hpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}")
            fs = hpath.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if not fs.exists(hpath):
                continue
            it = fs.listFiles(hpath, True)
            while it.hasNext():
                s = it.next()
                p = s.getPath().toString()
                m = re.search(_BELOW, p)
                if p.endswith(FORMATS) and m and m[0] not in used and s.getModificationTime() < older_than_ms:
                    out.append(p)
        return sorted(out)

    def clean(self, older_than_ms: int) -> int:
        """Delete unreferenced files; gives how many."""
        gone = self.unreferenced(older_than_ms)
        for p in gone:
            self._delete(p)
        return len(gone)

    def scan(self, content: str, where: str | None = None, *, after_seq: int = -1) -> DataFrame:
        """Raw rows of the live files of one content (names as in files), of sequences after ``after_seq``, filtered by a predicate that reaches the files."""
        meta = self.metadata()
        files = [f for f in meta.live(meta.refs.get("main")) if f.content == content and f.seq > after_seq]
        if not files:
            return self.spark.createDataFrame([], "_ int").drop("_")
        df = read_files(self.spark, files, None)
        return df.filter(where) if where else df

    def commit_files(self, files: list[File], summary: dict | None = None, *, removed: Iterable[str] = (), base: int | None = None, rebase: bool = True) -> Snapshot:
        """Commit written files (see :meth:`row_delta`)."""
        removed = tuple(removed)

        def edit(meta: Metadata) -> Snapshot:
            head = meta.refs.get("main")
            if not rebase and base is not None and base not in {s.id for s in meta.ancestors(head)}:
                raise CommitConflict(f"Snapshot {base} is not an ancestor of {head}")
            return self._delta(meta, files, removed, summary, {f.path for f in meta.live(head)})

        return self.commit(edit)

    def commit_all(self, commits: list[tuple[list[File], dict]]) -> list[Snapshot]:
        """Commit written files as a snapshot for each of ``commits`` (files and summary), one after the other, in one version: the time and metadata of a version grow with the snapshots there are."""

        def edit(meta: Metadata) -> list[Snapshot]:
            live = {f.path for f in meta.live(meta.refs.get("main"))}
            out = []
            for files, summary in commits:
                out.append(self._delta(meta, files, (), summary, live))
                live.update(f.path for f in files)
            return out

        return self.commit(edit) if commits else []

    def _delta(self, meta: Metadata, files: list[File], removed: tuple[str, ...], summary: dict | None, live: set[str]) -> Snapshot:
        """Put a snapshot of written files into ``meta``; ``live``: paths of the files there are before it."""
        for f in files:
            gone = [r for r in f.refs if r not in live and r not in {g.path for g in files}]
            if gone:
                raise CommitConflict(f"position deletes point to files that are gone: {gone[:3]}")
        seq = meta.last_seq + 1
        kinds = {f.content for f in files}
        op = "append" if kinds <= {DATA} and not removed else "delete" if DATA not in kinds else "overwrite"
        return self.add_snapshot(meta, op, [replace(f, seq=seq) for f in files], removed, summary or {})

    def truncate(self, summary: dict | None = None) -> Snapshot:
        """A snapshot that removes every file; history stays."""

        def edit(meta: Metadata) -> Snapshot:
            return self.add_snapshot(meta, "delete", [], [f.path for f in meta.live(meta.refs.get("main"))], summary or {})

        return self.commit(edit)

    # schema, spec, refs
    def evolve(self, new: T.StructType, keys: list[str] | None = None, properties: dict[str, str] | None = None) -> list[evolve.Change]:
        """Migrate columns, identifier fields and properties in one version; no data is touched."""
        found: list[evolve.Change] = []

        def edit(meta: Metadata):
            schema, changes, last = evolve.migrate(meta.schemas[meta.schema], new, meta.last_field)
            found[:] = changes
            if not changes and (keys is None or keys == meta.keys) and not properties:
                return False
            if changes:
                n = max(meta.schemas) + 1
                meta.schemas[n], meta.schema, meta.last_field = schema, n, last
            meta.keys = list(keys) if keys is not None else meta.keys
            meta.properties |= properties or {}

        self.commit(edit)
        return found

    def rename(self, old: str, new: str) -> None:
        """Another name for a column; files stay as they are."""

        def edit(meta: Metadata):
            s = meta.schemas[meta.schema]
            n = max(meta.schemas) + 1
            meta.schemas[n] = T.StructType([T.StructField(new if f.name == old else f.name, f.dataType, f.nullable, f.metadata) for f in s.fields])
            meta.schema = n
            meta.keys = [new if k == old else k for k in meta.keys]

        self.commit(edit)

    def respec(self, spec: list[str]) -> None:
        """Partition new files otherwise; old ones keep their layout."""

        def edit(meta: Metadata):
            n = max(meta.specs) + 1
            meta.specs[n], meta.spec = list(spec), n

        self.commit(edit)

    def tag(self, name: str, snapshot: int) -> None:
        def edit(meta: Metadata):
            meta.refs[name] = snapshot

        self.commit(edit)

    # reading
    def resolve(self, meta: Metadata, at: int | str | None = None, as_of_ms: int | None = None) -> int | None:
        """Snapshot id of an id, a tag, a time (the last commit not after it) or the head."""
        if as_of_ms is not None:
            on_main = [s for s in meta.ancestors(meta.refs.get("main")) if s.ts_ms <= as_of_ms]
            return on_main[0].id if on_main else None
        if isinstance(at, str):
            return meta.refs[at]
        return at if at is not None else meta.refs.get("main")

    def read(self, at: int | str | None = None, *, as_of_ms: int | None = None, partitions: set[str] | None = None) -> DataFrame:
        """The table's rows at a snapshot, in the schema it had then (the current one at the head). ``partitions`` reads only the files of those partitions."""
        meta = self.metadata()
        snap = self.resolve(meta, at, as_of_ms)
        schema = meta.schemas[meta.schema if at is None and as_of_ms is None or snap is None else meta.snapshots[snap].schema]
        files = meta.live(snap)
        if partitions is not None:
            files = [f for f in files if f.content != DATA or f.partition in partitions]
        return merge(self.spark, files, schema, meta.schemas)

    def summary_of(self, key: str) -> str | None:
        """The latest value that a snapshot of the main branch carries for a key."""
        meta = self.metadata()
        return next((s.summary[key] for s in meta.ancestors(meta.refs.get("main")) if key in s.summary), None)


def part_value(f: File) -> str:
    """The value of the ``by`` column that a file was split by."""
    return next(x.partition("=")[2] for x in f.path.split("/") if x.startswith("_by="))


#: Bytes that values of a type take up; texts, bytes and the elements of collections as a typical one.
_BYTES = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.StringType: 20, T.BinaryType: 100, T.DecimalType: 16}


def _row_bytes(t: T.DataType) -> int:
    """Bytes that a value takes up in about, by its type."""
    if isinstance(t, T.StructType):
        return sum(_row_bytes(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return 4 * _row_bytes(t.elementType)
    if isinstance(t, T.MapType):
        return 4 * (_row_bytes(t.keyType) + _row_bytes(t.valueType))
    return _BYTES.get(type(t), 8)


def _bare(t: T.DataType) -> T.DataType:
    """The type without requirements, so that casts need not prove them."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _bare(f.dataType), True) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_bare(t.elementType), True)
    if isinstance(t, T.MapType):
        return T.MapType(_bare(t.keyType), _bare(t.valueType), True)
    return t


def read_name() -> Column:
    """The name of the file that a row is read from, as :attr:`File.name` has it; Spark gives its path as an encoded address."""
    return F.url_decode(F.replace(F.regexp_extract("_metadata.file_path", _BELOW, 0), F.lit("+"), F.lit("%2B")))


def with_file(spark: SparkSession, df: DataFrame, files: list[File], ranges: dict[str, int] | None = None) -> DataFrame:
    """Adds ``_seq``, and ``_range`` if ``ranges`` has it by path, from the file each row lies in (``_name``); one sequence needs no join."""
    seqs = {f.seq for f in files}
    if len(seqs) == 1 and ranges is None:
        return df.withColumn("_seq", F.lit(seqs.pop()).cast("bigint"))
    if ranges is None:
        by = spark.createDataFrame([(f.name, f.seq) for f in files], "_name string, _seq bigint")  # one row per file
    else:
        by = spark.createDataFrame([(f.name, f.seq, ranges[f.path]) for f in files], "_name string, _seq bigint, _range bigint")
    # the list's size is unknown to Spark, and files may be a thousandth of their rows' size (ORC of keys in order): an outer join never broadcasts the rows
    return df.join(F.broadcast(by) if len(files) <= LISTED else by, "_name", "left")


def read_files(spark: SparkSession, files: list[File], schema: T.StructType | None) -> DataFrame:
    """Files of one format by their paths, with column pruning and predicates as their reader has them."""
    r = spark.read.format(files[0].format)
    paths = [f.path for f in files]
    with few_listings(spark):
        return (r.schema(schema) if schema is not None else r).load(paths)


@contextmanager
def few_listings(spark: SparkSession) -> Iterator[None]:
    """While paths are looked up, a task looks up many of them and not one."""
    name, most = "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism)
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def by_partition(files: Iterable[File]) -> dict[tuple[int, str], list[File]]:
    """Data files by spec and partition: what a rewrite may put together."""
    out: dict[tuple[int, str], list[File]] = {}
    for f in files:
        if f.content == DATA:
            out.setdefault((f.spec, f.partition), []).append(f)
    return out


def merge(spark: SparkSession, files: list[File], schema: T.StructType, schemas: dict[int, T.StructType], *, positions: bool = False, ranges: dict[str, int] | None = None) -> DataFrame:
    """Rows of data files without those that equality deletes of a later sequence or position deletes hit, in ``schema``.

    ``schemas``: all of the table's, for deletes whose key columns ``schema`` has no more: these are read along until the
    deletes are applied. ``positions`` adds _name and _pos of each row. Columns that a file lacks are null; narrower types
    are widened. ``ranges`` tells by path which of several sets a file is in: each is merged on its own, as if there were no
    others, and _range is added.
    """
    data = [f for f in files if f.content == DATA]
    logical = [F.col(f"c{f.metadata[evolve.ID]}").cast(_bare(f.dataType)).alias(f.name) for f in schema.fields]
    phys = evolve.physical(schema)
    if not data:
        return spark.createDataFrame([], _bare(schema))
    eq, pos = [f for f in files if f.content == EQ], [f for f in files if f.content == POS]
    # of a dropped column the latest type, which is the widest
    types = {x.name: x for n in sorted(schemas) for x in evolve.physical(schemas[n]).fields} | {x.name: x for x in phys.fields}
    phys = T.StructType([*phys.fields, *[types[k] for k in sorted({k for f in eq for k in f.keys} - set(phys.names))]])
    rows = None
    for kind in sorted({f.format for f in data}):
        part = read_files(spark, [f for f in data if f.format == kind], phys)
        if eq or pos or positions or ranges is not None:
            part = part.select("*", read_name().alias("_name"), (F.col("_metadata.row_index") if kind == "parquet" else F.lit(None).cast("bigint")).alias("_pos"))
        rows = part if rows is None else rows.unionByName(part)
    if pos:
        dead = spark.read.parquet(*[f.path for f in pos]).select(F.regexp_extract("file_path", _BELOW, 0).alias("_name"), F.col("pos").alias("_pos")).distinct()
        rows = rows.join(dead, ["_name", "_pos"], "left_anti")
    own_range = ["_range"] if ranges is not None else []
    if eq or ranges is not None:
        rows = with_file(spark, rows, data, ranges)
    for keys in sorted({f.keys for f in eq}):
        own = [f for f in eq if f.keys == keys]
        d = read_files(spark, own, T.StructType([types[k] for k in keys])).select("*", read_name().alias("_name"))
        large = sum(f.bytes for f in own) > KEY_BYTES
        rows = apply_equality_deletes(rows, with_file(spark, d, own, ranges).select(*keys, *own_range, "_seq"), [*keys, *own_range], "_seq", hint="merge" if large else None)
    return rows.select(*logical, *([F.col("_name"), F.col("_pos")] if positions else []), *own_range)
