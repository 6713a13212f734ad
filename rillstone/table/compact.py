"""Compaction of a range of snapshots into one, with the later ones picked anew on top.

For snapshots after ``low`` up to ``high``: rows are read by merging the deletes of the range and written again, equality
deletes become one set of distinct keys that still hits rows before the range, and one snapshot replaces the range. All
files of the new snapshot count as of the last sequence of the range's files, so that what comes before or after the range
compares with them as before. The chain changes in a single metadata version: no reader sees a state between.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import evolve
from .log import DATA, EQ, POS, SOURCE, SQUASHED, CommitConflict, File, Metadata, Snapshot, Table, merge, part_value, read_files, read_name, with_file


class InvalidCompaction(ValueError):
    """The range can't be compacted on its own."""


def in_range(meta: Metadata, low: int | None, high: int) -> list[Snapshot]:
    """Snapshots after low up to high, oldest first; from the root if low is None."""
    out = []
    for s in meta.ancestors(high):
        if s.id == low:
            break
        out.append(s)
    else:
        if low is not None:
            raise InvalidCompaction(f"snapshot {low} is not an ancestor of {high}")
    return out[::-1]


def net_files(snapshots: Iterable[Snapshot]) -> tuple[list[File], list[str]]:
    """Files that a run of snapshots adds in the end, and those from before it that it removes."""
    added: dict[str, File] = {}
    removed: list[str] = []
    for s in snapshots:
        for p in s.removed:
            if added.pop(p, None) is None:
                removed.append(p)
        added.update((f.path, f) for f in s.added)
    return list(added.values()), removed


def net_operation(ops: list[str], added_data: int, added_deletes: int, removed: int) -> str:
    """What a run of snapshots amounts to."""
    if ops and all(o == "replace" for o in ops):
        return "replace"
    if not (added_data or added_deletes or removed):
        return "noop"
    if not added_data:
        return "delete"
    return "append" if not added_deletes and not removed else "overwrite"


def check_positions(snapshots: list[Snapshot]) -> None:
    """Position deletes of the range may point only to files that the range has added so far."""
    added: set[str] = set()
    for s in snapshots:
        added.update(f.path for f in s.added if f.content == DATA)
        if any(set(f.refs) - added for f in s.added if f.content == POS):
            raise InvalidCompaction(f"Snapshot {s.id} contains POSITION_DELETES file reference to out of CompactionGroup")


def check_picks(later: list[Snapshot], dead: set[str]) -> None:
    """Position deletes of later snapshots may not point to files that are gone."""
    for s in later:
        if any(set(f.refs) & dead for f in s.added if f.content == POS):
            raise CommitConflict(f"Cannot cherry-pick snapshot {s.id}: Found POSITION_DELETES reference to the dead files")


def dangling(positions: DataFrame, files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Position deletes whose file isn't among ``files`` (both have file_path), for checks over manifests too large for the driver; ``by``: columns of both that tell ranges apart, each of which has files of its own."""
    return positions.join(files.select(*by, "file_path").distinct(), [*by, "file_path"], "left_anti")


def dead_references(positions: DataFrame, dead: DataFrame, order: str) -> DataFrame:
    """The check of :func:`check_picks` over frames of any size, for all ranges at once: position deletes that point to a file (file_path) that a range before theirs in ``order`` lost, with that range as ``range``."""
    gone = dead.select(F.col(order).alias("range"), "file_path").distinct()
    return positions.join(gone, "file_path").filter(F.col(order) > F.col("range"))


def net_changes_by(manifest: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The same as :func:`net_files` over a manifest frame (file_path, change 'added' or 'removed'), for ranges of any size, told apart by the columns ``by``: those, file_path and change."""
    own = manifest.groupBy(*by, "file_path").agg(F.bool_or(F.col("change") == "added").alias("_a"), F.bool_or(F.col("change") == "removed").alias("_r"))
    return own.filter("_a <> _r").select(*by, "file_path", F.when(F.col("_a"), "added").otherwise("removed").alias("change"))


def net_file_changes(manifest: DataFrame, low: int, high: int) -> DataFrame:
    """:func:`net_changes_by` of the snapshots after ``low`` up to ``high`` of a manifest that also has their numbers as ``snapshot``."""
    return net_changes_by(manifest.filter((F.col("snapshot") > low) & (F.col("snapshot") <= high)))


def net_operation_column(all_replace, added_data, added_deletes, removed):
    """:func:`net_operation` as a column expression over counts."""
    return F.when(all_replace, "replace").when(added_data + added_deletes + removed == 0, "noop").when(added_data == 0, "delete").when(added_deletes + removed == 0, "append").otherwise("overwrite")


def squash(table: Table, low: int | None, high: int, new: list[File], schema: int | None = None) -> Snapshot | None:
    """Replace the snapshots after low up to high by one that adds ``new`` (data files and equality deletes only); later snapshots, also those committed meanwhile, follow it.

    With no net change the range just goes. The new snapshot carries the summary of high and the ids of what it replaces.
    """
    if any(f.content == POS for f in new):
        raise InvalidCompaction("a squash may add equality deletes only")

    return table.commit(lambda meta: _squash(table, meta, low, high, new, schema)[0])


def _squash(table: Table, meta: Metadata, low: int | None, high: int, new: list[File], schema: int | None = None) -> tuple[Snapshot | None, list[int], dict[int, int]]:
    """:func:`squash` in ``meta``: the new snapshot, the ids that it replaces, and of each that was picked anew its new id."""
    head = meta.refs.get("main")
    chain = [s.id for s in meta.ancestors(head)]
    if high not in chain:
        raise InvalidCompaction(f"snapshot {high} is not on the main branch")
    run = in_range(meta, low, high)
    added, removed = net_files(run)
    new_paths = {f.path for f in new}
    dead = {f.path for f in added if f.content == DATA} - new_paths
    later = [meta.snapshots[i] for i in reversed(chain[: chain.index(high)])]
    check_picks(later, dead)
    top = meta.snapshots[high]
    op = net_operation([s.op for s in run], sum(f.content == DATA for f in new), sum(f.content == EQ for f in new), len(removed))
    made, parent, picked = None, low, {}
    if op != "noop":
        summary = {**top.summary, SQUASHED: ",".join(str(s.id) for s in run)}
        # files keep the sequence they were first committed with when their snapshot is picked anew, so theirs counts
        seq = max((f.seq for s in run for f in s.added), default=top.seq)
        files = [replace(f, seq=seq) for f in new]
        made = table.add_snapshot(meta, op, files, removed, summary, parent=low, schema=top.schema if schema is None else schema, ts_ms=top.ts_ms)
        parent = made.id
    for s in later:
        parent = picked[s.id] = table.add_snapshot(meta, s.op, s.added, s.removed, {**s.summary, SOURCE: s.summary.get(SOURCE, str(s.id))}, parent=parent, schema=s.schema, ts_ms=s.ts_ms).id
    if parent is None:
        meta.refs.pop("main", None)
    else:
        meta.refs["main"] = parent
    return made, [s.id for s in run], picked


def cherry_pick(table: Table, snapshot: int) -> Snapshot:
    """Apply a snapshot of another chain on the head; if the head is its parent, the branch just moves to it."""

    def edit(meta: Metadata) -> Snapshot:
        s = meta.snapshots[snapshot]
        head = meta.refs.get("main")
        if s.parent == head:
            meta.refs["main"] = s.id
            return s
        check_picks([s], {r for f in s.added for r in f.refs} - {f.path for f in meta.live(head)} - {f.path for f in s.added})
        return table.add_snapshot(meta, s.op, s.added, s.removed, {**s.summary, SOURCE: str(s.id)}, schema=s.schema, ts_ms=s.ts_ms)

    return table.commit(edit)


def rewrite_keys(spark: SparkSession, files: list[File], table: Table, meta: Metadata, ranges: dict[str, int] | None = None) -> list[File]:
    """Equality deletes of one key as one set of distinct keys, or one per range if ``ranges`` has it by path; keys of dropped columns in the latest schema that had them."""
    out: list[File] = []
    for keys in sorted({f.keys for f in files}):
        parts = [f for f in files if f.keys == keys]
        having = [n for n, s in meta.schemas.items() if set(keys) <= set(evolve.physical(s).names)]
        own = Metadata(**meta.__dict__ | {"schema": meta.schema if meta.schema in having else max(having)})
        schema = own.schemas[own.schema]
        names = {f"c{f.metadata[evolve.ID]}": f.name for f in schema.fields}
        physical = evolve.physical(schema)
        df = read_files(spark, parts, T.StructType([physical[k] for k in keys]))
        if ranges is not None:
            df = with_file(spark, df.select("*", read_name().alias("_name")), parts, ranges)
        df = df.select(*[F.col(k).alias(names[k]) for k in keys], *(["_range"] if ranges is not None else []))
        out += table.write_equality_deletes(df, own, by="_range" if ranges is not None else None)
    return out


def compact(table: Table, low: int | None, high: int, *, max_records: int | None = None) -> Snapshot | None:
    """Compact the snapshots after ``low`` up to ``high``; the table's content stays the same at every snapshot kept.

    From the root (low None) no equality deletes remain and position deletes need no check. A change of the partition spec
    within the range is an error.
    """
    meta = table.metadata()
    added, top = _fit(meta, low, high), meta.snapshots[high]
    new: list[File] = []
    if any(f.content == DATA for f in added):
        rows = merge(table.spark, added, meta.schemas[top.schema], meta.schemas)
        at = _at(meta, top)
        at.spec = next(f.spec for f in added if f.content == DATA)
        new += table.write_data(rows, at, clustered=True, max_records=max_records)
        new = _without_empty(table, new)
    if low is not None and any(f.content == EQ for f in added):
        new += rewrite_keys(table.spark, [f for f in added if f.content == EQ], table, _at(meta, top))
    return squash(table, low, high, new)


def _fit(meta: Metadata, low: int | None, high: int) -> list[File]:
    """The files that a range adds in the end, if it can be compacted and later snapshots are fit to follow."""
    run = in_range(meta, low, high)
    if low is not None:
        check_positions(run)
    added, _ = net_files(run)
    if len({f.spec for s in run for f in s.added if f.content == DATA}) > 1:
        raise InvalidCompaction("the partition spec changes within the range")
    # later snapshots must be fit to follow before any row is written
    chain = [s.id for s in meta.ancestors(meta.refs.get("main"))]
    if high in chain:
        check_picks([meta.snapshots[i] for i in reversed(chain[: chain.index(high)])], {f.path for f in added if f.content == DATA})
    return added


def compact_all(table: Table, ranges: list[tuple[int | None, int]], *, max_records: int | None = None) -> list[Snapshot | None]:
    """:func:`compact` of several ranges (low and high as they are now) of the main branch that don't overlap, oldest first.

    The chain that comes out is the same, ids included, as of one compaction after the other, each of which picks all later
    snapshots anew. But one job for each schema and spec writes the files of all ranges, and the chain changes in a single
    version; snapshots that were picked only to be picked or squashed again are in none.
    """
    meta = table.metadata()
    place = {s.id: i for i, s in enumerate(reversed(meta.ancestors(meta.refs.get("main"))))}
    last = None
    for n, (low, high) in enumerate(ranges):
        if high not in place or low is not None and low not in place or n and (low is None or place[low] < place[last]):
            raise InvalidCompaction(f"the range after {low} up to {high} is not on the main branch or not after the one before")
        last = high
    new: dict[int, list[File]] = {n: [] for n in range(len(ranges))}
    jobs: dict[tuple[int, int], dict[int, list[File]]] = {}
    for n, (low, high) in enumerate(ranges):
        added, schema = _fit(meta, low, high), meta.snapshots[high].schema
        jobs.setdefault((schema, next((f.spec for f in added if f.content == DATA), -1)), {})[n] = added
    for (schema, spec), own in jobs.items():
        at = Metadata(**meta.__dict__ | {"schema": schema})
        of = {f.path: n for n, added in own.items() for f in added}
        written: list[File] = []
        if spec >= 0:
            rows = merge(table.spark, [f for added in own.values() for f in added], meta.schemas[schema], meta.schemas, ranges=of)
            written += table.write_data(rows, Metadata(**at.__dict__ | {"spec": spec}), clustered=True, max_records=max_records, by="_range")
        gone = [f for n, added in own.items() if ranges[n][0] is not None for f in added if f.content == EQ]
        written += rewrite_keys(table.spark, gone, table, at, of) if gone else []
        for f in written:
            new[int(part_value(f))].append(f)

    def edit(meta: Metadata) -> list[Snapshot | None]:
        known, out = set(meta.snapshots), []
        old = [s.id for s in reversed(meta.ancestors(meta.refs.get("main")))]
        now, at = list(old), {i: n for n, i in enumerate(old)}  # what each snapshot of the branch has become
        for n, (low, high) in enumerate(ranges):
            if high not in at:
                raise InvalidCompaction(f"snapshot {high} is not on the main branch")
            start, end = None if low is None else now[at[low]], at[high]
            # with nothing left before the range nothing is left to delete there
            made, run, picked = _squash(table, meta, start, now[end], [f for f in new[n] if start is not None or f.content != EQ])
            now[end] = made.id if made else start
            now[end + 1 :] = [picked[i] for i in now[end + 1 :]]
            for i in [*run, *picked]:
                if i not in known:
                    del meta.snapshots[i]
            out.append(made)
        return out

    return table.commit(edit) if ranges else []


def _at(meta: Metadata, s: Snapshot) -> Metadata:
    """The metadata with the schema that a snapshot was written in."""
    return Metadata(**meta.__dict__ | {"schema": s.schema})


def _without_empty(table: Table, files: list[File]) -> list[File]:
    """Files that hold rows: a range whose rows are all deleted leaves none."""
    if not files:
        return files
    full = table.spark.read.format(files[0].format).load([f.path for f in files]).select(read_name().alias("n")).distinct()
    names = {r.n for r in full.collect()}  # one row per file
    return [f for f in files if f.name in names]
