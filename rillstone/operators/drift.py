"""Schemas that drift between files: one consistent table, and every change of a field.

Each file's JSON objects are profiled in one distributed pass: leaf paths and types. Files in a row that have one schema are
one *version* of it; only versions reach the driver, never files or data. Between two versions similarity flooding finds
what goes on as what: both schemas become graphs of names, types and nesting; each pair of nodes starts with a score, pairs
of fields of one name with 1, pairs of another name with how well the values of the one go on in the other; each pair
passes its score on to the pairs of its neighbours until the scores converge. Correspondences are the pairs whose flooded
score reaches ``THRESHOLD``, one to one, best first. What has none was removed or added.
"""

from __future__ import annotations

import json
import sys
from collections import defaultdict
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise

#: From weak to strong: a file that has several types of a field has the strongest.
STRENGTH = ["null", "boolean", "integer", "number", "array", "string"]
#: Flooded score from which two fields correspond; a field that keeps its name and nothing else has 1, two fields of one type
#: that have nothing but their place and a part of their names in common stay below 0.2.
THRESHOLD = 0.22
#: Share of a pair's score that it passes on, and of the likeness of names in the score that a pair of fields starts with.
DAMPING, NAMES = 0.25, 0.05
#: How many times as many agreements as chance gives to one record are needed for half of the weight.
DOUBT = 4


def kind_of(x) -> str:
    """Type of a JSON value."""
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, int):
        return "integer"
    if isinstance(x, float):
        return "number"
    if isinstance(x, list):
        return "array"
    return "string"


def leaves(x: dict, prefix: str = ""):
    """(path, value) of each field: objects are no fields, arrays are."""
    for k, v in x.items():
        if isinstance(v, dict):
            yield from leaves(v, f"{prefix}{k}.")
        else:
            yield prefix + k, v


def _objects(column):
    sys.set_int_max_str_digits(0)  # else an integer of over 4300 digits makes its text unreadable
    for i, text in enumerate(column.to_pylist()):
        if text is None:
            continue
        try:
            x = json.loads(text)
        except ValueError:
            continue
        if isinstance(x, dict):
            yield i, x


def _profile(batches):
    """Counts of (file, path, type) in a partition."""
    import pyarrow as pa

    counts: dict[tuple, int] = defaultdict(int)
    for batch in batches:
        files, topics = batch.column("file_id").to_pylist(), batch.column("topic").to_pylist()
        for i, x in _objects(batch.column("after")):
            file = (topics[i], files[i])
            for k, v in x.items():
                if isinstance(v, dict):
                    for path, leaf in leaves(v, f"{k}."):
                        counts[file, path, kind_of(leaf)] += 1
                else:
                    counts[file, k, kind_of(v)] += 1
    rows = [(*f, p, t, n) for (f, p, t), n in counts.items()]
    cols = list(zip(*rows)) if rows else [[]] * 5
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["topic", "file_id", "path", "kind", "n"])


def profile(feed: DataFrame) -> DataFrame:
    """(topic, file_id, path, kind, n) over all objects in ``after``; texts that are no JSON object tell nothing."""
    rows = feed.filter(F.col("after").isNotNull() & F.col("file_id").isNotNull()).select("topic", "file_id", "after")
    return rows.mapInArrow(_profile, "topic string, file_id bigint, path string, kind string, n bigint").groupBy("topic", "file_id", "path", "kind").agg(F.sum("n").alias("n"))


def versions(feed: DataFrame, files: DataFrame) -> DataFrame:
    """(topic, file_id, place, version, shape): files with objects in order of opened_at (unknown times last, then file_id) and the version of the schema each has.

    A file that ``files`` doesn't list has an unknown time. Rows without file_id belong to no file; a null topic equals null.

    ``version`` counts the files so far whose paths and types aren't those of the file before; ``shape`` holds a file's
    paths and types where a version starts, else null. Written once, for reading it again would parse all texts again.
    """
    shapes = profile(feed).groupBy("topic", "file_id").agg(F.array_sort(F.collect_list(F.struct("path", "kind"))).alias("shape"))
    order = files.filter("file_id is not null").groupBy("topic", "file_id").agg(F.min("opened_at").alias("opened_at"))
    there = order.select(F.col("topic").alias("_t"), F.col("file_id").alias("_f"), "opened_at")
    rows = shapes.join(there, F.col("topic").eqNullSafe(F.col("_t")) & (F.col("file_id") == F.col("_f")), "left").withColumn("hash", F.xxhash64("shape"))
    w = Window.partitionBy("topic").orderBy(F.col("opened_at").asc_nulls_last(), "file_id")  # one row per file
    rows = rows.withColumns({"place": F.row_number().over(w), "starts": (~F.col("hash").eqNullSafe(F.lag("hash").over(w))).cast("int")})
    rows = rows.withColumn("version", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return materialise(rows.select("topic", "file_id", "place", "version", F.when(F.col("starts") == 1, F.col("shape")).alias("shape")), "schemas")


def schemas(versions_: DataFrame) -> dict[str, list[tuple[int, int, dict[str, str]]]]:
    """Per topic its versions in order: the file and place each starts at, and the type of each field.

    A type that only nulls would tell is that of the version before. A path that elsewhere in the topic is an object is no
    field where it is null.
    """
    got: dict[str, list] = defaultdict(list)
    objects: dict[str, set[str]] = defaultdict(set)
    for r in versions_.filter("shape is not null").orderBy("topic", "version").collect():  # one row per version of a schema
        got[r.topic].append(r)
        for p, _ in r.shape:
            while "." in p:
                p = p.rpartition(".")[0]
                objects[r.topic].add(p)
    out = {}
    for topic, rows in got.items():
        out[topic], before = [], {}
        for r in rows:
            kinds: dict[str, set[str]] = defaultdict(set)
            for p, k in r.shape:
                kinds[p].add(k)
            own = {}
            for p, ks in kinds.items():
                kind = max(ks, key=STRENGTH.index)
                if kind == "null" and p in objects[topic]:
                    continue
                own[p] = before.get(p, "null") if kind == "null" else kind
            before |= own
            out[topic].append((r.file_id, r.place, own))
    return out


def _trigrams(name: str) -> set[str]:
    name = f"  {name.lower()} "
    return {name[i : i + 3] for i in range(len(name) - 2)}


def name_likeness(a: str, b: str) -> float:
    """Of two paths: the share of common trigrams of their last parts."""
    p, q = (_trigrams(x.rpartition(".")[2]) for x in (a, b))
    return 2 * len(p & q) / (len(p) + len(q))


def _graph(schema: dict[str, str]) -> list[tuple[str, str, str]]:
    """Edges (node, label, node): an object to its parts, a field to its type."""
    edges = set()
    for path, kind in schema.items():
        parts = path.split(".")
        for i in range(len(parts)):
            edges.add(("/" + ".".join(parts[:i]), "part", "/" + ".".join(parts[: i + 1])))
        edges.add(("/" + path, "type", "#" + kind))
    return sorted(edges)


def flood(old: dict[str, str], new: dict[str, str], evidence: dict[tuple[str, str], float], *, rounds: int = 500, eps: float = 1e-6) -> dict[tuple[str, str], float]:
    """Scores of all pairs (old field, new field) by similarity flooding, at most 1: where it starts plus what flows in from its neighbours, once the scores have converged."""
    import numpy as np

    ea, eb = _graph(old), _graph(new)
    by: dict[str, list] = defaultdict(list)
    for e in eb:
        by[e[1]].append(e)

    def start(a: str, b: str) -> float:
        x, y = a[1:], b[1:]
        if a[0] != b[0] or a[0] == "#":
            return 0.0  # types only pass on what their fields have, else the only two flags would be one
        if a == b:
            return 1.0
        if not x or not y:
            return 0.0
        if x in old and y in new:
            # a field that goes on under another name keeps its type
            return (1 - NAMES) * evidence.get((x, y), 0.0) + NAMES * name_likeness(x, y) if old[x] == new[y] else 0.0
        return name_likeness(x, y) if x not in old and y not in new else 0.0

    number: dict[tuple[str, str], int] = {}
    ends, out, into = [], defaultdict(int), defaultdict(int)
    for a, label, a2 in ea:
        for b, _, b2 in by[label]:
            p, q = (number.setdefault(n, len(number)) for n in ((a, b), (a2, b2)))
            ends.append((p, q, label))
            out[p, label] += 1
            into[q, label] += 1
    if not number:
        return {}
    first = np.array([start(*n) for n in number])
    p, q = np.array([e[0] for e in ends]), np.array([e[1] for e in ends])
    down, up = np.array([DAMPING / out[e[0], e[2]] for e in ends]), np.array([DAMPING / into[e[1], e[2]] for e in ends])
    score, top = first.copy(), 1.0
    for _ in range(rounds):
        flow = first + score
        nxt = flow + np.bincount(q, down * flow[p], len(flow)) + np.bincount(p, up * flow[q], len(flow))
        top = nxt.max() or 1.0
        moved = np.abs(nxt / top - score).max()
        score = nxt / top
        if moved < eps:
            break
    # a pair without neighbours would end at first / (top - 1): in that measure 1 is a kept name alone
    score = score * max(top - 1, 1e-9)
    found = {(a[1:], b[1:]): float(score[i]) for (a, b), i in number.items() if a[1:] in old and b[1:] in new and a[0] == b[0] == "/"}
    most = max([1.0, *found.values()])
    return {k: v / most for k, v in found.items()}


def correspondences(old: dict[str, str], new: dict[str, str], evidence: dict[tuple[str, str], float]) -> dict[str, str]:
    """Old field -> new field, one to one: the best flooded scores first, down to ``THRESHOLD``; fields of different names have one type."""
    score = flood(old, new, evidence)
    match: dict[str, str] = {}
    taken = set()
    for a, b in sorted(score, key=lambda k: (-score[k], k)):
        if score[a, b] < THRESHOLD:
            break
        if a not in match and b not in taken and (a == b or old[a] == new[b]):
            match[a] = b
            taken.add(b)
    return match


def _cells(wanted: dict[tuple[str, int], list[tuple[int, str, int, int]]], ids: list[str]):
    """Values of the fields in question: ``wanted`` maps a version to (case, path, side, place of the change)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            topics, numbers, places, keys = (batch.column(c).to_pylist() for c in ("topic", "version", "place", "record_key"))
            rows = []
            for i, x in _objects(batch.column("after")):
                flat = dict(leaves(x))
                try:
                    key = json.loads(keys[i]) if keys[i] else {}
                except ValueError:
                    key = {}
                ent = next((str(key[n]) for n in ids if isinstance(key, dict) and n in key), None)
                for case, path, side, at in wanted[topics[i], numbers[i]]:
                    v = flat.get(path)
                    if v is not None:
                        rows.append((case, path, side, abs(places[i] - at), ent, v if isinstance(v, str) else json.dumps(v)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["case_no", "path", "side", "far", "ent", "val"])

    return run


def value_evidence(feed: DataFrame, versions_: DataFrame, cases: list[tuple[str, int, dict[str, range], dict[str, range]]], ids: list[str]) -> dict[int, dict[tuple[str, str], float]]:
    """How well values go on, from 0 to 1, per case and pair of fields.

    A case is a topic, the place of the change, the fields that went, each with the versions that held it without a break up
    to the change, and the fields that came, with those that hold it without a break from it on. All of their rows are read. Of records on both sides: how far the values in the files
    nearest to the change on either side are the same (common values over all values, on average), less what chance gives.
    The overlap of the values' relative frequencies counts as one such record, and alone where there is none.
    """
    wanted: dict[tuple[str, int], list[tuple[int, str, int, int]]] = defaultdict(list)
    for n, (topic, place, went, came) in enumerate(cases):
        for side, fields in enumerate((went, came)):
            for path, held in fields.items():
                for v in held:
                    wanted[topic, v].append((n, path, side, place))
    if not wanted:
        return {}
    # a filter and no join, so that the few rows of versions are known to be few
    of: dict[str, list[int]] = defaultdict(list)
    for t, v in wanted:
        of[t].append(v)
    look = reduce(or_, [F.col("topic").eqNullSafe(F.lit(t)) & F.col("version").isin(vs) for t, vs in of.items()])
    read = versions_.filter(look).select(F.col("topic").alias("_t"), F.col("file_id").alias("_f"), "version", "place")
    rows = feed.filter(F.col("after").isNotNull()).select("topic", "file_id", "record_key", "after").join(read, F.col("topic").eqNullSafe(F.col("_t")) & (F.col("file_id") == F.col("_f")))
    cells = rows.select("topic", "version", "place", "record_key", "after").mapInArrow(_cells(dict(wanted), ids), "case_no int, path string, side int, far int, ent string, val string")
    # read several times below: written once, so that the texts are parsed once
    cells = materialise(cells.groupBy("case_no", "path", "side", "ent", "val").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("far")), "values")
    by_val = cells.groupBy("case_no", "path", "side", "val").agg(F.sum("n").alias("n"))
    total = cells.groupBy("case_no", "path", "side").agg(F.sum("n").alias("t"))
    by_val = by_val.join(total, ["case_no", "path", "side"]).select("case_no", "path", "side", "val", (F.col("n") / F.col("t")).alias("f"))

    def sides(df: DataFrame, *extra: str) -> DataFrame:
        a = df.filter("side = 0").select("case_no", F.col("path").alias("old"), *extra)
        b = df.filter("side = 1").select("case_no", F.col("path").alias("new"), *[F.col(c).alias(f"{c}_2") for c in extra])
        return a.join(b, [a.case_no == b.case_no, a[extra[0]] == b[f"{extra[0]}_2"]]).drop(b.case_no)

    freq = sides(by_val, "val", "f").groupBy("case_no", "old", "new").agg(F.sum(F.least("f", "f_2")).alias("overlap"), F.sum(F.col("f") * F.col("f_2")).alias("chance"))
    # the nearest file of each record, its values there, and how many they are
    known = cells.filter("ent is not null")
    nearest = known.groupBy("case_no", "path", "side", "ent").agg(F.min("far").alias("far"))
    pairs = known.join(nearest, ["case_no", "path", "side", "ent", "far"]).select("case_no", "path", "side", "ent", "val")
    count = pairs.groupBy("case_no", "path", "side", "ent").agg(F.count(F.lit(1)).alias("k"))
    common = sides(pairs.select("case_no", "path", "side", F.struct("ent", "val").alias("ev")), "ev").groupBy("case_no", "old", "new", F.col("ev.ent").alias("ent")).agg(F.count(F.lit(1)).alias("c"))
    both = sides(count, "ent", "k").select("case_no", "old", "new", "ent", (F.col("k") + F.col("k_2")).alias("k"))
    both = both.join(common, ["case_no", "old", "new", "ent"], "left").groupBy("case_no", "old", "new").agg(F.count(F.lit(1)).alias("seen"), F.avg(F.coalesce("c", F.lit(0)) / (F.col("k") - F.coalesce("c", F.lit(0)))).alias("same"))
    out: dict[int, dict[tuple[str, str], float]] = defaultdict(dict)
    for r in freq.join(both, ["case_no", "old", "new"], "full").collect():  # one row per pair of fields
        seen, chance = r.seen or 0, min(r.chance or 0.0, 0.999)
        agree = seen * (r.same or 0.0)
        same = max(0.0, ((r.same or 0.0) - chance) / (1 - chance)) * agree / (agree + DOUBT * chance) if agree else 0.0
        out[r.case_no][r.old, r.new] = (seen * same + (r.overlap or 0.0)) / (seen + 1)
    return dict(out)


def drift(feed: DataFrame, versions_: DataFrame, ids: list[str]) -> tuple[list[tuple[str, int, str, str, str]], dict[str, list[tuple[dict[str, str], dict[str, str]]]]]:
    """All changes (topic, file_id, change, field, new_field), and per topic its versions with schema and the map of their fields to fields of the consistent table."""
    per_topic = schemas(versions_)
    cases, at = [], {}
    for topic, seq in per_topic.items():
        for v, ((_, _, s0), (_, place, s1)) in enumerate(zip(seq, seq[1:]), 2):
            went, came = sorted(set(s0) - set(s1)), sorted(set(s1) - set(s0))
            pairs = [(a, b) for a in went for b in came if s0[a] == s1[b]]
            if pairs:
                at[topic, v] = len(cases)
                went = {a: range(next((k for k in range(v - 1, 0, -1) if a not in seq[k - 1][2]), 0) + 1, v) for a, _ in pairs}
                came = {b: range(v, next((k for k in range(v, len(seq) + 1) if b not in seq[k - 1][2]), len(seq) + 1)) for _, b in pairs}
                cases.append((topic, place, went, came))
    found = value_evidence(feed, versions_, cases, ids)
    changes, tables = [], {}
    for topic, seq in per_topic.items():
        names = {f: f for f in seq[0][2]}
        tables[topic] = [(seq[0][2], dict(names))]
        for v, ((_, _, s0), (file, _, s1)) in enumerate(zip(seq, seq[1:]), 2):
            match = correspondences(s0, s1, found.get(at.get((topic, v), -1), {}))
            back = {b: a for a, b in match.items()}
            for a, b in match.items():
                if a != b:
                    changes.append((topic, file, "renamed", a, b))
                elif s0[a] != s1[b] and "null" not in (s0[a], s1[b]):
                    changes.append((topic, file, "retyped", a, a))
            changes += [(topic, file, "removed", a, a) for a in s0 if a not in match]
            changes += [(topic, file, "added", b, b) for b in s1 if b not in back]
            # a field that comes anew takes its own name if no other field goes on under it
            goes_on = {names[back[b]] for b in s1 if b in back}
            fresh = {}
            for b in s1:
                if b in back:
                    fresh[b] = names[back[b]]
                else:
                    own, n = b, 2
                    while own in goes_on or own in fresh.values():
                        own, n = f"{b}_{n}", n + 1
                    fresh[b] = own
            names = fresh
            tables[topic].append((s1, dict(names)))
    return changes, tables


def changes_table(spark: SparkSession, feed: DataFrame, files: DataFrame, ids: list[str]) -> DataFrame:
    """Every change of a field with the file where it starts. No files or objects give no changes."""
    rows, _ = drift(feed, versions(feed, files), ids)
    return spark.createDataFrame(rows, "topic string, file_id bigint, change string, field string, new_field string")


def _unified_type(kinds: set[str]) -> str:
    kinds = kinds - {"null"}
    if kinds == {"boolean"}:
        return "boolean"
    if kinds == {"integer"}:
        return "bigint"
    if kinds and kinds <= {"integer", "number"}:
        return "double"
    return "string"


def _double(v) -> float:
    """As SQL casts it: infinite beyond the range."""
    try:
        return float(v)
    except OverflowError:
        return float("inf") if v > 0 else float("-inf")


def _unify(maps: dict[int, list[tuple[str, str]]], columns: list[tuple[str, str]]):
    def run(batches):
        import pyarrow as pa

        arrow = {"boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
        kind = dict(columns)
        for batch in batches:
            out: dict[str, list] = {c: [None] * batch.num_rows for c, _ in columns}
            numbers = batch.column("version").to_pylist()
            for i, x in _objects(batch.column("after")):
                flat = dict(leaves(x))
                for path, col in maps.get(numbers[i], ()):
                    v = flat.get(path)
                    if v is None:
                        continue
                    k = kind[col]
                    if k == "bigint" and not -(2**63) <= v < 2**63:
                        continue  # no integer of the table's type
                    out[col][i] = v if k in ("boolean", "bigint") else _double(v) if k == "double" else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("delivery_id", "file_id")], *[pa.array(out[c], arrow[k]) for c, k in columns]], names=["delivery_id", "file_id", *[c for c, _ in columns]])

    return run


def _consistent(feed: DataFrame, files: DataFrame, topic: str, ids: list[str]) -> tuple[DataFrame, dict[int, list[tuple[str, str]]], list[tuple[str, str]]]:
    """All rows of a topic with their version of the schema, per version its paths with their columns, and the columns with their types."""
    own = feed.filter(F.col("topic") == topic)
    known = versions(own, files.filter(F.col("topic") == topic))
    _, tables = drift(own, known, ids)
    kinds: dict[str, set[str]] = defaultdict(set)
    maps: dict[int, list[tuple[str, str]]] = {}
    for v, (s, names) in enumerate(tables.get(topic, []), 1):
        maps[v] = [(p, names[p].replace(".", "_")) for p in s]
        for p, c in maps[v]:
            kinds[c].add(s[p])
    rows = own.select("delivery_id", "file_id", "after").join(known.select("file_id", "version"), "file_id", "left")
    return rows, maps, sorted((c, _unified_type(k)) for c, k in kinds.items())


def consistent_table(spark: SparkSession, feed: DataFrame, files: DataFrame, topic: str, ids: list[str]) -> DataFrame:
    """All rows of a topic as one table: delivery_id, file_id and a column per field, under its first name, in a type for all of its types (text if they differ in kind; arrays as JSON).

    Two kinds of integers don't fit, and :func:`unheld_integers` counts them: beyond 64 bits they are null in a bigint
    column, and where a field is also a number the column is double, which rounds those beyond 2^53 (to infinity from about 10^308 on).
    """
    rows, maps, columns = _consistent(feed, files, topic, ids)
    ddl = ", ".join(["delivery_id bigint", "file_id bigint", *[f"`{c}` {t}" for c, t in columns]])
    return rows.mapInArrow(_unify(maps, columns), ddl)


def _unheld(maps: dict[int, list[tuple[str, str]]], columns: list[tuple[str, str]]):
    def run(batches):
        import pyarrow as pa

        kind, counts = dict(columns), defaultdict(int)
        for batch in batches:
            numbers = batch.column("version").to_pylist()
            for i, x in _objects(batch.column("after")):
                flat = dict(leaves(x))
                for path, col in maps.get(numbers[i], ()):
                    v = flat.get(path)
                    if not isinstance(v, int) or isinstance(v, bool):
                        continue
                    if kind[col] == "bigint" and not -(2**63) <= v < 2**63:
                        counts[col, "null"] += 1
                    elif kind[col] == "double" and _double(v) != v:
                        counts[col, "rounded"] += 1
        rows = [(*k, n) for k, n in counts.items()]
        cols = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.string(), pa.string(), pa.int64()])], names=["column", "becomes", "n"])

    return run


def unheld_integers(spark: SparkSession, feed: DataFrame, files: DataFrame, topic: str, ids: list[str]) -> DataFrame:
    """(column, becomes, n): how many integers of a topic its consistent table holds as null or rounded; no rows if it holds all as they are."""
    rows, maps, columns = _consistent(feed, files, topic, ids)
    return rows.mapInArrow(_unheld(maps, columns), "column string, becomes string, n bigint").groupBy("column", "becomes").agg(F.sum("n").alias("n"))


def _unreadable(batches):
    import pyarrow as pa

    for batch in batches:
        read = {i for i, _ in _objects(batch.column("after"))}
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("topic", "file_id")] + [pa.array([int(i not in read) for i in range(batch.num_rows)], pa.int64())], names=["topic", "file_id", "n"])


def unreadable_texts(feed: DataFrame) -> DataFrame:
    """(topic, file_id, n): how many texts of a file are no JSON object, so that they tell nothing of its schema and are rows of nulls in the consistent table; files without such are left out."""
    rows = feed.filter(F.col("after").isNotNull()).select("topic", "file_id", "after").mapInArrow(_unreadable, "topic string, file_id bigint, n bigint")
    return rows.groupBy("topic", "file_id").agg(F.sum("n").alias("n")).filter("n > 0")
