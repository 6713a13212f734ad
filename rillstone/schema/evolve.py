"""Evolution of table schemas with field ids: what a message's schema changes, and how old files are read afterwards.

Every field has an id in its metadata and files hold columns by id, so that a rename moves no data, a dropped and re-added
name can't show old values, and a file that lacks an id reads as null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ID = "field_id"


@dataclass(frozen=True)
class Change:
    """kind: add, drop, replace, promote, nullability or doc; path: dotted name; detail: what it becomes."""

    kind: str
    path: str
    detail: str = ""


def _with(f: T.StructField, t: T.DataType | None = None, **meta) -> T.StructField:
    return T.StructField(f.name, t or f.dataType, f.nullable, {**f.metadata, **meta})


def assign_ids(t: T.DataType, last: int) -> tuple[T.DataType, int]:
    """Fresh ids for all fields of a type, after ``last``; gives the last one used."""
    if isinstance(t, T.StructType):
        fields = []
        for f in t.fields:
            last += 1
            own = last
            sub, last = assign_ids(f.dataType, last)
            fields.append(_with(f, sub, **{ID: own}))
        return T.StructType(fields), last
    if isinstance(t, T.ArrayType):
        sub, last = assign_ids(t.elementType, last)
        return T.ArrayType(sub, t.containsNull), last
    if isinstance(t, T.MapType):
        k, last = assign_ids(t.keyType, last)
        v, last = assign_ids(t.valueType, last)
        return T.MapType(k, v, t.valueContainsNull), last
    return t, last


def physical(t: T.DataType) -> T.DataType:
    """The type as files hold it: fields are named by id, all optional."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f"c{f.metadata[ID]}", physical(f.dataType), True) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(physical(t.elementType), True)
    if isinstance(t, T.MapType):
        return T.MapType(physical(t.keyType), physical(t.valueType), True)
    return t


def equal(a: T.DataType, b: T.DataType) -> bool:
    """Whether types are the same but for ids and the order of fields."""
    if type(a) is not type(b):
        return False
    if isinstance(a, T.StructType):
        if sorted(a.names) != sorted(b.names):
            return False
        return all(f.nullable == b[f.name].nullable and f.metadata.get("comment") == b[f.name].metadata.get("comment") and equal(f.dataType, b[f.name].dataType) for f in a.fields)
    if isinstance(a, T.ArrayType):
        return a.containsNull == b.containsNull and equal(a.elementType, b.elementType)
    if isinstance(a, T.MapType):
        return a.valueContainsNull == b.valueContainsNull and equal(a.keyType, b.keyType) and equal(a.valueType, b.valueType)
    return a == b


def promotable(old: T.DataType, new: T.DataType) -> bool:
    """Whether values of the old type can be read as the new: int to long, float to double, wider decimals of one scale, structs (field by field), arrays and maps of such; keys of maps can't change."""
    if isinstance(old, T.StructType):
        return isinstance(new, T.StructType)
    if isinstance(old, T.ArrayType):
        return isinstance(new, T.ArrayType) and promotable(old.elementType, new.elementType)
    if isinstance(old, T.MapType):
        return isinstance(new, T.MapType) and promotable(old.valueType, new.valueType) and equal(old.keyType, new.keyType)
    if isinstance(old, T.DecimalType):
        return isinstance(new, T.DecimalType) and new.scale == old.scale and new.precision >= old.precision
    return old == new or (isinstance(old, T.IntegerType) and isinstance(new, T.LongType)) or (isinstance(old, T.FloatType) and isinstance(new, T.DoubleType))


class _Merge:
    def __init__(self, last: int):
        self.last, self.changes = last, []

    def fresh(self, f: T.StructField) -> T.StructField:
        self.last += 1
        own = self.last
        sub, self.last = assign_ids(f.dataType, self.last)
        return _with(f, sub, **{ID: own})

    def struct(self, old: T.StructType, new: T.StructType, path: str) -> T.StructType:
        kept, end = [], []
        for f in old.fields:
            p = f"{path}{f.name}"
            if f.name not in new.names:
                self.changes.append(Change("drop", p))
                continue
            g = new[f.name]
            if not promotable(f.dataType, g.dataType):
                self.changes.append(Change("replace", p, g.dataType.simpleString()))
                end.append(self.fresh(g))
                continue
            doc = g.metadata.get("comment")
            if doc != f.metadata.get("comment"):
                self.changes.append(Change("doc", p, doc or ""))
            if g.nullable != f.nullable:
                self.changes.append(Change("nullability", p, "optional" if g.nullable else "required"))
            meta = {ID: f.metadata[ID]} | ({"comment": doc} if doc else {})
            kept.append(T.StructField(f.name, self.type(f.dataType, g.dataType, p), g.nullable, meta))
        for g in new.fields:
            if g.name not in old.names:
                self.changes.append(Change("add", f"{path}{g.name}", ("optional " if g.nullable else "required ") + g.dataType.simpleString()))
                end.append(self.fresh(g))
        return T.StructType(kept + end)

    def type(self, old: T.DataType, new: T.DataType, path: str) -> T.DataType:
        if isinstance(old, T.StructType):
            return self.struct(old, new, f"{path}.")
        if isinstance(old, T.ArrayType):
            if old.containsNull != new.containsNull:
                self.changes.append(Change("nullability", f"{path}.element", "optional" if new.containsNull else "required"))
            return T.ArrayType(self.type(old.elementType, new.elementType, f"{path}.element"), new.containsNull)
        if isinstance(old, T.MapType):
            if old.valueContainsNull != new.valueContainsNull:
                self.changes.append(Change("nullability", f"{path}.value", "optional" if new.valueContainsNull else "required"))
            return T.MapType(old.keyType, self.type(old.valueType, new.valueType, f"{path}.value"), new.valueContainsNull)
        if old != new:
            self.changes.append(Change("promote", path, new.simpleString()))
        return new


def migrate(old: T.StructType, new: T.StructType, last_id: int) -> tuple[T.StructType, list[Change], int]:
    """The table's schema after a message schema: kept fields keep ids and order, replaced and added ones follow with fresh ids."""
    m = _Merge(last_id)
    schema = m.struct(old, new, "")
    return schema, m.changes, m.last


def should_migrate(stored: str | None, record_version: str | None, has_key: bool, has_value: bool) -> bool:
    """Whether a record asks for a migration: never without key or value, else if its version isn't the stored one."""
    return has_key and has_value and record_version != stored
