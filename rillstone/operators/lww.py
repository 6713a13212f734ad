"""Current state from a change feed, column-wise: the last writer of each field wins. SQL only.

For each field the value is ``max_by`` over the changes that set it; it counts only if that change isn't older than the
latest delete or replacement of the row. Both are aggregates of one pass, so a hot key is combined before the shuffle,
repeated changes are absorbed (the same sequence twice is the same maximum) and the order of arrival doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def _in(op: str, ops: list[str]) -> str:
    return f"{op} in ({', '.join(repr(o) for o in ops)})" if ops else "false"


def apply_changes_sql(keys: list[str], seq: str, op: str, fields: dict[str, tuple[str, str]], *, replace_ops: list[str], patch_ops: list[str], delete_ops: list[str], positions: bool = False, source: str = "{changes}") -> str:
    """The statement of :func:`apply_changes`."""
    by = ", ".join(f"`{k}`" for k in keys)
    sets = _in(op, [*replace_ops, *patch_ops])
    parts = [
        f"max({seq}) filter (where {sets}) as _set",
        f"max({seq}) filter (where {_in(op, replace_ops)}) as _whole",
        f"max({seq}) filter (where {_in(op, delete_ops)}) as _gone",
    ]
    out = []
    for name, (value, present) in fields.items():
        # a replacement sets every field, those it lacks to null
        said = f"({_in(op, replace_ops)} or ({_in(op, patch_ops)} and ({present})))"
        parts.append(f"max_by(struct({seq} as s, {value} as v), struct({seq} as s, {value} as v)) filter (where {said}) as `_f_{name}`")
        counts = f"case when (_gone is null or `_f_{name}`.s > _gone) and (_whole is null or `_f_{name}`.s >= _whole) then `_f_{name}`"
        out += [f"{counts}.v end as `{name}`", *([f"{counts}.s end as `{name}_at`"] if positions else [])]
    return f"select {', '.join([by, '_set as last_change', *out])} from (select {by}, {', '.join(parts)} from {source} where {seq} is not null group by {by}) where _set is not null and (_gone is null or _set > _gone)"


def apply_changes(changes: DataFrame, keys: list[str], seq: str, op: str, fields: dict[str, tuple[str, str]], *, replace_ops: list[str], patch_ops: list[str], delete_ops: list[str], positions: bool = False) -> DataFrame:
    """Rows that exist once every change has been applied in the order of ``seq``: keys, ``last_change`` (the sequence of the change that made the row), fields.

    ``seq`` and ``op`` are SQL expressions over ``changes``; ``fields`` maps a column to its value and to the condition
    under which a patch sets it (a patch without the field leaves it). Operations of no list do nothing, as do changes
    without sequence. A null key is a key. At the same sequence a delete wins over a set, and of several values the
    largest, nulls last. ``positions`` adds to each field the sequence of the change that set it, as ``field_at``.
    """
    return changes.sparkSession.sql(apply_changes_sql(keys, seq, op, fields, replace_ops=replace_ops, patch_ops=patch_ops, delete_ops=delete_ops, positions=positions), changes=changes)
