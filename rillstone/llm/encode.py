"""Encoding of a whole corpus with a public byte-level BPE, as a monoid over pieces of text.

Short texts are leaves. A longer text is halved recursively down to leaves, and neighbours are joined up the tree: only a
window around their boundary is encoded again. The window grows on both sides until it ends at *stable cuts*. A stable
cut lies between two characters that no pre-token of the vocabulary's pattern can hold in this order, whatever stands
around them, so the tokens outside the window are those of the whole text, provably:

- a letter is followed in its pre-token by letters only, a digit by digits only;
- any other visible character is followed by others of its kind, or, after an apostrophe, by letters; never by white
  space or a digit;
- white space before visible text is no stable cut, for a blank may belong to either side.

Joining is associative, with the empty text as its neutral element, and decoding is concatenation up the tree.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .tokens import FOLDER, byte_bpe

#: Characters of a leaf; longer texts are halved.
LEAF = 8192
#: Characters looked at first on either side of a boundary.
WINDOW = 32
#: Control characters that libraries don't agree on as white space: no cut beside them.
_UNSURE = "\x1c-\x1f\x85᠎​﻿"


def _cut_pattern():
    import regex

    other = rf"[^\s\p{{L}}\p{{N}}\p{{M}}{_UNSURE}]"
    sure = rf"(?![{_UNSURE}])"
    return regex.compile(rf"(?<=\p{{L}}){sure}(?=[^\p{{L}}\p{{M}}])|(?<=\p{{N}}){sure}(?=[^\p{{N}}\p{{M}}])|(?<={other}){sure}(?=[\s\p{{N}}])|(?<=(?!'){other}){sure}(?=\p{{L}})")


class Encoder:
    """Encodes texts of any length with one vocabulary."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = FOLDER, leaf: int = LEAF, window: int = WINDOW):
        self.bpe, self.leaf, self.window, self.cut = byte_bpe(name, folder), leaf, window, _cut_pattern()

    def first_cut(self, text: str, start: int, end: int) -> int:
        """The first stable cut in text[start:end], or end."""
        width = self.window
        while True:
            stop = min(end, start + width)
            # characters before start don't count as context: the cut must hold within this side
            if (m := self.cut.search(text[start : min(end, stop + 1)])) and m.start() > 0:
                return start + m.start()
            if stop >= end:
                return end
            width *= 2

    def last_cut(self, text: str, start: int, end: int) -> int:
        """The last stable cut in text[start:end], or start."""
        width = self.window
        while True:
            begin = max(start, end - width)
            last = -1
            for m in self.cut.finditer(text[begin:end]):
                last = m.start()
            if last > 0:
                return begin + last
            if begin <= start:
                return start
            width *= 2

    def join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[start:end] from those of its two parts."""
        a, b = self.last_cut(text, start, middle), self.first_cut(text, middle, end)
        n, m = len(self.bpe.encode_ordinary(text[a:middle])), len(self.bpe.encode_ordinary(text[middle:b]))
        return left[: len(left) - n] + self.bpe.encode_ordinary(text[a:b]) + right[m:]

    def span(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.bpe.encode_ordinary(text[start:end])
        middle = (start + end) // 2
        return self.join(text, start, middle, end, self.span(text, start, middle), self.span(text, middle, end))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or an empty one."""
        return self.span(text, 0, len(text)) if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids, by concatenating their bytes up the tree; bytes that are no UTF-8 become replacement characters."""

        def tree(lo: int, hi: int) -> bytes:
            if hi - lo <= self.leaf:
                return self.bpe.decode_bytes(ids[lo:hi])
            mid = (lo + hi) // 2
            return tree(lo, mid) + tree(mid, hi)

        return tree(0, len(ids)).decode("utf-8", errors="replace")


def _encode_batches(name: str, folder: str, leaf: int, id_col: str, text_col: str):
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = Encoder(name, folder, leaf)
        for batch in batches:
            flat, ends = [], [0]
            for text in batch.column(text_col).to_pylist():
                flat.append(np.array(encoder.encode(text), dtype=np.int32))
                ends.append(ends[-1] + len(flat[-1]))
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[id_col, "ids"])

    return run


def _count_batches(name: str, folder: str, leaf: int, keep: list[str], text_col: str):
    def run(batches) -> Iterator:
        import pyarrow as pa

        encoder = Encoder(name, folder, leaf)
        for batch in batches:
            n = pa.array([len(encoder.encode(t)) for t in batch.column(text_col).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], n], names=[*keep, "n_tokens"])

    return run


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, leaf: int = LEAF) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every row, without a shuffle. Null and empty texts give an empty list; repeated rows come out as often."""
    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(_encode_batches(vocabulary, folder, leaf, id_col, text_col), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", *, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, leaf: int = LEAF) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row."""
    rows = docs.select(*keep, text_col)
    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_count_batches(vocabulary, folder, leaf, keep, text_col), f"{ddl}, n_tokens bigint")
