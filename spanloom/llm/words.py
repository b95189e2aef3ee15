"""Vectorised word handling shared by the text operators.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D`` within one text.  Texts are taken straight from the
Arrow buffers, a few megabytes at a time, so memory does not depend on how many rows an Arrow batch holds; one very long text
is one piece.  Words and word windows are known by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once.
PIECE = 1 << 21
#: Stands for a null ``doc_id`` inside the operators: the largest id, turned back into null in every result.
NULL_ID = (1 << 63) - 1

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = _U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = np.asarray(x, dtype=_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_TABLE_LOWER = _TABLE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for positions below ``n``."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 64)
        pair = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, _U)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        if n > PIECE + 64:
            return pair[0], pair[1]
        _powers[:] = pair
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of several texts: byte ranges, hashes, and for text ``d`` the words ``ptr[d]:ptr[d+1]``."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    ptr: np.ndarray

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words that lie in one text, and the index of each run's first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, _U), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        return roll(self.hash, k)[at], at


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values, by doubling."""
    n = len(h) - k + 1
    have, size, power = None, 0, 1
    block, width, step = h, 1, int(_STEP)
    while k:
        if k & 1:
            have = block[:n].copy() if have is None else have * _U(pow(int(_STEP), width, 1 << 64)) + block[size:size + n]
            size += width
        k >>= 1
        if k:
            block = block[:-width] * _U(step) + block[width:] if len(block) > width else block[:0]
            width, step = 2 * width, step * step % (1 << 64)
    return mix(have)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i+1]]`` (UTF-8)."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    space = _SPACE[data]
    word = ~space
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    start = np.flatnonzero(word & (before | edge[:n]))
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum((_TABLE_LOWER if lower else _TABLE)[data] * power[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U))
    ptr = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(ptr))
    return Words(start, end, h, doc, ptr)


def text_pieces(batches, column: str = "text", limit: int = PIECE):
    """Yield ``(rows, data, offsets)``: slices of the Arrow batches of about ``limit`` text bytes, whole texts each.

    Null texts come out empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
        off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, 8 * arr.offset)
        data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
        lo = 0
        while lo < len(arr):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            lo = hi


def ints(rows, column: str) -> np.ndarray:
    return rows.column(rows.schema.get_field_index(column)).to_numpy(zero_copy_only=False)


def source(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **extra: Column) -> DataFrame:
    """Only the columns needed, under fixed names, so other columns of whatever name do not matter."""
    key = F.coalesce(df[id_col].cast("long"), F.lit(NULL_ID))
    return df.select(key.alias("doc_id"), df[text_col].cast("string").alias("text"), *[c.alias(n) for n, c in extra.items()])


def restore_id(df: DataFrame, *names: str) -> DataFrame:
    """Null ids are null again."""
    return df.withColumns({n: F.nullif(F.col(n), F.lit(NULL_ID)) for n in names or ("doc_id",)})


def apart(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until ``df`` has no such column (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def one_text(rows: DataFrame) -> DataFrame:
    """``doc_id, text``: of each id the text with the smallest hash, so that a bound on ids bounds the rows."""
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.nullif(F.col(column), F.lit(NULL_ID)).cast("string").cast("binary")) % modulus


def docs_table(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
