"""Benchmark decontamination by SimHash of item-sized windows.

An item is a benchmark text as lower-cased words and its weighted five-word shingles (weight: how often the shingle occurs;
fewer words are one shingle).  Every window of a document that has as many words as some item is a candidate place; for items
of more words than the whole document, the document is the one window.  Windows
and items get 64-bit SimHash fingerprints over their weighted shingles; a multi-index over eight 8-bit blocks returns all
items within ``radius`` bits (two fingerprints within r bits agree up to r // 8 bits in at least one block), and the exact
weighted Jaccard similarity of the shingles decides.  A document that is shorter than an item needs no fingerprint: its
shingles are counted among those of all longer items, which gives the similarity itself.

A window that can reach the similarity ``least`` has at least that share of its shingles among the item's, so windows with
fewer shingles known from any item are passed over before fingerprinting; no result depends on this.

Items are taken in blocks of bounded number and length (a block is what a task holds), each block against all documents.

Defined cases: null or empty texts and items match nothing; repeated rows are judged alike; an empty benchmark or table gives
no matches; a document shorter than an item is compared whole (``n_words`` is then the document's number of words).
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.words import NULL_ID, docs_table, mix, restore_id, roll, source, text_pieces, words_of

SHINGLE = 5
_BITS = np.arange(64, dtype=np.uint64)
_NEAR = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes; a repeated shingle weighs as often as it occurs."""
    out = np.zeros(len(shingles), np.uint64)
    step = max(1, (1 << 20) // max(1, shingles.shape[1]))
    for lo in range(0, len(shingles), step):
        part = shingles[lo:lo + step]
        for b in _BITS:
            ones = ((part >> b) & np.uint64(1)).sum(1, dtype=np.int64)
            out[lo:lo + step] |= (2 * ones > part.shape[1]).astype(np.uint64) << b
    return out


def numbered(row: np.ndarray) -> np.ndarray:
    """Distinct keys for the shingles of one row, so that a repeated shingle counts as often as it occurs."""
    row = np.sort(row)
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    nth = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    return np.sort(mix(row + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


class Index:
    """Items of a block by their number of words."""

    def __init__(self, items: list[tuple[int, str]], radius: int):
        self.radius = radius
        by_size, known = defaultdict(list), defaultdict(list)
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            h = words_of(raw, np.array([0, len(raw)]), lower=True).hash
            if len(h):
                k = min(SHINGLE, len(h))
                s = roll(h, k)
                by_size[len(h)].append((item_id, s))
                known[k].append(s)
        self.known = {k: np.unique(np.concatenate(v)) for k, v in known.items()}
        self.sizes = {}
        for n, found in by_size.items():
            prints = fingerprint(np.stack([s for _, s in found]))
            blocks = prints.view(np.uint8).reshape(-1, 8)
            near = [_NEAR[:, blocks[:, j]] <= radius // 8 for j in range(8)]
            self.sizes[n] = ([i for i, _ in found], prints, near, [numbered(s) for _, s in found])
        # Keys of all items with full shingles, each with its item: for texts of fewer words than the item.
        long = [(n, i, keys) for n, (ids, _, _, own) in self.sizes.items() if n > SHINGLE for i, keys in zip(ids, own)]
        self.long_ids, self.long_n = [i for _, i, _ in long], np.array([n for n, _, _ in long], np.int64)
        key = np.concatenate([np.empty(0, np.uint64), *[keys for _, _, keys in long]])
        order = np.argsort(key, kind="stable")
        self.long_key, self.long_item = key[order], np.repeat(np.arange(len(long)), self.long_n - SHINGLE + 1)[order]

    def within(self, n: int, prints: np.ndarray):
        """Pairs (window, item of n words) whose fingerprints differ in at most ``radius`` bits."""
        _, own, near, _ = self.sizes[n]
        step = max(1, (1 << 22) // max(1, len(own)))
        for lo in range(0, len(prints), step):
            part = prints[lo:lo + step]
            blocks = np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8)
            hit = near[0][blocks[:, 0]].copy()
            for j in range(1, 8):
                hit |= near[j][blocks[:, j]]
            a, b = np.nonzero(hit)
            ok = np.bitwise_count(part[a] ^ own[b]) <= self.radius
            yield from zip((a[ok] + lo).tolist(), b[ok].tolist())

    def longer(self, n: int, keys: np.ndarray, least: float) -> list[tuple[int, float]]:
        """Items of more than ``n`` words, and their similarity to a text of ``n`` words with these numbered shingles."""
        lo, hi = np.searchsorted(self.long_key, keys, "left"), np.searchsorted(self.long_key, keys, "right")
        both = np.zeros(len(self.long_ids), np.int64)
        for a, b in zip(lo.tolist(), hi.tolist()):
            both[self.long_item[a:b]] += 1  # a key occurs once in an item
        sim = both / (len(keys) + self.long_n - SHINGLE + 1 - both)
        return [(self.long_ids[i], float(sim[i])) for i in np.flatnonzero((self.long_n > n) & (sim >= least))]


def _member(known: np.ndarray, filter_bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash is among the sorted ``known``; a small bit table answers most of the time."""
    out = filter_bits[(h >> np.uint64(44)).astype(np.int64)]
    at = np.flatnonzero(out)
    pos = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
    out[at] = known[pos] == h[at]
    return out


def find(data: np.ndarray, offsets: np.ndarray, index: Index, least: float) -> list[tuple[int, int, int, int, float, int]]:
    """``(text, item_id, start_word, n_words, similarity, n_windows)`` for each matching pair, at its best window."""
    w = words_of(data, offsets, lower=True)
    best: dict[tuple[int, int, int], tuple[float, int]] = {}
    count: dict[tuple[int, int, int], int] = defaultdict(int)
    state = {}
    for k, known in index.known.items():
        if len(w.hash) < k:
            continue
        bits = np.zeros(1 << 20, bool)
        bits[(known >> np.uint64(44)).astype(np.int64)] = True
        s = roll(w.hash, k)
        hit = _member(known, bits, s) & (w.doc[:len(s)] == w.doc[k - 1:])
        if hit.any():
            state[k] = (s, np.concatenate([[0], np.cumsum(hit)]))
    for n, (ids, _, _, keys) in index.sizes.items():
        k = min(SHINGLE, n)
        m = n - k + 1
        if k not in state or len(w.hash) < n:
            continue
        s, total = state[k]
        begin = np.flatnonzero(total[m:] - total[:-m] >= least * m - 1e-9)
        begin = begin[w.doc[begin] == w.doc[begin + n - 1]]
        if not len(begin):
            continue
        for lo in range(0, len(begin), 1 << 14):
            part = begin[lo:lo + (1 << 14)]
            shingles = np.lib.stride_tricks.sliding_window_view(s, m)[part]
            for a, b in index.within(n, fingerprint(shingles)):
                own = numbered(shingles[a])
                both = int(np.isin(own, keys[b], assume_unique=True).sum())
                sim = both / (2 * m - both)
                if sim >= least:
                    at = int(part[a])
                    key = (int(w.doc[at]), ids[b], n)
                    count[key] += 1
                    if key not in best or sim > best[key][0]:
                        best[key] = (sim, at - int(w.ptr[w.doc[at]]))
    if SHINGLE in state and len(index.long_n):
        s, total = state[SHINGLE]
        size = np.diff(w.ptr)
        m = size - SHINGLE + 1
        short = np.flatnonzero((m > 0) & (size < index.long_n.max()))
        known = total[w.ptr[short] + m[short]] - total[w.ptr[short]]
        for d in short[known >= least * m[short] - 1e-9].tolist():
            for item, sim in index.longer(int(size[d]), numbered(s[w.ptr[d]:w.ptr[d] + m[d]]), least):
                key = (d, item, int(size[d]))
                count[key] = max(count[key], 1)
                if key not in best or sim > best[key][0]:
                    best[key] = (sim, 0)
    return [(d, item, at, n, sim, count[d, item, n]) for (d, item, n), (sim, at) in sorted(best.items(), key=lambda x: x[0])]


def item_blocks(benchmark: DataFrame, block: int, chars: int = 1 << 25):
    """Items as lists of at most ``block`` items and ``chars`` characters (a longer item is a list of its own), fetched a part at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NULL_ID)).alias("item_id"), F.col("text").cast("string").alias("text"))
    part, size = [], 0
    for item_id, text in rows.where("text is not null").toLocalIterator():
        if part and (len(part) == block or size + len(text) > chars):
            yield part
            part, size = [], 0
        part.append((item_id, text))
        size += len(text)
    if part:
        yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 22, block: int = 20000) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, similarity, n_windows``: a row for each document and item that match."""
    ddl = "doc_id long, item_id long, start_word long, n_words long, similarity double, n_windows long"
    out = docs.sparkSession.createDataFrame([], ddl)
    for items in item_blocks(benchmark, block):
        index = docs.sparkSession.sparkContext.broadcast(Index(items, radius))  # bounded by ``item_blocks``

        def run(batches, index=index):
            for rows, data, off in text_pieces(batches):
                found = find(data, off, index.value, least)
                if found:
                    d, item, at, n, sim, count = zip(*found)
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(d)), *[pa.array(c, pa.int64()) for c in (item, at, n)], pa.array(sim, pa.float64()),
                                                      pa.array(count, pa.int64())], ["doc_id", "item_id", "start_word", "n_words", "similarity", "n_windows"])
        out = out.union(docs.select("doc_id", "text").mapInArrow(run, ddl))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 22, block: int = 20000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that match no item; one pass a block of items and no shuffle."""
    for items in item_blocks(benchmark, block):
        index = docs.sparkSession.sparkContext.broadcast(Index(items, radius))

        def run(batches, index=index):
            for rows, data, off in text_pieces(batches):
                keep = np.ones(rows.num_rows, bool)
                keep[[f[0] for f in find(data, off, index.value, least)]] = False
                yield rows.filter(pa.array(keep))
        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Matching documents only, with the item and the place of the best window."""
    return restore_id(contaminated(source(docs_table(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "doc_id", "item_id")
