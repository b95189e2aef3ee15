"""Substring dedup: removal of word windows that occur earlier, found by compressed FM-indexes over content shards.

A window is ``window`` consecutive words of one document; it is removed if the same words also start earlier (smaller id, or
same document and earlier start).

An FM-index answers for the texts of its shard only, so texts are cut into shards by content, not by document: every window
has a minimizer (its smallest hash of ``GRAM`` words, the leftmost of equals), the windows that share one place of it form a
segment, and segments go to the shard of their minimizer.  Equal windows have equal minimizers, so all their occurrences meet
in one shard, and every segment is searched in one index only; the work grows with the text, not with documents times shards.

1. Each task sends (minimizer, content hash, place) of its segments.  Segments whose minimizer occurs once cannot repeat and
   end here.  Of segments with equal content only the earliest goes on; the others are removed whole.  Equal segments are
   first combined in the task that reads them, so a passage in a third of all documents sends one row a task.
2. The shards' remaining segments, of different content but one minimizer, are concatenated and indexed: suffix order,
   Burrows-Wheeler transform, wavelet matrix with packed bits.  The segments are streamed through backward search, all in step;
   at ``window`` words the match is shortened by its last word before it is extended.  What comes out are matching statistics
   capped at ``window`` and, for each window, the suffix interval with its earliest occurrence.
3. A minimizer with more than ``HOT`` different segments is dealt out window by window: an aggregate by the hash of the window,
   combined before its shuffle, finds the earliest place of each, and all others are removed.  No index holds them.

Defined cases: null text has no words; repeated rows (one id, one text) are one document, with a row each; a null id is the
largest id; texts shorter than a window lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.words import Words, _power, docs_table, ints, mix, restore_id, roll, source, text_pieces, words_of
from spanloom.session import materialise

WINDOW, GRAM = 20, 5
HOT = 4096
#: Words an index holds on average.
SHARD_WORDS = 400_000

_SEGMENT = np.dtype([("key", "<u8"), ("content", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("n", "<u4")])
_ASK = np.dtype([("key", "<u8"), ("start", "<u4"), ("n", "<u2"), ("kind", "<u2")])
_CUT = np.dtype([("start", "<u4"), ("n", "<u4")])
REMOVE, INDEX, SINGLY = 0, 1, 2


class WaveletMatrix:
    """Rank queries over a sequence of symbols below ``sigma``, bits packed in 64-bit words."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = []
        self.depth = max(1, int(sigma - 1).bit_length())
        self.n = len(seq)
        head = np.zeros(sigma, np.int64)  # where each symbol's block begins after all levels
        symbols = np.arange(sigma)
        for level in range(self.depth - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            ahead = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            zeros = self.n - int(bit.sum())
            self.levels.append((level, packed, ahead, zeros))
            one = self._ones(packed, ahead, head)
            head = np.where(symbols >> level & 1, zeros + one, head - one)
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.head = head

    @staticmethod
    def _ones(packed, ahead, i):
        w = i >> 6
        return ahead[w] + np.bitwise_count(packed[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``c`` occurs before position ``i``."""
        for level, packed, ahead, zeros in self.levels:
            one = self._ones(packed, ahead, i)
            i = np.where(c >> level & 1, zeros + one, i - one)
        return i - self.head[c]


def _ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by the first ``depth`` symbols or more, and the ranks by the first ``depth`` / 2 (a power of two)."""
    n = len(text)
    rank, half, width = text.astype(np.int64), None, 1
    while width < depth:
        half = rank
        after = np.zeros(n, np.int64)
        after[:-width or None] = rank[width:] + 1 if width < n else after[:0]
        pair = rank * (int(rank.max()) + 2) + after
        order = np.argsort(pair, kind="stable")
        new = np.ones(n, bool)
        new[1:] = pair[order[1:]] != pair[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        width *= 2
    return order, half


class FMIndex:
    """Index of segments of symbols; suffixes are in order by their first 32 symbols, enough for windows up to that."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, order: np.ndarray, window: int):
        """``order`` ranks every word's place; of equal windows, the one of least rank is the earliest."""
        self.window = window
        symbols, code = np.unique(words, return_inverse=True)
        ends = np.cumsum(lengths)
        self.text = np.insert(code + 1, ends, 0)          # a separator after each segment
        self.at = np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)
        n, sigma = len(self.text), len(symbols) + 1
        suffix, half = _ranks(self.text, 32)
        bwt = self.text[suffix - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=sigma))])[:-1]
        self.tree = WaveletMatrix(bwt, sigma)
        self.lo1, self.hi1, _ = self._classes(suffix, half, window - 1)
        place = np.full(n, np.iinfo(np.int64).max)
        place[self.at] = order
        _, _, begin = self._classes(suffix, half, window)
        least = np.minimum.reduceat(place[suffix], begin)
        self.earliest = np.repeat(least, np.diff(np.append(begin, n)))

    @staticmethod
    def _classes(suffix, half, depth):
        """First and end of the interval of suffixes that share ``depth`` (16 to 32) symbols, for each place in suffix order."""
        n = len(suffix)
        tail = np.full(n + 16, -1, np.int64)
        tail[:n] = half
        a, b = half[suffix], tail[suffix + (depth - 16)]
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, n))
        return np.repeat(begin, size), np.repeat(begin + size, size), begin

    def search(self, code: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of ``code[begin:begin+length]``; empty ones if the index does not hold it."""
        lo, hi = np.zeros(len(begin), np.int64), np.full(len(begin), len(self.text))
        for k in range(int(length.max(initial=0)) - 1, -1, -1):
            on = np.flatnonzero(length > k)
            c = code[begin[on] + k]
            lo[on], hi[on] = self.before[c] + self.tree.rank(c, lo[on]), np.where(c == 0, 0, self.before[c] + self.tree.rank(c, hi[on]))
        return lo, np.maximum(hi, 0)

    def stream(self, code: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Earliest place of the window that starts at each word of the streamed segments; the largest value if there is none.

        ``code`` holds symbols of the index (0 for words it does not hold), segment after segment.
        """
        out = np.full(len(code), np.iinfo(np.int64).max)
        longest = np.argsort(-lengths, kind="stable")
        last = (np.cumsum(lengths) - 1)[longest]
        size = lengths[longest]
        lo, hi, have = np.zeros(len(size), np.int64), np.full(len(size), len(self.text)), np.zeros(len(size), np.int64)
        for t in range(int(size.max(initial=0))):
            k = int(np.searchsorted(-size, -t, "left"))  # segments longer than t
            pos = last[:k] - t
            c = code[pos]
            full = have[:k] == self.window
            l = np.where(full, self.lo1[np.minimum(lo[:k], len(self.text) - 1)], lo[:k])
            h = np.where(full, self.hi1[np.maximum(hi[:k] - 1, 0)], hi[:k])
            n = have[:k] - full
            l, h = self.before[c] + self.tree.rank(c, l), self.before[c] + self.tree.rank(c, h)
            n += 1
            lost = np.flatnonzero((h <= l) | (c == 0))
            if len(lost):  # only words from elsewhere: the longest match that begins here, by bisection
                least, most = np.zeros(len(lost), np.int64), n[lost] - 1
                while (most > least).any():
                    mid = (least + most + 1) // 2
                    x, y = self.search(code, pos[lost], mid)
                    least, most = np.where(y > x, mid, least), np.where(y > x, most, mid - 1)
                l[lost], h[lost] = self.search(code, pos[lost], least)
                n[lost] = least
            lo[:k], hi[:k], have[:k] = l, h, n
            found = np.flatnonzero(have[:k] == self.window)
            out[pos[found]] = self.earliest[lo[found]]
        return out


def _sums(values: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of ranges of ``values``."""
    power, inverse = _power(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:len(values)], out=total[1:])
    return mix((total[stop] - total[begin]) * inverse[begin] + (stop - begin).astype(np.uint64))


def segments(w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first word, number of words, minimizer, content hash)`` of the segments of all texts."""
    n = len(w.hash)
    none = np.empty(0, np.int64)
    if n < window:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    g = roll(w.hash, gram)
    span = window - gram + 1  # grams in a window: 16
    best, width = np.arange(len(g)), 1
    while 2 * width <= span:
        a, b = best[:-width], best[width:]
        best, width = np.where(g[b] < g[a], b, a), 2 * width
    if width < span:
        a, b = best[:len(g) - span + 1], best[span - width:]
        best = np.where(g[b] < g[a], b, a)
    at = np.flatnonzero(w.doc[:n - window + 1] == w.doc[window - 1:])
    place = best[at]
    new = np.ones(len(at), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    begin = at[first]
    stop = at[np.append(first[1:], len(at))[:len(first)] - 1] + window if len(first) else none
    return begin, stop - begin, g[place[first]], _sums(w.hash, begin, stop) if len(first) else none.astype(np.uint64)


def _pack(shard: np.ndarray, columns: dict[str, np.ndarray], extra: dict[str, bytes]):
    """One row a shard with the packed rows of that shard."""
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    begin = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.empty(0, np.int64)
    stop = np.append(begin[1:], len(s))
    rows = {"shard": s[begin].astype(np.int64)}
    for name, col in columns.items():
        col = col[order]
        rows[name] = [col[a:b].tobytes() for a, b in zip(begin, stop)]
    for name, value in extra.items():
        rows[name] = [value] * len(begin)
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "shard" else pa.binary()) for k, v in rows.items()})


def _by_doc(ids: np.ndarray, keys: np.ndarray, rows: np.ndarray, name: str) -> pd.DataFrame:
    order = np.lexsort((keys, ids))
    ids, keys, rows = ids[order], keys[order], rows[order]
    begin = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))) if len(ids) else np.empty(0, np.int64)
    stop = np.append(begin[1:], len(ids))
    return pd.DataFrame({"doc_id": ids[begin], "text_key": keys[begin], name: [rows[a:b].tobytes() for a, b in zip(begin, stop)]})


def asked(docs: DataFrame, shards: int) -> DataFrame:
    """``doc_id, text_key, ask``: for each document, its segments to remove or to index (step 1)."""
    def send(batches):
        for rows, data, off in text_pieces(batches):
            w = words_of(data, off)
            begin, n, key, content = segments(w)
            if not len(begin):
                continue
            seg = np.empty(len(begin), _SEGMENT)
            doc = w.doc[begin]
            seg["key"], seg["content"], seg["doc"], seg["start"], seg["n"] = key, content, doc, begin - w.ptr[doc], n
            ids, keys = ints(rows, "doc_id"), ints(rows, "text_key")
            # Equal segments of this piece: the earliest speaks for all; the others are certain to go.
            order = np.lexsort((seg["start"], ids[seg["doc"]], content))
            seg = seg[order]
            same = np.zeros(len(seg), bool)
            same[1:] = (seg["content"][1:] == seg["content"][:-1])
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(seg))))
            later = same & ((ids[seg["doc"]] != ids[seg["doc"][lead]]) | (seg["start"] != seg["start"][lead]))
            seg["n"] |= later.astype(np.uint32) << np.uint32(31)
            yield _pack(mix(seg["key"]) % np.uint64(shards), {"seg": seg}, {"ids": ids.astype("<i8").tobytes(), "keys": keys.astype("<i8").tobytes()})

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(b, _SEGMENT) for b in frame.seg]
        seg = np.concatenate(parts)
        ids = np.concatenate([np.frombuffer(i, "<i8")[p["doc"]] for i, p in zip(frame["ids"], parts)])
        keys = np.concatenate([np.frombuffer(k, "<i8")[p["doc"]] for k, p in zip(frame["keys"], parts)])
        gone = seg["n"] >> np.uint32(31) == 1
        size = seg["n"] & np.uint32(0x7FFFFFFF)
        key, content, start = seg["key"], seg["content"], seg["start"]
        order = np.lexsort((start, ids, content, key))
        ids, keys, gone, size, key, content, start = (x[order] for x in (ids, keys, gone, size, key, content, start))
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key | np.append(True, content[1:] != content[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        gone |= (ids != ids[lead]) | (start != start[lead])
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))[np.cumsum(new_key) - 1]  # different segments of the minimizer
        use = gone | (kinds > 1)
        ask = np.empty(int(use.sum()), _ASK)
        ask["key"], ask["start"], ask["n"] = key[use], start[use], size[use]
        ask["kind"] = np.where(gone[use], REMOVE, np.where(kinds[use] > HOT, SINGLY, INDEX))
        return _by_doc(ids[use], keys[use], ask, "ask")

    sent = docs.select("doc_id", "text_key", "text").mapInArrow(send, "shard long, seg binary, ids binary, keys binary")
    return sent.groupBy("shard").applyInPandas(judge, "doc_id long, text_key long, ask binary")


def repeats(loaded: DataFrame, shards: int) -> DataFrame:
    """``doc_id, text_key, cut``: repeated windows that the shards' indexes find (step 2).  ``loaded`` has ``asks`` and texts."""
    def send(batches):
        for rows, data, off in text_pieces(batches):
            w = words_of(data, off)
            ids, keys = ints(rows, "doc_id"), ints(rows, "text_key")
            short = (w.hash >> np.uint64(32)).astype("<u4")
            begin, length, key = [], [], []
            for d, asks in enumerate(rows.column(rows.schema.get_field_index("asks")).to_pylist()):
                a = np.frombuffer(b"".join(asks), _ASK)
                whole = a[a["kind"] == INDEX]
                begin.append(whole["start"].astype(np.int64) + w.ptr[d]), length.append(whole["n"].astype(np.int64)), key.append(whole["key"])
            begin, length, key = np.concatenate(begin), np.concatenate(length), np.concatenate(key)
            shard = mix(key + np.uint64(1)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            begin, length, shard = begin[order], length[order], shard[order]
            doc = w.doc[begin] if len(begin) else begin
            place = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
            packed = short[place]
            word_at = np.concatenate([[0], np.cumsum(length)])
            edge = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.empty(0, np.int64)
            for a, b in zip(edge, np.append(edge[1:], len(shard))):
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([int(shard[a])], pa.int64()), "words": pa.array([packed[word_at[a]:word_at[b]].tobytes()]),
                    "length": pa.array([length[a:b].astype("<u4").tobytes()]), "ids": pa.array([ids[doc[a:b]].astype("<i8").tobytes()]),
                    "keys": pa.array([keys[doc[a:b]].astype("<i8").tobytes()]), "start": pa.array([(begin[a:b] - w.ptr[doc[a:b]]).astype("<u4").tobytes()])})

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        words, length, ids, keys, start = (np.concatenate([np.frombuffer(b, t) for b in frame[c]]) for c, t in (
            ("words", "<u4"), ("length", "<u4"), ("ids", "<i8"), ("keys", "<i8"), ("start", "<u4")))
        length, start = length.astype(np.int64), start.astype(np.int64)
        seg = np.repeat(np.arange(len(length)), length)
        at = np.arange(len(words)) - np.repeat(np.cumsum(length) - length, length) + start[seg]
        place = _order(ids[seg], at)
        index = FMIndex(words, length, place, WINDOW)
        earliest = index.stream(index.text[index.at], length)
        hit = np.flatnonzero(earliest < place)
        cut = np.empty(len(hit), _CUT)
        cut["start"], cut["n"] = at[hit], WINDOW
        return _by_doc(ids[seg[hit]], keys[seg[hit]], cut, "cut")

    need = loaded.where("n_index > 0").select("doc_id", "text_key", "text", "asks")
    sent = need.mapInArrow(send, "shard long, words binary, length binary, ids binary, keys binary, start binary")
    return sent.groupBy("shard").applyInPandas(search, "doc_id long, text_key long, cut binary")


def single_repeats(loaded: DataFrame) -> DataFrame:
    """``doc_id, text_key, cut``: repeated windows of the minimizers with very many segments (step 3)."""
    def send(batches):
        for rows, data, off in text_pieces(batches):
            w = words_of(data, off)
            at = [np.empty(0, np.int64)]
            for d, asks in enumerate(rows.column(rows.schema.get_field_index("asks")).to_pylist()):
                a = np.frombuffer(b"".join(asks), _ASK)
                single = a[a["kind"] == SINGLY]
                count = single["n"].astype(np.int64) - WINDOW + 1
                at.append(w.ptr[d] + np.repeat(single["start"].astype(np.int64), count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)))
            at = np.concatenate(at)
            doc = w.doc[at]
            yield pa.RecordBatch.from_arrays([pa.array(ints(rows, "doc_id")[doc]), pa.array(ints(rows, "text_key")[doc]), pa.array(at - w.ptr[doc]), pa.array(_sums(w.hash, at, at + WINDOW).view(np.int64))],
                                             ["doc_id", "text_key", "start", "window"])

    def pack(batches):
        for b in batches:
            cuts = []
            for starts in b.column(2).to_pylist():
                cut = np.empty(len(starts), _CUT)
                cut["start"], cut["n"] = starts, WINDOW
                cuts.append(cut.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cuts, pa.binary())], ["doc_id", "text_key", "cut"])

    need = loaded.where("n_single > 0").select("doc_id", "text_key", "text", "asks")
    windows = materialise(need.mapInArrow(send, "doc_id long, text_key long, start long, window long"), "windows")
    first = windows.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("times")).where("times > 1").select("window", "first")
    later = windows.join(first, "window").where(F.struct("doc_id", "start") != F.col("first"))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("starts")).mapInArrow(pack, "doc_id long, text_key long, cut binary")


def _order(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Dense rank of (id, word place); equal places have equal ranks."""
    order = np.lexsort((at, ids))
    new = np.append(False, (ids[order[1:]] != ids[order[:-1]]) | (at[order[1:]] != at[order[:-1]]))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept``, the remaining text) for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.withColumns({"text": F.coalesce("text", F.lit("")), "text_key": F.xxhash64(F.coalesce("text", F.lit("")))})
    per_doc = asked(docs, int(spark.conf.get("spark.sql.shuffle.partitions"))).groupBy("doc_id", "text_key").agg(F.collect_list("ask").alias("asks"))
    loaded = docs.join(per_doc, ["doc_id", "text_key"], "left")

    def weigh(batches):
        for rows, data, off in text_pieces(batches):
            asks = [np.frombuffer(b"".join(a or []), _ASK) for a in rows.column(3).to_pylist()]
            untouched = np.array([len(a) == 0 for a in asks])
            w = words_of(data, off)
            raw = data.tobytes()
            lines = [b" ".join([raw[s:e] for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist())]) if u else None for a, b, u in zip(w.ptr[:-1], w.ptr[1:], untouched)]
            n_index, n_single = ([int(a["n"][a["kind"] == kind].sum()) for a in asks] for kind in (INDEX, SINGLY))
            yield pa.RecordBatch.from_arrays([
                rows.column(0), rows.column(1), pa.array([None if u and not keep_text else t for u, t in zip(untouched, rows.column(2).to_pylist())], pa.string()), rows.column(3),
                pa.array(np.diff(w.ptr)), pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in lines], pa.string()), pa.array(n_index, pa.int64()), pa.array(n_single, pa.int64())],
                ["doc_id", "text_key", "text", "asks", "n_words", "sha", "n_index", "n_single"])

    ddl = "doc_id long, text_key long, text string, asks array<binary>, n_words long, sha string, n_index long, n_single long"
    loaded = materialise(loaded.select("doc_id", "text_key", "text", "asks").mapInArrow(weigh, ddl), "repeats")
    total = loaded.agg(F.coalesce(F.sum("n_index"), F.lit(0))).first()[0]
    found = repeats(loaded, max(1, -(-total // SHARD_WORDS))).unionByName(single_repeats(loaded)).groupBy("doc_id", "text_key").agg(F.collect_list("cut").alias("cuts"))
    touched = loaded.where("asks is not null").join(found, ["doc_id", "text_key"], "left")

    def finish(batches):
        for rows, data, off in text_pieces(batches):
            w = words_of(data, off)
            asks, cuts = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("asks", "cuts"))
            edge = np.zeros(len(w.hash) + 1, np.int64)
            for d, (a, c) in enumerate(zip(asks, cuts)):
                a = np.frombuffer(b"".join(a or []), _ASK)
                a = a[a["kind"] == REMOVE]
                c = np.frombuffer(b"".join(c or []), _CUT)
                begin = np.concatenate([a["start"], c["start"]]).astype(np.int64) + w.ptr[d]
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + np.concatenate([a["n"], c["n"]]).astype(np.int64), -1)
            stay = np.cumsum(edge[:-1]) == 0
            raw = data.tobytes()
            n_stay = np.bincount(w.doc, stay, len(off) - 1).astype(np.int64)
            kept = []
            for x, y in zip(w.ptr[:-1], w.ptr[1:]):
                at = x + np.flatnonzero(stay[x:y])
                kept.append(b" ".join([raw[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist())]))
            out = [rows.column(0), pa.array(np.diff(w.ptr)), pa.array(np.diff(w.ptr) - n_stay), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(out + ([pa.array([k.decode() for k in kept])] if keep_text else []), names + ["kept"] * keep_text)

    done = touched.select("doc_id", "text", "asks", "cuts").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
    rest = loaded.where("asks is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), *([F.col("text").alias("kept")] if keep_text else []))
    return done.unionByName(rest)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return restore_id(remove_repeats(source(docs_table(spark, sf_dir))))
