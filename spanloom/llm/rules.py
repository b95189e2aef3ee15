"""Quality rules: base rules, then gradient-boosted trees over document statistics.

The trees are flat numpy node arrays (``trees.Forest``), scored over whole pieces at once.  The score may only fall as the
share of symbols, of words in repeated windows, of repeated lines or of the commonest word grows; the other features are free.

Defined cases: null text has no words; a text of fewer than ``min_words`` words fails the base rules; repeated rows are judged
alike; without labels the trees reject nothing (every text scores 0.5 or more); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import trees
from spanloom.llm.words import docs_table, mix, one_text, restore_id, source, text_pieces, words_of

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["log_words", "mean_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
          "space_share", "distinct_share", "top_word_share", "adjacent_share", "short_word_share", "symbol_word_share", "words_per_line"]
#: -1: more of it never raises the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "top_word_share": -1, "adjacent_share": -1, "symbol_word_share": -1}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = _SYMBOL.copy()
_MARK[list(b"!@^~=+{}[]\\/_")] = True


def _per_doc(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts of ``BASE`` and the features of ``RATIOS``, a row for each text."""
    docs = len(offsets) - 1
    w = words_of(data, offsets)
    n_words = np.diff(w.ptr)
    lead = (data & 0xC0) != 0x80  # first byte of each code point
    chars = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    size = chars[w.end] - chars[w.start]
    word_chars = np.bincount(w.doc, size, docs).astype(np.int64)
    n_symbols = _per_doc(_SYMBOL[data], offsets)
    # Lines with a word: a line is all bytes between newlines, compared whole.
    n = len(data)
    feed = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], feed + 1]))
    begin = begin[begin < n]
    stop = np.minimum(np.append(begin[1:], n), n)
    line_doc = np.searchsorted(offsets, begin, "right") - 1
    stop = np.where((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10), stop - 1, stop) if n else stop
    words_in = np.searchsorted(w.start, stop) - np.searchsorted(w.start, begin)
    full = np.flatnonzero(words_in > 0)
    line_doc, begin, stop = line_doc[full], begin[full], stop[full]
    line_hash = _range_hash(data, begin, stop)
    n_lines = np.bincount(line_doc, minlength=docs)
    first = np.unique(_keyed(line_hash, line_doc), return_index=True)[1]
    n_dup_lines = n_lines - np.bincount(line_doc[first], minlength=docs)
    # Words inside eight-word windows that the text holds twice or more.
    win, at = w.windows(8)
    cover = np.zeros(len(w.hash) + 1, np.int64)
    if len(win):
        _, inverse, count = np.unique(_keyed(win, w.doc[at]), return_inverse=True, return_counts=True)
        hit = at[count[inverse] > 1]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 8, -1)
    repeat = np.cumsum(cover[:-1]) > 0
    n_repeat = np.bincount(w.doc, repeat, docs).astype(np.int64)
    base = np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat], 1).astype(np.int64)

    nw, nc, nb = np.maximum(n_words, 1), np.maximum(word_chars, 1), np.maximum(np.diff(offsets), 1)
    if len(w.hash):
        cell, inverse, count = np.unique(_keyed(w.hash, w.doc), return_index=True, return_counts=True)
        cell_doc = w.doc[inverse]
        distinct = np.bincount(cell_doc, minlength=docs)
        top = np.zeros(docs)
        np.maximum.at(top, cell_doc, count)
        same = np.zeros(len(w.hash), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        adjacent = np.bincount(w.doc, same, docs)
        marked = np.bincount(w.doc, np.logical_or.reduceat(_MARK[data], w.start), docs)
    else:
        distinct = top = adjacent = marked = np.zeros(docs)
    short = np.bincount(w.doc, size <= 2, docs)
    upper = _per_doc((data >= 65) & (data <= 90), offsets)
    digit = _per_doc((data >= 48) & (data <= 57), offsets)
    ratio = np.stack([np.log1p(n_words), word_chars / nw, n_symbols / nc, n_dup_lines / np.maximum(n_lines, 1), n_repeat / nw, upper / nc,
                      digit / nc, 1 - word_chars / nb, distinct / nw, top / nw, adjacent / nw, short / nw, marked / nw,
                      n_words / np.maximum(n_lines, 1)], 1)
    return base, ratio


def _keyed(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(h + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D))


def _range_hash(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, white space included."""
    from spanloom.llm.words import _TABLE, _power
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[:len(data)], out=total[1:])
    return mix((total[stop] - total[begin]) * inverse[begin] + (stop - begin).astype(np.uint64))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` with the counts of ``BASE`` (long) and the features of ``RATIOS`` (one array of double)."""
    def run(batches):
        for rows, data, off in text_pieces(batches):
            base, ratio = statistics(data, off)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ratio) + 1) * len(RATIOS), pa.int32()), pa.array(ratio.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), *[pa.array(base[:, i]) for i in range(5)], flat], ["doc_id", *BASE, "features"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", features array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, **options) -> trees.Forest:
    """A forest from at most ``max_rows`` labelled ids, those smallest by a hash, each with one text (``one_text``)."""
    picked = (labels.where(F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    sample = measure(one_text(docs.join(F.broadcast(picked.select("doc_id")), "doc_id")))  # at most max_rows ids
    table = sample.join(F.broadcast(picked), "doc_id").select("doc_id", "features", "label").toPandas().sort_values("doc_id")
    x = np.array(table.features.tolist(), float).reshape(len(table), len(RATIOS))
    return trees.train(x, table.label.to_numpy(float), monotone=[MONOTONE.get(f, 0) for f in RATIOS], **options)


def base_failed(min_words: int = 20, max_repeat: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def judge(docs: DataFrame, forest: trees.Forest, least: float = 0.5) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``score`` and ``kept`` for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # some thousand nodes, whatever the input

    def run(batches):
        for rows in batches:
            x = np.asarray(rows.column(6).flatten()).reshape(-1, len(RATIOS))
            score = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([*[rows.column(i) for i in range(6)], pa.array(score)], ["doc_id", *BASE, "score"])

    scored = measure(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", score double")
    failed = base_failed()
    return scored.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("score") >= least)).alias("kept"), "score")


def accepted(docs: DataFrame, forest: trees.Forest, least: float = 0.5, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the base rules and the trees keep; one pass and no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for rows, data, off in text_pieces(batches):
            base, ratio = statistics(data, off)
            failed = (base[:, 0] < min_words) | (100 * base[:, 4] > max_repeat * base[:, 0])
            yield rows.filter(pa.array(~failed & (shared.value.score(ratio) >= least)))
    return docs.mapInArrow(run, docs.schema)


def quality_labels(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("label"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = source(docs_table(spark, sf_dir))
    return restore_id(judge(docs, fit(docs, quality_labels(spark, sf_dir))))
