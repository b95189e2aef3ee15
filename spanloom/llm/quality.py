"""Quality classifier: logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader updates.

Features of a text are counts of hashed n-grams over four readings of its words: the lower-cased words (n = 1, 2), their
shapes (which of letter cases, digits, symbols they hold; n = 1, 2, 3), the shape next to whether the word occurred before in
the text (n = 1, 2), and whether each two-word window occurred before (n = 1, 4).  Counts are scaled per reading to unit
length.  A text is then a sparse vector in ``2**bits`` dimensions and its score a sparse dot product.

Fitting takes a bounded sample of labelled rows (``max_rows``, the smallest by a hash of the id, so it is the same at every
run), splits it into shards, lets each shard run its own FTRL passes, and averages the shards' weights.  What reaches the
driver is at most ``2**bits`` weights.

Defined cases: null text is empty; an empty text has only the bias; null labels are not used; repeated rows are scored alike;
without labelled rows every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.words import docs_table, fold, ints, mix, one_text, restore_id, roll, source, text_pieces, words_of

_CLASS = np.full(256, 8, np.uint8)  # bits: lower 1, upper 2, digit 4, other ASCII 8, beyond ASCII 16
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 4, 16
_CLASS[[9, 10, 11, 12, 13, 32]] = 0


@dataclass
class FTRL:
    bits: int = 18
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.0005
    passes: int = 4
    shards: int = 8


def _seen_before(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether each key occurred earlier within its group."""
    full = mix(keys + (group.astype(np.uint64) + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D))
    first = np.unique(full, return_index=True)[1]
    seen = np.ones(len(keys), bool)
    seen[first] = False
    return seen


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR rows ``(ptr, index, value)``; index 0 is the bias with value 1."""
    w = words_of(data, offsets, lower=True)
    n, docs = len(w.hash), len(offsets) - 1
    dim = np.uint64((1 << bits) - 1)
    keys, rows, weight = [], [], []

    def add(stream: np.ndarray, doc: np.ndarray, n_gram: int, salt: int) -> None:
        k = len(stream) - n_gram + 1
        if k <= 0:
            return
        at = np.flatnonzero(doc[:k] == doc[n_gram - 1:])
        h = (roll(stream.astype(np.uint64) + np.uint64(salt), n_gram)[at] % dim) + np.uint64(1)
        cell, count = np.unique(doc[at].astype(np.uint64) << np.uint64(32) | h, return_counts=True)
        d = (cell >> np.uint64(32)).astype(np.int64)
        norm = np.sqrt(np.bincount(d, count.astype(float) ** 2, docs))
        keys.append(cell), rows.append(d), weight.append(count / norm[d])

    if n:
        cls = np.bitwise_or.reduceat(_CLASS[data], w.start).astype(np.uint64)
        shape = cls | _CLASS[data[w.start]].astype(np.uint64) << np.uint64(8) | _CLASS[data[w.end - 1]].astype(np.uint64) << np.uint64(16)
        again = _seen_before(w.hash, w.doc).astype(np.uint64)
        add(w.hash, w.doc, 1, 11), add(w.hash, w.doc, 2, 12)
        add(shape, w.doc, 1, 21), add(shape, w.doc, 2, 22), add(shape, w.doc, 3, 23)
        add(shape << np.uint64(1) | again, w.doc, 1, 31), add(shape << np.uint64(1) | again, w.doc, 2, 32)
        pair, at = w.windows(2)
        if len(pair):
            twice = _seen_before(pair, w.doc[at]).astype(np.uint64)
            add(twice, w.doc[at], 1, 41), add(twice, w.doc[at], 4, 44)
    row = np.concatenate([np.arange(docs), *rows])
    idx = np.concatenate([np.zeros(docs, np.int64), *[(k & np.uint64(0xFFFFFFFF)).astype(np.int64) for k in keys]])
    val = np.concatenate([np.ones(docs), *weight])
    order = np.argsort(row, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=docs))]), idx[order], val[order]


def ftrl_fit(examples: list[tuple[np.ndarray, np.ndarray, float]], cfg: FTRL) -> np.ndarray:
    """Weights after FTRL-proximal updates over ``(index, value, label)`` in the given order."""
    z, s = np.zeros(1 << cfg.bits), np.zeros(1 << cfg.bits)

    def weights(zi, si):
        return np.where(np.abs(zi) <= cfg.l1, 0.0, -(zi - np.sign(zi) * cfg.l1) / ((cfg.beta + np.sqrt(si)) / cfg.alpha + cfg.l2))

    for _ in range(cfg.passes):
        for idx, val, label in examples:
            zi, si = z[idx], s[idx]
            w = weights(zi, si)
            p = 1 / (1 + np.exp(-np.clip(w @ val, -35, 35)))
            g = (p - label) * val
            step = (np.sqrt(si + g * g) - np.sqrt(si)) / cfg.alpha
            # A hashed index may occur twice in a text through different readings; both updates count.
            np.add.at(z, idx, g - step * w)
            np.add.at(s, idx, g * g)
    return weights(z, s)


def fit(docs: DataFrame, labels: DataFrame, train_only, max_rows: int = 6000, cfg: FTRL | None = None) -> np.ndarray:
    """Weights from labelled rows of ``docs`` for which the Column ``train_only`` holds.

    ``docs`` has ``doc_id, text``; ``labels`` has ``doc_id, label``.  At most ``max_rows`` labelled ids are used, each
    with one text (``one_text``) and its largest label, however often they repeat.
    """
    cfg = cfg or FTRL()
    picked = (labels.where(train_only & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    sample = F.broadcast(picked)  # at most max_rows pairs of an id and a label
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(cfg.shards)).cast("int")
    rows = one_text(docs.join(sample.select("doc_id"), "doc_id")).join(sample, "doc_id").withColumn("shard", shard)

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(key=mix(frame.doc_id.to_numpy().astype(np.uint64))).sort_values(["key", "text"], na_position="first")
        examples = []
        for part, data, off in text_pieces([pa.RecordBatch.from_pandas(frame[["text", "label"]], preserve_index=False)]):
            ptr, idx, val = features(data, off, cfg.bits)
            y = ints(part, "label")
            examples += [(idx[a:b], val[a:b], float(y[i])) for i, (a, b) in enumerate(zip(ptr[:-1], ptr[1:]))]
        w = ftrl_fit(examples, cfg)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at, "w": w[at], "shard": frame.shard.iloc[0]})

    learned = rows.groupBy("shard").applyInPandas(learn, "at long, w double, shard int")
    out = np.zeros(1 << cfg.bits)
    table = learned.select("at", "w", "shard").toPandas()
    if len(table):
        np.add.at(out, table["at"].to_numpy(), table["w"].to_numpy() / table["shard"].nunique())
    return out


def score(docs: DataFrame, weights: np.ndarray, bits: int, extra: str = "") -> DataFrame:
    """``doc_id, score`` for every row; columns after ``text`` are passed on (their DDL in ``extra``)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    keep = [f for f in docs.columns if f != "text"]

    def run(batches):
        w = shared.value
        for rows, data, off in text_pieces(batches):
            ptr, idx, val = features(data, off, bits)
            margin = np.add.reduceat(w[idx] * val, ptr[:-1])
            p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(c)) for c in keep], pa.array(p)], [*keep, "score"])

    return docs.mapInArrow(run, f"doc_id long{extra}, score double")


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document with its score; rows whose crc32(doc_id as text) mod 4 is 2 are never learned from."""
    cfg = FTRL()
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    docs = source(docs_table(spark, sf_dir))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("label"))
    weights = fit(docs, labels, fold("doc_id", 4) != 2, cfg=cfg)
    scored = score(docs.withColumn("held_out", held), weights, cfg.bits, ", held_out boolean")
    return restore_id(scored).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
