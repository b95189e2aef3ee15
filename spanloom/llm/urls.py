"""URL filter: explicit host and path rules, then gradient-boosted trees on lexical features of the URL.

The URLs a rule decides are the labelled ones: block is 1, allow 0.  Their distinct URLs fall into three folds by a hash of the
host: one gives the bucket statistics, one fits the trees, and one, of hosts the trees never saw, gives the threshold and the
measure of the whole (``Model.caught``, ``Model.wrong``).  All URLs of a fold count (``trees.train_table``, counts of scores in
steps of ``1 / STEPS``), unless ``max_rows`` asks for a sample.  Features: lengths, depth, digit and symbol ratios, entropy, parameter counts, and
statistics of the host's suffix and last two labels and of the path's beginning: the block rates of hashed buckets, both labels
weighing the same, smoothed towards one half (``BUCKETS`` per kind, so bounded).

A URL without a rule is blocked if its score reaches the threshold: the largest of these steps that still catches ``RECALL`` of the blocks of
the held-out hosts, and at least 0.5.  So what is blocked looks as much like a block as the rules' own blocks do.

Defined cases: a null URL or one without ``://`` has empty host and path, no rule, and is judged by the trees like any other;
ties between rules of equal length go to the first listed; repeated rows are judged alike and learned from once; without labelled
URLs all are allowed; without a held-out host the threshold is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import trees
from spanloom.llm.words import NULL_ID, ints, restore_id
from spanloom.session import materialise

#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
BUCKETS = 256
#: Share of the held-out hosts' blocks that the threshold has to catch.
RECALL = 0.95
STEPS = 1 << 16
KINDS = ["suffix", "site", "first", "pair", "lead"]
LEXICAL = ["length", "host_length", "path_length", "labels", "depth", "digit_ratio", "symbol_ratio", "upper_ratio", "entropy", "host_entropy",
           "n_params", "query_length", "has_fragment", "digits_in_path", "hyphens", "longest_label", "secure", "trailing_slash"]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path after the first ``://``."""
    def part(i):
        return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def by_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``host, path, rule`` and ``label`` (1 block, 0 allow, null without a rule).  ``rules`` is a short list."""
    host, path = split_url(F.col("url"))
    out = urls.withColumns({"host": host, "path": path})
    rule, label = F.lit(None).cast("string"), F.lit(None).cast("int")
    for _, (verdict, h, p) in sorted(enumerate(rules), key=lambda r: (len(r[1][1] + r[1][2]), -r[0])):  # what fits last decides
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, label = F.when(fits, h + p).otherwise(rule), F.when(fits, int(verdict == "block")).otherwise(label)
    return out.withColumns({"rule": rule, "label": label})


def bucket_columns() -> dict[str, Column]:
    label = F.split("host", r"\.", -1)
    suffix = F.element_at(label, -1)
    site = F.array_join(F.slice(label, -F.least(F.size(label), F.lit(2)), 2), ".")
    first = F.regexp_extract("path", r"^/?([^/]*)", 1)
    lead = F.regexp_extract("path", r"^/?([^/]*/?[^/]?)", 1)
    key = {"suffix": suffix, "site": site, "first": first, "pair": F.concat_ws("/", suffix, first), "lead": F.concat_ws("/", site, lead)}
    return {f"b_{k}": F.pmod(F.xxhash64(v), F.lit(BUCKETS)).cast("int") for k, v in key.items()}


def _entropy(text: bytes) -> float:
    if not text:
        return 0.0
    p = np.bincount(np.frombuffer(text, np.uint8))
    p = p[p > 0] / len(text)
    return float(-(p * np.log2(p)).sum())


def lexical(url: str, host: str, path: str) -> list[float]:
    raw = url.encode()
    n = max(len(raw), 1)
    b = np.frombuffer(raw, np.uint8)
    digit, upper = (b >= 48) & (b <= 57), (b >= 65) & (b <= 90)
    letter = ((b | 32) >= 97) & ((b | 32) <= 122)
    _, mark, rest = url.partition("?")
    query = rest.partition("#")[0] if mark else ""
    labels = host.split(".") if host else []
    return [len(url), len(host), len(path), len(labels), path.count("/"), digit.sum() / n, (~digit & ~letter).sum() / n, upper.sum() / n, _entropy(raw),
            _entropy(host.encode()), query.count("&") + bool(query), len(query), "#" in url, sum(c.isdigit() for c in path), url.count("-"),
            max(map(len, labels), default=0), url[:6].lower() == "https:", path.endswith("/")]


def _lexical_batch(rows) -> np.ndarray:
    cols = [rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("url", "host", "path")]
    return np.array([lexical(u or "", h or "", p or "") for u, h, p in zip(*cols)], float).reshape(rows.num_rows, len(LEXICAL))


def _buckets(rows) -> np.ndarray:
    return np.stack([ints(rows, f"b_{k}") for k in KINDS], 1)


def _rates(table: np.ndarray, buckets: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """Smoothed block rates, both labels weighing the same in all, and log counts of each row's buckets."""
    n, hits = table[:, :, 0], table[:, :, 1]
    total, blocks = n[0].sum(), hits[0].sum()
    k = np.arange(len(KINDS))[None, :]
    nn, hh = n[k, buckets], hits[k, buckets] * (total / (2 * max(blocks, 1)))
    rest = (nn - hits[k, buckets]) * (total / (2 * max(total - blocks, 1)))
    return np.concatenate([(hh + weight / 2) / (hh + rest + weight), np.log1p(nn)], 1)


def features(table: np.ndarray, rows) -> np.ndarray:
    return np.concatenate([_lexical_batch(rows), _rates(table, _buckets(rows))], 1)


@dataclass
class Model:
    """``caught``: share of the held-out hosts' blocks that reach the threshold; ``wrong``: share of their allowed URLs that do."""

    forest: trees.Forest
    table: np.ndarray
    threshold: float = 0.5
    n_held: int = 0
    caught: float = float("nan")
    wrong: float = float("nan")

    def score(self, rows) -> np.ndarray:
        return self.forest.score(features(self.table, rows))


def _sample(urls: DataFrame, max_rows: int | None) -> DataFrame:
    """All URLs, or at most ``max_rows`` of them, half of each label, those smallest by a hash of the URL."""
    if max_rows is None:
        return urls
    picked = [urls.where(F.col("label") == y).orderBy(F.xxhash64("url"), "url").limit(max_rows // 2) for y in (0, 1)]
    return picked[0].unionByName(picked[1])


def _mapped(urls: DataFrame, column: str, kind: str, of) -> DataFrame:
    """``label`` and ``of(batch)``."""
    def run(batches):
        for rows in batches:
            yield pa.RecordBatch.from_arrays([pa.array(of(rows)), rows.column(rows.schema.get_field_index("label"))], [column, "label"])
    return urls.mapInArrow(run, f"{column} {kind}, label int")


def fit(labelled: DataFrame, max_rows: int | None = None, **options) -> Model:
    """``labelled`` comes from ``by_rules`` with buckets and a non-null label; one shuffle makes its URLs distinct."""
    table = np.zeros((len(KINDS), BUCKETS, 2))
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"b_{k}").alias("bucket")) for i, k in enumerate(KINDS)])).alias("c")
    once = labelled.select("url", "host", "path", "label", *[f"b_{k}" for k in KINDS]).dropDuplicates(["url"])
    fold = F.pmod(F.xxhash64(F.lit("fold"), "host"), F.lit(3))
    for r in once.where(fold == 0).select(kinds, "label").groupBy("c.kind", "c.bucket").agg(F.count("*").alias("n"), F.sum("label").alias("hits")).toLocalIterator():
        table[r.kind, r.bucket] = r.n, r.hits  # at most kinds * BUCKETS rows
    known = _mapped(_sample(once.where(fold == 1), max_rows), "x", "array<double>", lambda rows: list(features(table, rows)))
    model = Model(trees.train_table(materialise(known, "urls"), len(LEXICAL) + 2 * len(KINDS), balanced=True, **options), table)
    step = _mapped(_sample(once.where(fold == 2), max_rows), "step", "long", lambda rows: np.floor(model.score(rows) * STEPS).astype(np.int64))
    count = np.zeros((2, STEPS + 1), np.int64)
    for r in step.groupBy("label", "step").count().toLocalIterator():
        count[r.label, r.step] = r["count"]  # at most 2 * STEPS rows
    (n_allows, n_blocks), below = count.sum(1).tolist(), count.cumsum(1)
    model.n_held = n_allows + n_blocks
    first = STEPS // 2
    if n_blocks:
        first = max(first, int(np.searchsorted(below[1], int(n_blocks * (1 - RECALL)), "right")))
        model.threshold, model.caught = first / STEPS, 1 - float(below[1, first - 1]) / n_blocks
    if n_allows:
        model.wrong = 1 - float(below[0, first - 1]) / n_allows
    return model


def judge(urls: DataFrame, rules=RULES, max_rows: int | None = None) -> DataFrame:
    """``urls`` has ``page_id, url``; returns ``page_id, host, path, rule, verdict, score``.

    ``score`` is the trees' chance that the URL is one to block, given for every row.
    """
    found = by_rules(urls, rules).withColumns(bucket_columns())
    model = fit(found.where(F.col("label").isNotNull()), max_rows)
    none = len(model.forest.feature) == 0 and not model.table[0, :, 1].any()  # no URL to learn blocking from
    shared = urls.sparkSession.sparkContext.broadcast(model)  # fixed numbers of nodes and buckets
    keep = ["page_id", "host", "path", "rule", "label"]

    def run(batches):
        model = shared.value
        for rows in batches:
            yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(c)) for c in keep], pa.array(model.score(rows))], [*keep, "score"])

    scored = found.mapInArrow(run, "page_id long, host string, path string, rule string, label int, score double")
    blocked = F.lit(False) if none else F.col("score") >= model.threshold
    verdict = F.when(F.coalesce(F.col("label") == 1, blocked), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("page_id"), F.col("url").cast("string").alias("url"))
    return restore_id(judge(urls), "page_id")
