"""Histogram gradient-boosted trees for the logistic loss, kept as flat node arrays for vectorised scoring.

``monotone[f]`` is +1, -1 or 0: the score may only rise, only fall, or do either as feature ``f`` grows.  A split on a
constrained feature is taken only if its two leaf values are in order, and each side's values stay on its side of their
midpoint, so the whole ensemble keeps the direction.

``train`` fits on rows in memory, ``train_table`` on all rows of a table: tasks sum the gradients of their rows by node, feature and
bin, one Spark job a level, and only those sums (at most ``2^(depth-1) * features * bins``) come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.words import ints
from spanloom.session import materialise

#: Rows of a file of the binned table; gradients are summed as whole multiples of the heaviest row's weight / ``UNIT``, so in any order alike.
FILE_ROWS, UNIT = 50_000, float(1 << 30)


def walk(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, steps: int) -> np.ndarray:
    """The node of one tree that each row of ``x`` is at after ``steps``."""
    rows, at = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(steps):
        g = feature[at]
        right = ~(x[rows, np.maximum(g, 0)] <= threshold[at])
        at = np.where(g >= 0, 2 * at + 1 + right, at)
    return at


@dataclass
class Forest:
    feature: np.ndarray    # (trees, nodes); -1 is a leaf
    threshold: np.ndarray  # go left if value <= threshold
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of ``x``; node ``i`` has children ``2i+1`` and ``2i+2``.  NaN goes right."""
        out = np.full(len(x), self.base)
        for f, t, v in zip(self.feature, self.threshold, self.value):
            out += v[walk(x, f, t, self.depth)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -500, 500)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
          ridge: float = 1.0, least: int = 8, monotone: list[int] | None = None, balanced: bool = False) -> Forest:
    """Fit on rows ``x`` with labels 0/1; ``balanced`` gives both labels the same total weight.  Without rows, or with one label only, the forest is a constant."""
    n, m = x.shape if x.ndim == 2 else (0, 0)
    monotone = monotone or [0] * m
    nodes = (1 << (depth + 1)) - 1
    p = (y.sum() + 0.5) / (n + 1.0) if n else 0.5
    base = float(np.log(p / (1 - p)))
    if n == 0 or y.min() == y.max():
        return Forest(np.full((0, nodes), -1), np.zeros((0, nodes)), np.zeros((0, nodes)), base, depth)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) if balanced else np.ones(n)
    base = 0.0 if balanced else base
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    code = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(m)], 1)
    margin = np.full(n, base)
    fs, ts, vs = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (prob - y), np.maximum(weight * prob * (1 - prob), 1e-9)
        feature, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(n, np.int64)
        bound = {0: (-np.inf, np.inf)}
        for node in range(nodes):
            if node not in bound:
                continue
            low, high = bound[node]
            rows = np.flatnonzero(at == node)
            g, h = grad[rows].sum(), hess[rows].sum()
            value[node] = rate * np.clip(-g / (h + ridge), low, high)
            if 2 * node + 2 >= nodes or len(rows) < 2 * least:
                continue
            best = (1e-6, None)
            for f in range(m):
                k = len(cuts[f]) + 1
                if k < 2:
                    continue
                c = code[rows, f]
                gl = np.cumsum(np.bincount(c, grad[rows], k))[:-1]
                hl = np.cumsum(np.bincount(c, hess[rows], k))[:-1]
                cl = np.cumsum(np.bincount(c, minlength=k))[:-1]
                left, right = -gl / (hl + ridge), -(g - gl) / (h - hl + ridge)
                gain = gl ** 2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g ** 2 / (h + ridge)
                ok = (cl >= least) & (len(rows) - cl >= least)
                if monotone[f]:
                    ok &= monotone[f] * (np.clip(right, low, high) - np.clip(left, low, high)) >= 0
                gain = np.where(ok, gain, 0)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], (f, i, np.clip(left[i], low, high), np.clip(right[i], low, high)))
            if best[1] is None:
                continue
            f, i, left, right = best[1]
            feature[node], threshold[node] = f, cuts[f][i]
            at[rows] = 2 * node + 1 + (code[rows, f] > i)
            mid = (left + right) / 2
            a, b = (low, high), (low, high)
            if monotone[f] > 0:
                a, b = (low, mid), (mid, high)
            elif monotone[f] < 0:
                a, b = (mid, high), (low, mid)
            bound[2 * node + 1], bound[2 * node + 2] = a, b
        margin += value[at]
        fs.append(feature), ts.append(threshold), vs.append(value)
    return Forest(np.array(fs), np.array(ts), np.array(vs), base, depth)


def _bin_codes(rows) -> np.ndarray:
    code = rows.column(rows.schema.get_field_index("code")).to_pylist()
    return np.frombuffer(b"".join(code), np.uint8).reshape(rows.num_rows, -1)


def _summed(df: DataFrame, shape: tuple, one: bool) -> np.ndarray:
    """The sum of the arrays of ``shape`` in the rows of ``df``, a row of each scanning task, added up by one task if there is more than ``one``."""
    def add(batches):
        total = np.zeros(shape, np.int64)
        for rows in batches:
            for h in rows.column(0):
                total += np.frombuffer(h.as_py(), np.int64).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["h"])
    rows = (df if one else df.repartition(1).mapInArrow(add, "h binary")).collect()
    return sum((np.frombuffer(r.h, np.int64).reshape(shape) for r in rows), np.zeros(shape, np.int64))


def train_table(table: DataFrame, m: int, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0,
                least: int = 8, balanced: bool = False) -> Forest:
    """``train`` without constraints over all rows of ``table`` (``x array<double>`` of ``m`` features, ``label``), which is read twice.

    Bins are cut at approximate percentiles of all rows.  Ends early where no split of all rows gains anything.
    """
    nodes, cells = (1 << (depth + 1)) - 1, min(bins, 256)
    share = [i / cells for i in range(1, cells)]
    seen = table.agg(F.count("*").alias("n"), F.sum("label").alias("ones"), *[F.percentile_approx(F.get("x", F.lit(f)), share, 10_000).alias(f"c{f}") for f in range(m)]).first()
    n, ones = seen.n, seen.ones or 0
    p = (ones + 0.5) / (n + 1.0) if n else 0.5
    base = float(np.log(p / (1 - p)))
    fs, ts, vs = [], [], []
    if not 0 < ones < n:
        return Forest(np.full((0, nodes), -1), np.zeros((0, nodes)), np.zeros((0, nodes)), base, depth)
    weight = np.array([0.5 * n / (n - ones), 0.5 * n / ones]) if balanced else np.ones(2)
    base, unit = (0.0 if balanced else base), UNIT / weight.max()
    cuts = [np.unique(np.array(seen[f"c{f}"], float)) for f in range(m)]

    def encode(batches):
        for rows in batches:
            x = np.array(rows.column(rows.schema.get_field_index("x")).to_pylist(), float).reshape(rows.num_rows, m)
            code = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(m)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in code], pa.binary()), pa.array(ints(rows, "label"), pa.int32())], ["code", "label"])

    binned = materialise(table.mapInArrow(encode, "code binary, label int").repartition(1 + n // FILE_ROWS), "binned")

    def sums(level: int, done: Forest, feature: np.ndarray, cut: np.ndarray):
        """Sums of gradients, hessians and rows by node of ``level``, feature and bin."""
        first, shape = (1 << level) - 1, (3, 1 << level, m, cells)

        def run(batches):
            total, some = np.zeros(shape, np.int64), False
            for rows in batches:
                code, y = _bin_codes(rows), ints(rows, "label").astype(np.int64)
                at = walk(code, feature, cut, level) - first
                code, y, at, prob = code[at >= 0], y[at >= 0], at[at >= 0], done.score(code)[at >= 0]
                some = some or len(y) > 0
                w = weight[y] * unit
                for k, of in enumerate((np.rint(w * (prob - y)), np.rint(np.maximum(w * prob * (1 - prob), 1e-9 * unit)), np.ones(len(y)))):
                    for f in range(m):
                        total[k, :, f] += np.bincount(at * cells + code[:, f], of, at_least).astype(np.int64).reshape(-1, cells)
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["h"])
        at_least = (1 << level) * cells
        total = _summed(binned.mapInArrow(run, "h binary"), shape, n < FILE_ROWS)
        return first, total[0] / unit, total[1] / unit, total[2]

    codes = []
    for _ in range(trees):
        done = Forest(np.array(fs).reshape(-1, nodes), np.array(codes).reshape(-1, nodes), np.array(vs).reshape(-1, nodes), base, depth)
        feature, cut, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes), np.zeros(nodes)
        for level in range(depth):
            first, grad, hess, count = sums(level, done, feature, cut)
            split = False
            for i in range(1 << level):
                gl, hl, cl = (a[i].cumsum(1)[:, :-1] for a in (grad, hess, count))
                g, h, c = grad[i][0].sum(), hess[i][0].sum(), count[i][0].sum()
                if c < 2 * least:
                    continue
                gain = gl ** 2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g ** 2 / (h + ridge)
                gain = np.where((cl >= least) & (c - cl >= least), gain, 0)
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] <= 1e-6:
                    continue
                at, split = first + i, True
                feature[at], cut[at], threshold[at] = f, b, cuts[f][b]
                value[2 * at + 1] = -rate * gl[f, b] / (hl[f, b] + ridge)
                value[2 * at + 2] = -rate * (g - gl[f, b]) / (h - hl[f, b] + ridge)
            if not split:
                break
        if feature[0] < 0:
            break
        fs.append(feature), codes.append(cut), ts.append(threshold), vs.append(value)
    return Forest(np.array(fs).reshape(-1, nodes), np.array(ts).reshape(-1, nodes), np.array(vs).reshape(-1, nodes), base, depth)
