"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves the space at every node by the median projection on the difference of two sample points.  The trees are fitted
on at most ``2 * sample`` vectors (those with small hashes of their ids), so the forest is bounded and can be shared; every
vector of the table is then indexed in every tree.  A query walks all trees through one priority queue: the branch with the
smallest sum of squared distances to the planes on its way comes next, whichever tree it is in, until the leaves taken hold
the wanted number of candidates, ``max(candidates, share * rows)``.  The leaf candidates are ranked by the exact inner product
in double precision, added up per pair alike wherever the pair meets.

Vectors go once to each tree's *cell*, a subtree of leaves that holds about ``cell_rows`` vectors; a query goes to a cell once,
with a bitmap of the leaves it takes there.  Where the sample is too small for cells of that size, or a cell would get more
than ``cell_queries`` queries, cells are split by hash of the vector and of the query: every vector of a leaf still meets every
query that takes the leaf.  A cell returns the best ``k`` of each query.  Of more than ``k + 1`` equal vectors only the ``k + 1``
smallest ids can ever be among the ``k`` nearest (the query itself may be one of them), so only those are indexed.

Near-uniform vectors of 64 dimensions, as in the tables at hand, have nothing local to use: 0.9 of the true neighbours takes a
large share of all rows (``share=1.0`` over four trees reads about two thirds of them), and work grows with queries times rows.
With clustered vectors set ``share=0``: then a query costs the same at every size of the table.

Defined cases: a vector that is null, zero, or holds null or non-finite components, or whose length is not the most frequent one
(the larger on a tie), takes no part; nor does a null id.  An id that repeats is stood for by its smallest vector in array order.
Ties go to the smaller id.  With ``k`` candidates or fewer all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.llm.words import ints
from spanloom.session import materialise


@dataclass
class Forest:
    """Planes of perfect binary trees: node ``i`` of a tree has the children ``2 i + 1`` (at most the offset) and ``2 i + 2``."""

    normal: np.ndarray  # trees x nodes x dimensions
    offset: np.ndarray  # trees x nodes
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def leaf_of(self, x: np.ndarray, tree: int) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", x, self.normal[tree][node]) > self.offset[tree][node]
            node = 2 * node + 1 + side
        return node - (self.leaves - 1)

    def search(self, x: np.ndarray, leaves: int):
        """For each row of ``x`` the first ``leaves`` leaves that come out of the shared queue, as ``tree * self.leaves + leaf``."""
        trees, nodes = self.offset.shape
        margin = (x @ self.normal.reshape(trees * nodes, -1).T if nodes else np.zeros((len(x), 0))) - self.offset.reshape(-1)
        for row in margin.tolist():
            queue, taken = [(0.0, tree, 0) for tree in range(trees)], []
            while queue and len(taken) < leaves:
                cost, tree, node = heapq.heappop(queue)
                at = tree * nodes
                while node < nodes:
                    m = row[at + node]
                    near = 2 * node + 1 + (m > 0)
                    heapq.heappush(queue, (cost + m * m, tree, 4 * node + 3 - near))
                    node = near
                taken.append(tree * self.leaves + node - nodes)
            yield taken


def fit(points: np.ndarray, trees: int, depth: int, seed: int = 7) -> Forest:
    rng, nodes, dim = np.random.default_rng(seed), (1 << depth) - 1, points.shape[1]
    normal, offset = np.zeros((trees, nodes, dim)), np.zeros((trees, nodes))
    for t in range(trees):
        parts = {0: np.arange(len(points))}
        for node in range(nodes):
            part = parts.pop(node)
            w = np.zeros(dim)
            if len(part) > 1:
                a, b = rng.choice(part, 2, replace=False)
                w = points[a] - points[b]
            if not w.any():
                w = rng.standard_normal(dim)
            w = w / np.abs(w).max()
            w /= np.linalg.norm(w)
            side = points[part] @ w
            normal[t, node], offset[t, node] = w, np.median(side) if len(part) else 0.0
            parts[2 * node + 1], parts[2 * node + 2] = part[side <= offset[t, node]], part[side > offset[t, node]]
    return Forest(normal, offset, depth)


def _vectors(rows, column: str = "vec") -> np.ndarray:
    flat = rows.column(rows.schema.get_field_index(column))
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, vec`` of the rows that take part, whatever their length."""
    odd = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = table.select(table[id_col].cast("long").alias("id"), table[vec_col].alias("vec"))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(~odd & F.exists("vec", lambda v: v != 0))


def _one_per_id(rows: DataFrame) -> DataFrame:
    again = materialise(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated-ids")
    single = rows.join(again, "id", "left_anti")
    return single.unionByName(rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("vec").alias("vec")))


def _few_equal(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of each vector, those with the smallest ids."""
    key = ["h1", "h2"]
    hashed = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    hot = materialise(hashed.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*key), "frequent-vectors")
    rank = F.row_number().over(Window.partitionBy(*key, "vec").orderBy("id"))
    first = hashed.join(hot, key, "left_semi").withColumn("rank", rank).where(F.col("rank") <= most)
    return hashed.join(hot, key, "left_anti").select("id", "vec").unionByName(first.select("id", "vec"))


def _best(qid, q, takes, ptr, ids, x, k: int):
    """Rows ``(query, id, score)`` of the best ``k`` members of the leaves each query takes; ``ptr`` cuts members into leaves."""
    top, found, held = np.full((len(q), k), -np.inf), [], 0
    slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)

    def cut():
        r, c = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        score = (q[r] * x[c]).sum(1)
        order = np.lexsort((ids[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[keep], c[keep], score[keep]

    for leaf in range(len(ptr) - 1):
        rows, (a, b) = np.flatnonzero(takes[:, leaf]), ptr[leaf:leaf + 2]
        if not len(rows) or a == b:
            continue
        s = q[rows] @ x[a:b].T
        s[qid[rows][:, None] == ids[None, a:b]] = -np.inf
        best = np.partition(np.concatenate([top[rows], s], 1), b - a, axis=1)[:, b - a:]
        top[rows] = best
        i, j = np.nonzero((s >= (best.min(1) - slack[rows])[:, None]) & (s > -np.inf))
        found.append((rows[i], a + j))
        held += len(i)
        if held > 1 << 21:  # many equal scores
            r, c, _ = cut()
            found, held = [(r, c)], len(r)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    r, c, score = cut()
    return r, ids[c], score


def nearest(table: DataFrame, wanted: str, k: int = 20, trees: int = 4, leaf_rows: int = 64, sample: int = 1 << 15, share: float = 1.0, candidates: int = 5000,
            cell_rows: int = 1 << 15, cell_queries: int = 1 << 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row where ``wanted``, a condition on ``id``, holds."""
    spark = table.sparkSession
    rows = usable(table, id_col, vec_col)
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.count_if(F.expr(wanted)).alias("queries")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, n_queries = sizes[0]
    single = rows.schema["vec"].dataType.elementType.simpleString() == "float"  # kept so, as it travels to every tree
    kind_of = pa.float32() if single else pa.float64()
    schema = f"cell long, kind int, leaf int, id long, vec array<{'float' if single else 'double'}>, takes binary"
    rows = _one_per_id(rows.where(F.size("vec") == dim).withColumn("vec", F.col("vec").cast("array<float>" if single else "array<double>")))
    index = _few_equal(rows, k + 1)

    share_of = min(1.0, sample / n)
    picked = index.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 40)) < int(share_of * (1 << 40))).limit(2 * sample).toArrow()
    points = _vectors(picked.combine_chunks().to_batches()[0])[np.argsort(picked["id"].to_numpy(), kind="stable")] if picked.num_rows else np.zeros((0, dim))
    depth = max(0, int(np.log2(max(len(points), 1) / leaf_rows)))
    forest = fit(points, trees, depth)
    if forest.normal.nbytes > 256 << 20:
        raise ValueError("the forest is too large to share: take a smaller sample, fewer trees or larger leaves")

    leaves = forest.leaves
    cells = min(leaves, 1 << max(0, int(np.ceil(np.log2(n / cell_rows)))))  # of a tree
    width = leaves // cells
    chunks, salts = -(-n // (cells * cell_rows)), -(-n_queries // cell_queries) or 1
    take = int(np.ceil(max(candidates, share * n) / (n / leaves)))
    shared = spark.sparkContext.broadcast(forest)  # at most trees * 2 * sample / leaf_rows planes

    def batch(cell, kind, leaf, ids, vec, takes):
        flat = pa.FixedSizeListArray.from_arrays(pa.array(vec.reshape(-1)).cast(kind_of), dim).cast(pa.list_(kind_of))
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(ids), kind, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(ids), flat, pa.array(takes, pa.binary())],
                                          ["cell", "kind", "leaf", "id", "vec", "takes"])

    def members(batches):
        forest = shared.value
        for rows in batches:
            ids, x = ints(rows, "id"), _vectors(rows)
            chunk = ints(rows, "hash") % chunks
            for tree in range(trees) if len(ids) else ():
                leaf = forest.leaf_of(x, tree)
                cell = ((tree * cells + leaf // width) * chunks + chunk) * salts
                for salt in range(salts):
                    yield batch(cell + salt, 0, leaf % width, ids, x, [None] * len(ids))

    def queries(batches):
        forest = shared.value
        for rows in batches:
            for lo in range(0, rows.num_rows, 256):
                part = rows.slice(lo, 256)
                ids, x = ints(part, "id"), _vectors(part)
                salt = ints(part, "hash") % salts
                cell, who, bits = [], [], []
                for i, taken in enumerate(forest.search(x, take)):
                    grid = np.zeros((trees * cells, width), bool)
                    grid.reshape(-1)[taken] = True
                    for c in np.flatnonzero(grid.any(1)).tolist():
                        packed = np.packbits(grid[c]).tobytes()
                        for chunk in range(chunks):
                            cell.append((c * chunks + chunk) * salts + int(salt[i]))
                            who.append(i)
                            bits.append(packed)
                who = np.array(who, np.int64)
                yield batch(np.array(cell, np.int64), 1, np.zeros(len(who)), ids[who], x[who], bits)

    def ranked(batches):
        at, mem, asked = None, [], []

        def answer():
            leaf, ids, x = (np.concatenate(z) for z in zip(*mem))
            ptr = np.searchsorted(leaf, np.arange(width + 1))
            qid, q, bits = (np.concatenate(z) for z in zip(*asked))
            for lo in range(0, len(qid), 1024):
                own = qid[lo:lo + 1024]
                r, c, s = _best(own, q[lo:lo + 1024], bits[lo:lo + 1024], ptr, ids, x, k)
                has = np.unique(r)
                off = np.append(np.searchsorted(r, has), len(r)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own[has]), pa.ListArray.from_arrays(off, pa.array(c)), pa.ListArray.from_arrays(off, pa.array(s))], ["query_id", "ids", "scores"])

        for rows in batches:
            cell, kind = ints(rows, "cell"), ints(rows, "kind")
            cut = np.flatnonzero(np.diff(cell) | np.diff(kind)) + 1
            for a, b in zip([0, *cut], [*cut, len(cell)]):
                if a == b:
                    continue
                part = rows.slice(a, b - a)
                if cell[a] != at:
                    if mem and asked:
                        yield from answer()
                    at, mem, asked = cell[a], [], []
                if kind[a] == 0:
                    mem.append((ints(part, "leaf"), ints(part, "id"), _vectors(part)))
                elif mem:
                    bits = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8).reshape(b - a, -1)
                    asked.append((ints(part, "id"), _vectors(part), np.unpackbits(bits, axis=1)[:, :width].astype(bool)))
                    if sum(len(z[0]) for z in asked) >= 1024:
                        yield from answer()
                        asked = []
        if mem and asked:
            yield from answer()

    def hashed(df):
        return df.select("id", "vec", F.pmod(F.xxhash64(F.lit("cell"), "id"), F.lit(1 << 40)).alias("hash"))

    meet = hashed(index).mapInArrow(members, schema).unionByName(hashed(rows.where(wanted)).mapInArrow(queries, schema))
    found = meet.repartition("cell").sortWithinPartitions("cell", "kind", "leaf", "id").mapInArrow(ranked, "query_id long, ids array<long>, scores array<double>")
    pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("c")).select("query_id", F.col("c.ids").alias("vec_id"), F.col("c.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_rp_forest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 20 = 0")
