"""Best-fit packing of token pieces into sequences by bin completion with branch and bound.

Pieces of one length are interchangeable, so the search works on how many pieces there are of each length: at most
``capacity`` numbers, whatever the corpus.  It fills bins around the largest length left.  The undominated fillings of the
rest of the bin are enumerated (a filling is dominated if one available length can stand for two or more of its lengths or for
a smaller one without overflow), tried by waste, and applied as many times as the counts allow.  The incumbent is the
best-fit-decreasing solution; a branch whose waste already exceeds what a better solution could waste is cut, and the search
ends at the bound ``ceil(total / capacity)`` or when ``nodes`` are spent.  The result is a short list of patterns and how
often each is used; every piece finds its place from its rank among the pieces of its length.

Ranks are counted in two steps (blocks of the written table, then within a block), so no length is gathered in one task.

Defined cases: null text is empty and is one piece of the closing id alone; repeated rows are separate documents; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.bpe import fast_encoder
from spanloom.llm.words import docs_table, restore_id, source, text_pieces
from spanloom.session import materialise

Pattern = tuple[int, tuple[int, ...]]  # how often, lengths in descending order


def _fit_rest(room: int, left: dict[int, int]) -> list[int]:
    """Best fit: always the largest length that still fits."""
    out, used = [], Counter()
    for s in sorted(left, reverse=True):
        while s <= room and used[s] < left[s]:
            k = min(room // s, left[s] - used[s])
            out += [s] * k
            used[s] += k
            room -= s * k
    return out


def _dominated(filling: list[int], room: int, left: dict[int, int], sizes: np.ndarray) -> bool:
    waste, used = room - sum(filling), Counter(filling)
    if len(filling) > 6:
        return False
    for k in range(1, len(filling) + 1):
        for part in set(combinations(filling, k)):
            low = sum(part) + (k == 1)
            lo, hi = np.searchsorted(sizes, low), np.searchsorted(sizes, sum(part) + waste, "right")
            if any(left[int(s)] > used[int(s)] and int(s) not in part for s in sizes[lo:hi]):
                return True
    return False


def fillings(room: int, left: dict[int, int], keep: int = 6, depth: int = 4, nodes: int = 4000) -> list[list[int]]:
    """Undominated fillings of ``room`` by least waste; the best-fit filling is always among the candidates."""
    sizes = np.array(sorted(s for s, n in left.items() if n and s <= room))
    found = {tuple(_fit_rest(room, left))}
    budget = [nodes]

    def go(chosen: list[int], rest: int, top: int) -> None:
        hi = int(np.searchsorted(sizes, min(rest, top), "right"))
        if hi == 0 or len(chosen) == depth:
            found.add(tuple(chosen))
            return
        if len(chosen) == depth - 1:  # the largest that fits is the only undominated last choice
            found.add((*chosen, *_fit_rest(rest, {int(s): left[int(s)] - chosen.count(int(s)) for s in sizes[:hi]})))
            return
        for s in sizes[:hi][::-1]:
            budget[0] -= 1
            if budget[0] < 0:
                return
            s = int(s)
            if chosen.count(s) < left[s]:
                go([*chosen, s], rest - s, s)
                if sum(1 for f in found if sum(f) == room) >= keep:
                    return

    go([], room, room)
    ranked = sorted(found, key=lambda f: (room - sum(f), len(f), tuple(-s for s in f)))
    good = [list(f) for f in ranked[:8 * keep] if not _dominated(list(f), room, left, sizes)] or [list(ranked[0])]
    return good[:keep]


def _take(left: dict[int, int], pattern: list[int]) -> tuple[int, dict[int, int]]:
    need = Counter(pattern)
    m = min(left[s] // n for s, n in need.items())
    after = dict(left)
    for s, n in need.items():
        after[s] -= m * n
        if not after[s]:
            del after[s]
    return m, after


def solve(counts: dict[int, int], capacity: int, nodes: int = 300) -> list[Pattern]:
    """Patterns that use up ``counts`` (length -> number) in few bins."""
    total = sum(s * n for s, n in counts.items())
    bound = -(-total // capacity)

    def run(left: dict[int, int], first: bool) -> list[Pattern]:
        out = []
        while left:
            top = max(left)
            rest = dict(left)
            rest[top] -= 1
            rest = {s: n for s, n in rest.items() if n}
            f = _fit_rest(capacity - top, rest) if first else fillings(capacity - top, rest, keep=1, nodes=400)[0]
            m, left = _take(left, [top, *f])
            out.append((m, (top, *f)))
        return out

    best = run({s: n for s, n in counts.items() if n}, True)
    size = sum(m for m, _ in best)
    if size > bound:
        other = run({s: n for s, n in counts.items() if n}, False)
        if (n := sum(m for m, _ in other)) < size:
            best, size = other, n
    stack = [({s: n for s, n in counts.items() if n}, [], 0, 0)]
    while stack and nodes > 0 and size > bound:
        left, made, bins, waste = stack.pop()
        nodes -= 1
        if waste > (size - 1) * capacity - total:
            continue
        if not left:
            if bins < size:
                best, size = made, bins
            continue
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        rest = {s: n for s, n in rest.items() if n}
        for f in reversed(fillings(capacity - top, rest, nodes=400)):
            m, after = _take(left, [top, *f])
            stack.append((after, [*made, (m, (top, *f))], bins + m, waste + m * (capacity - top - sum(f))))
    return best


def layout(patterns: list[Pattern]) -> pd.DataFrame:
    """For ranks ``begin`` and above of a length: first sequence, copies in a sequence, and the first copy's offset."""
    used, rows, base = Counter(), [], 0
    for m, pattern in patterns:
        offset = 0
        for s in sorted(set(pattern), reverse=True):
            k = pattern.count(s)
            rows.append((s, used[s], base, k, offset))
            used[s] += m * k
            offset += s * k
        base += m
    return pd.DataFrame(rows, columns=["length", "begin", "base", "copies", "offset"]).astype("int64").sort_values(["length", "begin"])


def cut(docs: DataFrame, capacity: int = 1024, close: int = 2, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces ``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of each text's ids followed by ``close``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids

    def run(batches):
        encode = fast_encoder(path)
        for rows, _, _ in text_pieces(batches):
            out = []
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(close)).astype("<u4")
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    out.append((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b]] if keep_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = 1024, nodes: int = 300) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have ``doc_id, piece, length``; lengths are 1 to ``capacity``."""
    table = materialise(pieces.withColumn("_block", F.spark_partition_id()), "pieces")
    counts = table.groupBy("_block", "length").agg(F.count("*").alias("n"))
    total = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}  # at most capacity rows
    plan = layout(solve(total, capacity, nodes))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_block", "length").orderBy("doc_id", "piece")
    ranked = table.withColumn("_rank", F.row_number().over(inside) - 1).join(first, ["_block", "length"])
    ranked = ranked.select(*pieces.columns, (F.col("_first") + F.col("_rank")).alias("_rank"))
    shared = pieces.sparkSession.sparkContext.broadcast({c: plan[c].to_numpy() for c in plan})  # a few rows for each length
    wide = capacity.bit_length() + 1

    def place(batches):
        p = shared.value
        order = (p["length"] << (62 - wide)) + p["begin"]
        for rows in batches:
            col = {n: rows.column(i) for i, n in enumerate(rows.schema.names)}
            length, rank = col["length"].to_numpy(), col["_rank"].to_numpy()
            at = np.searchsorted(order, (length << (62 - wide)) + rank, "right") - 1
            j = rank - p["begin"][at]
            del col["_rank"]
            col |= {"sequence_id": pa.array(p["base"][at] + j // p["copies"][at]), "offset": pa.array(p["offset"][at] + j % p["copies"][at] * length)}
            yield pa.RecordBatch.from_arrays(list(col.values()), list(col))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, ddl + ", sequence_id long, offset long")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return restore_id(pack(cut(source(docs_table(spark, sf_dir)))))
