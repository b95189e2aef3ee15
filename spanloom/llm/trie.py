"""Prefix trie of conversations, built as a burst trie.

A turn is known by the 128-bit hash of its role and text, so texts are read once and never shuffled.  Conversations with the
same turns are one *line* from the start: its members are counted, and one of them, the smallest id, stands for it; a third of
all conversations may be copies of one.  All lines begin in one container under the root.  A container that holds more than
``most`` turns bursts: the turns all its lines share become heads of the trie (found by comparing the smallest and the largest
turn at each depth, so a long shared beginning is one burst), and its lines go on to containers by their next turn.  A container
left with a single line is a chain and needs no task of its own.  The remaining containers are dealt to shards; within one, the
lines of a container are sorted by their turns and swept into nodes, a stack holding the open ones.  Last, the sums of the
containers' tops are added up through the heads, one burst after the other from below.

Rounds: one for each burst on the deepest path, over the turns of oversized containers only.  Tasks hold one container of at
most ``most`` turns.  The ids of a line's members are sorted by ranges and joined to pieces there; only the pieces are hashed one
after the other, as a digest must be.  Positions within a conversation come from a window; those of conversations of more than
``long`` turns are counted by ranges of turns, so none of them is sorted by one task alone.

Defined cases: rows without an id belong to no conversation; null role or text is empty; equal turns of a conversation are
ordered by role and hash of the text; ``c - c % 5`` takes the sign of ``c`` (as SQL does); an empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.session import materialise

_NODE = ["line", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_line"]
_SWEPT = ", ".join(f"{c} long" for c in _NODE) + ", above binary, top boolean"


def numbered(rows: DataFrame, long: int = 1 << 20) -> DataFrame:
    """``conv_id, i, tid, size``: the turns of each conversation by their place, from 1."""
    role, text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    tid = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    slim = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                                                    tid.alias("tid"), F.octet_length(text).cast("long").alias("size"))
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("tid")]
    hot = materialise(slim.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > long).select("conv_id"), "long-conversations")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    usual = slim.join(hot, "conv_id", "left_anti").withColumn("i", place.cast("long"))

    # Equal turns of a long conversation travel as one with a number; ranges of the rest are counted, then added up.
    few = slim.join(hot, "conv_id", "left_semi").groupBy("conv_id", "turn", "role", "tid", "size").agg(F.count("*").alias("n"))
    ranged = few.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "role", "tid").withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "ranges-of-turns")
    sums = ranged.groupBy("conv_id", "part").agg(F.sum("n").alias("n"))
    before = sums.select("conv_id", "part", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("conv_id", "part").orderBy(*order)) - F.col("n")
    counted = ranged.withColumn("inside", inside).join(before, ["conv_id", "part"])
    spread = counted.withColumn("i", F.explode(F.sequence(F.col("before") + F.col("inside") + 1, F.col("before") + F.col("inside") + F.col("n"))))
    names = ["conv_id", "i", "tid", "size"]
    return usual.select(*names).unionByName(spread.select(*names))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: the first ``h`` turns of ``c - c % 5``, then the own ones after the first ``h``.

    Returns their turns, and all their ids, as some have no turns.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    every = turns.select("conv_id").distinct()
    heads = turns.where((F.col("conv_id") % 5 == 0) & (F.col("i") <= 8))  # h is 8 at most
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("i", "tid", "size"))).alias("head"))
    asked = every.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 5, "h": h})
    given = asked.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), 1, F.col("h").cast("int")))
    given = materialise(given.select("conv_id", "head", (F.col("h") - F.size("head")).alias("missing")), "lent-turns")
    lent = given.select("conv_id", F.explode("head").alias("x")).select("conv_id", "x.i", "x.tid", "x.size")
    few = given.where("missing > 0").select("conv_id", "missing")  # their own turns follow fewer than h
    own = turns.where(F.col("i") > h).join(few, "conv_id", "left").withColumn("i", F.col("i") - F.coalesce("missing", F.lit(0)))
    return lent.unionByName(own.select("conv_id", "i", "tid", "size")), every


def _pieces(batches):
    """The sorted members of each line, joined in pieces of some thousand ids; rows are ``line, conv_id, part`` in order."""
    number = 0
    for rows in batches:
        for lo in range(0, rows.num_rows, 4000):
            out = []
            for (line, part), ids in groupby(zip(*[rows.slice(lo, 4000).column(i).to_pylist() for i in (0, 2, 1)]), key=lambda r: r[:2]):
                out.append((line, part, number, ",".join(str(r[2]) for r in ids)))
                number += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["line", "part", "number", "ids"])


def _ends(batches):
    """A running hash of each line's pieces, in order."""
    pieces = (row for rows in batches for row in zip(rows.column(0).to_pylist(), rows.column(3).to_pylist()))
    out = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["end_line", "ends_sha256"])

    for line, own in groupby(pieces, key=lambda r: r[0]):
        digest, comma = hashlib.sha256(), ""
        for _, ids in own:
            digest.update(f"{comma}{ids}".encode())
            comma = ","
        out.append((line, digest.hexdigest()))
        if len(out) >= 4000:
            yield batch()
            out = []
    if out:
        yield batch()


def _swept(lines: list, k: int) -> list:
    """Nodes of one container from its lines ``(turns, line, n, sizes)`` below depth ``k``, sorted by their turns.

    A node is a list in the order of ``_NODE``; its parent is a node until the end, as the smallest member shows last.
    """
    lines.sort()
    top = [None, k, None, 0, 0, 0, 0, None, 0]
    nodes, open_, last = [top], [top], ()

    def close(node):
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * node[8]
        above = node[2]
        if above is not None:
            above[0] = node[0] if above[0] is None else min(above[0], node[0])
            above[3], above[4], above[5], above[6] = above[3] + node[3], above[4] + 1, above[5] + node[5], above[6] + node[6]

    for turns, line, n, sizes in lines:
        same = 0
        while same < len(last) and same < len(turns) and last[same] == turns[same]:
            same += 1
        while len(open_) > same + 1:
            close(open_.pop())
        for i in range(same, len(turns)):
            open_.append([None, k + i + 1, open_[-1], 0, 0, 0, 0, None, sizes[i]])
            nodes.append(open_[-1])
        end = open_[-1]
        end[0], end[3], end[7] = line if end[0] is None else min(end[0], line), end[3] + n, line
        last = turns
    while len(open_) > 1:
        close(open_.pop())
    return nodes


def _sweep(batches):
    """Rows of whole containers ``container, line, i, tid, size, n, k, parent, above``, sorted by the first three.

    ``i`` is -1 in the row that describes a line; the row of depth ``k``, if any, gives the size of the container's top.
    """
    out = []

    def finish(lines, k, size, parent, above):
        nodes = _swept(lines, k)
        nodes[0][5], nodes[0][8] = nodes[0][5] or 1, size
        nodes[0][6] += (nodes[0][3] - 1) * size
        for x in nodes:
            out.append((x[0], x[1], parent if x is nodes[0] else x[2][0], *x[3:8], above if x is nodes[0] else None, x is nodes[0]))

    def batch():
        kinds = [pa.int64()] * 8 + [pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [*_NODE, "above", "top"])

    def rows():
        for b in batches:
            yield from zip(*[b.column(i).to_pylist() for i in range(9)])

    for _, container in groupby(rows(), key=lambda r: r[0]):
        lines, size = [], 0
        for _, line, i, tid, bytes_, n, depth, up, over in container:
            if i < 0:
                k, parent, above = depth, up, over
                lines.append(([], line, n, []))
            elif i == k:
                size = bytes_
            else:
                lines[-1][0].append(tid)
                lines[-1][3].append(bytes_)
        finish(lines, k, size, parent, above)
        if len(out) >= 4000:
            yield batch()
            out.clear()
    if out:
        yield batch()


def prefix_trie(turns: DataFrame, every: DataFrame, most: int = 1 << 15) -> DataFrame:
    """Nodes of the trie of ``turns`` (``conv_id, i, tid, size``) over the conversations ``every``."""
    prints = [F.bit_xor(F.xxhash64(F.lit(seed), "i", "tid")).alias(f"p{seed}") for seed in (0, 1)]
    shape = every.join(turns.groupBy("conv_id").agg(F.count("*").alias("len"), *prints), "conv_id", "left")
    shape = materialise(shape.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("len", "p0", "p1")]), "conversation-prints")
    lines = shape.groupBy("len", "p0", "p1").agg(F.min("conv_id").alias("line"), F.count("*").alias("n"))
    none, no_key = F.lit(None).cast("long"), F.lit(None).cast("binary")
    now = lines.withColumns({"container": F.lit(b""), "k": F.lit(0).cast("long"), "parent": none, "above": no_key})
    now = lines = materialise(now.select("line", "n", "len", "p0", "p1", "container", "k", "parent", "above"), "lines")
    of = shape.join(lines.select("line", "len", "p0", "p1"), ["len", "p0", "p1"]).select("line", "conv_id").repartitionByRange("line", "conv_id")
    pieces = of.sortWithinPartitions("line", "conv_id").withColumn("part", F.spark_partition_id()).mapInArrow(_pieces, "line long, part int, number long, ids string")
    ends = pieces.repartition("line").sortWithinPartitions("line", "part", "number").mapInArrow(_ends, "end_line long, ends_sha256 string")
    turns = materialise(turns.withColumnRenamed("conv_id", "line").join(lines.select("line"), "line", "left_semi"), "turns-of-lines")

    now = now.drop("p0", "p1")
    left, bursts = [], []
    while True:
        sizes = now.groupBy("container").agg(F.sum(F.col("len") - F.col("k")).alias("turns"), F.count("*").alias("m"), F.sum("n").alias("members"), F.min("line").alias("first"),
                                             F.first("k").alias("k"), F.first("parent").alias("parent"), F.first("above").alias("above"))
        large = materialise(sizes.where(F.col("turns") > most), "oversized-containers")
        left.append(now.join(large, "container", "left_anti"))
        chain = now.join(large.where("m = 1").select("container"), "container", "left_semi")
        bursting = large.where("m > 1")
        if bursting.isEmpty():
            break
        inside = now.select("line", "container").join(bursting.select("container", "m", "k", "first", "members"), "container")
        below = turns.join(inside, "line").where("i > k")
        # The first depth at which not all lines have the same turn.
        depths = below.groupBy("container", "m", "i").agg(F.min("tid").alias("low"), F.max("tid").alias("high"), F.count("*").alias("there"))
        split = depths.where("low <> high OR there < m").groupBy("container").agg(F.min("i").alias("at"))
        heads = materialise(bursting.join(split, "container"), "heads")
        ended = now.join(heads.select("container", "at"), "container").where(F.col("len") < F.col("at")).select("container", F.col("line").alias("end_line"))
        bursts.append((heads, ended))
        left.append(chain.withColumn("chain", F.lit(True)))
        go = turns.withColumnRenamed("i", "at").join(now.select("line", "n", "len", "container").join(heads.select("container", "at", "first"), "container"), ["line", "at"])
        key = F.unhex(F.md5(F.concat("container", "tid")))
        now = materialise(go.select("line", "n", "len", key.alias("container"), F.col("at").alias("k"), F.col("first").alias("parent"), F.col("container").alias("above")), "containers")
    left.append(chain.withColumn("chain", F.lit(True)))
    rest = None
    for part in left:
        part = part if "chain" in part.columns else part.withColumn("chain", F.lit(False))
        rest = part if rest is None else rest.unionByName(part)
    rest = materialise(rest, "last-containers")

    swept_lines = rest.where("NOT chain")
    about = swept_lines.select("container", "line", F.lit(-1).cast("long").alias("i"), no_key.alias("tid"), none.alias("size"), "n", "k", "parent", "above")
    rows = turns.join(swept_lines.select("container", "line", "k"), "line").where("i >= k")
    rows = rows.select("container", "line", "i", "tid", "size", none.alias("n"), none.alias("k"), none.alias("parent"), no_key.alias("above"))
    shards = about.unionByName(rows).repartition("container").sortWithinPartitions("container", "line", "i")
    swept = materialise(shards.mapInArrow(_sweep, _SWEPT), "swept-nodes")

    # A chain: one line, so every sum is over the line itself; one conversation saves nothing.
    def sums(nodes, group, add):
        later = F.sum("size").over(Window.partitionBy(group).orderBy(F.desc("depth")))
        return nodes.withColumn("saved_tokens", F.col(add) + (F.col("n_convs") - 1) * later)

    def placed(table, last):
        """A row for each depth from ``k`` to ``last`` of the line ``first``, with the size of its turn (the root's is 0)."""
        own = turns.select(F.col("line").alias("first"), F.col("i").alias("depth"), "size")
        root = table.where("k = 0").withColumns({"depth": F.lit(0).cast("long"), "size": F.lit(0).cast("long")})
        return table.join(own, "first").where((F.col("depth") >= F.col("k")) & (F.col("depth") <= F.col(last))).unionByName(root)

    def shown(nodes):
        top = F.col("depth") == F.col("k")
        return nodes.select(F.col("first").alias("line"), "depth", F.when(top, F.col("parent")).otherwise(F.col("first")).alias("parent"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                            "end_line", F.when(top, F.col("above")).alias("above"), top.alias("top"))

    chains = placed(rest.where("chain").withColumnRenamed("line", "first").withColumn("zero", F.lit(0).cast("long")), "len")
    is_end = F.col("depth") == F.col("len")
    chains = chains.withColumns({"n_convs": F.col("n"), "n_children": F.when(is_end, 0).otherwise(1).cast("long"), "n_leaves": F.lit(1).cast("long"), "end_line": F.when(is_end, F.col("first"))})
    nodes = swept.unionByName(shown(sums(chains, "container", "zero")))
    tops = nodes.where("top AND above IS NOT NULL")
    for heads, ended in reversed(bursts):
        under = tops.groupBy(F.col("above").alias("container")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("under"))
        known = heads.join(under, "container").join(ended, "container", "left").withColumns({"last": F.col("at") - 1, "n_convs": F.col("members")})
        is_last = F.col("depth") == F.col("last")
        every_head = placed(known, "last").withColumns({"n_children": F.when(is_last, F.col("kids")).otherwise(1).cast("long"), "end_line": F.when(is_last, F.col("end_line"))})
        made = materialise(shown(sums(every_head, "container", "under")), "head-nodes")
        nodes, tops = nodes.unionByName(made), tops.unionByName(made.where("top AND above IS NOT NULL"))

    empty = hashlib.sha256().hexdigest()
    out = nodes.join(ends, "end_line", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
    return out.select(F.col("line").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = materialise(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "numbered-turns")
    again, every = rebuilt(turns)
    return prefix_trie(materialise(again, "rebuilt-conversations"), every)
