"""Near-duplicate groups by an inverted join of MinHash signatures.

Each text is the set of its distinct lower-cased word shingles; a text with fewer words than a shingle is one shingle, one
without words is the empty set and linked with nothing.  Texts with equal sets form a class, kept as one representative.  The
representatives' signatures of ``coordinates`` MinHash values are posted under each (coordinate, value).  Two texts of
Jaccard similarity s agree in a share s of the coordinates on average; pairs with at least ``matches`` agreeing ones are kept
and then confirmed on their full sets.

* Skip merging: a posting list of one text joins nothing and is skipped, and so is a text that shares fewer than ``matches``
  coordinates with anybody.
* Prefix merging: lists are ordered by length.  Of a text's n shared coordinates, the n - matches + 1 with the shortest lists
  are enough, because two texts that agree in ``matches`` coordinates meet in one of them.  Long lists (a shingle that a third
  of all texts hold) thus drop out unless a text has nothing else.

Only connectedness is wanted, so pairs are not all expanded.  First each list links its members to its smallest one.  After
these links are confirmed and merged into components, only members of one list that are still in different components are
compared (in blocks, see ``possible_partners``), so no link between different texts is lost and no group emits its pairs.
Members that are all in different components meet in every two chunks of the list: this part grows with the square of their number,
spread over groups of bounded size.

At similarity 0.8 a pair agrees in 38.4 of 48 coordinates on average; the chance that it agrees in fewer than 22 is 3.4e-8.

Rows: one id with different texts counts as one document that has the links of each.  Null ids take no part in linking, are
their own group (null component) and are kept.  Repeated rows are one text, each with a row in the result.  An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.words import NULL_ID, apart, docs_table, mix, restore_id, roll, source, text_pieces, words_of
from spanloom.session import materialise

COORDINATES, MATCHES = 48, 22
_PIECE_DOCS = 1 << 15
_SEEDS = mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingles of all texts, sorted within each, and the pointer of each text into them.

    Texts are numbered in 16 bits: at most 65,535 at once.
    """
    assert len(offsets) <= 1 << 16
    w = words_of(data, offsets, lower=True)
    win, at = w.windows(k)
    doc = w.doc[at]
    few = np.diff(w.ptr)
    for n in range(1, k):  # texts of fewer words: the whole sequence is one shingle
        own = np.flatnonzero(few == n)
        if len(own):
            whole, first = w.windows(n)
            pick = np.searchsorted(first, w.ptr[own])
            win, doc = np.concatenate([win, whole[pick]]), np.concatenate([doc, own])
    cell = np.unique(doc.astype(np.uint64) << np.uint64(48) | win >> np.uint64(16))
    ptr = np.searchsorted(cell, np.arange(len(offsets), dtype=np.uint64) << np.uint64(48))
    return cell & np.uint64((1 << 48) - 1), ptr


def marks(docs: DataFrame, k: int, coordinates: int = COORDINATES) -> DataFrame:
    """``doc_id, text_key, n, f1, f2, sig`` for each row: set size, two sums that stand for the set, and the signature."""
    def run(batches):
        for rows, data, off in (x for b in batches for lo in range(0, b.num_rows, _PIECE_DOCS) for x in text_pieces([b.slice(lo, _PIECE_DOCS)])):
            cell, ptr = shingle_sets(data, off, k)
            n = np.diff(ptr)
            full = np.flatnonzero(n > 0)
            sig = np.zeros((len(n), coordinates), np.uint32)
            f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(full):
                h = mix(cell)
                f1[full] = np.add.reduceat(h, ptr[full])
                f2[full] = np.add.reduceat(mix(h + np.uint64(77)), ptr[full])
                for c in range(coordinates):
                    sig[full, c] = np.minimum.reduceat(((h * _SEEDS[c]) >> np.uint64(32)).astype(np.uint32), ptr[full])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * coordinates, pa.int32()), pa.array(sig.view(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), flat],
                                             ["doc_id", "text_key", "n", "f1", "f2", "sig"])
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, "doc_id long, text_key long, n long, f1 long, f2 long, sig array<int>")


def postings(reps: DataFrame, matches: int = MATCHES) -> DataFrame:
    """``key, rep``: the shortest shared lists of every text that shares at least ``matches`` coordinates."""
    posted = reps.select("rep", F.posexplode("sig").alias("c", "v")).select("rep", (F.col("c").cast("long") * (1 << 32) + F.col("v")).alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    shared = posted.join(lists, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("members", "key"))).alias("lists"))  # at most one for each coordinate
    prefix = F.slice("lists", F.lit(1), F.size("lists") - (matches - 1))
    return shared.where(F.size("lists") >= matches).select("rep", F.explode(prefix).alias("l")).select(F.col("l.key").alias("key"), "rep")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): the smallest node reachable.

    Large-star and small-star steps in turn until nothing changes; each round is a table, so lineage stays short.
    """
    cur = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    stamp = None
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        cur = materialise(small, "links")
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first())
        if now == stamp:
            break
        stamp = now
    roots = cur.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, least: int) -> DataFrame:
    """Pairs ``a, b`` whose full sets reach ``least`` per cent.

    The partners of one text are dealt out in groups of sixteen, so a text with very many partners is spread over many tasks.
    """
    kept = materialise(pairs.withColumn("g", F.pmod(F.xxhash64("b"), F.lit(1 << 30))), "pairs")
    size = kept.groupBy("a").agg(F.ceil(F.count("*") / 16).cast("long").alias("groups"))
    bundles = max(1, kept.count() // 128)
    dealt = kept.join(size, "a").select("a", "b", F.pmod(F.xxhash64("a", F.pmod("g", "groups")), F.lit(bundles)).alias("g"))
    text = texts.select(F.col("rep"), "text")
    others = dealt.join(text.withColumnRenamed("rep", "b"), "b")
    hubs = dealt.select("a", "g").distinct().join(text.withColumnRenamed("rep", "a"), "a").select(F.col("a").alias("hub"), F.col("g").alias("part"), F.col("text").alias("hub_text"))

    def verify(hub: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if hub.empty or other.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        own = dict(zip(hub.hub.tolist(), _sets(hub.hub_text, k)))
        good = []
        for a, s in zip(other.a.tolist(), _sets(other.text, k)):
            both = len(np.intersect1d(own[a], s, assume_unique=True))
            good.append(100 * both >= least * (len(own[a]) + len(s) - both))
        return other.loc[good, ["a", "b"]]

    return hubs.groupBy("part").cogroup(others.groupBy("g")).applyInPandas(verify, "a long, b long")


def _sets(texts: pd.Series, k: int):
    """The shingles of each text, in order."""
    whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    for _, data, off in text_pieces(whole.slice(lo, _PIECE_DOCS) for lo in range(0, len(texts), _PIECE_DOCS)):
        cell, ptr = shingle_sets(data, off, k)
        yield from (cell[x:y] for x, y in zip(ptr[:-1], ptr[1:]))


def agreeing(star: DataFrame, reps: DataFrame, least: int, matches: int) -> DataFrame:
    """Pairs ``a, b`` of ``star`` whose sizes and signatures allow a link."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y, na, nb = (b.column(b.schema.get_field_index(c)) for c in ("sa", "sb", "na", "nb"))
                x, y = (v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for v in (x, y))
                na, nb = na.to_numpy(), nb.to_numpy()
                ok = (100 * np.minimum(na, nb) >= least * np.maximum(na, nb)) & ((x == y).sum(1) >= matches)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    left, right = (reps.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "ab")
    return star.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


#: Weight of the rows a group of Python rows holds on average; a row weighs one and one more for each 1024 shingles.
GROUP_WEIGHT = 4096


def possible_partners(star: DataFrame, root: DataFrame, reps: DataFrame, least: int, matches: int, chunk: int = 512) -> DataFrame:
    """``hub, i, j, c, rep, root, n, sig, g``: texts whose size and signature allow a link with a text of the same hub in another component.

    Two texts of one posting list are both partners of the list's smallest text, so the partners of each such hub hold all
    pairs there are; the hub's own pairs are decided before.  Hubs whose partners are all in one component are done.  The
    partners of the others are dealt into chunks ``c`` of bounded weight: a large component has chunks of its own, small ones
    share.  Every two chunks (i, j) that hold different components meet in one block.  Blocks are dealt to as many groups
    ``g`` as their rows need, so a group holds a bounded number of rows whatever the hub.  Texts are returned, never pairs.
    """
    weight = 1 + F.col("n") / 1024
    named = star.select(F.col("a").alias("hub"), F.col("b").alias("rep")).join(root.withColumnRenamed("node", "rep"), "rep", "left").select("hub", "rep", F.coalesce("root", "rep").alias("root"))
    split = named.groupBy("hub").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("hub")
    member = materialise(named.join(split, "hub").join(reps.select("rep", "n"), "rep").select("hub", "rep", "root", "n"), "partners")
    parts = member.groupBy("hub", "root").agg(F.sum(weight).alias("size"))
    small = parts.where(F.col("size") < chunk).groupBy("hub").agg(F.ceil(F.sum("size") / chunk).alias("p"))
    large = parts.where(F.col("size") >= chunk).select("hub", "root", F.ceil(F.col("size") / chunk).alias("q"), F.col("root").alias("owner"))
    own = F.xxhash64("hub", "owner", F.pmod(F.xxhash64("rep"), "q"))
    shared = F.xxhash64("hub", F.pmod(F.xxhash64("root"), "p"))
    dealt = member.join(large, ["hub", "root"], "left").join(small, "hub", "left").select("hub", "rep", "root", "n", "owner", F.when(F.col("owner").isNull(), shared).otherwise(own).alias("c"))
    dealt = materialise(dealt, "dealt")
    chunks = dealt.groupBy("hub", "c").agg(F.first("owner").alias("owner"), F.sum(weight).alias("size"))
    x, y = (chunks.select("hub", F.col("c").alias(v), F.col("owner").alias(f"o{v}"), F.col("size").alias(f"w{v}")) for v in "ij")
    meet = (F.col("i") < F.col("j")) & (F.col("oi").isNull() | F.col("oj").isNull() | (F.col("oi") != F.col("oj"))) | (F.col("i") == F.col("j")) & F.col("oi").isNull()
    blocks = x.join(y, "hub").where(meet).select("hub", "i", "j", (F.col("wi") + F.when(F.col("i") < F.col("j"), F.col("wj")).otherwise(0)).alias("size"))
    blocks = materialise(blocks, "blocks")
    total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0.0))).first()[0]
    sides = blocks.select("hub", "i", "j", F.col("i").alias("c")).union(blocks.where("i < j").select("hub", "i", "j", "j"))
    rows = dealt.select("hub", "rep", "root", "n", "c").join(sides, ["hub", "c"]).join(reps.select("rep", "sig"), "rep")
    rows = rows.select("hub", "i", "j", "c", "rep", "root", "n", "sig", F.pmod(F.xxhash64("hub", "i", "j"), F.lit(max(1, int(total // GROUP_WEIGHT)))).alias("g"))

    def hopeful(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["hub", "i", "j"]).reset_index(drop=True)
        use = [np.empty(0, np.int64), *[a + np.union1d(x, y) for a, x, y in _pairs(frame, frame.root.to_numpy(), least, matches)]]
        return frame.iloc[np.concatenate(use)]

    return rows.groupBy("g").applyInPandas(hopeful, "hub long, i long, j long, c long, rep long, root long, n long, sig array<int>, g long")


def _pairs(frame: pd.DataFrame, root: np.ndarray, least: int, matches: int):
    """For each hub and two chunks: the first row, and the pairs of rows of different ``root`` whose sizes and signatures allow a link."""
    sig, n, c = np.array(frame.sig.tolist(), np.int32), frame.n.to_numpy(), frame.c.to_numpy()
    key = frame[["hub", "i", "j"]].to_numpy()
    begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    for a, b in zip(begin.tolist(), np.append(begin[1:], len(n)).tolist()):
        out = []
        for lo in range(a, b, 64):
            hi = min(lo + 64, b)
            ok = (root[lo:hi, None] != root[None, a:b]) & (100 * np.minimum(n[lo:hi, None], n[None, a:b]) >= least * np.maximum(n[lo:hi, None], n[None, a:b]))
            if key[a, 1] != key[a, 2]:  # pairs within a chunk belong to its own block
                ok &= c[lo:hi, None] != c[None, a:b]
            x, y = np.nonzero(ok)
            x += lo - a
            x, y = x[y > x], y[y > x]
            for at in range(0, len(x), 1 << 15):
                xs, ys = x[at:at + (1 << 15)], y[at:at + (1 << 15)]
                hit = (sig[a + xs] == sig[a + ys]).sum(1) >= matches
                out.append((xs[hit], ys[hit]))
        if out and sum(len(x) for x, _ in out):
            yield a, np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def across(few: DataFrame, texts: DataFrame, k: int, least: int, matches: int) -> DataFrame:
    """Confirmed links ``a, b`` between different components, enough of them to connect all that are linked.

    ``few`` comes from ``possible_partners``; a group returns links, never pairs.
    """
    def link(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["hub", "i", "j"]).reset_index(drop=True)
        rep, ids, sets = frame.rep.to_numpy(), pd.factorize(frame.root)[0], list(_sets(frame.text, k))
        up = list(range(len(frame)))

        def top(v):
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v
        links = []
        for a, xs, ys in _pairs(frame, ids, least, matches):
            for x, y in zip((xs + a).tolist(), (ys + a).tolist()):
                if top(ids[x]) != top(ids[y]):
                    both = np.intersect1d(sets[x], sets[y], assume_unique=True).size
                    if 100 * both >= least * (len(sets[x]) + len(sets[y]) - both):
                        up[top(ids[x])] = top(ids[y])
                        links.append((rep[x], rep[y]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return few.join(texts, "rep").groupBy("g").applyInPandas(link, "a long, b long")


def groups(docs: DataFrame, k: int = 5, least: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id`` for each row of ``docs`` (doc_id, text).

    ``least`` is the similarity in per cent; ``text_key`` is ``xxhash64(text)``.
    """
    marked = materialise(marks(docs, k, coordinates), "marks")
    linked = marked.where((F.col("n") > 0) & (F.col("doc_id") != NULL_ID))
    first = linked.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "text_key")).alias("r"), F.first("sig").alias("sig"))
    reps = materialise(first.select("f1", "f2", "n", F.col("r.doc_id").alias("rep_id"), F.col("r.text_key").alias("rep_key"), F.xxhash64("f1", "f2", "n").alias("rep"), "sig"), "classes")
    posts = materialise(postings(reps, matches), "postings")
    hub = posts.groupBy("key").agg(F.min("rep").alias("a"))
    star = materialise(posts.join(hub, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "star")

    def read(wanted: DataFrame, *hint: str) -> DataFrame:
        """Texts of the classes ``wanted``, read again."""
        rows = wanted.join(reps.select("rep", F.col("rep_id").alias("doc_id"), F.col("rep_key").alias("text_key")), "rep")
        keyed = docs.withColumn("text_key", F.xxhash64("text")).join(rows.hint(*hint) if hint else rows, ["doc_id", "text_key"])
        return materialise(keyed.groupBy("doc_id", "text_key").agg(F.first("rep").alias("rep"), F.first("text").alias("text")).select("rep", "text"), "texts")

    # Only texts with a possible partner are read again.  A merge join at every size: its order serves the grouping after it.
    near = materialise(agreeing(star, reps, least, matches), "agreeing")
    texts = read(near.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "merge")
    links = materialise(confirmed(near, texts, k, least), "links-first")
    few = materialise(possible_partners(star, components(links), reps, least, matches), "possible")
    rest = materialise(few.select("rep").distinct().join(texts.select("rep"), "rep", "left_anti"), "rest")
    more = materialise(across(few, texts.unionByName(read(rest)), k, least, matches), "links-second")
    # An id with several texts ties their classes together.
    ids = marked.where((F.col("n") > 0) & (F.col("doc_id") != NULL_ID)).select("doc_id", F.xxhash64("f1", "f2", "n").alias("rep"))
    ties = ids.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc_id", "a")
    tied = ties.join(ids, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")
    root = components(links.unionByName(more).unionByName(tied))
    named = reps.select("rep", "rep_id").join(root.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "rep_id", F.coalesce("root", "rep").alias("root"))
    named = materialise(named, "named")
    smallest = named.groupBy("root").agg(F.min("rep_id").alias("component"))
    of_rep = named.join(smallest, "root").select("rep", "component")
    rows = marked.withColumn("rep", F.when((F.col("n") > 0) & (F.col("doc_id") != NULL_ID), F.xxhash64("f1", "f2", "n")))
    alone, grouped = rows.where("rep is null"), rows.where("rep is not null").join(of_rep, "rep")
    own = F.col("doc_id").alias("component_id")
    return (grouped.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
            .unionByName(alone.select("doc_id", "text_key", F.col("n").alias("n_shingles"), own)))


def one_of_each(docs: DataFrame, k: int = 5, least: int = 80) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text among its columns), one of each group: the smallest id, once if repeated.

    Of rows that repeat an id and its text the one with the smallest hash over all columns stays.  Rows with a null id, and
    texts without words, all stay.
    """
    plain = source(docs)
    found = groups(plain, k, least).where((F.col("doc_id") == F.col("component_id")) | (F.col("doc_id") == NULL_ID))
    key, text_key, size, nth, alone = apart(docs, "_id", "_key", "_n", "_nth", "_alone")
    kept = found.select("doc_id", "text_key", "n_shingles").distinct().select(F.col("doc_id").alias(key), F.col("text_key").alias(text_key), F.col("n_shingles").alias(size))
    row = docs.withColumns({key: F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)), text_key: F.xxhash64(docs["text"].cast("string"))})
    single = (F.col(size) == 0) | (F.col(key) == NULL_ID)
    whole = F.xxhash64(*[docs[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()])
    # A row that stays anyway is a group of its own.  As the rank is all that is asked for, Spark keeps one row of a group in
    # every task before it shuffles them.
    apiece = row.join(kept, [key, text_key]).withColumn(alone, F.when(single, F.monotonically_increasing_id()))
    rank = F.row_number().over(Window.partitionBy(key, text_key, alone).orderBy(whole))
    return apiece.withColumn(nth, rank).where(F.col(nth) == 1).select(*docs.columns)


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Two-word shingles, similarity of 80 per cent."""
    found = groups(source(docs_table(spark, sf_dir)), k=2, least=80)
    kept = (F.col("doc_id") == F.col("component_id")) | (F.col("doc_id") == NULL_ID)
    return restore_id(found.select("doc_id", "n_shingles", "component_id", kept.alias("kept")), "doc_id", "component_id")
