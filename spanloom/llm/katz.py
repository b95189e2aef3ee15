"""Katz backoff language model over runs of up to three words, counted into stored tables and evaluated recursively.

Tokens of a text are its lower-cased words and one end; ends also stand before the first word.  With c the training counts, h a
history of n - 1 tokens and h' the history without its oldest token,

    P(w | h) = d_n(c(h w)) c(h w) / c(h)      if the run was seen
             = a(h) P(w | h')                 otherwise; without a history, P(w) = d_1(c(w)) c(w) / N, or P(unknown) if unseen,

d_n(r) is the Good-Turing discount of runs of n for r up to ``K`` (1 beyond) and a(h) makes the probabilities after h sum to 1
exactly, over all known words, the end and one unknown word; an unseen history has a(h) = 1.  Where counts of counts give no
discount between 0 and 1, d(r) = 1 - D / r with D = n1 / (n1 + 2 n2).  A history whose runs leave nothing to the unseen counts as
seen once more.

How it runs: texts are coded into blocks of about ``BLOCK_TOKENS`` tokens, each with its own vocabulary of word hashes (a
table in the shared folder).  There is a round for each length of run.  In it a block sends its distinct runs to the partitions
of their histories, and only to those, so there are never more messages than runs.  A partition adds up the counts, writes
them to the stored table of that length (``kind`` = -n, one row a partition: histories, next words, counts), and answers each
block with its runs' totals and its histories' sums.  The first round also gives every word a number, small for frequent words.
The runs of a hot history, one with more than a quarter of a partition's tokens, are dealt one by one; its sums are then added up
by a grouping of their own and joined to the blocks that have it.  In the last step a block evaluates its tokens, length after length, from the answers.  The
round of runs of n is done in n - 1 waves, each for its share of the partitions, and the shuffle files of a stored wave are removed,
so disk holds one wave's messages at a time.  Nothing is broadcast but the counts of counts, K + 3 numbers a length.  Partitions are as many as blocks, so a task holds about as much at
any size of the input.

Histories and runs are told apart by 64-bit hashes of their words' numbers, words by 64-bit hashes.

Defined cases: null text is empty (one token, the end); null ids are never held out and are learned from; repeated rows count
and are scored each; without training rows every token is unknown and has probability 1; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.words import docs_table, fold, ints, mix, restore_id, source, text_pieces, words_of
from spanloom.session import fresh_path, materialise

BLOCK_TOKENS = 1_500_000
ORDER = 3
K = 5
HOT = 1000  # kinds of rows about hot histories
END = np.uint64(0xE0D)  # not a value that ``mix`` gives a likely word
_COLUMNS = ["block", "part", "kind", "a", "b", "c", "stats"]
_ROW = "block long, part long, kind int, a binary, b binary, c binary, stats array<double>"


def _zip(x: np.ndarray) -> bytes:
    """Bytes of an array, equal places of the numbers side by side, compressed."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes(), 1)


def _unzip(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _join(*parts: bytes) -> bytes:
    return b"".join([np.array([len(parts), *map(len, parts)], "<i8").tobytes(), *parts])


def _split(b: bytes) -> list[bytes]:
    n = int(np.frombuffer(b, "<i8", 1)[0])
    edge = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(b, "<i8", n, 8))])
    return [b[x:y] for x, y in zip(edge[:-1], edge[1:])]


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..K) from counts of counts ``n[1..K+1]`` (``n[0]`` unused); d(0) is 1, the discount of counts beyond K."""
    d = np.ones(K + 1)
    n1 = n[1]
    plain = n1 / (n1 + 2 * n[2]) if n1 > 0 and n[2] > 0 else 0.5
    a = (K + 1) * n[K + 1] / n1 if n1 > 0 else 1.0
    for r in range(1, K + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] > 0 and a < 1 else 0.0
        d[r] = good if 0 < good < 1 else 1 - plain / r
    return d


def counts_of(c: np.ndarray) -> np.ndarray:
    return np.bincount(c[(c > 0) & (c <= K + 1)].astype(np.int64), minlength=K + 2).astype(float)


def kept(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What the discount leaves of each count."""
    return d[np.where(c <= K, c, 0).astype(np.int64)] * c


def left_over(d: np.ndarray, few: np.ndarray) -> np.ndarray:
    """What the discounts take, from how many runs have count 1..K (the last axis)."""
    return few @ ((1 - d[1:]) * np.arange(1, K + 1))


def named(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each history, given by its words' numbers."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mix(h + c + np.uint64(5))
    return h


class Block:
    """The tokens of some documents as numbers of the block's own vocabulary, frequent words first."""

    def __init__(self, row):
        self.ids, self.held, self.size = _unzip(row.ids, "<i8"), _unzip(row.held, "<u1"), _unzip(row.size, "<u4").astype(np.int64)
        self.vocab, self.code = _unzip(row.vocab, "<u8"), _unzip(row.code, "<u4").astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.learned = np.repeat(self.held == 0, self.size)
        self.end = int(np.flatnonzero(self.vocab == END)[0])
        # By length of run (index 0 is length 1): last words, histories, runs without the oldest token, each token's run, counts.
        self.w, self.history, self.low, self.run_of = [np.arange(len(self.vocab))], [None], [None], [self.code]
        self.seen = [np.bincount(self.code[self.learned], minlength=len(self.vocab))]

    def lengthen(self, order: int) -> None:
        """Distinct runs up to ``order``.  A history is a run one shorter, or (the number behind the last of them) the start."""
        while len(self.w) < order:
            before = np.empty_like(self.code)
            before[1:] = self.run_of[-1][:-1]
            before[self.first] = len(self.w[-1])
            key, at, of = np.unique(before << 32 | self.code, return_index=True, return_inverse=True)
            self.low.append(self.run_of[-1][at])
            self.w.append(key & 0xFFFFFFFF)
            self.history.append(key >> 32)
            self.run_of.append(of)
            self.seen.append(np.bincount(of[self.learned], minlength=len(key)))

    def histories(self, n: int, number: np.ndarray) -> list[np.ndarray]:
        """The words' numbers of all histories of runs of ``n``; the start is zeros."""
        zero = np.zeros(1, np.uint64)
        out = [np.append(number, zero)]
        for m in range(1, n - 1):
            out = [np.append(c[self.history[m]], zero) for c in out] + [np.append(number[self.w[m]], zero)]
        return out

    def shorter(self, n: int) -> np.ndarray:
        """For each history of runs of ``n``, the one without its oldest token; the start stays the start."""
        return np.append(self.low[n - 2], len(self.w[n - 3]))

    def word_part(self, parts: int) -> np.ndarray:
        return (mix(self.vocab + np.uint64(3)) % np.uint64(parts)).astype(np.int64)

    def part(self, n: int, parts: int, name: np.ndarray, number: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """A history's runs go to one partition, those of a hot one are dealt one by one."""
        h = name[self.history[n - 1]]
        return (np.where(hot[self.history[n - 1]], mix(h + mix(number[self.w[n - 1]])), h) % np.uint64(parts)).astype(np.int64)


def encode(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of ``docs`` (doc_id, held_out, text)."""
    def run(batches):
        held = []

        def flush():
            ids, out, size, h = (np.concatenate(x) for x in zip(*held))
            vocab, code, often = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            held.clear()
            cols = (_zip(ids.astype("<i8")), _zip(out.astype("<u1")), _zip(size.astype("<u4")), _zip(vocab[order]), _zip(rank[code]))
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), *[pa.array([c]) for c in cols]], ["block", "ids", "held", "size", "vocab", "code"])

        tokens = 0
        for rows, data, off in text_pieces(batches):
            w = words_of(data, off, lower=True)
            held.append((ints(rows, "doc_id"), ints(rows, "held_out"), np.diff(w.ptr) + 1, np.insert(w.hash, w.ptr[1:], END)))
            tokens += len(w.hash) + len(off) - 1
            if tokens >= block_tokens:
                yield flush()
                tokens = 0
        if held:
            yield flush()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "block long, ids binary, held binary, size binary, vocab binary, code binary")


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def _dealt(part: np.ndarray, parts: int):
    """``(partition, indexes)`` for each partition that has any, in their given order."""
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edge)).tolist():
        yield p, order[edge[p]:edge[p + 1]]


def word_questions(parts: int):
    def run(frames):
        for frame in frames:
            for row in frame.itertuples():
                b = Block(row)
                yield _rows([(row.block, p, 1, _zip(b.vocab[at]), _zip(b.seen[0][at].astype("<u4")), b"", []) for p, at in _dealt(b.word_part(parts), parts)])
    return run


def word_answers(parts: int):
    """The partition's words with their counts (kind -1), and for each block its words' counts and numbers (kind 1)."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame.part.iloc[0])
        words, counts = [_unzip(x, "<u8") for x in frame.a], [_unzip(x, "<u4") for x in frame.b]
        size = np.cumsum([0, *map(len, words)])
        word, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts)).astype("<i8")
        order = np.argsort(-total, kind="stable")
        number = np.empty(len(order), "<u8")
        number[order] = np.arange(len(order)) * parts + part + 1
        stats = [*counts_of(total), float(total.sum()), float((total > 0).sum())]
        out = [(-1, part, -1, _zip(word[order]), _zip(total[order]), b"", stats)]
        out += [(b, part, 1, _zip(total[inverse[x:y]]), _zip(number[inverse[x:y]]), b"", []) for b, x, y in zip(frame.block, size[:-1], size[1:])]
        return _rows(out)
    return run


class Known:
    """What a block has been told: totals of its runs and sums of its histories, by length of run (index 0 is length 1)."""

    def __init__(self, b: Block, answers: pd.DataFrame, parts: int, tokens: float, order: int):
        self.b, self.number = b, np.zeros(len(b.vocab), np.uint64)
        self.count, self.few, self.mass = [np.zeros(len(b.vocab), np.int64)], [None], [None]
        place = dict(_dealt(b.word_part(parts), parts))
        for r in answers[answers.kind == 1].itertuples():
            self.count[0][place[r.part]] = _unzip(r.a, "<i8")
            self.number[place[r.part]] = _unzip(r.b, "<u8")
        b.lengthen(order)
        for n in range(2, order + 1):
            self.columns = b.histories(n, self.number)
            name = named(self.columns)
            self.hot = self.before(n) * 4.0 * parts > tokens
            self.part = b.part(n, parts, name, self.number, self.hot)
            got = answers[answers.kind == n]
            if not len(got):  # this round is the one to ask
                return
            place = dict(_dealt(self.part, parts))
            count, few, mass = np.zeros(len(b.w[n - 1]), np.int64), np.zeros((len(name), K)), np.zeros(len(name))
            for r in got.itertuples():
                at = place[r.part]
                count[at] = _unzip(r.a, "<u4")
                h = np.unique(b.history[n - 1][at]) if r.b else []
                if len(h):
                    sums = _unzip(r.c, "<f8").reshape(K + 1, -1).T[_unzip(r.b, "<u4")]
                    few[h] += sums[:, :K]
                    mass[h] += sums[:, K]
            hot = np.flatnonzero(self.hot)
            hot = hot[np.argsort(name[hot])]
            for r in answers[answers.kind == HOT + n].itertuples():
                h = hot[np.searchsorted(name[hot], np.int64(r.part).view(np.uint64))]
                few[h], mass[h] = r.stats[:K], r.stats[K]
            self.count.append(count)
            self.few.append(few)
            self.mass.append(mass)

    def before(self, n: int) -> np.ndarray:
        """Counts of the histories of runs of ``n``; the start has one for each text, as has the end."""
        return np.append(self.count[n - 2], self.count[0][self.b.end])


def questions(n: int, parts: int, tokens: float, wave: int = 0, waves: int = 1):
    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        b = Block(next(block.itertuples()))
        known = Known(b, answers, parts, tokens, n)
        w, low, history = known.number[b.w[n - 1]], known.count[n - 2][b.low[n - 1]], b.history[n - 1]
        flag = known.hot.astype(np.uint8)  # 0: not hot, 1: hot, 2: hot, and this is the block's first run of it
        begins = np.append(True, history[1:] != history[:-1])
        out = []
        for p, at in _dealt(known.part, parts):  # still in order of history
            if p % waves != wave:
                continue
            first = np.flatnonzero(np.append(True, history[at][1:] != history[at][:-1]))
            h = history[at[first]]
            out.append((int(block.block.iloc[0]), p, n, _join(*[_zip(c[h]) for c in known.columns]),
                        _join(_zip(np.diff(np.append(first, len(at))).astype("<u4")), _zip(w[at]), _zip(b.seen[n - 1][at].astype("<u4")), _zip(low[at].astype("<u8"))),
                        _zip(flag[h] * (1 + begins[at[first]]).astype(np.uint8)), []))
        return _rows(out)
    return run


def answers_of(n: int, d_low: np.ndarray):
    """The partition's runs with their counts (kind -n), and for each block (kind n) the totals of its runs and, for each of its
    histories, how many runs have count 1..K and what the shorter runs of its seen runs keep of their counts.  Of hot histories
    these sums are rows of their own (kind HOT + n, the hash in ``part``), and so are the blocks that want them (kind HOT - n)."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame.part.iloc[0])
        names = [np.concatenate(c) for c in zip(*[[_unzip(x, "<u8") for x in _split(a)] for a in frame.a])]
        told = [[_unzip(x, k) for x, k in zip(_split(b), ("<u4", "<u8", "<u4", "<u8"))] for b in frame.b]
        size, heads = np.cumsum([0, *[len(t[1]) for t in told]]), np.cumsum([0, *[len(t[0]) for t in told]])
        follow, w, seen, low = (np.concatenate(x) for x in zip(*told))
        del told
        flag = np.concatenate([_unzip(x, "<u1") for x in frame.c])
        history, head, history_of = np.unique(named(names), return_index=True, return_inverse=True)
        h = np.repeat(history_of, follow)
        _, first, inverse = np.unique(mix(mix(history)[h] + w), return_index=True, return_inverse=True)
        total = np.bincount(inverse, seen, len(first)).astype(np.int64)
        of = h[first]
        mass = np.bincount(of, np.where(total > 0, kept(d_low, low[first]), 0), len(history))
        sums = np.stack([*[np.bincount(of[total == r], minlength=len(history)) for r in range(1, K + 1)], mass], 1)
        at = np.flatnonzero(total > 0)
        at = at[np.lexsort((w[first[at]], of[at]))]
        some, start = np.unique(of[at], return_index=True)
        out = [(-1, part, -n, _join(*[_zip(c[head[some]]) for c in names]), _join(_zip(np.diff(np.append(start, len(at))).astype("<u4")), _zip(w[first[at]]), _zip(total[at].astype("<u8"))),
                b"", list(counts_of(total)))]
        name = history.view(np.int64)
        out += [(-1, int(name[x]), HOT + n, b"", b"", b"", sums[x].tolist()) for x in np.flatnonzero(flag[head]).tolist()]
        sums[flag[head] > 0] = 0
        # Most histories have one of few different sums; each is sent as a number in the message's list of those, frequent ones first.
        _, one, kind, often = np.unique(named(list(sums.view(np.uint64).T)), return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        sums, rank = sums[one[order]], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        kind = rank[kind]
        for i, b in enumerate(frame.block):
            mine = history_of[heads[i]:heads[i + 1]]
            used, mine_kind = np.unique(kind[mine], return_inverse=True)
            out.append((b, part, n, _zip(total[inverse[size[i]:size[i + 1]]].astype("<u4")), _zip(mine_kind.astype("<u4")), _zip(sums[used].T.ravel()), []))
            out += [(b, int(name[x]), HOT - n, b"", b"", b"", []) for x in mine[flag[heads[i]:heads[i + 1]] == 2].tolist()]
        return _rows(out)
    return run


def scores(order: int, parts: int, stats: list[list[float]]):
    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        b = Block(next(block.itertuples()))
        tokens, distinct = stats[0][K + 2:]
        known = Known(b, answers, parts, tokens, order)
        c, d = known.count[0], discounts(np.array(stats[0]))
        left = float(left_over(d, np.array(stats[0][1:K + 1])))
        of_all = tokens if left > 0 else tokens + 1
        p = np.where(c > 0, kept(d, c) / of_all, (left if left > 0 else 1.0) / of_all if tokens else 1.0)
        whole = None
        for n in range(2, order + 1):
            c, d, total, h = known.count[n - 1], discounts(np.array(stats[n - 1])), known.before(n), b.history[n - 1]
            left = left_over(d, known.few[n - 1])
            shorter = of_all if n == 2 else whole[b.shorter(n)]
            whole = np.where(left > 0, total, total + 1).astype(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                back = np.where(total > 0, np.where(left > 0, left, 1.0) / whole / (1 - known.mass[n - 1] / shorter), 1.0)
            p = np.where(c > 0, kept(d, c) / whole[h], back[h] * p[b.low[n - 1]])
        base = np.log10((known.count[0] + 0.1) / (tokens + 0.1 * (distinct + 1)))
        return pd.DataFrame({
            "doc_id": b.ids, "held_out": b.held != 0, "n_tokens": b.size, "n_known": np.add.reduceat((known.count[0] > 0)[b.code].astype(np.int64), b.first),
            "train_tokens": int(tokens), "base_score": np.add.reduceat(base[b.code], b.first), "score": np.add.reduceat(np.log10(p)[b.run_of[order - 1]], b.first)})
    return run


@contextmanager
def _released(spark):
    """Shuffle files go when the query that wrote them has ended; all that is read again here is stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def count_round(n: int, waves: list[DataFrame], answer, parts: int) -> DataFrame:
    """One round's answers and counts, stored by wave, kind and partition."""
    spark = waves[0].sparkSession
    path = fresh_path(spark, f"grams{n}")
    with _released(spark):
        for i, asked in enumerate(waves):
            asked.repartition(parts, "part").groupBy("part").applyInPandas(answer, _ROW).write.partitionBy("kind").mode("errorifexists").parquet(f"{path}/wave={i}")
    return spark.read.schema(_ROW + ", wave int").parquet(path).select(*_COLUMNS)


def statistics(stored: DataFrame, n: int, size: int) -> list[float]:
    """Sums of the partitions' statistics: ``size`` numbers, whatever the input."""
    found = stored.where(F.col("kind") == -n).select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = [0.0] * size
    for r in found:
        out[r.i] = r.x
    return out


def sums_of_hot(stored: DataFrame, n: int) -> DataFrame:
    """Each hot history's sums over all partitions, for each block that wants them."""
    sums = stored.where(F.col("kind") == HOT + n).groupBy("part").agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(K + 1)]).alias("stats"))
    return stored.where(F.col("kind") == HOT - n).drop("stats").withColumn("kind", F.lit(HOT + n)).join(sums, "part").select(*_COLUMNS)


def score(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, order: int = ORDER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs`` (doc_id, held_out, text)."""
    blocks = materialise(encode(docs, block_tokens), "blocks")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.count())
    by_block = blocks.repartition(parts, "block").groupBy("block")
    stored = [count_round(1, [blocks.mapInPandas(word_questions(parts), _ROW)], word_answers(parts), parts)]
    stats = [statistics(stored[0], 1, K + 4)]
    told = stored[0].where("kind = 1")
    for n in range(2, order + 1):
        both = by_block.cogroup(told.repartition(parts, "block").groupBy("block"))
        asked = [both.applyInPandas(questions(n, parts, stats[0][K + 2], i, n - 1), _ROW) for i in range(n - 1)]
        stored.append(count_round(n, asked, answers_of(n, discounts(np.array(stats[-1]))), parts))
        stats.append(statistics(stored[-1], n, K + 2))
        if n < order:  # the next round needs the totals only
            told = told.unionByName(stored[-1].where(F.col("kind") == n).withColumns({"b": F.lit(b""), "c": F.lit(b"")}))
    told = stored[0].where("kind = 1")
    for n in range(2, order + 1):
        told = told.unionByName(stored[n - 1].where(F.col("kind") == n)).unionByName(sums_of_hot(stored[n - 1], n))
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_block.cogroup(told.repartition(parts, "block").groupBy("block")).applyInPandas(scores(order, parts, stats), ddl)


def op2_katz_backoff(spark, sf_dir: str) -> DataFrame:
    """Rows whose crc32(doc_id as text) mod 10 is 0 are scored but not learned from."""
    docs = source(docs_table(spark, sf_dir))
    return restore_id(score(docs.withColumn("held_out", F.coalesce(fold("doc_id", 10) == 0, F.lit(False)))))
