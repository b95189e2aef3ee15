"""Conversation repair and the prefix trie against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spanloom.llm import repair, trie
from spanloom.llm.queries import QUERIES

ROWS = "conv_id long, turn long, role string, text string"
GOOD = re.compile("(s?(ua)+)?")


def conversations(path, rows):
    kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
    pq.write_table(pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(kinds.items())}), f"{path}/conversations.parquet")


def order(r):
    return (r[0] is not None, r[0] or 0, r[1], r[2])


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = [" " if x is None else x for x in (role, text)]
        code = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out[conv] += [] if code == 0 else [(turn, "user" if code == 4 else role, text)] * (1 + (code == 3))
    return {c: sorted(v, key=order) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def ways(row, fault):
    extra = 3 * (fault == "truncated")
    return [("D", "", 4, [])] + ([] if fault in ("blank", "duplicate") else [
        ("K", row[1][:1] or "?", extra, [f"{row[1]}:{row[2]}"]), ("R", "u", 3 + extra, [f"user:{row[2]}"]), ("R", "a", 3 + extra, [f"assistant:{row[2]}"])])


INSERTS = [("I", "u", 3, ["user:"]), ("I", "a", 3, ["assistant:"])]


def cheapest(rows, found):
    """Plain recursion over what may come next: the rest of a conversation after the initials so far, at most two insertions in a row."""
    known = {}

    def rest(i, initials, inserted):
        key = (i, initials[-1:], len(initials) == 1, inserted)
        if key not in known:
            options = [(0, "", ())] if i == len(rows) and GOOD.fullmatch(initials) else []
            for letter, initial, cost, made in (ways(rows[i], found[i]) if i < len(rows) else []) + (INSERTS if inserted < 2 else []):
                then = initials + initial
                if GOOD.fullmatch(then) or GOOD.fullmatch(then + "a") or GOOD.fullmatch(then + "ua"):
                    more = rest(i + (letter != "I"), then, inserted + 1 if letter == "I" else 0)
                    if more:
                        options.append((cost + more[0], letter + more[1], (*made, *more[2])))
            known[key] = min(options, default=None)
        return known[key]

    cost, edits, made = rest(0, "", 0)
    return cost, edits, "\n".join(made)


def test_the_recursion_against_all_edits():
    """The expectation itself, held against every sequence of edits for up to two rows."""
    gap = [x for n in range(3) for x in itertools.product(INSERTS, repeat=n)]
    for roles in [("user",), ("assistant", "assistant"), ("system", "user"), ("tool", "user"), ("user", "assistant"), ("system", "assistant")]:
        for found in itertools.product(["", "blank", "truncated"], repeat=len(roles)):
            rows = [(i, r, f"t{i}.") for i, r in enumerate(roles)]
            best = None
            for pick in itertools.product(*[itertools.product(gap, ways(r, f)) for r, f in zip(rows, found)], gap):
                flat = [x for g, w in pick[:-1] for x in (*g, w)] + list(pick[-1])
                if GOOD.fullmatch("".join(x[1] for x in flat)):
                    got = (sum(x[2] for x in flat), "".join(x[0] for x in flat), "\n".join(y for x in flat for y in x[3]))
                    best = got if best is None or got < best else best
            assert cheapest(rows, found) == best


def expected(rows):
    out = {}
    for conv, part in damage(rows).items():
        found = faults(part)
        cost, audit, text = cheapest(part, found)
        turns = [t for t, _, _ in part if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(part, part[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[found.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def reported(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.fixture(scope="module")
def small():
    """Short conversations of odd turns, some without an id, a turn, a role or a text, with ties and repeated rows."""
    rnd, rows = random.Random(5), []
    for conv in range(150):
        for turn in range(rnd.randrange(1, 5)):
            role = rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "u", "", None])
            text = rnd.choice(["Yes.", "No!", "so", "what?  \n", " \t\x0b", "", None, "é…", "a. b", "Yes."])
            rows.append((conv if conv else None, None if rnd.random() < 0.05 else rnd.randrange(6) if rnd.random() < 0.2 else turn, role, text))
    return rows


@pytest.mark.parametrize("long, section", [(1 << 16, 1 << 15), (0, 2), (1, 1), (2, 100)])
def test_op11_against_all_edits(spark, small, long, section):
    turns = repair.damaged(spark.createDataFrame(small, ROWS))
    assert reported(repair.report(*repair.repair(turns, long, section))) == expected(small)


def test_op11_whole_and_cut_conversations_agree(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    one = table.selectExpr("conv_id % 2 AS conv_id", "conv_id * 10 + turn AS turn", "role", "text")
    both = [reported(repair.report(*repair.repair(repair.damaged(one), long, 5))) for long in (1 << 16, 3)]
    assert both[0] == both[1] and len(both[0]) == 2
    assert reported(QUERIES["op11_structure_repair"](spark, sf_dir)).keys() == {r[0] for r in table.select("conv_id").distinct().collect()}


def test_op11_memory_is_bounded():
    """Survivors of a long conversation coalesce; what is not emitted stays short."""
    search, held, rnd = repair.Survivors(), 0, random.Random(1)
    for i in range(20_000):
        resolved = search.step(repair._STEPS[rnd.choice("sua-"), rnd.choice(repair.FAULTS)], i)
        held += 1 - len(resolved)
        assert held < 60
    assert len(search.end()) >= held


def test_op11_does_not_copy_a_hot_row(spark):
    """A conversation of one row a hundred thousand times: all but the first are duplicates."""
    turns = spark.range(100_000).selectExpr("7L AS conv_id", "1L AS turn", "'user' AS role", "'Hi.' AS text", "1L AS copies")
    (row,) = repair.report(*repair.repair(turns, 1000, 1 << 15)).collect()
    assert (row.duplicate, row.cost, row.audit) == (99_999, 4 * 99_999 + 3, "K" + "D" * 99_999 + "I")


def lines(rows, rebuild=True):
    """Each conversation's (role, text) turns, rebuilt as the contract says."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in turns.items()}
    if not rebuild:
        return turns
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in turns}
    return {c: turns.get(c - c % 5, [])[:h[c]] + v[h[c]:] for c, v in turns.items()}


def nodes_of(turns):
    members = defaultdict(list)
    for c, v in turns.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, below = set(), {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, own + sum(below[k][1] for k in kids[p]))
        ends = ",".join(str(c) for c in sorted(members[p]) if len(turns[c]) == len(p))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(df):
    got = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(got) == len(set(got))
    return set(got)


def chatter(seed, n):
    """Conversations over few different turns, so that many share beginnings or are equal; some are long and alone."""
    rnd, rows = random.Random(seed), []
    for conv in range(n):
        rows += [(conv, t, rnd.choice(["user", "assistant"]) if t > 2 else "user", rnd.choice(["a", "é", "ccc"]) if t > 2 or conv % 3 else "a") for t in range(rnd.randrange(1, 9))]
        rows += [(conv, 100 + t, "user", "same" if t < 20 else f"{t} {conv % 2}") for t in range(30) if conv % 7 == 0]
    return rows + [(None, 1, "user", "x"), (10_001, None, None, None), (10_001, None, None, None), (10_001, None, "user", "b")]


@pytest.mark.parametrize("most, long", [(1 << 15, 1 << 20), (60, 4), (12, 0)])
def test_op13_against_all_prefixes(spark, tmp_path, most, long):
    rows = chatter(most, 120)
    turns = trie.numbered(spark.createDataFrame(rows, ROWS), long)
    again, every = trie.rebuilt(turns)
    assert nodes(trie.prefix_trie(again, every, most)) == nodes_of(lines(rows))
    if most == 60:
        assert nodes(trie.prefix_trie(turns, every, most)) == nodes_of(lines(rows, rebuild=False))


def test_op13_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(QUERIES["op13_prefix_trie"](spark, sf_dir)) == nodes_of(lines(rows))
