"""Long texts and many rows: what is linear or bounded stays so."""

import os
import time

import pytest
from pyspark.sql import functions as F

from spanloom.functions import offsets
from spanloom.functions.text import WS, ae_trigger
from spanloom.operators import parse, spans
from spanloom.operators.lexicon import Lexicon
from spanloom.plans.q_insights import _stream_in_order


def test_long_type_is_not_matched_by_recursion(spark):
    """A trigger text cut at its own ``=`` leaves the rest of a long line as the type."""
    tail = "ab:c " * 20_000
    row = spark.createDataFrame([(f"trigger> w = {tail}>=T: argument> x>=R",)], "p string").select(*ae_trigger(F.col("p"))).first()
    assert row[0] == "w" and row[1] == tail + ">=T"


def test_batches_of_several_files(spark):
    df = spark.range(3000).withColumnRenamed("id", "ord")
    stream = _stream_in_order(spark, "several", df, F.col("ord") % 3, 3, per_file=250)
    seen = []
    q = stream.writeStream.foreachBatch(lambda b, i: seen.append(tuple(
        b.withColumn("file", F.input_file_name()).agg(F.countDistinct("file"), F.collect_set(F.col("ord") % 3), F.count("*")).first()))).trigger(
        availableNow=True).start()
    q.awaitTermination()
    assert seen == [(4, [0], 1000), (4, [1], 1000), (4, [2], 1000)]


def test_spans_of_a_long_line(spark):
    """The filter on spans and the comparison of neighbours must not make the list again for each of its members."""
    n = 2500
    event = "array<struct<id:string,event_type:string,trigger:struct<start:string,end:string>,arguments:array<struct<text:string,span:string,start:string,end:string,entity_id:string,role:string,role_type:string,label:string>>>>"
    events = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        i.cast("string"), F.lit("T"), F.struct(i.cast("string"), (i + 1).cast("string")), F.array()))
    corpus = spark.range(1).select(
        F.lit("d").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("tokens"),
        events.cast(event).alias("event_mentions"), F.expr("cast(array() as array<struct<id:string,entity_id:string,start:string,end:string>>)").alias("entity_mentions"))
    start = time.time()
    row = spans.drop_no_trigger(corpus).select(F.size("uspans").alias("n"), spans.weave(F.col("tokens"), F.col("uspans"), lambda t, i: t).alias("w")).first()
    assert row.n == n and row.w.split(" ")[-1] == f"w{n - 1}"
    assert time.time() - start < 40


@pytest.mark.parametrize("n", [3, 1500])
def test_repeated_predictions(spark, n):
    """The k-th prediction of a word takes its k-th occurrence; of equal pairs the first class stays."""
    text = " ".join(["go", "gone"] * n)
    pred = " | ".join(["trigger> go>=A", "trigger> gone>=B"] * n + ["trigger> go>=C"])
    df = spark.createDataFrame([("Domain: d. Task. " + text, pred)], "s string, p string")
    start = time.time()
    row = df.select(parse.e2e_triggers(F.col("s"), F.col("p")).alias("x"), parse.classification_pairs(F.col("p")).alias("y")).first()
    gos = [x.start for x in row.x if x.text == "go"]
    at, want = -1, []
    for _ in gos:
        at = text.find("go", at + 1)
        want.append(17 + at)
    assert gos == want and [(y.text, y.type) for y in row.y] == [("go", "A"), ("gone", "B")]
    assert time.time() - start < 40


def test_arguments_of_many_triggers(spark):
    """A word is searched once for all triggers, and each trigger gets the nearest of its places."""
    n = 250
    text = " ".join(f"t{chr(97 + i % 26)}{i} arg" for i in range(n))
    trig = "array<struct<text:string,type:string,start:int,end:int>>"
    at = [text.index(f"t{chr(97 + i % 26)}{i} ") for i in range(n)]
    df = spark.createDataFrame([(text, [(text[a:].split(" ")[0], "T", a, a + len(text[a:].split(" ")[0]) - 1) for a in at], ["trigger> x>=T: argument> arg>=R | argument> none>=S"] * n)],
                               f"s string, t {trig}, p array<string>")
    start = time.time()
    got = df.select(parse.structure(F.col("s"), F.col("t"), F.col("p")).alias("e")).first().e
    for a, e in zip(at, got):
        assert [(x.role, x.start) for x in e.arguments] == [("R", text.index("arg", a) if a == 0 or text.index("arg", a) - e.trigger.end < a - (a - 4) else a - 4), ("S", None)]
    assert time.time() - start < 40


def test_lexicon_on_a_long_prompt(spark):
    """Every word known and an argument: the answer grows with the words, not with their square or cube."""
    n = 1500
    words = ["x" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(n)]
    rows = [(k, "d", "T" if k == "argument" else "", w, "T" if k != "argument" else "R", 2) for w in words[::2] for k in ("word", "whole")] + [("argument", "d", "T", words[1], "R", 2)]
    table = spark.createDataFrame(rows, "kind string, dataset string, type string, word string, label string, n long")
    body = " ".join(words)
    prompts = spark.createDataFrame([(0, "d", f"Domain: d. Identify trigger words. {body}"), (1, "d", f"domain: d. Event trigger and argument extraction. {body}"),
                                     (2, "d", f"Domain: d. Extract arguments for a specific event. argument> R for trigger> {words[0]}>=T: {body} {words[1]}")], "i int, model_key string, input string")
    start = time.time()
    got = {r.i: r.prediction for r in Lexicon(table).score_rows(prompts).collect()}
    assert got[0] == " ".join(f"trigger> {w}>" if i % 2 == 0 else w for i, w in enumerate(words))
    assert got[1] == " || ".join(f"trigger>{w}>=T | argument>{words[1]}>=R" for w in words[::2])
    assert got[2] == f"trigger> {words[0]}>=T: argument> {words[1]}>=R"
    assert time.time() - start < 40


def _detected(spark, merged):
    trigger = "array<struct<text:string,type:string,start:int,end:int>>"
    preds = (["trigger> ran>=Move: argument> the dog>=Agent | argument> dog>=Agent"], ["trigger> saw>=See: argument> it>=Theme", None])
    row = ("A dog ran; the dog saw it, and the dog ran.", [("ran", "Move", 6, 8)], [("saw", "See", 19, 21), ("ran", "Move", 38, 40)],
           [("ran", "Move", 6, 8), ("saw", "See", 19, 21)], *preds, preds[0] + preds[1] if merged is None else merged,
           "trigger>ran>=Move | argument>dog>=Agent || trigger>saw>=See | argument>it>=Theme")
    return spark.createDataFrame([row], f"source string, t_pipeline {trigger}, t_e2e {trigger}, t_merged {trigger}, ae_pipeline array<string>, "
                                 "ae_e2e array<string>, ae_merged array<string>, e2e_text string").repartition(2)


def test_modes_share_the_search_for_words(spark):
    """A word of a sentence is searched once for all modes, not once for each of them."""
    plan = parse.structure_modes(_detected(spark, None))._jdf.queryExecution().optimizedPlan().toString()
    alone = _detected(spark, None).select(offsets.word_positions(F.col("source"), F.col("e2e_text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<!") == alone.count("(?<!") > 0


@pytest.mark.parametrize("merged", [None, [], ["trigger> saw>=See: argument> it>=Theme"], [None, "trigger> ran>=Move: argument> dog>=Agent | argument> a cat>=Theme"]])
def test_modes_equal_each_mode_alone(spark, merged):
    d = _detected(spark, merged)
    alone = [parse.structure(F.col("source"), F.col(f"t_{m}"), F.col(f"ae_{m}")).alias(m) for m in parse.MODES]
    modes = [*parse.MODES, "complete_e2e"]
    assert parse.structure_modes(d).select(*modes).collect() == d.select(
        *alone, parse.serving_events(F.col("source"), F.col("e2e_text")).alias("complete_e2e")).collect()


def test_words_found_without_a_pattern(spark):
    """The paths for a text that holds a term once find what the pattern finds."""
    import re
    texts = ["a cat, cats a-b .x. x", "cat", "concat cat", "a-b", "-", " - a", "xx", "", "école cole", "x.x .x"]
    terms = ["cat", "a-b", "-", ".x", "x", "x.", "cole", "é", "a", "cats"]
    rows = [(t, w, at) for t in texts for w in terms for at in (0, 1, 4)]

    def expected(t, w):
        head, tail = ("(?<!\\w)" if re.match(r"\w", w) else "(?<=\\w)"), ("(?!\\w)" if re.search(r"\w$", w) else "(?=\\w)")
        return [m.start() for m in re.finditer(head + re.escape(w) + tail, t)]

    got = spark.createDataFrame(rows, "t string, w string, s int").select("t", "w", "s", offsets.word_positions(F.col("t"), F.col("w")).alias("all"), offsets.first_word_from(
        F.col("t"), F.col("w"), F.col("s")).alias("first"), offsets.nearest_substring(F.col("t"), F.col("w"), F.lit(3), F.lit(4)).alias("near")).collect()
    for r in got:
        assert r["all"] == expected(r.t, r.w), r
        assert r["first"] == next((p + r.s for p in expected(r.t[r.s:], r.w)), -1), r
        starts = [p for p in range(len(r.t)) if r.t.startswith(r.w, p)]
        before, after = [p for p in starts if p < 3], [p for p in starts if p > 4]
        side = (before[-1] if 3 - before[-1] <= after[0] - 4 else after[0]) if before and after else before[-1] if before else after[0] if after else starts[0] if starts else -1
        assert r["near"] == side, r


def test_blanks_of_every_kind(spark):
    """The faster form of the class holds the same characters."""
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF)
    row = spark.createDataFrame([(every,)], "c string").select(F.regexp_replace("c", WS, ""), F.regexp_replace("c", r"[\s\x1C-\x1F\x85\p{Z}]", "")).first()
    assert row[0] == row[1] and len(row[0]) < len(every)


def _lexicon_prompts(spark):
    entries = [("word", "d", "", "ran", "A: B", 2), ("whole", "d", "", "ran", "T", 1), ("word", "d", "", "saw", "T", 1), ("argument", "d", "A", "dog", "R", 2), ("argument", "d", "A", "B", "S", 2),
               ("argument", "d", "T", "dog", "R", 1), ("argument", "e", "T", "cat", "R", 1), ("word", None, "", "ran", "N", 9)]
    table = spark.createDataFrame(entries, "kind string, dataset string, type string, word string, label string, n long")
    leads = ["Identify trigger words. ", "Classify trigger types. trigger> saw> ", "Classify trigger types end-to-end. ", "Event trigger and argument extraction. ", "Identify potential arguments. ",
             "trigger words: ", "Extract arguments for a specific event. argument> R for trigger> ran>=T: ", "Extract arguments for a specific event. argument>  for trigger> ran>=A: B: ", "Nothing asked. "]
    prompts = [(f"{k}/{ds}", k, i, f"Domain: {ds}. {lead}The dog ran, a cat saw the dog; B ran.") for k in ("epoch/1", "epoch/2") for ds in ("d", "e", "x.y") for i, lead in enumerate(leads)]
    return table, spark.createDataFrame([*prompts, ("d", "k", -1, ""), ("d", "k", -2, None), (None, "k", -3, prompts[0][3])], "model_key string, k string, i int, input string")


def test_small_lexicon_answers_as_a_joined_one(spark, monkeypatch):
    """Both ways to look words up, for every task; the small one stores and shuffles nothing."""
    from spanloom.operators import lexicon
    table, prompts = _lexicon_prompts(spark)
    small = Lexicon(table).score_rows(prompts)
    assert "Exchange" not in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lexicon, "IN_ROW", 0)
    key = lambda r: (str(r.model_key), r.i)
    got = sorted(small.collect(), key=key)
    assert got == sorted(Lexicon(table).score_rows(prompts).collect(), key=key)
    said = {(r.model_key, r.i): r.prediction for r in got}
    assert said["epoch/1/d", 4] == "argument>dog>=R(A) | argument>dog>=R(T) | argument>B>=S(A)" and said["epoch/1/d", 5] == "ran | saw | ran" and said["epoch/2/d", 5] == "ran | ran"


def test_triggers_of_a_row_are_answered_as_their_prompts(spark):
    """The lists made in the row are what the model says to each extraction prompt; a text is not stored for each trigger."""
    from spanloom.functions.prompts import extraction_prompt
    from spanloom.operators.instances import PROMPTS  # noqa: F401
    from spanloom.ontology import starter_ontology
    table, _ = _lexicon_prompts(spark)
    trigger = "array<struct<text:string,type:string,start:int,end:int>>"
    text = "The dog ran, a cat saw the dog; B ran."
    ts = [("ran", "T", 0, 1), ("ran", "A: B", 0, 1), (None, "T", 0, 1), ("ran", "A", None, None)]
    rows = [(ds, "m", str(i), key, text if i else None, ts, ts[:1], [], "") for ds in ("d", "e", "x.y") for i, key in enumerate(("d", "d", "epoch/2/d"))]
    found = spark.createDataFrame(rows, f"dataset string, model_type string, doc_id string, model_key string, source string, t_pipeline {trigger}, t_e2e {trigger}, t_merged {trigger}, failed string")
    model, onto = Lexicon(table), starter_ontology()
    each = found.select("dataset", "doc_id", "model_key", "source", F.posexplode("t_pipeline").alias("pos", "t"))
    prompts = each.withColumn("input", extraction_prompt(onto, F.col("dataset"), F.col("t.text"), F.col("t.type"), F.col("source")))
    want = {}
    for r in model.score_rows(prompts).orderBy("pos").collect():
        want.setdefault((r.dataset, r.doc_id), []).append(r.prediction)
    got = model.score_triggers(found, onto, ["dataset", "doc_id"]).collect()
    assert {(r.dataset, r.doc_id): r.ae_pipeline for r in got} == want and any("dog" in p for p in want["d", "1"])
    assert all(r.ae_e2e == r.ae_pipeline[:1] and r.ae_merged == [] for r in got)
    assert {r._errors for r in got if r.dataset == "x.y" and r.source} == {"; ".join(["ValueError: a prompt of no known task"] * 4)}


def test_shared_tables_are_compressed(spark):
    """Texts that come again in other columns and rows take little room in the shared folder."""
    import glob
    import random
    from spanloom.session import materialise
    draw = random.Random(0)
    text = "".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(40_000))
    path = materialise(spark.createDataFrame([(text + str(i),) for i in range(10)], "c string").coalesce(1), "t").inputFiles()[0]
    assert sum(os.path.getsize(p) for p in glob.glob(path.removeprefix("file://"))) < 400_000


def test_sinks_are_compressed(spark, tmp_path):
    """S10 and S11 write compressed files that their readers read back."""
    from spanloom.operators.instances import COLUMNS
    from spanloom.sources import corpus as src
    rows = [tuple("x" if c != "seq" else i for c in COLUMNS) for i in range(50)]
    src.write_tasks(spark.createDataFrame(rows, ", ".join(f"{c} {'bigint' if c == 'seq' else 'string'}" for c in COLUMNS)), f"{tmp_path}/t")
    items = spark.createDataFrame([(str(i), "a b") for i in range(50)], "doc_id string, source string")
    src.write_results(items, f"{tmp_path}/r")
    for read in (src.read_tasks(spark, f"{tmp_path}/t"), src.read_results(spark, f"{tmp_path}/r", array=False)):
        assert read.count() == 50 and all(p.endswith(".gz") for p in read.inputFiles())


def test_sweep_takes_every_task(spark, tmp_path):
    """I2 scores the instances of all tasks under each epoch, not those of one task."""
    from spanloom.plans import catalog
    from spanloom.plans.q_corpus import expressive
    text = "\n".join(" ".join(f"{w}{chr(97 + i % 26)}" for w in ("attacked", "villages", "yesterday", "rebels", "marched") * 8) for i in range(6))
    spark.createDataFrame([(i, text, "en", "web", len(text)) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.epoch, r.task): r["count"] for r in catalog.QUERIES["i2_sweep"](spark, str(tmp_path)).groupBy("epoch", "task").count().collect()}
    assert got == {(e, r.task): r["count"] for r in expressive(spark, str(tmp_path)).groupBy("task").count().collect() for e in (1, 2)} and len(got) == 14
