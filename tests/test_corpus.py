"""Sources, numbering, instances and harmonisation on small fixtures."""

import json

from pyspark.sql import functions as F

from spanloom import schema
from spanloom.ontology import Lookup, Ontology, starter_ontology
from spanloom.operators import assemble, harmonise, instances, parse, spans
from spanloom.plans import derived
from spanloom.sources import corpus as src

ONTO = starter_ontology()
DDL = f"dataset string, split string, doc_id string, sid long, {schema.CORPUS}"


def arg(**kw):
    return tuple(kw.get(f) for f in ("text", "span", "start", "end", "entity_id", "role", "role_type", "label"))


def doc(tokens, events, entities=(), dataset="m2e2", sid=1):
    return (dataset, "train", f"d{sid}", sid, tokens, events, list(entities))


def frame(spark, *docs):
    return spark.createDataFrame(list(docs), DDL)


def by_task(df):
    return {r.task: (r.input, r.output) for r in df.collect()}


CRANE = doc(["The", "crane", "collapsed", "and", "crushed", "two", "."], [
    ("e1", "Conflict:Attack", ("2", "3"), [arg(start="1", end="2", role="Instrument")]), (None, "Life:Die", ("4", "5"), [])])


def test_default_layout(spark):
    got = by_task(instances.build_expressive(frame(spark, CRANE), ONTO))
    assert got["trigger_identification"] == (
        "Domain: m2e2. Identify trigger words. The crane collapsed and crushed two.", "The crane trigger> collapsed> and trigger> crushed> two.")
    assert got["trigger_classification_pipeline"][1] == "collapsed=Conflict:Attack | crushed=Life:Die"
    assert got["event_extraction_e2e"][1] == "trigger>collapsed>=Conflict:Attack | argument>crane>=Instrument || trigger>crushed>=Life:Die"
    assert got["argument_identification_e2e"][1] == "argument>crane>=Instrument(Conflict:Attack)"
    assert got["argument_extraction_pipeline"] == (
        "Domain: m2e2. Extract arguments for a specific event. argument> Attacker | Target | Instrument | Place for trigger> collapsed>=Conflict:Attack: "
        "The crane collapsed and crushed two.",
        "trigger> collapsed>=Conflict:Attack: None=Attacker | None=Target | argument> crane>=Instrument | None=Place")
    assert set(got) == set(schema.TASKS)


def test_prompt_override_and_human_labels(spark):
    got = by_task(instances.build_expressive(frame(spark, CRANE), ONTO, human=True, prompts={"identify": "Find them."}))
    assert got["trigger_identification"][0] == "Domain: m2e2. Find them. The crane collapsed and crushed two."
    assert got["trigger_classification_e2e"][1] == "trigger> collapsed>=Conflict Attack | trigger> crushed>=Life Die"


def test_argument_text_cascade(spark):
    tokens = ["a", "b", "c", "d", "e"]
    entities = [("X", None, "bad", "2"), (None, "X", "1", "3")]
    args = [arg(text="t , u", role="R1"), arg(span="s", start="0", end="1", role="R2"), arg(start="0", end="2", role_type="R3"),
            arg(start="x", end="2", entity_id="X", label="R4"), arg(role="R5"), arg(start="-2", end="-1", role="")]
    en = spans.enrich(frame(spark, doc(tokens, [("e", "T", ("0", "1"), args)], entities))).select(F.explode("mentions").alias("m")).first().m
    assert [(a.text, a.role) for a in en.args] == [("t, u", "R1"), ("s", "R2"), ("a b", "R3"), ("b c", "R4"), (None, "R5"), ("d", "Unknown")]


def test_span_rules_and_clamped_types(spark):
    ev = [("a", "T1", ("1", "9"), []), ("b", "T2", ("1", "1"), []), ("c", "T3", ("x", "2"), []), ("d", "T4", ("7", "8"), []), ("e", "T5", ("1", "9"), []), ("f", "T6", None, [])]
    c = frame(spark, doc(["p", "q", "r"], ev))
    assert [(r.s, r.e, r.type) for r in spans.valid_spans(c).collect()] == [(1, 3, "T1"), (1, 3, "T5")]
    new = by_task(instances.build_expressive(c, ONTO, tasks=["trigger_classification_pipeline"]))
    old = by_task(instances.build_expressive(c, ONTO, tasks=["trigger_classification_pipeline"], compat=True))
    assert new["trigger_classification_pipeline"][1] == "q r=T1 | q r=T1" and old["trigger_classification_pipeline"][1] == "q r=Unknown | q r=Unknown"


def test_lookup_of_any_size(spark):
    for n in (0, 1, 20, 30_000):
        look = Lookup({f"k{i}\té": f"v{i}" for i in range(n)})
        df = spark.range(-5, n + 5, max(1, n // 50)).select("id", look(F.concat(F.lit("k"), F.col("id").cast("string"), F.lit("\té"))).alias("v"))
        assert all(r.v == (f"v{r.id}" if 0 <= r.id < n else None) for r in df.collect())


def test_large_ontology(spark):
    big = Ontology(type_map={"m2e2": [[f"T{i}", f"U{i}"] for i in range(30_000)]}, role_map={"m2e2": {"T7": {"A": "B", "a": "C"}}})
    e = ("e", "T7", ("0", "1"), [arg(text="a", role="A"), arg(text="a", role="a"), arg(text="a", role="x")])
    got = harmonise.remap_corpus(frame(spark, doc(["a"], [e, (None, "other", ("0", "1"), [])])), big).first()
    assert [m.event_type for m in got.event_mentions] == ["U7", "other"] and (got.mapped, got.unmapped) == (1, 1)
    assert [a.role for a in got.event_mentions[0].arguments] == ["B", "C", "x"]
    plan = harmonise.remap_corpus(frame(spark, doc(["a"], [])), big)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_tags(spark):
    """Spellings in turn; an empty tag counts as found under the exact or upper-case spelling, and the type is shown."""
    onto = Ontology(type_tags={"x": {"Aa": "", "bb": "", "BB": "Upper", "CC": "", "d_e": "Alt", "f": "low"}, "y": {"Zz": "Elsewhere", "Aa": "Other"}})
    want = {"Aa": "Aa", "Bb": "Upper", "cc": "cc", "d:e": "Alt", "F": "low", "Zz": "Elsewhere", "none": "none", "": "Unknown", None: "Unknown"}
    df = spark.createDataFrame([("x", k) for k in want], "dataset string, event_type string")
    got = harmonise.tag_types(df, onto)
    assert {r.event_type: r.tag for r in got.collect()} == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_unified_roles(spark):
    ev = spark.createDataFrame([("news", "conflict_Attack"), ("news", "other")], "domain string, event_type string")
    got = {r.event_type: r.roles for r in harmonise.roles_for_type(ev, ONTO, "domain", F.col("event_type"), F.array(F.lit("R")), unified=True).collect()}
    assert got["conflict_Attack"][0] == "Attacker" and got["other"] == ["R"]


def test_row_index_spreads_a_hot_group(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")))
    got = assemble.row_index(df, ["g"], "id", bits=4)
    want = {}
    for r in sorted(got.collect(), key=lambda r: r.id):
        assert r.idx == want.get(r.g, 0)
        want[r.g] = want.get(r.g, 0) + 1


def test_first_rows_of_hot_and_far_groups(spark):
    """Large ids, a group with most rows, groups of one row, ties in the first key; the rows themselves are not shuffled."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("g"),
        (F.col("id") * 7919 % 1000 + 100_000_000_000).alias("k"), F.col("id").alias("pos"), F.lit("wide").alias("text"))
    rows = [tuple(r) for r in df.collect()]
    for quota in (0.0, 0.1, 0.999, 1.0):
        got = assemble.prefix_fraction(df, quota, "k", ("g",), ("pos",))
        want = []
        for g in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
            want += own[:int(len(own) * quota)]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    heads = assemble.first_rows(df, ["g"], "k", lambda total: F.lit(7), ["pos"], bits=4).groupBy("g").count().collect()
    assert all(r["count"] == min(7, sum(x[0] == r.g for x in rows)) for r in heads) and len(heads) == len({r[0] for r in rows})


def test_large_document_ids(spark):
    docs = spark.createDataFrame([(10**11, "a b c\nd e f\n" + "x\n" * 100_001, "en"), (10**11 + 1, "g h", "en")], "doc_id long, text string, lang string")
    got = derived.sentences(docs).agg(F.count("*").alias("n"), F.countDistinct("sid").alias("ids"), F.min("sid").alias("least")).first()
    assert got.n == got.ids == 100_004 and got.least > 0


def test_fraction(spark):
    df = spark.range(10).withColumn("g", F.lit("x"))
    assert sorted(r.id for r in assemble.prefix_fraction(df, 0.25, "id", ("g",)).collect()) == [0, 1]
    assert assemble.amount_compat(df, 0.25, "id", ("g",)).count() == 12


def test_read_corpus(spark, tmp_path):
    root = tmp_path / "data" / "m2e2" / "split1"
    root.mkdir(parents=True)
    lines = [json.dumps({"tokens": [f"w{i}"], "event_mentions": [{"event_type": "T", "trigger": {"start": 0, "end": 1}}]}) for i in range(500)]
    (root / "train.json").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (root / "dev.json").write_text(lines[0] + "\n\n" + lines[1], encoding="utf-8")
    df = src.read_corpus(spark, str(tmp_path / "data"), ["m2e2", "rams"])
    rows = {(r.split, r.doc_idx): r.tokens[0] for r in df.collect()}
    assert rows == {**{("train", i): f"w{i}" for i in range(500)}, ("val", 0): "w0", ("val", 1): "w1"}
    assert src.read_corpus(spark, str(tmp_path / "data"), ["m2e2"], max_per_split=3).count() == 5
    assert src.read_corpus(spark, str(tmp_path / "data"), ["m2e2"], max_per_split=0).count() == 502
    assert src.read_corpus(spark, str(tmp_path / "data"), ["m2e2"], max_per_split=0, zero_is_all=False).count() == 0
    assert src.read_corpus(spark, str(tmp_path / "none"), ["m2e2"]).count() == 0


def test_read_result_array(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps([{"doc_id": "a", "trigger_identification": {"prediction": "x"}}, {"doc_id": "b"}]), encoding="utf-8")
    assert [r.doc_id for r in src.read_results(spark, str(p)).collect()] == ["a", "b"]


def test_ontology_file(spark, tmp_path):
    p = tmp_path / "o.json"
    p.write_text(json.dumps({"roles": {"d": {"T": ["R"]}}, "type_map": {"d": [["T", "U"], ["bad"], ["T", "V"]]}}), encoding="utf-8")
    o = Ontology.load(spark, str(p))
    assert list(o.type_map_rows()) == [("d", "T", "V")] and o.roles["d"]["T"] == ["R"]


def test_round_trip(spark):
    """Parsing what the end-to-end layout wrote gives the events back."""
    en = spans.enrich(frame(spark, CRANE))
    made = instances.build_expressive(frame(spark, CRANE), ONTO, tasks=["event_extraction_e2e"])
    got = made.join(en.select("doc_id", "plain"), "doc_id").select(F.explode(parse.serving_events(F.col("plain"), F.col("output"))).alias("e")).collect()
    assert [(r.e.trigger.text, r.e.trigger.type, [(a.text, a.role) for a in r.e.arguments]) for r in got] == [
        ("collapsed", "Conflict:Attack", [("crane", "Instrument")]), ("crushed", "Life:Die", [])]
