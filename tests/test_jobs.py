"""Review, insights, ingestion, scoring and streaming on small fixtures."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.ontology import starter_ontology
from spanloom.operators import insights, parse, review, scoring
from spanloom.plans import derived
from spanloom.plans.standins import RuleClient, RuleScorer
from spanloom.session import fresh_path
from spanloom.sources import corpus as src
from spanloom.sources import documents as docs
from spanloom.sources import stored
from spanloom.streaming import jobs

ONTO = starter_ontology()


def test_false_positive_forms_agree(spark, sf_dir):
    """The in-row form and the join form name the same arguments, none of them in the references."""
    o = derived.outputs(spark, sf_dir)
    a = review.fp_records(o, "ae_pipeline", "t", "m").select("doc_id", F.col("argument_text").alias("text"), F.col("argument_role").alias("role"))
    b = review.false_positives(o, "ae_pipeline").select("doc_id", "text", "role")
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.join(review.reference_set(o), ["doc_id", "text", "role"], "left_semi").count() == 0


def test_review_in_the_row(spark, sf_dir):
    """Lists with gaps lose only the gaps, equal ids of two splits stay apart, no text is shuffled, a stored parse is shown first."""
    text = "The army attacked the town today ."
    wrong, right = "trigger> attacked >= Attack: argument> army >= Attacker", "trigger> attacked >= Attack: argument> town >= Target"
    items = spark.createDataFrame(
        [("d", "train", "1", text, [wrong, None, right], [right]), ("d", "dev", "1", text, [right, wrong], [wrong]), ("d", "dev", "2", text, None, [right]), ("e", "dev", "3", text, [wrong], None)],
        "dataset string, split string, doc_id string, source string, p array<string>, ae_refs array<string>")
    fps = review.false_positives(items, "p")
    pairs = {(r.split, r.doc_id, r.text, r.role) for r in review.predicted_arguments(items, "p").collect()}
    known = {(r.split, r.doc_id, r.text, r.role) for r in review.reference_set(items).collect()}
    assert len(pairs) == 5 and len(known) == 3
    assert {(r.split, r.doc_id, r.text, r.role) for r in fps.collect()} == pairs - known
    assert "Exchange" not in fps._jdf.queryExecution().executedPlan().toString()
    got = {r.dataset: (r.tp, r.fp, r.fn) for r in review.match_counts(items, "p").collect()}
    same = lambda s, ds: sum(1 for x in s if (x[1] == "3") == (ds == "e"))
    assert got == {ds: (same(pairs & known, ds), same(pairs - known, ds), same(known - pairs, ds)) for ds in "de"}
    plain, apart = (review.fp_records(items, "p", "t", "m", by_split=b).collect() for b in (False, True))
    assert len({r.fp_id for r in plain}) == 2 and {r.fp_id for r in apart} == {"d-train-t-1-0", "d-dev-t-1-0", "e-dev-t-3-0"}
    for r in apart:
        assert [(e.trigger.text, e.trigger.type, e.trigger.start, [(a.text, a.role, a.start) for a in e.arguments]) for e in r.parsed_prediction] == [
            (r.trigger_text, r.trigger_type, None, [(r.argument_text, r.argument_role, r.argument_start)])]
    shown = parse.detect(derived.outputs(spark, sf_dir).limit(2))
    event = review.fp_records(items, "p", "t", "m").where("dataset = 'e'").select("parsed_prediction")
    both = shown.join(event).unionByName(shown, allowMissingColumns=True)
    out = parse.review_preview(both).select("doc_id", "parsed_prediction", "preview").collect()
    live = {r.doc_id: r.preview for r in parse.review_preview(shown).collect()}
    assert len(out) == 4 and all(r.preview == (live[r.doc_id] if r.parsed_prediction is None else r.parsed_prediction) for r in out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60)), st.one_of(st.none(), st.integers(1, 7)), st.integers(1, 200))
def test_length_batches(lengths, batch, budget):
    got = scoring.length_batches(lengths, batch, budget)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert all(len(b) == 1 or len(b) * max(lengths[i] for i in b) <= budget for b in got)
    assert all(len(b) <= (batch or len(b)) for b in got)
    flat = [(lengths[i], i) for b in got for i in b]
    assert flat == sorted(flat)


def test_scoring_by_length(spark):
    """Little is padded, the budget holds, every prompt keeps its own prediction in the order of the rows."""
    class Padding:
        """Tells each prompt's own words and the words its batch is padded to."""

        def __init__(self, key):
            pass

        def score(self, texts):
            size = [min(len(t.split()), 512) for t in texts]
            return [f"{t[:6]} {n} {max(size)} {len(texts)}" for t, n in zip(texts, size)]

    words = [1 + (i * 7919) % 600 for i in range(2000)]
    prompts = spark.createDataFrame([(i, "m", f"{i:06d}" + " w" * (n - 1)) for i, n in enumerate(words)], "id long, model_key string, input string").coalesce(1)
    rows = scoring.batch_score(prompts, Padding, budget=4096).collect()
    assert [r.id for r in rows] == list(range(2000)) and all(r.error is None for r in rows)
    got = [r.prediction.split() for r in rows]
    assert all(g[0] == f"{i:06d}" and int(g[1]) == min(words[i], 512) for i, g in enumerate(got))
    assert all(int(g[2]) * int(g[3]) <= 4096 for g in got)
    padded = sum(int(g[2]) for g in got)
    assert 1 - sum(int(g[1]) for g in got) / padded < 0.05
    assert max(int(g[3]) for g in got) > 16  # short prompts fill a batch by tokens, not by rows
    sixteen = [r.prediction.split() for r in scoring.batch_score(prompts, Padding).collect()]
    assert max(int(g[3]) for g in sixteen) == 16 and [g[:2] for g in sixteen] == [g[:2] for g in got]


def test_decisions(spark):
    log = spark.createDataFrame(
        [("a", "uncertain", "2024-01-01"), ("a", "true_false_positive", "2024-01-02"), ("b", "uncertain", "2024-01-01")], "fp_id string, decision string, t string"
    ).select("fp_id", "decision", F.lit("").alias("notes"), F.lit(True).alias("schema_checked"), F.lit("r").alias("reviewer"), F.col("t").cast("timestamp").alias("timestamp"))
    recs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "fp_id string, k long").withColumn("dataset", F.lit("d"))
    got = {r.fp_id: (r.decision, r.schema_checked) for r in review.attach_decisions(recs, log).collect()}
    assert got == {"a": ("true_false_positive", True), "b": ("uncertain", True), "c": (None, False)}
    assert tuple(review.progress(recs, log).first()) == (2, 3)
    nav = {r.fp_id: (r.cursor, r.previous, r.next) for r in review.navigation(recs, ["dataset"], "k").collect()}
    assert nav == {"a": (0, 0, 1), "b": (1, 0, 2), "c": (2, 1, 2)}


def test_decisions_of_one_time(spark):
    """Of two decisions with one timestamp the one that was saved last is the newest."""
    rows = [("a", "uncertain", "2024-01-01", "2024-01-03"), ("a", "true_false_positive", "2024-01-01", "2024-01-04"), ("a", "true_positive_missing_gold", "2024-01-01", "2024-01-02")]
    log = spark.createDataFrame(rows, "fp_id string, decision string, timestamp string, saved_at string")
    log = log.select("fp_id", "decision", F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("saved_at").cast("timestamp").alias("saved_at"))
    assert [r.decision for r in review.latest_decisions(log).collect()] == ["true_false_positive"]
    assert review.latest_decisions(log).columns == log.columns


def test_upsert(spark):
    ddl = "result_key string, doc_id string, dataset string, model_type string, source string, value int, ord long"
    old = spark.createDataFrame([("k1", "d", "x", "m", "s", 1, 0), ("k2", "d", "x", "m", "s", 2, 1), (None, "d", "x", "m", "a  b", 3, 2)], ddl)
    new = spark.createDataFrame([("k1", "d", "x", "m", "s", 9, 0), ("d::x::m::a b", "d", "x", "m", "z", 8, 1)], ddl)
    got = {r.result_key: (r.value, r.first_batch, r.first_ord) for r in insights.upsert_runs(old, new).collect()}
    assert got == {"k1": (9, 0, 0), "k2": (2, 0, 1), "d::x::m::a b": (8, 0, 2)}
    again = insights.upsert_runs(old, old)
    assert again.count() == 3


def test_merge_compat(spark):
    """Duplicates inside one list can hide a difference when sizes are compared (Q13)."""
    def arr(*ts):
        return F.array(*[F.struct(F.lit(t).alias("text"), F.lit("T").alias("type"), F.lit(i).alias("start"), F.lit(i).alias("end")) for t, i in ts])
    a, b = arr(("A", 1), ("A", 1)), arr(("B", 2))
    r = spark.range(1).select(parse.merge_triggers(a, b).alias("new"), parse.merge_triggers(a, b, compat=True).alias("old")).first()
    assert [x.text for x in r.new] == ["A", "B"] and r.old == []


def test_annotated_documents(spark):
    ddl = "doc_id string, source string, dataset string, save_ord int, modes struct<n:int>, complete array<int>"
    saves = spark.createDataFrame([
        ("d", "s", "g", 1, (1,), []), ("d", "s", "g", 2, (2,), []), ("d", "s", "g", 3, None, [7]), ("d", "s", "h", 1, (5,), None), ("", "s", "g", 1, (1,), []), ("e", "s", "g", 1, None, [])], ddl)
    r = insights.annotated_documents(saves).collect()
    assert len(r) == 1 and {k: v.n for k, v in r[0].events.items()} == {"g": 2, "h": 5} and r[0].complete_e2e == {"g": [7]}


def test_saved_document_shape(spark, tmp_path):
    from spanloom.schema import ANNOTATED
    ev = {"trigger": {"text": "b", "type": "T", "offset": [1, 1]}, "arguments": [{"text": "zz", "role": "R", "offset": []}]}
    p = tmp_path / "a.json"
    p.write_text(json.dumps({"doc_id": "1", "source": "abc", "events": {"geneva": {"pipeline": {"doc_id": "", "source": "abc", "events": [ev]}}}, "complete_e2e": {}}), encoding="utf-8")
    r = spark.read.schema(ANNOTATED).json(str(p)).select(parse.import_events(F.col("events")["geneva"]["pipeline"]["events"]).alias("e")).first().e[0]
    assert (r.trigger.start, r.trigger.end, r.arguments[0].start) == (1, 1, None)


def test_uploads(spark):
    rows = [("w", '{"documents": [{"doc_id": "a", "text": "x"}, {"text": "y"}, {"id": "b", "doc_id": "c", "text": "z"}]}'),
            ("l", '{"text": "x"}\n{"id": "q", "text": "y"}'), ("m", '{"documents": [{"text": "x"}, {"id": 1}]}'), ("e", '{"documents": []}'), ("n", "[]")]
    good, bad = docs.strict(spark.createDataFrame(rows, "upload string, content string"))
    assert sorted((r.upload, r.pos, r.id, r.text) for r in good.collect()) == [
        ("l", 0, "doc_0", "x"), ("l", 1, "q", "y"), ("w", 0, "a", "x"), ("w", 1, "doc_1", "y"), ("w", 2, "b", "z")]
    assert sorted(r.upload for r in bad.collect()) == ["e", "m", "n"]
    loose = [("a", '["x", 3, {"id": "q", "sentence": "y"}]'), ("b", '{"z": "t", "b": {"content": "u"}}'), ("c", '{"text": "v", "data": {}}'), ("d", "not json"), ("e", '{"x": 1} {"text": "2"}')]
    ups = docs.concatenated(spark.createDataFrame(loose, "upload string, content string"))
    got = sorted((r.upload, r.pos, r.doc_id, r.text) for r in docs.normalised(docs.lenient(ups)).collect())
    assert got == [("a", 0, "doc-1", "x"), ("a", 1, "q", "y"), ("b", 0, "z", "t"), ("b", 1, "b", "u"), ("c", 0, "doc-1", "v"), ("e", 0, "doc-1", ""), ("e", 1, "doc-2", "2")]


def test_scoring(spark):
    class Odd:
        def __init__(self, key):
            self.key = key

        def score(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [f"{self.key}:{t}" for t in texts]

    df = spark.createDataFrame([("m1", "a"), ("m2", "bad"), ("m1", ""), ("m2", "c")], "model_key string, input string").coalesce(1)
    got = {r.input: (r.prediction, r.error) for r in scoring.batch_score(df, Odd).collect()}
    assert got == {"a": ("m1:a", None), "bad": ("", "RuntimeError: no"), "": ("", None), "c": ("m2:c", None)}


def test_chain(spark):
    d = spark.createDataFrame([("geneva", "x", "1", "Marseille expects shipments of dehydrated apricots"), ("m2e2", "cross-domain", "2", "no words here")],
                              "dataset string, model_type string, doc_id string, source string")
    got = {r.doc_id: r for r in scoring.chain(d, ONTO, RuleScorer).collect()}
    one = got["1"]
    assert [e.trigger.text for e in one.pipeline] == ["Marseille", "shipments", "dehydrated"] and [e.trigger.text for e in one.e2e] == ["shipments", "dehydrated"]
    assert one.merged == [] and one.pipeline[1].arguments[0].text == "Marseille expects" and one.pipeline[1].trigger.start == 18
    assert got["2"].pipeline == [] and got["2"].complete_e2e == [] and one.failed == ""


def test_two_stage(spark):
    d = spark.createDataFrame([("1", "geneva", "word two")], "doc_id string, dataset string, text string")
    r = scoring.two_stage(d, ONTO, RuleClient, pos=True, dep=True).first()
    assert r.event_labels == ["Achieve"] and r.triggers == [["word", "Achieve"]] and r.entities == [] and r.pos == [] and r.dependencies == [] and not r.failed


def in_order(spark, df, batches):
    """A stream that reads one file after the other: the rows of each of the conditions."""
    path = fresh_path(spark, "in")
    for where in batches:
        df.where(where).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), path


def test_stream_equals_batch(spark, sf_dir):
    """Late and unordered batches give the newest run and the first place of each key, as one batch does."""
    ev = derived.table(spark, sf_dir, "events").select(
        F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("result_key"), F.col("event_id").alias("ord"), "value", F.col("ts").cast("timestamp").alias("ts"),
        F.array(F.struct("props")).alias("nested"))
    stream, path = in_order(spark, ev, ["ord % 3 = 2", "ord % 3 = 0", "ord % 3 = 1 AND ord > 500"])
    out, ck = (fresh_path(spark, n) for n in ("out", "ck"))
    jobs.upsert_state(stream, out, ck, buckets=8).awaitTermination()

    def batch(rows):
        g = rows.groupBy("result_key").agg(F.max_by(F.struct("value", "ts", "nested"), "ord").alias("r"), F.max("ord").alias("ord"), F.min("ord").alias("first_ord"))
        return sorted(g.select("result_key", "ord", "first_ord", "r.*").collect())

    assert sorted(stored.read(spark, out).select("result_key", "ord", "first_ord", "value", "ts", "nested").collect()) == batch(ev.where("ord % 3 <> 1 OR ord > 500"))
    # A restart goes on from its state: earlier runs that come now move the first places only.
    ev.where("ord % 3 = 1 AND ord <= 500").coalesce(1).write.mode("append").parquet(path)
    jobs.upsert_state(stream, out, ck, buckets=8).awaitTermination()
    assert sorted(stored.read(spark, out).select("result_key", "ord", "first_ord", "value", "ts", "nested").collect()) == batch(ev)


def test_first_runs_forget_old_keys(spark):
    """The first run of each key stays; the state falls when the watermark passes; a key that comes back later is new."""
    ev = spark.range(600).select(F.format_string("k%d", F.col("id") % 50 + F.floor(F.col("id") / 200) * 50).alias("result_key"), F.col("id").alias("ord"),
                                 F.timestamp_seconds(1_700_000_000 + F.floor(F.col("id") / 200) * 86_400 + F.col("id") % 200).alias("ts"))
    back = spark.createDataFrame([("k0", 600)], "result_key string, ord long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + 3 * 86_400)))
    stream, _ = in_order(spark, ev.unionByName(back), ["ord < 200", "ord >= 200 AND ord < 400", "ord >= 400 AND ord < 600", "ord = 600"])
    out, ck = (fresh_path(spark, n) for n in ("out", "ck"))
    q = jobs.first_runs(stream, out, ck, within="1 hour")
    q.awaitTermination()
    got = sorted((r.result_key, r.ord) for r in spark.read.parquet(out).collect())
    assert got == sorted([(f"k{i + 50 * d}", i + 200 * d) for d in range(3) for i in range(50)] + [("k0", 600)])
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(held) <= 100 and held[-1] == 1


def test_late_rows_are_counted(spark):
    """A window that is closed is written once; what comes for it later is counted as dropped, what stays open is in the state."""
    rows = [(i, "a", 3600 * h + i) for h in range(6) for i in range(10)] + [(100 + i, "a", 60 * i) for i in range(7)]
    ev = spark.createDataFrame(rows, "n long, event_type string, s long").select("n", "event_type", "s", F.timestamp_seconds("s").alias("ts"))
    stream, _ = in_order(spark, ev, ["n < 100 AND s < 10800", "n < 100 AND s >= 10800 AND s < 18000", "n >= 100", "n < 100 AND s >= 18000"])
    out, ck = (fresh_path(spark, n) for n in ("out", "ck"))
    q = jobs.window_counts(stream, out, ck, watermark="10 minutes")
    q.awaitTermination()
    assert jobs.rows_seen(q) == 67 and jobs.dropped_rows(spark, q, out, ck) == 7
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [10] * 4 and [r.n for r in jobs.open_windows(spark, ck).collect()] == [10, 10]


def test_saves_merge_into_stored_documents(spark):
    """Three successive saves equal one; files of buckets that are not touched keep their names."""
    ddl = "doc_id string, source string, dataset string, save_ord int, modes struct<n:int>, complete array<int>"
    saves = spark.createDataFrame([(f"d{i % 40}", "s", f"g{i % 3}", i, (i,) if i % 2 else None, [i] if i % 5 else []) for i in range(400)], ddl)
    one, many = fresh_path(spark, "one"), fresh_path(spark, "many")
    stored.save_documents(saves, one, buckets=16)
    for low in (0, 150, 300):
        stored.save_documents(saves.where((F.col("save_ord") >= low) & (F.col("save_ord") < (low + 150))), many, buckets=16)

    def rows(path):
        return sorted((r.doc_id, {k: v.n for k, v in r.events.items()}, r.complete_e2e) for r in stored.read(spark, path).collect())

    assert rows(one) == rows(many) and len(rows(one)) == 36  # every tenth save holds no results
    before = set(stored.read(spark, many, bucket=True).inputFiles())
    stored.save_documents(spark.createDataFrame([("d1", "s", "g9", 1, (5,), None)], ddl), many, buckets=16)
    after = set(spark.read.parquet(many).inputFiles())
    assert len(before - after) == 1 == len(after - before)
    assert dict((d, e) for d, e, _ in rows(many))["d1"]["g9"] == 5
    with pytest.raises(ValueError):
        stored.save_documents(saves, many, buckets=2)


def test_windows_close_once(spark, sf_dir):
    ev = derived.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    src_path, out, ck = (fresh_path(spark, n) for n in ("in", "out", "ck"))
    ev.orderBy("ts").coalesce(1).write.parquet(src_path)
    jobs.window_counts(spark.readStream.schema(ev.schema).parquet(src_path), out, ck).awaitTermination()
    batch = insights.window_type_counts(ev, "ts", "event_type", "1 hour")
    done = spark.read.parquet(out).select("window_start", "event_type", "n")
    assert done.count() > 0 and done.exceptAll(batch).count() == 0
    assert done.groupBy("window_start", "event_type").count().where("count > 1").count() == 0


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([(1, "d", "x", "val", "t", 0, "s", "r", "é")], "epoch int, dataset string, doc_id string, split string, task string, index long, source string, reference string, prediction string")
    path = str(tmp_path / "g")
    src.write_generations(p, path)
    src.write_generations(p, path)
    assert src.read_generations(spark, path).count() == 1
    src.write_generations(p, path, append=True)
    assert [r.prediction for r in src.read_generations(spark, path).collect()] == ["é", "é"]


def test_supplied_triggers_are_reused(spark):
    """Arguments for triggers the caller brings: only the argument prompts reach the model."""
    class Only(RuleScorer):
        def score(self, texts):
            assert all("Extract arguments" in t for t in texts)
            return super().score(texts)

    one = "array(struct('ran' as text, 'Action' as type, 4 as start, 6 as end))"
    none = f"filter({one}, x -> false)"
    d = spark.sql(f"select 'geneva' dataset, 'x' model_type, '1' doc_id, 'geneva' model_key, 'she ran off' source, '' failed, {one} t_pipeline, {none} t_e2e, {none} t_merged")
    r = scoring.score_arguments(d, ONTO, Only).first()
    assert r.ae_pipeline == ["trigger> ran>=Action: argument> she ran>=Agent | None=Place"] and r.ae_e2e == [] and r.failed == ""


def test_records_become_runs(spark):
    """Empty, kept and scored records, defaults, keys of their own; triggers a request brings are used as they are."""
    rows = [("a", None, "", "wonderful day", "{}"), (None, "m2e2", "cross-domain", "", '{"parsed_detection": 1}'), ("c", "rams", "x", "some  text", '{"parsed_detection": {}}'),
            ("d", "rams", "x", "t", '{"event_detection_item": 1, "result_key": "mine", "analyzed_at": "2024-01-02T03:04:05"}'), ("e", "", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, dataset string, model_type string, text string, raw string")
    got = {r.doc_id: r for r in scoring.infer_runs(df, ONTO, RuleScorer).collect()}
    assert {k: (r.status, r.result_key) for k, r in got.items()} == {
        "a": ("scored", "a::geneva::domain-specific::wonderful day"), "doc-1": ("empty", "doc-1::m2e2::cross-domain::"), "c": ("kept", "c::rams::x::some text"),
        "d": ("kept", "mine"), "e": ("empty", "e::geneva::domain-specific::")}
    assert got["a"].pipeline[0].trigger.text == "wonderful" and got["c"].pipeline is None and all(r.analyzed_at for r in got.values())
    assert str(got["d"].analyzed_at) == "2024-01-02 03:04:05" and got["c"].raw

    one = "array(struct('ran' as text, 'Action' as type, 4 as start, 6 as end))"
    batch = spark.sql(f"select 'rams' domain, 'she ran wonderfully' source, '7' id, {one} t_pipeline, cast(null as array<struct<text string, type string, start int, end int>>) t_e2e, "
                      f"{one} t_merged union all select null, 'a wonderful day', '', null, null, null")
    asked = jobs.requests_of(batch)
    run = {r.doc_id: r for r in scoring.chain(asked.withColumnRenamed("text", "source"), ONTO, RuleScorer).collect()}
    assert [e.trigger.text for e in run["7"].pipeline] == ["ran"] == [e.trigger.text for e in run["7"].merged] and run["7"].e2e == [] and run["7"].dataset == "rams"
    assert [e.trigger.text for e in run["api-doc"].pipeline] == ["wonderful"] and run["api-doc"].dataset == "geneva"


def test_scratch_tables_are_removed(spark):
    import os
    from spanloom.session import materialise, scratch
    with scratch(spark):
        path = materialise(spark.range(3), "gone").inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.exists(path)
    assert not os.path.exists(path)
    assert os.path.exists(materialise(spark.range(3), "stays").inputFiles()[0].removeprefix("file://"))


def test_repeated_ids_stay_apart(spark):
    d = spark.createDataFrame([("geneva", "x", "api-doc", "first wonderful text"), ("geneva", "x", "api-doc", "other terrifying words")],
                              "dataset string, model_type string, doc_id string, source string")
    got = sorted((r.source, [(e.trigger.text, e.arguments[0].text) for e in r.pipeline]) for r in scoring.chain(d, ONTO, RuleScorer).collect())
    assert got == [("first wonderful text", [("wonderful", "first wonderful")]), ("other terrifying words", [("terrifying", "other terrifying")])]


def test_shared_folder():
    """The cluster's folder is used as it is; without one only a local session gets a temporary folder."""
    from types import SimpleNamespace as N

    import pytest

    from spanloom.session import shared_dir

    def fake(master, folder=None):
        return N(conf=N(get=lambda key, default: folder or default), sparkContext=N(master=master, applicationId="test-app"))

    assert shared_dir(fake("yarn", "hdfs:///ck")) == "hdfs:///ck"
    assert shared_dir(fake("local[2]")) == shared_dir(fake("local[2]"))
    with pytest.raises(RuntimeError):
        shared_dir(fake("yarn"))


def test_text_probes(spark):
    from spanloom.functions import text as T
    row = spark.range(1).select(
        T.parse_int(F.lit(" 3000000000 "), 5).alias("big"), T.parse_int(F.lit("x"), 5).alias("bad"),
        T.extract_json(F.lit("so {oops}")).alias("oops"), T.extract_json(F.lit('```json\n{"a": [1]}\n```')).alias("fine"),
        T.normalise_tuples(F.lit('[["a","b"], "x", ["c","d"], 3, ["e"], ["[1]"," f "]]')).alias("pairs"), T.normalise_tuples(F.lit("{oops")).alias("none")).first()
    assert (row.big, row.bad, row.oops, row.fine) == (3000000000, 5, None, '{"a": [1]}')
    assert row.pairs == [["a", "b"], ["c", "d"], ["[1]", "f"]] and row.none == []


def test_upload_probes(spark, tmp_path):
    loose = [("three", '{"text": "x"} {"text": "y"}\n{"text": "z"}'), ("bad", "{oops"), ("scalar", "3"), ("null", None), ("fine", '["t"]')]
    ups = spark.createDataFrame(loose, "upload string, content string")
    assert sorted((r.upload, r.pos, r.text) for r in docs.normalised(docs.lenient(ups)).collect()) == [("fine", 0, "t"), ("three", 0, "x"), ("three", 1, "y"), ("three", 2, "z")]
    assert sorted(tuple(r) for r in docs.lenient_rejects(ups).collect()) == [("bad", "not JSON"), ("null", "not JSON"), ("scalar", "no list, wrapper or document")]
    (tmp_path / "big.jsonl").write_text('{"id": "a", "text": "x"}\n\n{"doc_id": "b", "text": "y"}\nnope\n{"id": "c"}\n{"text": "z"}\n')
    good, bad = docs.strict_rows(docs.jsonl_uploads(spark, str(tmp_path)))
    assert [(r.id if r.id in "ab" else "made up", r.text) for r in good.orderBy("pos").collect()] == [("a", "x"), ("b", "y"), ("made up", "z")]
    assert bad.count() == 2


def test_broken_model_is_opened_once(spark, tmp_path):
    log = str(tmp_path / "opened")

    def factory(key):
        with open(log, "a") as f:
            f.write(f"{key}\n")
        if key == "bad":
            raise OSError("no weights")
        return RuleScorer(key)
    df = spark.range(200).coalesce(1).select(F.when(F.col("id") % 2 == 0, "bad").otherwise("good").alias("model_key"), F.format_string("Domain: geneva. Identify trigger words. text %d", "id").alias("input"))
    rows = scoring.batch_score(df, factory).collect()
    assert {r.error for r in rows if r.model_key == "bad"} == {"OSError: no weights"} and all(r.error is None for r in rows if r.model_key == "good")
    assert open(log).read().split().count("bad") == 1


def test_nothing_behind_a_value_is_lost(spark):
    """Strict uploads refuse whatever follows a value; so do lists of records, and replies that hold two objects."""
    from spanloom.functions import text as T
    rows = [("glued", '{"documents": [{"text": "x"}]} {"documents": [{"text": "y"}]}'), ("line", '{"text": "a"} {"text": "b"}\n{"text": "c"}'), ("closed", '{"documents": [{"text": "x"}]}] junk'),
            ("list", '[{"text": "x"}]'), ("good", ' {"documents": [{"text": "} {"}]}\n'), ("lines", '{"text": "a"}\n\n{"text": "]["}')]
    good, bad = docs.strict(spark.createDataFrame(rows, "upload string, content string"))
    assert sorted((r.upload, r.text) for r in good.collect()) == [("good", "} {"), ("lines", "]["), ("lines", "a")]
    assert sorted(r.upload for r in bad.collect()) == ["closed", "glued", "line", "list"]
    fps = [("two", '[{"id": 1}] [{"id": 2}]'), ("odd", '[{"id": 1}, 3]'), ("wrapped", '{"items": [{"id": 1}]}'), ("fine", '[{"id": 1}, {"id": 2}]'), ("none", '{"items": 3}')]
    good, bad = docs.fp_items(spark.createDataFrame(fps, "upload string, content string"))
    assert sorted((r.upload, r.pos) for r in good.collect()) == [("fine", 0), ("fine", 1), ("wrapped", 0)]
    assert sorted((r.upload, r.reason) for r in bad.collect()) == [("none", "not a list of records"), ("odd", "a record is no object"), ("two", "not a list of records")]
    texts = ['{"a":1} and {"b":2}', '{"a": 1}', '{"a":1}] {}', 'x {"a": "} {"} y']
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.extract_json(F.col("t")).alias("j")).orderBy("i").collect()
    assert [r.j for r in got] == [None, '{"a": 1}', None, '{"a": "} {"}']


def test_json_values(spark):
    """Glued values of every kind, against the standard decoder."""
    from spanloom.functions import text as T
    texts = ['{"a": "} {\\" ["}[1, 2]"x" 3 true{}', "", "  ", '{"a": [{"b": 1} {"c": 2}]}', '"a" "b"', "1 2", '{"a" 1}', '"open', '{"a": "\\\\"}{"b": 1}', "[1,,2]", "null\n[]", "{}}", '{"t": "' + "\\n" * 50_000 + '"} {"u": 1}']

    def plain(text):
        out, at, decoder = [], 0, json.JSONDecoder()
        try:
            while True:
                while at < len(text) and text[at].isspace():
                    at += 1
                if at == len(text):
                    return out or None
                value, at = decoder.raw_decode(text, at)
                out.append(value)
        except ValueError:
            return None

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.json_values(F.col("t")).alias("v")).orderBy("i").collect()
    assert [None if r.v is None else [json.loads(v) for v in r.v] for r in got] == [plain(t) for t in texts]


def test_large_uploads_are_read_by_ranges(spark, tmp_path):
    """Values over many lines, several to a line, glued: the same on one range and on many."""
    values = [{"id": i, "text": "} ] \" [ {" * (i % 4), "more": [{"n": list(range(i % 7))}]} for i in range(300)]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(v, indent=2 if i % 3 else None) + (json.dumps([i]) if i % 10 == 0 else "") for i, v in enumerate(values)))
    (tmp_path / "b.json").write_text('{"x": 1}\n{"y": \n')
    want = [x for i, v in enumerate(values) for x in ([v, [i]] if i % 10 == 0 else [v])]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = docs.value_uploads(spark, str(tmp_path)).orderBy("upload", "pos").collect()
            assert [json.loads(r.content) for r in got if r.upload.endswith("a.json")] == want
            assert [r.content for r in got if r.upload.endswith("b.json")] == ['{"x":1}', None]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_lexicon(spark):
    """Labels come from the training split; the direct form knows whole events only, so the modes differ and merge."""
    from spanloom.operators.lexicon import learn
    from spanloom.schema import CORPUS
    words = "Rebels attacked villages yesterday".split()

    def event(kind, args=()):
        return {"id": None, "event_type": kind, "trigger": {"start": "1", "end": "2"}, "arguments": [{"text": t, "role": r} for t, r in args]}

    rows = [("geneva", "train", words, [event("Attack"), event("Attack"), event("Raid", [("Rebels", "Agent"), ("villages", "Place")])], []),
            ("geneva", "train", ["Rebels", "marched"], [event("Move")], []), ("geneva", "test", ["they", "slept"], [event("Sleep")], [])]
    model = learn(spark.createDataFrame(rows, "dataset string, split string, " + CORPUS))
    asked = ["Domain: geneva. Identify trigger words. They attacked, marched; slept.", "Domain: geneva. Classify trigger types. They trigger> attacked> trigger> slept>",
             "Domain: geneva. Classify trigger types end-to-end. attacked marched", "domain: geneva. Event trigger and argument extraction. Rebels attacked villages",
             "Domain: geneva. Extract arguments for a specific event. argument> Agent for trigger> attacked>=Raid: Rebels, Rebels", "", "What?", "Domain: rams. Identify trigger words. attacked"]
    prompts = spark.createDataFrame([("epoch/2/geneva" if i == 7 else "geneva", i, t) for i, t in enumerate([*asked, asked[0]][1:])], "model_key string, i long, input string")
    got = {r.i: (r.prediction, r.error) for r in scoring.batch_score(prompts, model).collect()}
    assert got[0] == ("attacked=Attack", None) and got[1] == ("trigger> attacked>=Raid", None)
    assert got[2][0] == "trigger>attacked>=Raid | argument>Rebels>=Agent | argument>villages>=Place"
    assert got[3][0] == "trigger> attacked>=Raid: argument> Rebels>=Agent" and got[4] == ("", None) and got[5][1].startswith("ValueError") and got[6][0] == "attacked"
    assert got[7][0] == "They trigger> attacked>, marched; slept."
    d = spark.createDataFrame([("geneva", "x", "1", "Rebels attacked villages")], "dataset string, model_type string, doc_id string, source string")
    run = scoring.chain(d, ONTO, model).first()
    assert [[e.trigger.type for e in mode] for mode in (run.pipeline, run.e2e, run.merged, run.complete_e2e)] == [["Attack"], ["Raid"], ["Attack", "Raid"], ["Raid"]]
    assert [(a.text, a.role, a.start) for a in run.merged[1].arguments] == [("Rebels", "Agent", 0), ("villages", "Place", 16)] and run.failed == ""
