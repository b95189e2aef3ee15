"""Review records: their list is made once a row, and only what has no reference is searched for."""

from spanloom.operators import review

ITEMS = "dataset string, split string, doc_id string, source string, preds array<string>, ae_refs array<string>"


def items(spark):
    head = "trigger> hit>=Attack: "
    return spark.createDataFrame([
        ("m2e2", "test", "d1", "the old man hit the man in old town", [
            head + "argument> old man>=Agent | argument> man>=Target | argument> old town zzz>=Place | None=Time",
            head + "argument> nowhere>=Place | argument> man>=Target"], [head + "argument> old man>=Agent | argument> town>=Place"]),
        ("m2e2", "test", "d2", "a b a", [head + "argument> a>=Agent"], None),
        ("m2e2", "test", "d3", "a b a", None, [head + "argument> a>=Agent"]),
        ("m2e2", "test", "d4", None, [head + "argument> a b>=Agent", None], []),
    ], ITEMS)


def test_false_positives_are_predicted_pairs_without_a_reference(spark):
    df = items(spark)
    known = {tuple(r) for r in review.reference_set(df).select("doc_id", "text", "role").collect()}
    want = sorted([tuple(r) for r in review.predicted_arguments(df, "preds").collect() if (r.doc_id, r.text, r.role) not in known], key=str)
    got = sorted([tuple(r) for r in review.false_positives(df, "preds").collect()], key=str)
    assert got == want
    assert [(r[2], r[6], r[7], r[8], r[9]) for r in got] == [
        ("d1", "man", "Target", 8, 10), ("d1", "old town", "Place", 27, 34), ("d1", "nowhere", "Place", None, None), ("d1", "man", "Target", 8, 10),
        ("d2", "a", "Agent", 0, 0), ("d4", "a b", "Agent", None, None)]


def test_list_of_false_positives_is_made_once(spark):
    for df in (review.fp_records(items(spark), "preds", "t", "m"), review.false_positives(items(spark), "preds")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array_contains") == 1 and "Filter" not in plan
