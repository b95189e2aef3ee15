"""False-positive review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import ae_trigger, first_truthy, let
from spanloom.operators.assemble import row_index
from spanloom.operators.parse import place_first, serving_pairs

# Alias names a record may use for a field, in order.
ALIASES = {
    "fp_id": ("fp_id", "id", "uid"),
    "dataset": ("dataset", "ds_key", "domain"),
    "model_name": ("model_name", "model", "model_id"),
    "doc_id": ("doc_id", "document_id"),
    "source": ("source", "text", "sentence", "document"),
    "trigger_text": ("trigger_text", "pred_trigger_text", "trigger"),
    "trigger_type": ("trigger_type", "pred_trigger_type", "event_type"),
    "argument_text": ("argument_text", "pred_argument_text", "argument"),
    "argument_role": ("argument_role", "pred_argument_role", "role"),
}
DEFAULTS = {"dataset": "unknown", "model_name": "unknown"}


def _keys(items: DataFrame) -> list[str]:
    """What tells documents apart: ids repeat between data sets and, where the column is there, splits (Q16)."""
    return [c for c in ("dataset", "split", "doc_id") if c in items.columns]


def _listed(source: Column, preds: Column, compat: bool) -> Column:
    """The arguments of a list of predictions with both parts non-blank, in order, not yet searched for; empty for no list."""
    def one(p, i):
        return F.transform(serving_pairs(source, p, compat), lambda a, j: F.struct(
            i.alias("pred_pos"), j.alias("arg_pos"), *[a[n].alias(n) for n in ("text", "role", "several")]))
    lists = F.filter(F.transform(preds, one), lambda x: x.isNotNull())
    return F.coalesce(F.filter(F.flatten(lists), lambda a: (a["text"] != "") & (a["role"] != "")), F.array())


def _placed(source: Column, listed: Column) -> Column:
    return F.transform(listed, lambda a: place_first(source, a, "pred_pos", "arg_pos"))


def _arguments(source: Column, preds: Column, compat: bool) -> Column:
    """X8 without an anchor over a list of predictions: the arguments with both parts non-blank, in order; empty for no list."""
    return _placed(source, _listed(source, preds, compat))


def _pair(a: Column) -> Column:
    return F.struct(a["text"].alias("text"), a["role"].alias("role"))


def _pairs(items: DataFrame, preds: str, compat: bool) -> Column:
    return F.array_distinct(F.transform(_listed(items["source"], items[preds], compat), _pair))


def _exploded(rows: DataFrame, found: Column, preds: str) -> DataFrame:
    keys = _keys(rows)
    return rows.select(*keys, preds, F.explode(found).alias("a")).select(
        *keys, "a.pred_pos", "a.arg_pos", F.get(preds, F.col("a.pred_pos")).alias("pred"), "a.text", "a.role", "a.start", "a.end")


def predicted_arguments(items: DataFrame, preds: str, compat: bool = False) -> DataFrame:
    """One row per argument of a list of predictions."""
    return _exploded(items, _arguments(F.col("source"), F.col(preds), compat), preds)


def reference_set(items: DataFrame, refs: str = "ae_refs", compat: bool = False) -> DataFrame:
    """A document's pairs, distinct in its row."""
    return items.select(*_keys(items), F.explode(_pairs(items, refs, compat)).alias("a")).select(*_keys(items), "a.text", "a.role")


def _unmatched(items: DataFrame, preds: str, refs: str, compat: bool) -> Column:
    """Predicted arguments whose pair is no reference of the row; only these are searched for in the text.

    References and predictions of a document sit in its row, so matching happens there: no join, no shuffle.  To be exploded
    as it is: of a column, Spark would ask before that whether it is empty, and make the list again for each such question.
    """
    found = _listed(F.col("source"), F.col(preds), compat)
    wrong = let(_pairs(items, refs, compat), lambda known: F.filter(found, lambda a: ~F.array_contains(known, _pair(a))))
    return _placed(F.col("source"), wrong)


def false_positives(items: DataFrame, preds: str, refs: str = "ae_refs", compat: bool = False) -> DataFrame:
    """J9 as a table job: predicted (text, role) pairs absent from the document's references."""
    return _exploded(items, _unmatched(items, preds, refs, compat), preds)


def fp_records(items: DataFrame, preds: str, task: str, model_name: str, refs: str = "ae_refs", compat: bool = False,
               by_split: bool = False) -> DataFrame:
    """E1 + W4: one review record per false positive; a document's counter is its position in the surviving list.

    ``parsed_prediction`` is the one event a reviewer is shown (see :func:`spanloom.operators.parse.review_preview`).
    ``by_split`` puts the split into ``fp_id``, which tells equal document ids of two splits apart.
    """
    ids = ["dataset", "split"] if by_split else ["dataset"]
    rows = items.select(
        *ids, "doc_id", "source", F.col(refs).alias("reference_candidates"), F.col(preds).alias("_preds"),
        F.posexplode(_unmatched(items, preds, refs, compat)).alias("local_idx", "a"))
    pred = F.get("_preds", F.col("a.pred_pos"))
    text, etype = ae_trigger(pred, compat)
    nowhere = [F.lit(None).cast("int").alias(n) for n in ("start", "end")]
    event = F.struct(
        F.struct(text.alias("text"), etype.alias("type"), *nowhere).alias("trigger"),
        F.array(F.struct(*[F.col(f"a.{n}") for n in ("text", "role", "start", "end")])).alias("arguments"))
    return rows.select(
        F.concat_ws("-", *ids, F.lit(task), "doc_id", F.col("local_idx").cast("string")).alias("fp_id"),
        *ids, F.lit(model_name).alias("model_name"), F.lit(task).alias("task"), "doc_id", "source",
        text.alias("trigger_text"), etype.alias("trigger_type"),
        F.col("a.text").alias("argument_text"), F.col("a.role").alias("argument_role"),
        F.col("a.start").alias("argument_start"), F.col("a.end").alias("argument_end"),
        pred.alias("prediction_raw"), "reference_candidates", F.array(event).alias("parsed_prediction"), "local_idx")


def normalise_records(raw: DataFrame, idx: str = "idx") -> DataFrame:
    """E2 + F13: whatever aliases the columns use, one record schema."""
    have = set(raw.columns)

    def field(name: str) -> Column:
        default = F.concat(F.lit("fp-"), F.lpad(F.col(idx).cast("string"), 7, "0")) if name == "fp_id" else F.lit(DEFAULTS.get(name, ""))
        return first_truthy(*[F.col(a) for a in ALIASES[name] if a in have], default=default).alias(name)

    return raw.select(*[field(n) for n in ALIASES])


def filter_records(records: DataFrame, dataset: str | None = None, model_name: str | None = None) -> DataFrame:
    """``None`` and ``__ALL__`` match everything."""
    for col, want in (("dataset", dataset), ("model_name", model_name)):
        if want not in (None, "__ALL__"):
            records = records.where(F.col(col) == want)
    return records


def fp_summary(records: DataFrame) -> DataFrame:
    """A10."""
    return records.agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("dataset")).alias("datasets"),
        F.array_sort(F.collect_set("model_name")).alias("models"))


def latest_decisions(log: DataFrame) -> DataFrame:
    """The newest decision per record; a hash aggregate with partial results, not a sort.

    Of decisions of one time the one saved last counts, where the log says when that was.
    """
    cols = [c for c in log.columns if c != "fp_id"]
    order = [F.col(c).alias(f"by {c}") for c in ("timestamp", "saved_at") if c in cols]
    newest = F.max(F.struct(*order, *[F.col(c) for c in cols])).alias("_d")
    return log.groupBy("fp_id").agg(newest).select("fp_id", *[F.col("_d")[c].alias(c) for c in cols])


def progress(records: DataFrame, log: DataFrame) -> DataFrame:
    """Reviewed and total records."""
    done = log.select("fp_id").distinct().withColumn("_done", F.lit(1))
    return records.select("fp_id").join(done, "fp_id", "left").agg(F.count("_done").alias("reviewed"), F.count("*").alias("total"))


def attach_decisions(records: DataFrame, log: DataFrame) -> DataFrame:
    """Every record with its current decision, if any."""
    current = latest_decisions(log).select("fp_id", "decision", "notes", "schema_checked", "reviewer")
    return (
        records.join(current, "fp_id", "left")
        .withColumn("notes", F.coalesce("notes", F.lit(""))).withColumn("schema_checked", F.coalesce("schema_checked", F.lit(False)))
    )


def navigation(records: DataFrame, group: list[str], key: str) -> DataFrame:
    """Each record's cursor within ``group`` and the cursors before and after it, clamped to the range."""
    return row_index(records, group, key, name="cursor", total="_size").select(
        *records.columns, "cursor", F.greatest(F.col("cursor") - 1, F.lit(0)).alias("previous"),
        F.least(F.col("cursor") + 1, F.col("_size") - 1).alias("next"))


def match_counts(items: DataFrame, preds: str, refs: str = "ae_refs", compat: bool = False) -> DataFrame:
    """True and false positives and misses per data set under E1's matching rule; only counts are shuffled."""
    rows = items.select("dataset", _pairs(items, preds, compat).alias("p"), _pairs(items, refs, compat).alias("r"))
    rows = rows.where((F.size("p") > 0) | (F.size("r") > 0)).withColumn("both", F.size(F.array_intersect("p", "r")))
    return rows.groupBy("dataset").agg(
        F.sum("both").alias("tp"), F.sum(F.size("p") - F.col("both")).alias("fp"), F.sum(F.size("r") - F.col("both")).alias("fn"))


def corrected_precision(items: DataFrame, preds: str, records: DataFrame, log: DataFrame, refs: str = "ae_refs") -> DataFrame:
    """Precision per data set when reviewed false positives count as correct gold gaps."""
    found = items.select("dataset", F.size(_listed(F.col("source"), F.col(preds), False)).alias("n"))
    total = found.where("n > 0").groupBy("dataset").agg(F.sum("n").alias("predicted"))
    judged = records.select("fp_id", "dataset").join(latest_decisions(log).select("fp_id", "decision"), "fp_id", "left")
    fps = judged.groupBy("dataset").agg(
        F.count("*").alias("fps"), F.count_if(F.col("decision") == "true_positive_missing_gold").alias("missing_gold"),
        F.count_if(F.col("decision") == "uncertain").alias("uncertain"))
    fps0 = [F.coalesce(c, F.lit(0)) for c in ("fps", "missing_gold", "uncertain")]
    return total.join(fps, "dataset", "left").select(
        "dataset", "predicted", fps0[0].alias("fps"), fps0[1].alias("missing_gold"), fps0[2].alias("uncertain"),
        F.round((F.col("predicted") - fps0[0]) / F.col("predicted"), 6).alias("precision"),
        F.round((F.col("predicted") - fps0[0] + fps0[1]) / F.col("predicted"), 6).alias("corrected_precision"))
