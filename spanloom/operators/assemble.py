"""Putting instances and predictions together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.session import materialise


def concat_instances(*frames: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def drop_null_pairs(instances: DataFrame) -> DataFrame:
    """F6."""
    return instances.dropna(subset=["input", "output"])


def _range_starts(ranged: DataFrame, group: list[str], bits: int) -> DataFrame:
    """``group, _range, _n, _start, _total``: rows of a key range, of the ranges before it and of the group.

    The first window sees the ranges of one block (``2**bits`` at most), the second the blocks of a group (``2**(63 - 2 * bits)``
    at most, whatever the rows).
    """
    ranges = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_n")).withColumn("_block", F.shiftright("_range", bits))
    blocks = ranges.groupBy(*group, "_block").agg(F.sum("_n").alias("_n"))

    def before(part: list[str], order: str):
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(w), F.lit(0))

    first = blocks.select(*group, "_block", before(group, "_block").alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias("_total"))
    return ranges.withColumn("_inside", before([*group, "_block"], "_range")).join(first, [*group, "_block"]).select(
        *group, "_range", "_n", (F.col("_before") + F.col("_inside")).alias("_start"), "_total")


def _ranged(df: DataFrame, key: str, bits: int) -> DataFrame:
    return df.withColumn("_range", F.shiftright(F.col(key).cast("long"), bits))


def row_index(df: DataFrame, group: list[str], key: str, name: str = "idx", bits: int = 20, total: str | None = None) -> DataFrame:
    """0-based position within ``group`` by the unique integer ``key``, without one task per group.

    ``total`` names a column for the size of the group.

    A plain ``row_number`` over a group puts the whole group in one task, and a group may hold a third
    of all rows.  Here the key is read as digits of ``bits`` bits: a row's position is its rank among
    keys that share all but the last digit, plus the rows in earlier such ranges.
    """
    ranged = _ranged(df, key, bits)
    starts = _range_starts(ranged, group, bits).select(*group, "_range", "_start", *([F.col("_total").alias(total)] if total else []))
    rank = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(key))
    return (
        ranged.withColumn("_rank", rank).join(starts, [*group, "_range"])
        .withColumn(name, F.col("_start") + F.col("_rank") - 1).drop("_range", "_rank", "_start")
    )


def first_rows(df: DataFrame, group: list[str], key: str, quota, then: list[str] = (), bits: int = 20) -> DataFrame:
    """The first rows of each group by ``(key, *then)``, which must be unique; ``quota(total)`` says how many.

    Only keys are counted and, in the one key range where the quota ends, ranked.  That gives the last key of each group, a
    table of one row per group, and the rows themselves are filtered by it without being shuffled or sorted.  The table is
    written, so Spark knows its size and broadcasts it below its own threshold.
    """
    order = [key, *then]
    ranged = _ranged(df.select(*group, *order), key, bits)
    end = _range_starts(ranged, group, bits).withColumn("_left", quota(F.col("_total")).cast("long") - F.col("_start")).where(
        (F.col("_left") > 0) & ((F.col("_left") <= F.col("_n")) | (F.col("_start") + F.col("_n") == F.col("_total"))))
    end = materialise(end.select(*group, "_range", F.least("_left", "_n").alias("_left")), "quota-ranges")
    rank = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    inside = ranged.join(end, [*group, "_range"]).withColumn("_rank", rank).where(F.col("_rank") == F.col("_left"))
    last = materialise(inside.select(*group, F.struct(*order).alias("_last")), "last-keys")
    return df.join(last, group).where(F.struct(*order) <= F.col("_last")).drop("_last")


def doc_ids(corpus: DataFrame, key: str = "sid", combined: bool = False) -> DataFrame:
    """Line numbers per split and the id made of them (``doc_3``, or ``m2e2_train_3`` when combined)."""
    out = row_index(corpus, ["dataset", "split"], key, name="doc_idx")
    idx = F.col("doc_idx").cast("string")
    return out.withColumn("doc_id", F.concat_ws("_", "dataset", "split", idx) if combined else F.concat(F.lit("doc_"), idx))


def head_per_split(corpus: DataFrame, limit: int | None, key: str = "sid", zero_is_all: bool = True) -> DataFrame:
    """S3: the first ``limit`` documents of each split, before any filter.

    Zero means no limit for single data sets and no rows for the combined corpus.
    """
    if limit is None or (limit == 0 and zero_is_all):
        return corpus
    return first_rows(corpus, ["dataset", "split"], key, lambda total: F.lit(limit)).select(*corpus.columns)


def prefix_fraction(instances: DataFrame, amount: float | None, key: str, group=("dataset", "task", "split"), then=()) -> DataFrame:
    """The first ``int(n * amount)`` rows of each group by ``(key, *then)``."""
    if amount is None:
        return instances
    share = first_rows(instances, list(group), key, lambda total: F.floor(total * F.lit(float(amount))), list(then))
    return share.select(*instances.columns)


def amount_compat(instances: DataFrame, amount: float | None, key: str, group=("dataset", "task", "split"), then=()) -> DataFrame:
    """U4: the prefix in addition to everything, as the original loaders do (Q8)."""
    if amount is None:
        return instances
    return instances.unionByName(prefix_fraction(instances, amount, key, group, then))


def ae_references(instances: DataFrame) -> DataFrame:
    """Ordered argument-extraction outputs per document (bounded by the events of one document)."""
    return (
        instances.where(F.col("task") == "argument_extraction_pipeline")
        .groupBy("dataset", "split", "doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "output"))).alias("_refs"))
        .select("dataset", "split", "doc_id", F.transform("_refs", lambda x: x["output"]).alias("ae_refs"))
    )


def assemble_references(instances: DataFrame) -> DataFrame:
    """One row per identified document with the references of every task.

    One aggregation over the document key instead of a join per task; of repeated rows the last wins.
    Documents are keyed by data set, split and id (Q16).
    """
    def last(task: str, col: str) -> Column:
        # max over (seq, value) where the task matches: a map-side combinable "last wins"
        return F.max(F.when(F.col("task") == task, F.struct("seq", "input", "output")))[col]

    ae = F.when(F.col("task") == "argument_extraction_pipeline", F.struct("seq", "output"))
    grouped = instances.groupBy("dataset", "split", "doc_id").agg(
        last("trigger_identification", "input").alias("ti_input"),
        last("trigger_identification", "output").alias("ti_reference"),
        last("trigger_classification_pipeline", "output").alias("tc_reference"),
        last("trigger_classification_e2e", "input").alias("tc_e2e_input"),
        last("trigger_classification_e2e", "output").alias("tc_e2e_reference"),
        last("event_extraction_e2e", "input").alias("e2e_input"),
        last("event_extraction_e2e", "output").alias("e2e_reference"),
        F.array_sort(F.collect_list(ae)).alias("_refs"))
    blank = ["tc_reference", "tc_e2e_input", "tc_e2e_reference", "e2e_input", "e2e_reference"]
    return (
        grouped.where(F.col("ti_input").isNotNull())
        .withColumn("ae_references", F.transform("_refs", lambda x: x["output"])).drop("_refs").fillna("", subset=blank)
    )
