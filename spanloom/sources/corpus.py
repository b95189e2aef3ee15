"""Corpus and result sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom import schema
from spanloom.functions.text import reviewer_slug


#: The instances of a sentence repeat its text, so their files shrink to about a quarter.  Readers tell the codec by the files' names.
CODEC = "gzip"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are there, on whatever file system they name."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    return [p for p in paths if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]


def read_corpus(spark: SparkSession, root: str, datasets: list[str], split_group: str = "split1", splits: dict | None = None,
                max_per_split: int | None = None, zero_is_all: bool = True) -> DataFrame:
    """``root/data set/split group/{train,dev,test}.json``, one document per line.

    Missing files are skipped.  ``doc_idx`` is the line number within a split, ``doc_id`` is ``doc_{idx}``.
    All files are one scan; line numbers come from per-block counts, so no split passes through one task.
    """
    files = splits or schema.SPLIT_FILES
    paths = existing(spark, [f"{root}/{ds}/{split_group}/{f}" for ds in datasets for f in files.values()])
    if not paths:
        return spark.createDataFrame([], f"dataset string, split string, doc_idx bigint, doc_id string, {schema.CORPUS}")
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # Both passes below must cut the files alike, even if the cluster grows in between.
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    names = "|".join(f.replace(".", r"\.") for f in files.values())
    pattern = rf"/([^/]+)/{split_group}/({names})(?:/[^/]*)?$"
    split_of = F.create_map(*[F.lit(x) for s, f in files.items() for x in (f, s)])
    raw = spark.read.schema(schema.CORPUS).json(paths).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    raw = raw.withColumn("_mid", F.monotonically_increasing_id()).withColumn(
        "dataset", F.regexp_extract("_file", pattern, 1)).withColumn("split", split_of[F.regexp_extract("_file", pattern, 2)])
    key = ["dataset", "split", "_file", "_block"]
    # max(size(tokens)) makes both passes parse the same lines.
    blocks = raw.groupBy(*key).agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"), F.max(F.size("tokens")).alias("_probe"))
    before = Window.partitionBy("dataset", "split").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n", "_probe")
    out = raw.join(starts, key).withColumn("doc_idx", F.col("_start") + F.col("_mid") - F.col("_first")).select(
        "dataset", "split", "doc_idx", F.concat(F.lit("doc_"), F.col("doc_idx").cast("string")).alias("doc_id"),
        "tokens", "event_mentions", "entity_mentions")
    if max_per_split is None or (max_per_split == 0 and zero_is_all):
        return out
    return out.where(F.col("doc_idx") < max_per_split)


def write_corpus(corpus: DataFrame, root: str, split_group: str = "split1") -> None:
    """The layout :func:`read_corpus` reads, one folder of part files per split."""
    pairs = [(r["dataset"], r["split"]) for r in corpus.select("dataset", "split").distinct().collect()]
    for ds, split in pairs:
        corpus.where((F.col("dataset") == ds) & (F.col("split") == split)).select(
            "tokens", "event_mentions", "entity_mentions").write.mode("overwrite").json(f"{root}/{ds}/{split_group}/{schema.SPLIT_FILES[split]}")


def read_results(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """A JSON array of documents per file; ``array=False`` reads what :func:`write_results` writes, which splits."""
    return spark.read.option("multiLine", array).schema(schema.RESULT_ITEM).json(path)


def write_results(items: DataFrame, path: str) -> None:
    """One document per line, in files compressed by ``CODEC``."""
    items.write.mode("overwrite").option("compression", CODEC).json(path)


def write_generations(predictions: DataFrame, path: str, append: bool = False) -> None:
    """By epoch, data set and split; a re-run replaces its own partitions (``append`` keeps both)."""
    w = predictions.write.partitionBy("epoch", "dataset", "split")
    if append:
        w.mode("append").json(path)
    else:
        w.mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.PREDICTION).json(path)


def write_tasks(instances: DataFrame, path: str) -> None:
    """By task and split; text is written as it is, in files compressed by ``CODEC``."""
    instances.write.mode("overwrite").option("compression", CODEC).partitionBy("task", "split").json(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "dataset string, source_dataset string, split string, task string, doc_id string, seq bigint, event_id string, "
        "input string, output string").json(path)


def append_decisions(decisions: DataFrame, path: str, now: Column | None = None) -> None:
    """The log grows by one batch per save; reviewer and time of saving are columns."""
    decisions.withColumn("reviewer", reviewer_slug(F.col("reviewer"))).withColumn(
        "saved_at", F.current_timestamp() if now is None else now).write.mode("append").json(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.DECISION + ", saved_at timestamp").json(path)
