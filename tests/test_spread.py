"""Inputs of few row groups, and blanks around punctuation in one pass."""

import random

from pyspark.sql import functions as F

from spanloom.functions.text import WS, clean_punct, clean_ws
from spanloom.plans.derived import spread


def test_large_file_of_one_row_group_is_dealt_out(spark, tmp_path):
    spark.range(20_000).coalesce(1).write.parquet(f"{tmp_path}/one")
    df = spark.read.parquet(f"{tmp_path}/one")
    size = sum(p.stat().st_size for p in tmp_path.glob("one/*.parquet"))
    rows = spread(df, small=1, task=size // 10).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) >= 10 and sum(r["count"] for r in rows) == 20_000 and max(r["count"] for r in rows) < 4000
    assert spread(df, small=1, task=size).groupBy(F.spark_partition_id()).count().count() == spark.sparkContext.defaultParallelism


def test_blanks_as_by_separate_replacements(spark):
    def steps(c):
        for pattern, put in ((f"{WS}+([,.?!;:%])", "$1"), (rf"\({WS}+", "("), (rf"{WS}+\)", ")"), (f'{WS}+"', '"'), (f'"{WS}+', '"'), (f"{WS}+", " ")):
            c = F.regexp_replace(c, pattern, put)
        return F.trim(c)
    rnd = random.Random(1)
    signs = list('()",.%a  \t\n') + ["\xa0", "　", "\x85", "\x1c", "é", "😀"]
    rows = [("".join(rnd.choice(signs) for _ in range(rnd.randint(0, 14))),) for _ in range(20_000)] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    assert df.where(~steps(F.col("t")).eqNullSafe(clean_punct(F.col("t")))).collect() == []
    assert df.where(~F.trim(F.regexp_replace("t", f"{WS}+", " ")).eqNullSafe(clean_ws(F.col("t")))).collect() == []


def test_long_run_of_blanks_is_passed_once(spark):
    row = spark.createDataFrame([("a" + " \t" * 100_000 + "b .",)], "t string").select(clean_punct(F.col("t"))).first()
    assert row[0] == "a b."
