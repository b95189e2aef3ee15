"""Triggers counted off, and tasks that do not grow with their input."""

from pyspark.sql import functions as F

from spanloom.plans.derived import build_corpus, dealt, spread


def test_tasks_follow_the_size_of_an_input_below_a_gigabyte(spark, tmp_path):
    spark.range(20_000).coalesce(1).write.parquet(f"{tmp_path}/one")
    size = sum(p.stat().st_size for p in tmp_path.glob("one/*.parquet"))
    assert spread(spark.read.parquet(f"{tmp_path}/one"), task=size // 100).groupBy(F.spark_partition_id()).count().count() >= 100


def test_derived_tables_are_dealt_where_a_scan_has_large_tasks(spark, tmp_path):
    spark.range(20_000).coalesce(1).write.parquet(f"{tmp_path}/one")
    size = sum(p.stat().st_size for p in tmp_path.glob("one/*.parquet"))
    df = spark.read.parquet(f"{tmp_path}/one")
    assert dealt(df, task=size // 100).groupBy(F.spark_partition_id()).count().count() >= 100
    assert "Repartition" not in dealt(df)._jdf.queryExecution().optimizedPlan().toString()


def test_triggers_stand_at_every_17th_place(spark):
    words = " ".join("abcdef" if i % 3 else "abc" for i in range(60))
    docs = spark.createDataFrame([(i, words, "en") for i in (-40, -17, -1, 0, 1, 16, 17, 100)] + [(None, words, "en"), (3, "a\nb c", "en")], "doc_id long, text string, lang string")
    corpus = build_corpus(docs)
    for r in corpus.collect():
        m = None if r.src_id is None else r.src_id * 1000 + (r.sid - r.src_id * (1 << 26))
        want = [i for i, t in enumerate(r.tokens) if m is not None and len(t) >= 6 and (m + i) % 17 == 0]
        assert list(dict.fromkeys(int(e.trigger.start) for e in r.event_mentions)) == want
