"""Trees fitted on a table: all rows count, in any order and any number of files."""

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import trees, urls


def test_table_and_memory_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, (1500, 5)).astype(float)
    y = ((x[:, 0] > 20) ^ (x[:, 3] < 9) | (rng.random(1500) < 0.05)).astype(int)
    rows = [(r.tolist(), int(v)) for r, v in zip(x, y)]
    want = trees.train(x, y.astype(float), trees=6, depth=3, balanced=True).score(x)
    one = trees.train_table(spark.createDataFrame(rows, "x array<double>, label int").coalesce(1), 5, trees=6, depth=3, balanced=True)
    monkeypatch.setattr(trees, "FILE_ROWS", 200)
    many = trees.train_table(spark.createDataFrame(rows[::-1], "x array<double>, label int").repartition(3), 5, trees=6, depth=3, balanced=True)
    for a, b in ((one.feature, many.feature), (one.threshold, many.threshold), (one.value, many.value)):
        assert a.tolist() == b.tolist()
    assert ((one.score(x) >= 0.5) == (want >= 0.5)).mean() > 0.98
    same = trees.train_table(spark.createDataFrame([([1.0], 1)] * 50 + [([1.0], 0)] * 50, "x array<double>, label int"), 1)
    assert len(same.feature) == 0 and same.score(np.ones((1, 1))).tolist() == [0.5]


def test_op4_fits_on_all_urls(spark):
    """Folds of more than 6,000 URLs, once the size of a sample, are learned from and measured whole."""
    i = F.col("page_id")
    pages = spark.range(24_000).withColumnRenamed("id", "page_id").withColumn(
        "url", F.concat(F.lit("https://h"), i.cast("string"), F.when(i % 8 == 0, ".good.org/guide/").otherwise(".bad.org/promo/"), i.cast("string")))
    found = urls.by_rules(pages, [("block", "org", "/promo/"), ("allow", "org", "/guide/")]).withColumns(urls.bucket_columns())
    held = found.where(F.pmod(F.xxhash64(F.lit("fold"), "host"), F.lit(3)) == 2).count()
    model = urls.fit(found, trees=2, depth=1)
    assert held > 6000 and model.n_held == held and model.caught >= urls.RECALL and model.wrong == 0
