from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import heavy_keys as H

SCHEMA = "id long, asm_id int, chrom string, start_pos long, end_pos long, name string, score long, n int, hot_key int"


def rows(spark, data):
    return spark.createDataFrame([(*r, 1, 2) for r in data], SCHEMA)


def test_region_key(spark):
    got = spark.createDataFrame([(None,), ("",), (".",), ("a:1",), ("a",), ("tandem:period=3",)], "x string").select(H.region_key(F.col("x")).alias("k")).collect()
    assert [r.k for r in got] == [None, None, None, "a", "a", "tandem"]


def test_heavy_and_summary(spark):
    data = [(i, 1, "c", i, i + 10, "hot:5", i % 7) for i in range(60)] + [(100, 1, "c", 0, 5, "rare", None), (100, 1, "c", 0, 5, "rare", None), (101, 1, None, 0, 5, "lost", 3), (102, 1, "c", 9, 2, None, 3), (None, 1, "c", 0, 9, "hot:5", 99)]
    data += [(200 + i, 1, "c", 0, 1, None, 0) for i in range(40)]
    df = rows(spark, data)
    heavy = H.heavy_keys(df, "id", H.region_key(F.col("name"))).collect()
    assert [(r.hot_key, r.n, r.total) for r in heavy] == [("hot", 60, 103)]
    got = {r.hot_key: (r.n_rows, r.bases, r.best_score) for r in H.key_summary(df, "id", H.region_key(F.col("name")), F.col("score")).collect()}
    assert got == {"hot": (60, 69, 6), "rare": (1, 5, None), "lost": (1, 0, 3)}


def test_empty(spark):
    df = rows(spark, [])
    assert H.heavy_keys(df, "id", F.col("name")).count() == 0
    assert H.key_summary(df, "id", F.col("name"), F.col("score")).count() == 0
