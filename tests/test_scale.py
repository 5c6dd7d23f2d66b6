"""Hot keys and global orders against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.operators import scale


def test_split_join_hot_key_is_exact(spark):
    left = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("a")).withColumn(
        "k", F.when(F.col("a") < 200, 0).otherwise(F.col("k"))
    )
    right = spark.range(90).select(F.when(F.col("id") < 60, 0).otherwise(F.col("id") % 3).alias("k"), F.col("id").alias("b"))
    got = scale.split_join(left, right, ["k"], rows_per_task=7)
    want = left.join(right, "k")
    assert got.count() == want.count()
    assert got.exceptAll(want.select(got.columns)).count() == 0


def test_enrich_hot_key_keeps_every_row(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.createDataFrame([(1, "hot"), (800, "x")], "k long, v string")
    got = scale.enrich(left, right, ["k"], rows_per_task=50)
    want = left.join(right, "k", "left")
    assert sorted(map(tuple, got.select("k", "a", "v").collect()), key=str) == sorted(
        map(tuple, want.select("k", "a", "v").collect()), key=str
    )


@pytest.mark.parametrize("ranked", [3, 50, 10_000])
def test_take_lowest_matches_full_sort(spark, ranked):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.where(rng.random(2000) < 0.6, 0, rng.integers(1, 9, 2000)), "i": range(2000)})
    pdf["o"] = rng.integers(0, 500, 2000)
    df = spark.createDataFrame(pdf)
    got = scale.take_lowest(df, ["g"], F.col("o"), ["i"], 37, 500, ranked_rows=ranked).toPandas()
    want = pdf.sort_values(["o", "i"]).groupby("g").head(37)
    assert set(got["i"]) == set(want["i"]) and len(got) == len(want)
    got = scale.take_lowest(df, [], F.col("o"), ["i"], 123, 500, ranked_rows=ranked).toPandas()
    assert set(got["i"]) == set(pdf.sort_values(["o", "i"]).head(123)["i"])
    assert scale.take_lowest(df, [], F.col("o"), ["i"], 10**6, 500, ranked_rows=ranked).count() == 2000


@pytest.mark.parametrize("cuts", [[], [10.0, 11.0, 250.5], [-5.0, 1e9]])
def test_running_total_over_any_cuts(spark, cuts):
    df = spark.range(400).select(F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    got = scale.running_total(df, "o", ["v"], cuts=cuts).orderBy("o").toPandas()
    want = np.concatenate([[0], np.cumsum(got["v"])[:-1]])
    assert (got["v_before"].to_numpy() == want).all()


def test_cut_points_split_large_inputs(spark):
    df = spark.range(1000).select(F.col("id").alias("v"))
    cuts = scale.cut_points(df, "v", rows_per_task=100)
    assert 8 <= len(cuts) <= 12
    assert scale.cut_points(df, "v") == []


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=501), 1)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    probs = [0.0, 0.1, 0.37, 0.5, 0.99, 1.0]
    np.testing.assert_allclose(scale.exact_quantiles(df, "v", probs), np.quantile(v, probs), atol=1e-12)
    assert scale.exact_quantiles(df.where("v > 1e9"), "v", [0.5]) == [None]


def test_average_ranks_with_hot_value(spark):
    v = [0.0] * 50 + [1.0, 2.0, 2.0, -1.0]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = {r["value"]: r["rank"] for r in scale.value_ranks(df, "v").collect()}
    want = pd.Series(v).rank()
    assert got == {x: want[v.index(x)] for x in set(v)}


def test_numbered_is_a_permutation_in_hash_order(spark):
    df = spark.range(500).select(F.col("id").alias("tile"), F.xxhash64("id").alias("h"))
    got = scale.numbered(df, [], "h", "tile", parts=16).toPandas()
    assert sorted(got["place"]) == list(range(500))
    unsigned = got["h"].astype("uint64") if got["h"].dtype != "int64" else got["h"].to_numpy().view("uint64")
    parts = (unsigned >> np.uint64(48)) * 16 >> np.uint64(16)
    order = np.lexsort((got["h"], parts))
    assert (got["place"].to_numpy()[order] == np.arange(500)).all()
