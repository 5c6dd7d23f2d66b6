"""Steps whose work must follow the input and not its keys, copies or formulas."""

import numpy as np
from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.operators import coverage, spatial
from skyloom.operators.scale import split_join
from skyloom.operators.spatial import Measure


def test_places_of_many_ids_are_joined_once(spark, monkeypatch):
    """Two hundred ids on each of two spots: points meet the two spots, every id gets its result."""
    met = []
    whole = spatial.near_pairs

    def counted(locations, points, radius_m):
        met.append(locations.count())
        return whole(locations, points, radius_m)

    monkeypatch.setattr(spatial, "near_pairs", counted)
    places = spark.range(400).select(F.col("id").alias("loc_id"), (3.6 + (F.col("id") % 2) * 0.1).alias("longitude"), F.lit(51.0).alias("latitude"))
    points = spark.range(5).select(F.col("id").alias("pid"), (3.6 + F.col("id") * 0.001).alias("longitude"), F.lit(51.0).alias("latitude"))
    got = spatial.radius_aggregate(places, points, [Measure("n", "count", 150)])
    assert got.columns == ["loc_id", "longitude", "latitude", "n"]
    assert got.groupBy("n").count().orderBy("n").collect() == [(0, 200), (3, 200)]
    near = spatial.nearest(places, points, ["pid"], 150, "pid", "near_")
    assert near.columns == ["loc_id", "longitude", "latitude", "near_pid", "near_dist_m"]
    assert near.groupBy("near_pid").count().orderBy("near_pid").collect() == [(None, 200), (0, 200)]
    assert met == [2, 2]


def test_split_join_broadcasts_no_exploded_side(spark):
    few = spark.range(10).select("id", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("k"))
    joined = split_join(few, few.withColumnRenamed("id", "other"), ["k"])
    assert "strategy=merge" in joined._jdf.queryExecution().analyzed().toString()
    assert joined.count() == 900


def test_few_places_with_many_times_meet_points_directly(spark, monkeypatch):
    """A crowded cell, one location and many times: one pass over the pairs, and the same hits as by descent."""
    points = spark.range(3000).select(
        F.col("id").alias("pid"), (3.6 + (F.col("id") % 300) * 1e-5).alias("longitude"), (51.0 + F.col("id") * 1e-7).alias("latitude"),
        F.timestamp_seconds(F.col("id") * 7919 % 2000 * 86400).alias("ts"),
    )
    asked = spark.range(2500).select(F.lit(3.6001).alias("longitude"), F.lit(51.0001).alias("latitude"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"))
    want = [spatial.nearest_as_of(asked, points, ["pid"], 300, "pid", mode, prefix="hit_").orderBy("ts").collect() for mode in ("last_previous",)]
    monkeypatch.setattr(spatial, "PAIRS_PER_ROW", 0)
    assert [spatial.nearest_as_of(asked, points, ["pid"], 300, "pid", mode, prefix="hit_").orderBy("ts").collect() for mode in ("last_previous",)] == want

    def descended(*_):
        raise AssertionError("descended")

    monkeypatch.setattr(spatial, "PAIRS_PER_ROW", 32)
    monkeypatch.setattr(spatial, "_descended_as_of", descended)
    assert spatial.nearest_as_of(asked, points, ["pid"], 300, "pid", "nearest", prefix="hit_").count() == 2500


def test_stream_files_follow_the_splits(spark, sf, monkeypatch):
    """A table of many splits becomes as many files, in two batches."""
    from skyloom.queries import streams
    from skyloom.sources import derived

    whole = derived.obs(spark, sf)
    monkeypatch.setattr(derived, "obs", lambda *_: whole.repartition(9))
    files = spark.read.parquet(streams._obs_files(spark, sf)).inputFiles()
    assert len(files) == 9


def test_slices_of_words_stay_small():
    """What blocks of words hold while a batch is read does not follow the batch."""
    import tracemalloc

    import pyarrow as pa

    from skyloom.llm.substring_dedup import _blocks_of
    from skyloom.llm.rows import TEXT_KEY

    text = " ".join(f"w{i * 7919 % 10007}" for i in range(20_000))
    batch = pa.record_batch([pa.array(range(60)), pa.array([text] * 60), pa.array(range(60))], names=["doc_id", "text", TEXT_KEY])
    tracemalloc.start()
    found = sum(b.num_rows for b in _blocks_of(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 1000 and peak < 80_000_000


def test_area_projects_a_ring_once(spark):
    """The formula names the projected ring once, however often the area uses it."""
    assert str(geo.rings_area_m2(F.col("rings"))).lower().count("sin(") < 20


def test_runs_shuffle_polygons_and_not_crossings(spark):
    """A ring with a hole by rows, and no shuffle by row."""
    grid = coverage.Grid()

    def ring(a, b):
        return [(grid.lon0 + x * grid.step_lon / 4, grid.lat0 + y * grid.step_lat / 4) for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))]

    polygons = spark.createDataFrame([(1, "k", [ring(0.5, 20.5), ring(5.5, 9.5)]), (2, "k", [ring(30.5, 31.5)]), (3, "k", [])], "pid int, layer string, rings array<array<struct<x:double,y:double>>>")
    runs = coverage.polygon_runs(polygons, ["layer"], "pid", grid)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    got = {(r.pid, r.y, r.xa, r.xb) for r in runs.collect()}
    want = {(1, y, 1, 20) for y in range(1, 21) if not 6 <= y <= 9}
    want |= {(1, y, a, b) for y in range(6, 10) for a, b in ((1, 5), (10, 20))} | {(2, 31, 31, 31)}
    assert got == want
    assert "MapInArrow" in plan and "y#" not in plan.split("Exchange", 1)[1]


def test_trees_pass_over_different_rows(spark, monkeypatch):
    """Forty copies of fifty rows: fifty rows in the tables that passes read, and the trees of all of them."""
    from skyloom.operators import trees

    held = []
    whole = trees.materialise
    monkeypatch.setattr(trees, "materialise", lambda df, label="stage": held.append(df.count()) or whole(df, label))
    row = F.col("id") % 50
    df = spark.range(2000).select((row % 7).cast("double").alias("a"), (row / 3).alias("b"), (row * row % 11).cast("double").alias("y"))
    boosted = trees.fit_boosted(df, ["a", "b"], "y", trees.Boosting(rounds=1, depth=2, row_share=1.0, column_share=1.0))
    random = trees.fit_random_trees(df, ["a", "b"], "y", trees.RandomTrees(trees=3, depth=3))
    assert held == [50, 50, 50]
    assert boosted.trees[0].cover[0] == 2000 and [t.cover[0] for t in random.trees] == [2000] * 3
    mean = df.agg(F.avg("y")).first()[0]
    assert all(abs(t.mean()) < 1e-9 for t in random.trees) and abs(random.base - mean) < 1e-12


def test_equal_rows_are_scored_once(spark, monkeypatch):
    from skyloom.operators import models

    df = spark.range(600).select((F.col("id") % 6).cast("double").alias("x"), (F.col("id") % 6 * 2 + F.col("id") % 2).cast("double").alias("y"))
    scored = []
    whole = models.predict
    monkeypatch.setattr(models, "predict", lambda model, rows: scored.append(rows.count()) or whole(model, rows))
    kinds = ["ridge", "elastic_net", "nystroem", "boosting"]
    got = {r["model"]: r for r in models.train_all(df, df, ["x"], "y", kinds, {"nystroem": {"n_components": 4}, "boosting": {"maxIter": 2, "maxDepth": 2}}).collect()}
    assert scored == [6] * 4 and all(got[k]["n_rows"] == 600 for k in kinds)
    plain = models.regression_metrics(whole(models.fit_model("ridge", df, ["x"], "y"), df), "prediction", "y").first()
    for c in ("n_rows", "mse", "rmse", "mae", "r2", "mape", "bias", "max_error"):
        assert abs(got["ridge"][c] - plain[c]) < 1e-9


def test_event_study_holds_no_products_of_indicators(spark):
    """What a tile's list holds for each month follows the columns that vary in it, not the window."""
    from skyloom.operators import panel

    rows = spark.range(600).select(
        (F.col("id") % 6).cast("string").alias("tile"), (2000 * 12 + 1 + F.col("id") % 90).cast("int").alias("scene_ym"),
        (F.col("id") * 7919 % 101).cast("double").alias("y"), ((F.col("id") % 90) > 40 + F.col("id") % 6).cast("double").alias("d"),
    )
    seen = []
    whole = panel.materialise
    panel.materialise = lambda df, label="stage": seen.append(df) or whole(df, label)
    try:
        panel.event_study(rows, (-3, 3))
    finally:
        panel.materialise = whole
    first = seen[0].first()
    assert {len(v) for v in first["s"]} == {1} and len(first["p"]) == 1


def test_a_polygon_of_its_own_equals_a_layer_of_one(spark):
    """Shares of single polygons, with holes and beyond the grid, are those of layers that hold one polygon each."""
    grid = coverage.Grid()

    def ring(x, y, side):
        a, b = grid.lon0 + x * grid.step_lon, grid.lat0 + y * grid.step_lat
        return [(a + dx * grid.step_lon, b + dy * grid.step_lat) for dx, dy in ((0, 0), (side, 0), (side, side), (0, side), (0, 0))]

    rows = [(1, [ring(2.3, 2.1, 9), ring(4.2, 4.7, 3)]), (2, [ring(-5.0, -5.0, 7.4)]), (3, [ring(30.2, 30.1, 0.6)]), (4, [])]
    polygons = spark.createDataFrame(rows, "pid int, rings array<array<struct<x:double,y:double>>>").withColumn("name", F.col("pid").cast("string"))
    targets = spark.range(40 * 40).select((F.col("id") % 40).cast("int").alias("ix"), (F.col("id") / 40).cast("int").alias("iy"))
    own = coverage.coverage(polygons, ["pid"], "pid", targets, [30.0, 60.0], grid)
    layers = coverage.coverage(polygons, ["name"], "pid", targets, [30.0, 60.0], grid)
    want = {(r["ix"], r["iy"], r["name"], r["frac_30"], r["frac_60"]) for r in layers.collect()}
    got = [(r["ix"], r["iy"], str(r["pid"]), r["frac_30"], r["frac_60"]) for r in own.collect()]
    assert len(want) > 100 and len(got) == len(want) and set(got) == want


def test_layers_are_drawn_where_their_polygons_lie(spark):
    """Many polygons over many rows make one picture for a layer in a tile, and the union of their runs."""
    rng = np.random.default_rng(3)
    grid = coverage.Grid()
    sub_lon, sub_lat = grid.step_lon / 4, grid.step_lat / 4

    def ring(x, y, w, h):
        return [(float(grid.lon0 + a * sub_lon), float(grid.lat0 + b * sub_lat)) for a, b in ((x, y), (x + w, y + 0.3), (x + w, y + h), (x, y + h), (x, y))]

    rows = [(i, ["a", None, "b"][i % 3], [ring(*(rng.random(2) * 300 + 0.1), *(rng.random(2) * 60 + 9)), *([ring(150.2, 150.1, 20, 20)] if i % 5 == 0 else [])]) for i in range(400)]
    rows += [(400, "a", [ring(-900.3, -900.2, 880.0, 905.5)]), (401, "b", [])]
    polygons = spark.createDataFrame(rows, "pid int, layer string, rings array<array<struct<x:double,y:double>>>")
    spots = [(i, j) for i in range(0, 90, 6) for j in range(0, 90, 6)]
    targets = spark.createDataFrame(spots, "ix int, iy int")
    tiles = coverage._Tiles([60.0], grid)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")  # pictures are cut between batches
    try:
        got = {(r.ix, r.iy, r.layer): r.frac_60 for r in coverage.coverage(polygons, ["layer"], "pid", targets, [60.0], grid).collect()}
        pictures = coverage.layer_pictures(polygons, ["layer"], "pid", targets, tiles).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    runs = coverage.polygon_runs(polygons, ["layer"], "pid", grid, 40).toPandas()
    assert pictures < len(runs) / 100
    kernel, want = grid.kernel(60.0), {}
    for layer in ("a", None, "b"):
        cells = np.zeros((900, 900), np.int64)
        own = runs[runs.layer.isnull() if layer is None else runs.layer == layer]
        for r in own.itertuples():
            cells[r.y + 50, max(0, r.xa + 50) : r.xb + 51] = 1
        for ix, iy in spots:
            n = sum(c * cells[iy * 4 + dy + 50, ix * 4 - half + 50 : ix * 4 + half + 51].sum() for dy, steps in kernel.items() for half, c in steps)
            if n:
                want[ix, iy, layer] = min(1.0, n / coverage.kernel_total(kernel))
    assert len(want) > 200 and got == want


def test_models_share_one_pass_over_the_rows(spark, monkeypatch):
    """Every kind of model is trained on one table of different rows with their numbers, and each frame is read once."""
    from skyloom.operators import models

    row = F.col("id") % 60
    df = spark.range(2400).select((row % 7).cast("double").alias("a"), F.when(row % 9 > 0, row / 3).alias("b"), (row * row % 11).cast("double").alias("y"))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    seen = df.mapInArrow(counted, df.schema)
    trained, whole = [], models.fit_model
    monkeypatch.setattr(models, "fit_model", lambda kind, train, *a, **k: trained.append(train.count()) or whole(kind, train, *a, **k))
    few = {"nystroem": {"n_components": 4}, "random_forest": {"numTrees": 3, "maxDepth": 3}, "boosting": {"maxIter": 2, "maxDepth": 2},
           "second_order": {"rounds": 1, "depth": 2}, "extra_trees": {"trees": 2, "depth": 3}}
    got = {r["model"]: r for r in models.train_all(seen, seen, ["a", "b"], "y", settings=few).collect()}
    assert read.value == 2 * 2400 and trained == [60] * len(models.MODELS)
    assert set(got) == set(models.MODELS) and all(r["n_rows"] == 2400 for r in got.values())
    for kind in ("linear", "ridge", "extra_trees"):  # the same as on all rows
        alone = whole(kind, df, ["a", "b"], "y", **few.get(kind, {}))
        plain = models.regression_metrics(models.predict(alone, df), "prediction", "y").first()
        assert all(abs(got[kind][c] - plain[c]) < 1e-6 for c in ("rmse", "mae", "r2", "bias", "max_error"))


def test_a_forest_draws_equal_rows_in_pieces(spark):
    """No number of copies makes more than a few rows to draw, all of them count, and few copies are drawn one by one."""
    from skyloom.operators import attribution, models

    df = spark.createDataFrame([(0.0, 7), (1.0, 16), (2.0, 1000), (3.0, 1)], f"x double, {models.EQUAL} long")
    cut = models.in_pieces(df, 16).groupBy("x").agg(F.count("*").alias("k"), F.sum(models.EQUAL).alias("n"), F.min(models.EQUAL).alias("low"), F.max(models.EQUAL).alias("high"))
    assert sorted(tuple(r) for r in cut.collect()) == [(0.0, 7, 7, 1, 1), (1.0, 16, 16, 1, 1), (2.0, 16, 1000, 62, 63), (3.0, 1, 1, 1, 1)]
    # two different rows of many copies: a node of ten rows may be split between them, and its cover is its rows
    rows = spark.range(4000).select((F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 2 * 5).cast("double").alias("y"))
    model = models.fit_model("random_forest", rows, ["x"], "y", numTrees=5, maxDepth=2)
    trees = attribution.saved_trees(model, spark)
    assert all(len(t.value) == 3 and sorted(t.value[1:]) == [0.0, 5.0] and 1500 < t.cover[0] < 6500 for t in trees)


def test_shares_of_weighted_rows_are_reached_as_those_of_all(spark):
    from skyloom.operators import ranks

    rng = np.random.default_rng(4)
    values, n = rng.integers(0, 40, 300) / 4, rng.integers(1, 9, 300)
    pairs = [(float(v), None, int(k)) for v, k in zip(values, n)] + [(None, None, 50), (float("nan"), None, 3)]
    df = spark.createDataFrame(pairs, "`a.b` double, c double, n long")
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    whole = np.sort(np.repeat(values, n))
    want = [float(whole[max(0, int(np.ceil(p * len(whole))) - 1)]) for p in probs]
    assert ranks.reached(df, ["a.b", "c"], probs, "n") == {"a.b": want, "c": []}
