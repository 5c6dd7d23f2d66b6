"""Statistics against literal refits on small inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.functions import tails
from skyloom.functions.geo import HEX_NEIGHBOURS
from skyloom.operators import association, gram, models, panel, sampling, spatial_models
from skyloom.operators import transforms as tf
from skyloom.operators.autocorrelation import morans_i


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 400
    z = rng.normal(size=n)
    x = 0.6 * z + rng.normal(size=n)
    y = 2.0 * x - z + rng.normal(size=n)
    return pd.DataFrame({"one": 1.0, "z": z, "x": x, "y": y, "id": range(n), "block": rng.integers(0, 6, n)})


def test_tails_match_known_values():
    assert tails.t_two_sided(2.228138851964939, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_upper(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_upper(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_quantile_975(10) == pytest.approx(2.228138851964939, abs=1e-8)


def test_morans_i_on_hex_flower(spark):
    """Centre and six petals: weights and I written out by hand."""
    cells = [(0, 0), *HEX_NEIGHBOURS]
    values = [5.0, 1.0, 2.0, 3.0, 1.0, 2.0, 4.0]
    df = spark.createDataFrame(
        [(f"h9_{q}_{r}", q, r, v) for (q, r), v in zip(cells, values)], "tile string, q int, r int, value double"
    )
    z = np.array(values) - np.mean(values)
    w = np.zeros((7, 7))
    for i, (q, r) in enumerate(cells):
        for dq, dr in HEX_NEIGHBOURS:
            if (q + dq, r + dr) in cells:
                w[i, cells.index((q + dq, r + dr))] = 1
    w /= w.sum(axis=1, keepdims=True)
    row = morans_i(df, n_perm=49).first()
    assert row["morans_i"] == pytest.approx(7 / w.sum() * (z @ w @ z) / (z @ z), abs=1e-12)
    assert row["expected_i"] == pytest.approx(-1 / 6) and row["n_edges"] == 24
    assert 1 / 50 <= row["p_value"] <= 1


def test_permutations_of_morans_i(spark, monkeypatch):
    """Every permutation's sum equals that over the dealt-out residuals; both ways of permuting tell order from noise."""
    from skyloom.operators import autocorrelation

    rng = np.random.default_rng(3)
    cells = [(q, r) for q in range(12) for r in range(12)]
    z = rng.normal(size=len(cells))
    edges = [(i, cells.index((q + dq, r + dr)), 0.5) for i, (q, r) in enumerate(cells) for dq, dr in HEX_NEIGHBOURS if (q + dq, r + dr) in cells]
    placed = spark.createDataFrame([(f"t{i}", int(p), float(v)) for i, (p, v) in enumerate(zip(rng.permutation(len(z)), z))], "tile string, place long, z double")
    frame = placed.toPandas()
    values = np.zeros(len(z))
    values[frame["place"]] = frame["z"]
    named = spark.createDataFrame([(f"t{a}", f"t{b}", w) for a, b, w in edges], "src string, dst string, w double").repartition(3)
    got = {r["perm"]: r["i"] for r in autocorrelation._held_sums(placed, named, len(z), 20, 7).collect()}
    for p in range(21):
        own = values[autocorrelation.permutation(7, p, len(z))][frame["place"]]
        assert got[p] == pytest.approx(sum(w * own[a] * own[b] for a, b, w in edges))
    for held in (autocorrelation.HELD_TILES, 0):
        monkeypatch.setattr(autocorrelation, "HELD_TILES", held)
        smooth, noise = (
            spark.createDataFrame([(f"t{i}", q, r, float(v)) for i, ((q, r), v) in enumerate(zip(cells, values_))], "tile string, q int, r int, value double")
            for values_ in ([q + r for q, r in cells], z)
        )
        assert morans_i(smooth, n_perm=99).first()["p_value"] == 0.01 and morans_i(noise, n_perm=99).first()["p_value"] > 0.05


def test_partial_correlation_equals_full_regression(spark, data):
    df = spark.createDataFrame(data)
    row = association.partial_correlations(df, ["x"], "y", ["one", "z"], []).first()
    design = data[["one", "z", "x"]].to_numpy()
    beta = np.linalg.lstsq(design, data["y"], rcond=None)[0]
    assert row["effect_slope"] == pytest.approx(beta[2], abs=1e-9)
    res = [data[c] - np.polyval(np.polyfit(data["z"], data[c], 1), data["z"]) for c in "xy"]
    assert row["partial_r"] == pytest.approx(np.corrcoef(*res)[0, 1], abs=1e-9)
    adjusted = association.partial_correlations(df.withColumn("m", F.col("z") * 3), ["x"], "y", ["one"], ["m"]).first()
    assert adjusted["partial_r_adj"] == pytest.approx(row["partial_r"], abs=1e-9)
    want = (adjusted["partial_r"] - adjusted["partial_r_adj"]) / adjusted["partial_r"]
    assert adjusted["confounding_fraction"] == pytest.approx(want)


def test_wide_and_narrow_products_agree(spark, data, monkeypatch):
    df = spark.createDataFrame(data)
    narrow = {r["block"]: (r["n"], r["products"]) for r in gram.gram_by(df, ["one", "x", "y"], ["block"]).collect()}
    monkeypatch.setattr(gram, "EXPRESSION_LIMIT", 1)
    monkeypatch.setattr(gram, "GROUPS_IN_MEMORY", 2)
    wide = {r["block"]: (r["n"], r["products"]) for r in gram.gram_by(df, ["one", "x", "y"], ["block"]).collect()}
    assert narrow.keys() == wide.keys()
    for k in narrow:
        assert narrow[k][0] == wide[k][0]
        np.testing.assert_allclose(narrow[k][1], wide[k][1], rtol=1e-10)


def test_block_subtraction_equals_refit(spark, data):
    df = spark.createDataFrame(data)
    got = spatial_models.leave_block_out(df, ["one", "z", "x"], "y", "block", df, ridge=1e-4).toPandas()
    for row in got.itertuples():
        train, test = data[data.block != row.block], data[data.block == row.block]
        xt = train[["one", "z", "x"]].to_numpy()
        beta = np.linalg.solve(xt.T @ xt + 1e-4 * np.eye(3), xt.T @ train["y"])
        e = test["y"] - test[["one", "z", "x"]].to_numpy() @ beta
        assert row.rmse == pytest.approx(math.sqrt((e**2).mean()), abs=1e-9)
        assert row.n_train == len(train) and row.n_test == len(test)


@pytest.fixture(scope="module")
def unbalanced():
    rng = np.random.default_rng(2)
    rows = []
    for tile in range(12):
        start = 24000 + 12 * (tile % 4 + 1)
        for month in range(24000, 24000 + 72):
            for _ in range(rng.integers(0, 3)):
                d = 1.0 + tile % 2 if month >= start else 0.0
                c = rng.normal()
                y = 3 * tile + math.sin(month) + 1.5 * d + 0.5 * c + rng.normal()
                rows.append((f"t{tile}", int(month), y, d, c))
    return pd.DataFrame(rows, columns=["tile", "scene_ym", "y", "d", "c"])


def test_two_way_effects_equal_dummy_regression(spark, unbalanced):
    fit = panel.two_way_fit(spark.createDataFrame(unbalanced), ["d", "c"])
    dummies = pd.get_dummies(unbalanced[["tile", "scene_ym"]].astype(str), dtype=float)
    x = np.column_stack([unbalanced[["d", "c"]], dummies])
    beta = np.linalg.lstsq(x, unbalanced["y"], rcond=None)[0]
    assert fit.beta["d"] == pytest.approx(beta[0], abs=1e-8) and fit.beta["c"] == pytest.approx(beta[1], abs=1e-8)
    # clustered covariance from residualised columns, same scaling
    q = dummies.to_numpy()
    res = lambda v: v - q @ np.linalg.lstsq(q, v, rcond=None)[0]
    xt = np.column_stack([res(unbalanced["d"].to_numpy()), res(unbalanced["c"].to_numpy())])
    e = res(unbalanced["y"].to_numpy()) - xt @ beta[:2]
    meat = sum(np.outer(s, s) for s in (
        (xt[(unbalanced.tile == t).to_numpy()] * e[(unbalanced.tile == t).to_numpy(), None]).sum(axis=0)
        for t in unbalanced.tile.unique()))
    bread = np.linalg.inv(xt.T @ xt)
    n = len(unbalanced)
    free = n - 2 - (unbalanced.tile.nunique() + unbalanced.scene_ym.nunique() - 1)
    np.testing.assert_allclose(fit.covariance, bread @ meat @ bread * n / free, rtol=1e-6)
    absorbed = panel.two_way_fit(spark.createDataFrame(unbalanced).withColumn("same", F.lit(2.0)), ["d", "same"])
    assert absorbed.dropped == ["same"]


def test_event_study_equals_dummy_regression(spark, unbalanced):
    df = spark.createDataFrame(unbalanced)
    got, p = panel.event_study(df, (-2, 3))
    rows = panel.event_time(df, (-2, 3)).toPandas()
    ks = [k for k in range(-2, 4) if k != -1]
    dummies = pd.get_dummies(rows[["tile", "scene_ym"]].astype(str), dtype=float)
    x = np.column_stack([*[(rows.k_bin == k).astype(float) for k in ks], dummies])
    want = dict(zip(ks, np.linalg.lstsq(x, rows["y"], rcond=None)[0]))
    found = {r["event_time"]: r["estimate"] for r in got.collect()}
    used = list(found)
    if set(used) == set(ks):
        for k in ks:
            assert found[k] == pytest.approx(want[k], abs=1e-6)
    assert 0 <= p <= 1


def test_scene_year_keeps_december(spark):
    from skyloom.functions.derive import scene_year

    df = spark.createDataFrame([(2001 * 12 + 12, 2001), (2002 * 12 + 1, 2002)], "ym int, want int")
    assert all(r["want"] == r["got"] for r in df.select("want", scene_year("ym").alias("got")).collect())


def test_targets_and_quotas(spark):
    assert sum(sampling.target_vector("year", {})) == pytest.approx(1)
    t = sampling.target_vector("temperature", {20: 1, 21: 1, 23.0: 2})
    assert t[15] == 0.5 and t[16] == 0.5  # 21 and 23 sit between edges: the lower one wins
    assert sampling.normalise_targets({20: 0.4, 30: 0.6}) == {"temperature": {20: 0.4, 30: 0.6}}
    with pytest.raises(KeyError):
        sampling.normalise_targets({"colour": {}})
    hist = spark.createDataFrame([("a", [2, 2, 0]), ("b", [0, 0, 0])], "partition_key string, c array<long>")
    got = {r["partition_key"]: r["w"] for r in hist.select("partition_key", sampling.overlap(F.col("c"), [0.5, 0.25, 0.25]).alias("w")).collect()}
    assert got == {"a": 0.75, "b": 0.0}
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "partition_key string, weight double")
    q = {r["partition_key"]: r["quota"] for r in sampling.quotas(weights, 11).collect()}
    assert q == {"a": 6, "b": 3, "c": 2} and sum(q.values()) == 11


def test_outlier_calendar(spark):
    from skyloom.plans.slices import month_keys

    rows = sampling.expand_months(sampling.period_table(spark)).collect()
    assert len(rows) == sum(len(month_keys(a, b)) for _, a, b in sampling.OUTLIER_PERIODS)
    assert {r["partition_key"] for r in rows if r["label"] == "drought_2018"} == {"2018-05", "2018-06", "2018-07", "2018-08"}


def test_strict_checks_raise(spark):
    df = spark.createDataFrame([(1.0, 2.0), (100.0, 3.0)], "x double, y double")
    assert {r["check"] for r in tf.check_inputs(df, ["x"], "y").collect()} == {"feature_too_large"}
    with pytest.raises(tf.QualityError):
        tf.check_inputs(df, ["x"], "y", strict=True)
    scaler = tf.fit_scaler(df, ["x"])
    assert tf.check_scaler(df, scaler, ["x", "z"]).collect()[0]["column"] == "z"
    assert tf.check_coefficients(df, {"x": 60.0}).count() == 1


def test_models_learn_and_failures_are_recorded(spark, data):
    df = spark.createDataFrame(data)
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    got = models.train_all(
        train, test, ["z", "x"], "y", ["linear", "huber", "nystroem", "random_forest"],
        {"nystroem": {"n_components": 40, "gamma": 0.05}, "random_forest": {"numTrees": 10, "maxDepth": 5}},
    ).toPandas().set_index("model")
    assert (got["r2"] > 0.5).all() and got.loc["linear", "rmse"] < 1.2
    search = models.grid_search("ridge", train, test, ["z", "x"], "y", {"regParam": [0.0, -1.0]}).toPandas()
    assert search["error"].notna().sum() == 1 and search["rmse"].notna().sum() == 1
    model = models.fit_model("linear", train, ["z", "x"], "y")
    imp = models.permutation_importance(lambda f: models.predict(model, f), test, ["z", "x"], "y", "id").toPandas()
    assert imp.set_index("feature")["delta_mse"]["x"] > 1
    share = models.feature_importance(model, ["z", "x"], train).toPandas()
    assert share["importance"].sum() == pytest.approx(1)


def test_registry_size_and_names():
    from skyloom.plans.registry import build_registry

    reg = build_registry()
    assert len(reg) == 138
    assert {"dhm_avg50m_elevation_avg", "dhm_avg50m_count", "trees_plantedby_70m_count",
            "trees_plantedby_50m_beheerfase=Jeugdfase_count", "ua_vegetation_100m_frac", "wis_Fietspad_voetpad_50m_frac",
            "wis_Gebakken_klinkers_50m_frac"} <= set(reg.columns())
    hints = reg.scaler_hints()
    assert hints["ua_vegetation_100m_frac"] == "minmax" and "dhm_avg50m_count" not in hints
    assert len(reg.key()) == 16


def test_transforms_replace_and_keep_their_outputs(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    out = tf.apply_transforms(df, [tf.func(["a"], lambda v: v * 10, "'"), tf.polynomial(["a'"], 2, drop_inputs=True)])
    assert set(out.columns) == {"b", "a'", "a'^2"} and out.select("`a'^2`").first()[0] == 100.0
    again = tf.apply_transforms(df.withColumn("b'", F.lit(5.0)), [tf.func(["b"], lambda v: v * 10, "'")])
    assert set(again.columns) == {"a", "b'"} and again.select("`b'`").first()[0] == 20.0


def test_features_leave_out_target_sources(spark):
    assert tf.feature_columns(spark.createDataFrame([(1.0, 1.0, 1.0)], "ndvi double, aster_lst double, x double")) == ["x"]


def test_models_score_rows_with_missing_features(spark):
    rows = [(float(i), None if i % 5 == 0 else float(i), 2.0 * i) for i in range(50)]
    df = spark.createDataFrame(rows, "z double, x double, y double").withColumn("e", F.lit(None).cast("double"))
    for kind in ("ridge", "nystroem", "random_forest"):
        model = models.fit_model(kind, df, ["z", "x", "e"], "y", **({"n_components": 20} if kind == "nystroem" else {}))
        assert models.predict(model, df).where("prediction is not null").count() == 50
