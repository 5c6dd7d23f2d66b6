"""File sources, sinks, streams and the status table."""

import json

import pytest
from pyspark.sql import functions as F

from skyloom.functions import derive
from skyloom.plans.suite import run_suite
from skyloom.sources import polygons, tables, trees
from skyloom.streaming import jobs


def test_tree_csv_newest_file(spark, tmp_path):
    head = "geo_point_2d;sortiment;hoogte;aanlegjaar;stamomtrek;beheerfase\n"
    (tmp_path / "trees_2022.csv").write_text(head + "51.0, 3.7;Quercus robur;;1990;10;Jeugdfase\n", encoding="utf-8")
    (tmp_path / "trees_2023.csv").write_text(
        head + "51.0, 3.7;Quercus robur;nan;1990.0;10.5;Jeugdfase\n"
        "51.1,3.8;Ulmaceae zelkova 'Serrata';5;0;x;None\n;Tilia;;;;\n51.2, 3.6;Te Bepalen;;;;\n", encoding="utf-8",
    )
    rows = sorted(trees.read_tree_csv(spark, str(tmp_path)).collect(), key=lambda r: r["latitude"])
    assert [r["genus"] for r in rows] == ["Quercus", "Zelkova", None]
    assert [r["planting_year"] for r in rows] == [1990, None, None]
    assert rows[0]["girth"] == 10.5 and rows[0]["height"] is None and rows[1]["phase"] is None


def test_genus_cases(spark):
    cases = {"Acer platanoides": "Acer", "  Tilia sp.": "Tilia", "'quercus' x": "Quercus", "te bepalen": None, "  ": None,
             "Cornaceae": "Cornaceae", "MALUS,": "Malus"}
    df = spark.createDataFrame(list(cases.items()), "name string, want string")
    for r in df.select("name", "want", derive.genus("name").alias("got")).collect():
        assert r["got"] == r["want"], r


def test_road_geojson(spark, tmp_path):
    square = [[3.7, 51.0], [3.71, 51.0], [3.71, 51.01], [3.7, 51.01], [3.7, 51.0]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"bestemming": "Rijweg", "materiaalsoort": ""},
         "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"type": "Feature", "properties": {"bestemming": "Oprit"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square[:3]]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [square[:3]]}},
    ]}
    path = tmp_path / "wis.geojson"
    path.write_text(json.dumps(doc))
    rows = sorted(polygons.read_road_geojson(spark, str(path)).collect(), key=lambda r: r["bestemming"])
    assert [(r["bestemming"], r["materiaalsoort"], len(r["rings"])) for r in rows] == [("Oprit", None, 1), ("Rijweg", None, 1)]
    assert rows[0]["area_m2"] == pytest.approx(780_854, rel=1e-3)


def test_scan_prunes_partitions(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), F.format_string("2001-%02d", F.col("id") % 3 + 1).alias("partition_key"),
                                 F.lit("t").alias("tile_id"), F.lit(1.0).alias("latitude"), F.col("id").alias("longitude"))
    path = str(tmp_path / "facts")
    tables.clustered_write(df, path)
    got = tables.scan(spark, path, ["2001-02"], ["id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition_key" in plan or "PartitionFilters: [(cast(partition_key" in plan or "partition_key" in plan.split("PartitionFilters")[1][:120]
    assert got.count() == 33


def test_unknown_dataset_and_format_are_refused(spark, tmp_path):
    with pytest.raises(KeyError):
        tables.ingest_datasets(spark, {}, only=["x"])
    with pytest.raises(ValueError):
        tables.write_result(spark.range(1), str(tmp_path / "x"), "xml")


def test_partial_results_are_idempotent(spark, tmp_path):
    """A batch that is written twice counts once."""
    rows = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    partial = jobs.scaler_partial(["v"])
    for _ in range(2):
        partial(rows, 0).write.mode("overwrite").parquet(f"{tmp_path}/rows/batch=0")
    partial(rows, 1).write.mode("overwrite").parquet(f"{tmp_path}/rows/batch=1")
    row = jobs.merged_scaler(jobs.partials(spark, str(tmp_path))).first()
    assert (row["n"], row["mean"], row["var"]) == (4, 2.0, 1.0)


def test_suite_goes_on_after_a_failure(spark, tmp_path):
    def fails():
        raise RuntimeError("no")

    out = run_suite(spark, {"a": lambda: spark.range(3), "b": fails, "c": lambda: spark.range(1)}, str(tmp_path)).collect()
    assert [(r["analysis"], r["status"], r["n_rows"]) for r in out] == [("a", "ok", 3), ("b", "failed", None), ("c", "ok", 1)]


def test_a_feature_file_is_read_in_splits(spark, tmp_path):
    """One file gives several tasks and every feature once; a feature that hides its type is an error."""
    ring = [[3.7, 51.0], [3.71, 51.0], [3.71, 51.01], [3.7, 51.0]]
    features = [
        {"type": "Feature", "properties": {"bestemming": f"r{i} \"x\" }},{{", "materiaalsoort": None}, "geometry": {"type": "Polygon", "coordinates": [ring]}, "id": i}
        for i in range(3000)
    ]
    path = tmp_path / "one.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "name": "x", "features": features, "crs": {"a": [1]}}, indent=1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        read = polygons.read_feature_collection(spark, str(path))
        assert read.rdd.getNumPartitions() > 4
        assert sorted(r["properties"]["bestemming"] for r in read.collect()) == sorted(f["properties"]["bestemming"] for f in features)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    last = tmp_path / "last.geojson"
    last.write_text(json.dumps({"type": "FeatureCollection", "features": [{"geometry": features[0]["geometry"], "properties": {}, "type": "Feature"}]}))
    with pytest.raises(Exception, match="does not begin with its type"):
        polygons.read_feature_collection(spark, str(last)).collect()
