import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import raster, support
from plumbline.operators.selection import Rules, deduplicate_sites, has_sigmas, require_unique, select_stations
from plumbline.plans import pipelines

META = "raster_id string, crs string, width int, height int, a double, b double, c double, d double, e double, f double, nodata double, dtype string, band_count int"
STATION = "station_id string, longitude_deg double, latitude_deg double, east_mm_per_year double, north_mm_per_year double, up_mm_per_year double, sigma_east_mm_per_year double, sigma_north_mm_per_year double, sigma_up_mm_per_year double, quality string, duration_years double, nearest_fitting_distance_m double"


def grid(spark, values, rid="vlm", nodata=-9999.0, **change):
    head = {"raster_id": rid, "crs": "EPSG:4326", "width": len(values[0]), "height": len(values), "a": 0.1, "b": 0.0, "c": -124.0, "d": 0.0, "e": -0.1, "f": 48.0, "nodata": nodata, "dtype": "float32", "band_count": 1} | change
    cells = [(rid, r, c, v) for r, row in enumerate(values) for c, v in enumerate(row)]
    return spark.createDataFrame(cells, "raster_id string, row_index int, column_index int, cell_value double"), spark.createDataFrame([tuple(head.values())], META)


def station(sid, lon, lat, up=1.0, sigma=0.3, quality="accepted", duration=10.0, distance=1000.0):
    return (sid, lon, lat, 0.0, 0.0, up, 0.1, 0.2, sigma, quality, duration, distance)


def test_edges_nodata_and_status(spark):
    cells, meta = grid(spark, [[1.0, -9999.0], [3.0, float("nan")]])
    points = [("nw", -124.0, 48.0), ("mid", -123.9, 47.9), ("in", -123.95, 47.95), ("nd", -123.85, 47.95), ("nan", -123.85, 47.85), ("east", -123.8, 47.95), ("south", -123.95, 47.8), ("bad", None, 47.9), ("off", -123.95, float("inf"))]
    df = spark.createDataFrame(points, "station_id string, longitude_deg double, latitude_deg double").withColumn("width", F.lit("clash"))
    got = {r["station_id"]: (r["pixel_status"], r["cell_value"], r["group_id"]) for r in raster.sample(df, cells, meta).collect()}
    assert got["nw"] == ("finite", 1.0, "r0_c0") and got["in"] == ("finite", 1.0, "r0_c0")
    assert got["nd"][0] == got["nan"][0] == "no_data" and got["nd"][2] == "r0_c1"
    assert got["bad"] == ("invalid_coordinate", None, "") and got["off"][0] == "invalid_coordinate"
    assert got["south"][0] == got["east"][0] == "out_of_bounds"
    assert raster.sample(df.limit(0), cells, meta).count() == 0 and raster.sample(df, cells, meta.limit(0)).count() == 0


def test_rotated(spark):
    cells, meta = grid(spark, [[1.0, 2.0], [3.0, 4.0]], a=0.0, b=1.0, c=0.0, d=1.0, e=0.0, f=0.0)
    df = spark.createDataFrame([("p", 1.5, 0.5), ("q", 0.5, 1.5)], "station_id string, longitude_deg double, latitude_deg double")
    got = {r["station_id"]: (r["cell_value"], r["pixel_center_x"], r["pixel_center_y"]) for r in raster.sample(df, cells, meta).collect()}
    assert got == {"p": (3.0, 1.5, 0.5), "q": (2.0, 0.5, 1.5)}


def test_audit(spark):
    _, a = grid(spark, [[1.0]], "a")
    _, b = grid(spark, [[1.0]], "b", c=-120.0)
    _, c = grid(spark, [[1.0]], "c", crs="epsg:4326")
    raster.audit_coregistration(a.unionByName(c), ["a", "c"])
    with pytest.raises(ValueError, match="grid"):
        raster.audit_coregistration(a.unionByName(b), ["a", "b"])
    with pytest.raises(ValueError, match="missing"):
        raster.audit_coregistration(a, ["a", "z"])
    assert raster.crs_matches("EPSG:4326", "urn:ogc:def:crs:epsg::4326") and not raster.crs_matches("EPSG:4326", None)


def vlm(spark, rows, values, rules):
    cells, meta = grid(spark, values)
    return pipelines.vlm_station_values(spark.createDataFrame(rows, STATION), cells, meta, rules, crs="EPSG:4326")


def test_only_accepted_stations_with_data_count(spark):
    """One station of each kind on a grid of four cells; excluded ones keep their values."""
    rows = [station("kept", -123.97, 47.93, -2.5), station("rejected", -123.83, 47.83, 4.5, quality="poor"), station("vague", -123.92, 47.88, 7.0, sigma=2.6), station("over gap", -123.88, 47.97, 1.5)]
    values = vlm(spark, rows, [[-2.0, -9999.0], [7.5, 4.0]], Rules(require_status={"quality": "accepted"}, max_component_sigma=2.5))
    found = pipelines.metrics_frame(values, "insar_vlm_mm_per_year", "gnss_up_mm_per_year").first()
    assert (found["n"], found["bias_mm_per_year"], found["correlation"]) == (1, 0.5, None)
    out = {r["station_id"]: (r["selection_reason"], r["pixel_status"]) for r in pipelines.exclusions(values).collect()}
    assert out == {"over gap": ("raster_no_data", "no_data"), "vague": ("component_rate_uncertainty_above_threshold", "finite"), "rejected": ("status_quality_not_accepted", "finite")}
    kept = {r["station_id"]: (r["insar_vlm_mm_per_year"], r["residual_mm_per_year"]) for r in values.collect()}
    assert kept == {"kept": (-2.0, 0.5), "rejected": (4.0, -0.5), "vague": (7.5, 0.5), "over gap": (None, None)}


def test_sites_are_represented_by_what_passes_the_rules(spark):
    """The longest of three records at a site breaks a rule, so the next longest stands for it."""
    rows = [station("w1", -123.86, 47.96, duration=8.0), station("w2", -123.8601, 47.9602, duration=11.0), station("w3", -123.8602, 47.9601, sigma=9.0, duration=40.0), station("alone", -123.94, 47.84, duration=6.0)]
    values = vlm(spark, rows, [[0.5, 1.5], [2.5, 3.5]], Rules(max_component_sigma=5.0, deduplicate_within_m=60.0))
    got = {r["station_id"]: r["selection_reason"] for r in values.collect()}
    assert got == {"w1": "nonrepresentative_physical_site_record", "w2": "included", "w3": "component_rate_uncertainty_above_threshold", "alone": "included"}


def test_los_zero_is_valid(spark):
    rows = [station("ZERO", -123.95, 47.95, 0.0), station("ONE", -123.85, 47.95, 1.0)]
    parts = [grid(spark, [[0.0, 1.0], [5.0, 6.0]], "los"), grid(spark, [[0.0, 0.0], [0.0, 0.0]], "inc"), grid(spark, [[0.0, 0.0], [0.0, -9999.0]], "head")]
    cells, meta = parts[0]
    for c, m in parts[1:]:
        cells, meta = cells.unionByName(c), meta.unionByName(m)
    values = pipelines.los_station_values(spark.createDataFrame([*rows, station("GEO", -123.85, 47.85)], STATION), cells, meta, "los", "inc", "head")
    got = {r["station_id"]: r for r in values.collect()}
    assert got["ZERO"]["residual_mm_per_year"] == 0 and got["ZERO"]["include_in_metrics"] and got["ONE"]["sigma_los_mm_per_year"] == pytest.approx(0.3)
    assert got["GEO"]["pixel_status"] == "geometry_no_data" and got["GEO"]["selection_reason"] == "raster_geometry_no_data" and not got["GEO"]["include_in_metrics"]
    assert pipelines.metrics_frame(values, "insar_los_mm_per_year", "gnss_los_mm_per_year").first()["n"] == 2


def test_thresholds_at_equality_and_all_reasons(spark):
    rows = [
        station("DUR", 0.0, 0.0, duration=5.0), station("DIST", 1.0, 1.0, distance=500.0), station("SIG", 2.0, 2.0, sigma=2.0), station("X", 3.0, 3.0), station("NEG", 4.0, 4.0, sigma=-1.0),
        station("ALL", None, 5.0, up=None, sigma=None, quality=None, duration=None, distance=None), station("0001", 6.0, 6.0), station("NA", 7.0, 7.0),
    ]
    rules = Rules(("X",), {"quality": "accepted"}, 5.0, 500.0, 2.0)
    got = {r[0]: r[1] for r in select_stations(spark.createDataFrame(rows, STATION), rules).select("station_id", "selection_reason").collect()}
    assert got["DUR"] == got["SIG"] == got["0001"] == got["NA"] == "eligible" and got["DIST"] == "too_close_to_fitting_site" and got["X"] == "explicit_station_exclusion" and got["NEG"] == "invalid_rate_uncertainty"
    assert got["ALL"] == "nonfinite_coordinate;nonfinite_enu_rate;status_quality_not_accepted;record_too_short;too_close_to_fitting_site;invalid_rate_uncertainty;component_rate_uncertainty_above_threshold"


def test_chain_dedup(spark):
    rows = [("A", 0.0, 10.0, 0.2), ("B", 0.0007, 20.0, 0.5), ("C", 0.0014, 20.0, 0.3), ("D", 0.01, 5.0, 0.1), ("E", 0.01, None, None)]
    df = spark.createDataFrame([station(i, x, 0.0001, sigma=s, duration=d) for i, x, d, s in rows], STATION).withColumn("component", F.lit(1)).withColumn("lon", F.lit(1))
    got = {r["station_id"]: (r["component_id"], r["is_representative"]) for r in deduplicate_sites(df).collect()}
    assert got == {"A": (0, False), "B": (0, False), "C": (0, True), "D": (1, True), "E": (1, False)}
    assert deduplicate_sites(df.limit(0)).count() == 0


def test_guards(spark):
    df = spark.createDataFrame([station("A", 0.0, 1.0)] * 2, STATION)
    with pytest.raises(ValueError, match="unique"):
        require_unique(df, "station_id")
    with pytest.raises(ValueError, match="part"):
        has_sigmas(df.drop("sigma_up_mm_per_year"))
    with pytest.raises(ValueError, match="semantics"):
        has_sigmas(df, None)
    for bad in ({"min_duration_years": -1}, {"deduplicate_within_m": 0}, {"max_component_sigma": float("nan")}):
        with pytest.raises(ValueError):
            Rules(**bad)
    with pytest.raises(ValueError, match="missing"):
        select_stations(df, Rules(require_status={"nope": "x"}))


def test_same_result_for_any_partitioning(spark):
    rows = [station(f"S{i}", (i * 7 % 50) / 1000, (i * 11 % 50) / 1000, duration=float(i % 9)) for i in range(120)]
    df = spark.createDataFrame(rows, STATION)
    one, many = (sorted(map(tuple, deduplicate_sites(df.repartition(n)).select("station_id", "component_id", "is_representative").collect())) for n in (1, 8))
    assert one == many


def test_support(spark):
    sites = spark.createDataFrame([(0.0, 0.0), (10.0, 0.0), (5.0, 10.0), (5.0, 3.0), (None, 1.0)], "longitude_deg double, latitude_deg double")
    rows = spark.createDataFrame([("a", 1.0, 0.0), ("b", 5.0, 5.0), ("c", 20.0, 0.0), ("n", None, 0.0)], "station_id string, longitude_deg double, latitude_deg double")
    got = {r[0]: r["nearest_fitting_distance_m"] for r in support.nearest_site_distance(rows, sites).collect()}
    assert got["a"] == pytest.approx(111195.08, abs=0.5) and got["n"] is None
    assert support.nearest_site_distance(rows, sites.limit(0)).where("nearest_fitting_distance_m IS NOT NULL").count() == 0
    hull = support.hull_of(sites.repartition(3), "longitude_deg", "latitude_deg")
    assert len(hull) == 3
    assert {r[0]: r["inside_fitting_hull"] for r in support.inside_hull(rows, hull, "longitude_deg", "latitude_deg").collect()} == {"a": True, "b": True, "c": False, "n": None}
    assert all(r["inside_fitting_hull"] in (False, None) for r in support.inside_hull(rows, hull[:2], "longitude_deg", "latitude_deg").collect())
    rng = np.random.default_rng(3)
    pts = np.round(rng.normal(size=(400, 2)), 2)
    many = spark.createDataFrame([(float(x), float(y)) for x, y in pts], "x double, y double")
    hull = support.hull_of(many.repartition(5), "x", "y")
    asked = np.concatenate([np.round(rng.normal(size=(300, 2)) * 2, 2), hull, (hull + np.roll(hull, 1, axis=0)) / 2])
    sides = np.stack([np.roll(hull, -1, axis=0) - hull], axis=0)[0]
    want = [bool((sides[:, 0] * (y - hull[:, 1]) - sides[:, 1] * (x - hull[:, 0]) >= -1e-9).all()) for x, y in asked]
    assert support._between(hull, asked[:, 0], asked[:, 1], 1e-9).tolist() == want and 50 < sum(want) < 330
    tiers = support.evidence_tiers(spark.createDataFrame([("x", "internal"), ("y", "independent")], "selection string, comparison_role string"))
    assert {(r["selection"], r["evidence_tier"]) for r in tiers.collect()} == {("x", 1), ("y", 2)}


def test_a_far_nearest_cell_is_a_null(spark):
    cells, meta = grid(spark, [[1.0, -9999.0, -9999.0, -9999.0, -9999.0, -9999.0]], "r")
    points = spark.createDataFrame([(i, -123.95 + 0.1 * i, 47.95) for i in range(6)] + [(9, 0.0, 0.0)], "n int, longitude_deg double, latitude_deg double")
    got = {r["n"]: (r["distance_cells"], r["cell_value"]) for r in support.nearest_valid_cell(points, cells, meta, "n", 2).collect()}
    assert got == {0: (0.0, 1.0), 1: (1.0, 1.0), 2: (2.0, 1.0), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_more_than_a_thousand_rasters(spark):
    n = 1203
    meta = spark.range(n).selectExpr("concat('r', id) AS raster_id", "CASE WHEN id = 1200 THEN 'EPSG:3857' ELSE 'EPSG:4326' END AS crs", "2 AS width", "2 AS height", "1.0D AS a", "0.0D AS b", "0.0D AS c", "0.0D AS d", "-1.0D AS e", "2.0D AS f", "CAST(NULL AS DOUBLE) AS nodata", "'float32' AS dtype", "1 AS band_count")
    cells = meta.selectExpr("raster_id", "0 AS row_index", "0 AS column_index", "1.0D AS cell_value").unionByName(meta.selectExpr("raster_id", "1 AS row_index", "1 AS column_index", "2.0D AS cell_value"))
    got = raster.crop(cells, meta, 0.0, 1.0, 1.0, 2.0)
    assert got.count() == got.select("raster_id").distinct().count() == n
    assert {tuple(r)[1:] for r in got.collect()} == {(0, 0, 0.5, 1.5, 1.0)}
    with pytest.raises(ValueError, match="r1200"):
        pipelines._check_crs(meta, "EPSG:4326")
