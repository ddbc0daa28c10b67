import csv
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.operators import verify
from plumbline.operators.selection import Rules
from plumbline.plans.report import build_report, csv_table, escape, labeled_path, metadata_table
from plumbline.sources import geotiff, sinks, tables
from plumbline.sources.metadata import check_metadata
from plumbline.streaming import rows as streaming

META = {
    "velocity_units": "mm/year", "coordinate_crs": "EPSG:4326", "vertical_positive": "up", "reference_frame": "synthetic", "observation_window": "2020/2026", "comparison_role": "independent",
    "los_sign": "toward_satellite", "incidence_definition": "from_vertical", "heading_convention": "satellite_flight_heading_clockwise_from_north", "angle_units": "degrees", "insar_product_stage": "test",
    "uncertainty_semantics": "one_standard_deviation_rate_uncertainty", "los_uncertainty_model": "diagonal_enu_rate_covariance_zero_cross_terms",
}
TRANSFORM = (0.1, 0.0, -124.0, 0.0, -0.1, 48.0)
HEADER = "station_id,longitude_deg,latitude_deg,east_mm_per_year,north_mm_per_year,up_mm_per_year,sigma_east_mm_per_year,sigma_north_mm_per_year,sigma_up_mm_per_year,quality"


@pytest.fixture
def inputs(spark, tmp_path):
    spark.dataSource.register(geotiff.GeoTiffSource)
    (tmp_path / "metadata.json").write_text(json.dumps(META))
    lines = [HEADER, "0001,-123.95,47.95,0,0,0,.2,.3,.4,accepted", "NA,-123.85,47.95,0,0,1,.2,.3,.4,accepted", "BAD,-123.95,47.85,0,0,3,.2,.3,.4,rejected", "GAP,-123.85,47.85,0,0,1,.2,.3,.4,accepted"]
    (tmp_path / "stations.csv").write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")
    geotiff.write_geotiff(tmp_path / "vlm.tif", np.array([[0, 1], [5, -9999]], "<f4"), TRANSFORM, nodata=-9999)
    for name in ("incidence", "heading"):
        geotiff.write_geotiff(tmp_path / f"{name}.tif", np.zeros((2, 2), "<f4"), TRANSFORM)
    return tmp_path


def table(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.DictReader(f))


def run(*args):
    return cli.main([str(a) for a in args])


@pytest.mark.parametrize("mode", ["vlm", "los"])
def test_validate(inputs, mode, capsys):
    rasters = ["--vlm", inputs / "vlm.tif"] if mode == "vlm" else ["--los", inputs / "vlm.tif", "--incidence", inputs / "incidence.tif", "--heading", inputs / "heading.tif"]
    args = ["validate", mode, "--stations", inputs / "stations.csv", "--metadata", inputs / "metadata.json", *rasters, "--require-status", "quality=accepted", "--output-dir", inputs / "out"]
    assert run(*args) == 0
    values = {r["station_id"]: r for r in table(inputs / "out/station_values.csv")}
    assert set(values) == {"0001", "NA", "BAD", "GAP"} and values["GAP"][f"insar_{mode}_mm_per_year"] == "" and values["0001"]["group_id"] == "r0_c0"
    metrics = table(inputs / "out/metrics.csv")
    assert len(metrics) == 1 and metrics[0]["n"] == "2" and float(metrics[0]["rms_mm_per_year"]) == 0
    assert {r["station_id"] for r in table(inputs / "out/exclusions.csv")} == {"BAD", "GAP"}
    record = json.loads((inputs / "out/provenance.json").read_text())
    assert record["inputs"]["stations"]["file"] == "stations.csv" and len(record["inputs"]["stations"]["sha256"]) == 64 and str(inputs) not in json.dumps(record)
    capsys.readouterr()
    assert run(*args) == 2 and "already holds" in capsys.readouterr().err
    assert run(*args, "--overwrite") == 0
    assert [r["station_id"] for r in table(inputs / "out/station_values.csv")] == ["0001", "NA", "BAD", "GAP"]  # the order of the input
    saved = ["--station-values", inputs / "out/station_values.csv", "--metrics", inputs / "out/metrics.csv", "--raster", inputs / "vlm.tif"]
    capsys.readouterr()
    assert run("plot-data", mode, *saved, "--output", inputs / "plot.json") == 0
    found = json.loads(capsys.readouterr().out)
    assert found == json.loads((inputs / "plot.json").read_text()) and found["region"] == pytest.approx([-124, -123.8, 47.8, 48]) and found["metrics"]["n"] == 2
    assert ("histogram" in found) == (mode == "vlm")
    assert run("plot-data", mode, *saved, "--output", inputs / "plot.json") == 2
    assert run("plot-data", mode, *saved, "--residual-limit", -1) == 2
    capsys.readouterr()
    assert run("plot-preflight", "--mode", mode, *saved) == 0
    found = json.loads(capsys.readouterr().out)
    assert (found["station_rows"], found["included_in_metrics"], found["raster"]["file"]) == (4, 2, "vlm.tif")
    # A raster that does not hold the saved values, and one without data.
    for data, word in (([[7, 1], [5, -9999]], "differ"), ([[-9999, -9999], [-9999, -9999]], "no data")):
        geotiff.write_geotiff(inputs / "other.tif", np.array(data, "<f4"), TRANSFORM, nodata=-9999)
        assert run("plot-preflight", "--mode", mode, *saved[:-1], inputs / "other.tif") == 2 and word in capsys.readouterr().err
    if mode == "vlm":
        assert run("plot-data", "vlm", *saved, "--region", -123.89, -123.81, 47.81, 47.89) == 2 and "no data" in capsys.readouterr().err
        assert run("report", "--title", "T|x", "--metadata", inputs / "metadata.json", "--metric-table", f"All={inputs / 'out/metrics.csv'}", "--output", inputs / "report.md") == 0
        text = (inputs / "report.md").read_text()
        assert "correlation" in text and tables.file_sha256(inputs / "out/metrics.csv") in text


def test_saved_values_are_read_strictly(spark, tmp_path):
    head = "station_id,longitude_deg,latitude_deg,insar_vlm_mm_per_year,gnss_up_mm_per_year,sigma_up_mm_per_year,residual_mm_per_year,include_in_metrics"
    good = ["a,1,2,3,1,,2,yes", "b,1,2,,1,0.5,,no", "c,1,2,5,1,0.5,4,1"]
    p = tmp_path / "v.csv"

    def read(*lines):
        p.write_text("\n".join([head, *lines]) + "\n")
        return verify.read_station_values(spark, str(p), "vlm")

    assert read(*good).count() == 3
    for lines, words in (
        ([*good, "d,1,x7,5,1,0.5,4,1"], "v.csv line 5, latitude_deg: 'x7'"), ([*good, "d,1,2,5,1,0.5,4,maybe"], "line 5, include_in_metrics: 'maybe'"), ([*good, "a,1,2,3,1,,2,yes"], "not unique"),
        ([*good, ",1,2,3,1,,2,yes"], "without a station_id"), ([*good, "d,1,2,5,1,-0.5,4,1"], "negative sigma_up_mm_per_year at d"), ([*good, "d,1,2,,1,0.5,,1"], "included station d"),
        ([*good, "d,1,2,5,1,0.5,9,0", "e,1,2,5,1,0.5,7,0"], "largest mismatch is 5 mm/year at d"), ([good[1]], "no station is included"),
    ):
        with pytest.raises(ValueError, match=words):
            read(*lines)


def test_cv_figure(tmp_path, capsys):
    trials, loocv = tmp_path / "cv_trials.csv", tmp_path / "loocv.csv"
    trials.write_text("trial,orbit,all_rms_mm_per_year,holdout_rms_mm_per_year\n1,a,1,2\n2,a,3,4\n1,b,5,6\n")
    loocv.write_text("orbit,rms_mm_per_year\na,2.5\n")
    args = ["--trials", trials, "--metrics", loocv]
    assert run("plot-data", "cv-rms", *args) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["groups"]["a"] == {"trials": 2, "all_median_rms_mm_per_year": 2.0, "holdout_median_rms_mm_per_year": 3.0, "loocv_rms_mm_per_year": 2.5} and found["groups"]["b"]["loocv_rms_mm_per_year"] is None
    assert found["axis"][1] > 6 and run("plot-data", "cv-rms", *args, "--rms-limit", 0) == 2
    capsys.readouterr()
    assert run("plot-preflight", "--mode", "cv-rms", *args) == 0
    assert json.loads(capsys.readouterr().out)["groups"] == {"a": {"trials": 2, "has_loocv_metric": True}, "b": {"trials": 1, "has_loocv_metric": False}}
    assert run("plot-preflight") == 0 and run("plot-preflight", "--mode", "cv-rms") == 2
    for path, text, word in ((loocv, "orbit,rms_mm_per_year\nz,2.5\n", "no trials for"), (trials, "trial,orbit,all_rms_mm_per_year,holdout_rms_mm_per_year\n1,a,1,2\n1,b,oops,6\n", "line 3, all_rms"), (trials, "trial,orbit,all_rms_mm_per_year,holdout_rms_mm_per_year\n1,a,1,2\n1,a,3,6\n", "not unique")):
        path.write_text(text)
        capsys.readouterr()
        assert run("plot-data", "cv-rms", *args) == 2 and word in capsys.readouterr().err


def test_preflight(inputs, capsys):
    args = ["preflight", "vlm", "--stations", inputs / "stations.csv", "--metadata", inputs / "metadata.json", "--vlm", inputs / "vlm.tif"]
    assert run(*args) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["table"]["rows"] == 4 and found["rasters"][0]["crs"] == "EPSG:4326" and found["table"]["columns"][0] == "station_id"
    (inputs / "metadata.json").write_text(json.dumps(META | {"coordinate_crs": "EPSG:3857"}))
    assert run(*args) == 2
    assert run("preflight", "vlm", "--stations", inputs / "none.csv", "--metadata", inputs / "metadata.json", "--vlm", inputs / "vlm.tif") == 2


def test_cross_validate(inputs):
    from tests.test_crossval import rows

    with open(inputs / "obs.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["orbit", "station_id", "group_id", "normalized_pixel_x", "normalized_pixel_y", "residual_before_fit_mm_per_year"])
        w.writerows(rows())
    args = ["validate", "cross-validate", "--observations", inputs / "obs.csv", "--metadata", inputs / "metadata.json", "--trials", 3, "--seed", 5, "--output-dir"]
    assert run(*args, inputs / "a") == 0 and run(*args, inputs / "b") == 0
    assert len(table(inputs / "a/loocv_folds.csv")) == 36 and len(table(inputs / "a/cv_trials.csv")) == 3
    assert (inputs / "a/cv_assignments.csv").read_bytes() == (inputs / "b/cv_assignments.csv").read_bytes()


@pytest.mark.parametrize("dtype,tile,deflate", [("<f4", None, False), ("<f8", 16, True), ("<i2", None, True), ("<u1", 16, False)])
def test_geotiff_round_trip(spark, tmp_path, dtype, tile, deflate):
    spark.dataSource.register(geotiff.GeoTiffSource)
    data = (np.arange(37 * 21).reshape(37, 21) % 100).astype(dtype)
    geotiff.write_geotiff(tmp_path / "r.tif", data, TRANSFORM, 32610, 7, tile, deflate)
    row = geotiff.meta_row(tmp_path / "r.tif")
    assert (row["width"], row["height"], row["crs"], row["nodata"], row["a"], row["f"], row["band_count"]) == (21, 37, "EPSG:32610", 7.0, 0.1, 48.0, 1)
    got = {(r[1], r[2]): r[3] for r in spark.read.format("geotiff").load(str(tmp_path / "r.tif")).collect()}
    assert got == {(r, c): float(data[r, c]) for r in range(37) for c in range(21) if data[r, c] != 7}


def test_geotiff_refusals(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"no tiff at all")
    with pytest.raises(ValueError):
        geotiff.read_header(tmp_path / "x.tif")


def test_metadata_contract():
    assert check_metadata(META, "los", True) is META
    for change in ({"velocity_units": "m"}, {"los_sign": "up"}, {"angle_units": "rad"}, {"uncertainty_semantics": "?"}, {"los_uncertainty_model": "?"}, {"comparison_role": "x"}):
        with pytest.raises(ValueError):
            check_metadata(META | change, "los", True)
    with pytest.raises(ValueError, match="reference_frame"):
        check_metadata({k: v for k, v in META.items() if k != "reference_frame"}, "vlm")
    check_metadata({k: v for k, v in META.items() if not k.startswith("los")}, "vlm")


def test_readers(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id , flag ,v\n 0001 ,Yes, 1.5 \nNA,excluded,NaN\nx,?,2\n")
    df = tables.read_strict(spark, p, ["id", "v"])
    assert df.columns == ["id", "flag", "v"] and [r["id"] for r in df.collect()] == ["0001", "NA", "x"]
    assert [r[0] for r in df.select(tables.parse_flag("flag")).collect()] == [True, False, None]
    assert [r[0] for r in df.select(tables.strict_number("v", True)).collect()] == [1.5, None, 2.0]
    with pytest.raises(Exception, match="flag: not a finite number"):
        df.select(tables.strict_number("flag")).collect()
    assert tables.select_one(df, {"id": "NA"})["flag"] == "excluded"
    for filters in ({"id": "none"}, {}, {"nope": "1"}):
        with pytest.raises(ValueError):
            tables.select_one(df, filters)
    for text in ("", "a,a\n1,2\n", "a,b\n"):
        p.write_text(text)
        with pytest.raises(ValueError):
            tables.read_strict(spark, p)
    p.write_text("abc")
    row = tables.file_digests(spark, str(p)).first()
    assert (row["file"], row["sha256"]) == ("t.csv", tables.file_sha256(p))


def test_trials(spark):
    schema = "group string, trial int, all_rms_mm_per_year double, fitting_rms_mm_per_year double, holdout_rms_mm_per_year double, orbit string, rms_mm_per_year double"
    good = spark.createDataFrame([("a", 1, 1.0, 1.0, 1.0, "a", 1.0), ("a", 2, 1.0, 1.0, 1.0, "b", 1.0)], schema)
    assert tables.load_trials(good).count() == 2
    for df in (good.unionByName(good), good.withColumn("all_rms_mm_per_year", F.lit(-1.0)), good.withColumn("all_rms_mm_per_year", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            tables.load_trials(df)
    loocv = tables.load_loocv_metrics(good)
    tables.check_group_cover(loocv.where("orbit = 'a'"), good.where("orbit = 'a'"))
    with pytest.raises(ValueError):
        tables.check_group_cover(loocv, good.where("orbit = 'a'"))


def test_verify(spark):
    schema = "station_id string, insar_vlm_mm_per_year double, gnss_up_mm_per_year double, sigma_up_mm_per_year double, residual_mm_per_year double, include_in_metrics string"
    df = spark.createDataFrame([("a", 1.0, 0.0, 0.1, 1.0, "True"), ("b", 4.0, 1.0, None, 3.0, "yes"), ("c", 9.0, 0.0, 0.1, 1.0, "no"), ("d", None, 1.0, -1.0, None, "1")], schema)
    assert tuple(verify.consistency(df).first()) == (4, 3, 1, 1, 1)
    good = {"n": 2, "bias_mm_per_year": 2.0, "rms_mm_per_year": 5**0.5, "centered_rms_mm_per_year": 1.0, "mae_mm_per_year": 2.0, "correlation": 1.0}
    assert verify.verify_metrics(df, good)["n"] == 2
    for change in ({"n": 3}, {"bias_mm_per_year": 2.1}, {"correlation": ""}):
        with pytest.raises(ValueError):
            verify.verify_metrics(df, good | change)


def test_sinks(spark, tmp_path):
    out = sinks.prepare_output(tmp_path / "o")
    df = spark.createDataFrame([(2, float("nan"), ["a", "b"]), (1, None, [])], "k int, v double, w array<string>")
    sinks.write_table(df, out / "metrics", ("k",))
    assert (out / "metrics.csv").read_text() == "k,v,w\n1,,\n2,,a;b\n"
    with pytest.raises(FileExistsError):
        sinks.prepare_output(out)
    assert sinks.prepare_output(out, True) == out
    assert [p.name for p in out.iterdir()] == ["metrics.csv"]


def test_large_tables_keep_their_form(spark, tmp_path):
    out = sinks.prepare_output(tmp_path / "o")
    df = spark.range(200_001).withColumn("v", F.col("id") * 0.5)
    sinks.write_table(df, out / "cv_trials", ("id",), form="parquet")
    assert spark.read.parquet(str(out / "cv_trials.parquet")).count() == 200_001
    with pytest.raises(FileExistsError):
        sinks.write_table(df, out / "cv_trials", ("id",))
    sinks.write_table(df, out / "cv_trials", ("id",), overwrite=True)
    assert [p.name for p in out.iterdir()] == ["cv_trials.csv"]
    lines = (out / "cv_trials.csv").read_text().splitlines()
    assert (len(lines), lines[0], lines[-1]) == (200_002, "id,v", "200000,100000.0")
    with pytest.raises(ValueError):
        sinks.write_table(df, out / "x", form="xls")


def test_report(tmp_path):
    assert escape("a|b\nc") == "a\\|b c"
    assert metadata_table({"z": 1, "a": 2, "los_sign": "x"}).splitlines()[2:] == ["| los_sign | x |", "| a | 2 |", "| z | 1 |"]
    (tmp_path / "m.csv").write_text("a,b\n")
    assert csv_table(tmp_path / "m.csv") == "_No rows._"
    assert labeled_path("A=x/y=z")[0] == "A"
    with pytest.raises(ValueError):
        labeled_path("x")
    path = build_report("T", META, [], tmp_path / "r.md")
    assert "No table was given." in path.read_text()
    with pytest.raises(FileExistsError):
        build_report("T", META, [], path)


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, "a,b"), (2, 'x,1,2,3,4,5,6,7,8,q,9,"r"')], "line_id long, raw_text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("line_id long, raw_text string").parquet(str(tmp_path / "in"))
    q = streaming.stream_records(stream).writeStream.format("memory").queryName("parsed").start()
    q.processAllAvailable()
    q.stop()
    assert {r["line_id"]: r["reason"] for r in spark.table("parsed").collect()} == {1: "wrong_column_count", 2: None}
    seen = []
    q = streaming.each_batch(stream, lambda df, i: seen.append(df.count()), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 2
    with pytest.raises(ValueError):
        streaming.stream_reasons(stream, Rules(deduplicate_within_m=1.0))
