from plumbline.operators.crossval import CrossValidation
from plumbline.plans import pipelines
from plumbline.sources import archive
from tests.test_crossval import frame, rows
from tests.test_raster_selection import STATION, grid, station


def fields(schema):
    return [f.split(" ")[0] for f in schema.split(", ")]


def test_samples_and_metrics(spark):
    cells, meta = grid(spark, [[1.0, -9999.0]])
    values = pipelines.vlm_station_values(spark.createDataFrame([station("A", -123.95, 47.95), station("B", -123.85, 47.95), station("C", 0.0, 0.0)], STATION), cells, meta)
    got = {r["solution_id"]: r for r in archive.station_samples(values).collect()}
    assert list(got["A"].asDict()) == fields(archive.STATION_SAMPLE)
    assert got["A"]["sample_id"] == "A:vlm" and got["A"]["sample_distance_m"] < 1 and got["A"]["exclusion_reasons"] == "" and got["A"]["included_in_statistics"]
    assert got["B"]["exclusion_reasons"] == "raster_no_data" and got["B"]["inside_raster"] and not got["C"]["inside_raster"] and got["C"]["row_index"] is None
    assert archive.vertical_comparison(values).count() == 3 and archive.station_rates(values).columns == fields(archive.STATION_RATE)
    inventory = archive.raster_inventory(meta).first()
    assert (inventory["product_id"], inventory["pixel_size_y"]) == ("vlm", 0.1)
    summary = archive.metric_summary(pipelines.metrics_frame(values, "insar_vlm_mm_per_year", "gnss_up_mm_per_year"), "run", "vlm").first()
    assert (summary["n_observations"], summary["evidence_tier"], summary["offset_removed"]) == (1, "independent", False)


def test_splits(spark):
    cv = CrossValidation(frame(spark, rows(noise=0.1, groups=9)), 2, 0.3, 4)
    got = archive.split_assignments(cv, "run")
    assert got.columns == fields(archive.SPLIT_ASSIGNMENT) and got.count() == 9 * 9 + 2 * 9
    assert got.where("assignment = 'held_out'").count() == 9 + 2 * 3
    assert archive.predictions(cv, "run").count() == 37
