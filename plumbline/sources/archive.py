"""The archival layer: results as typed tables of a fixed form, for Parquet.

Each builder takes what the pipelines return, fills the fields that follow from
it and leaves the rest null, so that provider facts can be joined in later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import haversine_m
from ..operators.crossval import CrossValidation
from ..operators.selection import SEPARATOR

# The fields of the archival tables.
RASTER_INVENTORY = (
    "product_id string, product_role string, track_id string, orbit_direction string, data_locator string, sha256 string, crs string, width int, height int, transform string, "
    "pixel_size_x double, pixel_size_y double, nodata_value double, units string, positive_direction string, start_epoch date, end_epoch date, frame_realization string, "
    "correction_state string, parent_product_ids string, processing_record_id string"
)
STATION_RATE = (
    "solution_id string, station_id string, physical_site_id string, longitude_deg double, latitude_deg double, east_mm_per_year double, north_mm_per_year double, up_mm_per_year double, "
    "sigma_east_mm_per_year double, sigma_north_mm_per_year double, sigma_up_mm_per_year double, cov_en double, cov_eu double, cov_nu double, start_epoch date, end_epoch date, "
    "duration_years double, n_epochs int, frame_realization string, velocity_estimator string, processing_center string, used_in_fitting boolean, source_record_id string"
)
STATION_SAMPLE = (
    "sample_id string, solution_id string, product_id string, row_index int, column_index int, pixel_longitude_deg double, pixel_latitude_deg double, sample_distance_m double, "
    "sampling_rule string, station_cell_finite boolean, inside_raster boolean, inside_auxiliary_hull boolean, insar_value_mm_per_year double, incidence_deg double, heading_deg double, "
    "gnss_projected_los_mm_per_year double, sigma_projected_los_mm_per_year double, residual_insar_minus_gnss_mm_per_year double, included_in_statistics boolean, exclusion_reasons string"
)
VERTICAL_COMPARISON = (
    "solution_id string, product_id string, station_id string, physical_site_id string, longitude_deg double, latitude_deg double, gnss_up_mm_per_year double, sigma_up_mm_per_year double, "
    "insar_vlm_mm_per_year double, residual_insar_minus_gnss_mm_per_year double, station_cell_finite boolean, inside_auxiliary_hull boolean, used_in_fitting boolean, "
    "included_in_statistics boolean, exclusion_reasons string"
)
SPLIT_ASSIGNMENT = (
    "validation_run_id string, method string, orbit_or_product_id string, random_seed long, repeat_id int, fold_id int, group_id string, solution_id string, assignment string, "
    "n_fitting_groups int, n_held_out_groups int, model_specification_id string"
)
PREDICTION = (
    "validation_run_id string, repeat_id int, fold_id int, group_id string, solution_id string, observed_gnss_mm_per_year double, uncorrected_insar_mm_per_year double, "
    "predicted_correction_mm_per_year double, corrected_insar_mm_per_year double, held_out_residual_mm_per_year double"
)
METRIC_SUMMARY = (
    "validation_run_id string, product_id string, orbit_direction string, selection_name string, evidence_tier string, n_observations long, n_unique_physical_sites long, bias_mm_per_year double, "
    "rms_mm_per_year double, centered_rms_mm_per_year double, mae_mm_per_year double, nmad_mm_per_year double, pearson_r double, fraction_abs_residual_within_threshold double, "
    "threshold_mm_per_year double, offset_removed boolean, notes string"
)


def shaped(df: DataFrame, schema: str, **columns: Column | str) -> DataFrame:
    """The fields of ``schema`` in order: those given, those of the same name, or null."""
    out = []
    for field in schema.split(", "):
        name, kind = field.split(" ")
        c = columns.get(name)
        c = F.col(c) if isinstance(c, str) else c
        if c is None:
            c = F.col(name) if name in df.columns else F.lit(None)
        out.append(c.cast(kind).alias(name))
    return df.select(*out)


def raster_inventory(meta: DataFrame, role: str = "vlm", units: str = "mm/year", positive: str = "up", correction_state: str = "raw") -> DataFrame:
    transform = F.concat_ws(" ", *[F.col(c).cast("string") for c in "abcdef"])
    return shaped(meta, RASTER_INVENTORY, product_id="raster_id", product_role=F.lit(role), orbit_direction=F.lit("not_applicable"), transform=transform, pixel_size_x=F.sqrt(F.col("a") ** 2 + F.col("d") ** 2), pixel_size_y=F.sqrt(F.col("b") ** 2 + F.col("e") ** 2), nodata_value="nodata", units=F.lit(units), positive_direction=F.lit(positive), correction_state=F.lit(correction_state))


def station_rates(stations: DataFrame, solution_id: str = "station_id") -> DataFrame:
    return shaped(stations, STATION_RATE, solution_id=solution_id)


def _sample_facts(values: DataFrame, solution_id: str) -> dict[str, Column | str]:
    inside = F.col("pixel_row_zero_based") >= 0
    reasons = F.when(F.col("selection_reason") != "included", F.col("selection_reason"))
    return {
        "solution_id": solution_id, "product_id": "raster_id" if "raster_id" in values.columns else F.lit(None), "station_cell_finite": F.col("pixel_status") == "finite", "inside_raster": inside,
        "residual_insar_minus_gnss_mm_per_year": "residual_mm_per_year", "included_in_statistics": "include_in_metrics", "exclusion_reasons": F.coalesce(reasons, F.lit("")),
        "row_index": F.when(inside, F.col("pixel_row_zero_based")), "column_index": F.when(inside, F.col("pixel_column_zero_based")),
    }


def station_samples(values: DataFrame, solution_id: str = "station_id") -> DataFrame:
    """From vertical or line-of-sight station values."""
    los = "insar_los_mm_per_year" in values.columns
    facts = _sample_facts(values, solution_id)
    product = facts["product_id"] if isinstance(facts["product_id"], Column) else F.col(facts["product_id"])
    more = {"gnss_projected_los_mm_per_year": "gnss_los_mm_per_year", "sigma_projected_los_mm_per_year": "sigma_los_mm_per_year"} if los else {}
    away = haversine_m("longitude_deg", "latitude_deg", "pixel_center_x", "pixel_center_y")
    return shaped(values, STATION_SAMPLE, **facts, **more, sample_id=F.concat_ws(":", F.col(solution_id).cast("string"), product), pixel_longitude_deg="pixel_center_x", pixel_latitude_deg="pixel_center_y", sample_distance_m=away, sampling_rule=F.lit("station_cell"), insar_value_mm_per_year="insar_los_mm_per_year" if los else "insar_vlm_mm_per_year")


def vertical_comparison(values: DataFrame, solution_id: str = "station_id") -> DataFrame:
    return shaped(values, VERTICAL_COMPARISON, **_sample_facts(values, solution_id))


def split_assignments(cv: CrossValidation, run_id: str, model: str = "quadratic") -> DataFrame:
    """Every group's part in every fold and trial."""
    groups = cv.folds.select("orbit", "group_id")
    total = groups.groupBy("orbit").agg(F.count(F.lit(1)).cast("int").alias("g"))
    sets = cv.folds.select("orbit", F.col("fold").alias("split"), "group_id", F.lit("leave_one_group_out").alias("method")).unionByName(cv.cv_assignments().select("orbit", F.col("trial").alias("split"), "group_id", F.lit("repeated_group_holdout").alias("method")))
    held = sets.groupBy("orbit", "method", "split").agg(F.collect_set("group_id").alias("held")).join(F.broadcast(total), "orbit")
    rows = held.join(groups, "orbit")
    out = F.array_contains("held", F.col("group_id"))
    logo = F.col("method") == "leave_one_group_out"
    return shaped(rows, SPLIT_ASSIGNMENT, validation_run_id=F.lit(run_id), orbit_or_product_id="orbit", random_seed=F.when(~logo, F.lit(cv.seed)), repeat_id=F.when(~logo, F.col("split")), fold_id=F.when(logo, F.col("split")), assignment=F.when(out, "held_out").otherwise("fitting"), n_fitting_groups=F.col("g") - F.size("held"), n_held_out_groups=F.size("held"), model_specification_id=F.lit(model))


def predictions(cv: CrossValidation, run_id: str) -> DataFrame:
    """Every observation, held out once."""
    rows = cv.loocv_station_values().join(cv.folds, ["orbit", "group_id"])
    return shaped(rows, PREDICTION, validation_run_id=F.lit(run_id), fold_id="fold", solution_id="station_id", held_out_residual_mm_per_year="residual_mm_per_year")


def metric_summary(metrics: DataFrame, run_id: str, product_id: str | None = None) -> DataFrame:
    return shaped(metrics, METRIC_SUMMARY, validation_run_id=F.lit(run_id), product_id=F.lit(product_id), selection_name="selection", evidence_tier="comparison_role", n_observations="n", pearson_r="correlation", fraction_abs_residual_within_threshold="fraction_within_tolerance", threshold_mm_per_year="tolerance_mm_per_year", offset_removed=F.lit(False))
