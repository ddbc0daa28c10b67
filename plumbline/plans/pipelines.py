"""The comparison pipelines: vertical and line of sight."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import enu_to_los, project_diagonal_sigma
from ..functions.scalar import finite_or_null, is_finite
from ..operators.metrics import PAIR_METRICS, RESIDUAL_METRICS, accuracy_metrics
from ..operators.raster import crs_matches, sample, sample_colocated
from ..operators.selection import Rules, has_sigmas, reason_text, select_stations

METRIC_COLUMNS = ("selection", "comparison_role", *RESIDUAL_METRICS, *PAIR_METRICS)
#: Quality rules reject a row; a raster reason is added where no value was found.


def _check_crs(meta: DataFrame, declared: str | None, raster_ids: list[str] | None = None) -> None:
    if declared is None:
        return
    own = meta if raster_ids is None else meta.where(F.col("raster_id").isin(raster_ids))
    for r in own.groupBy("crs").agg(F.min("raster_id").alias("raster_id")).toLocalIterator():
        if not crs_matches(declared, r["crs"]):
            raise ValueError(f"{r['raster_id']} is in {r['crs']}, not {declared}")


def _dispositions(rows: DataFrame, finite_pair) -> DataFrame:
    """Reasons with the raster's, and the inclusion that follows from them."""
    lost = F.col("pixel_status") != "finite"
    reasons = F.when(lost, F.concat(F.col("reasons"), F.array(F.concat(F.lit("raster_"), F.col("pixel_status"))))).otherwise(F.col("reasons"))
    rows = rows.withColumn("reasons", reasons)
    include = (F.size("reasons") == 0) & finite_pair
    return rows.withColumns({"selection_reason": reason_text("reasons", "included"), "include_in_metrics": include}).drop("reasons")


def vlm_station_values(stations: DataFrame, cells: DataFrame, meta: DataFrame, rules: Rules = Rules(), station_id: str = "station_id", crs: str | None = None) -> DataFrame:  # noqa: B008
    """All station columns with raster_id, pixel columns, the vertical rates of
    raster and station, sigma, residual, reasons and inclusion; one row for each
    station and raster. Excluded rows keep their values."""
    _check_crs(meta, crs)
    sampled = sample(select_stations(stations, rules, station_id).drop("group_id"), cells, meta)
    sigma = finite_or_null("sigma_up_mm_per_year") if has_sigmas(stations) else F.lit(None).cast("double")
    rows = sampled.withColumns({"insar_vlm_mm_per_year": F.col("cell_value"), "gnss_up_mm_per_year": finite_or_null("up_mm_per_year"), "sigma_up_mm_per_year": sigma}).drop("cell_value")
    rows = rows.withColumn("residual_mm_per_year", F.col("insar_vlm_mm_per_year") - F.col("gnss_up_mm_per_year"))
    return _dispositions(rows, F.col("residual_mm_per_year").isNotNull())


def los_station_values(stations: DataFrame, cells: DataFrame, meta: DataFrame, los: str, incidence: str, heading: str, rules: Rules = Rules(), station_id: str = "station_id", positive_direction: str = "toward_satellite", crs: str | None = None) -> DataFrame:  # noqa: B008
    """As :func:`vlm_station_values`, with rates and sigmas projected into the
    line of sight by the incidence and heading of the containing cell. An
    incidence outside [0, 90] at any sampled station stops the job."""
    _check_crs(meta, crs, [los, incidence, heading])
    names = {los: "insar_los_mm_per_year", incidence: "incidence_deg", heading: "heading_deg"}
    rows = sample_colocated(select_stations(stations, rules, station_id).drop("group_id"), cells, meta, names)
    seen = F.col("pixel_status") == "finite"
    inc, head = F.when(seen, F.col("incidence_deg")), F.when(seen, F.col("heading_deg"))
    rates = [finite_or_null(c) for c in ("east_mm_per_year", "north_mm_per_year", "up_mm_per_year")]
    gnss = enu_to_los(*rates, inc, head, positive_direction=positive_direction)
    if has_sigmas(stations):
        triple = ("sigma_east_mm_per_year", "sigma_north_mm_per_year", "sigma_up_mm_per_year")
        usable = is_finite(triple[0]) & is_finite(triple[1]) & is_finite(triple[2])
        for s in triple:
            usable = usable & F.coalesce(F.col(s) >= 0, F.lit(False))
        sigma = project_diagonal_sigma(*[F.when(usable, F.col(s)) for s in triple], inc, head, positive_direction=positive_direction)
    else:
        sigma = F.lit(None).cast("double")
    rows = rows.withColumns({"gnss_los_mm_per_year": gnss, "sigma_los_mm_per_year": sigma})
    rows = rows.withColumn("residual_mm_per_year", F.when(seen, F.col("insar_los_mm_per_year") - F.col("gnss_los_mm_per_year")))
    return _dispositions(rows, F.col("residual_mm_per_year").isNotNull())


def metrics_frame(values: DataFrame, insar: str, gnss: str, label: str = "formal", role: str = "independent", tolerance: float = 2.0, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each key) with label, role and all metrics of the included rows."""
    found = accuracy_metrics(values.where("include_in_metrics"), insar, gnss, by, tolerance)
    return found.select(*by, F.lit(label).alias("selection"), F.lit(role).alias("comparison_role"), *RESIDUAL_METRICS, *PAIR_METRICS)


def exclusions(values: DataFrame, station_id: str = "station_id", keep: tuple[str, ...] = ()) -> DataFrame:
    return values.where(~F.col("include_in_metrics")).select(*keep, station_id, "longitude_deg", "latitude_deg", "selection_reason", "pixel_status")


def metadata_options(metadata: Mapping[str, Any]) -> dict[str, str]:
    return {"positive_direction": metadata["los_sign"], "crs": metadata["coordinate_crs"]}
