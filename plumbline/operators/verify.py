"""Checks of saved results against what they claim."""

from __future__ import annotations

import math
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import is_finite, to_double
from ..sources.tables import parse_flag, read_strict, require_sound, unique_rows, with_source_row
from .metrics import accuracy_metrics
from .raster import sample

VALUE = {"vlm": ("insar_vlm_mm_per_year", "gnss_up_mm_per_year", "sigma_up_mm_per_year"), "los": ("insar_los_mm_per_year", "gnss_los_mm_per_year", "sigma_los_mm_per_year")}
COMPARED = ("bias_mm_per_year", "rms_mm_per_year", "centered_rms_mm_per_year", "mae_mm_per_year", "correlation")


def consistency(values: DataFrame, mode: str = "vlm", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of what saved station values must not have: included rows that are
    incomplete or have a negative sigma, residuals that are not the difference
    (1e-7 relative and absolute), and the number included, by any keys."""
    insar, gnss, sigma = (F.col(c) for c in VALUE[mode])
    inc = F.coalesce(parse_flag("include_in_metrics"), F.lit(False))
    res, diff = F.col("residual_mm_per_year"), insar - gnss
    whole = is_finite(insar) & is_finite(gnss) & is_finite(res)
    off = F.abs(res - diff) > F.lit(1e-7) + F.lit(1e-7) * F.abs(diff)
    return values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(inc).alias("n_included"), F.count_if(inc & ~whole).alias("n_incomplete"),
        F.count_if(inc & F.coalesce(sigma < 0, F.lit(False))).alias("n_negative_sigma"), F.count_if(whole & off).alias("n_residual_mismatch"),
    )


def worst_residual(values: DataFrame, mode: str = "vlm", key: str = "station_id", by: tuple[str, ...] = ()) -> DataFrame:
    """The row whose residual is farthest from the difference of its rates:
    ``by, key, mismatch``; of equals that of the smallest key. Rows without all
    three numbers are not compared; null where none is."""
    insar, gnss, _ = (F.col(c) for c in VALUE[mode])
    res = F.col("residual_mm_per_year")
    off = F.when(is_finite(insar) & is_finite(gnss) & is_finite(res), F.abs(res - (insar - gnss)))
    rows = values.select(*by, key, off.alias("mismatch"))
    order = F.when(F.col("mismatch").isNotNull(), F.struct(-F.col("mismatch"), F.col(key)))
    return rows.groupBy(*by).agg(F.min_by(key, order).alias(key), F.max("mismatch").alias("mismatch"))


def read_station_values(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """Saved station values for a figure: unique ids, all fields sound, sigmas
    not negative, included rows complete, residuals the raw difference. The
    first fault, or the largest mismatch, is named in the ValueError."""
    insar, gnss, sigma = VALUE[mode]
    numbers = ["longitude_deg", "latitude_deg", insar, gnss, sigma, "residual_mm_per_year"]
    name = Path(path).name
    raw = with_source_row(read_strict(spark, path, ["station_id", *numbers, "include_in_metrics"]))
    require_sound(raw, name, gaps=numbers, flags=["include_in_metrics"])
    unique_rows(raw, ["station_id"])
    values = raw.withColumns({c: to_double(c) for c in numbers})
    inc = parse_flag("include_in_metrics")
    whole = is_finite("longitude_deg") & is_finite("latitude_deg") & is_finite(insar) & is_finite(gnss) & is_finite("residual_mm_per_year")
    first = lambda c: F.min_by("station_id", F.when(c, F.col("source_row")))
    blank, negative, broken = F.coalesce(F.col("station_id") == "", F.lit(True)), F.coalesce(F.col(sigma) < 0, F.lit(False)), inc & ~whole
    seen = values.agg(F.count_if(blank), F.count_if(inc), F.count_if(negative), first(negative), F.count_if(broken), first(broken)).first()
    if seen[0]:
        raise ValueError(f"{name}: {seen[0]} rows without a station_id")
    if not seen[1]:
        raise ValueError(f"{name}: no station is included")
    if seen[2]:
        raise ValueError(f"{name}: negative {sigma} at {seen[3]}")
    if seen[4]:
        raise ValueError(f"{name}: included station {seen[5]} lacks a coordinate, rate or residual")
    if consistency(values, mode).first()["n_residual_mismatch"]:
        worst = worst_residual(values, mode).first()
        raise ValueError(f"{name}: residual is not radar minus station; the largest mismatch is {worst['mismatch']:.6g} mm/year at {worst['station_id']}")
    return values


def verify_metrics(values: DataFrame, saved: Mapping[str, float], mode: str = "vlm", tolerance: float = 1e-6) -> dict[str, float]:
    """The recomputed metrics; ValueError where a saved one differs or the saved
    ones break RMS^2 = bias^2 + centred RMS^2."""
    inc = F.coalesce(parse_flag("include_in_metrics"), F.lit(False))
    insar, gnss, _ = VALUE[mode]
    own = accuracy_metrics(values.where(inc), insar, gnss).first().asDict()
    if not own["n"]:
        raise ValueError("no included station")
    if int(saved["n"]) != own["n"]:
        raise ValueError(f"n is {saved['n']}, recomputed {own['n']}")

    def number(v) -> float:
        return math.nan if v is None or v == "" else float(v)

    for name in COMPARED:
        a, b = number(saved[name]), number(own[name])
        if not (math.isnan(a) and math.isnan(b)) and not math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance):
            raise ValueError(f"{name} is {a:.9g}, recomputed {b:.9g}")
    bias, rms, centred = (number(saved[n]) for n in COMPARED[:3])
    if not math.isclose(rms * rms, bias * bias + centred * centred, rel_tol=2e-6, abs_tol=2e-6):
        raise ValueError("RMS^2 differs from bias^2 + centred RMS^2")
    return own


def sample_mismatches(values: DataFrame, cells: DataFrame, meta: DataFrame, tolerance: float = 1e-4, key: str = "station_id", value: str = "insar_vlm_mm_per_year") -> DataFrame:
    """Included stations whose saved value is not that of the raster's cell:
    ``raster_id, key, saved_value, raster_value``. ``values`` holds raster_id."""
    inc = values.where(F.coalesce(parse_flag("include_in_metrics"), F.lit(False))).select(F.col("raster_id").alias("_rid"), key, "longitude_deg", "latitude_deg", F.col(value).alias("saved_value"))
    got = sample(inc, cells, meta).where(F.col("_rid") == F.col("raster_id"))
    close = F.abs(F.col("cell_value") - F.col("saved_value")) <= tolerance
    return got.where(~F.coalesce(close, F.lit(False))).select("raster_id", key, "saved_value", F.col("cell_value").alias("raster_value"))


def verify_samples(values: DataFrame, cells: DataFrame, meta: DataFrame, tolerance: float = 1e-4, key: str = "station_id", value: str = "insar_vlm_mm_per_year") -> None:
    bad = sample_mismatches(values, cells, meta, tolerance, key, value).limit(8).collect()
    if bad:
        raise ValueError(f"raster and saved values differ: {[tuple(r) for r in bad]}")
