"""Station selection by rules that give every reason, not just the first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.scalar import finite_or_null, is_finite
from .components import connected_components
from .near import Cells

RATES = ("east_mm_per_year", "north_mm_per_year", "up_mm_per_year")
SIGMAS = ("sigma_east_mm_per_year", "sigma_north_mm_per_year", "sigma_up_mm_per_year")
SEPARATOR = ";"


@dataclass(frozen=True)
class Rules:
    """Options of the selection; None switches a rule off."""

    exclude_ids: tuple[str, ...] = ()
    require_status: Mapping[str, str] = field(default_factory=dict)
    min_duration_years: float | None = None
    min_distance_from_fitting_m: float | None = None
    max_component_sigma: float | None = None
    deduplicate_within_m: float | None = None

    def __post_init__(self) -> None:
        for name in ("min_duration_years", "min_distance_from_fitting_m", "max_component_sigma"):
            v = getattr(self, name)
            if v is not None and not 0 <= v < float("inf"):
                raise ValueError(f"{name} must be finite and not negative")
        d = self.deduplicate_within_m
        if d is not None and not 0 < d < float("inf"):
            raise ValueError("deduplicate_within_m must be positive and finite")


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def has_sigmas(df: DataFrame, uncertainty_semantics: str | None = "one_standard_deviation_rate_uncertainty") -> bool:
    """Whether the sigma triple is there; a part of it is an error, and so is a
    triple whose meaning the metadata does not declare."""
    there = [s for s in SIGMAS if s in df.columns]
    if there and len(there) < len(SIGMAS):
        raise ValueError(f"only part of the sigma columns: {', '.join(there)}")
    if there and uncertainty_semantics != "one_standard_deviation_rate_uncertainty":
        raise ValueError("uncertainty_semantics must be one_standard_deviation_rate_uncertainty")
    return bool(there)


def require_unique(df: DataFrame, key: str, show: int = 10) -> None:
    twice = [r[0] for r in df.groupBy(key).count().where("count > 1").orderBy(key).limit(show).collect()]
    if twice:
        raise ValueError(f"{key} is not unique: {twice}")


def max_sigma(sigmas: Sequence[str] = SIGMAS) -> Column:
    """The largest sigma; null unless all are finite."""
    known = None
    for s in sigmas:
        known = is_finite(s) if known is None else known & is_finite(s)
    return F.when(known, F.greatest(*[F.col(s) for s in sigmas]))


def rule_reasons(df: DataFrame, rules: Rules, station_id: str = "station_id") -> DataFrame:
    """Add ``reasons``, an array in the order of the rules."""
    require_columns(df, [station_id, "longitude_deg", "latitude_deg", *RATES])
    checks: list[tuple[str, Column]] = [
        ("nonfinite_coordinate", ~(is_finite("longitude_deg") & is_finite("latitude_deg"))),
        ("nonfinite_enu_rate", ~(is_finite(RATES[0]) & is_finite(RATES[1]) & is_finite(RATES[2]))),
    ]
    if rules.exclude_ids:
        checks.append(("explicit_station_exclusion", F.coalesce(F.col(station_id).cast("string").isin(*rules.exclude_ids), F.lit(False))))
    for column, value in rules.require_status.items():
        require_columns(df, [column])
        checks.append((f"status_{column}_not_{value}", ~F.col(column).cast("string").eqNullSafe(F.lit(value))))
    if rules.min_duration_years is not None:
        require_columns(df, ["duration_years"])
        checks.append(("record_too_short", ~is_finite("duration_years") | (F.col("duration_years") < rules.min_duration_years)))
    if rules.min_distance_from_fitting_m is not None:
        require_columns(df, ["nearest_fitting_distance_m"])
        checks.append(("too_close_to_fitting_site", ~is_finite("nearest_fitting_distance_m") | (F.col("nearest_fitting_distance_m") <= rules.min_distance_from_fitting_m)))
    if has_sigmas(df):
        bad = F.lit(False)
        for s in SIGMAS:
            bad = bad | ~is_finite(s) | F.coalesce(F.col(s) < 0, F.lit(False))
        checks.append(("invalid_rate_uncertainty", bad))
        if rules.max_component_sigma is not None:
            largest = max_sigma()
            checks.append(("component_rate_uncertainty_above_threshold", largest.isNull() | (largest > rules.max_component_sigma)))
    elif rules.max_component_sigma is not None:
        raise ValueError("max_component_sigma needs the sigma columns")
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks])))


def site_components(sites: DataFrame, site_id: str, threshold_m: float = 100.0) -> DataFrame:
    """``site_id, component_id`` of every site with a location: single-link
    clusters of sites less than ``threshold_m`` apart, numbered from zero by
    their smallest id.

    Sites at one place are linked through the place, not in pairs; near places
    come from the Voronoi partition, components from Borůvka hooking. Sites
    without finite coordinates, or with a latitude beyond 90, are left out.
    """
    ok = is_finite("longitude_deg") & is_finite("latitude_deg") & F.coalesce(F.abs(F.col("latitude_deg")) <= 90, F.lit(False))
    lon = F.col("longitude_deg") - F.lit(360.0) * F.floor((F.col("longitude_deg") + 180.0) / 360.0)
    own = sites.where(ok).select(F.col(site_id).alias("id"), (lon + F.lit(0.0)).alias("lon"), (F.col("latitude_deg") + F.lit(0.0)).alias("lat"))
    at = own.groupBy("lon", "lat").agg(F.min("id").alias("first"))
    pairs = Cells(at.select("lon", "lat"), threshold_m).near(threshold_m)
    a = at.select(F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"), F.col("first").alias("a"))
    b = at.select(F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"), F.col("first").alias("b"))
    linked = pairs.join(a, ["lon_a", "lat_a"]).join(b, ["lon_b", "lat_b"]).select("a", "b")
    parts = connected_components(linked, "a", "b").select(F.col("node").alias("first"), "component")
    rows = own.join(at, ["lon", "lat"]).join(parts, "first", "left").select("id", F.coalesce("component", "first").alias("least"))
    numbers = _numbered(rows.select("least").distinct(), "least")
    return rows.join(numbers, "least").select(F.col("id").alias(site_id), F.col("n").alias("component_id"))


def _numbered(keys: DataFrame, key: str) -> DataFrame:
    """Number distinct keys from zero in order, without one task for all: by
    ranges, with the counts of the ranges before."""
    ranged = keys.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id())
    from ..plans.lineage import cut

    fixed = cut(ranged)
    counts = fixed.groupBy("_part").count()
    before = counts.select("_part", (F.sum("count").over(W.Window.orderBy("_part")) - F.col("count")).alias("_before"))  # one row a partition
    inside = F.row_number().over(W.Window.partitionBy("_part").orderBy(key)) - 1
    return fixed.withColumn("_n", inside).join(F.broadcast(before), "_part").select(key, (F.col("_before") + F.col("_n")).cast("long").alias("n"))


def deduplicate_sites(sites: DataFrame, site_id: str = "station_id", threshold_m: float = 100.0) -> DataFrame:
    """Add ``component_id`` and ``is_representative`` to sites with a location.

    The representative of a component has the longest record, then the lowest
    largest sigma, then the smallest id; missing values come last. It is the
    minimum of a struct, which combines before the shuffle.
    """
    parts = site_components(sites, site_id, threshold_m)
    duration = finite_or_null("duration_years") if "duration_years" in sites.columns else F.lit(None).cast("double")
    sigma = max_sigma() if all(s in sites.columns for s in SIGMAS) else F.lit(None).cast("double")
    rank = F.struct(duration.isNull().alias("d0"), (-duration).alias("d"), sigma.isNull().alias("s0"), sigma.alias("s"), F.col(site_id).alias("id"))
    rows = sites.join(parts, site_id).withColumn("_rank", rank)
    best = rows.groupBy("component_id").agg(F.min("_rank").alias("_best"))
    return rows.join(best, "component_id").withColumn("is_representative", F.col("_rank") == F.col("_best")).drop("_rank", "_best")


def select_stations(df: DataFrame, rules: Rules, station_id: str = "station_id") -> DataFrame:
    """Add ``reasons`` with the de-duplication, which looks only at stations that
    no other rule excludes, and ``selection_reason`` (``eligible`` if none)."""
    ruled = rule_reasons(df, rules, station_id)
    if rules.deduplicate_within_m is not None:
        require_columns(df, ["duration_years"])
        candidates = ruled.where(F.size("reasons") == 0)
        kept = deduplicate_sites(candidates, station_id, rules.deduplicate_within_m).where("is_representative").select(station_id, F.lit(True).alias("_kept"))
        ruled = ruled.join(kept, station_id, "left")
        other = (F.size("reasons") == 0) & F.col("_kept").isNull()
        ruled = ruled.withColumn("reasons", F.when(other, F.array(F.lit("nonrepresentative_physical_site_record"))).otherwise(F.col("reasons"))).drop("_kept")
    return ruled.withColumn("selection_reason", reason_text("reasons"))


def reason_text(reasons: str, none: str = "eligible") -> Column:
    return F.coalesce(F.nullif(F.array_join(reasons, SEPARATOR), F.lit("")), F.lit(none))
