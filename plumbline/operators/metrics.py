"""Residual and accuracy summaries, by any keys.

All parts but the quantiles are algebraic and combine before the shuffle. The
deviation about the median needs the median first: a second pass. The residuals
and their keys, a few bytes a row, are written once, so that what made them is
not computed again for the second pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite_or_null, is_finite
from ..plans.lineage import cut

NMAD_SCALE = 1.4826
RESIDUAL_METRICS = (
    "n", "bias_mm_per_year", "rms_mm_per_year", "centered_rms_mm_per_year", "mae_mm_per_year", "median_residual_mm_per_year", "nmad_mm_per_year",
    "fraction_within_tolerance", "tolerance_mm_per_year", "minimum_residual_mm_per_year", "maximum_residual_mm_per_year",
)
PAIR_METRICS = ("mean_insar_mm_per_year", "mean_gnss_mm_per_year", "correlation")


def _checked(tolerance: float) -> float:
    if not 0 <= tolerance < float("inf"):
        raise ValueError("the tolerance must be finite and not negative")
    return float(tolerance)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's coefficient as an aggregate; null for fewer than two pairs or a
    series without range, where ``corr`` would divide by zero."""
    ranged = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return F.when(ranged, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def _keyed(left: DataFrame, right: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Add ``value`` of ``right`` by keys of which null equals null; without
    keys ``right`` has one row, read as a scalar subquery."""
    if not by:
        return left.withColumn(value, right.select(value).scalar())
    names = {k: f"_{k}" for k in by}
    renamed = right.select(*by, value).withColumnsRenamed(names)
    on = None
    for k, r in names.items():
        c = left[k].eqNullSafe(renamed[r])
        on = c if on is None else on & c
    return left.join(renamed, on, "left").drop(*names.values())


def summarize_residuals(rows: DataFrame, residual: str, by: Sequence[str] = (), tolerance: float = 2.0, extra: Sequence[Column] = (), keep: Sequence[str] = ()) -> DataFrame:
    """The eleven residual metrics (RESIDUAL_METRICS) for each key.

    Rows whose residual is null or not finite are left out; a key that has only
    such rows gives n = 0 and nulls; without keys there is always one row.
    ``extra`` are further aggregates for the first pass, over the columns ``keep``.
    """
    by, tol = list(by), _checked(tolerance)
    work = cut(rows.select(*by, *keep, finite_or_null(F.col(residual).cast("double")).alias("_r")))
    r = F.col("_r")
    first = work.groupBy(*by).agg(
        F.count(r).alias("n"), F.avg(r).alias("bias_mm_per_year"), F.sqrt(F.avg(r * r)).alias("rms_mm_per_year"), F.stddev_pop(r).alias("centered_rms_mm_per_year"),
        F.avg(F.abs(r)).alias("mae_mm_per_year"), F.percentile(r, F.lit(0.5)).alias("median_residual_mm_per_year"),
        F.avg((F.abs(r) <= tol).cast("double")).alias("fraction_within_tolerance"), F.lit(tol).alias("tolerance_mm_per_year"),
        F.min(r).alias("minimum_residual_mm_per_year"), F.max(r).alias("maximum_residual_mm_per_year"), *extra,
    )
    medians = first.select(*by, F.col("median_residual_mm_per_year").alias("_m"))
    off = _keyed(work.where(r.isNotNull()).select(*by, "_r"), medians, by, "_m")
    spread = off.groupBy(*by).agg((F.lit(NMAD_SCALE) * F.percentile(F.abs(r - F.col("_m")), F.lit(0.5))).alias("nmad_mm_per_year"))
    out = _keyed(first, spread, by, "nmad_mm_per_year")
    names = [*by, *RESIDUAL_METRICS]
    return out.select(*names, *[c for c in out.columns if c not in names])


def accuracy_metrics(rows: DataFrame, insar: str, gnss: str, by: Sequence[str] = (), tolerance: float = 2.0) -> DataFrame:
    """The residual metrics of ``insar - gnss`` with the means and the
    correlation of both; only pairs of which both sides are finite count."""
    a, b = F.col(insar).cast("double"), F.col(gnss).cast("double")
    both = is_finite(a) & is_finite(b)
    work = rows.select(*by, F.when(both, a).alias("_a"), F.when(both, b).alias("_b"), F.when(both, a - b).alias("_d"))
    x, y = F.col("_a"), F.col("_b")
    extra = (F.avg(x).alias("mean_insar_mm_per_year"), F.avg(y).alias("mean_gnss_mm_per_year"), correlation(x, y).alias("correlation"))
    return summarize_residuals(work, "_d", by, tolerance, extra, ("_a", "_b"))


def rms_distribution(trials: DataFrame, by: str = "orbit", scopes: Sequence[str] = ("all", "fitting", "holdout"), suffix: str = "_rms_mm_per_year") -> DataFrame:
    """``orbit, scope, trials, mean_rms, standard_deviation_of_rms, p2_5_rms, median_rms, p97_5_rms``."""
    long = trials.select(by, *[F.col(f"{s}{suffix}").alias(s) for s in scopes]).unpivot([by], list(scopes), "scope", "rms")
    q = F.percentile("rms", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = long.groupBy(by, "scope").agg(F.count("rms").alias("trials"), F.avg("rms").alias("mean_rms"), F.stddev_samp("rms").alias("standard_deviation_of_rms"), q.alias("_q"))
    return out.select(by, "scope", "trials", "mean_rms", "standard_deviation_of_rms", F.col("_q")[0].alias("p2_5_rms"), F.col("_q")[1].alias("median_rms"), F.col("_q")[2].alias("p97_5_rms"))
