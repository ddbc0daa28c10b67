"""The queries of the validation engine, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cv_sql
from . import fixtures as fx
from .functions import geometry as geo
from .functions.ids import id_key, id_key_sql
from .functions.scalar import rounded
from .operators import crossval, figures, metrics, raster, support, verify
from .operators.selection import Rules, deduplicate_sites, select_stations
from .plans import pipelines

QUALITY = Rules(min_duration_years=5.0, max_component_sigma=2.5)
FULL = Rules(exclude_ids=("S1", "S7"), require_status={"status": "BUILDING"}, min_duration_years=5.0, min_distance_from_fitting_m=500.0, max_component_sigma=2.5)
DEDUP = Rules(min_duration_years=5.0, max_component_sigma=2.5, deduplicate_within_m=100.0)
TOLERANCE, TRIALS, FRACTION, SEED = 2.0, 100, 0.2, 314159


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[rounded(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields])


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return fx.table(spark, d, name)


# --- comparisons on the derived stations and rasters

VLM_OUT = ("station_id", "pixel_row_zero_based", "pixel_column_zero_based", "pixel_center_x", "pixel_center_y", "pixel_status", "insar_vlm_mm_per_year", "gnss_up_mm_per_year", "sigma_up_mm_per_year", "residual_mm_per_year", "selection_reason", "include_in_metrics", "group_id")


def _vlm(spark: SparkSession, d: str) -> DataFrame:
    only = F.col("raster_id") == "velocity"
    return pipelines.vlm_station_values(fx.stations(spark, d), fx.cells(spark, d).where(only), fx.meta(spark, d).where(only), QUALITY, crs="epsg:4326")


def vlm_station_values(spark: SparkSession, d: str) -> DataFrame:
    """Vertical comparison, one row for each station."""
    return round_doubles(_vlm(spark, d).select(*VLM_OUT))


def vlm_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: accuracy of the vertical raster against the stations."""
    return round_doubles(pipelines.metrics_frame(_vlm(spark, d), "insar_vlm_mm_per_year", "gnss_up_mm_per_year", tolerance=TOLERANCE))


def vlm_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Stations that do not count, with every reason."""
    return round_doubles(pipelines.exclusions(_vlm(spark, d)))


LOS_OUT = ("station_id", "pixel_status", "incidence_deg", "heading_deg", "insar_los_mm_per_year", "gnss_los_mm_per_year", "sigma_los_mm_per_year", "residual_mm_per_year", "selection_reason", "include_in_metrics", "group_id")


def _los(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.los_station_values(fx.stations(spark, d), fx.cells(spark, d), fx.meta(spark, d), "velocity", "incidence", "heading", QUALITY)


def los_station_values(spark: SparkSession, d: str) -> DataFrame:
    """Line-of-sight comparison with projected rates and sigmas."""
    return round_doubles(_los(spark, d).select(*LOS_OUT))


def los_metrics(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(pipelines.metrics_frame(_los(spark, d), "insar_los_mm_per_year", "gnss_los_mm_per_year", tolerance=TOLERANCE))


# --- selection

def selection_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every rule's reason for every station."""
    return select_stations(fx.stations(spark, d), FULL).select("station_id", "selection_reason")


def site_components(spark: SparkSession, d: str) -> DataFrame:
    """Single-link site clusters and their representatives."""
    return deduplicate_sites(fx.stations(spark, d)).select("station_id", "component_id", "is_representative")


def selection_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Selection with one record for each physical site, after the other rules."""
    return select_stations(fx.stations(spark, d), DEDUP).select("station_id", "selection_reason")


def duplicate_station_ids(spark: SparkSession, d: str) -> DataFrame:
    """Station keys with several rows."""
    return _t(spark, d, "stations").select(id_key("station_id").alias("station_key")).where("station_key IS NOT NULL").groupBy("station_key").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


# --- projections

def look_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Look vector, projected rate and sigma, both signs, for every cell."""
    part = _t(spark, d, "part").select("p_partkey", F.expr("30.0D + (p_partkey % 150) / 10.0D").alias("i"), F.expr("-13.0D + (p_partkey % 7)").alias("h"), F.expr("(p_partkey % 41) / 10.0D").alias("e"), F.expr("(p_partkey % 37) / 10.0D").alias("n"), F.expr("(p_partkey % 43) / 10.0D").alias("u"))
    le, ln, lu = geo.los_unit_vector("i", "h")
    cols = {"look_east": le, "look_north": ln, "look_up": lu, "los": geo.enu_to_los("e", "n", "u", "i", "h"), "los_away": geo.enu_to_los("e", "n", "u", "i", "h", positive_direction="away_from_satellite"), "sigma_los": geo.project_diagonal_sigma("e", "n", "u", "i", "h")}
    cols["sigma_full"] = geo.project_full_sigma("e", "n", "u", F.col("e") * F.col("n") * 0.3, F.col("e") * F.col("u") * -0.2, F.col("n") * F.col("u") * 0.1, "i", "h")
    return part.select("p_partkey", *[rounded(c).alias(k) for k, c in cols.items()])


def two_look_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """East and up rates from two looks."""
    part = _t(spark, d, "part").select("p_partkey", F.expr("30.0D + (p_partkey % 150) / 10.0D").alias("i"), F.expr("(p_partkey % 41) / 10.0D").alias("a"), F.expr("(p_partkey % 37) / 10.0D").alias("b"), F.expr("(p_partkey % 5) / 10.0D").alias("n"))
    east, up = geo.decompose_two_looks("a", "b", "i", -12.0, "i", -168.0, "n")
    return part.select("p_partkey", rounded(east).alias("east"), rounded(up).alias("up"))


def pixel_basis(spark: SparkSession, d: str) -> DataFrame:
    """Normalised pixel coordinates and the quadratic terms of every cell."""
    own = fx.cells(spark, d).where("raster_id = 'velocity'").select("row_index", "column_index")
    height = fx.raster_rows(spark, d)
    x, y = geo.normalize_pixel("column_index", "row_index", fx.COLUMNS, height)
    at = own.select("row_index", "column_index", x.alias("x"), y.alias("y")).withColumn("b", geo.quadratic_basis("x", "y"))
    return at.select("row_index", "column_index", *[rounded(c).alias(c) for c in "xy"], *[rounded(F.col("b")[i]).alias(n) for i, n in ((3, "xy"), (4, "xx"), (5, "yy"))])


def station_distances(spark: SparkSession, d: str) -> DataFrame:
    """Great-circle distance of every solution from a fixed point."""
    own = _t(spark, d, "stations")
    return own.select("solution_no", F.round(geo.haversine_m("longitude_deg", "latitude_deg", 10.0, 50.0), 3).alias("distance_m"))


# --- metrics on the delivered samples

def residual_summary(spark: SparkSession, d: str) -> DataFrame:
    """Residual metrics by raster and inclusion; residuals beyond 1 m a year stem
    from stand-in numbers and count as missing."""
    own = _t(spark, d, "station_values").withColumn("r", F.when(F.abs("residual_mm_per_year") <= 1000, F.col("residual_mm_per_year")))
    return round_doubles(metrics.summarize_residuals(own, "r", ["raster_id", "include_in_metrics"], TOLERANCE))


def station_values_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy metrics of the delivered samples by raster."""
    own = _t(spark, d, "station_values").where("include_in_metrics")
    return round_doubles(metrics.accuracy_metrics(own, "insar_vlm_mm_per_year", "gnss_up_mm_per_year", ["raster_id"], TOLERANCE))


def station_values_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Constraints that the delivered samples must meet."""
    return verify.consistency(_t(spark, d, "station_values"), "vlm", ("raster_id",))


def station_samples(spark: SparkSession, d: str) -> DataFrame:
    """The delivered solutions sampled in the delivered rasters."""
    got = raster.sample(_t(spark, d, "stations").select("solution_no", "longitude_deg", "latitude_deg"), _t(spark, d, "raster_cells"), _t(spark, d, "raster_meta"))
    return round_doubles(got.select("solution_no", "raster_id", "pixel_row_zero_based", "pixel_column_zero_based", "pixel_center_x", "pixel_center_y", "cell_value", "pixel_status", "group_id"))


def sample_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Included samples whose saved value is not the raster's."""
    return round_doubles(verify.sample_mismatches(_t(spark, d, "station_values"), _t(spark, d, "raster_cells"), _t(spark, d, "raster_meta"), key="value_no"))


def rms_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of the RMS of trials, by orbit and scope."""
    part = _t(spark, d, "part").selectExpr("CASE WHEN p_partkey % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit", "p_retailprice / 100.0D AS all_rms_mm_per_year", "(p_partkey % 97) / 10.0D AS fitting_rms_mm_per_year", "(p_size * 31 % 89) / 10.0D AS holdout_rms_mm_per_year")
    return round_doubles(metrics.rms_distribution(part))


# --- rasters

def raster_summary(spark: SparkSession, d: str) -> DataFrame:
    """Header, number of cells with data and range of each raster."""
    got = raster.summary(_t(spark, d, "raster_cells"), _t(spark, d, "raster_meta"))
    return round_doubles(got.select("raster_id", "width", "height", "band_count", "dtype", "n_valid", "minimum", "maximum"))


def raster_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Preview blocks."""
    return round_doubles(raster.block_average(_t(spark, d, "raster_cells"), _t(spark, d, "raster_meta")))


def raster_crop(spark: SparkSession, d: str) -> DataFrame:
    """The cells of a region."""
    return round_doubles(raster.crop(_t(spark, d, "raster_cells"), _t(spark, d, "raster_meta"), -60.005, 60.005, -40.005, 40.005))


# --- figures

def residual_histogram(spark: SparkSession, d: str) -> DataFrame:
    own = _t(spark, d, "station_values").where("include_in_metrics")
    return round_doubles(figures.histogram(own, "residual_mm_per_year", 20.0, 0.5))


def residual_bin_width(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(figures.bin_width(_t(spark, d, "station_values").where("include_in_metrics"), "residual_mm_per_year"))


def color_limits(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(figures.robust_symmetric_limit(_t(spark, d, "station_values").where("include_in_metrics"), "residual_mm_per_year", ("raster_id",)))


def scatter_axis(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(figures.axis_range(_t(spark, d, "station_values").where("include_in_metrics"), "insar_vlm_mm_per_year", "gnss_up_mm_per_year", "sigma_up_mm_per_year"))


# --- support of a model

def nearest_fitting_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance of every solution to the nearest site in the local frame."""
    own = _t(spark, d, "stations").select("solution_no", "longitude_deg", "latitude_deg", "frame_realization")
    own = own.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("longitude_deg", "latitude_deg")})
    sites = own.where("frame_realization = 'LOCAL-7' AND abs(latitude_deg) <= 90")
    rows = own.where("abs(latitude_deg) <= 90 AND longitude_deg IS NOT NULL").drop("frame_realization")
    return support.nearest_site_distance(rows, sites).select("solution_no", F.round("nearest_fitting_distance_m", 1).alias("nearest_fitting_distance_m"))


def nearest_valid_cells(spark: SparkSession, d: str) -> DataFrame:
    """For display: the nearest cell with data around each solution."""
    got = support.nearest_valid_cell(_t(spark, d, "stations").select("solution_no", "longitude_deg", "latitude_deg"), _t(spark, d, "raster_cells"), _t(spark, d, "raster_meta"), "solution_no", 1)
    return round_doubles(got)


def inside_fitting_hull(spark: SparkSession, d: str) -> DataFrame:
    """Which derived stations lie inside the hull of those in one segment."""
    own = fx.stations(spark, d)
    hull = support.hull_of(own.where("status = 'MACHINERY'"), "longitude_deg", "latitude_deg")
    return support.inside_hull(own, hull, "longitude_deg", "latitude_deg").select("station_id", "inside_fitting_hull")


# --- cross-validation

def _cv(spark: SparkSession, d: str, name: str) -> DataFrame:
    own = crossval.gate(fx.observations(spark, d))
    return crossval.CrossValidation(own, TRIALS, FRACTION, SEED, tolerance=TOLERANCE).table(name)


def cv_folds(spark: SparkSession, d: str) -> DataFrame:
    """Groups in the order of their folds, with the rows that each fold fits and holds out."""
    own = fx.observations(spark, d)
    folds = crossval.group_list(own)
    n = own.groupBy("orbit", "group_id").agg(F.count(F.lit(1)).alias("n_heldout_observations"))
    total = own.groupBy("orbit").agg(F.count(F.lit(1)).alias("n"))
    return folds.join(n, ["orbit", "group_id"]).join(F.broadcast(total), "orbit").select("orbit", "fold", "group_id", "n_heldout_observations", (F.col("n") - F.col("n_heldout_observations")).alias("n_fitting_observations"))


def cv_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Groups held out in every trial."""
    return crossval.holdout_assignments(crossval.group_list(fx.observations(spark, d)), TRIALS, FRACTION, SEED).select("trial", "orbit", "group_id")


def full_fit_metrics(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(_cv(spark, d, "full_fit_metrics"))


def loocv_station_values(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(_cv(spark, d, "loocv_station_values"))


def loocv_metrics(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(_cv(spark, d, "loocv_metrics"))


def loocv_folds(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(_cv(spark, d, "loocv_folds"))


def cv_trials(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(_cv(spark, d, "cv_trials"))


def cv_distribution(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(_cv(spark, d, "cv_distribution"))


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    """The delivered observations with bare keys, those that can be used."""
    c = F.lower(F.trim("orbit"))
    orbit = F.when(c.startswith("a"), "ascending").when(c.startswith("d"), "descending")
    own = _t(spark, d, "observations").withColumns({"orbit": orbit, "group_id": id_key("group_id")})
    return crossval.usable(own)


def observation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Usable observations, groups and stations by orbit."""
    own = _delivered(spark, d).withColumn("station_id", id_key("station_id"))
    return own.groupBy("orbit").agg(F.count(F.lit(1)).alias("n_observations"), F.count_distinct("group_id").alias("n_groups"), F.count_distinct("station_id").alias("n_stations"))


def observation_loocv(spark: SparkSession, d: str) -> DataFrame:
    """Leave-one-group-out metrics of the delivered observations, all groups."""
    own = _delivered(spark, d)
    folds = crossval.group_list(own)
    models = crossval.fit_leave_one_out(crossval.group_factors(own), folds)
    return round_doubles(metrics.summarize_residuals(crossval.leave_one_out(own, folds, models), "residual_mm_per_year", ["orbit"], TOLERANCE))


def _delivered_cv(spark: SparkSession, d: str, name: str) -> DataFrame:
    cv = crossval.CrossValidation(_delivered(spark, d), TRIALS, FRACTION, SEED, tolerance=TOLERANCE)
    return round_doubles(getattr(cv, name)())


def observation_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Delivered groups held out in every trial."""
    return _delivered_cv(spark, d, "cv_assignments")


def observation_full_fit(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the surface fitted to all delivered observations."""
    return _delivered_cv(spark, d, "full_fit_metrics")


def observation_loocv_values(spark: SparkSession, d: str) -> DataFrame:
    """Every usable delivered observation with its leave-one-group-out residual."""
    return _delivered_cv(spark, d, "loocv_station_values")


def observation_fold_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Facts and held-out metrics of every fold of the delivered observations."""
    return _delivered_cv(spark, d, "loocv_fold_residuals")


def observation_folds(spark: SparkSession, d: str) -> DataFrame:
    """Fitting and held-out metrics of every fold: rows times folds."""
    return _delivered_cv(spark, d, "loocv_folds")


def observation_trials(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of every holdout trial of the delivered observations."""
    return _delivered_cv(spark, d, "cv_trials")


def observation_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of the RMS over the trials of the delivered observations."""
    return _delivered_cv(spark, d, "cv_distribution")


_LIST = (
    vlm_metrics, vlm_station_values, vlm_exclusions, los_station_values, los_metrics, selection_reasons, site_components, selection_dedup, duplicate_station_ids,
    look_vectors, two_look_decomposition, pixel_basis, station_distances, residual_summary, station_values_accuracy, station_values_consistency, station_samples, sample_mismatches,
    rms_distribution, raster_summary, raster_blocks, raster_crop, residual_histogram, residual_bin_width, color_limits, scatter_axis,
    nearest_fitting_distance, nearest_valid_cells, inside_fitting_hull, cv_folds, cv_assignments, full_fit_metrics, loocv_station_values, loocv_metrics, loocv_folds, cv_trials, cv_distribution,
    observation_counts, observation_loocv, observation_assignments, observation_full_fit, observation_loocv_values, observation_fold_residuals, observation_folds, observation_trials, observation_distribution,
)
QUERIES = {f.__name__: f for f in _LIST}

# --- DuckDB

R6 = "round({}, 6) + CAST(0 AS DOUBLE)"


def r6(expression: str, name: str | None = None) -> str:
    return f"{R6.format(expression)} AS {name or expression}"


_METRICS = f"""count(r) AS n, {r6('avg(r)', 'bias_mm_per_year')}, {r6('sqrt(avg(r * r))', 'rms_mm_per_year')}, {r6('stddev_pop(r)', 'centered_rms_mm_per_year')}, {r6('avg(abs(r))', 'mae_mm_per_year')},
  {r6('median(r)', 'median_residual_mm_per_year')}, {r6(f'{metrics.NMAD_SCALE} * median(abs(r - m))', 'nmad_mm_per_year')}, {r6(f'avg(CAST(abs(r) <= {TOLERANCE} AS INTEGER))', 'fraction_within_tolerance')},
  CAST({TOLERANCE} AS DOUBLE) AS tolerance_mm_per_year, {r6('min(r)', 'minimum_residual_mm_per_year')}, {r6('max(r)', 'maximum_residual_mm_per_year')}"""
_PAIRS = f"""{r6('avg(i)', 'mean_insar_mm_per_year')}, {r6('avg(g)', 'mean_gnss_mm_per_year')},
  {r6('CASE WHEN max(i) > min(i) AND max(g) > min(g) THEN covar_pop(i, g) / (stddev_pop(i) * stddev_pop(g)) END', 'correlation')}"""

_META = f"SELECT n // {fx.COLUMNS} AS height, CAST(-4.0 AS DOUBLE) / (n // {fx.COLUMNS}) AS e FROM (SELECT count(*) AS n FROM part)"
_RULES_QUALITY = """
    CASE WHEN NOT (isfinite(longitude_deg) AND isfinite(latitude_deg)) THEN 'nonfinite_coordinate' END,
    CASE WHEN east_mm_per_year IS NULL OR north_mm_per_year IS NULL OR up_mm_per_year IS NULL THEN 'nonfinite_enu_rate' END, {more}
    CASE WHEN duration_years IS NULL OR duration_years < 5 THEN 'record_too_short' END, {distance}
    CASE WHEN sigma_east_mm_per_year < 0 OR sigma_north_mm_per_year < 0 OR sigma_up_mm_per_year < 0 THEN 'invalid_rate_uncertainty' END,
    CASE WHEN greatest(sigma_east_mm_per_year, sigma_north_mm_per_year, sigma_up_mm_per_year) > 2.5 THEN 'component_rate_uncertainty_above_threshold' END"""
_QUALITY_SQL = _RULES_QUALITY.format(more="", distance="")
_FULL_SQL = _RULES_QUALITY.format(
    more="CASE WHEN station_id IN ('S1', 'S7') THEN 'explicit_station_exclusion' END, CASE WHEN status IS DISTINCT FROM 'BUILDING' THEN 'status_status_not_BUILDING' END,",
    distance="CASE WHEN nearest_fitting_distance_m IS NULL OR nearest_fitting_distance_m <= 500 THEN 'too_close_to_fitting_site' END,",
)


def _reasons(rules: str) -> str:
    return f"list_filter([{rules}], lambda x: x IS NOT NULL)"


_SAMPLED = f"""
s AS ({fx.STATIONS_SQL}), m AS ({_META}),
placed AS (SELECT s.*, {_reasons(_QUALITY_SQL)} AS why, height, e, floor((longitude_deg - CAST(-124 AS DOUBLE)) / CAST(0.1 AS DOUBLE)) AS pc, floor((latitude_deg - CAST(48 AS DOUBLE)) / e) AS pr FROM s, m),
inside AS (SELECT *, pc BETWEEN 0 AND 39 AND pr BETWEEN 0 AND height - 1 AS ins FROM placed),
cells AS ({fx.CELLS_SQL}),
v AS (SELECT row_index, column_index, max(cell_value) FILTER (raster_id = 'velocity') AS vel, max(cell_value) FILTER (raster_id = 'incidence') AS inc, max(cell_value) FILTER (raster_id = 'heading') AS head FROM cells GROUP BY ALL)"""
_VLM = f"""
WITH {_SAMPLED},
got AS (SELECT i.*, v.vel AS i_value, CASE WHEN NOT ins THEN 'out_of_bounds' WHEN vel IS NULL THEN 'no_data' ELSE 'finite' END AS pixel_status
  FROM inside i LEFT JOIN v ON ins AND row_index = pr AND column_index = pc),
vlm AS (SELECT *, i_value - up_mm_per_year AS res, CASE WHEN pixel_status <> 'finite' THEN list_append(why, 'raster_' || pixel_status) ELSE why END AS reasons FROM got),
done AS (SELECT *, coalesce(nullif(array_to_string(reasons, ';'), ''), 'included') AS selection_reason, len(reasons) = 0 AND res IS NOT NULL AS inc FROM vlm)
"""
_GROUP = "CASE WHEN ins THEN 'r' || CAST(pr AS INTEGER) || '_c' || CAST(pc AS INTEGER) ELSE '' END AS group_id"
VLM_VALUES = f"""{_VLM}
SELECT station_id, CAST(CASE WHEN ins THEN pr ELSE -1 END AS INTEGER) AS pixel_row_zero_based, CAST(CASE WHEN ins THEN pc ELSE -1 END AS INTEGER) AS pixel_column_zero_based,
  {r6('CASE WHEN ins THEN CAST(0.1 AS DOUBLE) * (pc + 0.5) - 124 END', 'pixel_center_x')}, {r6('CASE WHEN ins THEN e * (pr + 0.5) + 48 END', 'pixel_center_y')}, pixel_status,
  {r6('i_value', 'insar_vlm_mm_per_year')}, {r6('up_mm_per_year', 'gnss_up_mm_per_year')}, {r6('sigma_up_mm_per_year')}, {r6('res', 'residual_mm_per_year')}, selection_reason, inc AS include_in_metrics, {_GROUP} FROM done"""
VLM_METRICS = f"""{_VLM}, x AS (SELECT res AS r, i_value AS i, up_mm_per_year AS g, median(res) OVER () AS m FROM done WHERE inc)
SELECT 'formal' AS selection, 'independent' AS comparison_role, {_METRICS}, {_PAIRS} FROM x"""
VLM_EXCLUSIONS = f"{_VLM} SELECT station_id, {r6('longitude_deg')}, {r6('latitude_deg')}, selection_reason, pixel_status FROM done WHERE NOT inc"

_LE, _LN, _LU = "(-cos(radians(head)) * sin(radians(inc)))", "(sin(radians(head)) * sin(radians(inc)))", "cos(radians(inc))"
_LOS = f"""
WITH {_SAMPLED},
got AS (SELECT i.*, vel, inc, head, CASE WHEN NOT ins THEN 'out_of_bounds' WHEN vel IS NULL THEN 'no_data' WHEN inc IS NULL OR head IS NULL THEN 'geometry_no_data' ELSE 'finite' END AS pixel_status
  FROM inside i LEFT JOIN v ON ins AND row_index = pr AND column_index = pc),
look AS (SELECT *, CASE WHEN pixel_status = 'finite' THEN {_LE} * east_mm_per_year + {_LN} * north_mm_per_year + {_LU} * up_mm_per_year END AS g,
  CASE WHEN pixel_status = 'finite' THEN sqrt(({_LE} * sigma_east_mm_per_year) ^ 2 + ({_LN} * sigma_north_mm_per_year) ^ 2 + ({_LU} * sigma_up_mm_per_year) ^ 2) END AS sl FROM got),
done AS (SELECT *, vel - g AS res, CASE WHEN pixel_status <> 'finite' THEN list_append(why, 'raster_' || pixel_status) ELSE why END AS reasons FROM look),
fin AS (SELECT *, coalesce(nullif(array_to_string(reasons, ';'), ''), 'included') AS selection_reason, len(reasons) = 0 AND res IS NOT NULL AS ok FROM done)
"""
LOS_VALUES = f"""{_LOS}
SELECT station_id, pixel_status, {r6('inc', 'incidence_deg')}, {r6('head', 'heading_deg')}, {r6('vel', 'insar_los_mm_per_year')}, {r6('g', 'gnss_los_mm_per_year')}, {r6('sl', 'sigma_los_mm_per_year')}, {r6('res', 'residual_mm_per_year')},
  selection_reason, ok AS include_in_metrics, {_GROUP} FROM fin"""
LOS_METRICS = f"""{_LOS}, x AS (SELECT res AS r, vel AS i, g, median(res) OVER () AS m FROM fin WHERE ok)
SELECT 'formal' AS selection, 'independent' AS comparison_role, {_METRICS}, {_PAIRS} FROM x"""

SELECTION = f"WITH s AS ({fx.STATIONS_SQL}) SELECT station_id, coalesce(nullif(array_to_string({_reasons(_FULL_SQL)}, ';'), ''), 'eligible') AS selection_reason FROM s"
_HAVERSINE = f"2 * {geo.EARTH_RADIUS_M} * asin(sqrt(least(1, sin(radians(b.latitude_deg - a.latitude_deg) / 2) ^ 2 + cos(radians(a.latitude_deg)) * cos(radians(b.latitude_deg)) * sin(radians(b.longitude_deg - a.longitude_deg) / 2) ^ 2)))"


def _components(source: str) -> str:
    return f"""link AS (SELECT a.station_id AS a, b.station_id AS b FROM {source} a JOIN {source} b ON a.station_id <> b.station_id AND abs(a.latitude_deg - b.latitude_deg) < 0.001 WHERE {_HAVERSINE} < 100),
    reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
    least AS (SELECT station_id, least(station_id, coalesce(min(b), station_id)) AS c FROM {source} LEFT JOIN reach ON a = station_id GROUP BY station_id),
    sites AS (SELECT s.*, c, row_number() OVER (PARTITION BY c ORDER BY duration_years DESC, greatest(sigma_east_mm_per_year, sigma_north_mm_per_year, sigma_up_mm_per_year), station_id) AS k FROM {source} s JOIN least USING (station_id))"""


COMPONENTS = f"WITH RECURSIVE s AS ({fx.STATIONS_SQL}), {_components('s')} SELECT station_id, CAST(dense_rank() OVER (ORDER BY c) - 1 AS BIGINT) AS component_id, k = 1 AS is_representative FROM sites"
DEDUPED = f"""WITH RECURSIVE s AS ({fx.STATIONS_SQL}), ruled AS (SELECT *, array_to_string({_reasons(_QUALITY_SQL)}, ';') AS why FROM s), good AS (SELECT * FROM ruled WHERE why = ''), {_components('good')}
SELECT r.station_id, CASE WHEN r.why <> '' THEN r.why WHEN k = 1 THEN 'eligible' ELSE 'nonrepresentative_physical_site_record' END AS selection_reason FROM ruled r LEFT JOIN sites USING (station_id)"""

_PARTS = "CAST(30 AS DOUBLE) + (p_partkey % 150) / CAST(10 AS DOUBLE)"
LOOKS = f"""WITH p AS (SELECT p_partkey, {_PARTS} AS inc, CAST(-13 AS DOUBLE) + p_partkey % 7 AS head, (p_partkey % 41) / CAST(10 AS DOUBLE) AS e, (p_partkey % 37) / CAST(10 AS DOUBLE) AS n, (p_partkey % 43) / CAST(10 AS DOUBLE) AS u FROM part),
l AS (SELECT *, {_LE} AS le, {_LN} AS ln, {_LU} AS lu FROM p)
SELECT p_partkey, {r6('le', 'look_east')}, {r6('ln', 'look_north')}, {r6('lu', 'look_up')}, {r6('le * e + ln * n + lu * u', 'los')}, {r6('-(le * e + ln * n + lu * u)', 'los_away')},
  {r6('sqrt((le * e) ^ 2 + (ln * n) ^ 2 + (lu * u) ^ 2)', 'sigma_los')},
  {r6('sqrt(le * le * e * e + ln * ln * n * n + lu * lu * u * u + 2 * (le * ln * e * n * 0.3 - le * lu * e * u * 0.2 + ln * lu * n * u * 0.1))', 'sigma_full')} FROM l"""
TWO_LOOKS = f"""WITH p AS (SELECT p_partkey, radians({_PARTS}) AS i, (p_partkey % 41) / CAST(10 AS DOUBLE) AS a, (p_partkey % 37) / CAST(10 AS DOUBLE) AS b, (p_partkey % 5) / CAST(10 AS DOUBLE) AS n FROM part),
l AS (SELECT *, -cos(radians(-12)) * sin(i) AS ae, sin(radians(-12)) * sin(i) AS an, cos(i) AS au, -cos(radians(-168)) * sin(i) AS de, sin(radians(-168)) * sin(i) AS dn, cos(i) AS du FROM p),
q AS (SELECT *, a - an * n AS x, b - dn * n AS y, ae * du - au * de AS det FROM l)
SELECT p_partkey, {r6('CASE WHEN abs(det) >= 0.05 THEN (x * du - au * y) / det END', 'east')}, {r6('CASE WHEN abs(det) >= 0.05 THEN (ae * y - de * x) / det END', 'up')} FROM q"""
PIXELS = f"""WITH m AS ({_META}), c AS (SELECT CAST(p_partkey // 40 AS INTEGER) AS row_index, CAST(p_partkey % 40 AS INTEGER) AS column_index FROM part),
n AS (SELECT row_index, column_index, CASE WHEN column_index < 40 THEN ((column_index + 1.0) - 41 / 2.0) / 20.0 END AS x, CASE WHEN row_index < height THEN ((row_index + CAST(1 AS DOUBLE)) - (height + 1) / 2.0) / (height / 2.0) END AS y FROM c, m)
SELECT row_index, column_index, {r6('CAST(x AS DOUBLE)', 'x')}, {r6('CAST(y AS DOUBLE)', 'y')}, {r6('x * y', 'xy')}, {r6('x * x', 'xx')}, {r6('y * y', 'yy')} FROM n"""
DISTANCES = f"""SELECT a.solution_no, round(CASE WHEN isfinite(a.longitude_deg) AND abs(a.latitude_deg) <= 90 THEN {_HAVERSINE} END, 3) AS distance_m
FROM stations a, (SELECT CAST(10 AS DOUBLE) AS longitude_deg, CAST(50 AS DOUBLE) AS latitude_deg) b"""
DUPLICATES = f"SELECT * FROM (SELECT {id_key_sql('station_id')} AS station_key, count(*) AS n_rows FROM stations GROUP BY 1) WHERE station_key IS NOT NULL AND n_rows > 1"

SUMMARY = f"""WITH x AS (SELECT raster_id, include_in_metrics, CASE WHEN isfinite(residual_mm_per_year) AND abs(residual_mm_per_year) <= 1000 THEN residual_mm_per_year END AS r FROM station_values),
y AS (SELECT *, median(r) OVER (PARTITION BY raster_id, include_in_metrics) AS m FROM x)
SELECT raster_id, include_in_metrics, {_METRICS} FROM y GROUP BY raster_id, include_in_metrics"""
ACCURACY = f"""WITH x AS (SELECT raster_id, insar_vlm_mm_per_year AS i, gnss_up_mm_per_year AS g, i - g AS r FROM station_values WHERE include_in_metrics AND isfinite(insar_vlm_mm_per_year) AND isfinite(gnss_up_mm_per_year)),
y AS (SELECT *, median(r) OVER (PARTITION BY raster_id) AS m FROM x)
SELECT raster_id, {_METRICS}, {_PAIRS} FROM y GROUP BY raster_id"""
_WHOLE = "coalesce(isfinite(insar_vlm_mm_per_year) AND isfinite(gnss_up_mm_per_year) AND isfinite(residual_mm_per_year), false)"
_GAP = "insar_vlm_mm_per_year - gnss_up_mm_per_year"
CONSISTENCY = f"""SELECT raster_id, count(*) AS n_rows, count(*) FILTER (include_in_metrics) AS n_included, count(*) FILTER (include_in_metrics AND NOT {_WHOLE}) AS n_incomplete,
  count(*) FILTER (include_in_metrics AND sigma_up_mm_per_year < 0) AS n_negative_sigma, count(*) FILTER ({_WHOLE} AND abs(residual_mm_per_year - ({_GAP})) > 1e-7 + 1e-7 * abs({_GAP})) AS n_residual_mismatch FROM station_values GROUP BY raster_id"""
_CLEAN = "clean AS (SELECT c.* FROM raster_cells c JOIN raster_meta m USING (raster_id) WHERE isfinite(cell_value) AND cell_value IS DISTINCT FROM nodata)"


def _placed(source: str, columns: str) -> str:
    return f"""placed AS (SELECT {columns}, m.raster_id AS rid, a, e, c, f, isfinite(longitude_deg) AND isfinite(latitude_deg) AS known, floor((longitude_deg - c) / a) AS pc, floor((latitude_deg - f) / e) AS pr,
  coalesce(isfinite(longitude_deg) AND isfinite(latitude_deg) AND floor((longitude_deg - c) / a) BETWEEN 0 AND width - 1 AND floor((latitude_deg - f) / e) BETWEEN 0 AND height - 1, false) AS ins FROM {source}, raster_meta m)"""


SAMPLES = f"""WITH {_CLEAN}, {_placed('stations', 'solution_no')}
SELECT solution_no, rid AS raster_id, CAST(CASE WHEN ins THEN pr ELSE -1 END AS INTEGER) AS pixel_row_zero_based, CAST(CASE WHEN ins THEN pc ELSE -1 END AS INTEGER) AS pixel_column_zero_based,
  {r6('CASE WHEN ins THEN a * (pc + 0.5) + c END', 'pixel_center_x')}, {r6('CASE WHEN ins THEN e * (pr + 0.5) + f END', 'pixel_center_y')}, {r6('cell_value')},
  CASE WHEN NOT coalesce(known, false) THEN 'invalid_coordinate' WHEN NOT ins THEN 'out_of_bounds' WHEN cell_value IS NULL THEN 'no_data' ELSE 'finite' END AS pixel_status, {_GROUP}
FROM placed LEFT JOIN clean ON ins AND raster_id = rid AND row_index = pr AND column_index = pc"""
MISMATCHES = f"""WITH {_CLEAN}, {_placed('station_values', 'value_no, station_values.raster_id AS own, insar_vlm_mm_per_year AS saved, include_in_metrics')}
SELECT rid AS raster_id, value_no, {r6('saved', 'saved_value')}, {r6('cell_value', 'raster_value')} FROM placed LEFT JOIN clean ON ins AND clean.raster_id = rid AND row_index = pr AND column_index = pc
WHERE include_in_metrics AND own = rid AND NOT coalesce(abs(cell_value - saved) <= 1e-4, false)"""
_TRIALS = "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit, p_retailprice / 100.0 AS \"all\", (p_partkey % 97) / 10.0 AS fitting, (p_size * 31 % 89) / 10.0 AS holdout FROM part"
DISTRIBUTION = f"""WITH t AS ({_TRIALS}), u AS (UNPIVOT t ON "all", fitting, holdout INTO NAME scope VALUE rms)
SELECT orbit, scope, count(rms) AS trials, {r6('avg(rms)', 'mean_rms')}, {r6('stddev_samp(rms)', 'standard_deviation_of_rms')}, {r6('quantile_cont(rms, 0.025)', 'p2_5_rms')}, {r6('median(rms)', 'median_rms')}, {r6('quantile_cont(rms, 0.975)', 'p97_5_rms')} FROM u GROUP BY orbit, scope"""
RASTERS = f"""WITH {_CLEAN}, s AS (SELECT raster_id, count(*) AS n, min(cell_value) AS lo, max(cell_value) AS hi FROM clean GROUP BY 1)
SELECT m.raster_id, width, height, band_count, dtype, coalesce(n, 0) AS n_valid, {r6('lo', 'minimum')}, {r6('hi', 'maximum')} FROM raster_meta m LEFT JOIN s USING (raster_id)"""
BLOCKS = f"""WITH {_CLEAN}, k AS (SELECT raster_id, CAST(greatest(1, ceil(greatest(width, height) / 1024.0)) AS INTEGER) AS k FROM raster_meta)
SELECT raster_id, CAST(row_index // k AS INTEGER) AS block_row, CAST(column_index // k AS INTEGER) AS block_column, {r6('avg(cell_value)', 'mean_value')}, count(*) AS n_cells FROM clean JOIN k USING (raster_id) GROUP BY ALL"""
CROP = f"""WITH {_CLEAN}, p AS (SELECT c.*, a * (column_index + 0.5) + c AS x, e * (row_index + 0.5) + f AS y FROM clean c JOIN raster_meta m USING (raster_id))
SELECT raster_id, row_index, column_index, {r6('x')}, {r6('y')}, {r6('cell_value')} FROM p WHERE x BETWEEN -60.005001 AND 60.005001 AND y BETWEEN -40.005001 AND 40.005001"""
_INC = "SELECT residual_mm_per_year AS r, * FROM station_values WHERE include_in_metrics"
HISTOGRAM = f"""WITH v AS ({_INC}), b AS (SELECT CAST(range AS INTEGER) AS bin FROM range(81)), c AS (SELECT CAST(CASE WHEN r = 20.5 THEN 80 ELSE floor((r + 20) / 0.5) END AS INTEGER) AS bin, count(*) AS n FROM v WHERE isfinite(r) AND r BETWEEN -20 AND 20.5 GROUP BY 1)
SELECT bin, {r6('CAST(-20 + bin * 0.5 AS DOUBLE)', 'lower_edge')}, {r6('CAST(-20 + (bin + 1) * 0.5 AS DOUBLE)', 'upper_edge')}, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin)"""
BIN_WIDTH = f"WITH v AS ({_INC}), q AS (SELECT count(r) AS n, quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS iqr FROM v WHERE isfinite(r)) SELECT {r6('2 * iqr / pow(n, 1.0 / 3.0)', 'bin_width_mm_per_year')} FROM q"
LIMITS = f"WITH v AS ({_INC}), q AS (SELECT raster_id, quantile_cont(abs(r), 0.98) AS q FROM v WHERE isfinite(r) GROUP BY 1), s AS (SELECT *, pow(10, floor(log10(q))) AS s FROM q) SELECT raster_id, {r6('ceil(q / s * 5) / 5 * s', 'color_limit')} FROM s"
AXIS = f"""WITH v AS ({_INC}), e AS (SELECT min(least(insar_vlm_mm_per_year, gnss_up_mm_per_year - b)) AS lo, max(greatest(insar_vlm_mm_per_year, gnss_up_mm_per_year + b)) AS hi
FROM (SELECT *, CASE WHEN isfinite(sigma_up_mm_per_year) THEN sigma_up_mm_per_year ELSE 0 END AS b FROM v) WHERE isfinite(insar_vlm_mm_per_year) AND isfinite(gnss_up_mm_per_year))
SELECT {r6('lo - 0.08 * (hi - lo)', 'axis_minimum')}, {r6('hi + 0.08 * (hi - lo)', 'axis_maximum')} FROM e"""
NEAREST = f"""WITH p AS (SELECT * FROM stations WHERE isfinite(longitude_deg) AND abs(latitude_deg) <= 90), t AS (SELECT DISTINCT longitude_deg, latitude_deg FROM p WHERE frame_realization = 'LOCAL-7')
SELECT solution_no, round(min({_HAVERSINE}), 1) AS nearest_fitting_distance_m FROM p a, t b GROUP BY solution_no"""
NEAREST_CELLS = f"""WITH {_CLEAN}, {_placed('stations', 'solution_no')},
h AS (SELECT solution_no, rid, row_index, column_index, cell_value, (row_index - pr) ^ 2 + (column_index - pc) ^ 2 AS d FROM (SELECT * FROM placed WHERE ins) LEFT JOIN clean ON raster_id = rid AND row_index BETWEEN pr - 1 AND pr + 1 AND column_index BETWEEN pc - 1 AND pc + 1)
SELECT solution_no, rid AS raster_id, {r6('sqrt(d)', 'distance_cells')}, row_index, column_index, {r6('cell_value')}, false AS include_in_metrics FROM h
QUALIFY row_number() OVER (PARTITION BY solution_no, rid ORDER BY d, row_index, column_index) = 1"""
HULL = f"""WITH s AS ({fx.STATIONS_SQL}), t AS (SELECT DISTINCT longitude_deg AS x, latitude_deg AS y FROM s WHERE status = 'MACHINERY'),
sides AS (SELECT a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM t a JOIN t b ON a.x <> b.x OR a.y <> b.y
  WHERE NOT EXISTS (SELECT 1 FROM t c WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < -1e-12))
SELECT station_id, NOT EXISTS (SELECT 1 FROM sides WHERE (x1 - x0) * (latitude_deg - y0) - (y1 - y0) * (longitude_deg - x0) < -1e-12) AS inside_fitting_hull FROM s"""
FOLDS = f"""WITH o AS ({fx.OBSERVATIONS_SQL}), g AS (SELECT orbit, group_id, count(*) AS k FROM o GROUP BY ALL)
SELECT orbit, CAST(row_number() OVER (PARTITION BY orbit ORDER BY group_id) AS INTEGER) AS fold, group_id, k AS n_heldout_observations, CAST(sum(k) OVER (PARTITION BY orbit) - k AS BIGINT) AS n_fitting_observations FROM g"""
ASSIGNMENTS = f"""WITH o AS ({fx.OBSERVATIONS_SQL}), g AS (SELECT DISTINCT orbit, group_id FROM o), n AS (SELECT orbit, greatest(1, CAST(round_even({FRACTION} * count(*), 0) AS INTEGER)) AS k FROM g GROUP BY 1),
r AS (SELECT CAST(t.range AS INTEGER) AS trial, orbit, group_id, row_number() OVER (PARTITION BY orbit, t.range ORDER BY md5('{SEED}|' || orbit || '|' || t.range || '|' || group_id), group_id) AS r FROM g, range(1, {TRIALS + 1}) t)
SELECT trial, orbit, group_id FROM r JOIN n USING (orbit) WHERE r <= k"""
COUNTS = f"""WITH o AS (SELECT CASE WHEN lower(trim(orbit)) LIKE 'a%' THEN 'ascending' WHEN lower(trim(orbit)) LIKE 'd%' THEN 'descending' END AS orb, {id_key_sql('group_id')} AS g, {id_key_sql('station_id')} AS s FROM observations
  WHERE isfinite(normalized_pixel_x) AND isfinite(normalized_pixel_y) AND isfinite(residual_before_fit_mm_per_year))
SELECT orb AS orbit, count(*) AS n_observations, count(DISTINCT g) AS n_groups, count(DISTINCT s) AS n_stations FROM o WHERE orb IS NOT NULL AND g IS NOT NULL GROUP BY 1"""

_DERIVED = f"SELECT *, normalized_pixel_x AS x, normalized_pixel_y AS y, residual_before_fit_mm_per_year AS z FROM ({fx.OBSERVATIONS_SQL})"
_ROUNDED = ", ".join(r6(c) for c in (crossval.X, crossval.Y, crossval.Z))
_HELD = f"""SELECT r.orbit, trial, group_id FROM (SELECT CAST(t.range AS INTEGER) AS trial, orbit, group_id, row_number() OVER (PARTITION BY orbit, t.range ORDER BY md5('{SEED}|' || orbit || '|' || t.range || '|' || group_id), group_id) AS r FROM g, range(1, {TRIALS + 1}) t) r
  JOIN (SELECT orbit, greatest(1, CAST(round_even({FRACTION} * count(*), 0) AS INTEGER)) AS k FROM g GROUP BY 1) USING (orbit) WHERE r <= k"""
_USABLE = f"""SELECT * FROM (SELECT * REPLACE (CASE WHEN lower(trim(orbit)) LIKE 'a%' THEN 'ascending' WHEN lower(trim(orbit)) LIKE 'd%' THEN 'descending' END AS orbit, {id_key_sql('group_id')} AS group_id), normalized_pixel_x AS x, normalized_pixel_y AS y, residual_before_fit_mm_per_year AS z FROM observations)
  WHERE orbit IS NOT NULL AND group_id IS NOT NULL AND isfinite(x) AND isfinite(y) AND isfinite(z)"""
_DELIVERED_COLUMNS = f"obs_no, orbit, station_id, group_id, {_ROUNDED}, observed_at, received_at"

ORACLE = {
    "full_fit_metrics": cv_sql.full_fit(_DERIVED, TOLERANCE), "loocv_station_values": cv_sql.loo_values(_DERIVED, f"orbit, station_id, group_id, {_ROUNDED}"), "loocv_metrics": cv_sql.loo_metrics(_DERIVED, TOLERANCE),
    "loocv_folds": cv_sql.loo_folds(_DERIVED, TOLERANCE), "cv_trials": cv_sql.trials(_DERIVED, _HELD, TOLERANCE), "cv_distribution": cv_sql.distribution(_DERIVED, _HELD, TOLERANCE),
    "observation_loocv": cv_sql.loo_metrics(_USABLE, TOLERANCE, groups=False), "observation_full_fit": cv_sql.full_fit(_USABLE, TOLERANCE), "observation_loocv_values": cv_sql.loo_values(_USABLE, _DELIVERED_COLUMNS),
    "observation_fold_residuals": cv_sql.loo_held(_USABLE, TOLERANCE), "observation_trials": cv_sql.trials(_USABLE, _HELD, TOLERANCE), "observation_distribution": cv_sql.distribution(_USABLE, _HELD, TOLERANCE),
    "observation_folds": cv_sql.loo_folds(_USABLE, TOLERANCE), "observation_assignments": f"WITH {cv_sql.moments(_USABLE)} {_HELD}",
    "vlm_metrics": VLM_METRICS, "vlm_station_values": VLM_VALUES, "vlm_exclusions": VLM_EXCLUSIONS, "los_station_values": LOS_VALUES, "los_metrics": LOS_METRICS, "selection_reasons": SELECTION,
    "site_components": COMPONENTS, "selection_dedup": DEDUPED, "duplicate_station_ids": DUPLICATES, "look_vectors": LOOKS, "two_look_decomposition": TWO_LOOKS, "pixel_basis": PIXELS, "station_distances": DISTANCES,
    "residual_summary": SUMMARY, "station_values_accuracy": ACCURACY, "station_values_consistency": CONSISTENCY, "station_samples": SAMPLES, "sample_mismatches": MISMATCHES, "rms_distribution": DISTRIBUTION,
    "raster_summary": RASTERS, "raster_blocks": BLOCKS, "raster_crop": CROP, "residual_histogram": HISTOGRAM, "residual_bin_width": BIN_WIDTH, "color_limits": LIMITS, "scatter_axis": AXIS,
    "nearest_fitting_distance": NEAREST, "nearest_valid_cells": NEAREST_CELLS, "inside_fitting_hull": HULL, "cv_folds": FOLDS, "cv_assignments": ASSIGNMENTS, "observation_counts": COUNTS,
}
