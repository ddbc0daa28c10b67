"""Queries of readers, sinks, checks, archival tables and further cases of the
rules, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import geometry as geo
from .functions.scalar import rounded
from .operators import crossval, figures, metrics, raster, support, verify
from .operators.selection import Rules, has_sigmas, select_stations
from .plans.lineage import Scratch, cut
from .plans.pipelines import exclusions, metrics_frame
from .queries_core import _METRICS, _PAIRS, _RULES_QUALITY, _VLM, CONSISTENCY, DEDUP, DEDUPED, MISMATCHES, FRACTION, SEED, TOLERANCE, TRIALS, _reasons, _t, _vlm, r6, round_doubles
from .sources import archive, tables
from .sources.sinks import presentable

# --- readers and sinks


def _through_csv(spark: SparkSession, df: DataFrame, read) -> DataFrame:
    """A table written as CSV by the executors and read again."""
    folder = Scratch(spark).folder + ".csv"
    presentable(df).write.csv(folder, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    return cut(read(spark, folder))


STATION_FIELDS = ("station_id", *tables.STATION_NUMBERS, "quality")


def csv_stations(spark: SparkSession, d: str) -> DataFrame:
    """The delivered stations through a CSV file: ids verbatim, numbers to the last digit."""
    got = _through_csv(spark, _t(spark, d, "stations").select("solution_no", *STATION_FIELDS), tables.read_stations)
    return got.select(F.col("solution_no").cast("long").alias("solution_no"), *[F.nullif(F.col(c), F.lit("")).alias(c) if c in ("station_id", "quality") else c for c in STATION_FIELDS])


def csv_observations(spark: SparkSession, d: str) -> DataFrame:
    """The delivered observations through a CSV file."""
    keys = ("obs_no", "orbit", "station_id", "group_id")
    got = _through_csv(spark, _t(spark, d, "observations").select(*keys, *tables.OBSERVATION_NUMBERS), tables.read_observations)
    return got.select(F.col("obs_no").cast("long").alias("obs_no"), *[F.nullif(F.col(c), F.lit("")).alias(c) for c in keys[1:]], *tables.OBSERVATION_NUMBERS)


def _raw_fields(spark: SparkSession, d: str) -> DataFrame:
    """Lines without quotes and with twelve fields, split."""
    own = _t(spark, d, "raw_station_lines").where("raw_text NOT LIKE '%\"%'").withColumn("v", F.split(F.regexp_replace("raw_text", "\r$", ""), ","))
    names = ("longitude_deg", "latitude_deg", "east_mm_per_year", "north_mm_per_year", "up_mm_per_year")
    return own.where(F.size("v") == 12).select("line_id", *[F.col("v")[i + 1].alias(n) for i, n in enumerate(names)])


def number_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every field of the plain raw lines that is not the number or gap it should be."""
    got = tables.faults(_raw_fields(spark, d), numbers=("longitude_deg", "latitude_deg"), gaps=("east_mm_per_year", "north_mm_per_year", "up_mm_per_year"), key="line_id")
    return got


def flag_words(spark: SparkSession, d: str) -> DataFrame:
    """The flags that written words stand for."""
    words = "CASE p_partkey % 9 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'false ' WHEN 4 THEN '1' WHEN 5 THEN '0' WHEN 6 THEN 'Included' WHEN 7 THEN 'exclude' ELSE 'perhaps' END"
    return _t(spark, d, "part").selectExpr("p_partkey", f"{words} AS word").select("p_partkey", tables.parse_flag("word").alias("flag"))


def missing_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the contracts that the delivered tables lack."""
    wanted = {"stations": (*STATION_FIELDS, "status"), "observations": crossval.COLUMNS, "station_values": ("station_id", *verify.VALUE["vlm"], *verify.VALUE["los"], "include_in_metrics")}
    rows = [(t, c) for t, names in wanted.items() for c in sorted(set(names) - set(_t(spark, d, t).columns))]
    has_sigmas(_t(spark, d, "stations"))
    return spark.createDataFrame(rows, "table_name string, column_name string")


def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """Results put back into the order of the input: each row's place survives a shuffle."""
    own = tables.with_source_row(_t(spark, d, "stations").coalesce(1).select("solution_no"))
    ranked = own.repartition(7).orderBy("source_row").select("solution_no", "source_row")
    return ranked.select("solution_no", F.col("source_row").cast("long").alias("place"))


# --- rules and saved values


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    """Derived stations some of which lack coordinates or have impossible sigmas."""
    key = F.substring("station_id", 2, 12).cast("long")
    return fx.stations(spark, d).withColumns({
        "longitude_deg": F.when(key % 101 != 0, F.when(key % 211 == 0, F.lit(float("nan"))).otherwise(F.col("longitude_deg"))),
        "sigma_north_mm_per_year": F.when(key % 103 == 0, F.lit(-1.0)).otherwise(F.col("sigma_north_mm_per_year")),
        "sigma_up_mm_per_year": F.when(key % 107 == 0, F.lit(float("nan"))).otherwise(F.col("sigma_up_mm_per_year")),
    })


def selection_reasons_dirty(spark: SparkSession, d: str) -> DataFrame:
    """The rules about coordinates and sigmas, which clean stations never break."""
    return select_stations(_dirty(spark, d), Rules(min_duration_years=5.0, max_component_sigma=2.5)).select("station_id", "selection_reason")


def _spoiled(spark: SparkSession, d: str) -> DataFrame:
    """Delivered samples, every fiftieth with a wrong value, every seventieth with none."""
    wrong = F.when(F.col("value_no") % 50 == 0, F.col("insar_vlm_mm_per_year") + 1.0).when(F.col("value_no") % 70 != 0, F.col("insar_vlm_mm_per_year"))
    return _t(spark, d, "station_values").withColumn("insar_vlm_mm_per_year", wrong)


def sample_mismatches_spoiled(spark: SparkSession, d: str) -> DataFrame:
    """Included samples whose saved value is not the raster's, of which there are some."""
    return round_doubles(verify.sample_mismatches(_spoiled(spark, d), _t(spark, d, "raster_cells"), _t(spark, d, "raster_meta"), key="value_no"))


def consistency_spoiled(spark: SparkSession, d: str) -> DataFrame:
    """Constraints that spoiled samples break."""
    return verify.consistency(_spoiled(spark, d), "vlm", ("raster_id",))


def worst_residuals(spark: SparkSession, d: str) -> DataFrame:
    """The spoiled sample of each raster whose residual is farthest from its rates."""
    return round_doubles(verify.worst_residual(_spoiled(spark, d), "vlm", "value_no", ("raster_id",)))


def saved_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the vertical comparison made anew from its saved values, after
    the check against those saved with them."""
    values = cut(_vlm(spark, d).drop("raster_id"))
    saved = metrics_frame(values, "insar_vlm_mm_per_year", "gnss_up_mm_per_year", tolerance=TOLERANCE).first().asDict()
    own = verify.verify_metrics(values, saved)
    return spark.createDataFrame([(own["n"], *[float(own[c]) for c in verify.COMPARED])], f"n long, {', '.join(f'{c} double' for c in verify.COMPARED)}").select("n", *[rounded(c).alias(c) for c in verify.COMPARED])


def coregistration(spark: SparkSession, d: str) -> DataFrame:
    """The grids of the derived rasters, after the check that they are one."""
    meta = fx.meta(spark, d)
    raster.audit_coregistration(meta, list(fx.CELL_VALUES))
    return meta.select("raster_id", "width", "height", F.lit(raster.normalized_crs("epsg:4326")).alias("crs"), "band_count")


def evidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by raster as internal and as independent evidence, never merged."""
    own = _t(spark, d, "station_values")
    each = metrics.accuracy_metrics(own.where("include_in_metrics"), "insar_vlm_mm_per_year", "gnss_up_mm_per_year", ["raster_id"], TOLERANCE)
    role = F.explode(F.array(F.lit("internal"), F.lit("independent"))).alias("comparison_role")
    got = support.evidence_tiers(each.select(F.col("raster_id").alias("selection"), "n", role))
    return got.select("selection", "comparison_role", "n", "evidence_tier", "tier_rank")


def group_cover(spark: SparkSession, d: str) -> DataFrame:
    """Groups without trials: those of every third derived observation against the fifths."""
    own = fx.observations(spark, d).withColumn("k", F.substring("station_id", 2, 12).cast("long"))
    return tables.uncovered_groups(own.where("k % 3 = 0").select("group_id").distinct(), own.where("k % 5 = 0"), "group_id")


def trial_medians(spark: SparkSession, d: str) -> DataFrame:
    """Medians of trials by group with a leave-one-out figure."""
    own = _t(spark, d, "part").selectExpr("concat('g', CAST(p_partkey % 12 AS STRING)) AS orbit", "p_partkey AS trial", "(p_partkey % 97) / 10.0D AS all_rms_mm_per_year", "(p_size * 31 % 89) / 10.0D AS holdout_rms_mm_per_year")
    loocv = tables.load_loocv_metrics(own.groupBy("orbit").agg(F.max("all_rms_mm_per_year").alias("rms_mm_per_year")).where("orbit <> 'g3'"))
    return round_doubles(figures.trial_medians(tables.load_trials(own, "orbit"), loocv))


def legend(spark: SparkSession, d: str) -> DataFrame:
    """Values of the legend of sigmas."""
    got = figures.legend_values(_t(spark, d, "station_values").where("include_in_metrics"), "sigma_up_mm_per_year")
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(got)], "place int, sigma double").select("place", rounded("sigma").alias("sigma"))


def quadratic_prediction(spark: SparkSession, d: str) -> DataFrame:
    """The surface with known coefficients at every derived observation."""
    own = fx.observations(spark, d).withColumn("coefficients", F.array(*[F.lit(v) for v in (1.2, -0.7, 0.3, 0.8, -0.4, 0.6)]))
    got = geo.predict_quadratic("coefficients", crossval.X, crossval.Y)
    return own.select("station_id", rounded(got).alias("predicted"), rounded(F.col(crossval.Z) - got).alias("residual"))


# --- archival tables

RUN_ID = "run-1"


def archive_rasters(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(archive.raster_inventory(_t(spark, d, "raster_meta")).select("product_id", "product_role", "orbit_direction", "crs", "width", "height", "pixel_size_x", "pixel_size_y", "units", "positive_direction", "correction_state"))


def archive_rates(spark: SparkSession, d: str) -> DataFrame:
    own = archive.station_rates(_t(spark, d, "stations"), "solution_no")
    return round_doubles(own.select("solution_id", "station_id", "longitude_deg", "up_mm_per_year", "duration_years", "frame_realization", "processing_center", "physical_site_id").withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("longitude_deg", "up_mm_per_year", "duration_years")}))


def archive_samples(spark: SparkSession, d: str) -> DataFrame:
    own = archive.station_samples(_vlm(spark, d))
    return round_doubles(own.select("sample_id", "solution_id", "product_id", "row_index", "column_index", F.round("sample_distance_m", 3).alias("sample_distance_m"), "station_cell_finite", "inside_raster", "included_in_statistics", "exclusion_reasons", "insar_value_mm_per_year", "residual_insar_minus_gnss_mm_per_year"))


def archive_vertical(spark: SparkSession, d: str) -> DataFrame:
    own = archive.vertical_comparison(_vlm(spark, d))
    return round_doubles(own.select("solution_id", "product_id", "gnss_up_mm_per_year", "insar_vlm_mm_per_year", "residual_insar_minus_gnss_mm_per_year", "station_cell_finite", "included_in_statistics", "exclusion_reasons"))


def archive_metrics(spark: SparkSession, d: str) -> DataFrame:
    own = metrics_frame(_vlm(spark, d), "insar_vlm_mm_per_year", "gnss_up_mm_per_year", tolerance=TOLERANCE)
    return round_doubles(archive.metric_summary(own, RUN_ID, "velocity").select("validation_run_id", "product_id", "selection_name", "evidence_tier", "n_observations", "bias_mm_per_year", "rms_mm_per_year", "pearson_r", "threshold_mm_per_year", "offset_removed"))


def _archive_cv(spark: SparkSession, d: str) -> crossval.CrossValidation:
    return crossval.CrossValidation(fx.observations(spark, d), TRIALS, FRACTION, SEED, tolerance=TOLERANCE)


def archive_splits(spark: SparkSession, d: str) -> DataFrame:
    own = archive.split_assignments(_archive_cv(spark, d), RUN_ID)
    return own.select("validation_run_id", "method", "orbit_or_product_id", "random_seed", "repeat_id", "fold_id", "group_id", "assignment", "n_fitting_groups", "n_held_out_groups")


def archive_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Stations that de-duplication or another rule leaves out, with coordinates."""
    ruled = select_stations(fx.stations(spark, d), DEDUP).withColumns({"pixel_status": F.lit("finite"), "include_in_metrics": F.size("reasons") == 0})
    return round_doubles(exclusions(ruled))


_LIST = (
    csv_stations, csv_observations, number_faults, flag_words, missing_columns, first_rows, selection_reasons_dirty, sample_mismatches_spoiled, consistency_spoiled, worst_residuals, saved_metrics, coregistration,
    evidence_tiers, group_cover, trial_medians, legend, quadratic_prediction, archive_rasters, archive_rates, archive_samples, archive_vertical, archive_metrics, archive_splits, archive_exclusions,
)
QUERIES = {f.__name__: f for f in _LIST}

# --- DuckDB

_PLAIN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_GAPLESS = lambda c: f"CASE WHEN isfinite({c}) THEN {c} END AS {c}"
_TEXT = lambda c: f"nullif({c}, '') AS {c}"
CSV_STATIONS = f"SELECT solution_no, {', '.join(_TEXT(c) if c in ('station_id', 'quality') else _GAPLESS(c) for c in STATION_FIELDS)} FROM stations"
CSV_OBSERVATIONS = f"SELECT obs_no, {', '.join(_TEXT(c) for c in ('orbit', 'station_id', 'group_id'))}, {', '.join(_GAPLESS(c) for c in tables.OBSERVATION_NUMBERS)} FROM observations"


def _fault(column: str, i: int, gap: bool) -> str:
    text = f"trim(v[{i}])"
    empty = f"lower({text}) IN ('', 'nan')"
    shown = f"coalesce(nullif({text}, ''), '(nothing)')"
    bad = f"NOT regexp_matches(v[{i}], '{_PLAIN}') OR abs(TRY_CAST({text} AS DOUBLE)) = 'infinity'"
    return f"SELECT line_id, '{column}' AS column_name, CASE WHEN {empty} THEN {'NULL' if gap else shown} WHEN {bad} THEN {shown} END AS found FROM f"


_FIELDS = (("longitude_deg", False), ("latitude_deg", False), ("east_mm_per_year", True), ("north_mm_per_year", True), ("up_mm_per_year", True))
FAULTS = f"""WITH f AS (SELECT line_id, string_split(regexp_replace(raw_text, '\\r$', ''), ',') AS v FROM raw_station_lines WHERE raw_text NOT LIKE '%"%' AND len(string_split(raw_text, ',')) = 12)
SELECT * FROM ({' UNION ALL '.join(_fault(c, i + 2, gap) for i, (c, gap) in enumerate(_FIELDS))}) WHERE found IS NOT NULL"""
FLAGS = "SELECT p_partkey, CASE WHEN p_partkey % 9 IN (0, 2, 4, 6) THEN true WHEN p_partkey % 9 IN (1, 3, 5, 7) THEN false END AS flag FROM part"
MISSING = """WITH w(table_name, column_name) AS (VALUES ('stations', 'status'), ('stations', 'quality'), ('stations', 'duration_years'), ('observations', 'orbit'), ('observations', 'normalized_pixel_x'), ('station_values', 'station_id'),
  ('station_values', 'insar_los_mm_per_year'), ('station_values', 'gnss_los_mm_per_year'), ('station_values', 'sigma_los_mm_per_year'), ('station_values', 'insar_vlm_mm_per_year'))
SELECT table_name, column_name FROM w WHERE column_name NOT IN (SELECT c.column_name FROM information_schema.columns c WHERE c.table_name = w.table_name)"""
FIRST_ROWS = "SELECT solution_no, row_number() OVER () - 1 AS place FROM stations"
_KEY = "CAST(station_id[2:] AS BIGINT)"
_DIRTY_RULES = _RULES_QUALITY.format(more="", distance="").replace("NOT (isfinite(longitude_deg) AND isfinite(latitude_deg))", "NOT coalesce(isfinite(longitude_deg) AND isfinite(latitude_deg), false)").replace(
    "sigma_east_mm_per_year < 0 OR sigma_north_mm_per_year < 0 OR sigma_up_mm_per_year < 0", "sigma_east_mm_per_year < 0 OR sigma_north_mm_per_year < 0 OR isnan(sigma_up_mm_per_year)"
).replace("THEN 'component_rate", "OR isnan(sigma_up_mm_per_year) THEN 'component_rate")
DIRTY = f"""WITH s AS (SELECT * REPLACE (CASE WHEN {_KEY} % 101 <> 0 THEN CASE WHEN {_KEY} % 211 = 0 THEN CAST('nan' AS DOUBLE) ELSE longitude_deg END END AS longitude_deg,
  CASE WHEN {_KEY} % 103 = 0 THEN -1.0 ELSE sigma_north_mm_per_year END AS sigma_north_mm_per_year, CASE WHEN {_KEY} % 107 = 0 THEN CAST('nan' AS DOUBLE) ELSE sigma_up_mm_per_year END AS sigma_up_mm_per_year) FROM ({fx.STATIONS_SQL}))
SELECT station_id, coalesce(nullif(array_to_string({_reasons(_DIRTY_RULES)}, ';'), ''), 'eligible') AS selection_reason FROM s"""
_SPOILED = "SELECT * REPLACE (CASE WHEN value_no % 50 = 0 THEN insar_vlm_mm_per_year + 1 WHEN value_no % 70 <> 0 THEN insar_vlm_mm_per_year END AS insar_vlm_mm_per_year) FROM station_values"


def _on_spoiled(sql: str) -> str:
    """The same statement over the spoiled samples."""
    head = f"WITH spoiled AS ({_SPOILED})"
    sql = sql.replace("station_values", "spoiled")
    return f"{head}, {sql.removeprefix('WITH ')}" if sql.startswith("WITH ") else f"{head} {sql}"


_GAP = "insar_vlm_mm_per_year - gnss_up_mm_per_year"
WORST = f"""WITH spoiled AS ({_SPOILED}), m AS (SELECT raster_id, value_no, CASE WHEN isfinite(insar_vlm_mm_per_year) AND isfinite(gnss_up_mm_per_year) AND isfinite(residual_mm_per_year) THEN abs(residual_mm_per_year - ({_GAP})) END AS mismatch FROM spoiled)
SELECT raster_id, value_no, {r6('mismatch')} FROM m WHERE mismatch IS NOT NULL QUALIFY row_number() OVER (PARTITION BY raster_id ORDER BY mismatch DESC, value_no) = 1"""
SAVED = f"""{_VLM}, x AS (SELECT res AS r, i_value AS i, up_mm_per_year AS g, median(res) OVER () AS m FROM done WHERE inc)
SELECT n, {', '.join(verify.COMPARED)} FROM (SELECT {_METRICS}, {_PAIRS} FROM x)"""
GRIDS = f"SELECT r AS raster_id, {fx.COLUMNS} AS width, CAST(greatest(1, n // {fx.COLUMNS}) AS INTEGER) AS height, 'EPSG:4326' AS crs, 1 AS band_count FROM (SELECT count(*) AS n FROM part), (VALUES ('velocity'), ('incidence'), ('heading')) v(r)"
TIERS = """WITH x AS (SELECT raster_id AS selection, count(*) FILTER (isfinite(insar_vlm_mm_per_year) AND isfinite(gnss_up_mm_per_year)) AS n FROM station_values WHERE include_in_metrics GROUP BY 1)
SELECT selection, comparison_role, n, evidence_tier, CAST(row_number() OVER (PARTITION BY evidence_tier ORDER BY selection) AS INTEGER) AS tier_rank FROM x, (VALUES ('internal', 1), ('independent', 2)) v(comparison_role, evidence_tier)"""
COVER = "SELECT DISTINCT 'G' || lpad(CAST(p_partkey % 60 AS VARCHAR), 3, '0') AS group_id FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 60 NOT IN (SELECT p_partkey % 60 FROM part WHERE p_partkey % 5 = 0)"
MEDIANS = f"""WITH t AS (SELECT 'g' || (p_partkey % 12) AS orbit, (p_partkey % 97) / CAST(10 AS DOUBLE) AS a, (p_size * 31 % 89) / CAST(10 AS DOUBLE) AS h FROM part)
SELECT orbit, count(*) AS trials, {r6('median(a)', 'all_median_rms_mm_per_year')}, {r6('median(h)', 'holdout_median_rms_mm_per_year')}, {r6('max(greatest(a, h))', 'largest')}, {r6("CASE WHEN orbit <> 'g3' THEN max(a) END", 'loocv_rms_mm_per_year')} FROM t GROUP BY orbit"""
LEGEND = f"""WITH q AS (SELECT unnest(quantile_cont(sigma_up_mm_per_year, [0.25, 0.5, 0.75])) AS v FROM station_values WHERE include_in_metrics AND isfinite(sigma_up_mm_per_year) AND sigma_up_mm_per_year > 0),
u AS (SELECT DISTINCT round_even(v / pow(10, floor(log10(v)) - 1), 0) * pow(10, floor(log10(v)) - 1) AS s FROM q)
SELECT CAST(row_number() OVER (ORDER BY s) - 1 AS INTEGER) AS place, {r6('s', 'sigma')} FROM u"""
_X, _Y, _Z = crossval.X, crossval.Y, crossval.Z
_SURFACE = f"(CAST(1.2 AS DOUBLE) * {_X} - CAST(0.7 AS DOUBLE) * {_Y} + CAST(0.3 AS DOUBLE) + CAST(0.8 AS DOUBLE) * {_X} * {_Y} - CAST(0.4 AS DOUBLE) * {_X} * {_X} + CAST(0.6 AS DOUBLE) * {_Y} * {_Y})"
PREDICTION = f"SELECT station_id, {r6(_SURFACE, 'predicted')}, {r6(f'{_Z} - {_SURFACE}', 'residual')} FROM ({fx.OBSERVATIONS_SQL})"
ARCHIVE_RASTERS = f"SELECT raster_id AS product_id, 'vlm' AS product_role, 'not_applicable' AS orbit_direction, crs, width, height, {r6('sqrt(a * a + d * d)', 'pixel_size_x')}, {r6('sqrt(b * b + e * e)', 'pixel_size_y')}, 'mm/year' AS units, 'up' AS positive_direction, 'raw' AS correction_state FROM raster_meta"
_FIN = lambda c: r6(f"CASE WHEN NOT isnan({c}) THEN {c} END", c)
ARCHIVE_RATES = f"SELECT CAST(solution_no AS VARCHAR) AS solution_id, station_id, {_FIN('longitude_deg')}, {_FIN('up_mm_per_year')}, {_FIN('duration_years')}, frame_realization, processing_center, CAST(NULL AS VARCHAR) AS physical_site_id FROM stations"
_AWAY = f"2 * {geo.EARTH_RADIUS_M} * asin(sqrt(least(1, sin(radians(cy - latitude_deg) / 2) ^ 2 + cos(radians(latitude_deg)) * cos(radians(cy)) * sin(radians(cx - longitude_deg) / 2) ^ 2)))"
_STATED = f"pixel_status = 'finite' AS station_cell_finite, inc AS included_in_statistics, CASE WHEN selection_reason <> 'included' THEN selection_reason ELSE '' END AS exclusion_reasons, {r6('res', 'residual_insar_minus_gnss_mm_per_year')}"
ARCHIVE_SAMPLES = f"""{_VLM}, c AS (SELECT *, CASE WHEN ins THEN CAST(0.1 AS DOUBLE) * (pc + 0.5) - 124 END AS cx, CASE WHEN ins THEN e * (pr + 0.5) + 48 END AS cy FROM done)
SELECT station_id || ':velocity' AS sample_id, station_id AS solution_id, 'velocity' AS product_id, CAST(CASE WHEN ins THEN pr END AS INTEGER) AS row_index, CAST(CASE WHEN ins THEN pc END AS INTEGER) AS column_index, CASE WHEN ins THEN round({_AWAY}, 3) END AS sample_distance_m,
  ins AS inside_raster, {r6('i_value', 'insar_value_mm_per_year')}, {_STATED} FROM c"""
ARCHIVE_VERTICAL = f"{_VLM} SELECT station_id AS solution_id, 'velocity' AS product_id, {r6('up_mm_per_year', 'gnss_up_mm_per_year')}, {r6('i_value', 'insar_vlm_mm_per_year')}, {_STATED} FROM done"
ARCHIVE_METRICS = f"""{_VLM}, x AS (SELECT res AS r, i_value AS i, up_mm_per_year AS g, median(res) OVER () AS m FROM done WHERE inc)
SELECT '{RUN_ID}' AS validation_run_id, 'velocity' AS product_id, 'formal' AS selection_name, 'independent' AS evidence_tier, n AS n_observations, bias_mm_per_year, rms_mm_per_year, correlation AS pearson_r, tolerance_mm_per_year AS threshold_mm_per_year, false AS offset_removed FROM (SELECT {_METRICS}, {_PAIRS} FROM x)"""
ARCHIVE_SPLITS = f"""WITH o AS ({fx.OBSERVATIONS_SQL}), g AS (SELECT orbit, group_id, CAST(row_number() OVER (PARTITION BY orbit ORDER BY group_id) AS INTEGER) AS fold, CAST(count(*) OVER (PARTITION BY orbit) AS INTEGER) AS n FROM (SELECT DISTINCT orbit, group_id FROM o)),
r AS (SELECT CAST(t.range AS INTEGER) AS trial, orbit, group_id, row_number() OVER (PARTITION BY orbit, t.range ORDER BY md5('{SEED}|' || orbit || '|' || t.range || '|' || group_id), group_id) AS r, CAST(greatest(1, round_even({FRACTION} * n, 0)) AS INTEGER) AS k, n FROM g, range(1, {TRIALS + 1}) t)
SELECT '{RUN_ID}' AS validation_run_id, 'leave_one_group_out' AS method, h.orbit AS orbit_or_product_id, CAST(NULL AS BIGINT) AS random_seed, CAST(NULL AS INTEGER) AS repeat_id, h.fold AS fold_id, g.group_id, CASE WHEN g.fold = h.fold THEN 'held_out' ELSE 'fitting' END AS assignment, h.n - 1 AS n_fitting_groups, 1 AS n_held_out_groups FROM g h JOIN g USING (orbit)
UNION ALL SELECT '{RUN_ID}', 'repeated_group_holdout', orbit, {SEED}, trial, NULL, group_id, CASE WHEN r <= k THEN 'held_out' ELSE 'fitting' END, n - k, k FROM r"""

EXCLUDED = f"SELECT station_id, {r6('longitude_deg')}, {r6('latitude_deg')}, selection_reason, 'finite' AS pixel_status FROM ({DEDUPED}) JOIN ({fx.STATIONS_SQL}) USING (station_id) WHERE selection_reason <> 'eligible'"

ORACLE = {
    "csv_stations": CSV_STATIONS, "csv_observations": CSV_OBSERVATIONS, "number_faults": FAULTS, "flag_words": FLAGS, "missing_columns": MISSING, "first_rows": FIRST_ROWS, "selection_reasons_dirty": DIRTY,
    "sample_mismatches_spoiled": _on_spoiled(MISMATCHES), "consistency_spoiled": _on_spoiled(CONSISTENCY), "archive_exclusions": EXCLUDED, "worst_residuals": WORST, "saved_metrics": SAVED, "coregistration": GRIDS, "evidence_tiers": TIERS, "group_cover": COVER, "trial_medians": MEDIANS, "legend": LEGEND, "quadratic_prediction": PREDICTION,
    "archive_rasters": ARCHIVE_RASTERS, "archive_rates": ARCHIVE_RATES, "archive_samples": ARCHIVE_SAMPLES, "archive_vertical": ARCHIVE_VERTICAL, "archive_metrics": ARCHIVE_METRICS, "archive_splits": ARCHIVE_SPLITS,
}
