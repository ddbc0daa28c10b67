"""Stations, rasters and observations derived from customer and part, by
arithmetic that every engine evaluates alike. Each has a SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEST, NORTH, STEP, COLUMNS = -124.0, 48.0, 0.1, 40
_K = "(c_custkey - CASE WHEN c_custkey % 10 IN (1, 2) THEN c_custkey % 10 ELSE 0 END)"
STATION_COLUMNS = {
    "station_id": "concat('S', CAST(c_custkey AS STRING))",
    "longitude_deg": f"-124.0D + (({_K} * 7919) % 10007) * 4.0D / 10007.0D + CASE WHEN c_custkey % 89 = 0 THEN 10.0D ELSE 0.0D END",
    "latitude_deg": f"48.0D - (({_K} * 6271) % 10009) * 4.0D / 10009.0D - (c_custkey - {_K}) * 0.0005D",
    "east_mm_per_year": "((c_custkey * 31) % 2001 - 1000) / 100.0D",
    "north_mm_per_year": "((c_custkey * 53) % 2001 - 1000) / 100.0D",
    "up_mm_per_year": "CASE WHEN c_custkey % 97 <> 0 THEN ((c_custkey * 71) % 2001 - 1000) / 100.0D END",
    "sigma_east_mm_per_year": "((c_custkey * 17) % 300) / 100.0D",
    "sigma_north_mm_per_year": "((c_custkey * 19) % 300) / 100.0D",
    "sigma_up_mm_per_year": "((c_custkey * 23) % 300) / 100.0D",
    "duration_years": "((c_custkey * 13) % 300) / 10.0D",
    "nearest_fitting_distance_m": "((c_custkey * 37) % 5000) * 1.0D",
    "status": "c_mktsegment",
}
CELL_VALUES = {
    "velocity": "CASE WHEN p_size % 11 <> 0 THEN (p_retailprice * 7.0D) % 40.0D - 20.0D END",
    "incidence": "CASE WHEN p_size % 13 <> 0 THEN 30.0D + (p_partkey % 150) / 10.0D END",
    "heading": "CASE WHEN p_size % 13 <> 0 THEN -13.0D + (p_partkey % 7) END",
}
_X, _Y = "((p_partkey * 37) % 201 - 100) / 100.0D", "((p_partkey * 61) % 197 - 98) / 98.0D"
OBSERVATION_COLUMNS = {
    "orbit": "CASE WHEN p_partkey % 2 = 0 THEN 'ascending' ELSE 'descending' END",
    "station_id": "concat('P', CAST(p_partkey AS STRING))",
    "group_id": "concat('G', lpad(CAST(p_partkey % 60 AS STRING), 3, '0'))",
    "normalized_pixel_x": _X,
    "normalized_pixel_y": _Y,
    "residual_before_fit_mm_per_year": f"1.2D * ({_X}) - 0.7D * ({_Y}) + 0.3D + 0.8D * ({_X}) * ({_Y}) - 0.4D * ({_X}) * ({_X}) + 0.6D * ({_Y}) * ({_Y}) + ((p_partkey * 29) % 101 - 50) / 100.0D",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr(*[f"{v} AS {k}" for k, v in STATION_COLUMNS.items()])


def raster_rows(spark: SparkSession, d: str) -> int:
    return max(1, table(spark, d, "part").count() // COLUMNS)


def cells(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    each = [F.struct(F.lit(name).alias("raster_id"), F.expr(value).alias("cell_value")) for name, value in CELL_VALUES.items()]
    own = part.select(F.expr("CAST(floor(p_partkey / 40) AS INT)").alias("row_index"), F.expr("CAST(p_partkey % 40 AS INT)").alias("column_index"), F.explode(F.array(*each)).alias("c"))
    return own.select("c.raster_id", "row_index", "column_index", "c.cell_value")


def meta(spark: SparkSession, d: str) -> DataFrame:
    rows = raster_rows(spark, d)
    values = [(name, "EPSG:4326", COLUMNS, rows, STEP, 0.0, WEST, 0.0, -4.0 / rows, NORTH, None, "float64", 1) for name in CELL_VALUES]
    return spark.createDataFrame(values, "raster_id string, crs string, width int, height int, a double, b double, c double, d double, e double, f double, nodata double, dtype string, band_count int")


def observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(*[f"{v} AS {k}" for k, v in OBSERVATION_COLUMNS.items()])


def _sql(columns: dict[str, str], source: str) -> str:
    body = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    return f"SELECT {duck(body)} FROM {source}"


def duck(expression: str) -> str:
    """The same expression for DuckDB: double literals and integer arithmetic."""
    import re

    out = re.sub(r"(\d+\.\d+)D", r"CAST(\1 AS DOUBLE)", expression)
    return out.replace("AS STRING", "AS VARCHAR").replace("concat('", "concat('")


STATIONS_SQL = _sql(STATION_COLUMNS, "customer")
OBSERVATIONS_SQL = _sql(OBSERVATION_COLUMNS, "part")
CELLS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS raster_id, CAST(p_partkey // 40 AS INTEGER) AS row_index, CAST(p_partkey % 40 AS INTEGER) AS column_index, {duck(v)} AS cell_value FROM part" for n, v in CELL_VALUES.items())
