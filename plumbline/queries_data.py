"""Core queries of problems 4 and 5, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import near, records

NEAR_M = 100.0


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows less than 100 m apart, and the site region around each row."""
    return near.near_and_within(_t(spark, d, "stations"), "solution_no", NEAR_M, _t(spark, d, "site_regions"))


def p4_places(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near places with the rows at each, not expanded into pairs of rows."""
    pairs, members = near.near_rows(near.located(_t(spark, d, "stations"), "solution_no"), NEAR_M)
    n = members.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n"))
    a, b = (n.select(F.col("lon").alias(f"lon_{s}"), F.col("lat").alias(f"lat_{s}"), F.col("n").alias(f"rows_{s}")) for s in "ab")
    out = pairs.join(a, ["lon_a", "lat_a"]).join(b, ["lon_b", "lat_b"])
    return out.select(*[F.round(c, 6).alias(c) for c in ("lon_a", "lat_a", "lon_b", "lat_b")], F.round("distance_m", 3).alias("distance_m"), "rows_a", "rows_b")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that cannot load, with the reason."""
    return records.rejected(records.parse_records(_t(spark, d, "raw_station_lines")))


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Lines that load, as typed station rows."""
    return records.loaded(records.parse_records(_t(spark, d, "raw_station_lines")))


QUERIES = {f.__name__: f for f in (p4_found, p4_places, p5_found, p5_loaded)}

_PLACED = """
placed AS (
  SELECT solution_no, CASE WHEN longitude_deg >= 180 THEN longitude_deg - 360 ELSE longitude_deg END + 0.0 AS lon, latitude_deg + 0.0 AS lat FROM stations
  WHERE isfinite(longitude_deg) AND isfinite(latitude_deg) AND longitude_deg BETWEEN -180 AND 360 AND latitude_deg BETWEEN -90 AND 90),
points AS (SELECT * FROM placed WHERE NOT (lon = 0 AND lat = 0))"""
_DISTANCE = f"2 * {near.EARTH_RADIUS_M} * asin(sqrt(least(1, sin(radians(b.lat - a.lat) / 2) ^ 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ^ 2)))"
P4_FOUND = f"""
WITH {_PLACED},
corners AS (
  SELECT region_no, i, ring_longitude_deg[i] AS x, ring_latitude_deg[i] AS y,
    ring_longitude_deg[i % len(ring_longitude_deg) + 1] AS x2, ring_latitude_deg[i % len(ring_latitude_deg) + 1] AS y2
  FROM site_regions, unnest(generate_series(1, len(ring_longitude_deg))) AS s(i)),
steps AS (SELECT *, x2 - x - 360 * round((x2 - x) / 360) AS dx FROM corners),
sides AS (SELECT region_no, i, y AS ya, y2 AS yb, first(x) OVER w + sum(dx) OVER w - dx AS xa, dx FROM steps WINDOW w AS (PARTITION BY region_no ORDER BY i)),
turns AS (SELECT region_no, solution_no, k, count(*) AS n FROM points p JOIN sides s ON (s.ya > p.lat) <> (s.yb > p.lat), (VALUES (-360), (0), (360)) AS t(k)
  WHERE p.lon + k < s.xa + (p.lat - s.ya) * s.dx / (s.yb - s.ya) GROUP BY ALL)
SELECT 'near' AS relation, a.solution_no AS key_a, b.solution_no AS key_b FROM points a JOIN points b ON a.solution_no < b.solution_no AND abs(a.lat - b.lat) < 0.001
WHERE {_DISTANCE} < {NEAR_M}
UNION ALL
SELECT DISTINCT 'within', region_no, solution_no FROM turns WHERE n % 2 = 1
"""
P4_PLACES = f"""
WITH {_PLACED}, n AS (SELECT lon, lat, count(*) AS n FROM points GROUP BY ALL)
SELECT round(a.lon, 6) AS lon_a, round(a.lat, 6) AS lat_a, round(b.lon, 6) AS lon_b, round(b.lat, 6) AS lat_b, round({_DISTANCE}, 3) AS distance_m, a.n AS rows_a, b.n AS rows_b
FROM n a JOIN n b ON (a.lon < b.lon OR (a.lon = b.lon AND a.lat < b.lat)) AND abs(a.lat - b.lat) < 0.001 WHERE {_DISTANCE} < {NEAR_M}
"""

_FIELD = records._FIELD
_LINE = r"regexp_replace(raw_text, '\r\z', '')"
_NUMBER = "[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_L = records.STATION_LINE
_PARSED = f"""
fields AS (
  SELECT line_id, CASE WHEN regexp_full_match({_LINE}, '(?s){_FIELD}(?:,{_FIELD})*') THEN
    list_transform(regexp_extract_all(',' || {_LINE}, '(?s),({_FIELD})', 1), lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) END AS f FROM raw_station_lines),
bare AS (SELECT line_id, f, list_transform(list_concat(f[2:9], f[11:11]), lambda x: trim(x, ' ' || chr(9))) AS v FROM fields),
judged AS (
  SELECT line_id, f, list_transform(v, lambda x: CASE WHEN x IN ('', 'NaN') THEN NULL ELSE TRY_CAST(x AS DOUBLE) END) AS n,
    CASE WHEN f IS NULL THEN '{records.BROKEN}' WHEN len(f) <> 12 THEN '{records.COUNT}'
      WHEN NOT list_bool_and(list_transform(v, lambda x: x IN ('', 'NaN') OR (regexp_full_match(x, '{_NUMBER}') AND coalesce(isfinite(TRY_CAST(x AS DOUBLE)), false)))) THEN '{records.VALUE}'
      WHEN list_bool_or(list_transform(v[6:8], lambda x: x NOT IN ('', 'NaN') AND TRY_CAST(x AS DOUBLE) < 0)) THEN '{records.VALUE}' END AS reason
  FROM bare)"""
P5_FOUND = f"WITH {_PARSED} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL"
_TYPED = ", ".join(f"n[{_L.numbers.index(name) + 1}] AS {name}" if name in _L.numbers else f"f[{i + 1}] AS {name}" for i, name in enumerate(_L.names))
P5_LOADED = f"WITH {_PARSED} SELECT line_id, {_TYPED} FROM judged WHERE reason IS NULL"
ORACLE = {"p4_found": P4_FOUND, "p4_places": P4_PLACES, "p5_found": P5_FOUND, "p5_loaded": P5_LOADED}
