"""Where a model is supported: nearest fitting sites, nearest valid cells and
the convex hull of the fitting sites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.scalar import is_finite
from .near import EARTH_RADIUS_M, VantageTree, angles, unit_vectors
from .raster import clean_cells, containing_cell

#: Fitting sites of one pass (24 bytes each); more are searched in more passes.
SITES_PER_PASS = 500_000


class _Nearest(VantageTree):
    def nearest(self, queries: np.ndarray) -> np.ndarray:
        """The smallest angle from each query to any point."""
        best = np.full(len(queries), np.pi + 1e-9)
        stack = [(0, np.arange(len(queries)))]
        while stack:
            at, mine = stack.pop()
            vantage, mu, inner, outer = self.nodes[at]
            if vantage is None:
                d = angles(queries[mine][:, None, :], self.points[mu][None, :, :]).min(axis=1) if len(mu) else best[mine]
                best[mine] = np.minimum(best[mine], d)
                continue
            d = angles(queries[mine], self.points[vantage])
            best[mine] = np.minimum(best[mine], d)
            near_inner = d <= mu
            # The likelier side is searched first: it is pushed last.
            for first in (False, True):
                for child, side, keep in ((inner, near_inner, d - best[mine] <= mu), (outer, ~near_inner, d + best[mine] > mu)):
                    pick = keep & (side == first)
                    if pick.any():
                        stack.append((child, mine[pick]))
        return best


def nearest_site_distance(rows: DataFrame, sites: DataFrame, output: str = "nearest_fitting_distance_m") -> DataFrame:
    """Add the great-circle distance to the nearest site, null without a
    location or without sites. The sites are searched in passes of
    SITES_PER_PASS with a vantage-point tree each; nothing is shuffled."""
    ok = is_finite("longitude_deg") & is_finite("latitude_deg")
    own = sites.where(ok).select(F.col("longitude_deg").cast("double").alias("x"), F.col("latitude_deg").cast("double").alias("y")).distinct()
    passes: list[list[tuple[float, float]]] = []
    for r in own.toLocalIterator():
        if not passes or len(passes[-1]) == SITES_PER_PASS:
            passes.append([])
        passes[-1].append((r[0], r[1]))
    out = rows.drop(output).withColumn(output, F.lit(None).cast("double"))
    schema = out.schema
    where = out.columns.index(output)
    for sites_of_pass in passes:
        xy = np.array(sites_of_pass)
        shared = rows.sparkSession.sparkContext.broadcast(unit_vectors(xy[:, 0], xy[:, 1]))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tree = _Nearest(shared.value)
            for batch in batches:
                lon, lat = (batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("longitude_deg", "latitude_deg"))
                good = np.isfinite(lon) & np.isfinite(lat)
                d = np.full(len(lon), np.nan)
                d[good] = tree.nearest(unit_vectors(lon[good], lat[good])) * EARTH_RADIUS_M
                d = np.fmin(d, batch.column(where).to_numpy(zero_copy_only=False))
                cols = list(batch.columns)
                cols[where] = pa.array(d, pa.float64(), mask=np.isnan(d))
                yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

        out = out.mapInArrow(search, schema)
    return out


def nearest_valid_cell(points: DataFrame, cells: DataFrame, meta: DataFrame, key: str, reach: int = 2) -> DataFrame:
    """For display only: the nearest cell with data within ``reach`` rows and
    columns of the containing cell, with its distance in cells; nulls where the
    raster has no data that near. One row for every point in every raster that
    contains it. Such values never enter metrics: ``include_in_metrics`` is false."""
    at = containing_cell(points, meta).where(F.col("_inside")).select(key, "raster_id", "pixel_row_zero_based", "pixel_column_zero_based")
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    around = at.withColumn("_dr", F.explode(steps)).withColumn("_dc", F.explode(steps))
    around = around.withColumns({"row_index": F.col("pixel_row_zero_based") + F.col("_dr"), "column_index": F.col("pixel_column_zero_based") + F.col("_dc")})
    hit = around.join(clean_cells(cells, meta), ["raster_id", "row_index", "column_index"], "left")
    found = F.struct((F.col("_dr") * F.col("_dr") + F.col("_dc") * F.col("_dc")).alias("d"), "row_index", "column_index", "cell_value")
    best = F.min(F.when(F.col("cell_value").isNotNull(), found))
    return hit.groupBy(key, "raster_id").agg(best.alias("b")).select(key, "raster_id", F.sqrt(F.col("b.d").cast("double")).alias("distance_cells"), F.col("b.row_index").alias("row_index"), F.col("b.column_index").alias("column_index"), F.col("b.cell_value").alias("cell_value"), F.lit(False).alias("include_in_metrics"))


def convex_hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def half(order) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = half(pts), half(pts[::-1])
    return np.array(lower[:-1] + upper[:-1])


#: Tasks that merge the corners found by batches before the driver does.
HULL_TASKS = 16


def hull_of(sites: DataFrame, x: str, y: str) -> np.ndarray:
    """The hull of all sites: each batch sends only its own hull's corners,
    HULL_TASKS tasks merge them, and the driver merges what these found."""

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hull = np.zeros((0, 2))
        for batch in batches:
            hull = convex_hull(np.concatenate([hull, np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])]))
        yield pa.RecordBatch.from_arrays([pa.array(hull[:, 0]), pa.array(hull[:, 1])], ["x", "y"])

    own = sites.where(is_finite(x) & is_finite(y)).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    merged = own.mapInArrow(corners, "x double, y double").coalesce(HULL_TASKS).mapInArrow(corners, "x double, y double")
    table = merged.toArrow()
    return convex_hull(np.column_stack([table.column(c).to_numpy() for c in "xy"]).reshape(-1, 2))


def inside_hull(rows: DataFrame, hull: np.ndarray, x: str, y: str, output: str = "inside_fitting_hull") -> DataFrame:
    """Flag rows inside or on a convex hull; null without coordinates. The hull,
    as many corners as it has, is broadcast and each row is held against the
    side below it and the side above it, found by bisection."""
    out = rows.drop(output).withColumn(output, F.lit(None).cast("boolean"))
    where, slack = out.columns.index(output), 1e-12
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(hull, float))

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hull = shared.value
        for batch in batches:
            px, py = (batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x, y))
            good, inside = np.isfinite(px) & np.isfinite(py), np.zeros(batch.num_rows, bool)
            if len(hull) >= 3:
                inside = _between(hull, px, py, slack) & good
            cols = list(batch.columns)
            cols[where] = pa.array(inside, pa.bool_(), mask=~good)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return out.mapInArrow(flag, out.schema)


def _between(hull: np.ndarray, px: np.ndarray, py: np.ndarray, slack: float) -> np.ndarray:
    """Points on the inner side of the side of a counter-clockwise hull that
    runs below them and of the one above."""
    first, last = np.lexsort((hull[:, 1], hull[:, 0]))[[0, -1]]
    turned = np.roll(hull, -first, axis=0)
    last = (last - first) % len(hull)
    lower, upper = turned[: last + 1], np.concatenate([turned[last:], turned[:1]])[::-1]
    inside = (px >= lower[0, 0] - slack) & (px <= lower[-1, 0] + slack)
    for chain, sign in ((lower, 1.0), (upper, -1.0)):
        i = np.clip(np.searchsorted(chain[:, 0], px, "right") - 1, 0, len(chain) - 2)
        a, b = chain[i], chain[i + 1]
        inside &= sign * ((b[:, 0] - a[:, 0]) * (py - a[:, 1]) - (b[:, 1] - a[:, 1]) * (px - a[:, 0])) >= -slack
    return inside


def evidence_tiers(metrics: DataFrame, role: str = "comparison_role") -> DataFrame:
    """Number the tiers of evidence, which are never merged: internal agreement,
    then independent comparison."""
    tier = F.when(F.col(role) == "internal", 1).when(F.col(role) == "independent", 2)
    return metrics.withColumn("evidence_tier", tier).withColumn("tier_rank", F.row_number().over(W.Window.partitionBy("evidence_tier").orderBy("selection")))
