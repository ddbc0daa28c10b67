"""Problem 4: points near other points, and regions around points.

A Voronoi partition around pivots: every distinct place belongs to its nearest
pivot and is copied to each further cell whose pivot is no more than twice the
radius farther away. By the triangle inequality every place within the radius
of a place of a cell is then present in that cell, so each cell is searched on
its own, with a vantage-point tree under the exact great-circle metric. The
pivots are a bounded sample of the places themselves, so dense regions get many
small cells. Rows at the same coordinates are one place until the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_finite
from ..plans.lineage import cut

EARTH_RADIUS_M = 6_371_008.8
#: Pivots: one for so many places, and no more than MAX_PIVOTS, which bounds
#: what is collected and broadcast (24 bytes each).
PLACES_PER_CELL, MAX_PIVOTS = 4000, 8192
LEAF = 48
#: Pairs of a cell that are sent on together.
OUT_ROWS = 50_000
#: Slack of the replication test in radians (0.6 m): far above rounding.
SLACK = 1e-7


def unit_vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    x, y = np.radians(lon), np.radians(lat)
    return np.column_stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)])


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle angle between unit vectors, exact for small ones too."""
    chord = np.sqrt(np.sum((a - b) ** 2, axis=-1))
    return 2.0 * np.arcsin(np.minimum(1.0, chord / 2.0))


class VantageTree:
    """A vantage-point tree over unit vectors.

    Each node splits its points at the median angle from one of them; equal
    points end in one leaf.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.nodes: list[tuple] = []
        if len(points):
            self._build(np.arange(len(points)))

    def _build(self, own: np.ndarray) -> None:
        todo = [(own, -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][side] = me
            if len(own) > LEAF:
                far = angles(self.points[own], self.points[own[0]])
                vantage = own[int(np.argmax(far))]
                far = angles(self.points[own], self.points[vantage])
                mu = float(np.median(far))
                inner = far <= mu
                if not inner.all():
                    self.nodes.append([vantage, mu, -1, -1])
                    todo += [(own[~inner], me, 3), (own[inner], me, 2)]
                    continue
            self.nodes.append([None, own, -1, -1])

    def within(self, queries: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yield (query indices, point indices) of all pairs at most ``radius`` apart."""
        if not self.nodes or not len(queries):
            return
        reach, stack = radius + 1e-12, [(0, np.arange(len(queries)))]
        while stack:
            at, mine = stack.pop()
            vantage, mu, inner, outer = self.nodes[at]
            if vantage is None:
                for part in np.array_split(mine, max(1, len(mine) * len(mu) // 1_000_000 + 1)):
                    q, p = np.nonzero(angles(queries[part][:, None, :], self.points[mu][None, :, :]) <= reach)
                    if len(q):
                        yield part[q], mu[p]
                continue
            d = angles(queries[mine], self.points[vantage])
            for child, keep in ((inner, d - reach <= mu), (outer, d + reach > mu)):
                if keep.any():
                    stack.append((child, mine[keep]))


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in arrays of at least so many, the last one apart."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in parts:
        held.append(part)
        if sum(len(a) for a, _ in held) >= least:
            yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            held = []
    if held:
        yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])


def haversine_m(lon1, lat1, lon2, lat2) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def located(rows: DataFrame, row_id: str, longitude: str = "longitude_deg", latitude: str = "latitude_deg") -> DataFrame:
    """``row_id, lon, lat`` of the rows with a location.

    Longitudes of both conventions become [-180, 180). Null, NaN, infinite and
    out-of-range coordinates and 0/0 are no location. Extra columns are dropped.
    """
    x, y = F.col(longitude).cast("double"), F.col(latitude).cast("double")
    inside = is_finite(x) & is_finite(y) & x.between(-180.0, 360.0) & y.between(-90.0, 90.0)
    own = rows.where(inside).select(F.col(row_id).alias("row_id"), (F.when(x >= 180.0, x - 360.0).otherwise(x) + F.lit(0.0)).alias("lon"), (y + F.lit(0.0)).alias("lat"))
    return own.where(~((F.col("lon") == 0.0) & (F.col("lat") == 0.0)))


class Cells:
    """The Voronoi partition of a table of places (``lon, lat``, distinct)."""

    def __init__(self, places: DataFrame, radius_m: float) -> None:
        spark = places.sparkSession
        self.radius = radius_m / EARTH_RADIUS_M
        self.n = places.count()
        k = min(MAX_PIVOTS, max(1, math.ceil(self.n / PLACES_PER_CELL)))
        chosen = places.orderBy(F.xxhash64("lon", "lat"), "lon", "lat").limit(k).collect()
        self.pivots = unit_vectors(np.array([r[0] for r in chosen], float), np.array([r[1] for r in chosen], float))
        shared, reach = spark.sparkContext.broadcast(self.pivots), 2 * self.radius + SLACK

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots = shared.value
            step = max(1, 4_000_000 // max(1, len(pivots)))
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    lon, lat = part.column(0).to_numpy(), part.column(1).to_numpy()
                    xyz = unit_vectors(lon, lat)
                    dots = np.clip(xyz @ pivots.T, -1.0, 1.0)
                    home = np.argmax(dots, axis=1)
                    here = angles(xyz, pivots[home])
                    row, cell = np.nonzero(dots >= np.cos(np.minimum(here + reach, math.pi))[:, None])
                    extra = cell != home[row]
                    row, cell = np.concatenate([np.arange(len(lon)), row[extra]]), np.concatenate([home, cell[extra]])
                    own = np.arange(len(row)) < len(lon)
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(own), pa.array(lon[row]), pa.array(lat[row]), pa.array(here[row])], ["cell", "own", "lon", "lat", "angle"])

        self.rows = cut(places.select("lon", "lat").mapInArrow(assign, "cell int, own boolean, lon double, lat double, angle double"))

    def near(self, radius_m: float) -> DataFrame:
        """Pairs of places less than the radius apart: ``lon_a, lat_a, lon_b, lat_b, distance_m``,
        each once, the smaller (longitude, latitude) first."""
        radius = self.radius

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell = pa.Table.from_batches(list(batches)).combine_chunks()
            lon, lat = cell.column("lon").to_numpy(), cell.column("lat").to_numpy()
            own = np.flatnonzero(cell.column("own").to_numpy(zero_copy_only=False))
            xyz = unit_vectors(lon, lat)
            # Pairs leave as they are found: a dense cell has far more than places.
            for a, b in _gathered(VantageTree(xyz).within(xyz[own], radius + SLACK), OUT_ROWS):
                a = own[a]
                first = (lon[a] < lon[b]) | ((lon[a] == lon[b]) & (lat[a] < lat[b]))
                a, b = a[first], b[first]
                d = haversine_m(lon[a], lat[a], lon[b], lat[b])
                keep = d < radius_m
                a, b, d = a[keep], b[keep], d[keep]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()) for x in (lon[a], lat[a], lon[b], lat[b], d)], ["lon_a", "lat_a", "lon_b", "lat_b", "distance_m"])

        return self.rows.select("cell", "own", "lon", "lat").groupBy("cell").applyInArrow(search, "lon_a double, lat_a double, lon_b double, lat_b double, distance_m double")

    def regions(self, regions: DataFrame, region_id: str, ring_longitude: str, ring_latitude: str) -> DataFrame:
        """``region_id, lon, lat``: the places inside each region.

        A region is sent to the cells that its bounding cap can touch, judged by
        each cell's covering radius. Sides are straight in longitude and
        latitude; a side over more than 180 degrees of longitude crosses the
        date line; a ring around a pole is closed through it. Rings of fewer
        than three vertices, of unequal lengths or with missing coordinates
        hold nothing.
        """
        spark = self.rows.sparkSession
        radii = np.full(len(self.pivots), -1.0)
        for r in self.rows.where("own").groupBy("cell").agg(F.max("angle").alias("a")).collect():  # one row for each pivot
            radii[r["cell"]] = r["a"]
        shared = spark.sparkContext.broadcast((self.pivots, radii))
        kind = regions.schema[region_id].dataType.simpleString()

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, radii = shared.value
            for batch in batches:
                out: list[tuple] = []
                for rid, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (ring := closed_ring(x, y)) is None:
                        continue
                    centre, cap = bounding_cap(*ring)
                    hit = np.flatnonzero((radii >= 0) & (angles(pivots, centre) <= cap + radii + SLACK))
                    out += [(int(c), rid, ring[0].tolist(), ring[1].tolist()) for c in hit]
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], batch.schema.field(0).type), pa.array(cols[2], pa.list_(pa.float64())), pa.array(cols[3], pa.list_(pa.float64()))], ["cell", "rid", "x", "y"])

        rings = regions.where(F.col(region_id).isNotNull()).select(F.col(region_id).alias("rid"), F.col(ring_longitude).cast("array<double>"), F.col(ring_latitude).cast("array<double>")).mapInArrow(spread, f"cell int, rid {kind}, x array<double>, y array<double>")
        places = self.rows.where("own").select("cell", "lon", "lat")

        def inside(key, own, around):
            lon, lat = own.column("lon").to_numpy(), own.column("lat").to_numpy()
            ids, xs, ys = [], [], []
            kind = around.schema.field("rid").type
            if len(lon):
                for rid, x, y in zip(*(around.column(c).to_pylist() for c in ("rid", "x", "y")), strict=True):
                    hit = np.flatnonzero(in_ring(lon, lat, np.array(x), np.array(y)))
                    ids += [rid] * len(hit)
                    xs.append(lon[hit])
                    ys.append(lat[hit])
            joined = [np.concatenate(v) if v else np.zeros(0) for v in (xs, ys)]
            return pa.table([pa.array(ids, kind), pa.array(joined[0], pa.float64()), pa.array(joined[1], pa.float64())], names=["rid", "lon", "lat"])

        return places.groupBy("cell").cogroup(rings.groupBy("cell")).applyInArrow(inside, f"rid {kind}, lon double, lat double")


def closed_ring(lon: list | None, lat: list | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The ring with unwrapped longitudes, closed; None if it is no ring."""
    if lon is None or lat is None or len(lon) != len(lat) or any(v is None or not math.isfinite(v) for v in (*lon, *lat)):
        return None
    if len(lon) > 1 and (lon[0], lat[0]) == (lon[-1], lat[-1]):
        lon, lat = lon[:-1], lat[:-1]
    if len(lon) < 3:
        return None
    x, y = np.array([*lon, lon[0]], float), np.array([*lat, lat[0]], float)
    step = np.diff(x)
    step = np.where(step > 180, step - 360, np.where(step < -180, step + 360, step))
    x = np.concatenate([x[:1], x[0] + np.cumsum(step)])
    if abs(x[-1] - x[0]) > 180:  # once around: through the pole that it encloses
        pole = 90.0 if y.mean() > 0 else -90.0
        x, y = np.concatenate([x, [x[-1], x[0], x[0]]]), np.concatenate([y, [pole, pole, y[0]]])
    return x, y


def bounding_cap(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and angular radius of a cap that holds the ring."""
    at, px, py = np.linspace(0, 1, 181), [], []
    for i in range(len(x) - 1):  # steps of two degrees at most
        px.append(x[i] + at * (x[i + 1] - x[i]))
        py.append(y[i] + at * (y[i + 1] - y[i]))
    v = unit_vectors(np.concatenate(px), np.concatenate(py))
    mean = v.mean(axis=0)
    size = np.linalg.norm(mean)
    if size < 0.2:  # more than a hemisphere, perhaps: every cell
        return np.array([0.0, 0.0, 1.0]), math.pi
    centre = mean / size
    cap = float(angles(v, centre).max()) + math.radians(3.0)
    return centre, cap if cap < math.pi / 2 else math.pi


def in_ring(lon: np.ndarray, lat: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd test against a closed, unwrapped ring, in blocks of points."""
    out = np.zeros(len(lon), bool)
    low, high = y[:-1], y[1:]
    slope = np.where(high != low, (x[1:] - x[:-1]) / np.where(high != low, high - low, 1.0), 0.0)
    turns = range(math.floor((x.min() - 180) / 360), math.ceil((x.max() + 180) / 360) + 1)
    for i in range(0, len(lon), 20_000):
        px, py = lon[i : i + 20_000, None], lat[i : i + 20_000, None]
        crosses = (low > py) != (high > py)
        meet = x[:-1] + (py - low) * slope
        for turn in turns:
            out[i : i + 20_000] |= (np.sum(crosses & (px + 360 * turn < meet), axis=1) % 2).astype(bool)
    return out


def near_rows(points: DataFrame, radius_m: float, cells: Cells | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of places and the membership of rows, for located points
    (``row_id, lon, lat``): rows at the same coordinates share a place and are
    not expanded into pairs. See :func:`expand_pairs`.
    """
    if not (radius_m > 0 and math.isfinite(radius_m)):
        raise ValueError("the radius must be positive and finite")
    cells = cells or Cells(points.select("lon", "lat").distinct(), radius_m)
    return cells.near(radius_m), points.select("row_id", "lon", "lat")


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``key_a, key_b`` of every two rows at near or equal places, smaller first.

    Null row ids take part in no pair; a repeated id gives its pairs once. Only
    a repeated id can give a pair twice, so the pairs, which are many, are
    de-duplicated only where the members, which are few, have one.
    """
    m = members.where(F.col("row_id").isNotNull())
    repeated = not m.groupBy("row_id").count().where("count > 1").isEmpty()
    a = m.select(F.col("row_id").alias("a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"))
    b = m.select(F.col("row_id").alias("b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"))
    apart = pairs.join(a, ["lon_a", "lat_a"]).join(b, ["lon_b", "lat_b"]).select("a", "b")
    same = a.join(b, (F.col("lon_a") == F.col("lon_b")) & (F.col("lat_a") == F.col("lat_b")) & (F.col("a") < F.col("b"))).select("a", "b")
    both = apart.unionByName(same).where("a <> b")
    out = both.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))
    return out.distinct() if repeated else out


def near_and_within(rows: DataFrame, row_id: str, radius_m: float, regions: DataFrame, region_id: str = "region_no", ring_longitude: str = "ring_longitude_deg", ring_latitude: str = "ring_latitude_deg") -> DataFrame:
    """``relation, key_a, key_b``: ``near`` for two rows less than ``radius_m``
    apart, ``within`` for a region and a row that it holds.

    Rows without a location are in neither. No rows or no regions give no pairs
    of that kind. One partition serves both relations.
    """
    points = cut(located(rows, row_id))
    cells = Cells(points.select("lon", "lat").distinct(), radius_m)
    pairs, members = near_rows(points, radius_m, cells)
    near = expand_pairs(pairs, members).select(F.lit("near").alias("relation"), F.col("key_a").cast("long").alias("key_a"), F.col("key_b").cast("long").alias("key_b"))
    inside = cells.regions(regions, region_id, ring_longitude, ring_latitude).join(points.where(F.col("row_id").isNotNull()), ["lon", "lat"])
    within = inside.select(F.lit("within").alias("relation"), F.col("rid").cast("long").alias("key_a"), F.col("row_id").cast("long").alias("key_b")).distinct()
    return near.unionByName(within)
