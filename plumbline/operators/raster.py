"""Rasters as tables of cells, and the cell that contains a point.

A raster is ``raster_id, row_index, column_index, cell_value`` (absent cells
have no data) with one row of ``raster_meta``: the affine a..f (x = a col + b row
+ c, y = d col + e row + f), width, height, crs, nodata, dtype, band_count.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_finite

MAX_RASTERS = 500
STATUS = ("finite", "no_data", "out_of_bounds", "invalid_coordinate", "geometry_no_data")


def normalized_crs(crs: str | None) -> str | None:
    """``EPSG:4326`` from any way of writing a code; other text trimmed upper case."""
    if crs is None:
        return None
    m = re.search(r"EPSG[^0-9]*([0-9]+)", crs.upper())
    return f"EPSG:{m.group(1)}" if m else crs.strip().upper() or None


def crs_matches(declared: str, actual: str | None) -> bool:
    return actual is not None and normalized_crs(declared) == normalized_crs(actual)


def audit_coregistration(meta: DataFrame, raster_ids: list[str]) -> None:
    """Raise unless all rasters have one band, and equal size, CRS and transform."""
    rows = [r.asDict() for r in meta.where(F.col("raster_id").isin(raster_ids)).limit(len(raster_ids) + 1).collect()]
    if sorted(r["raster_id"] for r in rows) != sorted(raster_ids):
        raise ValueError(f"rasters missing or repeated: {sorted(raster_ids)}")
    bands = [r["raster_id"] for r in rows if r["band_count"] != 1]
    if bands:
        raise ValueError(f"not single-band: {bands}")
    kinds = {(r["width"], r["height"], normalized_crs(r["crs"]), *(r[k] for k in "abcdef")) for r in rows}
    if len(kinds) > 1:
        raise ValueError("the rasters are not on one grid")


def clean_cells(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Cells with data: null, NaN, infinite and nodata values are left out.
    The meta table has one row for each raster and is small."""
    nodata = meta.select("raster_id", "nodata")
    joined = cells.join(F.broadcast(nodata), "raster_id")
    v = F.col("cell_value")
    return joined.where(is_finite(v) & ~F.coalesce(v == F.col("nodata"), F.lit(False))).select("raster_id", "row_index", "column_index", v.cast("double").alias("cell_value"))


def containing_cell(points: DataFrame, meta: DataFrame, longitude: str = "longitude_deg", latitude: str = "latitude_deg") -> DataFrame:
    """For ``points`` and every raster (at most MAX_RASTERS, whose headers become
    part of the plan) add the containing cell: raster_id, pixel_row_zero_based, pixel_column_zero_based (-1 outside),
    pixel_center_x, pixel_center_y and ``_inside``, ``_known``.

    The upper left edges belong to a cell, the lower right ones do not; rotated
    and sheared transforms are inverted in full.
    """
    heads = meta.select("raster_id", "width", "height", *"abcdef").orderBy("raster_id").limit(MAX_RASTERS + 1).collect()
    if len(heads) > MAX_RASTERS:
        raise ValueError(f"more than {MAX_RASTERS} rasters at once")
    x, y = F.col(longitude).cast("double"), F.col(latitude).cast("double")
    kinds = {f.name: f.dataType for f in meta.schema.fields}
    structs = [F.struct(*[F.lit(r[k]).cast(kinds[k]).alias(k) for k in r.asDict()]) for r in heads]
    if not structs:
        structs = [F.struct(*[F.lit(None).cast(kinds[k]).alias(k) for k in ("raster_id", "width", "height", *"abcdef")])]
        points = points.limit(0)
    clash = [c for c in ("raster_id", "width", "height", *"abcdef") if c in points.columns]
    at = points.drop(*clash).select("*", F.inline(F.array(*structs)))
    dx, dy, det = x - F.col("c"), y - F.col("f"), F.col("a") * F.col("e") - F.col("b") * F.col("d")
    known = is_finite(x) & is_finite(y)
    straight = (F.col("b") == 0) & (F.col("d") == 0)
    col = F.floor(F.when(straight, F.try_divide(dx, F.col("a"))).otherwise(F.try_divide(F.col("e") * dx - F.col("b") * dy, det)))
    row = F.floor(F.when(straight, F.try_divide(dy, F.col("e"))).otherwise(F.try_divide(F.col("a") * dy - F.col("d") * dx, det)))
    at = at.withColumns({"_known": known, "_col": F.when(known, col), "_row": F.when(known, row)})
    inside = F.coalesce(F.col("_col").between(0, F.col("width") - 1) & F.col("_row").between(0, F.col("height") - 1), F.lit(False))
    at = at.withColumn("_inside", inside)
    mid_c, mid_r = F.col("_col") + 0.5, F.col("_row") + 0.5

    def if_inside(c: Column) -> Column:
        return F.when(F.col("_inside"), c)

    return at.withColumns({
        "pixel_row_zero_based": F.coalesce(if_inside(F.col("_row")), F.lit(-1)).cast("int"),
        "pixel_column_zero_based": F.coalesce(if_inside(F.col("_col")), F.lit(-1)).cast("int"),
        "pixel_center_x": if_inside(F.col("a") * mid_c + F.col("b") * mid_r + F.col("c")),
        "pixel_center_y": if_inside(F.col("d") * mid_c + F.col("e") * mid_r + F.col("f")),
    }).drop("width", "height", *"abcdef", "_col", "_row")


def sample(points: DataFrame, cells: DataFrame, meta: DataFrame, values: Mapping[str, str] | None = None, longitude: str = "longitude_deg", latitude: str = "latitude_deg") -> DataFrame:
    """The value of the containing cell for every point and raster.

    Adds the columns of :func:`containing_cell`, the value (``cell_value``),
    ``pixel_status`` and the cell's ``group_id`` (``r<row>_c<column>``, empty
    outside). There is no fallback to a neighbouring cell. The wanted cells,
    distinct, are joined with the raster, and the points with what was hit:
    where stations are few against cells the first join broadcasts the cells
    wanted (Spark judges their size) and the raster is read without a shuffle.
    """
    at = containing_cell(points, meta, longitude, latitude)
    keys = ["raster_id", "row_index", "column_index"]
    at = at.withColumns({"row_index": F.col("pixel_row_zero_based"), "column_index": F.col("pixel_column_zero_based")})
    wanted = at.where("_inside").select(*keys).distinct()
    hits = clean_cells(cells, meta).join(wanted, keys)
    out = at.join(hits, keys, "left").drop("row_index", "column_index")
    status = F.when(~F.col("_known"), "invalid_coordinate").when(~F.col("_inside"), "out_of_bounds").when(F.col("cell_value").isNull(), "no_data").otherwise("finite")
    group = F.when(F.col("_inside"), F.concat(F.lit("r"), F.col("pixel_row_zero_based").cast("string"), F.lit("_c"), F.col("pixel_column_zero_based").cast("string"))).otherwise("")
    return out.withColumns({"pixel_status": status, "group_id": group}).drop("_known", "_inside")


def sample_colocated(points: DataFrame, cells: DataFrame, meta: DataFrame, rasters: Mapping[str, str]) -> DataFrame:
    """Values of co-registered rasters at the containing cell, one row a point.

    ``rasters`` maps raster ids to output columns; the first is the one whose
    ``pixel_status`` counts. The rasters are pivoted on the cell first, so there
    is one join with the points, whatever the number of rasters.
    """
    ids = list(rasters)
    audit_coregistration(meta, ids)
    own = clean_cells(cells.where(F.col("raster_id").isin(ids)), meta)
    one = meta.where(F.col("raster_id") == ids[0])
    wide = own.groupBy("row_index", "column_index").agg(*[F.max(F.when(F.col("raster_id") == i, F.col("cell_value"))).alias(rasters[i]) for i in ids])
    at = containing_cell(points, one).drop("raster_id")
    at = at.withColumns({"row_index": F.col("pixel_row_zero_based"), "column_index": F.col("pixel_column_zero_based")})
    keys = ["row_index", "column_index"]
    wanted = at.where("_inside").select(*keys).distinct()
    out = at.join(wide.join(wanted, keys), keys, "left").drop(*keys)
    first = F.col(rasters[ids[0]])
    geometry = F.lit(True)
    for i in ids[1:]:
        geometry = geometry & F.col(rasters[i]).isNotNull()
    status = F.when(~F.col("_known"), "invalid_coordinate").when(~F.col("_inside"), "out_of_bounds").when(first.isNull(), "no_data").when(~geometry, "geometry_no_data").otherwise("finite")
    group = F.when(F.col("_inside"), F.concat(F.lit("r"), F.col("pixel_row_zero_based").cast("string"), F.lit("_c"), F.col("pixel_column_zero_based").cast("string"))).otherwise("")
    return out.withColumns({"pixel_status": status, "group_id": group}).drop("_known", "_inside")


def block_average(cells: DataFrame, meta: DataFrame, side: int = 1024) -> DataFrame:
    """A preview of at most ``side`` x ``side`` blocks: the mean of the cells
    with data in each block."""
    k = F.greatest(F.lit(1), F.ceil(F.greatest("width", "height") / F.lit(side)))
    steps = meta.select("raster_id", k.cast("int").alias("block_cells"))
    own = clean_cells(cells, meta).join(F.broadcast(steps), "raster_id")
    block = lambda c: F.floor(F.col(c) / F.col("block_cells")).cast("int")
    return own.groupBy("raster_id", block("row_index").alias("block_row"), block("column_index").alias("block_column")).agg(F.avg("cell_value").alias("mean_value"), F.count(F.lit(1)).alias("n_cells"))


def crop(cells: DataFrame, meta: DataFrame, west: float, east: float, south: float, north: float) -> DataFrame:
    """Cells with data whose centre lies in the region, with the centre
    (``x, y``). The region becomes a range of rows and columns of each raster,
    whose headers are broadcast, however many; rotated or sheared rasters are
    refused."""
    if meta.where("b <> 0 OR d <> 0").limit(1).collect():
        raise ValueError("a rotated or sheared raster cannot be cropped")
    if not (west < east and south < north):
        raise ValueError("the region is empty")
    span = lambda u, v, origin, step: [f(*[(F.lit(w) - F.col(origin)) / F.col(step) - 0.5 for w in (u, v)]) for f in (F.least, F.greatest)]
    (left, right), (top, bottom) = span(west, east, "c", "a"), span(south, north, "f", "e")
    heads = meta.select("raster_id", *[F.col(k).alias(f"_{k}") for k in "acef"], left.alias("_left"), right.alias("_right"), top.alias("_top"), bottom.alias("_bottom"))
    own = clean_cells(cells, meta).join(F.broadcast(heads), "raster_id")
    own = own.where(F.col("column_index").between(F.col("_left"), F.col("_right")) & F.col("row_index").between(F.col("_top"), F.col("_bottom")))
    x, y = F.col("_a") * (F.col("column_index") + 0.5) + F.col("_c"), F.col("_e") * (F.col("row_index") + 0.5) + F.col("_f")
    return own.select("raster_id", "row_index", "column_index", x.alias("x"), y.alias("y"), "cell_value")


def is_geographic(crs: str | None) -> bool:
    """Whether a CRS has longitudes and latitudes: a code of that range, or so its text begins."""
    named = normalized_crs(crs) or ""
    code = named.removeprefix("EPSG:")
    return 4000 <= int(code) < 5000 if code.isdigit() else named.startswith(("GEOGCS", "GEOGCRS", "GEODCRS", "OGC:CRS84"))


def inspect(cells: DataFrame, meta: DataFrame) -> dict:
    """Header and region (west, east, south, north) of the one raster to be
    shown, with its number of cells with data; ValueError unless it has one
    band, a geographic CRS and data."""
    heads = summary(cells, meta).limit(2).collect()
    if len(heads) != 1:
        raise ValueError("one raster is needed")
    r = heads[0].asDict()
    if r["band_count"] != 1:
        raise ValueError(f"{r['raster_id']} has {r['band_count']} bands")
    if not is_geographic(r["crs"]):
        raise ValueError(f"{r['raster_id']} has no geographic CRS: {r['crs']}")
    if not r["n_valid"]:
        raise ValueError(f"{r['raster_id']} has no data")
    xs = [r["c"] + r["a"] * i + r["b"] * j for i in (0, r["width"]) for j in (0, r["height"])]
    ys = [r["f"] + r["d"] * i + r["e"] * j for i in (0, r["width"]) for j in (0, r["height"])]
    return {k: r[k] for k in ("crs", "width", "height", "n_valid", "minimum", "maximum")} | {"region": [min(xs), max(xs), min(ys), max(ys)]}


def summary(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Header of each raster with its number of cells with data and their range."""
    stats = clean_cells(cells, meta).groupBy("raster_id").agg(F.count(F.lit(1)).alias("n_valid"), F.min("cell_value").alias("minimum"), F.max("cell_value").alias("maximum"))
    return meta.join(stats, "raster_id", "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0).cast("long")))
