"""Look-ups on keys of which some hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in HOT_SHARE of its table, so
#: there are never more than HOT_SHARE hot keys: the bound of the broadcast.
HOT_SHARE = 2000
#: Below this many rows a single key fits any task and nothing is treated as hot.
HOT_LEAST_ROWS = 2_000_000


def lookup(rows: DataFrame, key: str, table: DataFrame, how: str = "left", total: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Join ``rows`` with ``table`` (at most one row for each key) on ``key``.

    Keys that hold more than ``1/HOT_SHARE`` of a large ``rows`` are joined by
    broadcast (at most HOT_SHARE rows of ``table``); the others are shuffled.
    ``how`` is ``left`` or ``inner``. Null keys match nothing: kept by ``left``.
    ``total`` is the number of rows when known, ``hot`` has the hot keys (once
    each) when known; otherwise they are counted.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"lookup cannot do a {how} join")
    n = rows.count() if total is None else total
    if n < HOT_LEAST_ROWS:
        return rows.join(table, key, how)
    limit = n // HOT_SHARE
    if hot is None:
        hot = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > limit).select(key)
    hot = hot.withColumn("_hot", F.lit(True))
    flagged = rows.join(F.broadcast(hot), key, "left")
    few = table.join(F.broadcast(hot.select(key)), key, "left_semi")
    a = flagged.where(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(few), key, how)
    b = flagged.where(F.col("_hot").isNull()).drop("_hot").join(table, key, how)
    return a.unionByName(b)
