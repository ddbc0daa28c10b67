"""Problem 3: pairwise match results consolidated into groups.

Every record gets one group identifier that covers all records linked with it
directly or through others. The components are found by Borůvka hooking
(``operators.components``); links by a shared group enter as a star around the
smallest key of the group, so a group of n records gives n - 1 edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import id_key
from ..operators.components import connected_components
from ..plans.lineage import cut_counting
from ..plans.skew import lookup


def star_edges(members: DataFrame, member: str, group: str) -> DataFrame:
    """Edges ``a, b`` that tie all members of a group to its smallest one.

    The smallest is found by a partial aggregation and looked up from the
    distinct memberships, hot groups by broadcast; null members or groups give
    no edge.
    """
    pairs, n = cut_counting(members.select(F.col(member).alias("b"), F.col(group).alias("g")).where(F.col("b").isNotNull() & F.col("g").isNotNull()).distinct())
    least = pairs.groupBy("g").agg(F.min("b").alias("a"))
    return lookup(pairs, "g", least, "inner", n).where(F.col("a") != F.col("b")).select("a", "b")


def is_match(verdict: Column | str) -> Column:
    c = F.col(verdict) if isinstance(verdict, str) else verdict
    return F.lower(F.trim(c)) == "match"


def station_links(matches: DataFrame, values: DataFrame) -> DataFrame:
    """Edges between station keys: verdict match, or a shared pixel group.

    A null or other verdict, a missing id and an empty or blank group link
    nothing. A group that no id of its own writes in several ways is compared
    after trimming. Extra columns are ignored.
    """
    by_match = matches.where(is_match("verdict")).select(id_key("station_a").alias("a"), id_key("station_b").alias("b"))
    members = values.select(id_key("station_id").alias("s"), F.trim("group_id").alias("g")).where(F.col("g") != "")
    return by_match.unionByName(star_edges(members, "s", "g"))


def consolidate(edges: DataFrame, records: DataFrame | None = None, key: str = "station_key") -> DataFrame:
    """Return ``group_key, station_key``: one row for every record.

    ``edges`` has columns a, b. ``records`` (column ``key``) adds the records
    that no edge names; each is its own group. Null keys are left out, repeated
    ones count once. ``group_key`` is the smallest key of the group.
    """
    parts = connected_components(edges, "a", "b").select(F.col("component").alias("group_key"), F.col("node").alias("station_key"))
    if records is None:
        return parts
    every = records.select(F.col(key).alias("station_key")).where(F.col("station_key").isNotNull()).distinct()
    alone = every.join(parts, "station_key", "left_anti").select(F.col("station_key").alias("group_key"), "station_key")
    return parts.unionByName(alone)


def all_station_keys(*tables: tuple[DataFrame, str]) -> DataFrame:
    """Distinct non-missing keys of the given (table, id column) pairs."""
    keys = None
    for df, col in tables:
        part = df.select(id_key(col).alias("station_key"))
        keys = part if keys is None else keys.unionByName(part)
    return keys.where(F.col("station_key").isNotNull()).distinct()
