"""Problem 2: the best representative of each group of duplicate records.

Fields are unpivoted to long rows, every row votes for its normalised value,
votes are summed by value, the winner of each field is chosen by ``max_by`` and
the winners are pivoted back to one record. Two ways to weigh the votes:

* ``votes``: source trust times an exponential decay with age, summed over all
  rows that support a value; agreement of several rows can outvote one.
* ``precedence``: the value of the best supporting row wins, rows being ordered
  by trust, then recency, then the smaller row number. No sum of weights can
  express a strict order: enough provisional rows would outvote an accepted
  one. The votes are summed here as well and do not enter the order.

``p2_survivors`` shows the method with its votes; ``p2_found``, whose order is
fixed, runs the same steps in the mode ``precedence``. The two differ in the
struct that the last ``max_by`` compares and in nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import id_key
from ..functions.scalar import is_finite


@dataclass(frozen=True)
class Field:
    """A field to merge: values within [low, high] (low excluded if open)."""

    name: str
    low: float
    high: float
    open_low: bool = False
    decimals: int = 6

    def usable(self) -> Column:
        c = F.col(self.name)
        above = c > self.low if self.open_low else c >= self.low
        return is_finite(c) & above & (c <= self.high)


#: The fields of the p2 queries with their possible values.
RATE_FIELDS = (
    Field("up_mm_per_year", -200.0, 200.0),
    Field("sigma_up_mm_per_year", 0.0, 50.0),
    Field("duration_years", 0.0, 100.0, open_low=True),
)
# Trust of a delivery by its quality.
TRUST = (("accepted", 3, 1.0), ("provisional", 2, 0.6), ("rejected", 1, 0.2))
NO_TRUST = (0, 0.1)


def trust(quality: Column | str) -> tuple[Column, Column]:
    """Rank and weight of a quality word; anything else has the lowest of both."""
    q = F.lower(F.trim(F.col(quality) if isinstance(quality, str) else quality))
    rank, weight = F.lit(NO_TRUST[0]), F.lit(NO_TRUST[1])
    for word, r, w in TRUST:
        rank, weight = F.when(q == word, F.lit(r)).otherwise(rank), F.when(q == word, F.lit(w)).otherwise(weight)
    return rank, weight


def long_rows(stations: DataFrame, fields: tuple[Field, ...] = RATE_FIELDS) -> DataFrame:
    """``station_key, field_name, value, trust_rank, trust_weight, retrieved_at, solution_no``.

    Only keys with more than one row, and only usable values. A null quality or
    time stays with the lowest trust and the oldest time. A window over the key
    would sort all rows, so the keys are counted and joined instead.
    """
    rank, weight = trust("quality")
    own = stations.select(
        id_key("station_id").alias("station_key"), "solution_no", "retrieved_at", rank.alias("trust_rank"), weight.alias("trust_weight"),
        *[F.when(f.usable(), F.col(f.name).cast("double")).alias(f.name) for f in fields],
    ).where(F.col("station_key").isNotNull())
    several = own.groupBy("station_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("station_key")
    return (
        own.join(several, "station_key", "left_semi")
        .unpivot(["station_key", "solution_no", "retrieved_at", "trust_rank", "trust_weight"], [f.name for f in fields], "field_name", "value")
        .where(F.col("value").isNotNull())
    )


def _decay(retrieved_at: str, half_life_days: float, now: Column) -> Column:
    age = F.greatest(F.lit(0.0), (now - F.unix_micros(F.col(retrieved_at).cast("timestamp"))) / F.lit(86_400e6))
    return F.when(F.col(retrieved_at).isNull(), 0.0).otherwise(F.pow(F.lit(0.5), age / F.lit(half_life_days)))


def elect(
    long: DataFrame,
    mode: str = "votes",
    fields: tuple[Field, ...] = RATE_FIELDS,
    half_life_days: float = 730.0,
    as_of: str = "2026-01-01 00:00:00",
) -> DataFrame:
    """``station_key, field_name, solution_no, value, votes, support``: the winners.

    Votes are summed by normalised value (rounded to the field's decimals);
    ``solution_no`` is the best row that supports the winning value. Ties go to
    the value of the better supporting row, then of the smaller ``solution_no``.
    Both aggregations combine before the shuffle, so a key with a third of all
    rows sends one row for each task and value.
    """
    if mode not in ("votes", "precedence"):
        raise ValueError(f"unknown mode {mode}")
    decimals = reduce(lambda c, f: F.when(F.col("field_name") == f.name, F.round("value", f.decimals)).otherwise(c), fields, F.col("value"))
    now = F.unix_micros(F.to_timestamp(F.lit(as_of)))
    best = F.struct(F.col("trust_rank"), F.coalesce(F.unix_micros(F.col("retrieved_at").cast("timestamp")), F.lit(-(2**63))).alias("at"), (-F.col("solution_no")).alias("minus_no"))
    by_value = (
        long.withColumn("value_key", decimals + F.lit(0.0))
        .groupBy("station_key", "field_name", "value_key")
        .agg(
            F.round(F.sum(F.col("trust_weight") * _decay("retrieved_at", half_life_days, now)), 9).alias("votes"),
            F.count(F.lit(1)).alias("support"),
            F.max(best).alias("best"),
            F.max_by("value", best).alias("value"),
        )
    )
    order = F.struct("best") if mode == "precedence" else F.struct("votes", "best")
    won = F.max_by(F.struct("best", "value", "votes", "support"), order)
    return (
        by_value.groupBy("station_key", "field_name").agg(won.alias("w"))
        .select("station_key", "field_name", (-F.col("w.best.minus_no")).alias("solution_no"), F.col("w.value").alias("value"), F.col("w.votes").alias("votes"), F.col("w.support").alias("support"))
    )


def survivors(winners: DataFrame, fields: tuple[Field, ...] = RATE_FIELDS) -> DataFrame:
    """Pivot the winners back: one row for each key, null where no value was usable,
    with ``<field>_from``, the row each value was taken from."""
    cols = []
    for f in fields:
        hit = F.col("field_name") == f.name
        cols += [F.max(F.when(hit, F.col("value"))).alias(f.name), F.max(F.when(hit, F.col("solution_no"))).alias(f"{f.name}_from")]
    return winners.groupBy("station_key").agg(*cols)
