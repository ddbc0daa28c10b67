"""Connected components by Borůvka hooking.

Every component selects its smallest outgoing edge, the trees that arise
collapse by pointer doubling, edges are relabelled and de-duplicated, and the
rounds go on until no edge is left. Edges are ordered by a hash of their ends
(then by the ends themselves), so the order is total, the result deterministic
and the trees shallow even on long chains. A round at least halves the number
of components that still have edges: there are O(log n) rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Scratch, cut
from ..plans.skew import lookup


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def _collapse(hooks: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """Pointer doubling of ``c -> p`` (at most ``n`` rows) until every p is a root.

    A row whose p is known to be a root (``done``) is left alone, so a step joins
    only what is still on its way; the write itself counts those.
    """
    while True:
        far = hooks.select(F.col("c").alias("p"), F.col("p").alias("pp"), F.col("done").alias("pd"))
        step = lookup(hooks.where("NOT done"), "p", far, "inner", n).select("c", F.col("pp").alias("p"), F.col("pd").alias("done"))
        hooks, left = scratch.cut_counting(hooks.where("done").unionByName(step), ~F.col("done"))
        if not left:
            return hooks.select("c", "p")


def _hooks(live: DataFrame) -> DataFrame:
    """``c, p, done``: every component of an edge of ``live`` and the component
    that it hooks to along its smallest edge.

    A component can be the choice of any number of others, so the choices are not
    joined with each other: they are grouped by the edge chosen, which is one
    or two rows. An edge chosen from both sides makes its smaller end a root.
    """
    ends = live.select(F.xxhash64("lo", "hi").alias("w"), "lo", "hi", F.explode(F.array(F.col("lo"), F.col("hi"))).alias("c"))
    picks = ends.groupBy("c").agg(F.min(F.struct("w", "lo", "hi")).alias("e"))
    chosen = picks.groupBy("e").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("c"))
    lo, hi = F.col("e.lo"), F.col("e.hi")
    row = lambda c, p, done: F.struct(c.alias("c"), p.alias("p"), F.lit(done).alias("done"))
    both = F.array(row(lo, lo, True), row(hi, lo, True))
    one = F.array(row(F.col("c"), F.when(F.col("c") == lo, hi).otherwise(lo), False))
    return chosen.select(F.inline(F.when(F.col("k") == 2, both).otherwise(one)))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Return ``node, component`` for every node that has an edge.

    ``component`` is the smallest node of the component by code point. Edges
    with a null end and self edges link nothing; repeats and either order are
    the same edge; extra columns are ignored. No edges give an empty result.
    """
    with Scratch(edges.sparkSession) as scratch:
        whole, n = _roots(edges, a, b, scratch)
    names = whole.groupBy("p").agg(F.min("c").alias("component"))
    return lookup(whole, "p", names, "inner", n).select(F.col("c").alias("node"), "component")


def _roots(edges: DataFrame, a: str, b: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """``c, p``: every node and the root that its component ended in, and a
    bound of their number."""
    lo, hi = _ordered(F.col(a), F.col(b))
    live, n = scratch.cut_counting(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(lo.alias("lo"), hi.alias("hi"))
        .distinct()
    )
    rounds: list[tuple[DataFrame, int]] = []
    while n > 0:
        hooks, left = scratch.cut_counting(_hooks(live), ~F.col("done"))
        hooks = _collapse(hooks, 2 * n, scratch) if left else hooks.select("c", "p")
        rounds.append((hooks, 2 * n))
        ends_lo = hooks.select(F.col("c").alias("lo"), F.col("p").alias("plo"))
        ends_hi = hooks.select(F.col("c").alias("hi"), F.col("p").alias("phi"))
        joined = lookup(lookup(live, "lo", ends_lo, "inner", n), "hi", ends_hi, "inner", n)
        x, y = _ordered(F.col("plo"), F.col("phi"))
        live, n = scratch.cut_counting(joined.where(F.col("plo") != F.col("phi")).select(x.alias("lo"), y.alias("hi")).distinct())
    if not rounds:
        return cut(live.select(F.col("lo").alias("c"), F.col("hi").alias("p"))), 0
    # Later rounds know only the roots of earlier ones: compose from the last.
    whole, n = rounds[-1]
    for earlier, n in reversed(rounds[:-1]):
        later = whole.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        whole = lookup(earlier, "p", later, "left", n).select("c", F.coalesce("pp", "p").alias("p"))
    return cut(whole), n
