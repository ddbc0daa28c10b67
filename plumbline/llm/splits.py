"""Problem 1: splits that keep related records together.

Records that share a station or a group, directly or through others, form a
block; every block gets one of the labels, so that the shares asked for are met
in every orbit. Blocks of equal size in every orbit are bundled. A min-cost flow
sends the units (blocks) of each bundle to the splits at a convex cost for the
deviation from each quota of each label: augmenting paths, then cancelling of
negative residual cycles. It is carried out by hash order within the bundle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions.ids import id_key
from ..operators.components import connected_components
from ..plans.lineage import cut, cut_counting
from ..plans.skew import lookup
from .groups import star_edges

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Blocks of more rows than this are put in bundles by size to this relative precision.
EXACT_ROWS, COARSE = 512, 1.02
#: Blocks of one bundle that are ordered together by hash.
RUN = 50_000
#: Bundles of no more units are placed unit by unit.
FEW = 64
#: Bundles tried for the first two arcs of a cycle over three splits.
NEAREST = 48
#: Least gain for which flow is changed.
EPSILON = 1e-9


def orbit_label(col: str = "orbit") -> Column:
    """ascending, descending or unknown, from any way of writing it."""
    c = F.lower(F.trim(F.col(col)))
    return F.when(c.startswith("a"), "ascending").when(c.startswith("d"), "descending").otherwise("unknown")


def linked_groups(keyed: DataFrame) -> DataFrame:
    """``group_key, block``: every non-missing group and the smallest group that
    it must stay with. ``keyed`` has station and group keys ``s`` and ``g``;
    missing ones tie nothing together."""
    edges = star_edges(keyed, "g", "s")
    parts = connected_components(edges, "a", "b").select(F.col("node").alias("group_key"), F.col("component").alias("block"))
    groups = keyed.where(F.col("g").isNotNull()).select(F.col("g").alias("group_key")).distinct()
    return groups.join(parts, "group_key", "left").select("group_key", F.coalesce("block", "group_key").alias("block"))


def block_of_rows(observations: DataFrame, row_id: str = "obs_no") -> tuple[DataFrame, DataFrame]:
    """``(row_id, orbit_label, block)`` for every row, and the linked groups.

    A row with a group belongs to the group's block, one without to the block
    of its station's groups, or of the station alone, or to itself when both
    ids are missing. The block keys of the last two kinds begin with ``s:`` and
    ``r:`` in lower case, which no group key contains. The keys are made once
    and written; hot groups and stations are looked up by broadcast.
    """
    rows, n = cut_counting(observations.select(row_id, orbit_label().alias("orbit_label"), id_key("station_id").alias("s"), id_key("group_id").alias("g")))
    groups = cut(linked_groups(rows))
    first = rows.where(F.col("s").isNotNull() & F.col("g").isNotNull()).groupBy("s").agg(F.min("g").alias("group_key"))
    of_station = first.join(groups, "group_key").select("s", F.col("block").alias("sb"))
    by_group = lookup(rows.where(F.col("g").isNotNull()), "g", groups.withColumnRenamed("group_key", "g"), "inner", n).select(row_id, "orbit_label", "block")
    rest = rows.where(F.col("g").isNull())
    by_station = lookup(rest, "s", of_station, "left", n).select(
        row_id, "orbit_label",
        F.coalesce("sb", F.concat(F.lit("s:"), F.col("s")), F.concat(F.lit("r:"), F.coalesce(F.col(row_id).cast("string"), F.lit("null")))).alias("block"),
    )
    return cut(by_group.unionByName(by_station)), groups


class Network:
    """The flow from bundles through splits to the quotas of every label.

    An arc runs from each bundle to each split; a unit on it carries the rows of
    a block to the (split, label) arcs behind, whose cost is convex in the
    deviation from the quota: (load - quota)^2 / quota. In the residual network a
    unit may be sent back and on to another split, so a cycle through the splits
    takes one unit of any bundle along each of its arcs.
    """

    def __init__(self, bundles: list[tuple[int, tuple[float, ...]]], shares: list[float]) -> None:
        self.n = np.array([n for n, _ in bundles], np.int64)
        self.profile = np.array([p for _, p in bundles], float).reshape(len(bundles), -1)
        self.shares = np.array(shares, float)
        self.quota = np.outer(self.shares, self.n @ self.profile) if len(bundles) else np.zeros((len(shares), 0))
        self.weight = 1.0 / np.maximum(self.quota, 1.0)
        self.left = self.quota.copy()
        self.flow = np.zeros((len(bundles), len(shares)), np.int64)

    def cost(self) -> float:
        return float(np.sum(self.left**2 * self.weight))

    def put(self, i: int, j: int, units: int) -> None:
        self.flow[i, j] += units
        self.left[j] -= units * self.profile[i]

    def augment(self) -> None:
        """Send every unit along the shortest path, the largest units first.

        A bundle of many units is sent until the marginal costs of the splits it
        uses are equal, in closed form; the units that are left over by rounding
        down, and those of bundles of few units, take the arc of least overflow,
        since what comes later is finer and fills the rest.
        """
        open_ = [j for j in range(len(self.shares)) if self.shares[j] > 0]
        for i in sorted(range(len(self.n)), key=lambda i: (-self.profile[i].sum(), i)):
            n, p = int(self.n[i]), self.profile[i]
            slope = np.maximum(1e-12, self.weight @ (p * p))
            pull = (self.left * self.weight) @ p
            active = list(open_)
            while n > FEW:
                level = (sum(pull[j] / slope[j] for j in active) - n) / sum(1 / slope[j] for j in active)
                keep = [j for j in active if pull[j] > level]
                if len(keep) == len(active):
                    for j in active:
                        self.put(i, j, math.floor((pull[j] - level) / slope[j]))
                    break
                active = keep
            for _ in range(n - int(self.flow[i].sum())):
                over = ((np.maximum(0.0, p - self.left) ** 2 - np.maximum(0.0, -self.left) ** 2) * self.weight * (p > 0)).sum(axis=1)
                self.put(i, min(open_, key=lambda j: (round(float(over[j]), 9), -float(self.left[j] @ p), j)), 1)

    def arc(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """For one unit of each bundle from split a to split b: the parts of the
        change of cost that are linear and quadratic in the number of units."""
        slope = 2.0 * (self.weight[a] * self.left[a] - self.weight[b] * self.left[b])
        return self.profile @ slope, (self.profile**2) @ (self.weight[a] + self.weight[b])

    def cancel_one_way(self, a: int, b: int) -> bool:
        """The best number of units of one bundle from a to b, if that lowers the cost."""
        linear, square = self.arc(a, b)
        there = self.flow[:, a] > 0
        steps = np.clip(np.rint(-linear / np.maximum(2.0 * square, 1e-300)), 1, np.maximum(self.flow[:, a], 1))
        change = np.where(there, linear * steps + square * steps**2, np.inf)
        i = int(np.argmin(change)) if len(change) else 0
        if not len(change) or not change[i] < -EPSILON:
            return False
        self.put(i, a, -int(steps[i]))
        self.put(i, b, int(steps[i]))
        return True

    def cancel_two(self, first: tuple[int, int], second: tuple[int, int]) -> bool:
        """The best two units, one along each of two arcs, if they lower the cost:
        a cycle where the second arc leads back, else a path. Every two bundles
        are looked at."""
        (a, b), (c, d) = first, second
        (lin1, sq1), (lin2, sq2) = self.arc(a, b), self.arc(c, d)
        # Where the arcs meet in a split, loads add up (same direction) or cancel.
        bend = sum((np.where(x == y, 1.0, 0.0) * sign * self.weight[x] for x, y, sign in ((a, c, 1), (b, d, 1), (a, d, -1), (b, c, -1))), np.zeros(self.profile.shape[1]))
        best, found = -EPSILON, None
        out, back = np.flatnonzero(self.flow[:, a] > 0), np.flatnonzero(self.flow[:, c] > 0)
        for k in range(0, len(out), 1024):
            part = out[k : k + 1024]
            change = (lin1 + sq1)[part, None] + (lin2 + sq2)[None, back] + 2.0 * (self.profile[part] * bend) @ self.profile[back].T
            if a == c:  # a bundle of one unit cannot give two
                change[(part[:, None] == back[None, :]) & (self.flow[part, a] < 2)[:, None]] = np.inf
            if change.size and change.min() < best:
                x, y = np.unravel_index(int(np.argmin(change)), change.shape)
                best, found = float(change[x, y]), (int(part[x]), int(back[y]))
        if found is None:
            return False
        for i, (x, y) in zip(found, (first, second), strict=True):
            self.put(i, x, -1)
            self.put(i, y, 1)
        return True

    def cancel_three(self, a: int, b: int, c: int) -> bool:
        """A cycle a, b, c, a with a unit of one bundle on each arc. The first
        two are any of the NEAREST that are cheapest on their arcs, the third
        is any."""
        heads = []
        for x, y in ((a, b), (b, c)):
            linear, square = self.arc(x, y)
            there = np.flatnonzero(self.flow[:, x] > 0)
            heads.append(there[np.argsort((linear + square)[there], kind="stable")[:NEAREST]])
        third = np.flatnonzero(self.flow[:, c] > 0)
        if not all(len(v) for v in (*heads, third)):
            return False
        before = self.cost()
        p = self.profile
        la = self.left[a] + p[heads[0]][:, None, :]
        lb = self.left[b] - p[heads[0]][:, None, :] + p[heads[1]][None, :, :]
        lc = self.left[c] - p[heads[1]][None, :, :]
        rest = before - float(np.sum(self.left[[a, b, c]] ** 2 * self.weight[[a, b, c]]))
        best, found = before - EPSILON, None
        fixed = np.sum(lb**2 * self.weight[b], axis=2) + rest
        for m in third:
            after = fixed + np.sum((la - p[m]) ** 2 * self.weight[a], axis=2) + np.sum((lc + p[m]) ** 2 * self.weight[c], axis=2)
            x, y = np.unravel_index(int(np.argmin(after)), after.shape)
            if after[x, y] < best:
                best, found = float(after[x, y]), (int(heads[0][x]), int(heads[1][y]), int(m))
        if found is None:
            return False
        for i, x, y in zip(found, (a, b, c), (b, c, a), strict=True):
            self.put(i, x, -1)
            self.put(i, y, 1)
        return True

    def cancel(self) -> None:
        """Cancel negative cycles and paths until none is left of those looked
        for: the cost falls with each, so this ends."""
        used = [j for j in range(len(self.shares)) if self.shares[j] > 0]
        arcs = [(a, b) for a in used for b in used if a != b]
        cycles = [((a, b), (b, a)) for a, b in arcs if a < b]
        twos = [(x, y) for k, x in enumerate(arcs) for y in arcs[k:] if (x, y) not in cycles]
        while (
            any([self.cancel_one_way(a, b) for a, b in arcs])
            or any([self.cancel_two(*t) for t in cycles])
            or any(self.cancel_two(*t) for t in twos)
            or any(self.cancel_three(*t) for t in permutations(used, 3))
        ):
            # Loads are formed anew, so that rounding does not build up.
            self.left = self.quota - self.flow.T @ self.profile


def allocate(bundles: list[tuple[int, tuple[float, ...]]], shares: list[float]) -> list[list[int]]:
    """Whole units of each bundle for each split, by min-cost flow.

    ``bundles`` holds (number of units, rows of a unit by label). Fractional
    flow always meets every quota (each bundle is dealt in proportion), so the
    least cost of the relaxed problem is zero and the cost reached is itself
    the bound of the gap to the optimum. Whole units are sent by augmenting
    paths and improved until no negative residual cycle or path is left with
    units of one bundle, of any two, or of three (:meth:`Network.cancel_three`). Units differ in size and labels, so an optimum over whole units in
    general would be a partition problem.
    """
    if not bundles:
        return []
    net = Network(bundles, shares)
    net.augment()
    net.cancel()
    return net.flow.tolist()


def _coarse(c: Column) -> Column:
    """The count itself, or beyond EXACT_ROWS the power of COARSE that it falls in."""
    step = F.floor(F.log(c.cast("double")) / F.lit(math.log(COARSE)))
    return F.when(c <= EXACT_ROWS, c.cast("long")).otherwise(-step.cast("long"))


def split_related(observations: DataFrame, shares: Mapping[str, float] | None = None, row_id: str = "obs_no", seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assign each record to a split; related records land in the same one.

    Returns ``rows`` (row_id, orbit_label, block, split), ``blocks`` (block,
    split) and ``groups`` (group_key, block). Every row is kept: missing ids
    give blocks of their own, a null orbit counts as the orbit ``unknown``.
    Repeated rows are rows. An empty table gives empty results. Columns other
    than orbit, station_id, group_id and ``row_id`` are ignored.

    Bundles are exact up to EXACT_ROWS rows by label and within 2 % beyond, so
    their number, which the driver solves, is bounded by the cube of the number
    of sizes (about 1,500, there being three labels) and by the number of
    blocks; most blocks are small and of few kinds, so it is far smaller in
    practice. Their exact mean sizes enter the costs.
    """
    shares = dict(SHARES if shares is None else shares)
    if not shares or any(v < 0 for v in shares.values()) or abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must be non-negative and sum to one")
    spark = observations.sparkSession
    rows, groups = block_of_rows(observations, row_id)
    labels = ("ascending", "descending", "unknown")
    sizes = cut(rows.groupBy("block").agg(*[F.count_if(F.col("orbit_label") == o).alias(o) for o in labels]))
    profile = sizes.select("block", *labels, *[_coarse(F.col(o)).alias(f"k{i}") for i, o in enumerate(labels)])
    keys = [f"k{i}" for i in range(len(labels))]
    found = profile.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(o).alias(o) for o in labels]).orderBy(*keys).collect()
    names = [n for n in shares]
    flow = allocate([(r["n"], tuple(r[o] / r["n"] for o in labels)) for r in found], [shares[n] for n in names])
    plan, most = [], 1
    for b, (r, units) in enumerate(zip(found, flow, strict=True)):
        most = max(most, r["n"])
        start = 0
        for name, u in zip(names, units, strict=True):
            if u:
                plan.append((*[r[k] for k in keys], b, start, start + u, name))
            start += u
    schema = T.StructType([*[T.StructField(k, T.LongType()) for k in keys], T.StructField("bundle", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("split", T.StringType())])
    plan_df = spark.createDataFrame(plan, schema)
    bundle_of = spark.createDataFrame([(*[r[k] for k in keys], b) for b, r in enumerate(found)], T.StructType(schema.fields[:4]))
    # Rank by hash within a bundle: an offset for each run of hashes, then a
    # row number inside the run, so that no task sorts a whole bundle.
    runs = max(1, math.ceil(most / RUN))
    h = F.xxhash64(F.lit(seed), F.col("block"))
    hashed = profile.join(F.broadcast(bundle_of), keys).select("block", "bundle", h.alias("h"), F.pmod(F.shiftrightunsigned(h, 20), F.lit(runs)).alias("run"))
    if runs == 1:
        offsets = None
        placed = hashed.withColumn("base", F.lit(0))
    else:
        counts = hashed.groupBy("bundle", "run").count()
        offsets = counts.select("bundle", "run", (F.sum("count").over(W.Window.partitionBy("bundle").orderBy("run")) - F.col("count")).alias("base"))
        placed = hashed.join(offsets, ["bundle", "run"])
    ranked = placed.withColumn("rank", F.col("base") + F.row_number().over(W.Window.partitionBy("bundle", "run").orderBy("h", "block")) - 1)
    spans = plan_df.select("bundle", F.struct("lo", "hi", "split").alias("x")).groupBy("bundle").agg(F.collect_list("x").alias("spans"))
    hit = F.filter("spans", lambda x: (F.col("rank") >= x["lo"]) & (F.col("rank") < x["hi"]))
    blocks = cut(ranked.join(F.broadcast(spans), "bundle").select("block", hit[0]["split"].alias("split")))
    return lookup(rows, "block", blocks, "inner", sum(r[o] for r in found for o in labels)), blocks, groups


def split_shares(rows: DataFrame) -> DataFrame:
    """``orbit_label, split, n_rows, share`` of an assignment."""
    by = rows.groupBy("orbit_label", "split").agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("n_rows").over(W.Window.partitionBy("orbit_label"))
    return by.withColumn("share", F.round(F.col("n_rows") / total, 6))


def split_quotas(rows: DataFrame, shares: Mapping[str, float] = SHARES) -> DataFrame:
    """Whether an assignment keeps what it promises, by orbit and split:
    ``orbit_label, split, n_orbit, n_blocks, within, n_divided``. ``within`` says
    that the split is no farther from its share of the orbit's rows than the
    largest block of the orbit is large; ``n_divided`` counts the orbit's blocks
    that have rows in several splits."""
    by = rows.groupBy("orbit_label", "block").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("k"))
    whole = by.groupBy("orbit_label").agg(F.sum("n").alias("n_orbit"), F.count(F.lit(1)).alias("n_blocks"), F.max("n").alias("largest"), F.count_if(F.col("k") > 1).alias("n_divided"))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("split"), F.lit(float(v)).alias("asked")) for k, v in shares.items()])).alias("a")
    got = rows.groupBy("orbit_label", "split").agg(F.count(F.lit(1)).alias("n_split"))
    each = whole.select("*", asked).select("*", "a.split", "a.asked").join(got, ["orbit_label", "split"], "left")
    off = F.abs(F.coalesce("n_split", F.lit(0)) - F.col("asked") * F.col("n_orbit"))
    return each.select("orbit_label", "split", "n_orbit", "n_blocks", (off <= F.col("largest")).alias("within"), "n_divided")
