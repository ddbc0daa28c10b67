"""Grouped cross-validation of the quadratic surface.

Every kind of split (the full fit, leave one group out, repeated holdout) goes
the same way: rows are reduced to one triangular factor for each group, splits
are fitted from the factors of the groups that they keep, and residuals are
formed by joining the few models back to the rows. Rows are never copied for a
fit; a split costs its groups' factors, not its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.geometry import predict_quadratic
from ..functions.scalar import is_finite
from ..plans.lineage import cut
from ..plans.skew import lookup
from .metrics import NMAD_SCALE, RESIDUAL_METRICS, rms_distribution, summarize_residuals
from .quadratic import FIT, MAX_CONDITION, WIDTH, design, factors, reduce_rows, solve
from .selection import require_columns
from .trials import drawn_bits, held_names, listed_bits, marked_rows, trial_metrics, trial_rms

X, Y, Z = "normalized_pixel_x", "normalized_pixel_y", "residual_before_fit_mm_per_year"
COLUMNS = ("orbit", "station_id", "group_id", X, Y, Z)
#: Models (about 100 bytes each) that are broadcast; beyond, rows are salted.
BROADCAST_MODELS = 100_000


def usable(observations: DataFrame) -> DataFrame:
    """Rows with all keys and finite numbers; the others are left out."""
    ok = F.col("orbit").isNotNull() & F.col("group_id").isNotNull() & is_finite(X) & is_finite(Y) & is_finite(Z)
    return observations.where(ok)


def gate(observations: DataFrame) -> DataFrame:
    """The observations, after a check that all keys are there, all numbers
    finite and every orbit has at least two groups; ValueError otherwise."""
    require_columns(observations, COLUMNS)
    bad = F.col("orbit").isNull() | F.col("group_id").isNull() | ~(is_finite(X) & is_finite(Y) & is_finite(Z))
    n, wrong = observations.agg(F.count(F.lit(1)), F.count_if(bad)).first()
    if not n or wrong:
        raise ValueError(f"{wrong} of {n} observations have missing keys or numbers that are not finite" if n else "there are no observations")
    alone = observations.groupBy("orbit").agg(F.count_distinct("group_id").alias("g")).where("g < 2").limit(5).collect()
    if alone:
        raise ValueError(f"fewer than two groups in {[r['orbit'] for r in alone]}")
    return observations


def group_list(observations: DataFrame) -> DataFrame:
    """``orbit, group_id, fold``: groups numbered from one within each orbit."""
    from .selection import _numbered

    own = observations.select("orbit", "group_id").distinct().select(F.struct("orbit", "group_id").alias("k"))
    n = cut(_numbered(own, "k").select("k.orbit", "k.group_id", "n"))
    first = n.groupBy("orbit").agg(F.min("n").alias("first"))
    return n.join(F.broadcast(first), "orbit").select("orbit", "group_id", (F.col("n") - F.col("first") + 1).cast("int").alias("fold"))


def holdout_size(groups: int, fraction: float) -> int:
    """Groups to hold out: rounded half to even, at least one, leaving one."""
    if not 0 < fraction < 1:
        raise ValueError("the holdout fraction must lie between 0 and 1")
    k = max(1, round(fraction * groups))
    if k >= groups:
        raise ValueError("the holdout leaves no fitting group")
    return k


def holdout_assignments(groups: DataFrame, trials: int = 100, fraction: float = 0.2, seed: int = 0, rng: str = "hash") -> DataFrame:
    """``orbit, trial, group_id`` of the groups held out in each trial.

    ``hash`` ranks the groups of a trial by md5 of seed, orbit, trial and group;
    ``numpy`` draws them with the generator seeded for each orbit, which takes
    the ordered group names to the driver (for tables with few groups).
    """
    if trials < 1:
        raise ValueError("trials must be at least one")
    counts = {r["orbit"]: r["n"] for r in groups.groupBy("orbit").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {o: holdout_size(n, fraction) for o, n in counts.items()}
    if rng == "hash":
        k = F.create_map(*[F.lit(v) for o, n in sizes.items() for v in (o, n)])
        each = groups.select("orbit", "group_id", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
        mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("orbit"), F.col("trial").cast("string"), F.col("group_id")))
        return _smallest(each.withColumn("_mark", mark), k[F.col("orbit")], max(counts.values(), default=0)).select("orbit", "trial", "group_id")
    if rng != "numpy":
        raise ValueError(f"unknown generator {rng!r}")
    names: dict[str, list[str]] = {}
    for r in groups.select("orbit", "group_id").toLocalIterator():
        names.setdefault(r[0], []).append(r[1])
    rows = []
    children = np.random.SeedSequence(seed).spawn(len(names))
    for orbit, child in zip(sorted(names), children, strict=True):
        draw, own = np.random.default_rng(int(child.generate_state(1, dtype=np.uint64)[0])), sorted(names[orbit])
        for t in range(trials):
            rows += [(orbit, t + 1, own[i]) for i in np.sort(draw.choice(len(own), size=sizes[orbit], replace=False))]
    return groups.sparkSession.createDataFrame(rows, "orbit string, trial int, group_id string")


#: Groups of an orbit that one task ranks for a trial; beyond, by ranges of marks.
RANKED_GROUPS = 1_000_000


def _smallest(marked: DataFrame, k: Column, most: int) -> DataFrame:
    """The ``k`` rows of smallest (_mark, group_id) for each orbit and trial.

    An orbit of many groups is counted by the first three digits of the mark:
    ranges wholly below the bound are taken as they are, and only the one range
    that the bound cuts is ranked.
    """
    at = ["orbit", "trial"]
    order = F.row_number().over(W.Window.partitionBy(*at).orderBy("_mark", "group_id"))
    if most <= RANKED_GROUPS:
        return marked.withColumn("_r", order).where(F.col("_r") <= k)
    ranged = marked.withColumn("_range", F.substring("_mark", 1, 3))
    n = ranged.groupBy(*at, "_range").count()
    below = F.sum("count").over(W.Window.partitionBy(*at).orderBy("_range"))
    bounds = n.select(*at, "_range", (below - F.col("count")).alias("_before"), below.alias("_below")).where(F.col("_before") < k)
    kept = ranged.join(bounds, [*at, "_range"])
    inner = kept.where(F.col("_below") > k).withColumn("_r", F.col("_before") + order).where(F.col("_r") <= k).drop("_r")
    return kept.where(F.col("_below") <= k).unionByName(inner)


MODEL = f"orbit string, split int, n_fitting_observations long, n_heldout_observations long, {FIT}"


def fit_holdout(group_factors: DataFrame, assignments: DataFrame, trials: int, max_condition: float = MAX_CONDITION) -> DataFrame:
    """Models of trials 1..``trials`` and of split 0, which holds nothing out.

    ``assignments`` is ``orbit, trial, group_id``. Each batch of group factors
    reduces to one factor for each trial before the shuffle.
    """
    held = assignments.groupBy("orbit", "group_id").agg(F.collect_list("trial").alias("held"))
    joined = group_factors.join(held, ["orbit", "group_id"], "left").select("orbit", "n", "factor", "held")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orbits = np.array(batch.column(0).to_pylist(), object)
            if not len(orbits):
                continue
            n = batch.column(1).to_numpy()
            stack = np.array(batch.column(2).to_pylist(), float).reshape(-1, WIDTH, WIDTH)
            out = np.zeros((len(orbits), trials + 1), bool)
            for i, h in enumerate(batch.column(3).to_pylist()):
                out[i, h or []] = True
            rows = []
            for o in sorted(set(orbits)):
                mine = orbits == o
                for t in range(trials + 1):
                    keep = mine & ~out[:, t]
                    rows.append((o, t, int(n[keep].sum()), int(n[mine & out[:, t]].sum()), reduce_rows(stack[keep].reshape(-1, WIDTH)).ravel().tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _PARTIAL_KINDS, strict=True)], list(_PARTIAL_NAMES))

    made = joined.mapInArrow(partial, "orbit string, split int, n_fit long, n_held long, factor array<double>")

    def finish(key, table):
        stack = np.array(table.column("factor").to_pylist(), float).reshape(-1, WIDTH)
        n_fit, n_held = (sum(table.column(c).to_pylist()) for c in ("n_fit", "n_held"))
        orbit, split = key[0].as_py(), key[1].as_py()
        return _model(orbit, split, n_fit, n_held, solve(reduce_rows(stack), n_fit, max_condition, f"orbit {orbit}, trial {split}"))

    return made.groupBy("orbit", "split").applyInArrow(finish, MODEL)


_PARTIAL_NAMES = ("orbit", "split", "n_fit", "n_held", "factor")
_PARTIAL_KINDS = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()))


def _model(orbit, split, n_fit, n_held, fit) -> pa.Table:
    c, rank, condition = fit
    return pa.table({"orbit": pa.array([orbit], pa.string()), "split": pa.array([split], pa.int32()), "n_fitting_observations": pa.array([n_fit], pa.int64()), "n_heldout_observations": pa.array([n_held], pa.int64()), "coefficients": pa.array([c.tolist()], pa.list_(pa.float64())), "rank": pa.array([rank], pa.int32()), "condition_number": pa.array([condition], pa.float64())})


def _all_but_one(stack: np.ndarray) -> Iterator[np.ndarray]:
    """The factor of all others, for each of the factors of a stack, from the
    factors of what lies before and behind."""
    behind = [np.zeros((WIDTH, WIDTH))]
    for f in stack[:0:-1]:
        behind.append(reduce_rows(np.vstack([behind[-1], f])))
    before = np.zeros((WIDTH, WIDTH))
    for i, f in enumerate(stack):
        yield reduce_rows(np.vstack([before, behind[len(stack) - 1 - i]]))
        before = reduce_rows(np.vstack([before, f]))


def fit_leave_one_out(group_factors: DataFrame, folds: DataFrame, max_condition: float = MAX_CONDITION) -> DataFrame:
    """One model for each group, fitted to all other groups of its orbit.

    Groups are dealt to about sqrt(groups) blocks for each orbit; a fold merges
    the other blocks with the other groups of its block: three merges a fold,
    no task beyond a block, and no subtraction, which would lose precision.
    """
    own = cut(group_factors.join(folds, ["orbit", "group_id"]))
    most = own.groupBy("orbit").count().agg(F.max("count")).first()[0] or 1
    blocks = max(1, math.isqrt(most))
    own = own.withColumn("block", F.pmod(F.xxhash64("group_id"), F.lit(blocks)).cast("int"))

    def merge(key, table):
        stack = np.array(table.column("factor").to_pylist(), float).reshape(-1, WIDTH)
        return pa.table({"orbit": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "factor": pa.array([reduce_rows(stack).ravel().tolist()], pa.list_(pa.float64()))})

    whole = own.select("orbit", "block", "n", "factor").groupBy("orbit", "block").applyInArrow(merge, "orbit string, block int, n long, factor array<double>")

    def others(key, table):
        stack = np.array(table.column("factor").to_pylist(), float).reshape(-1, WIDTH, WIDTH)
        n = table.column("n").to_numpy()
        return pa.table({"orbit": table.column("orbit"), "block": table.column("block"), "n_other": pa.array(n.sum() - n, pa.int64()), "other": pa.array([f.ravel().tolist() for f in _all_but_one(stack)], pa.list_(pa.float64()))})

    rest = whole.groupBy("orbit").applyInArrow(others, "orbit string, block int, n_other long, other array<double>")

    def fit(key, left, right):
        if not left.num_rows:
            return _model_schema_table()
        other = np.array(right.column("other").to_pylist(), float).reshape(WIDTH, WIDTH)
        n_other = right.column("n_other")[0].as_py()
        stack = np.array(left.column("factor").to_pylist(), float).reshape(-1, WIDTH, WIDTH)
        n, fold = left.column("n").to_numpy(), left.column("fold").to_pylist()
        orbit, out = key[0].as_py(), []
        for i, f in enumerate(_all_but_one(stack)):
            n_fit = int(n_other + n.sum() - n[i])
            out.append(_model(orbit, fold[i], n_fit, int(n[i]), solve(reduce_rows(np.vstack([other, f])), n_fit, max_condition, f"orbit {orbit}, fold {fold[i]}")))
        return pa.concat_tables(out)

    return own.select("orbit", "block", "n", "factor", "fold").groupBy("orbit", "block").cogroup(rest.groupBy("orbit", "block")).applyInArrow(fit, MODEL)


def _model_schema_table() -> pa.Table:
    return _model("", 0, 0, 0, (np.zeros(6), 0, 0.0)).slice(0, 0)


def group_factors(observations: DataFrame) -> DataFrame:
    own = observations.select(F.col("orbit").cast("string").alias("orbit"), F.col("group_id").cast("string").alias("group_id"), X, Y, Z)
    return cut(factors(own, ["orbit", "group_id"], X, Y, Z))


def leave_one_out(observations: DataFrame, folds: DataFrame, models: DataFrame, total: int | None = None) -> DataFrame:
    """Every row with the correction that the other groups predict for it:
    all columns, predicted_correction_mm_per_year, residual_mm_per_year. Large
    groups get their model by broadcast; ``total`` is the number of rows if known."""
    keyed = models.select("orbit", F.col("split").alias("fold"), "coefficients").join(folds, ["orbit", "fold"]).select(F.struct("orbit", "group_id").alias("_group"), "coefficients")
    rows = lookup(observations.withColumn("_group", F.struct("orbit", "group_id")), "_group", keyed, "inner", total).drop("_group")
    predicted = predict_quadratic("coefficients", X, Y)
    return rows.withColumn("predicted_correction_mm_per_year", predicted).withColumn("residual_mm_per_year", F.col(Z) - F.col("predicted_correction_mm_per_year")).drop("coefficients")


#: Rows of an orbit up to which one task holds the residuals of a split.
GROUP_ROWS = 2_000_000


def residual_metrics(r: np.ndarray, tolerance: float) -> list:
    """The residual metrics (RESIDUAL_METRICS) of finite residuals."""
    if not len(r):
        return [0, None, None, None, None, None, None, None, tolerance, None, None]
    mean, mid = float(r.mean()), float(np.median(r))
    rms, centred = math.sqrt(float(np.mean(r * r))), math.sqrt(float(np.mean((r - mean) ** 2)))
    nmad = NMAD_SCALE * float(np.median(np.abs(r - mid)))
    return [len(r), mean, rms, centred, float(np.abs(r).mean()), mid, nmad, float(np.mean(np.abs(r) <= tolerance)), tolerance, float(r.min()), float(r.max())]


#: Tasks among which the splits of an orbit are dealt.
SPLIT_TASKS = 8
_PACKED = np.dtype([("x", float), ("y", float), ("z", float), ("group", np.int64)])


def _packed_split_metrics(observations: DataFrame, models: DataFrame, assignments: DataFrame, tolerance: float, scopes: tuple[str, ...]) -> DataFrame:
    names = [f"{s}_{m}" for s in scopes for m in RESIDUAL_METRICS]
    kinds = ", ".join(f"{n} {'long' if n.endswith('_n') else 'double'}" for n in names)
    code = F.xxhash64("group_id").alias("group")
    rows = observations.select("orbit", X, Y, Z, code)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orbits = np.array(batch.column(0).to_pylist(), object)
            block = np.empty(len(orbits), _PACKED)
            for k, name in enumerate(_PACKED.names):
                block[name] = batch.column(k + 1).to_numpy(zero_copy_only=False)
            each = sorted(set(orbits))
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.string()), pa.array([block[orbits == o].tobytes() for o in each], pa.binary())], ["orbit", "data"])

    tasks = F.sequence(F.lit(0), F.lit(SPLIT_TASKS - 1))
    left = rows.mapInArrow(pack, "orbit string, data binary").select("orbit", F.explode(tasks).alias("task"), "data")
    held = assignments.select("orbit", "split", code).groupBy("orbit", "split").agg(F.collect_list("group").alias("held"))
    task = F.pmod(F.col("split"), F.lit(SPLIT_TASKS)).alias("task")
    right = models.select("orbit", "split", "coefficients", task).join(held, ["orbit", "split"], "left").select("orbit", "task", "split", "coefficients", "held")

    def summarise(key, data, splits):
        own = np.frombuffer(b"".join(data.column("data").to_pylist()), _PACKED)
        known, group = np.unique(own["group"], return_inverse=True)
        terms, z = design(own["x"], own["y"]), own["z"]
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(len(known) + 1))
        out = np.zeros(len(own), bool)
        found = []
        for coefficients, own_held in zip(splits.column("coefficients").to_pylist(), splits.column("held").to_pylist(), strict=True):
            at = np.searchsorted(known, np.array(own_held or [], np.int64))
            gone = np.concatenate([order[ends[g] : ends[g + 1]] for g in at]) if len(at) else np.zeros(0, int)
            out[gone] = True
            r = z - terms @ np.array(coefficients)
            part = {"all": lambda: r, "fitting": lambda: r[~out], "holdout": lambda: r[gone]}
            found.append([v for s in scopes for v in residual_metrics(part[s](), tolerance)])
            out[gone] = False
        cols = [pa.array(c, pa.int64() if n.endswith("_n") else pa.float64()) for n, c in zip(names, zip(*found, strict=True) if found else [[]] * len(names), strict=True)]
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.string()), splits.column("split").cast(pa.int32()), *cols], names=["orbit", "split", *names])

    grouped = left.groupBy("orbit", "task").cogroup(right.groupBy("orbit", "task"))
    return grouped.applyInArrow(summarise, f"orbit string, split int, {kinds}")


def split_metrics(observations: DataFrame, models: DataFrame, assignments: DataFrame, tolerance: float = 2.0, scopes: tuple[str, ...] = ("all", "fitting", "holdout")) -> DataFrame:
    """``orbit, split`` with the residual metrics of each scope, prefixed by it.

    ``assignments`` is ``orbit, split, group_id``. Every split judges every row
    of its orbit, so the work is rows times splits, but not the rows moved: for
    orbits of at most GROUP_ROWS rows, packed rows go to SPLIT_TASKS tasks, each
    of which judges its part of the splits. Beyond, residuals are aggregated by
    Spark, with the same result; the models are broadcast up to BROADCAST_MODELS,
    beyond which rows are salted and models repeated.
    """
    most = observations.groupBy("orbit").count().agg(F.max("count")).first()[0] or 0
    if most <= GROUP_ROWS:
        return _packed_split_metrics(observations, models, assignments, tolerance, scopes)
    held = assignments.groupBy(F.struct("orbit", "group_id").alias("_group")).agg(F.collect_list("split").alias("held"))
    rows = lookup(observations.select("orbit", F.struct("orbit", "group_id").alias("_group"), X, Y, Z), "_group", held, "left")
    few = models.select("orbit", "split", "coefficients")
    if few.count() <= BROADCAST_MODELS:
        joined = rows.join(F.broadcast(few), "orbit")
    else:
        salts = 256
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_group", X, Y, Z), F.lit(salts)))
        joined = salted.join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["orbit", "_salt"])
    out_of_fit = F.coalesce(F.array_contains("held", F.col("split")), F.lit(False))
    wanted = [F.when(out_of_fit, F.lit("holdout")).otherwise(F.lit("fitting"))]
    if "all" in scopes:
        wanted.append(F.lit("all"))
    each = joined.select("orbit", "split", (F.col(Z) - predict_quadratic("coefficients", X, Y)).alias("residual"), F.explode(F.array(*wanted)).alias("scope"))
    long = summarize_residuals(each.where(F.col("scope").isin(*scopes)), "residual", ["orbit", "split", "scope"], tolerance)
    cells = [F.max(F.when(F.col("scope") == s, F.col(m))).alias(f"{s}_{m}") for s in scopes for m in RESIDUAL_METRICS]
    return long.groupBy("orbit", "split").agg(*cells)


def held_text(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("orbit", "split").agg(F.array_join(F.sort_array(F.collect_list("group_id")), ";").alias("heldout_groups"))


class CrossValidation:
    """The seven tables of a cross-validation, each computed when asked for.

    Rows must have passed :func:`gate`. A fold or trial that cannot be fitted
    stops the job with a FitError that names it. Factors, groups, assignments
    and models are computed once and shared by the tables.
    """

    TABLES = ("full_fit_metrics", "loocv_station_values", "loocv_metrics", "loocv_folds", "cv_trials", "cv_assignments", "cv_distribution")
    FACTS = ("n_fitting_observations", "n_heldout_observations", "condition_number")

    def __init__(self, observations: DataFrame, trials: int = 100, fraction: float = 0.2, seed: int = 0, max_condition: float = MAX_CONDITION, tolerance: float = 2.0, rng: str = "hash") -> None:
        self.rows = observations.withColumns({"orbit": F.col("orbit").cast("string"), "group_id": F.col("group_id").cast("string"), **{c: F.col(c).cast("double") for c in (X, Y, Z)}})
        self.trials, self.fraction, self.seed, self.rng = trials, fraction, seed, rng
        self.max_condition, self.tolerance = max_condition, tolerance

    @cached_property
    def factors(self) -> DataFrame:
        return group_factors(self.rows)

    @cached_property
    def n(self) -> int:
        return self.factors.agg(F.sum("n")).first()[0] or 0

    @cached_property
    def folds(self) -> DataFrame:
        return cut(group_list(self.factors))

    @cached_property
    def assigned(self) -> DataFrame:
        return cut(holdout_assignments(self.folds.drop("fold"), self.trials, self.fraction, self.seed, self.rng))

    @cached_property
    def fold_models(self) -> DataFrame:
        return cut(fit_leave_one_out(self.factors, self.folds, self.max_condition))

    def _with_groups(self, metrics: DataFrame) -> DataFrame:
        return metrics.join(self.folds.groupBy("orbit").agg(F.count(F.lit(1)).alias("n_groups")), "orbit")

    def full_fit_metrics(self) -> DataFrame:
        # No trial is drawn or fitted for this.
        none = self.folds.limit(0).select("orbit", F.lit(0).alias("trial"), "group_id")
        full = cut(fit_holdout(self.factors, none, 0, self.max_condition)).select("orbit", "coefficients", "condition_number")
        rows = self.rows.join(F.broadcast(full), "orbit").withColumn("_r", F.col(Z) - predict_quadratic("coefficients", X, Y))
        found = self._with_groups(summarize_residuals(rows, "_r", ["orbit"], self.tolerance)).join(full.drop("coefficients"), "orbit")
        return found.select("orbit", "n_groups", "condition_number", *RESIDUAL_METRICS)

    def loocv_station_values(self) -> DataFrame:
        return leave_one_out(self.rows, self.folds, self.fold_models, self.n)

    def loocv_metrics(self) -> DataFrame:
        found = summarize_residuals(self.loocv_station_values(), "residual_mm_per_year", ["orbit"], self.tolerance)
        return self._with_groups(found).select("orbit", "n_groups", *RESIDUAL_METRICS)

    def _splits(self, models: DataFrame, sets: DataFrame, scopes: tuple[str, ...]) -> DataFrame:
        facts = models.select("orbit", "split", *self.FACTS).join(held_text(sets), ["orbit", "split"])
        return facts.join(split_metrics(self.rows, models, sets, self.tolerance, scopes), ["orbit", "split"])

    def loocv_fold_residuals(self) -> DataFrame:
        """What a fold costs no more than its own rows for: its facts and the
        metrics of its held-out rows."""
        kept = self.loocv_station_values().select("orbit", "group_id", "residual_mm_per_year")
        held = summarize_residuals(kept, "residual_mm_per_year", ["orbit", "group_id"], self.tolerance)
        facts = self.fold_models.select("orbit", F.col("split").alias("fold"), *self.FACTS).join(self.folds, ["orbit", "fold"])
        return facts.join(held, ["orbit", "group_id"]).select("orbit", "fold", F.col("group_id").alias("heldout_groups"), *self.FACTS, *[F.col(m).alias(f"heldout_{m}") for m in RESIDUAL_METRICS])

    def loocv_folds(self) -> DataFrame:
        found = self._splits(self.fold_models, self.folds.select("orbit", F.col("fold").alias("split"), "group_id"), ("fitting", "holdout"))
        found = found.withColumnsRenamed({f"holdout_{m}": f"heldout_{m}" for m in RESIDUAL_METRICS} | {"split": "fold"})
        return found.select("orbit", "fold", "heldout_groups", *self.FACTS, *[f"{s}_{m}" for s in ("fitting", "heldout") for m in RESIDUAL_METRICS])

    @cached_property
    def _keyed(self) -> DataFrame:
        return cut(self.rows.select("orbit", "group_id", X, Y, Z))

    @cached_property
    def _groups(self) -> DataFrame:
        return cut(self._keyed.groupBy("orbit", "group_id").agg(F.count(F.lit(1)).alias("n")))

    @cached_property
    def _bits(self) -> DataFrame:
        if self.trials < 1:
            raise ValueError("trials must be at least one")
        if self.rng == "hash":
            return cut(drawn_bits(self._groups, self.trials, self.fraction, self.seed))
        return cut(listed_bits(self._groups, holdout_assignments(self._groups, self.trials, self.fraction, self.seed, self.rng), self.trials))

    @cached_property
    def _marked(self) -> DataFrame:
        return marked_rows(self._keyed, self._groups, self._bits, X, Y, Z)

    @cached_property
    def _trial_metrics(self) -> DataFrame:
        return trial_metrics(self._marked, self.trials, self.max_condition, self.tolerance)

    def cv_trials(self) -> DataFrame:
        found = self._trial_metrics.join(held_names(self._bits, self.trials), ["orbit", "split"])
        rows = found.withColumnRenamed("split", "trial").withColumn("group", F.col("orbit"))
        return rows.select("trial", "orbit", "group", "heldout_groups", *self.FACTS, *[f"{s}_{m}" for s in ("all", "fitting", "holdout") for m in RESIDUAL_METRICS])

    def cv_assignments(self) -> DataFrame:
        return self.assigned.select("trial", "orbit", "group_id")

    def cv_distribution(self) -> DataFrame:
        known = "_trial_metrics" in self.__dict__
        return rms_distribution(self._trial_metrics if known else trial_rms(self._marked, self.trials, self.max_condition, self.tolerance))

    def table(self, name: str) -> DataFrame:
        if name not in self.TABLES:
            raise ValueError(f"no table {name!r}")
        return getattr(self, name)()
