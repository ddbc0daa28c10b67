"""Cross-validation in SQL: normal equations by elimination, for comparison.

Moments of every group are summed, those of a split follow by subtraction, and
the six equations are eliminated without pivots, which holds for the well
conditioned tables that are compared. The condition number comes from the
largest and the smallest eigenvalue of the moments, each found by squaring the
matrix: the trace of a high power is that of its largest eigenvalue.
"""

from __future__ import annotations

from .operators.metrics import NMAD_SCALE, RESIDUAL_METRICS

N = 6
_AT = {2: "CAST(1 AS DOUBLE)", 0: "x", 1: "y", 3: "x * y", 4: "x * x", 5: "y * y", 6: "z"}
_PAIRS = [(i, j) for i in range(N) for j in range(i, N + 1)]
#: Squarings of a matrix: its 2^SQUARINGS-th power.
SQUARINGS = 44


def _m(i: int, j: int, prefix: str = "") -> str:
    return f"{prefix}m_{min(i, j)}_{max(i, j)}"


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + CAST(0 AS DOUBLE) AS {name}"


def metric_list(tolerance: float, prefix: str = "", where: str = "") -> str:
    """The residual metrics of column r with median m, over rows that meet ``where``."""
    f = f" FILTER ({where})" if where else ""
    m = f"m_{prefix.rstrip('_')}" if prefix else "m"
    found = {
        "n": f"count(r){f}", "bias_mm_per_year": f"avg(r){f}", "rms_mm_per_year": f"sqrt(avg(r * r){f})", "centered_rms_mm_per_year": f"stddev_pop(r){f}", "mae_mm_per_year": f"avg(abs(r)){f}",
        "median_residual_mm_per_year": f"median(r){f}", "nmad_mm_per_year": f"{NMAD_SCALE} * median(abs(r - {m})){f}", "fraction_within_tolerance": f"avg(CAST(abs(r) <= {tolerance} AS INTEGER)){f}",
        "tolerance_mm_per_year": f"CAST({tolerance} AS DOUBLE)", "minimum_residual_mm_per_year": f"min(r){f}", "maximum_residual_mm_per_year": f"max(r){f}",
    }
    return ", ".join(f"{found[k]} AS {prefix}{k}" if k == "n" else r6(found[k], prefix + k) for k in RESIDUAL_METRICS)


def moments(observations: str) -> str:
    """CTEs ``o`` (orbit, group_id, x, y, z and more), ``g`` and ``tot`` from a
    statement that gives them."""
    sums = ", ".join(f"sum(({_AT[i]}) * ({_AT[j]})) AS {_m(i, j)}" for i, j in _PAIRS)
    again = ", ".join(f"sum({_m(i, j)}) AS {_m(i, j)}" for i, j in _PAIRS)
    return f"""o AS MATERIALIZED ({observations}),
g AS MATERIALIZED (SELECT orbit, group_id, count(*) AS n, {sums}, CAST(row_number() OVER (PARTITION BY orbit ORDER BY group_id) AS INTEGER) AS fold FROM o GROUP BY orbit, group_id),
tot AS MATERIALIZED (SELECT orbit, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_groups, {again} FROM g GROUP BY orbit)"""


def full() -> str:
    return f"s AS (SELECT orbit, 0 AS split, n AS n_fit, 0 AS n_held, {', '.join(_m(i, j) for i, j in _PAIRS)} FROM tot)"


def leave_one_out() -> str:
    less = ", ".join(f"tot.{_m(i, j)} - g.{_m(i, j)} AS {_m(i, j)}" for i, j in _PAIRS)
    return f"s AS (SELECT orbit, g.fold AS split, tot.n - g.n AS n_fit, g.n AS n_held, {less} FROM g JOIN tot USING (orbit))"


def holdout() -> str:
    """From CTE ``held`` (orbit, trial, group_id)."""
    sums = ", ".join(f"sum({_m(i, j)}) AS {_m(i, j)}" for i, j in _PAIRS)
    less = ", ".join(f"tot.{_m(i, j)} - h.{_m(i, j)} AS {_m(i, j)}" for i, j in _PAIRS)
    return f"""h AS (SELECT orbit, trial, CAST(sum(n) AS BIGINT) AS n, {sums} FROM held JOIN g USING (orbit, group_id) GROUP BY orbit, trial),
s AS (SELECT orbit, trial AS split, tot.n - h.n AS n_fit, h.n AS n_held, {less} FROM h JOIN tot USING (orbit))"""


def solved() -> str:
    """CTEs up to ``fit`` (orbit, split, n_fit, n_held, c0..c5, condition) from ``s``."""
    steps = [f"e0 AS MATERIALIZED (SELECT *, {', '.join(f'{_m(i, j)} AS a_{i}_{j}' for i in range(N) for j in range(N + 1))} FROM s)"]
    for k in range(N - 1):
        changed = {f"a_{i}_{j}": f"a_{i}_{j} - a_{i}_{k} / a_{k}_{k} * a_{k}_{j}" for i in range(k + 1, N) for j in range(k, N + 1)}
        steps.append(f"e{k + 1} AS MATERIALIZED (SELECT * REPLACE ({', '.join(f'{v} AS {n}' for n, v in changed.items())}) FROM e{k})")
    back, source = [], f"e{N - 1}"
    for i in reversed(range(N)):
        known = "".join(f" - a_{i}_{j} * c{j}" for j in range(i + 1, N))
        back.append(f"b{i} AS MATERIALIZED (SELECT *, (a_{i}_6{known}) / a_{i}_{i} AS c{i} FROM {source})")
        source = f"b{i}"
    return ",\n".join([*steps, *back, _eigen("hi", "s", lambda i, j: _m(i, j)), _eigen("lo", "s JOIN hi_value USING (orbit, split)", lambda i, j: f"{'hi - ' if i == j else '-'}{_m(i, j)}")]) + """,
fit AS MATERIALIZED (SELECT b0.*, sqrt(hi / (hi - lo)) AS condition FROM b0 JOIN hi_value USING (orbit, split) JOIN lo_value USING (orbit, split))"""


def _eigen(name: str, source: str, entry) -> str:
    """The largest eigenvalue of a matrix by repeated squaring and scaling."""
    upper = [(i, j) for i in range(N) for j in range(i, N)]
    v = lambda i, j: f"v_{min(i, j)}_{max(i, j)}"
    trace = " + ".join(v(i, i) for i in range(N))
    first = ", ".join(f"{entry(i, j)} AS {v(i, j)}" for i, j in upper)
    scaled = ", ".join(f"{v(i, j)} / t AS {v(i, j)}" for i, j in upper)
    square = ", ".join(f"{' + '.join(f'{v(i, k)} * {v(k, j)}' for k in range(N))} AS {v(i, j)}" for i, j in upper)
    return f"""{name}_first AS (SELECT orbit, split, {first} FROM {source}),
{name}_power AS (
  SELECT orbit, split, 0 AS k, ln(t) AS logs, {scaled} FROM (SELECT *, {trace} AS t FROM {name}_first)
  UNION ALL
  SELECT orbit, split, k + 1, logs + ln(t) / pow(2, k + 1), {scaled} FROM (SELECT *, {trace} AS t FROM (SELECT orbit, split, k, logs, {square} FROM {name}_power WHERE k < {SQUARINGS}))),
{name}_value AS (SELECT orbit, split, exp(logs) AS {name} FROM {name}_power WHERE k = {SQUARINGS})"""


PREDICTED = "c0 * x + c1 * y + c2 + c3 * x * y + c4 * x * x + c5 * y * y"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes)


def full_fit(observations: str, tolerance: float) -> str:
    return f"""{with_(moments(observations), full(), solved())},
e AS (SELECT orbit, z - ({PREDICTED}) AS r FROM o JOIN fit USING (orbit)), w AS (SELECT *, median(r) OVER (PARTITION BY orbit) AS m FROM e)
SELECT orbit, any_value(n_groups) AS n_groups, {r6('any_value(condition)', 'condition_number')}, {metric_list(tolerance)} FROM w JOIN tot USING (orbit) JOIN fit USING (orbit) GROUP BY orbit"""


def _loo(observations: str) -> str:
    return f"""{with_(moments(observations), leave_one_out(), solved())},
e AS (SELECT o.*, {PREDICTED} AS p, z - ({PREDICTED}) AS r FROM o JOIN g USING (orbit, group_id) JOIN fit ON fit.orbit = o.orbit AND fit.split = g.fold)"""


def loo_values(observations: str, columns: str) -> str:
    """``columns`` are those of the observations to give beside the two added."""
    return f"{_loo(observations)} SELECT {columns}, {r6('p', 'predicted_correction_mm_per_year')}, {r6('r', 'residual_mm_per_year')} FROM e"


def loo_metrics(observations: str, tolerance: float, groups: bool = True) -> str:
    count = "any_value(n_groups) AS n_groups, " if groups else ""
    return f"""{_loo(observations)}, w AS (SELECT *, median(r) OVER (PARTITION BY orbit) AS m FROM e)
SELECT orbit, {count}{metric_list(tolerance)} FROM w JOIN tot USING (orbit) GROUP BY orbit"""


_FACTS = f"any_value(n_fit) AS n_fitting_observations, any_value(n_held) AS n_heldout_observations, {r6('any_value(condition)', 'condition_number')}"


def loo_held(observations: str, tolerance: float) -> str:
    return f"""{_loo(observations)}, w AS (SELECT *, median(r) OVER (PARTITION BY orbit, group_id) AS m_heldout FROM e)
SELECT w.orbit AS orbit, g.fold AS fold, group_id AS heldout_groups, any_value(fit.n_fit) AS n_fitting_observations, any_value(fit.n_held) AS n_heldout_observations, {r6('any_value(condition)', 'condition_number')}, {metric_list(tolerance, 'heldout_')}
FROM w JOIN g USING (orbit, group_id) JOIN fit ON fit.orbit = w.orbit AND fit.split = g.fold GROUP BY ALL"""


def _splits(tolerance: float, scopes: dict[str, str]) -> str:
    """Per orbit and split, the metrics of scopes (name: condition on ``out``)."""
    medians = ", ".join(f"median(r) FILTER ({c}) OVER (PARTITION BY orbit, split) AS m_{s}" for s, c in scopes.items())
    return f"""w AS (SELECT *, {medians} FROM e),
x AS (SELECT orbit, split, {_FACTS}, {', '.join(metric_list(tolerance, f'{s}_', c) for s, c in scopes.items())} FROM w GROUP BY orbit, split)"""


def loo_folds(observations: str, tolerance: float) -> str:
    return f"""{with_(moments(observations), leave_one_out(), solved())},
e AS (SELECT o.orbit, split, n_fit, n_held, condition, z - ({PREDICTED}) AS r, g.fold = split AS out FROM o JOIN g USING (orbit, group_id) JOIN fit ON fit.orbit = o.orbit),
{_splits(tolerance, {'fitting': 'NOT out', 'heldout': 'out'})}
SELECT x.* EXCLUDE (split), split AS fold, group_id AS heldout_groups FROM x JOIN g ON g.orbit = x.orbit AND g.fold = split"""


def _trials(observations: str, held: str, tolerance: float) -> str:
    """``held`` is a statement over ``g`` that gives orbit, trial, group_id."""
    return f"""{with_(moments(observations), f"held AS MATERIALIZED ({held})", holdout(), solved())},
e AS (SELECT o.orbit, split, n_fit, n_held, condition, z - ({PREDICTED}) AS r, held.group_id IS NOT NULL AS out FROM o JOIN fit ON fit.orbit = o.orbit LEFT JOIN held ON held.orbit = o.orbit AND held.trial = split AND held.group_id = o.group_id),
{_splits(tolerance, {'all': 'true', 'fitting': 'NOT out', 'holdout': 'out'})},
names AS (SELECT orbit, trial, string_agg(group_id, ';' ORDER BY group_id) AS heldout_groups FROM held GROUP BY orbit, trial)"""


def trials(observations: str, held: str, tolerance: float) -> str:
    return f"""{_trials(observations, held, tolerance)}
SELECT x.* EXCLUDE (split), split AS trial, x.orbit AS "group", heldout_groups FROM x JOIN names ON names.orbit = x.orbit AND trial = split"""


def distribution(observations: str, held: str, tolerance: float) -> str:
    rms = ", ".join(f"sqrt(avg(r * r) FILTER ({c})) AS {k}" for k, c in (("\"all\"", "true"), ("fitting", "NOT out"), ("holdout", "out")))
    return f"""{_trials(observations, held, tolerance)},
t AS (SELECT orbit, split, {rms} FROM e GROUP BY orbit, split), u AS (UNPIVOT (SELECT orbit, "all", fitting, holdout FROM t) ON "all", fitting, holdout INTO NAME scope VALUE rms)
SELECT orbit, scope, count(rms) AS trials, {r6('avg(rms)', 'mean_rms')}, {r6('stddev_samp(rms)', 'standard_deviation_of_rms')}, {r6('quantile_cont(rms, 0.025)', 'p2_5_rms')}, {r6('median(rms)', 'median_rms')}, {r6('quantile_cont(rms, 0.975)', 'p97_5_rms')} FROM u GROUP BY orbit, scope"""
