import numpy as np
import pytest

from plumbline.operators import crossval as C
from plumbline.operators import quadratic as Q
from plumbline.operators.metrics import RESIDUAL_METRICS

SCHEMA = "orbit string, station_id string, group_id string, normalized_pixel_x double, normalized_pixel_y double, residual_before_fit_mm_per_year double"
BETA = np.array([1.2, -0.7, 0.3, 0.8, -0.4, 0.6])


def rows(n=6, noise=0.0, orbit="ascending", groups=None, seed=0):
    rng, at, out = np.random.default_rng(seed), np.linspace(-0.9, 0.9, n), []
    for i, (x, y) in enumerate((a, b) for a in at for b in at):
        z = float(Q.design(np.array([x]), np.array([y]))[0] @ BETA + noise * rng.normal())
        out.append((orbit, f"S{i:03d}", f"G{i % groups if groups else i:03d}", float(x), float(y), z))
    return [*out, (orbit, "S999", "G000", *out[0][3:])]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def fit(data):
    x, y, z = (np.array([r[i] for r in data]) for i in (3, 4, 5))
    beta, _, _, s = np.linalg.lstsq(Q.design(x, y), z, rcond=None)
    return beta, s[0] / s[-1]


def left_over(data, beta):
    x, y, z = (np.array([r[i] for r in data]) for i in (3, 4, 5))
    return z - Q.design(x, y) @ beta


def test_exact_surface(spark):
    data = rows()
    cv = C.CrossValidation(C.gate(frame(spark, data)), 6, 0.2, 314159)
    folds = {r["heldout_groups"]: r for r in cv.loocv_folds().collect()}
    assert len(folds) == 36 and (folds["G000"]["n_heldout_observations"], folds["G000"]["n_fitting_observations"]) == (2, 35)
    assert cv.cv_assignments().count() == 6 * 7
    pooled = cv.loocv_metrics().first()
    assert pooled["n"] == 37 and pooled["n_groups"] == 36 and pooled["rms_mm_per_year"] < 1e-10
    assert cv.full_fit_metrics().first()["rms_mm_per_year"] < 1e-10


def test_every_table_against_numpy(spark):
    data = rows(noise=0.5, groups=9) + rows(5, 0.7, "descending", 7, 3)
    cv = C.CrossValidation(frame(spark, data), 5, 0.3, 11)
    held = {}
    for r in cv.cv_assignments().collect():
        held.setdefault((r["orbit"], r["trial"]), set()).add(r["group_id"])
    trials = {(r["orbit"], r["trial"]): r for r in cv.cv_trials().collect()}
    assert set(trials) == set(held) and len(trials) == 10
    for (orbit, trial), groups in held.items():
        own = [r for r in data if r[0] == orbit]
        beta, condition = fit([r for r in own if r[2] not in groups])
        t = trials[orbit, trial]
        assert t["condition_number"] == pytest.approx(condition, rel=1e-9) and t["heldout_groups"] == ";".join(sorted(groups))
        for scope, part in (("all", own), ("fitting", [r for r in own if r[2] not in groups]), ("holdout", [r for r in own if r[2] in groups])):
            want = C.residual_metrics(left_over(part, beta), 2.0)
            assert [t[f"{scope}_{m}"] for m in RESIDUAL_METRICS] == pytest.approx(want, rel=1e-7, abs=1e-9)
    for r in cv.loocv_station_values().collect():
        beta, _ = fit([d for d in data if d[0] == r["orbit"] and d[2] != r["group_id"]])
        mine = [d for d in data if d[0] == r["orbit"] and d[1] == r["station_id"]]
        assert r["residual_mm_per_year"] == pytest.approx(left_over(mine, beta)[0], abs=1e-9)
    assert cv.loocv_station_values().count() == len(data)
    assert {(r["orbit"], r["scope"]): r["trials"] for r in cv.cv_distribution().collect()} == {(o, s): 5 for o in ("ascending", "descending") for s in ("all", "fitting", "holdout")}


def test_distributed_metrics_equal_grouped(spark, monkeypatch):
    data = rows(noise=0.5, groups=9)
    found = []
    for limit, models in ((10**6, 10**6), (0, 10**6), (0, 0)):
        monkeypatch.setattr(C, "GROUP_ROWS", limit)
        monkeypatch.setattr(C, "BROADCAST_MODELS", models)
        found.append(sorted(map(tuple, C.CrossValidation(frame(spark, data), 3, 0.3, 1).cv_trials().collect())))
    for other in found[1:]:
        for a, b in zip(found[0], other, strict=True):
            assert list(a[:4]) == list(b[:4]) and list(a[4:]) == pytest.approx(list(b[4:]))


def test_generators(spark):
    g = C.group_list(frame(spark, rows() + rows(orbit="b")))
    for rng in ("hash", "numpy"):
        take = lambda seed: sorted(map(tuple, C.holdout_assignments(g.drop("fold"), 4, 0.2, seed, rng).select("orbit", "trial", "group_id").collect()))  # noqa: B023, E731
        assert take(17) == take(17) != take(18) and len(set(take(17))) == 2 * 4 * 7
    names = sorted({r[2] for r in rows()})
    child = np.random.SeedSequence(17).spawn(2)[0]
    draw = np.random.default_rng(int(child.generate_state(1, dtype=np.uint64)[0]))
    want = [("ascending", t + 1, names[i]) for t in range(4) for i in draw.choice(36, size=7, replace=False)]
    assert [r for r in sorted(map(tuple, C.holdout_assignments(g.drop("fold"), 4, 0.2, 17, "numpy").select("orbit", "trial", "group_id").collect())) if r[0] == "ascending"] == sorted(want)
    assert C.holdout_size(25, 0.1) == 2 and C.holdout_size(35, 0.1) == 4 and C.holdout_size(3, 0.01) == 1
    for bad in ((2, 0.9), (10, 0), (10, 1)):
        with pytest.raises(ValueError):
            C.holdout_size(*bad)


def test_gate(spark):
    good = rows()
    for bad in ((None, "S", "G1", 0.1, 0.1, 1.0), ("ascending", "S", None, 0.1, 0.1, 1.0), ("ascending", "S", "G1", 0.1, float("nan"), 1.0), ("lonely", "S", "G1", 0.1, 0.1, 1.0)):
        with pytest.raises(ValueError):
            C.gate(frame(spark, [*good, bad]))
    with pytest.raises(ValueError):
        C.gate(frame(spark, good).limit(0))
    with pytest.raises(ValueError):
        C.gate(frame(spark, good).drop("group_id"))


def test_fit_guards(spark):
    def fails(data, **more):
        with pytest.raises(Exception, match="rank|condition|rows"):
            Q.fit_quadratic(frame(spark, data), "normalized_pixel_x", "normalized_pixel_y", "residual_before_fit_mm_per_year", ["orbit"], **more).collect()

    fails([(*r[:3], 0.0, *r[4:]) for r in rows()])
    fails(rows(), max_condition=1.01)
    fails(rows()[:5])
    row = Q.fit_quadratic(frame(spark, rows()), "normalized_pixel_x", "normalized_pixel_y", "residual_before_fit_mm_per_year", ["orbit"]).first()
    assert row["coefficients"] == pytest.approx(BETA) and row["rank"] == 6 and row["condition_number"] == pytest.approx(fit(rows())[1])


def test_condition_of_a_bad_design():
    data = [(*r[:3], 1.0 + r[3] * 1e-4, r[4], r[5]) for r in rows(20)]
    x, y, z = (np.array([r[i] for r in data]) for i in (3, 4, 5))
    parts = np.array_split(np.column_stack([Q.design(x, y), z]), 7)
    f = Q.reduce_rows(np.vstack([Q.reduce_rows(p) for p in parts]))
    _, rank, condition = Q.solve(f, len(data), 1e12)
    assert rank == 6 and condition == pytest.approx(fit(data)[1], rel=1e-4) and condition > 1e8


def test_delivered_observations_are_cross_validated(spark, tmp_path):
    """Dirty keys, skewed groups, missing ids and NaN: every trial and fold, as without them."""
    from plumbline import queries

    data = rows(noise=0.5, groups=9) + [("ascending", f"X{i}", "G001", 0.01 * i - 0.4, 0.3 - 0.02 * i, 0.1 * (i % 7)) for i in range(40)]
    names = ["orbit", "station_id", "group_id", "normalized_pixel_x", "normalized_pixel_y", "residual_before_fit_mm_per_year"]
    dirty = [(f" {o.upper()} ", s, f" {g.lower()}-", *v) for o, s, g, *v in data]
    bad = [("ascending", "S", None, 0.1, 0.1, 1.0), ("ascending", "S", " n/a ", 0.1, 0.1, 1.0), (None, "S", "G001", 0.1, 0.1, 1.0), ("ascending", "S", "G001", 0.1, 0.1, float("nan")), ("ascending", "S", "G001", 0.1, 0.1, None)]
    kinds = "orbit string, station_id string, group_id string, " + ", ".join(f"{n} double" for n in names[3:])
    spark.createDataFrame(dirty + bad, kinds).write.parquet(f"{tmp_path}/observations.parquet")
    cv = C.CrossValidation(frame(spark, data), 100, 0.2, 314159)
    got = lambda name: sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()))
    folds = got("observation_folds")
    assert len(got("observation_assignments")) == 100 * 2 and len(folds) == 9
    for found, want in ((got("observation_trials"), cv.cv_trials()), (folds, cv.loocv_folds()), (got("observation_distribution"), cv.cv_distribution()), (got("observation_full_fit"), cv.full_fit_metrics())):
        want = sorted(map(tuple, want.collect()))
        assert len(found) == len(want) > 0
        for a, b in zip(found, want, strict=True):
            assert all(x == y if isinstance(x, str) or x is None else x == pytest.approx(y, rel=1e-5, abs=1e-5) for x, y in zip(a, b, strict=True))
    at = len(C.CrossValidation.FACTS) + 3
    assert [r[at:] for r in got("observation_fold_residuals")] == [r[at + len(RESIDUAL_METRICS) :] for r in folds]


def test_holdout_of_many_groups_is_the_same(spark, monkeypatch):
    groups = spark.createDataFrame([("a", f"G{i:04d}") for i in range(700)] + [("d", f"G{i}") for i in range(31)], "orbit string, group_id string")
    draw = lambda: sorted(map(tuple, C.holdout_assignments(groups, 7, 0.3, 11).collect()))
    one = draw()
    monkeypatch.setattr(C, "RANKED_GROUPS", 10)
    assert draw() == one and len(one) == 7 * (210 + 9)
