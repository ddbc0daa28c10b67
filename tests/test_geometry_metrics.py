import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.functions.scalar import finite_or_null, is_finite, to_double
from plumbline.operators import figures
from plumbline.operators import metrics as M


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize("e,n,u,i,h,sign,want", [
    (2, 0, 0, 90, 0, "toward_satellite", -2), (2, 0, 0, 90, 0, "away_from_satellite", 2), (0, 3, 0, 90, 90, "toward_satellite", 3),
    (5, 3, 2, 0, 0, "toward_satellite", 2), (8, 4, -1, 0, 180, "toward_satellite", -1),
])
def test_known_looks(spark, e, n, u, i, h, sign, want):
    assert one(spark, geo.enu_to_los(e, n, u, i, h, positive_direction=sign)) == pytest.approx(want, abs=1e-12)


def test_sigma(spark):
    for sign in geo.DIRECTIONS:
        assert one(spark, geo.project_diagonal_sigma(2, 3, 4, 0, 123, positive_direction=sign)) == pytest.approx(4)
    with pytest.raises(Exception, match="sigma must not be negative"):
        one(spark, geo.project_diagonal_sigma(-2, 3, 4, 0, 123))
    assert one(spark, geo.project_full_sigma(2, 3, 4, 0, 0, 0, 35, 10)) == pytest.approx(one(spark, geo.project_diagonal_sigma(2, 3, 4, 35, 10)))


def test_conventions_are_enforced(spark):
    with pytest.raises(ValueError):
        geo.los_unit_vector(1, 2, heading_convention="look_azimuth")
    with pytest.raises(ValueError):
        geo.los_unit_vector(1, 2, positive_direction="up")
    with pytest.raises(Exception, match="incidence"):
        one(spark, geo.enu_to_los(1, 1, 1, 90.1, 0))
    assert one(spark, geo.enu_to_los(1, 1, 1, float("nan"), 0)) is None


def test_two_looks_invert(spark):
    east, north, up = 3.0, -2.0, 5.0
    a = one(spark, geo.enu_to_los(east, north, up, 37, -12))
    d = one(spark, geo.enu_to_los(east, north, up, 39, -168))
    found = [one(spark, c) for c in geo.decompose_two_looks(a, d, 37, -12, 39, -168, north)]
    assert found == pytest.approx([east, up])
    assert one(spark, geo.decompose_two_looks(1, 1, 37, -12, 37, -12, 0)[0]) is None


def test_distances(spark):
    assert one(spark, geo.haversine_m(0, 0, 1, 0)) == pytest.approx(111195.08, abs=0.5)
    assert one(spark, geo.haversine_m(179.9999, 0, -179.9999, 0)) == pytest.approx(22.24, abs=0.1)
    assert one(spark, geo.haversine_m(0, 91, 0, 0)) is None
    with pytest.raises(ValueError):
        geo.haversine_m(0, 0, 1, 1, earth_radius_m=0)


def test_pixels(spark):
    x, y = geo.normalize_pixel(3, 0, 4, 4)
    assert (one(spark, x), one(spark, y)) == (0.75, -0.75)
    assert one(spark, geo.normalize_pixel(4, 0, 4, 4)[0]) is None


def test_scalars(spark):
    texts = [" 1 ", "+1", "1.", ".5", "1e3", "1_000", "0x10", "1d", "1f", "", None, "inf", "NaN", "1,0"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(to_double("t")).collect()]
    assert got == [1.0, 1.0, 1.0, 0.5, 1000.0] + [None] * 9
    values = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [tuple(r) for r in values.select(is_finite("v"), finite_or_null("v")).collect()] == [(True, 1.0), (False, None), (False, None), (False, None)]


def residuals(spark, values, keys=None):
    return spark.createDataFrame([(k, v, "clash") for k, v in zip(keys or ["k"] * len(values), values, strict=True)], "key string, r double, n string")


def test_metrics_identity_and_numpy(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(1, 3, 501).tolist() + [float("nan"), None, float("inf")]
    row = M.summarize_residuals(residuals(spark, values), "r", tolerance=2.0).first().asDict()
    v = np.array(values[:501])
    assert row["n"] == 501 and row["rms_mm_per_year"] ** 2 == pytest.approx(row["bias_mm_per_year"] ** 2 + row["centered_rms_mm_per_year"] ** 2)
    assert row["nmad_mm_per_year"] == pytest.approx(1.4826 * np.median(np.abs(v - np.median(v))))
    assert row["median_residual_mm_per_year"] == pytest.approx(np.median(v)) and row["fraction_within_tolerance"] == pytest.approx(np.mean(np.abs(v) <= 2))


def test_metrics_by_key_with_null_and_empty(spark):
    df = residuals(spark, [1.0, -2.0, None, 5.0], ["a", "a", "b", None])
    rows = {r["key"]: r for r in M.summarize_residuals(df, "r", ["key"], 2.0).collect()}
    assert rows["a"]["n"] == 2 and rows["a"]["fraction_within_tolerance"] == 1.0 and rows["a"]["nmad_mm_per_year"] == pytest.approx(1.4826 * 1.5)
    assert rows["b"]["n"] == 0 and rows["b"]["rms_mm_per_year"] is None
    assert rows[None]["n"] == 1 and rows[None]["nmad_mm_per_year"] == 0
    assert M.summarize_residuals(df.limit(0), "r").first()["n"] == 0
    assert M.summarize_residuals(df.limit(0), "r", ["key"]).count() == 0
    with pytest.raises(ValueError):
        M.summarize_residuals(df, "r", tolerance=-1)


def test_accuracy(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 1.0), (float("nan"), 2.0), (3.0, None)], "i double, g double")
    row = M.accuracy_metrics(df, "i", "g").first()
    assert row["n"] == 2 and row["bias_mm_per_year"] == 2 and row["rms_mm_per_year"] == pytest.approx(math.sqrt(5)) and row["centered_rms_mm_per_year"] == pytest.approx(1) and row["correlation"] == pytest.approx(1)
    for rows in ([(1.0, 2.0)], [(1.0, 2.0), (1.0, 3.0)]):
        assert M.accuracy_metrics(spark.createDataFrame(rows, "i double, g double"), "i", "g").first()["correlation"] is None


def test_distribution(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("a", 3.0, 2.0, 5.0), ("b", 1.0, 1.0, 1.0)], "orbit string, all_rms_mm_per_year double, fitting_rms_mm_per_year double, holdout_rms_mm_per_year double")
    rows = {(r["orbit"], r["scope"]): r for r in M.rms_distribution(df).collect()}
    assert rows["a", "all"]["p2_5_rms"] == pytest.approx(np.percentile([1, 3], 2.5)) and rows["a", "holdout"]["standard_deviation_of_rms"] == pytest.approx(np.std([3, 5], ddof=1))
    assert rows["b", "all"]["standard_deviation_of_rms"] is None


def test_figures(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 2, 400)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    q25, q75 = np.percentile(v, [25, 75])
    assert figures.bin_width(df, "v").first()[0] == pytest.approx(2 * (q75 - q25) / 400 ** (1 / 3))
    assert figures.bin_width(spark.createDataFrame([(1.0,)], "v double"), "v").first()[0] == 1.0
    assert figures.bin_width(spark.createDataFrame([(1.0,)] * 5 + [(2.0,)], "v double"), "v").first()[0] == pytest.approx(0.2)
    hist = figures.histogram(df, "v", 8.0, 0.5).orderBy("bin").collect()
    counts, _ = np.histogram(v, np.arange(-8, 8 + 0.5 * 1.001, 0.5))
    assert [r["n"] for r in hist] == counts.tolist()
    limit = figures.robust_symmetric_limit(df, "v").first()[0]
    assert limit >= np.percentile(np.abs(v), 98) and limit == pytest.approx(math.ceil(np.percentile(np.abs(v), 98) * 5) / 5)
    assert figures.robust_symmetric_limit(spark.createDataFrame([(0.0,)], "v double"), "v").first()[0] == 1.0
    assert figures.robust_symmetric_limit(df.limit(0), "v").first()[0] is None
    assert figures.legend_values(spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.31, -1.0, None)], "s double"), "s") == pytest.approx([0.15, 0.2, 0.26])
    assert figures.tick_step(9.0, 5) == 2.0 and figures.tick_step(11.0, 5) == 2.5
    low, high = figures.axis_range(spark.createDataFrame([(0.0, 10.0, 1.0), (5.0, 2.0, None)], "i double, g double, s double"), "i", "g", "s").first()
    assert (low, high) == pytest.approx((-0.88, 11.88))
