"""Rules of missing values, thresholds and axes on hand-made frames; properties of remapping, agreement and regression."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridstrata.functions import columns as C
from gridstrata.operators import conform, panel, regimes, regress, series
from gridstrata.sources import catalog


def one(spark, sql):
    return spark.sql(f"SELECT {sql}").first()[0]


def test_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 2.0), (5.0, 1e-13)], "a double, b double")
    assert [r[0] for r in df.select(C.safe_ratio(F.col("a"), F.col("b"))).collect()] == [0.5, None, None, None]
    assert [r[0] for r in df.select(C.clip(F.col("a"), 0, 2)).collect()] == [1.0, 1.0, None, 2.0]
    x = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "x double")
    assert [r[0] for r in x.select(C.finite(F.col("x"))).collect()] == [None, None, 1.0, None]


def test_month_length(spark):
    days = {c: spark.range(1).select(C.month_length(F.lit(2000), F.lit(2), c)).first()[0] for c in ("standard", "noleap", "all_leap", "360_day")}
    assert days == {"standard": 29, "noleap": 28, "all_leap": 29, "360_day": 30}


def test_months_parse():
    with pytest.raises(KeyError):
        panel.select_months(None, "monsoon")


def test_pad_months_leaves_gaps(spark):
    df = spark.createDataFrame([("a", 2000, 3, 1.0), ("a", 2000, 5, 2.0)], "cell string, year int, month int, v double")
    got = {(r.year, r.month): r.v for r in conform.pad_months(df, ["cell"], (2000, 2), (2000, 6)).collect()}
    assert got == {(2000, 2): None, (2000, 3): 1.0, (2000, 5): 2.0, (2000, 6): None}


def test_rx5day_crosses_the_year_and_needs_all_days(spark):
    days = [dt.date(1999, 12, 29) + dt.timedelta(k) for k in range(8)]
    rows = [(1, d, 1.0) for d in days if d != dt.date(2000, 1, 4)]
    got = {r.year: r.rx5day for r in panel.rolling_max(spark.createDataFrame(rows, "cell int, day date, pr double")).collect()}
    assert got == {1999: None, 2000: 5.0}


def test_regrid_keeps_the_integral(spark):
    grid = [(lat, lon, float(lat * 3 + lon % 7), 0) for lat in range(-85, 90, 10) for lon in range(-175, 180, 10)]
    df = spark.createDataFrame([(float(a), float(b), v, t) for a, b, v, t in grid], "lat double, lon double, v double, t int")
    out = conform.regrid_conservative(df, ["v"], ["t"], 10.0, 30.0)
    total = lambda d, h: d.agg(F.sum(F.col("v") * (F.sin(F.radians(F.col("lat") + h)) - F.sin(F.radians(F.col("lat") - h))) * h)).first()[0]
    assert out.count() == 72 and abs(total(df, 5) - total(out, 15)) < 1e-6


def test_regrid_null_source(spark):
    df = spark.createDataFrame([(-85.0, -175.0, None, 0), (-85.0, -165.0, 2.0, 0)], "lat double, lon double, v double, t int")
    plain, normed = (conform.regrid_conservative(df, ["v"], ["t"], 10.0, 30.0, n).where("v is not null").collect() for n in (False, True))
    assert plain == [] and [r.v for r in normed] == [2.0]


def test_region_by_ray_casting(spark):
    rings = spark.createDataFrame([("box", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])], "region string, ring array<struct<lon: double, lat: double>>")
    cells = spark.createDataFrame([(5.0, 5.0), (5.0, 15.0), (-5.0, 5.0)], "lat double, lon double")
    assert [(r.lat, r.lon) for r in conform.region_of(cells, rings).collect()] == [(5.0, 5.0)]


def test_units():
    with pytest.raises(KeyError):
        C.convert(F.col("x") if False else None, "K", "furlong")


def test_regimes_are_disjoint_and_zero_is_neither(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(regimes.regime(F.col("x"), "historical", "bgws")).collect()] == ["Positive Historical BGWS", None, "Negative Historical BGWS", None]


def test_quadrant_areas_sum_to_all(spark):
    df = spark.createDataFrame([(10.0, 0, True), (50.0, 1, False), (70.0, 3, None), (0.0, None, None)], "lat double, quadrant int, low boolean")
    rows = regimes.quadrant_areas(df).collect()
    assert abs(sum(r.total for r in rows) - 100) < 1e-9 and all(abs(r.total - r.robust - r.uncertain) < 1e-9 for r in rows)


def test_kendall_against_pairs_and_negation(spark):
    rng = np.random.default_rng(1)
    rows = [(1, float(a), float(b)) for a, b in rng.integers(0, 6, (40, 2))]
    df = spark.createDataFrame(rows, "cell int, a double, b double")
    c = na = nb = 0
    for i, (_, a, b) in enumerate(rows):
        for _, x, y in rows[:i]:
            c, na, nb = c + np.sign(a - x) * np.sign(b - y), na + (a != x), nb + (b != y)
    tau = series.kendall(df, "a", "b", ["cell"]).first().tau
    assert abs(tau - c / np.sqrt(na * nb)) < 1e-12
    assert abs(series.kendall(df.withColumn("b", -F.col("b")), "a", "b", ["cell"]).first().tau + tau) < 1e-12


def test_detrended_has_no_slope(spark):
    df = spark.createDataFrame([(1, k, 3.0 * k + (k % 3)) for k in range(20)], "cell int, t int, v double")
    rows = series.detrend(df, "v", ["cell"], ["t"]).orderBy("t").toPandas()
    assert abs(np.polyfit(rows.t, rows.detrended, 1)[0]) < 1e-9


def test_elastic_net_against_subgradient_conditions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.1]
    pdf = pd.DataFrame(x, columns=list("abc")).assign(y=2 * x[:, 0] - x[:, 1] + rng.normal(size=200), block="b")
    own, alpha, l1 = ["a", "b", "c", "y"], 0.3, 0.7
    m = regress.block_moments(spark.createDataFrame(pdf), "y", list("abc"), ["block"]).toPandas().iloc[0]
    coef, intercept = regress.elastic_net(m, own, alpha, l1)
    z, w = (x - x.mean(0)) / x.std(0), coef * x.std(0)
    grad = z.T @ (pdf.y - intercept - x @ coef) / 200 - alpha * (1 - l1) * w
    assert all(abs(g - alpha * l1 * np.sign(v)) < 1e-6 if v else abs(g) <= alpha * l1 + 1e-6 for g, v in zip(grad, w, strict=True))
    r2 = 1 - ((pdf.y - intercept - x @ coef) ** 2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum()
    assert abs(regress.r_squared(m, own, coef, intercept) - r2) < 1e-9


def test_blocks_never_straddle(spark):
    df = spark.range(60).select((F.col("id") % 13).cast("string").alias("block"))
    splits = regress.group_shuffles(df, 3).toPandas()
    assert (splits.groupby(["repeat", "block"]).size() == 1).all() and (splits.groupby("repeat").is_test.sum() == 3).all()
    assert regress.group_folds(df, 4).toPandas().block.is_unique


def test_store_and_load(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.createDataFrame([("p", "m", 1.5)], "period string, model string, v double")
    for _ in range(2):
        df = catalog.load_or_compute(spark, f"{tmp_path}/r", make, ["period", "model"])
    assert len(calls) == 1 and dict(df.dtypes)["v"] == "float"
    catalog.csv_export(df, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 1


def test_panel_write_replaces_only_its_partitions(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "experiment string, model string, v int")
    catalog.panel_write(frame([("h", "a", 1), ("h", "b", 2)]), f"{tmp_path}/p")
    catalog.panel_write(frame([("h", "b", 3)]), f"{tmp_path}/p")
    assert sorted((r.model, r.v) for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [("a", 1), ("b", 3)]


def test_permutation_importance_is_the_mean_over_permutations(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 2)) @ np.array([[1.0, 0.6], [0.0, 1.0]])
    y = x @ [1.5, -0.5] + rng.normal(size=60)
    own = ["a", "b", "y"]
    frame = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "k": 1}))
    m = regress.block_moments(frame, "y", ["a", "b"], ["k"]).toPandas().iloc[0]
    coef, intercept = np.array([1.2, -0.3]), 0.1
    r2 = lambda z: 1 - ((y - z @ coef - intercept) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    want = []
    for j in range(2):
        drops = []
        for _ in range(4000):
            z = x.copy()
            z[:, j] = rng.permutation(z[:, j])
            drops.append(r2(x) - r2(z))
        want.append((np.mean(drops), 5 * np.std(drops) / 4000**0.5))
    got = regress.permutation_importance(m, own, coef, intercept)
    assert all(abs(g - w) <= e for g, (w, e) in zip(got, want, strict=True))


def test_nested_screening_tests_each_block_once_with_the_best_setting(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=200)
    rows = pd.DataFrame({"a": a, "y": 2 * a + 0.1 * rng.normal(size=200), "block": [f"b{k % 12:02d}" for k in range(200)], "g": "x"})
    frame = spark.createDataFrame(rows)
    folds = regress.group_folds(frame, 5)
    out = regress.nested_screening(regress.block_moments(frame, "y", ["a"], ["g", "block"]), folds, "y", ["a"], ["g"], alphas=(0.001, 1.0), l1_ratios=(0.5,)).toPandas()
    assert sorted(out["repeat"]) == list(range(5)) and (out["alpha"] == 0.001).all() and (out["test_r2"] > 0.99).all()
    one_se = regress.repeated_elastic_net(regress.block_moments(frame, "y", ["a"], ["g", "block"]), regress.group_shuffles(frame, 3), "y", ["a"], ["g"], alphas=(0.001, 1.0), l1_ratios=(0.5,)).toPandas()
    assert (one_se["importance"] > 1).all()


def test_overfit_guard(spark):
    rows = spark.createDataFrame([(2, 0.5, 0.45), (8, 0.9, 0.6), (4, 0.55, 0.5)], "depth int, train_r2 double, test_r2 double")
    assert regress.overfit_guard(rows).first().depth == 4
    with pytest.raises(ValueError):
        regress.overfit_guard(rows.where("depth = 8"))


def test_tau_b_is_that_of_pairs():
    rng = np.random.default_rng(7)
    for n, top in ((2, 2), (9, 3), (60, 8), (200, 1000)):
        for _ in range(10):
            a, b = rng.integers(0, top, n).astype(float), rng.integers(0, top, n).astype(float)
            da, db = (np.sign(x[:, None] - x[None, :]) for x in (a, b))
            size = np.sqrt((da**2).sum() * (db**2).sum())
            got = series.tau_b(a, b)
            assert got is None if size == 0 else abs(got - (da * db).sum() / size) < 1e-12
    assert series.tau_b(np.array([1.0]), np.array([2.0])) is None


def test_quantiles_and_ranks(spark):
    rng = np.random.default_rng(8)
    rows = [(k, float(x)) for k, n, top in (("a", 700, 40), ("b", 1, 5), ("c", 300, 10**6)) for x in rng.integers(-top, top, n)] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    shares = (0.0, 0.025, 0.3333, 0.5, 0.9, 1.0)
    got = {r.k: r.q for r in series.quantiles(df, "x", shares, ("k",)).collect()}
    for k in "abc":
        assert np.allclose(got[k], np.quantile([x for c, x in rows if c == k and x is not None], shares))
    assert "d" not in got and series.quantiles(df.where("x is null"), "x", (0.5,)).first().q == [None]
    for r in series.value_ranks(df, "x", ["k"]).collect():
        own = [x for c, x in rows if c == r.k and x is not None]
        assert (r.n, r.before, r.total) == (own.count(r.x), sum(x < r.x for x in own), len(own))


def test_changes_and_ensembles_in_one_pass(spark):
    rows = [("hist", "A", 1.0, 2.0, 4.0), ("far", "A", 1.0, 2.0, 5.0), ("near", "A", 1.0, 2.0, None), ("far", "B", 1.0, 2.0, 9.0), ("hist", "C", 1.0, 2.0, 0.0), ("far", "C", 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "period string, model string, lat double, lon double, x double")
    for relative in ((), ("x",)):
        want = df.unionByName(panel.change(df, ["x"], "hist", relative))
        got = panel.with_changes(df, ["x"], "hist", relative)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    both = panel.with_ensemble(df, ["x"], ["period", "lat", "lon"]).where("kind = 'mean'").collect()
    assert {(r.period, r.model, r.x) for r in both} == {("hist", "ensemble mean", 2.0), ("far", "ensemble mean", 17 / 3), ("near", "ensemble mean", None)}


def test_merged_tables_keep_all_keys(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, None, 5.0)], "k int, x double, y double")
    b = spark.createDataFrame([(2, 7.0, 6.0), (3, 8.0, 9.0)], "k int, z double, y double")
    got = conform.merge_tables([a, b], ["k"]).orderBy("k").collect()
    assert [(r.k, r.x, r.y, r.z) for r in got] == [(1, 1.0, None, None), (2, None, 5.0, 7.0), (3, None, 9.0, 8.0)]


def test_bilinear_needs_its_neighbours(spark):
    rows = [(y, x, y + 10 * np.cos(np.radians(x))) for y in (-10.0, 0.0, 10.0) for x in (-180.0, -90.0, 0.0, 90.0)]
    df = spark.createDataFrame([(lat, lon, None if (lat, lon) == (10.0, 0.0) else float(v)) for lat, lon, v in rows], "lat double, lon double, x double").withColumn("m", F.lit("A"))
    target = spark.createDataFrame([(lat, lon) for lat in (-20.0, -5.0, 0.0, 5.0) for lon in (-180.0, -45.0, 135.0)], "lat double, lon double")
    got = {(r.lat, r.lon): r.x for r in conform.regrid_bilinear(df, target, ["x"], ["m"]).collect()}
    of = {-180.0: -10.0, -45.0: 5.0, 135.0: -5.0}
    want = {(lat, lon): None if (lat, lon) == (5.0, -45.0) else lat + w for lat in (-5.0, 0.0, 5.0) for lon, w in of.items()}
    assert got.keys() == want.keys() and all(got[k] == w if w is None else abs(got[k] - w) < 1e-9 for k, w in want.items())


def test_means_that_differ_by_rounding_tie_in_ranks(spark, tmp_path):
    import numpy as np

    from gridstrata.plans import registry

    cells = [(0, 10.0, (0.1, 0.2, 0.3)), (1, 20.0, (0.3, 0.2, 0.1)), (2, 30.0, (1.0, 1.0, 1.0)), (3, 5.0, (2.0, 2.0, 2.0))]
    rows = [(p, 0, q, x, 0.1, 0.1) for p, q, prices in cells for x in prices]
    df = spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    df.selectExpr("*", "timestamp'1996-01-05 00:00:00' AS l_shipdate").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = np.corrcoef([2, 3, 4, 1], [1.5, 1.5, 3, 4])[0, 1]
    assert registry.QUERIES["i7_spearman"](spark, str(tmp_path)).first().rho == round(want, 6)
