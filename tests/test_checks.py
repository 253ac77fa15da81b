"""Checks inside plans, stores that go on after a stop, representatives, summaries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstrata.operators import conform, panel, regress, series
from gridstrata.sources import catalog


def days(spark, n, cell=1):
    return spark.range(n).select(F.lit(cell).alias("cell"), F.date_add(F.lit("1999-03-01").cast("date"), F.col("id").cast("int")).alias("day"), F.col("id").cast("double").alias("pr"))


def reference(spark, n):
    return spark.range(1, n + 1).select(F.col("id").alias("rank"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int") - 1).alias("day"))


def test_unequal_counts_raise_when_the_job_runs(spark):
    job = lambda n, **o: conform.by_rank(days(spark, n), reference(spark, 3), ["cell"], ["day"], ["day"], **o)
    assert [str(r.day) for r in job(3).orderBy("pr").collect()] == ["2000-01-01", "2000-01-02", "2000-01-03"]
    for n in (2, 5):
        tracker = spark.sparkContext.statusTracker()
        before = len(tracker.getJobIdsForGroup())
        plan = job(n)
        assert len(tracker.getJobIdsForGroup()) == before  # nothing ran yet
        with pytest.raises(Exception, match=f"positions by cell and in the reference: {n} and 3"):
            plan.collect()
    assert job(2, exact=False).count() == 2
    with pytest.raises(Exception, match="5 and 3"):
        job(5, exact=False).count()


def test_missing_drivers_raise_when_the_job_runs(spark):
    base = spark.createDataFrame([("A", 1.0, 5.0), ("B", 1.0, 6.0), (None, 1.0, 7.0)], "model string, lat double, x double")
    drivers = spark.createDataFrame([("A", 1.0, 9.0)], "model string, lat double, d double")
    assert panel.combine(base.where("model = 'A'"), drivers, ["model", "lat"]).collect() == [("A", 1.0, 5.0, 9.0)]
    assert panel.combine(base.where("model is not null"), drivers, ["model", "lat"], ("B",)).count() == 1
    plan = panel.combine(base, drivers, ["model", "lat"])
    with pytest.raises(Exception, match="drivers lack a key of the base: B, 1.0"):
        plan.collect()


def test_window_of_months_and_days(spark):
    names = ["pr_185001-185912.nc", "pr_20100101-20101231.nc", "pr_18500101-18591231.nc", "pr_fx.nc", "pr_201501-201512.nc", "pr_20150116-20150120.nc"]
    cat = spark.createDataFrame([(n,) for n in names], "file string")
    kept = lambda a, b: [names.index(r.file) for r in catalog.window_overlap(cat, a, b).collect()]
    assert sorted(kept("201001", "201912")) == [1, 3, 4, 5]
    assert sorted(kept("20150121", "20150125")) == [3, 4]
    assert sorted(kept("185912", "201001")) == [0, 1, 2, 3]


def test_store_goes_on_and_heeds_the_mask(spark, tmp_path):
    mask = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "lat double, lon double")
    parts, asked = [(p, m) for p in ("a", "b") for m in ("M0", "M1")], []

    def compute(missing, mask, fail_at=None):
        asked.extend(missing)
        if fail_at in missing:
            raise RuntimeError("stopped")
        wanted = spark.createDataFrame(missing, "period string, model string")
        return wanted.crossJoin(mask).withColumn("x", F.length("model") + F.col("lat"))

    store = catalog.ResultStore(spark, str(tmp_path), mask)
    with pytest.raises(RuntimeError):
        store.fill(parts, lambda m, k: compute(m, k, ("b", "M0")), at_once=1)
    assert store.done() == {("a", "M0"), ("a", "M1")}
    # what a stopped job wrote of a part without its line in the manifest is written anew
    compute([("b", "M0")], mask).write.partitionBy("period", "model").mode("append").parquet(f"{store.folder}/rows")
    asked.clear()
    again = catalog.ResultStore(spark, str(tmp_path), mask.orderBy(F.desc("lat")))
    rows = again.fill(parts, compute)
    assert asked == [("b", "M0"), ("b", "M1")] and rows.count() == 8 and dict(rows.dtypes)["x"] == "float"
    assert sorted(map(tuple, again.mask().collect())) == [(1.0, 2.0), (3.0, 4.0)]
    asked.clear()
    assert again.fill(parts[:1], compute).count() == 2 and asked == []
    other = catalog.ResultStore(spark, str(tmp_path), mask.where("lat = 1"))
    assert other.fill(parts, compute).count() == 4 and len(asked) == 4
    assert catalog.fingerprint(mask) != catalog.fingerprint(mask.unionAll(mask)) != catalog.fingerprint(mask.where("false"))


def test_three_representatives_with_ties(spark):
    rng = np.random.default_rng(4)
    rows = [("many", k, float(x)) for k, x in enumerate(rng.integers(0, 4, 12))] + [("same", k, 1.0) for k in range(5)] + [("two", 0, 1.0), ("two", 1, 3.0)] + [("none", 0, None)]
    got = {}
    for r in regress.three_representatives(spark.createDataFrame(rows, "key string, repeat int, r2 double"), ["key"]).collect():
        got.setdefault(r.key, {})[r.quantile] = r.repeat
    want = {}
    for key in ("many", "same", "two"):
        left = {k: x for y, k, x in rows if y == key}
        targets = np.quantile(list(left.values()), [0.25, 0.5, 0.75])
        for q, t in zip((0.25, 0.5, 0.75), targets, strict=True):
            if left:
                k = min(left, key=lambda k: (abs(left[k] - t), k))
                want.setdefault(key, {})[q] = k
                del left[k]
    assert got == want


def test_linear_against_forest(spark):
    linear = spark.createDataFrame([("p", r, x, name) for r, x in ((0, 0.2), (1, 0.4)) for name in "ab"], "regime string, repeat int, test_r2 double, predictor string")
    forest = spark.createDataFrame([("p", 0, 0.5), ("p", 1, 0.7), ("q", 0, 0.1)], "regime string, repeat int, test_r2 double")
    got = {r.regime: r for r in regress.linear_against_forest(linear, forest, ["regime"]).collect()}
    assert got["p"].n_linear == 2 and got["p"].gain_mean == pytest.approx(0.3) and got["p"].linear_median == pytest.approx(0.3)
    assert got["q"].linear_mean is None and got["q"].forest_mean == pytest.approx(0.1)


def test_driver_job(spark):
    rng = np.random.default_rng(0)
    rows = []
    for m in ("M0", "M1", "M2"):
        for k in range(400):
            a, b = rng.normal(size=2)
            rows.append((m, "positive", f"{k % 12}_0", float(3 * a - b * (m != "M2") + rng.normal() * 0.2), float(a), float(b)))
    got = {r.predictor: r for r in regress.driver_job(spark.createDataFrame(rows, "model string, regime string, block string, y double, a double, b double"), "y", ["a", "b"], 4).collect()}
    assert got["a"].n_models == 3 and got["a"].mean > got["b"].mean and got["a"].dominant_sign == 1 and got["a"].coef_positive == 1
    assert got["b"].coef_negative >= 2 / 3 and abs(got["a"].context_z) < 0.2 and got["a"].selection_frequency == 1 and got["a"].coef_p2_5 > 2.5


def test_regions_of_many_corners_and_holes(spark):
    rng = random.Random(2)

    def star(lon, lat, size, n):
        turn = [2 * np.pi * k / n for k in range(n)]
        return [(float(lon + size * (0.5 + rng.random() / 2) * np.cos(t)), float(lat + size * (0.5 + rng.random() / 2) * np.sin(t))) for t in turn]

    shapes = [("a", star(0, 0, 40, 400)), ("a", star(0, 0, 12, 50)), ("b", star(60, -30, 25, 7)), ("b", star(-80, 40, 20, 90)), ("c", star(10, 10, 30, 60)), ("none", []), ("line", [(0.0, 1.0), (5.0, 1.0)])]
    cells = [(float(lat), float(lon)) for lat in np.arange(-59.5, 65, 3) for lon in np.arange(-110.5, 100, 3)]
    want = set()
    for lat, lon in cells:
        for name in {n for n, _ in shapes}:
            crossings = 0
            for _, ring in (s for s in shapes if s[0] == name):
                for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
                    crossings += (y0 > lat) != (y1 > lat) and lon < x0 + (lat - y0) * (x1 - x0) / (y1 - y0)
            if crossings % 2:
                want.add((lat, lon, name))
    frame = spark.createDataFrame(cells + cells[:9], "lat double, lon double")
    rings = spark.createDataFrame(shapes, "region string, ring array<struct<lon:double,lat:double>>")
    for band in (0.5, 1.0, 30.0):
        assert {tuple(r) for r in conform.region_of(frame, rings, band).collect()} == want


def test_eli_is_that_of_separate_steps(spark):
    rng = np.random.default_rng(5)
    rows = [(c, 2000 + k // 12, k % 12 + 1, *(None if rng.random() < 0.1 else float(x) for x in rng.normal(size=3) + np.array([k / 9, k % 12, 1.0]))) for c in range(6) for k in range(48) if rng.random() > 0.05]
    rows += [(90, 2000, 1, 1.0, 2.0, 3.0), (91, 2000, 1, None, None, None), (92, 2000, 1, 1.0, 1.0, None), (92, 2000, 2, 2.0, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "cell int, year int, month int, s double, e double, t double")
    steps = df
    for v in "set":
        steps = series.deseasonalise(series.detrend(steps, v, ["cell"], ["year", "month"]).withColumnRenamed("detrended", "_d"), "_d", ["cell"]).withColumnRenamed("anomaly", f"{v}_a").drop("_d")
    parts = {}
    for r in steps.collect():
        parts.setdefault(r.cell, []).append(r)

    def tau(pairs):
        sign = lambda x: 0 if abs(x) < 1e-9 else (1 if x > 0 else -1)
        both = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(pairs) for b in pairs[:i]]
        nx, ny = sum(x != 0 for x, _ in both), sum(y != 0 for _, y in both)
        return sum(x * y for x, y in both) / (nx * ny) ** 0.5 if nx and ny else None

    got = {r.cell: r for r in series.eli(df, "s", "e", "t", ["cell"]).collect()}
    assert set(got) == set(parts)
    for c, part in parts.items():
        want = [tau([(r[f"{v}_a"], r.t_a) for r in part if r[f"{v}_a"] is not None and r.t_a is not None]) for v in "se"]
        for x, y in zip((got[c].tau_s, got[c].tau_e), want, strict=True):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y)), c
    plan = series.eli(df, "s", "e", "t", ["cell"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_folds_are_dealt_by_size(spark):
    rng = random.Random(6)
    sizes = {f"b{k}": rng.randrange(1, 40) for k in range(23)}
    df = spark.createDataFrame([(b,) for b, n in sizes.items() for _ in range(n)], "block string")
    load, want = [0] * 4, {}
    for b, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        k = load.index(min(load))
        want[b], load[k] = k, load[k] + n
    assert {r.block: r.fold for r in regress.group_folds(df, 4).collect()} == want


def test_shuffles_hold_out_a_fifth_of_the_blocks(spark):
    df = spark.createDataFrame([(f"b{k % 17:02d}",) for k in range(60)], "block string")
    rows = regress.group_shuffles(df, 6).collect()
    names, rng = sorted({r.block for r in rows}), np.random.RandomState(42)
    for repeat in range(6):
        want = {names[i] for i in rng.permutation(17)[:4]}
        assert {r.block for r in rows if r.repeat == repeat and r.is_test} == want and sum(r.repeat == repeat for r in rows) == 17


def test_classes_and_tables_of_fits(spark):
    coefs = {"core": [1.0, 2.0, 1.0, 3.0, 1.0], "mixed": [1.0, -1.0, 2.0, -3.0, 1.0], "half": [1.0, 0.0, 2.0, 0.0, 1.0], "weak": [0.0, 0.0, 0.0, 0.0, -2.0]}
    rows = [("M0", "wet", k, name, c, 0.1 * k + c, 0.5 + 0.1 * k) for name, cs in coefs.items() for k, c in enumerate(cs)]
    fits = spark.createDataFrame(rows, "model string, regime string, repeat int, predictor string, coef double, importance double, test_r2 double")
    got = {r.predictor: r for r in regress.selection(fits, ["regime"]).collect()}
    assert {p: r["class"] for p, r in got.items()} == {"core": "core", "mixed": "secondary", "half": "secondary", "weak": "weak"}
    assert got["weak"].frequency == pytest.approx(0.2) and got["weak"].sign == -1 and got["mixed"].sign == pytest.approx(0.2)
    for r in regress.importance_table(fits, ["model", "regime"]).collect():
        c = np.array(coefs[r.predictor])
        x, t = 0.1 * np.arange(5) + c, 0.5 + 0.1 * np.arange(5)
        signs = np.sign(c[c != 0])
        want = (x.mean(), np.median(x), np.median(c), c.mean(), (c != 0).mean(), signs.mean(), t.mean(), np.median(t), t.std(ddof=1), 5)
        assert tuple(r)[3:] == pytest.approx(want)
