"""The registered jobs call their operators over the whole job."""

import pytest
from pyspark.sql import functions as F

from gridstrata.operators import regress
from gridstrata.plans import products, registry  # noqa: F401 (products adds to the registry)

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "repeats"), [("j9_repeated_elastic_net", 40), ("j12_predictor_classes", 40), ("j11_compare_predictor_sets", 40), ("j14_per_model", 20)])
def test_elastic_nets(spark, monkeypatch, name, repeats):
    seen, whole = [], regress.repeated_elastic_net

    def small(moments, splits, response, predictors, keys, *rest, **grid):
        seen.append((splits.agg({"repeat": "max"}).first()[0] + 1, rest, grid))
        return whole(moments, splits.where("repeat < 2"), response, predictors, keys, alphas=(0.01,), l1_ratios=(0.5,))

    monkeypatch.setattr(regress, "repeated_elastic_net", small)
    rows = registry.QUERIES[name](spark, DATA).collect()
    assert seen and all(s == (repeats, (), {}) for s in seen)
    assert rows and all("regime" in r for r in rows)  # the tables hold positive changes only
    assert len(regress.ALPHAS) == 20 and len(regress.L1_RATIOS) == 7


def test_sets_are_compared_within_regimes(spark):
    fits = [(g, name, r, x + r, "pr", c) for g, name, x, c in [("negative", "a", 0.1, 0.0), ("negative", "b", 0.2, 1.0), ("positive", "a", 0.5, 2.0)] for r in range(2)]
    out = regress.compare_sets(spark.createDataFrame(fits, "regime string, set string, repeat int, test_r2 double, predictor string, coef double"), ["regime"]).collect()
    assert [(r.regime, r.set, round(r.mean_r2, 6), r.mean_selected) for r in out] == [("negative", "b", 0.7, 1.0), ("negative", "a", 0.6, 0.0), ("positive", "a", 1.0, 1.0)]


def test_forests(spark, monkeypatch):
    seen, whole = [], regress.forest_repeats

    def small(*own, **grid):
        seen.append((own[1].agg({"repeat": "max"}).first()[0] + 1, own[4:], grid))
        return whole(*own[:4], repeats=3, trees=3, depth=2)

    monkeypatch.setattr(regress, "forest_repeats", small)
    rows = registry.QUERIES["j19_forest_repeats"](spark, DATA).collect()
    assert seen == [(12, (), {})]  # every default of the operator
    assert [(r.repeat, r.predictor) for r in rows] == [(k, p) for k in range(3) for p in ("pr", "disc", "tax")]


def test_forests_find_the_predictor_that_counts(spark):
    df = spark.createDataFrame([(i % 12, float(i % 10), float(i * 7 % 11), 3.0 * (i % 10)) for i in range(240)], "block int, a double, b double, y double")
    folds = spark.createDataFrame([(b, b % 2) for b in range(12)], "block int, fold int")
    splits = spark.createDataFrame([(r, b, b % 3 == r) for r in range(3) for b in range(12)], "repeat int, block int, is_test boolean")
    found = regress.forest_repeats(df, splits, "y", ["a", "b"], repeats=3, trees=10, depth=5, share=1.0)
    assert [r for r, *_ in found] == [0, 1, 2] and all(test > 0.8 and weights["a"] > 0.9 for _, _, test, weights in found)
    grid = regress.forest_grid(df, folds, "y", ["a", "b"], depths=(1, 5), leaves=(1,), shares=(1.0,), trees=10).collect()
    assert [(r.depth, r.leaf, r.share) for r in grid] == [(1, 1, 1.0), (5, 1, 1.0)] and grid[1].test_r2 > max(0.8, grid[0].test_r2)


def test_forest_importance_explains_all_held_out_rows(spark, monkeypatch):
    from gridstrata.operators import forests

    seen, whole, grow, drops = [], forests.attribution, forests.grow, forests.permutation_importance

    def counted(rows, forest, predictors, **options):
        found = whole(rows, forest, predictors, **options)
        seen.append(({r.data: r.n for r in forests._in_sets(rows, "test").groupBy("data").agg(F.count("*").alias("n")).collect()}, options))
        return found

    monkeypatch.setattr(forests, "attribution", counted)
    monkeypatch.setattr(forests, "grow", lambda rows, k, settings, trees: grow(rows, k, settings, 3))
    monkeypatch.setattr(forests, "permutation_importance", lambda *a: drops(*a, draws=1))
    assert len(registry.QUERIES["j19_forest_importance"](spark, DATA).collect()) == 3
    (sizes, options), = seen
    assert len(sizes) == 10 and options.get("most") is None
