"""Spatially blocked regression on block moments, and summaries of importance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.functions.columns import finite

#: The grid of the elastic net.
ALPHAS, L1_RATIOS = np.logspace(-3, 1, 20), (0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 1.0)


def regime_frame(df: DataFrame, response: str, predictors: list[str], where: Column) -> DataFrame:
    """J1. Complete finite rows of one regime."""
    own = [response, *predictors]
    return df.where(where).withColumns({c: finite(F.col(c)) for c in own}).dropna(how="any", subset=own)


def block(lat: Column, lon: Column, lat_bin: float = 10, lon_bin: float = 20) -> Column:
    """J2."""
    return F.concat_ws("_", F.floor(lat / lat_bin).cast("string"), F.floor(lon / lon_bin).cast("string"))


def group_folds(df: DataFrame, k: int, key: str = "block") -> DataFrame:
    """J3. block, fold: blocks, the largest first, dealt to the fold that is lightest. There are at most 324 blocks of 10 by 20 degrees."""

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows, load, fold = rows.sort_values(["n", key], ascending=[False, True]), np.zeros(k), []
        for n in rows["n"]:
            fold.append(int(load.argmin()))
            load[fold[-1]] += n
        return rows.assign(fold=fold)[[key, "fold"]]

    return df.groupBy(key).agg(F.count("*").alias("n")).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(deal, f"{key} string, fold int")


def group_shuffles(df: DataFrame, repeats: int, share: float = 0.2, seed: int = 42, key: str = "block") -> DataFrame:
    """J4. repeat, block, is_test: in each repeat a random ceil(share * n) of the sorted blocks is tested."""

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        names, rng, out = sorted(rows[key]), np.random.RandomState(seed), []
        for r in range(repeats):
            test = {names[i] for i in rng.permutation(len(names))[: int(np.ceil(share * len(names)))]}
            out.append(pd.DataFrame({"repeat": r, key: names, "is_test": [n in test for n in names]}))
        return pd.concat(out)

    return df.select(key).distinct().withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(split, f"repeat int, {key} string, is_test boolean")


def block_moments(df: DataFrame, response: str, predictors: list[str], keys: list[str]) -> DataFrame:
    """J5. n and all first and second moments by key: what every fit and score below needs of the rows."""
    own = [*predictors, response]
    pairs = [(a, b) for i, a in enumerate(own) for b in own[i:]]
    return df.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in own], *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in pairs])


def _gram(m: pd.Series, own: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    s = np.array([m[f"s_{c}"] for c in own])
    q = np.array([[m[f"s_{a}_{b}"] if i <= j else m[f"s_{b}_{a}"] for j, b in enumerate(own)] for i, a in enumerate(own)])
    return float(m["n"]), s, q


def elastic_net(m: pd.Series, own: list[str], alpha: float, l1: float, sweeps: int = 500) -> tuple[np.ndarray, float]:
    """J6. Coefficients on the raw scale and intercept, by coordinate descent on moments; predictors are standardised."""
    n, s, q = _gram(m, own)
    mean, cov = s / n, q / n - np.outer(s, s) / n**2
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    inverse = np.divide(1, sd, out=np.zeros_like(sd), where=sd > 0)
    c, r = cov[:-1, :-1] * np.outer(inverse, inverse), cov[:-1, -1] * inverse
    w = np.zeros(len(r))
    for _ in range(sweeps):
        last = w.copy()
        for j in range(len(w)):
            if inverse[j]:
                rho = r[j] - c[j] @ w + c[j, j] * w[j]
                w[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (c[j, j] + alpha * (1 - l1))
        if np.abs(w - last).max(initial=0) < 1e-10:
            break
    coef = w * inverse
    return coef, float(mean[-1] - coef @ mean[:-1])


def r_squared(m: pd.Series, own: list[str], coef: np.ndarray, intercept: float) -> float:
    """R2 of a linear fit on rows of which only the moments are known."""
    n, s, q = _gram(m, own)
    v = np.append(-coef, 1.0)
    sse = v @ q @ v - 2 * intercept * (v @ s) + n * intercept**2
    sst = q[-1, -1] - s[-1] ** 2 / n
    return float(1 - sse / sst) if sst > 0 else float("nan")


def permutation_importance(m: pd.Series, own: list[str], coef: np.ndarray, intercept: float) -> np.ndarray:
    """J10. By predictor, the drop of a linear fit's R2 on held-out rows when that predictor is permuted over them: its mean over all
    permutations, which the moments of the rows give exactly, where repeated draws estimate it."""
    n, s, q = _gram(m, own)
    sst = q[-1, -1] - s[-1] ** 2 / n
    if not sst > 0:
        return np.full(len(coef), np.nan)
    v = np.append(-coef, 1.0)
    # a permuted value has the mean of all and is uncorrelated with the row's own: what it adds to a residual is b (x - x')
    with_residual = (q @ v)[:-1] - intercept * s[:-1] - s[:-1] / n * (v @ s - n * intercept)
    return (2 * coef * with_residual + 2 * coef**2 * (np.diag(q)[:-1] - s[:-1] ** 2 / n)) / sst


def repeated_elastic_net(moments: DataFrame, splits: DataFrame, response: str, predictors: list[str], keys: list[str], inner: int = 4, alphas=ALPHAS, l1_ratios=L1_RATIOS, simplest: bool = True) -> DataFrame:
    """J8, J9, J10, J14. For each key and repeat: the choice over inner folds of blocks (the one-standard-error one, or the best if not
    `simplest`), refitted; R2 and permutation importance on test blocks, and the coefficients.

    moments: by keys and block. A group holds the moments of one key and repeat, at most 324 blocks.
    """
    own, alphas = [*predictors, response], list(map(float, alphas))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        sums = [c for c in rows.columns if c == "n" or c.startswith("s_")]
        train, test = rows[~rows["is_test"]].sort_values(["n", "block"], ascending=[False, True]), rows[rows["is_test"]]
        load, fold = np.zeros(inner), []
        for n in train["n"]:
            fold.append(int(load.argmin()))
            load[fold[-1]] += n
        fold, whole, scores = np.array(fold), train[sums].sum(), {}
        parts = [train[sums][fold == f].sum() for f in range(inner)]
        for a in alphas:
            for l1 in l1_ratios:
                scores[a, l1] = [r_squared(p, own, *elastic_net(whole - p, own, a, l1)) for p in parts if p["n"]]
        mean = {k: float(np.mean(v)) for k, v in scores.items()}
        a, l1 = best = max(mean, key=mean.get)
        if simplest:
            a, l1 = max(k for k, v in mean.items() if v >= mean[best] - np.std(scores[best]) / np.sqrt(len(scores[best])))
        coef, intercept = elastic_net(whole, own, a, l1)
        held_out = test[sums].sum()
        first = rows.iloc[0]
        scored = {"test_r2": r_squared(held_out, own, coef, intercept), "predictor": predictors, "coef": coef, "importance": permutation_importance(held_out, own, coef, intercept)}
        return pd.DataFrame({**{k: first[k] for k in [*keys, "repeat"]}, "alpha": a, "l1_ratio": l1, "inner_r2": mean[a, l1], **scored})

    schema = ", ".join([*[f"{k} string" for k in keys], "repeat int, alpha double, l1_ratio double, inner_r2 double, test_r2 double, predictor string, coef double, importance double"])
    return moments.join(F.broadcast(splits), "block").groupBy(*keys, "repeat").applyInPandas(fit, schema)  # splits: repeats times 324 rows


def nested_screening(moments: DataFrame, folds: DataFrame, response: str, predictors: list[str], keys: list[str], **grid) -> DataFrame:
    """J7. repeated_elastic_net with the outer folds of blocks as its repeats, and the best setting of the inner folds for each.
    folds: block, fold (group_folds)."""
    outer = folds.select(F.col("fold").alias("repeat")).distinct().crossJoin(folds).select("repeat", "block", (F.col("fold") == F.col("repeat")).alias("is_test"))  # folds times 324 rows
    return repeated_elastic_net(moments, outer, response, predictors, keys, simplest=False, **grid)


def importance_table(fits: DataFrame, by: list[str]) -> DataFrame:
    """J14. By key and predictor, over the repeats: importance, coefficients, how often selected and of which sign, and the key's performance."""
    c, x = F.col("coef"), F.col("importance")
    return fits.groupBy(*by, "predictor").agg(
        F.avg(x).alias("mean_perm_importance"), F.median(x).alias("median_perm_importance"), F.median(c).alias("coef_median"), F.avg(c).alias("coef_mean"), F.avg((c != 0).cast("double")).alias("selection_frequency"),
        F.avg(F.signum(F.nullif(c, F.lit(0.0)))).alias("sign_consistency"), F.avg("test_r2").alias("mean_test_r2"), F.median("test_r2").alias("median_test_r2"), F.stddev("test_r2").alias("sd_test_r2"), F.count("*").alias("n"),
    )


def one_se(cv: DataFrame, k: int, by: list[str]) -> DataFrame:
    """J8. Of the settings within a standard error of the best, the largest alpha, then the largest l1 ratio."""
    best = cv.groupBy(*by).agg(F.max_by(F.struct("mean_score", "sd_score"), F.struct("mean_score", "alpha", "l1_ratio")).alias("b"))
    near = cv.join(best, by) if by else cv.crossJoin(F.broadcast(best))  # one row
    near = near.where(F.col("mean_score") >= F.col("b.mean_score") - F.col("b.sd_score") / k**0.5)
    return near.groupBy(*by).agg(F.max(F.struct("alpha", "l1_ratio", "mean_score")).alias("x")).select(*by, "x.*")


def selection(coefs: DataFrame, by: list[str]) -> DataFrame:
    """J9, J12. Selection frequency, sign consistency, mean coefficient, and the class core, secondary or weak."""
    c = F.col("coef")
    out = coefs.groupBy(*by, "predictor").agg(F.avg((c != 0).cast("double")).alias("frequency"), F.avg(F.signum(F.nullif(c, F.lit(0.0)))).alias("sign"), F.avg(c).alias("mean_coef"), F.median(c).alias("median_coef"))
    core = (F.col("frequency") >= 0.8) & (F.abs("sign") >= 0.9)
    return out.withColumn("class", F.when(core, "core").when(F.col("frequency") >= 0.5, "secondary").otherwise("weak"))


def importance_summary(df: DataFrame, by: list[str], value: str = "importance") -> DataFrame:
    """J13."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.025, 0.25, 0.5, 0.75, 0.975)]))
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), q.alias("q"))
    return out.select(*by, "mean", *[F.col("q")[i].alias(n) for i, n in enumerate(("p2_5", "q25", "median", "q75", "p97_5"))])


def fit_summary(fits: DataFrame, by: list[str]) -> DataFrame:
    """J13. Over the repeats, by key and predictor: mean, median and 95 percent range of importance, median and range of the coefficient, how
    often it is selected, and of which sign. fits: coef and importance."""
    c, outer = F.col("coef"), lambda v: F.percentile(v, F.array(F.lit(0.025), F.lit(0.975)))
    out = fits.groupBy(*by, "predictor").agg(
        F.avg("importance").alias("perm_mean"), F.median("importance").alias("perm_median"), outer("importance").alias("p"), F.median(c).alias("coef_median"), outer("coef").alias("q"),
        F.avg((c != 0).cast("double")).alias("selection_frequency"), F.avg(F.signum(F.nullif(c, F.lit(0.0)))).alias("sign_consistency"),
    )
    ranges = [F.col(a)[i].alias(f"{n}_{e}") for a, n in (("p", "perm"), ("q", "coef")) for i, e in enumerate(("p2_5", "p97_5"))]
    return out.select(*by, "predictor", "perm_mean", "perm_median", "coef_median", *ranges, "selection_frequency", "sign_consistency")


def model_agreement(df: DataFrame, value: str = "importance", by: list[str] | None = None) -> DataFrame:
    """J15. By key and predictor, over models: ranks within the model, quartiles, shares that are positive, in the top three, of either sign,
    and the share of the sign that most have."""
    by = by or []
    ranked = df.withColumn("rank", F.rank().over(Window.partitionBy(*by, "model").orderBy(F.desc(value))))
    of = lambda c: F.avg(c.cast("double"))
    out = ranked.groupBy(*by, "predictor").agg(
        F.count_distinct("model").alias("n_models"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.percentile(value, F.lit(0.25)).alias("p25"), F.percentile(value, F.lit(0.75)).alias("p75"),
        F.avg("rank").alias("mean_rank"), of(F.col(value) > 0).alias("positive"), of(F.col("rank") <= 3).alias("top3"), of(F.col("coef") > 0).alias("coef_positive"), of(F.col("coef") < 0).alias("coef_negative"),
    )
    out = out.withColumn("dominant_sign", F.greatest("coef_positive", "coef_negative"))
    return out.withColumn("star", F.when(F.col("top3") >= 0.5, "**").when(F.col("positive") >= 0.8, "*").otherwise(""))


def context_z(df: DataFrame, values: list[str], by: list[str], clipped: bool = True) -> DataFrame:
    """J16. mean over deviation of each value by key, clipped to [-1, 1]; NULL for fewer than two values or no spread."""
    z = lambda v: F.when(F.count(v) >= 2, F.avg(v) / F.nullif(F.stddev_pop(v), F.lit(0.0)))
    limit = (lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))) if clipped else (lambda c: c)
    return df.groupBy(*by).agg(*[limit(z(v)).alias(v) for v in values])


def panel_table(importance: DataFrame, performance: DataFrame, least_r2: float = 0.3) -> DataFrame:
    """J17. Agreement over the models whose R2 is above the least. performance: model, r2."""
    return model_agreement(importance.join(performance.where(F.col("r2") > least_r2), "model", "left_semi")).orderBy(F.desc("median"))


def representative(df: DataFrame, by: list[str]) -> DataFrame:
    """J21. The repeat whose score is nearest to the median. df: repeat, r2."""
    mid = df.groupBy(*by).agg(F.median("r2").alias("mid"))
    return df.join(mid, by).groupBy(*by).agg(F.min_by("repeat", F.struct(F.abs(F.col("r2") - F.col("mid")), F.col("repeat"))).alias("repeat"))


def three_representatives(df: DataFrame, by: list[str]) -> DataFrame:
    """J21. by, quantile, repeat: for the lower quartile, the median and the upper quartile of the score in turn, the repeat nearest to it that
    isn't taken yet; of equally near ones the first. df: repeat, r2; the repeats of a key, a few dozen, are one array."""
    shares, once = (0.25, 0.5, 0.75), lambda x, f: F.transform(F.array(x), f)[0]
    rows = df.where(F.col("r2").isNotNull()).groupBy(*by).agg(F.collect_list(F.struct("r2", "repeat")).alias("all"), F.percentile("r2", F.array(*map(F.lit, shares))).alias("q"))
    nearest = lambda all_, q: F.array_min(F.transform(all_, lambda x: F.struct(F.abs(x["r2"] - q), x["repeat"].alias("repeat"))))["repeat"]
    left = lambda all_, taken: F.filter(all_, lambda x: x["repeat"] != taken)
    row = lambda k, r: F.struct(F.lit(shares[k]).alias("quantile"), r.alias("repeat"))
    third = lambda rest, first, second: F.array(row(0, first), row(1, second), row(2, nearest(rest, F.col("q")[2])))
    second = lambda rest, first: once(nearest(rest, F.col("q")[1]), lambda r: third(left(rest, r), first, r))
    chosen = once(nearest(F.col("all"), F.col("q")[0]), lambda r: second(left(F.col("all"), r), r))
    return rows.select(*by, F.inline(chosen)).where(F.col("repeat").isNotNull())


def linear_against_forest(linear: DataFrame, forest: DataFrame, by: list[str]) -> DataFrame:
    """J24. By key: n repeats, mean and median R2 of the linear fits and of the forests over held-out blocks, and how much the forests gain.
    linear, forest: the keys, repeat and test_r2; rows that repeat a fit count once."""
    of = lambda df, n: df.select(*by, "repeat", F.col("test_r2").alias(n)).distinct().groupBy(*by).agg(F.count(n).alias(f"n_{n}"), F.avg(n).alias(f"{n}_mean"), F.median(n).alias(f"{n}_median"))
    both = of(linear, "linear").join(of(forest, "forest"), by, "full")
    return both.withColumns({f"gain_{s}": F.col(f"forest_{s}") - F.col(f"linear_{s}") for s in ("mean", "median")})


def driver_job(rows: DataFrame, response: str, predictors: list[str], repeats: int = 20, least_r2: float | None = None) -> DataFrame:
    """J25, from rows to its table: per-model fits (J14) with held-out importance (J10), agreement of the models (J15), their summary over all
    repeats (J13), the clipped context (J16) and, where least_r2 is given, only models of at least that mean R2 (J17). rows: model, regime,
    block, the response and the predictors."""
    fits = repeated_elastic_net(block_moments(rows, response, predictors, ["model", "regime", "block"]), group_shuffles(rows, repeats), response, predictors, ["model", "regime"])
    table = importance_table(fits, ["model", "regime"])
    if least_r2 is not None:
        table = table.where(F.col("mean_test_r2") > least_r2)
    agreement = model_agreement(table.select("model", "regime", "predictor", F.col("mean_perm_importance").alias("importance"), F.col("coef_median").alias("coef")), by=["regime"])
    long = rows.select("regime", F.explode(F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).cast("double").alias("context_z")) for p in predictors])).alias("e")).select("regime", "e.*")
    context = context_z(long, ["context_z"], ["regime", "predictor"])
    over_all = fit_summary(fits, ["regime"])
    return agreement.join(context, ["regime", "predictor"]).join(over_all, ["regime", "predictor"])


def _at_once(spark, job, settings: list, most: int) -> list:
    """job(setting) of each setting, in their order; as many jobs run at once as `most` says."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    with ThreadPool(most) as pool:
        return pool.map(inheritable_thread_target(spark)(job), settings, chunksize=1)


def _forest_rows(df: DataFrame, splits: DataFrame, response: str, predictors: list[str]) -> DataFrame:
    """The rows with features `_x` and the columns of splits, kept for many fits; lost parts are made again."""
    from pyspark.ml.feature import VectorAssembler

    kept = VectorAssembler(inputCols=predictors, outputCol="_x").transform(df.join(F.broadcast(splits), "block"))  # splits: at most 324 rows a repeat
    return kept.select("_x", response, *[c for c in splits.columns if c != "block"]).persist()


def _fitted(train: DataFrame, test: DataFrame, response: str, trees: int, depth: int, leaf: int, share: float, seed: int):
    """A forest, and its R2 on training and test rows."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import RandomForestRegressor

    model = RandomForestRegressor(featuresCol="_x", labelCol=response, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="all" if share >= 1 else str(share), seed=seed).fit(train)
    score = RegressionEvaluator(labelCol=response, metricName="r2")
    return model, score.evaluate(model.transform(train)), score.evaluate(model.transform(test))


def forest_repeats(
    df: DataFrame, splits: DataFrame, response: str, predictors: list[str], repeats: int = 12, trees: int = 200, depth: int = 8, leaf: int = 5, share: float = 0.5, seed: int = 42
) -> list[tuple[int, float, float, dict[str, float]]]:
    """J19 without permutation importance. For each repeat: R2 on training and test rows of blocks, and impurity importance; the forests of all
    repeats grow at once. Rows are told apart by their cell, where they have one."""
    from gridstrata.operators import forests
    from gridstrata.sources.catalog import stored

    which = lambda t: F.collect_list(F.when((F.col("is_test") == t) & (F.col("repeat") < repeats), F.col("repeat"))).alias("test" if t else "train")
    sets = splits.groupBy("block").agg(which(False), which(True))  # at most 324 rows
    own = df.dropna(subset=[response, *predictors]).join(F.broadcast(sets), "block")
    if "cell" not in df.columns:
        own = own.withColumn("cell", F.monotonically_increasing_id())
    rows = stored(forests.forest_rows(own, response, predictors, "cell", F.col("train"), F.col("test")), "rows")
    forest = forests.grow(rows, len(predictors), [forests.Setting(depth, leaf, 2, share)], trees, seed)
    r2 = {r.data: (r.train_r2, r.test_r2) for r in forests.scores(rows, forest, len(predictors)).collect()}  # a row a repeat
    found: dict[int, dict[str, float]] = {}
    for r in forests.impurity_importance(forest, predictors).collect():  # a row a repeat and predictor
        found.setdefault(r.data, {})[r.predictor] = r.importance
    return [(r, *r2[r], found[r]) for r in sorted(r2)]


def forest_grid(
    df: DataFrame, folds: DataFrame, response: str, predictors: list[str], depths=(8, 16), leaves=(3, 5), shares=(0.5, 1.0), trees: int = 200, seed: int = 42, at_once: int = 4
) -> DataFrame:
    """J18. depth, leaf, share, train_r2, test_r2: means over the folds of blocks. One MLlib fit for each setting and fold; folds: block, fold."""
    from itertools import product

    rows = _forest_rows(df, folds, response, predictors)
    numbers = sorted(r[0] for r in folds.select("fold").distinct().collect())  # a handful
    settings = list(product(depths, leaves, shares))

    def fold(job: tuple) -> tuple[float, float]:
        (depth, leaf, share), k = job
        return _fitted(rows.where(F.col("fold") != k), rows.where(F.col("fold") == k), response, trees, depth, leaf, share, seed)[1:]

    try:
        scores = np.array(_at_once(df.sparkSession, fold, list(product(settings, numbers)), at_once)).reshape(len(settings), len(numbers), 2).mean(axis=1)
    finally:
        rows.unpersist()
    out = [(depth, leaf, float(share), float(train), float(test)) for (depth, leaf, share), (train, test) in zip(settings, scores, strict=True)]
    return df.sparkSession.createDataFrame(out, "depth int, leaf int, share double, train_r2 double, test_r2 double")


def compare_sets(fits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """J11. By keys and set of predictors, the best first: mean, median and deviation of R2, and how many predictors are selected. fits: keys, set, repeat, test_r2, predictor, coef."""
    by = by or []
    each = fits.groupBy(*by, "set", "repeat").agg(F.first("test_r2").alias("r2"), F.count_if(F.col("coef") != 0).alias("n"))
    return each.groupBy(*by, "set").agg(F.avg("r2").alias("mean_r2"), F.median("r2").alias("median_r2"), F.stddev("r2").alias("sd_r2"), F.avg("n").alias("mean_selected")).orderBy(*by, F.desc("mean_r2"))


def overfit_gaps(results: DataFrame, most_gap: float = 0.10) -> DataFrame:
    """J23. results, one row a setting, with the gap of training over test R2, and whether it passes."""
    gap = F.col("train_r2") - F.col("test_r2")
    return results.withColumns({"gap": gap, "passes": gap <= most_gap})


def overfit_guard(results: DataFrame, most_gap: float = 0.10) -> DataFrame:
    """J23. The setting of the best test R2 among those that pass; an error if there is none."""
    best = overfit_gaps(results, most_gap).where("passes").orderBy(F.desc("test_r2")).limit(1).select(*results.columns)
    if best.isEmpty():
        raise ValueError(f"each setting's training R2 is more than {most_gap} above its test R2")
    return best
