"""Time-series statistics by cell, and correlations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def detrend(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """I1. Residual of the least-squares line against position; NULL with fewer than two values."""
    cell = Window.partitionBy(*keys)
    rows = df.withColumn("_x", (F.row_number().over(cell.orderBy(*order)) - 1).cast("double"))
    slope, at = F.regr_slope(value, "_x").over(cell), F.regr_intercept(value, "_x").over(cell)
    return rows.withColumn("detrended", F.when(F.count(value).over(cell) >= 2, F.col(value) - (slope * F.col("_x") + at))).drop("_x")


def deseasonalise(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """I2. Less the mean of the same calendar month."""
    return df.withColumn("anomaly", F.col(value) - F.avg(value).over(Window.partitionBy(*keys, "month")))


def _inversions(ranks: np.ndarray) -> int:
    """Pairs in which the larger of two ranks comes first: counted at each bit, from the highest, among ranks equal above it."""
    total = 0
    for bit in reversed(range(int(ranks.max()).bit_length())):
        one, above = ranks >> bit & 1, ranks >> (bit + 1)
        ones = np.concatenate([[0], np.cumsum(one)])
        before = ones[1:] - ones[np.searchsorted(above, above)]
        total += int(before[one == 0].sum())
        ranks = ranks[np.argsort(ranks >> bit, kind="stable")]
    return total


def tau_b(a: np.ndarray, b: np.ndarray) -> float | None:
    """Kendall's tau-b of two arrays, n log n; None with fewer than two values, or where one side is constant."""
    x, y = (np.unique(c, return_inverse=True)[1].reshape(-1) for c in (a, b))
    if len(x) < 2:
        return None
    tied = lambda ranks: int(sum(n * (n - 1) // 2 for n in np.unique(ranks, return_counts=True)[1].tolist()))
    pairs, tx, ty, both = len(x) * (len(x) - 1) // 2, tied(x), tied(y), tied(x * (int(y.max()) + 1) + y)
    if pairs in (tx, ty):
        return None
    return (pairs - tx - ty + both - 2 * _inversions(y[np.lexsort((y, x))])) / (float(pairs - tx) * float(pairs - ty)) ** 0.5


def kendall(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """I3. Kendall's tau-b of each cell over complete pairs; NULL with fewer than two, or where one side is constant.

    A cell's series is an array of bounded length (months of a period); Arrow hands batches of them to numpy, which counts
    discordant pairs in n log n.
    """

    def tau(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([tau_b(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    series = [F.collect_list(F.col(c).cast("double")).alias(n) for c, n in ((a, "_a"), (b, "_b"))]
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(*series)
    return rows.select(*keys, F.nanvl(F.pandas_udf(tau, DoubleType())("_a", "_b"), F.lit(None)).alias("tau"))


def anomalies(values: np.ndarray, months: np.ndarray) -> np.ndarray:
    """I1 and I2 of one series in order, NaN where a value isn't known: the residual of the line against position, less its mean by calendar
    month. All NaN with fewer than two values."""
    known = np.isfinite(values)
    if known.sum() < 2:
        return np.full(len(values), np.nan)
    x, y = np.arange(len(values), dtype=float)[known], values[known]
    dx = x - x.mean()
    rest = y - y.mean() - dx * ((dx * (y - y.mean())).sum() / (dx * dx).sum())
    _, at = np.unique(months[known], return_inverse=True)
    rest -= (np.bincount(at, rest) / np.bincount(at))[at]
    out = np.full(len(values), np.nan)
    out[known] = rest
    return out


def eli(df: DataFrame, soil: str, energy: str, et: str, keys: list[str]) -> DataFrame:
    """I4. tau(soil', et') - tau(energy', et') of detrended, deseasonalised series.

    One scan and one shuffle: a cell's three series are one array of bounded length (months of a period), in order of time, and Arrow
    hands batches of them to numpy, which detrends, takes the seasons off and counts both taus."""

    def both(rows: pd.Series) -> pd.DataFrame:
        out = []
        for cell in rows:
            months = np.array([r["month"] for r in cell], int)
            a, b, c = (anomalies(np.array([np.nan if r[n] is None else r[n] for r in cell], float), months) for n in "abc")
            pair = lambda x, c=c: tau_b(x[k], c[k]) if (k := np.isfinite(x) & np.isfinite(c)).any() else None
            out.append((pair(a), pair(b)))
        return pd.DataFrame(out, columns=["s", "e"]).astype("float64")

    row = F.struct("year", "month", *[F.col(v).cast("double").alias(n) for v, n in ((soil, "a"), (energy, "b"), (et, "c"))])
    cells = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    taus = cells.select(*keys, F.pandas_udf(both, "s double, e double")("rows").alias("t"))
    known = lambda n: F.nanvl(F.col(f"t.{n}"), F.lit(None))
    return taus.select(*keys, known("s").alias(f"tau_{soil}"), known("e").alias(f"tau_{energy}")).withColumn("eli", F.col(f"tau_{soil}") - F.col(f"tau_{energy}"))


def pearson_and_bias(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """I5, I6. Over rows where both are known: r, mean difference, means, slope and intercept of a on b."""
    x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c)) for c in (a, b))
    return df.groupBy(*by).agg(
        F.corr(x, y).alias("r"), F.avg(x - y).alias("bias"), F.avg(x).alias(f"mean_{a}"), F.avg(y).alias(f"mean_{b}"), F.regr_slope(x, y).alias("slope"), F.regr_intercept(x, y).alias("intercept"), F.count(x).alias("n")
    )


#: Buckets that a key's values are cut into where ranks are counted.
BUCKETS = 64


def value_ranks(df: DataFrame, value: str, by: list[str], times: Column | None = None) -> DataFrame:
    """The distinct values of each key (not NULL), with n (how often), before (rows with smaller ones) and total.

    Values are counted, cut into buckets by approximate quantiles, and summed up within buckets from the bucket's start, so
    that no task holds all values of a key. Where the cuts lie has no effect on the result. times: rows that a row stands for.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(F.lit(1) if times is None else times).alias("n"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit(k / BUCKETS) for k in range(1, BUCKETS)]), F.lit(1000)).alias("_cuts"))
    located = counts.join(cuts, by) if by else counts.crossJoin(F.broadcast(cuts))  # one row
    located = located.withColumn("_k", F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).drop("_cuts")
    key = Window.partitionBy(*by)  # a row for each bucket
    starts = located.groupBy(*by, "_k").agg(F.sum("n").alias("_n"))
    starts = starts.select(*by, "_k", (F.sum("_n").over(key.orderBy("_k")) - F.col("_n")).alias("_start"), F.sum("_n").over(key).alias("total"))
    within = F.sum("n").over(Window.partitionBy(*by, "_k").orderBy(value)) - F.col("n")
    return located.join(starts, [*by, "_k"]).select(*by, value, "n", (F.col("_start") + within).alias("before"), "total")


def quantiles(df: DataFrame, value: str, shares: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """by, q: exact quantiles of the values that are known, interpolated between neighbours, as an array; no key, one row."""
    ranks = value_ranks(df, value, list(by))
    place = [F.lit(p) * (F.col("total") - 1) for p in shares]
    at = lambda x: F.max(F.when((F.col("before") <= x) & (x < F.col("before") + F.col("n")), F.col(value)))
    ends = ranks.groupBy(*by).agg(F.max("total").alias("total"), *[e for i, x in enumerate(place) for e in (at(F.floor(x)).alias(f"_lo{i}"), at(F.ceil(x)).alias(f"_hi{i}"))])
    return ends.select(*by, F.array(*[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (x - F.floor(x)) for i, x in enumerate(place)]).alias("q"))


def stacked(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """variable, x: a row for each of the named values of a row."""
    rows = F.array(*[F.struct(F.lit(n).alias("variable"), c.cast("double").alias("x")) for n, c in values.items()])
    return df.select(F.inline(rows))


def spearman(df: DataFrame, a: str, b: str, by: list[str], weight: Column | None = None) -> DataFrame:
    """I7, I8. Correlation of average ranks over rows where both are known, optionally weighted; keys aren't NULL."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_w", F.lit(1.0) if weight is None else weight)
    joint = rows.groupBy(*by, a, b).agg(F.count("*").alias("_n"), F.sum("_w").alias("_w"))
    rank = lambda c, name: value_ranks(joint, c, by, F.col("_n")).select(*by, c, (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    r = joint.join(rank(a, "_x"), [*by, a]).join(rank(b, "_y"), [*by, b])
    mean = lambda x: F.sum(x * F.col("_w")) / F.sum("_w")
    x, y = F.col("_x"), F.col("_y")
    cov, vx, vy = mean(x * y) - mean(x) * mean(y), mean(x * x) - mean(x) * mean(x), mean(y * y) - mean(y) * mean(y)
    return r.groupBy(*by).agg((cov / F.nullif(F.sqrt(F.greatest(vx * vy, F.lit(0.0))), F.lit(0.0))).alias("rho"), F.sum("_n").alias("n"))


def density(df: DataFrame, a: str, b: str, bins: int = 70, low: float = 0.08, high: float = 0.85) -> DataFrame:
    """I9. Rows in the histogram bin of each row, scaled to [low, high]."""
    lim = df.agg(*[f(c).alias(f"{n}_{c}") for c in (a, b) for n, f in (("lo", F.min), ("hi", F.max))])
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)) * bins), F.lit(bins - 1))
    rows = df.crossJoin(F.broadcast(lim)).withColumns({"bx": at(a), "by": at(b)})  # one row
    counts = rows.groupBy("bx", "by").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("bx", "by", "n", (low + (high - low) * F.col("n") / F.col("most")).alias("alpha"))  # one row


def robust_limits(df: DataFrame, value: str) -> DataFrame:
    """I10. Percentiles 2.5 and 97.5, zero included, padded by 4 %."""
    p = quantiles(df, value, (0.025, 0.975)).select(F.least(F.col("q")[0], F.lit(0.0)).alias("lo"), F.greatest(F.col("q")[1], F.lit(0.0)).alias("hi"))
    return p.select((F.col("lo") - 0.04 * (F.col("hi") - F.col("lo"))).alias("lo"), (F.col("hi") + 0.04 * (F.col("hi") - F.col("lo"))).alias("hi"))


def nice_bound(x: Column) -> Column:
    """I15. The size of x rounded up to one leading digit; 0 for 0."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.ceil(F.abs(x) / step) * step)


def zscore(df: DataFrame, values: list[str]) -> DataFrame:
    """I11. Values standardised over the whole table."""
    m = df.agg(*[x for v in values for x in (F.avg(v).alias(f"m_{v}"), F.stddev_pop(v).alias(f"s_{v}"))])
    z = {v: (F.col(v) - F.col(f"m_{v}")) / F.nullif(F.col(f"s_{v}"), F.lit(0.0)) for v in values}
    return df.crossJoin(F.broadcast(m)).withColumns(z).select(*df.columns)  # one row


def pairwise(df: DataFrame, values: list[str]) -> DataFrame:
    """I13. Pearson's r of each ordered pair of variables, in one pass."""
    pairs = [(a, b) for a in values for b in values if a != b]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]))
    return wide.select(rows.alias("x")).select("x.*")


def describe(df: DataFrame, values: list[str]) -> DataFrame:
    """I14, I15. Count, mean, deviation, extremes and exact quartiles of each value."""
    wide = df.agg(*[F.struct(F.lit(v).alias("variable"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max")).alias(v) for v in values])
    rows = wide.select(F.inline(F.array(*values)))
    quarters = quantiles(stacked(df, {v: F.col(v) for v in values}), "x", (0.25, 0.5, 0.75), ("variable",))
    return rows.join(quarters, "variable", "left").select("variable", "n", "mean", "sd", "min", *[F.col("q")[i].alias(f"q{25 * (i + 1)}") for i in range(3)], "max")
