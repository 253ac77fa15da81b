"""Regimes, agreement between models, classifications and areas of change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.functions.columns import share, weight
from gridstrata.operators.panel import CELL
from gridstrata.operators.series import quantiles, stacked


def area() -> Column:
    """A cell's weight by its latitude."""
    return weight(F.col("lat"))


def regime(x: Column, base: str, variable: str) -> Column:
    """H1. Positive or Negative <Base> <VARIABLE>; zero and NULL are in neither."""
    name = f"{base.capitalize()} {variable.upper()}"
    return F.when(x > 0, f"Positive {name}").when(x < 0, f"Negative {name}")


def subdivide(df: DataFrame, base: DataFrame, label: str = "regime") -> DataFrame:
    """H2, H4. Each row gets its cell's regime. base: lat, lon, regime; one row a cell."""
    return df.join(base.select(*CELL, label), CELL)


def sign_agreement(df: DataFrame, value: str, least_share: float = 0.8, least_valid: float = 0.75) -> DataFrame:
    """H3, H5. By cell: shares of all models with a positive or negative value, valid models, the mean, and whether they agree."""
    x = F.col(value)
    out = df.groupBy(*CELL).agg(
        F.avg(F.when(x > 0, 1.0).otherwise(0.0)).alias("positive"), F.avg(F.when(x < 0, 1.0).otherwise(0.0)).alias("negative"),
        F.sum(F.when(x != 0, 1).otherwise(0)).alias("n_valid"), F.count("*").alias("n"), F.avg(x).alias("mean"),
    )
    majority = F.greatest("positive", "negative")
    return out.withColumns({"majority": majority, "confident": (majority >= least_share) & (F.col("n_valid") >= F.ceil(least_valid * F.col("n")))})


def low_agreement(majority: Column, most: float = 0.70, least: float = 0.54545455) -> Column:
    """H5, H6."""
    return F.coalesce((majority < most) & (majority >= least), F.lit(False))


def low_count(df: DataFrame, value: str, mean: DataFrame, least: int = 8) -> DataFrame:
    """H7. Whether fewer than `least` models share a sign, where the ensemble mean is known. mean: lat, lon, mean."""
    n = df.groupBy(*CELL).agg(F.greatest(F.count_if(F.col(value) > 0), F.count_if(F.col(value) < 0)).alias("n_same"))
    return n.join(mean, CELL).select(*CELL, "n_same", F.when(F.col("mean").isNotNull(), F.col("n_same") < least).alias("low"))


def quadrant(a: Column, b: Column, ta: float = 0.0, tb: float = 0.0) -> Column:
    """H8. 0 ++, 1 +-, 2 -+, 3 --; NULL within the thresholds."""
    return F.when((a > ta) & (b > tb), 0).when((a > ta) & (b < -tb), 1).when((a < -ta) & (b > tb), 2).when((a < -ta) & (b < -tb), 3)


def low_quadrant_agreement(df: DataFrame, q: str = "quadrant", least: int = 8, least_valid: float = 0.55) -> DataFrame:
    """H9."""
    counts = [F.count_if(F.col(q) == k) for k in range(4)]
    out = df.groupBy(*CELL).agg(F.greatest(*counts).alias("best"), F.count(q).alias("valid"), F.count("*").alias("n"))
    low = (F.col("best") < least) | (F.col("valid") < F.ceil(least_valid * F.col("n")))
    return out.select(*CELL, "best", "valid", F.when(F.col("valid") > 0, low).alias("low"))


def quadrant_areas(df: DataFrame, q: str = "quadrant", low: str = "low") -> DataFrame:
    """H10. Area in percent of each quadrant: all, robust, and uncertain. df: one map."""
    total = F.sum(F.when(F.col(q).isNotNull(), area()))
    part = lambda k, c: 100 * F.sum(F.when(c, area()).otherwise(0.0)) / F.nullif(total, F.lit(0.0))
    robust = lambda k: (F.col(q) == k) & ~F.coalesce(F.col(low), F.lit(False))
    wide = df.agg(*[part(k, F.col(q) == k).alias(f"t{k}") for k in range(4)], *[part(k, robust(k)).alias(f"r{k}") for k in range(4)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("quadrant"), F.col(f"t{k}").alias("total"), F.col(f"r{k}").alias("robust")) for k in range(4)]))
    return wide.select(rows.alias("r")).select("r.*").withColumn("uncertain", F.greatest(F.col("total") - F.col("robust"), F.lit(0.0)))


def magnitude_bins(df: DataFrame, a: str, b: str, q: Column) -> DataFrame:
    """H11. Joint magnitude on the scale of 90th percentiles, in three bins at its terciles, and the class quadrant * 3 + bin."""
    ninety = quantiles(stacked(df, {c: F.abs(c) for c in (a, b)}), "x", (0.9,), ("variable",))
    ninety = ninety.agg(*[F.max(F.when(F.col("variable") == c, F.col("q")[0])).alias(f"p_{c}") for c in (a, b)])
    joint = df.crossJoin(F.broadcast(ninety)).withColumn("joint", F.greatest(F.abs(a) / F.col(f"p_{a}"), F.abs(b) / F.col(f"p_{b}"))).drop(f"p_{a}", f"p_{b}")  # one row
    cuts = quantiles(joint, "joint", (0.3333, 0.6667)).withColumnRenamed("q", "cuts")
    m = F.when(F.col("joint") <= F.col("cuts")[0], 0).when(F.col("joint") <= F.col("cuts")[1], 1).when(F.col("joint").isNotNull(), 2)
    return joint.crossJoin(F.broadcast(cuts)).withColumns({"magnitude": m, "class": q * 3 + m}).drop("cuts")


def change_category(base: Column, change: Column) -> Column:
    """H12."""
    return F.when((base < 0) & (change < 0), "Greener").when((base < 0) & (change > 0), "Less green").when((base > 0) & (change < 0), "Less blue").when((base > 0) & (change > 0), "Bluer")


def areas(df: DataFrame, label: Column, by: list[str] | None = None, count: str | None = None) -> DataFrame:
    """F11, H12, H14, H19. Area of each label in percent of all labelled area, by key; count: a column for the number of rows."""
    keys = by or []
    parts = df.withColumn("label", label).where("label is not null").groupBy(*keys, "label").agg(F.sum(area()).alias("w"), F.count("*").alias("_n"))
    whole = F.sum("w").over(Window.partitionBy(*keys))  # a row for each label
    return parts.select(*keys, "label", *([F.col("_n").alias(count)] if count else []), (100 * F.col("w") / whole).alias("percent"))


def flips(df: DataFrame, base: str, future: str, by: list[str]) -> DataFrame:
    """F12, H16. Area in percent that goes from + to - and from - to +, of the area where the base is known."""
    a, b = F.col(base), F.col(future)
    known = F.when(a.isNotNull(), F.lit(True))
    return df.groupBy(*by).agg(share(known & F.coalesce((a > 0) & (b < 0), F.lit(False)), area()).alias("pos_to_neg"), share(known & F.coalesce((a < 0) & (b > 0), F.lit(False)), area()).alias("neg_to_pos"))


def flip_spread(per_model: DataFrame) -> DataFrame:
    """H16. Mean and half-width of the 95 % interval over models."""
    half = lambda c: 1.96 * F.stddev_samp(c) / F.sqrt(F.count(c))
    return per_model.agg(*[x for c in ("pos_to_neg", "neg_to_pos") for x in (F.avg(c).alias(c), half(c).alias(f"{c}_half"))])


def flipped(base: Column, future: Column) -> Column:
    """H17. The future value where its sign isn't the base's."""
    return F.when(F.signum(base) != F.signum(future), future)


def disagreement(mean: Column, ref_a: Column, ref_b: Column) -> Column:
    """H13. The ensemble's sign differs from both references'; all known and not zero."""
    s = F.signum(mean)
    return F.coalesce((s != 0) & (F.signum(ref_a) == -s) & (F.signum(ref_b) == -s), F.lit(False))


def increase_decrease(change: Column, least: float = 0.0) -> tuple[Column, Column]:
    """H18."""
    return F.coalesce(change > least, F.lit(False)), F.coalesce(change < -least, F.lit(False))


def confidence_classes(df: DataFrame, value: str) -> DataFrame:
    """H19, H20. By cell: 1 confident and positive, 2 confident and negative, 3 masked; with the agreement's columns."""
    return sign_agreement(df, value).withColumn("class", F.when(~F.col("confident"), 3).when(F.col("mean") > 0, 1).when(F.col("mean") < 0, 2).otherwise(3))


def three_way(a: Column, b: Column, c: Column, eps: float = 0.0) -> Column:
    """H14. 0 all near zero, 1 all +, 2 all -, 3 two share a sign, 4 no two do; NULL where one is unknown."""
    sign = [F.when(x > eps, 1).when(x < -eps, -1).otherwise(0) for x in (a, b, c)]
    pos, neg = (sum((F.when(s == k, 1).otherwise(0) for s in sign), F.lit(0)) for k in (1, -1))
    known = a.isNotNull() & b.isNotNull() & c.isNotNull()
    return F.when(known, F.when(pos == 3, 1).when(neg == 3, 2).when((pos == 0) & (neg == 0), 0).when((pos == 2) | (neg == 2), 3).otherwise(4))


def limitation_regime(df: DataFrame, water: str, energy: str, seasonal: str) -> DataFrame:
    """H15. 1 water, 2 energy, 3 seasonality: the largest of -z(water), -z(energy), z(seasonality); the first of ties."""
    moments = df.agg(*[x for c in (water, energy, seasonal) for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    z = lambda c: F.when(F.col(f"s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)))
    a, b, c = -z(water), -z(energy), z(seasonal)
    label = F.when((a >= b) & (a >= c), 1).when(b >= c, 2).when(c.isNotNull(), 3)
    return df.crossJoin(F.broadcast(moments)).withColumn("limit", label).select(*df.columns, "limit")  # one row


def band(lat: Column) -> Column:
    """F14."""
    a = F.abs(lat)
    return F.when(a > 60, ">60").when(a >= 40, "40-60").when(a >= 20, "20-40").otherwise("<20")
