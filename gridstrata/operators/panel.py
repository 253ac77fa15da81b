"""Period statistics, spatial aggregates, ensembles and changes of panels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.functions.columns import clip, partition, safe_ratio, season, weight, weighted_mean
from gridstrata.sources.catalog import stored

CELL = ["lat", "lon"]
#: Statistics by name; deviations and variances over all values, not a sample.
STATS = {"mean": F.avg, "std": F.stddev_pop, "var": F.var_pop, "median": F.median, "min": F.min, "max": F.max}
#: seasons' months, hydrological thresholds (mm/day).
SEASONS = {"nh_winter": [12, 1, 2], "nh_spring": [3, 4, 5], "nh_summer": [6, 7, 8], "nh_fall": [9, 10, 11]}
THRESHOLDS = {"pr": 0.822, "tran": 0.05, "mrro": 0.05}


def select_years(df: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """D1, D3."""
    return df if first is None or last is None else df.where(F.col("year").between(first, last))


def select_months(df: DataFrame, months=None) -> DataFrame:
    """D2. None, a month, a list of months, or names of seasons joined by `and`."""
    if months is None:
        return df
    if isinstance(months, str):
        months = [m for name in months.split(" and ") for m in SEASONS[name]]
    if isinstance(months, int):
        months = [months]
    if not isinstance(months, list):
        raise TypeError("months: None, int, list or season name")
    return df.where(F.col("month").isin(months))


def first_of_year(df: DataFrame, keys: list[str]) -> DataFrame:
    """D4. The first row of each year."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "year").orderBy("month"))).where("_r = 1").drop("_r")


def align_years(df: DataFrame, years: DataFrame, keys: list[str]) -> DataFrame:
    """D5. Every cell has the reference's years; those it lacks are NULL. years: one row a year."""
    return df.select(*keys).distinct().crossJoin(F.broadcast(years.select("year").distinct())).join(df, [*keys, "year"], "left")


def stats(df: DataFrame, values: list[str], names: list[str], by: list[str], suffix: str = "_{stat}") -> DataFrame:
    """E1, E2, E4-E7, E10: statistics of values by key."""
    return df.groupBy(*by).agg(*[STATS[n](v).alias(v + suffix.format(stat=n)) for v in values for n in names])


def period_stats(df: DataFrame, periods: DataFrame, values: list[str], names: list[str]) -> DataFrame:
    """E3. Statistics over several named periods from one scan. periods: experiment, period, y0, y1; a few rows."""
    hit = df.join(F.broadcast(periods), (df["experiment"] == periods["experiment"]) & df["year"].between(periods["y0"], periods["y1"])).drop(periods["experiment"])
    return stats(hit, values, names, ["period", "model", *CELL])


def with_season(df: DataFrame) -> DataFrame:
    """E7, E8. season, and season_year in which December counts to the next year."""
    return df.withColumns({"season": season(F.col("month")), "season_year": F.col("year") + (F.col("month") == 12).cast("int")})


def annual_sum(df: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """E11. Sums of daily rates over each year's days; NULL in every year of a cell that misses a month."""
    days = F.day(F.last_day(F.make_date("year", "month", F.lit(1))))
    w = Window.partitionBy(*keys)
    marked = df.select(*keys, "year", "month", *values, *[F.bool_or(F.col(v).isNull()).over(w).alias(f"_{v}") for v in values])
    return marked.groupBy(*keys, "year").agg(*[F.sum(F.when(~F.col(f"_{v}"), F.col(v) * days)).alias(v) for v in values])


def seasonality(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """E12. Deviation of the twelve monthly means."""
    return df.groupBy(*keys, "month").agg(F.avg(value).alias("m")).groupBy(*keys).agg(F.stddev_pop("m").alias(f"{value}_seasonality"))


def spatial_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """area-weighted mean, variance and deviation, plain min and max."""
    w, x = weight(F.col("lat")), F.col(value)
    mean = weighted_mean(x, w)
    out = df.groupBy(*by).agg(mean.alias("mean"), (weighted_mean(x * x, w) - mean * mean).alias("var"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.withColumn("std", F.sqrt(F.greatest("var", F.lit(0.0))))


def weighted_median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """F3. The first value at which the running weight reaches half; rows of one key are those of one map."""
    w = weight(F.col("lat"))
    rows = df.where(F.col(value).isNotNull())
    keys = Window.partitionBy(*by)
    running = F.sum(w).over(keys.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)) / F.sum(w).over(keys)
    return rows.withColumn("_c", running).where("_c >= 0.5").groupBy(*by).agg(F.min(value).alias("median"))


def regional_mean(df: DataFrame, cell_region: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """F6. Area-weighted means in each region; cell_region has a row for each cell and region."""
    w = weight(F.col("lat"))
    return df.join(cell_region, CELL).groupBy(*by, "region").agg(*[weighted_mean(F.col(v), w).alias(v) for v in values])


def region_expand(df: DataFrame, cell_region: DataFrame, values: list[str], by: list[str], with_global: bool = True) -> DataFrame:
    """F9. Rows by region, zeros as NULL; regions without a value go; optionally a region Global."""
    out = df.join(cell_region, CELL)
    out = out.unionByName(df.withColumn("region", F.lit("Global"))) if with_global else out
    out = out.withColumns({v: F.nullif(F.col(v), F.lit(0.0)) for v in values})
    there = out.groupBy(*by, "region").agg(*[F.count(v).alias(f"n_{v}") for v in values])
    return there.where(" or ".join(f"n_{v} > 0" for v in values))


def cell_area(cells: DataFrame, radius: float = 6371.0) -> DataFrame:
    """F10. km2 of each cell, by the mean spacing of coordinates."""
    spacing = lambda axis: cells.agg(((F.max(axis) - F.min(axis)) / F.nullif(F.count_distinct(axis) - 1, F.lit(0))).alias(f"d{axis}"))
    area = radius**2 * F.radians("dlat") * F.radians("dlon") * weight(F.col("lat"))
    return cells.select(*CELL).distinct().crossJoin(F.broadcast(spacing("lat"))).crossJoin(F.broadcast(spacing("lon"))).select(*CELL, area.alias("area"))  # one row each


def ensemble(df: DataFrame, values: list[str], by: list[str], name: str = "mean") -> DataFrame:
    """G1, G2. A statistic over members; rows have kind `member`."""
    return df.groupBy(*by).agg(*[STATS[name](v).alias(v) for v in values])


def change(df: DataFrame, values: list[str], base: str, relative: tuple[str, ...] = (), by: tuple[str, ...] = ("model", *CELL)) -> DataFrame:
    """G3, G4, G5. Each other period less the base, by key (model and cell); relative variables, and mrso, in percent."""
    a, b = df.where(F.col("period") != base), df.where(F.col("period") == base).select(*by, *[F.col(v).alias(f"_{v}") for v in values])
    diff = lambda v: F.col(v) - F.col(f"_{v}")
    out = {v: 100 * diff(v) / F.when(F.col(f"_{v}") != 0, F.col(f"_{v}")) if v in relative or v == "mrso" else diff(v) for v in values}
    return a.join(b, list(by)).select(F.concat("period", F.lit(f"-{base}")).alias("period"), *by, *[c.alias(v) for v, c in out.items()])


def with_changes(df: DataFrame, values: list[str], base: str, relative: tuple[str, ...] = (), by: tuple[str, ...] = ("model", *CELL)) -> DataFrame:
    """G3, G4. df's keys and values, and the rows of change(), from one pass: a key has one row a period, so its window is small."""
    key, at = Window.partitionBy(*by), F.col("period") == base
    rows = df.select(*by, "period", *values, F.bool_or(at).over(key).alias("_base"), *[F.max(F.when(at, F.col(v))).over(key).alias(f"_{v}") for v in values])
    diff = lambda v: F.col(v) - F.col(f"_{v}")
    out = [(100 * diff(v) / F.when(F.col(f"_{v}") != 0, F.col(f"_{v}")) if v in relative or v == "mrso" else diff(v)).alias(v) for v in values]
    changed = F.when(~at & F.col("_base"), F.struct(F.concat("period", F.lit(f"-{base}")).alias("period"), *out))
    return rows.select(*by, F.inline(F.array_compact(F.array(F.struct("period", *values), changed))))


def with_ensemble(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """G1, G3. Rows of kind `member`, and of kind `mean` their mean as model `ensemble mean`; by: keys but for the model, which has few rows each."""
    member = F.struct("model", *values, F.lit("member").alias("kind"))
    mean = F.struct(F.lit("ensemble mean").alias("model"), *[F.avg(v).alias(v) for v in values], F.lit("mean").alias("kind"))
    return df.groupBy(*by).agg(F.collect_list(member).alias("_rows"), mean.alias("_mean")).select(*by, F.inline(F.concat("_rows", F.array("_mean"))))


def relative_change(df: DataFrame, values: list[str], base: str, eps: float = 1e-12) -> DataFrame:
    """G6. Changes in percent of the base where its size exceeds eps, and their mean over models as model `ensemble mean`; a variable that isn't there raises."""
    if missing := [v for v in values if v not in df.columns]:
        raise KeyError(f"no such variables: {missing}")
    part = change(df.withColumns({v: F.when(F.abs(v) > eps, F.col(v)) if v in values else F.col(v) for v in values}), values, base, tuple(values))
    return part.unionByName(ensemble(part, values, ["period", *CELL]).withColumn("model", F.lit("ensemble mean")))


def combine(base: DataFrame, drivers: DataFrame, keys: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """G11. Base rows with the drivers' columns, without the models to skip; a key that the drivers lack raises while the job runs."""
    own = base.where(~F.col("model").isin(list(skip))) if skip else base
    both = own.join(drivers.withColumn("_there", F.lit(True)), keys, "left")
    lacks = F.raise_error(F.concat(F.lit("drivers lack a key of the base: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    checked = F.when(F.col("_there"), F.col(keys[0])).otherwise(lacks.cast(dict(own.dtypes)[keys[0]]))
    return both.withColumn(keys[0], checked).drop("_there")


def period_summary(df: DataFrame, periods: DataFrame, values: list[str], seasonal: list[str]) -> DataFrame:
    """E3, E12. <value>_mean and <value>_seasonality by period, model and cell, from one scan."""
    hit = df.join(F.broadcast(periods), (df["experiment"] == periods["experiment"]) & df["year"].between(periods["y0"], periods["y1"])).drop(periods["experiment"])
    keys = ["period", "model", *CELL]
    months = hit.groupBy(*keys, "month").agg(*[x for v in values for x in (F.sum(v).alias(f"s_{v}"), F.count(v).alias(f"n_{v}"))], *[F.avg(v).alias(f"m_{v}") for v in seasonal])
    mean = lambda v: F.sum(f"s_{v}") / F.nullif(F.sum(f"n_{v}"), F.lit(0))
    return months.groupBy(*keys).agg(*[mean(v).alias(f"{v}_mean") for v in values], *[F.stddev_pop(f"m_{v}").alias(f"{v}_seasonality") for v in seasonal])


def driver_product(df: DataFrame, periods: DataFrame, base: str, values: list[str], seasonal: list[str], mask: DataFrame) -> DataFrame:
    """G13. Period means and seasonality by model, masked, with changes; then the mean over models, by period and cell."""
    both = period_summary(df, periods, values, seasonal)
    own = [*[f"{v}_mean" for v in values], *[f"{v}_seasonality" for v in seasonal]]
    kept = apply_mask(both, mask, own).select("period", "model", *CELL, *own)
    return ensemble(with_changes(kept, own, base), own, ["period", *CELL])


def selected_driver_product(df: DataFrame, land: DataFrame, periods: DataFrame, base: str, values: list[str], seasonal: list[str]) -> DataFrame:
    """G14. Drivers, bgws and land use of the models that have all of them in all periods, within those models' own mask: members
    and means, with changes. Rows by period, model and cell are stored once and read for the models and for the product. land: period, model, lat, lon and land-use columns; values hold pr, tran and mrro."""
    uses = [c for c in land.columns if c not in ("period", "model", *CELL)]
    both = partition_metrics(period_summary(df, periods, values, seasonal), ["tran"], "mean").join(land, ["period", "model", *CELL], "left")
    own = [*[f"{v}_mean" for v in values], *[f"{v}_seasonality" for v in seasonal], "bgws_tran", *uses]
    both = stored(both, "drivers")
    full = common_models(both, own).withColumn("_in", in_mask(base, suffix="_mean"))
    kept = full.select("period", "model", *CELL, *[F.when(F.col("_in"), F.col(v)).alias(v) for v in own])
    return with_ensemble(with_changes(kept, own, base), own, ["period", *CELL])


def subset_ensembles(df: DataFrame, values: list[str], by: list[str], members: DataFrame) -> DataFrame:
    """G17. Means over each named set of models. members: ensemble, model; a model may be in several."""
    return df.join(members.select("ensemble", "model").distinct(), "model").groupBy("ensemble", *by).agg(*[F.avg(v).alias(v) for v in values])


def monthly_product(df: DataFrame, periods: DataFrame, base: str, values: list[str], mask: DataFrame) -> DataFrame:
    """G15. As period_product for each calendar month: climatology, bgws, mask, changes, mean over models."""
    hit = df.join(F.broadcast(periods), (df["experiment"] == periods["experiment"]) & df["year"].between(periods["y0"], periods["y1"])).drop(periods["experiment"])
    clim = partition_metrics(stats(hit, values, ["mean"], ["period", "model", *CELL, "month"], "_clim"), ["tran"], "clim")
    kept = apply_mask(clim, mask, ["bgws_tran"]).select("period", "model", *CELL, "month", "bgws_tran")
    return ensemble(with_changes(kept, ["bgws_tran"], base, by=("model", *CELL, "month")), ["bgws_tran"], ["period", *CELL, "month"])


def sustain_lulcc(df: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """C17. Half the effect of land use under ssp126 and half that under ssp370; one row for each key and experiment."""
    of = lambda e, v: F.max(F.when(F.col("experiment") == e, F.col(v)))
    return df.groupBy(*keys).agg(*[(0.5 * (of("ssp126", v) - of("ssp126-ssp370Lu", v)) + 0.5 * (of("ssp370-ssp126Lu", v) - of("ssp370", v))).alias(v) for v in values])


def sustain_product(df: DataFrame, values: list[str], mask: DataFrame, derive: Callable[[DataFrame], DataFrame] | None = None, derived: tuple[str, ...] = (), by: tuple[str, ...] = (), with_mean: bool = True) -> DataFrame:
    """G17. Means over the period by experiment, what derive makes of them, the land-use effect of each model (C17), its mean over models as
    model `ensemble mean` where asked for, and the mask. by: further keys, such as the season."""
    keys = ["model", *CELL, *by]
    means = stats(df, values, ["mean"], ["experiment", *keys], "")
    own = [*values, *derived]
    effect = sustain_lulcc(derive(means) if derive else means, own, keys)
    rows = with_ensemble(effect, own, [*CELL, *by]) if with_mean else effect.withColumn("kind", F.lit("member"))
    return apply_mask(rows, mask, own).select("model", *CELL, *by, *own, "kind")


def land_use_history(df: DataFrame, values: list[str], mask: DataFrame, members: DataFrame, derive: Callable[[DataFrame], DataFrame] | None = None, derived: tuple[str, ...] = (), experiment: str = "historical", without: str = "hist-noLu") -> DataFrame:
    """G17. What land use did: means of the experiment less those of the one without it, by model, then their means over each named set of
    models as a model of that name, within the mask. A model that lacks one of the two has no row. members: ensemble, model."""
    means = stats(df, values, ["mean"], ["experiment", "model", *CELL], "")
    means, own = derive(means) if derive else means, [*values, *derived]
    of = lambda e, v: F.max(F.when(F.col("experiment") == e, F.col(v)))
    there = F.count_distinct(F.when(F.col("experiment").isin(experiment, without), F.col("experiment")))
    effect = means.groupBy("model", *CELL).agg(there.alias("_n"), *[(of(experiment, v) - of(without, v)).alias(v) for v in own]).where("_n = 2").drop("_n")
    sets = subset_ensembles(effect, own, list(CELL), members).withColumnRenamed("ensemble", "model")
    return apply_mask(effect.unionByName(sets), mask, own).select("model", *CELL, *own)


def to_celsius(df: DataFrame, value: str = "tas", by: tuple[str, ...] = ("model",), mean: float = 150, most: float = 100) -> DataFrame:
    """C18. Kelvin by the values: a group whose mean or maximum is too large for deg C is converted. Groups are summed before they are joined back."""
    kelvin = df.groupBy(*by).agg(((F.avg(value) > mean) | (F.max(value) > most)).alias("_kelvin"))
    return df.join(kelvin, list(by)).withColumn(value, F.when(F.col("_kelvin"), F.col(value) - 273.15).otherwise(F.col(value))).drop("_kelvin")


def regional_series(df: DataFrame, mask: DataFrame, cell_region: DataFrame) -> DataFrame:
    """F7. Yearly regional series of masked cells by model: means, bgws, storage change and residual."""
    values = ["pr", "mrro", "tran", "evapo", "mrso"]
    yearly = df.join(mask, CELL, "left_semi").groupBy("model", *CELL, "year").agg(*[F.avg(v).alias(v) for v in values])
    return partition_metrics(budget_series(regional_mean(yearly, cell_region, values, ["model", "year"]), ["model", "region"]), ["tran"], "")

def hydro_mask(df: DataFrame, thresholds: dict[str, float] = THRESHOLDS, suffix: str = "") -> DataFrame:
    """G7, G9. lat, lon of cells whose ensemble means exceed all thresholds."""
    means = df.groupBy(*CELL).agg(*[F.avg(v + suffix).alias(v) for v in thresholds])
    return means.where(" and ".join(f"{v} > {t}" for v, t in thresholds.items())).select(*CELL)


def in_mask(base: str, thresholds: dict[str, float] = THRESHOLDS, suffix: str = "") -> Column:
    """G7. As hydro_mask, for the rows of period means themselves: whether the cell's ensemble means of the base exceed all thresholds."""
    cell, out = Window.partitionBy(*CELL), F.lit(True)
    for v, least in thresholds.items():
        out = out & (F.avg(F.when(F.col("period") == base, F.col(v + suffix))).over(cell) > least)
    return F.coalesce(out, F.lit(False))


def apply_mask(df: DataFrame, mask: DataFrame, values: list[str]) -> DataFrame:
    """G8. Values outside the mask become NULL; cells stay. mask: one row a cell."""
    return df.join(mask.withColumn("_in", F.lit(True)), CELL, "left").withColumns({v: F.when(F.col("_in"), F.col(v)) for v in values}).drop("_in")


def common_models(df: DataFrame, values: list[str]) -> DataFrame:
    """G10. Rows of the models that have all values in all periods."""
    have = df.groupBy("model", "period").agg(*[F.count(v).alias(v) for v in values])  # a few rows
    full = have.where(" and ".join(f"{v} > 0" for v in values)).groupBy("model").agg(F.count("*").alias("n")).join(have.agg(F.count_distinct("period").alias("n")), "n")
    return df.join(full.select("model"), "model", "left_semi")


def partition_metrics(df: DataFrame, terms: list[str], suffix: str) -> DataFrame:
    """C9, C10. bgws of each term, and the shares of precipitation."""
    col = lambda v: F.col(f"{v}_{suffix}" if suffix else v)
    out = {f"bgws_{t}": partition(col("mrro"), col(t), col("pr")) for t in terms}
    return df.withColumns(out | {"r_over_p": safe_ratio(col("mrro"), col("pr")), "et_over_p": safe_ratio(col("tran"), col("pr"))})


def period_product(df: DataFrame, periods: DataFrame, base: str, values: list[str]) -> DataFrame:
    """G12. Period means, partition metrics, hydrological mask, changes, and ensemble means of both: one scan of the panel, then
    windows over cells that hold a row for each model and period."""
    means = partition_metrics(period_stats(df, periods, values, ["mean"]), ["tran"], "mean")
    own = [f"{v}_mean" for v in values] + ["bgws_tran"]
    kept = means.withColumn("_in", in_mask(base, suffix="_mean")).select("period", "model", *CELL, *[F.when(F.col("_in"), F.col(v)).alias(v) for v in own])
    return with_ensemble(with_changes(kept, own, base), own, ["period", *CELL])


def budget_series(df: DataFrame, by: list[str]) -> DataFrame:
    """C19, C20. Storage change and water-balance residual of yearly series with pr, mrro, evapo (mm/day) and mrso (mm)."""
    ds = F.col("mrso") - F.lag("mrso").over(Window.partitionBy(*by).orderBy("year"))
    out = df.withColumn("dS", ds).withColumn("p_year", F.when(F.col("pr") * 365 > 1e-6, F.col("pr") * 365))
    residual = 365 * (F.col("pr") - F.col("mrro") - F.col("evapo")) - F.col("dS")
    return out.withColumns({"dS_over_P": F.col("dS") / F.col("p_year") * 100, "residual": residual, "residual_pct": residual / F.col("p_year") * 100}).drop("p_year")


def rx1day(df: DataFrame, keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """C5. Yearly maximum of daily pr; NULL for a year that misses a day."""
    year = F.year("day").alias("year")
    out = df.groupBy(*keys, year).agg(F.max("pr").alias("most"), F.count("pr").alias("n"))
    return out.select(*keys, "year", F.when(F.col("n") == F.dayofyear(F.make_date("year", F.lit(12), F.lit(31))), F.col("most")).alias("rx1day"))


def rx5day_ratio(yearly: DataFrame, monthly: DataFrame, keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """C7. rx5day over the year's precipitation by its monthly means; NULL where that isn't positive."""
    total = monthly.groupBy(*keys, "year").agg((F.avg("pr") * 365).alias("total"))
    return yearly.join(total, [*keys, "year"]).select(*keys, "year", (F.col("rx5day") / F.when(F.col("total") > 0, F.col("total"))).alias("rx5day_ratio"))


#: States of land use in each class.
LAND_USE = {"forest": ["primf", "secdf"], "cropland": ["c3ann", "c4ann", "c3per", "c4per", "c3nfx"], "grazing_land": ["pastr", "range"], "natural_non_forest": ["primn", "secdn"]}


def land_use(df: DataFrame) -> DataFrame:
    """C14. Percent of each class."""
    return df.withColumns({name: sum((F.col(c) for c in states[1:]), F.col(states[0])) * 100 for name, states in LAND_USE.items()})


def carbon(df: DataFrame) -> DataFrame:
    """C15. Ratios and wood carbon, each where its inputs are there; NULL where the divisor is 0."""
    over = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    if {"cVeg", "cLeaf", "cRoot"} <= set(df.columns):
        df = df.withColumn("cWood", F.col("cVeg") - F.col("cLeaf") - F.col("cRoot"))
    ratios = {"cVeg_nVeg": ("cVeg", "nVeg"), "lai_cLeaf": ("lai", "cLeaf"), "f_leaf": ("cLeaf", "cVeg"), "f_root": ("cRoot", "cVeg"), "f_wood": ("cWood", "cVeg")}
    return df.withColumns({name: over(a, b) for name, (a, b) in ratios.items() if {a, b} <= set(df.columns)})


def rolling_max(df: DataFrame, days: int = 5, keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """C5, C6. Yearly maxima of daily pr and of its running sums; windows with a missing day are NULL."""
    seconds = F.unix_date("day")
    w = Window.partitionBy(*keys).orderBy(seconds).rangeBetween(1 - days, 0)
    total = F.when(F.count("pr").over(w) == days, F.sum("pr").over(w))
    rows = df.select(*keys, F.year("day").alias("year"), "pr", total.alias("t"))
    return rows.groupBy(*keys, "year").agg(F.max("pr").alias("rx1day"), F.max("t").alias(f"rx{days}day"))


def scale(x: Column, limit: Column) -> Column:
    """I12. Signed value on [-1, 1]; 0 where the limit is."""
    return F.when(limit == 0, 0.0).otherwise(clip(x / F.nullif(limit, F.lit(0.0)), -1, 1))
