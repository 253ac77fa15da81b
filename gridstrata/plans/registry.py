"""Queries over the fixture views, and the same in DuckDB SQL. Doubles are rounded to six places in both, after a nudge that
settles decimal ties alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstrata.functions import columns as C
from gridstrata.operators import conform, panel, regimes, regress, series
from gridstrata.sources import catalog
from gridstrata.sources.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NUDGE = 1.3e-10
CELL, PERIODS = panel.CELL, [("historical", "hist", 1995, 1997), ("ssp370", "near", 1998, 1999), ("ssp370", "far", 2000, 2001)]
_PERIODS_SQL = "(VALUES ('historical','hist',1995,1997),('ssp370','near',1998,1999),('ssp370','far',2000,2001)) periods(experiment, period, y0, y1)"
#: Bands of latitude and halves of longitude stand in for polygons.
_REGION_SQL = "CASE WHEN lat < -20 THEN 'S' WHEN lat < 20 THEN 'T' ELSE 'N' END || CASE WHEN lon < 0 THEN 'W' ELSE 'E' END"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{c}`") + NUDGE, 6) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query; doubles: its columns of that type."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: _rounded(f(lambda n: view(spark, sf_dir, n), spark))
        if sql:
            replaced = ", ".join(f"round({c} + {NUDGE}, 6) + 0.0 AS {c}" for c in doubles.split())
            inner = with_views(sql)
            ORACLE_SQL[name] = f"SELECT * REPLACE ({replaced}) FROM ({inner})" if replaced else inner
        return f

    return add


def periods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PERIODS, "experiment string, period string, y0 int, y1 int")


def region(df: DataFrame) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    name = F.concat(F.when(lat < -20, "S").when(lat < 20, "T").otherwise("N"), F.when(lon < 0, "W").otherwise("E"))
    return df.select(*CELL).distinct().withColumn("region", name)


_MEANS = f"""means AS (SELECT period, model, lat, lon, avg(pr) AS pr_mean, avg(tran) AS tran_mean, avg(mrro) AS mrro_mean FROM panel_month p JOIN {_PERIODS_SQL} ON p.experiment = periods.experiment AND p.year BETWEEN y0 AND y1 GROUP BY ALL),
b AS (SELECT *, least(greatest((mrro_mean - tran_mean) / (CASE WHEN pr_mean > 1e-12 THEN pr_mean END) * 100, -100), 100) AS bgws_tran FROM means),
msk AS (SELECT lat, lon FROM b WHERE period = 'hist' GROUP BY ALL HAVING avg(pr_mean) > 0.822 AND avg(tran_mean) > 0.05 AND avg(mrro_mean) > 0.05)"""


def _cte(sql: str, select: str) -> str:
    """A select over fixture views and further CTEs."""
    text = with_views(sql)
    return f"{text}, {select}" if text.startswith("WITH") else text


def means(v, spark) -> DataFrame:
    return panel.partition_metrics(panel.period_stats(v("panel_month"), periods(spark), ["pr", "tran", "mrro"], ["mean"]), ["tran"], "mean")


def masked(v, spark) -> DataFrame:
    return means(v, spark).withColumn("_in", panel.in_mask("hist", suffix="_mean")).where("_in").drop("_in")


def product(v, spark) -> DataFrame:
    return panel.period_product(v("panel_month"), periods(spark), "hist", ["pr", "tran", "mrro"])


def add_cte(name: str, ctes: str, final: str, doubles: str):
    """query() whose SQL has further CTEs after the views."""
    from gridstrata.sources.fixtures import SQL

    used = [n for n in SQL if n in ctes or n in final]
    text = "WITH " + ", ".join([f"{n} AS ({SQL[n]})" for n in used] + [ctes]) + " " + final

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: _rounded(f(lambda n: view(spark, sf_dir, n), spark))
        replaced = ", ".join(f"round({c} + {NUDGE}, 6) + 0.0 AS {c}" for c in doubles.split())
        ORACLE_SQL[name] = f"SELECT * REPLACE ({replaced}) FROM ({text})" if replaced else text
        return f

    return add


W = "cos(radians(lat))"


@add_cte("g0_partition_by_period", _MEANS + ", k AS (SELECT b.* FROM b JOIN msk USING (lat, lon)), e AS (SELECT period, model, lat, lon, bgws_tran FROM k UNION ALL SELECT period, 'ensemble mean', lat, lon, avg(bgws_tran) FROM k GROUP BY period, lat, lon)",
         f"SELECT period, model, sum(bgws_tran * {W}) / nullif(sum(CASE WHEN bgws_tran IS NOT NULL THEN {W} END), 0) AS bgws FROM e GROUP BY period, model", "bgws")
def _(v, spark):
    m = masked(v, spark).select("period", "model", *CELL, "bgws_tran")
    both = m.unionByName(panel.ensemble(m, ["bgws_tran"], ["period", *CELL]).withColumn("model", F.lit("ensemble mean")))
    return both.groupBy("period", "model").agg(C.weighted_mean(F.col("bgws_tran"), C.weight(F.col("lat"))).alias("bgws"))


# --- catalogue ---
query("a2_models_with_all", "SELECT source_id FROM catalog WHERE variable_id IN ('pr','tas') AND table_id = 'Amon' AND experiment_id IN ('historical','ssp370') GROUP BY source_id HAVING count(DISTINCT (variable_id, table_id, experiment_id)) = 4")(
    lambda v, s: catalog.models_with_all(v("catalog"), [("pr", "Amon"), ("tas", "Amon")], ["historical", "ssp370"])
)
query("a3_common_members", "SELECT m.source_id, member_id FROM (SELECT source_id, member_id, count(DISTINCT (experiment_id, variable_id)) AS n FROM catalog GROUP BY ALL) m JOIN (SELECT source_id, count(DISTINCT (experiment_id, variable_id)) AS n FROM catalog GROUP BY ALL) a ON m.source_id = a.source_id AND m.n = a.n")(
    lambda v, s: catalog.common_members(v("catalog"))
)
query("a4_newest_common_version", "SELECT h.source_id, max(v) AS version FROM (SELECT source_id, CAST(substr(version, 2) AS INT) AS v, count(DISTINCT variable_id) AS n FROM catalog GROUP BY ALL) h JOIN (SELECT source_id, count(DISTINCT variable_id) AS n FROM catalog GROUP BY ALL) a ON h.source_id = a.source_id AND h.n = a.n GROUP BY h.source_id")(
    lambda v, s: catalog.newest_common_version(v("catalog"))
)
query("a5_pick_grid_and_version", "SELECT * FROM catalog QUALIFY rank() OVER (PARTITION BY source_id, experiment_id, variable_id ORDER BY CASE grid WHEN 'gn' THEN 0 WHEN 'gr' THEN 1 WHEN 'gr1' THEN 2 ELSE 3 END, version DESC) = 1")(
    lambda v, s: catalog.pick_grid_and_version(v("catalog"), ["source_id", "experiment_id", "variable_id"])
)
query("a6_window_overlap", "SELECT * FROM catalog WHERE regexp_extract(file, '_(\\d{6})-(\\d{6})', 1) <= '189012' AND regexp_extract(file, '_(\\d{6})-(\\d{6})', 2) >= '188501'")(
    lambda v, s: catalog.window_overlap(v("catalog"), "188501", "189012")
)
_DAY_NAMES = "replace(replace(file, '01-', '0115-'), '12.nc', '1220.nc')"
query("a6_window_overlap_days", f"SELECT * REPLACE ({_DAY_NAMES} AS file) FROM catalog WHERE regexp_extract({_DAY_NAMES}, '_([0-9]+)-([0-9]+)', 1) <= '18901231' AND regexp_extract({_DAY_NAMES}, '_([0-9]+)-([0-9]+)', 2) >= '18851220'")(
    lambda v, s: catalog.window_overlap(v("catalog").withColumn("file", F.expr(_DAY_NAMES)), "18851220", "189012")
)
query("a7_source_priority", "SELECT model, lat, lon, year, month, pr FROM panel_month QUALIFY row_number() OVER (PARTITION BY model, lat, lon, year, month ORDER BY CASE WHEN experiment = 'historical' THEN 0 ELSE 1 END) = 1", "pr")(
    lambda v, s: catalog.source_priority([v("panel_month").where(F.col("experiment") == e).select("model", *CELL, "year", "month", "pr") for e in ("historical", "ssp370")], ["model", *CELL, "year", "month"])
)
query("a8_skip_present", "SELECT DISTINCT model, lat, lon FROM panel_month EXCEPT SELECT DISTINCT model, lat, lon FROM panel_month WHERE year = 1995 AND month = 1")(
    lambda v, s: catalog.skip_present(v("panel_month").select("model", *CELL).distinct(), v("panel_month").where("year = 1995 and month = 1"), ["model", *CELL])
)

# --- conforming ---
def _ranks(spark) -> DataFrame:
    """A reference calendar: the days from 2000 on by rank, for 50 years."""
    return spark.range(1, 18264).select(F.col("id").alias("rank"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int") - 1).alias("day"))


def calendar(spark, first: int, months: int = 36) -> DataFrame:
    """rank, year, month from January of a year on."""
    i = F.col("id").cast("int")
    return spark.range(months).select((i + 1).alias("rank"), (first + F.floor(i / 12)).cast("int").alias("year"), (i % 12 + 1).alias("month"))


def _model_months(v) -> DataFrame:
    """Historical months by model, without gaps."""
    return v("panel_month").where("experiment = 'historical'").groupBy("model", "year", "month").agg(F.avg("pr").alias("pr"))


query("b3_conform_time_by_rank", "SELECT cell, rank, CAST(CAST(DATE '2000-01-01' + CAST(rank - 1 AS INT) AS DATE) AS VARCHAR) AS day, pr FROM (SELECT cell, pr, dense_rank() OVER (PARTITION BY cell ORDER BY day) AS rank FROM panel_day)", "pr")(
    lambda v, s: conform.by_rank(v("panel_day"), _ranks(s), ["cell"], ["day"], ["day"], exact=False).select("cell", (F.datediff("day", F.lit("2000-01-01")) + 1).cast("long").alias("rank"), F.col("day").cast("string"), "pr")
)
query("b3_conform_time_exact", "SELECT model, CAST(2050 + (rank - 1) // 12 AS INT) AS year, CAST((rank - 1) % 12 + 1 AS INT) AS month, avg(pr) AS pr FROM (SELECT model, pr, dense_rank() OVER (PARTITION BY model ORDER BY year, month) AS rank FROM panel_month WHERE experiment = 'historical') GROUP BY ALL", "pr")(
    lambda v, s: conform.by_rank(_model_months(v), calendar(s, 2050), ["model"], ["year", "month"], ["year", "month"]).select("model", "year", "month", "pr")
)
query("b4_slice_months", "SELECT experiment, model, lat, lon, year, month, pr FROM panel_month WHERE year * 12 + month BETWEEN 1996 * 12 + 5 AND 1999 * 12 + 3", "pr")(
    lambda v, s: conform.slice_months(v("panel_month"), (1996, 5), (1999, 3)).select("experiment", "model", *CELL, "year", "month", "pr")
)
_PAD = "s AS (SELECT model, lat, lon, min(year * 12 + month - 1) AS a, max(year * 12 + month - 1) AS b FROM panel_month WHERE experiment = 'historical' GROUP BY ALL), m AS (SELECT model, lat, lon, unnest(range(1994 * 12, 1999 * 12)) AS m, a, b FROM s)"
add_cte("b6_pad_months", _PAD, "SELECT model, lat, lon, year, month, pr FROM panel_month WHERE experiment = 'historical' UNION ALL SELECT model, lat, lon, CAST(m // 12 AS INT), CAST(m % 12 + 1 AS INT), NULL FROM m WHERE m < a OR m > b", "pr")(
    lambda v, s: conform.pad_months(v("panel_month").where("experiment = 'historical'").select("model", *CELL, "year", "month", "pr"), ["model", *CELL], (1994, 1), (1998, 12))
)
query("b8_drop_feb29", "SELECT cell, CAST(day AS VARCHAR) AS day, pr FROM (SELECT *, count(*) OVER (PARTITION BY cell) - sum(CASE WHEN month(day) = 2 AND day(day) = 29 THEN 1 ELSE 0 END) OVER (PARTITION BY cell) AS n FROM panel_day WHERE year(day) = 1996) WHERE NOT (n = 365 AND month(day) = 2 AND day(day) = 29)", "pr")(
    lambda v, s: conform.drop_feb29(v("panel_day").where("year(day) = 1996"), ["cell"], 365).withColumn("day", F.col("day").cast("string"))
)
query("b12_landmask", "SELECT model, lat, lon, year, month, pr * CASE WHEN lon > 0 THEN 1.0 END AS pr FROM panel_month", "pr")(
    lambda v, s: conform.apply_landmask(v("panel_month").select("model", *CELL, "year", "month", "pr"), v("panel_month").select(*CELL).distinct().withColumn("landseamask", F.when(F.col("lon") > 0, 1.0)), ["pr"])
)
query("b14_remove_regions", f"SELECT lat, lon, count(*) AS n FROM panel_month WHERE lat > -60 AND {_REGION_SQL} <> 'NW' GROUP BY lat, lon")(
    lambda v, s: conform.remove_regions(v("panel_month"), region(v("panel_month")), ["NW"]).groupBy(*CELL).agg(F.count("*").alias("n"))
)
query("b16_set_units", "SELECT experiment, model, lat, lon, year, month, tas - 273.15 AS tas, ps * 0.01 AS ps FROM panel_month", "tas ps")(
    lambda v, s: conform.set_units(v("panel_month"), {"tas": ("K", "C"), "ps": ("Pa", "hPa")}).select("experiment", "model", *CELL, "year", "month", "tas", "ps")
)
query("b20_negatives_to_zero", "SELECT cell, CASE WHEN bgws < 0 THEN 0.0 ELSE bgws END AS bgws FROM change_frame", "bgws")(
    lambda v, s: conform.negatives_to_zero(v("change_frame"), ["bgws"]).select("cell", "bgws")
)
#: The fixture's cells as a regular grid of 20 by 90 degrees; its mean over targets of 10 degrees keeps each value.
_GRID = "SELECT lat, lon, avg(pr) AS pr FROM panel_month WHERE experiment = 'historical' GROUP BY lat, lon"
add_cte("b10_regrid_conservative", f"""g AS ({_GRID}), t AS (SELECT -90.0 + 30 * i AS y0, -60.0 + 30 * i AS y1, -180.0 + 30 * j AS x0, -150.0 + 30 * j AS x1 FROM range(6) a(i), range(12) b(j)),
    o AS (SELECT y0 + 15 AS lat, x0 + 15 AS lon, pr, (sin(radians(least(y1, g.lat + 10))) - sin(radians(greatest(y0, g.lat - 10)))) * (least(x1, g.lon + k + 45) - greatest(x0, g.lon + k - 45)) AS w
          FROM t, (VALUES (-360.0), (0.0), (360.0)) s(k), g WHERE least(y1, g.lat + 10) > greatest(y0, g.lat - 10) AND least(x1, g.lon + k + 45) > greatest(x0, g.lon + k - 45))""",
        "SELECT CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, sum(pr * w) / sum(w) AS pr FROM o GROUP BY lat, lon", "pr")(
    lambda v, s: _regridded(v)
)


def _regridded(v) -> DataFrame:
    g = v("panel_month").where("experiment = 'historical'").groupBy(*CELL).agg(F.avg("pr").alias("pr"))
    # latitudes are 20 degrees apart, longitudes 90: each is split into equal parts of 10 by 10
    parts = g.withColumn("k", F.explode(F.array(F.lit(-5.0), F.lit(5.0)))).withColumn("j", F.explode(F.array(*[F.lit(-40.0 + 10 * i) for i in range(9)])))
    lon = F.pmod(F.col("lon") + F.col("j") + 180, F.lit(360.0)) - 180
    return conform.regrid_conservative(parts.select((F.col("lat") + F.col("k")).alias("lat"), lon.alias("lon"), "pr", F.lit(1).alias("t")), ["pr"], ["t"], 10.0, 30.0, normed=True).drop("t")


# --- derived variables ---
K6 = "experiment, model, lat, lon, year, month"
_KEYS = ["experiment", "model", *CELL, "year", "month"]
_VPD = "(611.21 * exp((18.678 - (tas - 273.15) / 234.5) * ((tas - 273.15) / (257.14 + (tas - 273.15)))) - huss * ps / (0.622 + 0.378 * huss)) / 100"
query("c1_evapo", f"SELECT {K6}, evspsbl - tran AS evapo FROM panel_month", "evapo")(lambda v, s: v("panel_month").select(*_KEYS, (F.col("evspsbl") - F.col("tran")).alias("evapo")))
query("c2_vpd", f"SELECT {K6}, greatest({_VPD}, 0) AS vpd FROM panel_month", "vpd")(lambda v, s: v("panel_month").select(*_KEYS, C.vapour_pressure_deficit(F.col("tas") - 273.15, F.col("huss"), F.col("ps")).alias("vpd")))
query("c3_wue", f"SELECT {K6}, CASE WHEN gpp / (tran + 1e-6) BETWEEN 0.1 AND 10 THEN gpp / (tran + 1e-6) END AS wue FROM panel_month", "wue")(lambda v, s: v("panel_month").select(*_KEYS, C.water_use_efficiency(F.col("gpp"), F.col("tran")).alias("wue")))
query("c4_wue_year_sum", "SELECT experiment, model, lat, lon, year, CASE WHEN w BETWEEN 0.1 AND 10 THEN w END AS wue FROM (SELECT experiment, model, lat, lon, year, sum(gpp) / nullif(sum(tran), 0) AS w FROM panel_month GROUP BY ALL)", "wue")(
    lambda v, s: v("panel_month").groupBy("experiment", "model", *CELL, "year").agg((F.sum("gpp") / F.nullif(F.sum("tran"), F.lit(0.0))).alias("w")).select("experiment", "model", *CELL, "year", C.inside(F.col("w"), 0.1, 10).alias("wue"))
)
query("c6_rx5day", "SELECT cell, year(day) AS year, max(pr) AS rx1day, max(t) AS rx5day FROM (SELECT *, CASE WHEN count(pr) OVER w = 5 THEN sum(pr) OVER w END AS t FROM panel_day WINDOW w AS (PARTITION BY cell ORDER BY day RANGE BETWEEN INTERVAL 4 DAYS PRECEDING AND CURRENT ROW)) GROUP BY ALL", "rx1day rx5day")(
    lambda v, s: panel.rolling_max(v("panel_day")).withColumn("year", F.col("year").cast("long"))
)
query("c9_partition_metrics", f"SELECT {K6}, least(greatest((mrro - tran) / (CASE WHEN pr > 1e-12 THEN pr END) * 100, -100), 100) AS bgws_tran, least(greatest((mrro - evspsbl) / (CASE WHEN pr > 1e-12 THEN pr END) * 100, -100), 100) AS bgws_evspsbl, mrro / (CASE WHEN pr > 1e-12 THEN pr END) AS r_over_p, tran / (CASE WHEN pr > 1e-12 THEN pr END) AS et_over_p FROM panel_month", "bgws_tran bgws_evspsbl r_over_p et_over_p")(
    lambda v, s: panel.partition_metrics(v("panel_month"), ["tran", "evspsbl"], "").select(*_KEYS, "bgws_tran", "bgws_evspsbl", "r_over_p", "et_over_p")
)
query("c11_bgws_limits", f"SELECT {K6}, x AS free, CASE WHEN x BETWEEN -5 AND 5 THEN x END AS narrow FROM (SELECT *, (mrro - tran) / (CASE WHEN pr > 1e-12 THEN pr END) * 100 AS x FROM panel_month)", "free narrow")(
    lambda v, s: v("panel_month").select(*_KEYS, C.partition(F.col("mrro"), F.col("tran"), F.col("pr"), "none").alias("free"), C.inside(C.partition(F.col("mrro"), F.col("tran"), F.col("pr"), "none"), -5, 5).alias("narrow"))
)
query("c16_cumulative", "SELECT model, lat, lon, CASE WHEN count(pr) = count(*) THEN sum(pr) * 100 END AS total FROM panel_month GROUP BY ALL", "total")(
    lambda v, s: v("panel_month").groupBy("model", *CELL).agg(F.when(F.count("pr") == F.count("*"), F.sum("pr") * 100).alias("total"))
)
_YEARLY = "y AS (SELECT model, year, avg(pr) AS pr, avg(mrro) AS mrro, avg(evspsbl - tran) AS evapo, avg(mrsos) AS mrso FROM panel_month GROUP BY ALL)"
add_cte("c19_budget_series", _YEARLY + ", d AS (SELECT *, mrso - lag(mrso) OVER (PARTITION BY model ORDER BY year) AS dS FROM y)", "SELECT *, dS / (pr * 365) * 100 AS dS_over_P, 365 * (pr - mrro - evapo) - dS AS residual, (365 * (pr - mrro - evapo) - dS) / (pr * 365) * 100 AS residual_pct FROM d", "pr mrro evapo mrso dS dS_over_P residual residual_pct")(
    lambda v, s: panel.budget_series(v("panel_month").groupBy("model", "year").agg(F.avg("pr").alias("pr"), F.avg("mrro").alias("mrro"), F.avg(F.col("evspsbl") - F.col("tran")).alias("evapo"), F.avg("mrsos").alias("mrso")), ["model"])
)

# --- time selection and aggregation ---
query("d2_select_months", "SELECT experiment, count(*) AS n, avg(pr) AS pr FROM panel_month WHERE month IN (12, 1, 2, 6, 7, 8) GROUP BY ALL", "pr")(
    lambda v, s: panel.select_months(v("panel_month"), "nh_winter and nh_summer").groupBy("experiment").agg(F.count("*").alias("n"), F.avg("pr").alias("pr"))
)
query("d4_first_of_year", "SELECT model, lat, lon, year, month, pr FROM panel_month QUALIFY row_number() OVER (PARTITION BY model, lat, lon, year ORDER BY month) = 1", "pr")(
    lambda v, s: panel.first_of_year(v("panel_month"), ["model", *CELL]).select("model", *CELL, "year", "month", "pr")
)
query("d5_align_years", "SELECT c.model, c.lat, c.lon, y.year, p.pr FROM (SELECT DISTINCT model, lat, lon FROM panel_month WHERE experiment = 'historical') c CROSS JOIN (SELECT unnest(range(1994, 1998)) AS year) y LEFT JOIN (SELECT model, lat, lon, year, avg(pr) AS pr FROM panel_month WHERE experiment = 'historical' GROUP BY ALL) p ON c.model = p.model AND c.lat = p.lat AND c.lon = p.lon AND y.year = p.year", "pr")(
    lambda v, s: panel.align_years(v("panel_month").where("experiment = 'historical'").groupBy("model", *CELL, "year").agg(F.avg("pr").alias("pr")), s.range(1994, 1998).withColumnRenamed("id", "year"), ["model", *CELL]).select("model", *CELL, "year", "pr")
)
query("e1_temporal_stats", "SELECT experiment, model, lat, lon, avg(pr) AS pr_mean, stddev_pop(pr) AS pr_std, median(pr) AS pr_median, min(pr) AS pr_min, max(pr) AS pr_max, var_pop(pr) AS pr_var FROM panel_month GROUP BY ALL", "pr_mean pr_std pr_median pr_min pr_max pr_var")(
    lambda v, s: panel.stats(v("panel_month"), ["pr"], ["mean", "std", "median", "min", "max", "var"], ["experiment", "model", *CELL])
)
add_cte("e3_period_stats", _MEANS, "SELECT period, model, lat, lon, pr_mean, tran_mean, mrro_mean FROM means", "pr_mean tran_mean mrro_mean")(lambda v, s: panel.period_stats(v("panel_month"), periods(s), ["pr", "tran", "mrro"], ["mean"]))
query("e6_monthly_climatology", "SELECT experiment, model, lat, lon, month, avg(pr) AS pr_mean, median(pr) AS pr_median FROM panel_month GROUP BY ALL", "pr_mean pr_median")(
    lambda v, s: panel.stats(v("panel_month"), ["pr"], ["mean", "median"], ["experiment", "model", *CELL, "month"])
)
_SEASON = "CASE WHEN month IN (12,1,2) THEN 'DJF' WHEN month < 6 THEN 'MAM' WHEN month < 9 THEN 'JJA' ELSE 'SON' END"
query("e7_seasonal_climatology", f"SELECT experiment, model, lat, lon, {_SEASON} AS season, avg(pr) AS pr_mean FROM panel_month GROUP BY ALL", "pr_mean")(
    lambda v, s: panel.stats(panel.with_season(v("panel_month")), ["pr"], ["mean"], ["experiment", "model", *CELL, "season"])
)
query("e8_seasonal_series", f"SELECT model, lat, lon, CAST(year + CASE WHEN month = 12 THEN 1 ELSE 0 END AS INT) AS season_year, {_SEASON} AS season, avg(pr) AS pr_mean FROM panel_month GROUP BY ALL", "pr_mean")(
    lambda v, s: panel.stats(panel.with_season(v("panel_month")), ["pr"], ["mean"], ["model", *CELL, "season_year", "season"])
)
query("e11_annual_sum", "SELECT model, lat, lon, year, sum(CASE WHEN NOT bad THEN pr * day(last_day(make_date(year, month, 1))) END) AS pr FROM (SELECT *, bool_or(pr IS NULL) OVER (PARTITION BY model, lat, lon) AS bad FROM panel_month) GROUP BY ALL", "pr")(
    lambda v, s: panel.annual_sum(v("panel_month"), ["pr"], ["model", *CELL])
)
query("e12_seasonality", "SELECT model, lat, lon, stddev_pop(m) AS pr_seasonality FROM (SELECT model, lat, lon, month, avg(pr) AS m FROM panel_month GROUP BY ALL) GROUP BY ALL", "pr_seasonality")(
    lambda v, s: panel.seasonality(v("panel_month"), "pr", ["model", *CELL])
)
query("e13_annual_seasonality", "SELECT model, lat, lon, year, stddev_pop(pr) AS pr FROM panel_month GROUP BY ALL", "pr")(lambda v, s: v("panel_month").groupBy("model", *CELL, "year").agg(F.stddev_pop("pr").alias("pr")))

# --- space ---
_WM = f"sum(pr * {W}) / sum({W})"
query("f1_spatial_stats", f"SELECT model, year, month, {_WM} AS mean, sum(pr * pr * {W}) / sum({W}) - ({_WM}) * ({_WM}) AS var, min(pr) AS min, max(pr) AS max, sqrt(greatest(sum(pr * pr * {W}) / sum({W}) - ({_WM}) * ({_WM}), 0)) AS std FROM panel_month GROUP BY model, year, month", "mean var min max std")(
    lambda v, s: panel.spatial_stats(v("panel_month"), "pr", ["model", "year", "month"]).withColumn("std", F.when(F.col("var") < 1e-12, F.sqrt(F.greatest("var", F.lit(0.0)))).otherwise(F.col("std")))
)
query("f3_weighted_median", f"SELECT model, year, month, min(pr) AS median FROM (SELECT *, sum({W}) OVER (PARTITION BY model, year, month ORDER BY pr) / sum({W}) OVER (PARTITION BY model, year, month) AS c FROM panel_month) WHERE c >= 0.5 GROUP BY ALL", "median")(
    lambda v, s: panel.weighted_median(v("panel_month"), "pr", ["model", "year", "month"])
)
query("f6_regional_mean", f"SELECT model, year, {_REGION_SQL} AS region, sum(pr * {W}) / sum({W}) AS pr, sum(mrro * {W}) / sum({W}) AS mrro FROM panel_month GROUP BY ALL", "pr mrro")(
    lambda v, s: panel.regional_mean(v("panel_month"), region(v("panel_month")), ["pr", "mrro"], ["model", "year"])
)
query("f9_region_expand", f"SELECT model, region, count(nullif(pr, 0)) AS n_pr FROM (SELECT *, {_REGION_SQL} AS region FROM panel_month UNION ALL SELECT *, 'Global' FROM panel_month) GROUP BY ALL HAVING count(nullif(pr, 0)) > 0")(
    lambda v, s: panel.region_expand(v("panel_month"), region(v("panel_month")), ["pr"], ["model"])
)
query("f10_cell_area", f"SELECT lat, lon, 6371.0 * 6371.0 * radians(dlat) * radians(dlon) * {W} AS area FROM (SELECT DISTINCT lat, lon FROM panel_month), (SELECT (max(lat) - min(lat)) / (count(DISTINCT lat) - 1) AS dlat, (max(lon) - min(lon)) / (count(DISTINCT lon) - 1) AS dlon FROM panel_month)", "area")(
    lambda v, s: panel.cell_area(v("panel_month"))
)
query("f13_global_mean_table", f"SELECT model, round(sum(CASE WHEN experiment = 'historical' THEN pr * {W} END) / sum(CASE WHEN experiment = 'historical' THEN {W} END), 2) AS historical, round(sum(CASE WHEN experiment = 'ssp370' THEN pr * {W} END) / sum(CASE WHEN experiment = 'ssp370' THEN {W} END), 2) AS ssp370 FROM panel_month GROUP BY model", "historical ssp370")(
    lambda v, s: v("panel_month").groupBy("model").pivot("experiment", ["historical", "ssp370"]).agg(F.round(C.weighted_mean(F.col("pr"), C.weight(F.col("lat"))), 2))
)
query("f14_latitude_bands", f"SELECT CASE WHEN abs(lat) > 60 THEN '>60' WHEN abs(lat) >= 40 THEN '40-60' WHEN abs(lat) >= 20 THEN '20-40' ELSE '<20' END AS band, 100 * sum(CASE WHEN bgws > 0 THEN {W} ELSE 0 END) / sum({W}) AS positive, sum(bgws * {W}) / sum({W}) AS mean FROM change_frame GROUP BY ALL", "positive mean")(
    lambda v, s: v("change_frame").groupBy(regimes.band(F.col("lat")).alias("band")).agg(C.share(F.col("bgws") > 0, C.weight(F.col("lat"))).alias("positive"), C.weighted_mean(F.col("bgws"), C.weight(F.col("lat"))).alias("mean"))
)

# --- ensemble and change ---
add_cte("g1_ensemble", _MEANS, "SELECT period, lat, lon, avg(bgws_tran) AS mean, median(bgws_tran) AS median, stddev_pop(bgws_tran) AS std FROM b GROUP BY ALL", "mean median std")(
    lambda v, s: means(v, s).groupBy("period", *CELL).agg(*[panel.STATS[n]("bgws_tran").alias(n) for n in ("mean", "median", "std")])
)
add_cte("g3_change", _MEANS, "SELECT a.period || '-hist' AS period, a.model, a.lat, a.lon, a.bgws_tran - h.bgws_tran AS bgws_tran, 100 * (a.pr_mean - h.pr_mean) / nullif(h.pr_mean, 0) AS pr_mean FROM b a JOIN b h ON h.period = 'hist' AND a.period <> 'hist' AND a.model = h.model AND a.lat = h.lat AND a.lon = h.lon", "bgws_tran pr_mean")(
    lambda v, s: panel.change(means(v, s), ["bgws_tran", "pr_mean"], "hist", ("pr_mean",))
)
add_cte("g7_hydro_mask", _MEANS, "SELECT lat, lon FROM msk", "lat lon")(lambda v, s: panel.hydro_mask(means(v, s).where("period = 'hist'"), suffix="_mean"))
add_cte("g8_apply_mask", _MEANS, "SELECT b.period, b.model, b.lat, b.lon, CASE WHEN msk.lat IS NOT NULL THEN bgws_tran END AS bgws_tran FROM b LEFT JOIN msk ON b.lat = msk.lat AND b.lon = msk.lon", "bgws_tran")(
    lambda v, s: panel.apply_mask(means(v, s), panel.hydro_mask(means(v, s).where("period = 'hist'"), suffix="_mean"), ["bgws_tran"]).select("period", "model", *CELL, "bgws_tran")
)
query("g10_common_models", "SELECT experiment AS period, model, count(*) AS n FROM panel_month WHERE model IN (SELECT model FROM panel_month GROUP BY model HAVING count(DISTINCT experiment) = 2) GROUP BY ALL")(
    lambda v, s: panel.common_models(v("panel_month").withColumnRenamed("experiment", "period"), ["pr", "tran"]).groupBy("period", "model").agg(F.count("*").alias("n"))
)
_PRODUCT = _MEANS + """, kept AS (SELECT b.period, b.model, b.lat, b.lon, CASE WHEN msk.lat IS NOT NULL THEN bgws_tran END AS bgws_tran FROM b LEFT JOIN msk ON b.lat = msk.lat AND b.lon = msk.lon),
ch AS (SELECT a.period || '-hist' AS period, a.model, a.lat, a.lon, a.bgws_tran - h.bgws_tran AS bgws_tran FROM kept a JOIN kept h ON h.period = 'hist' AND a.period <> 'hist' AND a.model = h.model AND a.lat = h.lat AND a.lon = h.lon),
bo AS (SELECT * FROM kept UNION ALL SELECT * FROM ch)"""
add_cte("g12_period_product", _PRODUCT, "SELECT period, model, lat, lon, bgws_tran, 'member' AS kind FROM bo UNION ALL SELECT period, 'ensemble mean', lat, lon, avg(bgws_tran), 'mean' FROM bo GROUP BY period, lat, lon", "bgws_tran")(
    lambda v, s: product(v, s).select("period", "model", *CELL, "bgws_tran", "kind")
)

# --- regimes and agreement ---
query("h1_regime", "SELECT cell, CASE WHEN bgws > 0 THEN 'Positive Historical BGWS' WHEN bgws < 0 THEN 'Negative Historical BGWS' END AS regime FROM change_frame")(lambda v, s: v("change_frame").select("cell", regimes.regime(F.col("bgws"), "historical", "bgws").alias("regime")))
_CH = _PRODUCT + ", far AS (SELECT * FROM ch WHERE period = 'far-hist')"
add_cte("h3_sign_agreement", _CH, "SELECT lat, lon, avg(CASE WHEN bgws_tran > 0 THEN 1.0 ELSE 0 END) AS positive, avg(CASE WHEN bgws_tran < 0 THEN 1.0 ELSE 0 END) AS negative, CAST(sum(CASE WHEN bgws_tran <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, greatest(avg(CASE WHEN bgws_tran > 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN bgws_tran < 0 THEN 1.0 ELSE 0 END)) >= 0.8 AND sum(CASE WHEN bgws_tran <> 0 THEN 1 ELSE 0 END) >= ceil(0.75 * count(*)) AS confident FROM far GROUP BY ALL", "positive negative")(
    lambda v, s: regimes.sign_agreement(product(v, s).where("kind = 'member' and period = 'far-hist'"), "bgws_tran").select(*CELL, "positive", "negative", "n_valid", "confident")
)
query("h8_quadrant", "SELECT cell, CASE WHEN bgws > 1 AND price > 1200 THEN 0 WHEN bgws > 1 AND price < -1200 THEN 1 WHEN bgws < -1 AND price > 1200 THEN 2 WHEN bgws < -1 AND price < -1200 THEN 3 END AS quadrant FROM change_frame")(
    lambda v, s: v("change_frame").select("cell", regimes.quadrant(F.col("bgws"), F.col("price"), 1, 1200).alias("quadrant"))
)
_Q = "q AS (SELECT *, pr - 25.5 AS x, CASE WHEN bgws > 0 AND pr > 25.5 THEN 0 WHEN bgws > 0 AND pr < 25.5 THEN 1 WHEN bgws < 0 AND pr > 25.5 THEN 2 WHEN bgws < 0 AND pr < 25.5 THEN 3 END AS quadrant, size > 25 AS low FROM change_frame)"


def _quadrants(v) -> DataFrame:
    x = v("change_frame").withColumn("x", F.col("pr") - 25.5)
    return x.withColumns({"quadrant": regimes.quadrant(F.col("bgws"), F.col("x")), "low": F.col("size") > 25})


add_cte("h10_quadrant_areas", _Q, f"SELECT CAST(k AS INT) AS quadrant, 100 * sum(CASE WHEN quadrant = k THEN {W} ELSE 0 END) / sum(CASE WHEN quadrant IS NOT NULL THEN {W} END) AS total, 100 * sum(CASE WHEN quadrant = k AND NOT low THEN {W} ELSE 0 END) / sum(CASE WHEN quadrant IS NOT NULL THEN {W} END) AS robust, 100 * sum(CASE WHEN quadrant = k AND low THEN {W} ELSE 0 END) / sum(CASE WHEN quadrant IS NOT NULL THEN {W} END) AS uncertain FROM q, range(4) r(k) GROUP BY k", "total robust uncertain")(
    lambda v, s: regimes.quadrant_areas(_quadrants(v))
)
add_cte("h11_magnitude_bins", _Q + ", p AS (SELECT quantile_cont(abs(bgws), 0.9) AS a, quantile_cont(abs(x), 0.9) AS b FROM q), j AS (SELECT cell, quadrant, greatest(abs(bgws) / a, abs(x) / b) AS joint FROM q, p), c AS (SELECT quantile_cont(joint, 0.3333) AS c0, quantile_cont(joint, 0.6667) AS c1 FROM j)", "SELECT cell, joint, CASE WHEN joint <= c0 THEN 0 WHEN joint <= c1 THEN 1 ELSE 2 END AS magnitude, quadrant * 3 + CASE WHEN joint <= c0 THEN 0 WHEN joint <= c1 THEN 1 ELSE 2 END AS class FROM j, c", "joint")(
    lambda v, s: regimes.magnitude_bins(_quadrants(v), "bgws", "x", F.col("quadrant")).select("cell", "joint", "magnitude", "class")
)
query("h12_change_category", f"SELECT label, 100 * sum({W}) / sum(sum({W})) OVER () AS percent FROM (SELECT lat, CASE WHEN bgws < 0 AND pr < 25.5 THEN 'Greener' WHEN bgws < 0 AND pr > 25.5 THEN 'Less green' WHEN bgws > 0 AND pr < 25.5 THEN 'Less blue' WHEN bgws > 0 AND pr > 25.5 THEN 'Bluer' END AS label FROM change_frame) WHERE label IS NOT NULL GROUP BY label", "percent")(
    lambda v, s: regimes.areas(v("change_frame"), regimes.change_category(F.col("bgws"), F.col("pr") - 25.5))
)
query("h14_three_way", "SELECT cell, CASE WHEN p = 3 THEN 1 WHEN n = 3 THEN 2 WHEN p = 0 AND n = 0 THEN 0 WHEN p = 2 OR n = 2 THEN 3 ELSE 4 END AS agreement FROM (SELECT cell, (CASE WHEN bgws > 1 THEN 1 ELSE 0 END + CASE WHEN pr - 25.5 > 1 THEN 1 ELSE 0 END + CASE WHEN size - 25 > 1 THEN 1 ELSE 0 END) AS p, (CASE WHEN bgws < -1 THEN 1 ELSE 0 END + CASE WHEN pr - 25.5 < -1 THEN 1 ELSE 0 END + CASE WHEN size - 25 < -1 THEN 1 ELSE 0 END) AS n FROM change_frame)")(
    lambda v, s: v("change_frame").select("cell", regimes.three_way(F.col("bgws"), F.col("pr") - 25.5, F.col("size") - 25, 1).alias("agreement"))
)
query("h15_limitation_regime", 'SELECT cell, CASE WHEN -a >= -b AND -a >= c THEN 1 WHEN -b >= c THEN 2 ELSE 3 END AS "limit" FROM (SELECT cell, (pr - avg(pr) OVER ()) / stddev_pop(pr) OVER () AS a, (price - avg(price) OVER ()) / stddev_pop(price) OVER () AS b, (size - avg(size) OVER ()) / stddev_pop(size) OVER () AS c FROM change_frame)')(
    lambda v, s: regimes.limitation_regime(v("change_frame"), "pr", "price", "size").select("cell", "limit")
)
_FLIPS = f"SELECT a.model, 100 * sum(CASE WHEN h.bgws_tran > 0 AND a.bgws_tran < 0 THEN cos(radians(a.lat)) ELSE 0 END) / sum(cos(radians(a.lat))) AS pos_to_neg, 100 * sum(CASE WHEN h.bgws_tran < 0 AND a.bgws_tran > 0 THEN cos(radians(a.lat)) ELSE 0 END) / sum(cos(radians(a.lat))) AS neg_to_pos FROM b a JOIN b h ON h.period = 'hist' AND a.period = 'far' AND a.model = h.model AND a.lat = h.lat AND a.lon = h.lon GROUP BY a.model"
add_cte("h16_flips", _MEANS, _FLIPS, "pos_to_neg neg_to_pos")(
    lambda v, s: regimes.flips(_hist_far(means(v, s)), "hist", "far", ["model"])
)
add_cte("h16_flip_spread", _MEANS, "SELECT " + ", ".join(f"avg({c}) AS {c}, 1.96 * stddev_samp({c}) / sqrt(count({c})) AS {c}_half" for c in ("pos_to_neg", "neg_to_pos")) + f" FROM ({_FLIPS})", "pos_to_neg neg_to_pos pos_to_neg_half neg_to_pos_half")(
    lambda v, s: regimes.flip_spread(regimes.flips(_hist_far(means(v, s)), "hist", "far", ["model"]))
)


def _hist_far(m: DataFrame) -> DataFrame:
    p = lambda name: F.max(F.when(F.col("period") == name, F.col("bgws_tran"))).alias(name)
    both = m.where("period in ('hist', 'far')").groupBy("model", *CELL).agg(F.count("*").alias("_n"), p("hist"), p("far"))
    return both.where("_n = 2").drop("_n")


# --- series and correlation ---
_T = "SELECT *, CAST(row_number() OVER (PARTITION BY model, lat, lon ORDER BY year, month) - 1 AS DOUBLE) AS x FROM panel_month"
query("i1_detrend", f"SELECT model, lat, lon, year, month, CASE WHEN count(pr) OVER c >= 2 THEN pr - (regr_slope(pr, x) OVER c * x + regr_intercept(pr, x) OVER c) END AS detrended FROM ({_T}) WINDOW c AS (PARTITION BY model, lat, lon)", "detrended")(
    lambda v, s: series.detrend(v("panel_month"), "pr", ["model", *CELL], ["year", "month"]).select("model", *CELL, "year", "month", "detrended")
)
query("i2_deseasonalise", "SELECT model, lat, lon, year, month, pr - avg(pr) OVER (PARTITION BY model, lat, lon, month) AS anomaly FROM panel_month", "anomaly")(
    lambda v, s: series.deseasonalise(v("panel_month"), "pr", ["model", *CELL]).select("model", *CELL, "year", "month", "anomaly")
)
query("i3_kendall", "SELECT a.model, a.lat, a.lon, CAST(sum(sign(a.pr - b.pr) * sign(a.tran - b.tran)) AS DOUBLE) / nullif(sqrt(CAST(sum(abs(sign(a.pr - b.pr))) AS DOUBLE) * sum(abs(sign(a.tran - b.tran)))), 0) AS tau FROM panel_month a JOIN panel_month b ON a.model = b.model AND a.lat = b.lat AND a.lon = b.lon AND a.year * 12 + a.month > b.year * 12 + b.month GROUP BY ALL", "tau")(
    lambda v, s: series.kendall(v("panel_month"), "pr", "tran", ["model", *CELL])
)
query("i4_eli")(lambda v, s: series.eli(v("panel_month"), "mrsos", "tas", "tran", ["model", *CELL]))
query("i5_pearson_and_bias", "SELECT model, corr(pr, tran) AS r, avg(pr - tran) AS bias, avg(pr) AS mean_pr, avg(tran) AS mean_tran, regr_slope(pr, tran) AS slope, regr_intercept(pr, tran) AS intercept, count(*) AS n FROM panel_month GROUP BY model", "r bias mean_pr mean_tran slope intercept")(
    lambda v, s: series.pearson_and_bias(v("panel_month"), "pr", "tran", ["model"])
)
#: Means over the same rows differ by the order in which an engine adds them: values that agree to nine places tie, after a nudge that
#: keeps decimal ties off the edge.
_TIED = f"SELECT model, lat, round(pr + {NUDGE}, 9) AS pr, round(tran + {NUDGE}, 9) AS tran FROM panel_month"
_RANKS = f"SELECT model, lat, rank() OVER (PARTITION BY model ORDER BY pr) + (count(*) OVER (PARTITION BY model, pr) - 1) / 2 AS x, rank() OVER (PARTITION BY model ORDER BY tran) + (count(*) OVER (PARTITION BY model, tran) - 1) / 2 AS y FROM ({_TIED})"


def _tied(v) -> DataFrame:
    return v("panel_month").withColumns({c: F.round(F.col(c) + NUDGE, 9) for c in ("pr", "tran")})


query("i7_spearman", f"SELECT model, corr(x, y) AS rho, count(*) AS n FROM ({_RANKS}) GROUP BY model", "rho")(lambda v, s: series.spearman(_tied(v), "pr", "tran", ["model"]))
query("i8_weighted_spearman", f"SELECT model, (sum(x * y * {W}) / sum({W}) - sum(x * {W}) / sum({W}) * sum(y * {W}) / sum({W})) / sqrt((sum(x * x * {W}) / sum({W}) - pow(sum(x * {W}) / sum({W}), 2)) * (sum(y * y * {W}) / sum({W}) - pow(sum(y * {W}) / sum({W}), 2))) AS rho, count(*) AS n FROM ({_RANKS}) GROUP BY model", "rho")(
    lambda v, s: series.spearman(_tied(v), "pr", "tran", ["model"], C.weight(F.col("lat")))
)
_L = "l AS (SELECT min(pr) AS a0, max(pr) AS a1, min(price) AS b0, max(price) AS b1 FROM change_frame), n AS (SELECT CAST(least(floor((pr - a0) / (a1 - a0) * 70), 69) AS BIGINT) AS bx, CAST(least(floor((price - b0) / (b1 - b0) * 70), 69) AS BIGINT) AS \"by\", count(*) AS n FROM change_frame, l GROUP BY ALL)"
add_cte("i9_density", _L, 'SELECT bx, "by", n, 0.08 + 0.77 * n / (max(n) OVER ()) AS alpha FROM n', "alpha")(lambda v, s: series.density(v("change_frame"), "pr", "price"))
query("i10_robust_limits", "SELECT lo - 0.04 * (hi - lo) AS lo, hi + 0.04 * (hi - lo) AS hi FROM (SELECT least(quantile_cont(bgws, 0.025), 0) AS lo, greatest(quantile_cont(bgws, 0.975), 0) AS hi FROM change_frame)", "lo hi")(lambda v, s: series.robust_limits(v("change_frame"), "bgws"))
query("i11_zscore", "SELECT cell, (pr - avg(pr) OVER ()) / stddev_pop(pr) OVER () AS pr, (tax - avg(tax) OVER ()) / stddev_pop(tax) OVER () AS tax FROM change_frame", "pr tax")(lambda v, s: series.zscore(v("change_frame").select("cell", "pr", "tax"), ["pr", "tax"]))
_VARS = ["bgws", "pr", "disc", "tax"]
query("i13_pairwise", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM change_frame" for a in _VARS for b in _VARS if a != b), "r")(lambda v, s: series.pairwise(v("change_frame"), _VARS))
query("i14_describe", " UNION ALL ".join(f"SELECT '{a}' AS variable, count({a}) AS n, avg({a}) AS mean, stddev_samp({a}) AS sd, min({a}) AS min, quantile_cont({a}, 0.25) AS q25, median({a}) AS q50, quantile_cont({a}, 0.75) AS q75, max({a}) AS max FROM change_frame" for a in _VARS), "mean sd min q25 q50 q75 max")(
    lambda v, s: series.describe(v("change_frame"), _VARS)
)

# --- regression and importance ---
_BLOCK = "CAST(CAST(floor(lat / 10) AS INT) AS VARCHAR) || '_' || CAST(CAST(floor(lon / 20) AS INT) AS VARCHAR)"


def _blocked(v) -> DataFrame:
    df = regress.regime_frame(v("change_frame"), "bgws", ["pr", "disc", "tax"], F.col("bgws") > 0)
    return df.withColumn("block", regress.block(F.col("lat"), F.col("lon")))


query("j2_spatial_blocks", f"SELECT {_BLOCK} AS block, count(*) AS n FROM change_frame WHERE bgws > 0 GROUP BY ALL")(lambda v, s: _blocked(v).groupBy("block").agg(F.count("*").alias("n")))
query("j3_group_folds")(lambda v, s: regress.group_folds(_blocked(v), 5))
query("j4_group_shuffles")(lambda v, s: regress.group_shuffles(_blocked(v), 10))
query("j5_block_moments", f"SELECT {_BLOCK} AS block, CAST(count(*) AS DOUBLE) AS n, sum(pr) AS s_pr, sum(bgws) AS s_bgws, sum(pr * pr) AS s_pr_pr, sum(pr * bgws) AS s_pr_bgws, sum(bgws * bgws) AS s_bgws_bgws FROM change_frame WHERE bgws > 0 GROUP BY ALL", "n s_pr s_bgws s_pr_pr s_pr_bgws s_bgws_bgws")(
    lambda v, s: regress.block_moments(_blocked(v), "bgws", ["pr"], ["block"])
)


def _regimes(v) -> DataFrame:
    return v("change_frame").where("bgws <> 0").withColumn("regime", F.when(F.col("bgws") > 0, "positive").otherwise("negative")).withColumn("block", regress.block(F.col("lat"), F.col("lon")))


def _moments(v) -> DataFrame:
    return regress.block_moments(_regimes(v), "bgws", ["pr", "disc", "tax"], ["regime", "block"])


def _fits(v) -> DataFrame:
    return regress.repeated_elastic_net(_moments(v), regress.group_shuffles(_regimes(v), 40), "bgws", ["pr", "disc", "tax"], ["regime"])


query("j9_repeated_elastic_net")(lambda v, s: _fits(v))
query("j12_predictor_classes")(lambda v, s: regress.selection(_fits(v), ["regime"]))
query("j8_one_se", "SELECT (m).alpha AS alpha, (m).l1_ratio AS l1_ratio, (m).mean_score AS mean_score FROM (SELECT max({'alpha': alpha, 'l1_ratio': l1_ratio, 'mean_score': mean_score}) AS m FROM cv_results, (SELECT mean_score AS bm, sd_score AS bs FROM cv_results ORDER BY mean_score DESC, alpha DESC, l1_ratio DESC LIMIT 1) WHERE mean_score >= bm - bs / 2)", "alpha l1_ratio mean_score")(
    lambda v, s: regress.one_se(v("cv_results"), 4, [])
)
query("j10_permutation_importance")(lambda v, s: _fits(v).select("regime", "repeat", "predictor", "coef", "importance"))
query("j7_nested_screening")(lambda v, s: regress.nested_screening(_moments(v), regress.group_folds(_regimes(v), 5), "bgws", ["pr", "disc", "tax"], ["regime"]))
query("j13_importance_summary", "SELECT predictor, avg(importance) AS mean, quantile_cont(importance, 0.025) AS p2_5, quantile_cont(importance, 0.25) AS q25, median(importance) AS median, quantile_cont(importance, 0.75) AS q75, quantile_cont(importance, 0.975) AS p97_5 FROM importance_long GROUP BY predictor", "mean p2_5 q25 median q75 p97_5")(
    lambda v, s: regress.importance_summary(v("importance_long"), ["predictor"])
)
query("j13_fit_summary", "SELECT predictor, avg(importance) AS perm_mean, median(importance) AS perm_median, median(coef) AS coef_median, quantile_cont(importance, 0.025) AS perm_p2_5, quantile_cont(importance, 0.975) AS perm_p97_5, quantile_cont(coef, 0.025) AS coef_p2_5, quantile_cont(coef, 0.975) AS coef_p97_5, avg(CASE WHEN coef <> 0 THEN 1.0 ELSE 0 END) AS selection_frequency, avg(sign(nullif(coef, 0))) AS sign_consistency FROM importance_long GROUP BY predictor", "perm_mean perm_median coef_median perm_p2_5 perm_p97_5 coef_p2_5 coef_p97_5 selection_frequency sign_consistency")(
    lambda v, s: regress.fit_summary(v("importance_long"), [])
)
_AGREE = "SELECT predictor, count(DISTINCT model) AS n_models, avg(importance) AS mean, median(importance) AS median, quantile_cont(importance, 0.25) AS p25, quantile_cont(importance, 0.75) AS p75, avg(rank) AS mean_rank, avg(CASE WHEN importance > 0 THEN 1.0 ELSE 0 END) AS positive, avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END) AS top3, avg(CASE WHEN coef > 0 THEN 1.0 ELSE 0 END) AS coef_positive, avg(CASE WHEN coef < 0 THEN 1.0 ELSE 0 END) AS coef_negative, greatest(avg(CASE WHEN coef > 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN coef < 0 THEN 1.0 ELSE 0 END)) AS dominant_sign FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY importance DESC) AS rank FROM importance_long {where}) GROUP BY predictor"
_STAR = "CASE WHEN top3 >= 0.5 THEN '**' WHEN positive >= 0.8 THEN '*' ELSE '' END AS star"
query("j15_model_agreement", f"SELECT *, {_STAR} FROM ({_AGREE.format(where='')})", "mean median p25 p75 mean_rank positive top3 coef_positive coef_negative dominant_sign")(lambda v, s: regress.model_agreement(v("importance_long")))
query("j16_context_z", "SELECT predictor, CASE WHEN count(importance) >= 2 THEN least(greatest(avg(importance) / nullif(stddev_pop(importance), 0), -1), 1) END AS importance FROM importance_long GROUP BY predictor", "importance")(lambda v, s: regress.context_z(v("importance_long"), ["importance"], ["predictor"]))
_R2 = "SELECT model FROM importance_long GROUP BY model HAVING avg(coef) > 0"
query("j17_panel_table", f"SELECT *, {_STAR} FROM ({_AGREE.format(where=f'WHERE model IN ({_R2})')})", "mean median p25 p75 mean_rank positive top3 coef_positive coef_negative dominant_sign")(
    lambda v, s: regress.panel_table(v("importance_long"), v("importance_long").groupBy("model").agg(F.avg("coef").alias("r2")), 0.0)
)
query("j21_representative", "SELECT predictor, (min({'d': abs(importance - mid), 'm': model})).m AS repeat FROM importance_long JOIN (SELECT predictor, median(importance) AS mid FROM importance_long GROUP BY predictor) USING (predictor) GROUP BY predictor")(
    lambda v, s: regress.representative(v("importance_long").select("predictor", F.col("model").alias("repeat"), F.col("importance").alias("r2")), ["predictor"])
)
_NEAREST = "SELECT predictor, {q} AS quantile, (min({{'d': abs(importance - q{k}), 'm': model}})).m AS repeat FROM {rows} GROUP BY predictor"
_THREE = "i AS (SELECT *, quantile_cont(importance, 0.25) OVER w AS q1, quantile_cont(importance, 0.5) OVER w AS q2, quantile_cont(importance, 0.75) OVER w AS q3 FROM importance_long WINDOW w AS (PARTITION BY predictor)), " + ", ".join(f"c{k} AS ({_NEAREST.format(q=q, k=k, rows=rows)})" for k, q, rows in (
    (1, 0.25, "i"), (2, 0.5, "(SELECT i.* FROM i JOIN c1 ON i.predictor = c1.predictor AND i.model <> c1.repeat)"), (3, 0.75, "(SELECT i.* FROM i JOIN c1 ON i.predictor = c1.predictor AND i.model <> c1.repeat JOIN c2 ON i.predictor = c2.predictor AND i.model <> c2.repeat)")))
add_cte("j21_three_representatives", _THREE, "SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3", "quantile")(
    lambda v, s: regress.three_representatives(v("importance_long").select("predictor", F.col("model").alias("repeat"), F.col("importance").alias("r2")), ["predictor"])
)
