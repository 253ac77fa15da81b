"""Further queries: sinks, conforming, derived variables, products over periods, agreement and regression jobs, with DuckDB SQL
where SQL can express them. They go into the registry of gridstrata.plans.registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstrata.functions import columns as C
from gridstrata.operators import conform, forests, panel, regimes, regress, series
from gridstrata.plans import registry as R
from gridstrata.plans.registry import CELL, K6, W, add_cte, means, periods, query, region
from gridstrata.sources import catalog

_KEYS = ["experiment", "model", *CELL, "year", "month"]
_REGION = R._REGION_SQL


def history(v) -> DataFrame:
    return v("panel_month").where("experiment = 'historical'")


def hydro(v, spark) -> DataFrame:
    return panel.hydro_mask(means(v, spark).where("period = 'hist'"), suffix="_mean")


# --- sources and sinks ---
@query("a1_panel_scan", f"SELECT {K6}, pr, tran FROM panel_month WHERE experiment = 'historical' AND model IN ('M0', 'M1')", "pr tran")
def _(v, spark):
    path = catalog.shared_folder(spark, "panel")
    catalog.panel_write(v("panel_month"), path)
    return catalog.panel_scan(spark, path, ["pr", "tran", "no_such_variable"], ["historical"], ["M0", "M1"])


@query("a1_outer_merge", f"SELECT {K6}, pr, tran FROM (SELECT {K6}, pr FROM panel_month WHERE model IN ('M0', 'M1')) FULL JOIN (SELECT {K6}, tran FROM panel_month WHERE model IN ('M1', 'M2')) USING ({K6})", "pr tran")
def _(v, spark):
    """Variables in tables of their own, and one that isn't there."""
    paths = {c: catalog.shared_folder(spark, c) for c in ("pr", "tran", "lai")}
    for c, models in (("pr", ["M0", "M1"]), ("tran", ["M1", "M2"])):
        catalog.panel_write(v("panel_month").where(F.col("model").isin(models)).select(*_KEYS, c), paths[c])
    return catalog.variables_scan(spark, paths, ["historical", "ssp370"])


@add_cte("a10_load_or_compute", R._MEANS, "SELECT period, model, lat, lon, CAST(CAST(pr_mean AS FLOAT) AS DOUBLE) AS pr_mean FROM means", "pr_mean")
def _(v, spark):
    path = catalog.shared_folder(spark, "result")
    compute = lambda: means(v, spark).select("period", "model", *CELL, "pr_mean")
    catalog.load_or_compute(spark, path, compute, ["period", "model"])
    stored = catalog.load_or_compute(spark, path, lambda: None, ["period", "model"])
    return stored.select("period", "model", *CELL, F.col("pr_mean").cast("double"))


@add_cte("a10_result_store", R._MEANS, "SELECT period, model, m.lat, m.lon, CAST(CAST(pr_mean AS FLOAT) AS DOUBLE) AS pr_mean FROM means m JOIN msk ON m.lat = msk.lat AND m.lon = msk.lon WHERE model IN ('M0', 'M1')", "pr_mean")
def _(v, spark):
    """Parts that a first job left out are filled in by a second."""
    path, mask = catalog.shared_folder(spark, "results"), hydro(v, spark)
    parts = [(p, m) for p in ("hist", "near", "far") for m in ("M0", "M1")]

    def compute(missing: list[tuple], mask: DataFrame) -> DataFrame:
        wanted = spark.createDataFrame(missing, "period string, model string")
        own = means(v, spark).select("period", "model", *CELL, "pr_mean").join(F.broadcast(wanted), ["period", "model"])  # a row a part
        return own.join(mask, CELL, "left_semi")

    catalog.ResultStore(spark, path, mask).fill(parts[:2], compute)
    return catalog.ResultStore(spark, path, mask).fill(parts, compute).select("period", "model", *CELL, F.col("pr_mean").cast("double"))


@query("a11_csv_export", "SELECT model, avg(pr) AS pr, avg(tran) AS tran, count(*) AS n FROM panel_month GROUP BY model", "pr tran")
def _(v, spark):
    path = catalog.shared_folder(spark, "csv")
    catalog.csv_export(v("panel_month").groupBy("model").agg(F.avg("pr").alias("pr"), F.avg("tran").alias("tran"), F.count("*").alias("n")), path)
    return spark.read.csv(path, header=True, schema="model string, pr double, tran double, n long")


# --- conforming ---
query("b1_drop_redundant", f"SELECT {K6}, pr, tran, gpp FROM panel_month", "pr tran gpp")(lambda v, s: conform.drop_redundant(v("panel_month"), ["mrro", "evspsbl", "lai", "mrsos", "tas", "huss", "ps", "no_such_variable"]))
query("b19_remove_variables", f"SELECT {K6}, tas FROM panel_month", "tas")(lambda v, s: conform.drop_redundant(v("panel_month"), ["mrro", "evspsbl", "lai", "mrsos", "pr", "tran", "gpp", "huss", "ps"]))
add_cte("b2_conform_axis_by_rank", "r AS (SELECT lat + 0.25 AS lat, dense_rank() OVER (ORDER BY lat) AS rank FROM (SELECT DISTINCT lat FROM panel_month)), p AS (SELECT *, dense_rank() OVER (PARTITION BY model ORDER BY lat) AS rank FROM panel_month)",
        "SELECT model, r.lat, lon, year, month, pr FROM p JOIN r ON p.rank = r.rank", "lat pr")(
    lambda v, s: conform.by_axis(v("panel_month").select("model", *CELL, "year", "month", "pr"), _axis(v), ["model"], "lat")
)


query("b2_merge_tables", "SELECT model, lat, lon, year, month, pr, CASE WHEN month <= 6 THEN lai END AS lai FROM panel_month", "pr lai")(
    lambda v, s: _merged(v("panel_month").select("model", *CELL, "year", "month", "pr"), v("panel_month").where("month <= 6").select("model", (F.col("lat") + 0.25).alias("lat"), "lon", "year", "month", "lai"), _axis(v))
)


def _merged(first: DataFrame, second: DataFrame, axis: DataFrame) -> DataFrame:
    """The second table takes the first's latitudes by position; then both are merged."""
    moved = conform.by_axis(second, axis.withColumn("lat", F.col("lat") - 0.25), ["model"], "lat")
    return conform.merge_tables([first, moved], ["model", *CELL, "year", "month"])


def _axis(v) -> DataFrame:
    """The latitudes of the grid, by rank: a few rows."""
    lats = v("panel_month").select("lat").distinct().agg(F.sort_array(F.collect_list("lat")).alias("lats"))
    return lats.select(F.posexplode("lats").alias("i", "x")).select((F.col("i") + 1).alias("rank"), (F.col("x") + 0.25).alias("lat"))


_DAYS = "day(last_day(make_date(year, month, 1)))"
query("b5_month_length", f"SELECT DISTINCT year, month, CAST({_DAYS} AS INT) AS standard, CAST(CASE WHEN month = 2 THEN 28 ELSE {_DAYS} END AS INT) AS noleap, CAST(CASE WHEN month = 2 THEN 29 ELSE {_DAYS} END AS INT) AS all_leap, CAST(30 AS INT) AS equal FROM panel_month")(
    lambda v, s: v("panel_month").select("year", "month").distinct().select("year", "month", *[C.month_length(F.col("year"), F.col("month"), c).alias(n) for c, n in (("standard", "standard"), ("noleap", "noleap"), ("all_leap", "all_leap"), ("360_day", "equal"))])
)
add_cte("b7_pad_days", "o AS (SELECT * FROM panel_day WHERE year(day) = 1996), s AS (SELECT cell, min(day) AS a, max(day) AS b FROM o GROUP BY cell), x AS (SELECT cell, a, b, CAST(unnest(generate_series(DATE '1995-12-01', DATE '1997-03-31', INTERVAL 1 DAY)) AS DATE) AS day FROM s)",
        "SELECT cell, CAST(day AS VARCHAR) AS day, pr FROM o UNION ALL SELECT cell, CAST(day AS VARCHAR), NULL FROM x WHERE (day < a OR day > b) AND NOT (month(day) = 2 AND day(day) = 29)", "pr")(
    lambda v, s: conform.pad_days(v("panel_day").where("year(day) = 1996"), ["cell"], "1995-12-01", "1997-03-31", leap=False).withColumn("day", F.col("day").cast("string"))
)
add_cte("b9_conform_months", """s AS (SELECT model, lat, lon, year * 12 + month - 1 AS m, pr FROM panel_month WHERE year BETWEEN 1995 AND 1997), g AS (SELECT model, lat, lon, min(m) AS a, max(m) AS b FROM s GROUP BY ALL),
    x AS (SELECT model, lat, lon, a, b, unnest(range(1995 * 12, 1998 * 12)) AS m FROM g), p AS (SELECT model, lat, lon, m, pr FROM s UNION ALL SELECT model, lat, lon, m, NULL FROM x WHERE m < a OR m > b),
    r AS (SELECT *, 1995 * 12 + dense_rank() OVER (PARTITION BY model, lat, lon ORDER BY m) - 1 AS t FROM p)""",
        "SELECT model, lat, lon, CAST(t // 12 AS INT) AS year, CAST(t % 12 + 1 AS INT) AS month, pr FROM r", "pr")(
    lambda v, s: conform.conform_months(history(v).select("model", *CELL, "year", "month", "pr"), R.calendar(s, 1995), ["model", *CELL], (1995, 1), (1997, 12), exact=False)
)
query("b9_day_coverage", "SELECT cell, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, min(day) = DATE '1996-01-01' AND max(day) = DATE '1996-12-31' AS covered FROM panel_day WHERE year(day) = 1996 GROUP BY cell")(
    lambda v, s: conform.day_coverage(v("panel_day"), ["cell"], "1996-01-01", "1996-12-31").withColumns({c: F.col(c).cast("string") for c in ("first", "last")})
)
add_cte("b11_regrid_nearest", """g AS (SELECT model, lat, lon, avg(pr) AS pr FROM panel_month WHERE experiment = 'historical' GROUP BY ALL), y AS (SELECT t, (min({'d': abs(lat - t), 'x': lat})).x AS lat FROM (SELECT DISTINCT lat FROM g), (VALUES (-45.0), (-15.0), (15.0), (45.0)) a(t) GROUP BY t),
    z AS (SELECT t, (min({'d': least(abs(lon - t), abs(360 - abs(lon - t))), 'x': lon})).x AS lon FROM (SELECT DISTINCT lon FROM g), (VALUES (-120.0), (-30.0), (60.0), (150.0)) b(t) GROUP BY t)""",
        "SELECT model, CAST(y.t AS DOUBLE) AS lat, CAST(z.t AS DOUBLE) AS lon, pr FROM g JOIN y ON g.lat = y.lat JOIN z ON g.lon = z.lon", "pr")(
    lambda v, s: conform.regrid_nearest(history(v).groupBy("model", *CELL).agg(F.avg("pr").alias("pr")), s.range(16).select((-45.0 + 30 * (F.col("id") % 4)).alias("lat"), (-120.0 + 90 * F.floor(F.col("id") / 4)).alias("lon")), ["pr"], ["model"])
)
_SIDES = ", ".join(f"(SELECT CAST(t AS DOUBLE) AS t, ({lo} + {step} * floor((t - ({lo})) / {step}) + {step} * k {wrap}) AS s, CASE k WHEN 0 THEN 1 - (t - ({lo})) / {step} + floor((t - ({lo})) / {step}) ELSE (t - ({lo})) / {step} - floor((t - ({lo})) / {step}) END AS w FROM (VALUES {ts}) a(t), (VALUES (0), (1)) b(k)) {n}" for n, lo, step, ts, wrap in (("y", -50.5, 20, "(-45.0), (-15.0), (15.0), (45.0)", ""), ("z", -135.5, 90, "(-120.0), (-30.0), (60.0), (150.0)", "- CASE WHEN -135.5 + 90 * floor((t + 135.5) / 90) + 90 * k > 180 THEN 360 ELSE 0 END")))
query("b11_regrid_bilinear", f"SELECT model, y.t AS lat, z.t AS lon, CASE WHEN sum(CASE WHEN pr IS NOT NULL THEN y.w * z.w END) >= 1 - 1e-9 THEN sum(pr * y.w * z.w) END AS pr FROM (SELECT model, lat, lon, avg(pr) AS pr FROM panel_month WHERE experiment = 'historical' GROUP BY ALL) g, {_SIDES} WHERE g.lat = y.s AND g.lon = z.s GROUP BY model, y.t, z.t", "pr")(
    lambda v, s: conform.regrid_bilinear(history(v).groupBy("model", *CELL).agg(F.avg("pr").alias("pr")), s.range(16).select((-45.0 + 30 * (F.col("id") % 4)).alias("lat"), (-120.0 + 90 * F.floor(F.col("id") / 4)).alias("lon")), ["pr"], ["model"])
)
query("b13_remove_antarctica", "SELECT cell, lat - 20 AS lat, bgws FROM change_frame WHERE lat - 20 > -60", "bgws")(lambda v, s: conform.remove_antarctica(v("change_frame").withColumn("lat", F.col("lat") - 20)).select("cell", "lat", "bgws"))
query("b15_cell_region", "SELECT DISTINCT lat, lon, CASE WHEN lon < 0 THEN 'box' ELSE 'peak' END AS region FROM panel_month WHERE (lon > -160 AND lon < -20 AND lat > -60 AND lat < 0) OR (lat > -60 AND lon > 80 * (lat + 60) / 140 AND lon < 160 - 80 * (lat + 60) / 140)")(
    lambda v, s: conform.region_of(v("panel_month"), s.createDataFrame([("box", [(-160.0, -60.0), (-20.0, -60.0), (-20.0, 0.0), (-160.0, 0.0)]), ("peak", [(0.0, -60.0), (160.0, -60.0), (80.0, 80.0)])], "region string, ring array<struct<lon:double,lat:double>>"))
)
query("b15_region_with_hole", "SELECT DISTINCT lat, lon, 'ring' AS region FROM change_frame WHERE lat > -50.25 AND lat < 70.25 AND lon > -160.25 AND lon < 160.25 AND NOT (lat > -20.25 AND lat < 40.25 AND abs(lon) < 60.25)")(
    lambda v, s: conform.region_of(v("change_frame"), s.createDataFrame([("ring", [(-160.25, -50.25), (160.25, -50.25), (160.25, 70.25), (-160.25, 70.25)]), ("ring", [(-60.25, -20.25), (-60.25, 40.25), (60.25, 40.25), (60.25, -20.25)])], "region string, ring array<struct<lon:double,lat:double>>"))
)
query("b17_provenance", "SELECT CAST(0 AS INT) AS seq, 'read' AS step, model, count(*) AS n_rows FROM panel_month GROUP BY model UNION ALL SELECT 1, 'historical', model, count(*) FROM panel_month WHERE experiment = 'historical' GROUP BY model")(
    lambda v, s: catalog.provenance([("read", v("panel_month")), ("historical", history(v))], ["model"])
)
query("b18_no_landmask_names", f"SELECT {K6}, pr AS pr_no_landmask FROM panel_month", "pr_no_landmask")(lambda v, s: conform.no_landmask_names(v("panel_month").select(*_KEYS, "pr"), ["pr"]))
query("b21_preprocess", f"SELECT {K6}, pr * CASE WHEN lon > 0 THEN 1.0 END AS pr, (tas - 273.15) * CASE WHEN lon > 0 THEN 1.0 END AS tas FROM panel_month WHERE year BETWEEN 1996 AND 1999", "pr tas")(
    lambda v, s: conform.preprocess(v("panel_month"), ["mrro", "tran", "evspsbl", "lai", "mrsos", "huss", "ps", "gpp"], (1996, 1), (1999, 12), {"tas": ("K", "C")}, ["pr", "tas"], v("panel_month").select(*CELL).distinct().withColumn("landseamask", F.when(F.col("lon") > 0, 1.0)))
)

_TWO_CELLS = "(VALUES (-50.5, 44.5), (49.5, -135.5), (-70.5, 44.5)) c(lat, lon)"
query("b21_preprocess_whole", f"SELECT experiment, model, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, CAST(year + 55 AS INT) AS year, month, CASE WHEN lon > 0 THEN pr END AS pr, CASE WHEN lon > 0 THEN tas - 273.15 END AS tas FROM (SELECT experiment, model, year, month, avg(pr) AS pr, avg(tas) AS tas FROM panel_month WHERE experiment = 'historical' AND (year, month) <> (1995, 1) GROUP BY ALL UNION ALL SELECT DISTINCT experiment, model, 1995, 1, NULL, NULL FROM panel_month WHERE experiment = 'historical'), {_TWO_CELLS} WHERE lat > -60 AND lat < 40", "pr tas")(
    lambda v, s: _preprocessed(v, s)
)


def _preprocessed(v, spark) -> DataFrame:
    """Padding, position and named regions: months from February 1995 on at three cells, one of them in Antarctica, one in a region that goes."""
    cells = spark.createDataFrame([(-50.5, 44.5), (49.5, -135.5), (-70.5, 44.5)], "lat double, lon double")
    months = history(v).where("not (year = 1995 and month = 1)").groupBy("experiment", "model", "year", "month").agg(F.avg("pr").alias("pr"), F.avg("tas").alias("tas"), F.avg("lai").alias("lai"))
    regions = cells.withColumn("region", F.when(F.col("lat") > 40, "Greenland").otherwise("rest"))
    mask = cells.withColumn("landseamask", F.when(F.col("lon") > 0, 1.0))
    return conform.preprocess(months.crossJoin(F.broadcast(cells)), ["lai"], (1995, 1), (1997, 12), {"tas": ("K", "C")}, ["pr", "tas"], mask, calendar=R.calendar(spark, 2050), regions=regions, remove=["Greenland"])  # three cells


# --- derived variables ---
query("c5_rx1day", "SELECT cell, CAST(year(day) AS INT) AS year, CASE WHEN count(pr) = dayofyear(make_date(year(day), 12, 31)) THEN max(pr) END AS rx1day FROM panel_day GROUP BY cell, year(day)", "rx1day")(lambda v, s: panel.rx1day(v("panel_day")))
add_cte("c7_rx5day_ratio", "t AS (SELECT *, CASE WHEN count(pr) OVER w = 5 THEN sum(pr) OVER w END AS t FROM panel_day WINDOW w AS (PARTITION BY cell ORDER BY day RANGE BETWEEN INTERVAL 4 DAYS PRECEDING AND CURRENT ROW)), y AS (SELECT cell, year(day) AS year, max(t) AS rx5day FROM t GROUP BY ALL), m AS (SELECT cell, year(day) AS year, month(day) AS month, avg(pr) AS pr FROM panel_day GROUP BY ALL), a AS (SELECT cell, year, avg(pr) * 365 AS total FROM m GROUP BY ALL)",
        "SELECT y.cell, CAST(y.year AS INT) AS year, rx5day / CASE WHEN total > 0 THEN total END AS rx5day_ratio FROM y JOIN a ON y.cell = a.cell AND y.year = a.year", "rx5day_ratio")(
    lambda v, s: panel.rx5day_ratio(panel.rolling_max(v("panel_day")), v("panel_day").groupBy("cell", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.avg("pr").alias("pr")))
)
query("c8_safe_ratio", f"SELECT {K6}, tran / CASE WHEN mrro > 1e-12 THEN mrro END AS ratio FROM panel_month", "ratio")(lambda v, s: v("panel_month").select(*_KEYS, C.safe_ratio(F.col("tran"), F.col("mrro")).alias("ratio")))
_RATIO = "(mrro - tran) / CASE WHEN pr > 1e-12 THEN pr END * 100"
query("c12_partitioning_ratio", f"SELECT {K6}, CASE WHEN {_RATIO} BETWEEN -100 AND 100 THEN {_RATIO} END AS ratio FROM panel_month", "ratio")(lambda v, s: v("panel_month").select(*_KEYS, C.partition(F.col("mrro"), F.col("tran"), F.col("pr"), "null").alias("ratio")))
query("c13_pr_shares", f"SELECT {K6}, CASE WHEN pr > 1e-12 AND tran / pr * 100 BETWEEN 0 AND 100 THEN tran / pr * 100 END AS tran_pr, CASE WHEN pr > 1e-12 AND mrro / pr * 100 BETWEEN 0 AND 100 THEN mrro / pr * 100 END AS mrro_pr FROM panel_month", "tran_pr mrro_pr")(
    lambda v, s: v("panel_month").select(*_KEYS, *[C.inside(C.safe_ratio(F.col(c), F.col("pr")) * 100, 0, 100).alias(f"{c}_pr") for c in ("tran", "mrro")])
)
_CLASSES = '(primf + secdf) * 100 AS forest, (c3ann + c4ann + c3per + c4per + c3nfx) * 100 AS cropland, (pastr + "range") * 100 AS grazing_land, (primn + secdn) * 100 AS natural_non_forest'
query("c14_land_use", f"SELECT experiment, lat, lon, year, {_CLASSES} FROM landuse_year", " ".join(panel.LAND_USE))(lambda v, s: panel.land_use(v("landuse_year")).select("experiment", *CELL, "year", *panel.LAND_USE))
add_cte("c15_carbon", "c AS (SELECT cell, price AS cVeg, pr AS cLeaf, size AS cRoot, tax AS lai, disc AS nVeg FROM change_frame)",
        "SELECT cell, cVeg - cLeaf - cRoot AS cWood, cVeg / nullif(nVeg, 0) AS cVeg_nVeg, lai / nullif(cLeaf, 0) AS lai_cLeaf, cLeaf / nullif(cVeg, 0) AS f_leaf, cRoot / nullif(cVeg, 0) AS f_root, (cVeg - cLeaf - cRoot) / nullif(cVeg, 0) AS f_wood FROM c", "cWood cVeg_nVeg lai_cLeaf f_leaf f_root f_wood")(
    lambda v, s: panel.carbon(v("change_frame").select("cell", F.col("price").alias("cVeg"), F.col("pr").alias("cLeaf"), F.col("size").alias("cRoot"), F.col("tax").alias("lai"), F.col("disc").alias("nVeg"))).drop("cVeg", "cLeaf", "cRoot", "lai", "nVeg")
)
_LULCC = "CASE year % 4 WHEN 0 THEN 'ssp126' WHEN 1 THEN 'ssp126-ssp370Lu' WHEN 2 THEN 'ssp370-ssp126Lu' ELSE 'ssp370' END"
add_cte("c17_sustain_lulcc", f"e AS (SELECT {_LULCC} AS experiment, model, lat, lon, avg(pr) AS pr FROM panel_month GROUP BY ALL), p AS (SELECT model, lat, lon, max(CASE WHEN experiment = 'ssp126' THEN pr END) AS a, max(CASE WHEN experiment = 'ssp126-ssp370Lu' THEN pr END) AS b, max(CASE WHEN experiment = 'ssp370-ssp126Lu' THEN pr END) AS c, max(CASE WHEN experiment = 'ssp370' THEN pr END) AS d FROM e GROUP BY ALL)",
        "SELECT model, lat, lon, 0.5 * (a - b) + 0.5 * (c - d) AS pr FROM p", "pr")(
    lambda v, s: panel.sustain_lulcc(v("panel_month").groupBy(F.expr(_LULCC).alias("experiment"), "model", *CELL).agg(F.avg("pr").alias("pr")), ["pr"], ["model", *CELL])
)
_MIXED = "k AS (SELECT experiment, model, lat, lon, year, month, CASE WHEN model = 'M0' THEN tas - 273.15 ELSE tas END AS t FROM panel_month)"
add_cte("c18_to_celsius", _MIXED, f"SELECT {K6}, CASE WHEN avg(t) OVER (PARTITION BY model) > 150 OR max(t) OVER (PARTITION BY model) > 100 THEN t - 273.15 ELSE t END AS tas FROM k", "tas")(
    lambda v, s: panel.to_celsius(v("panel_month").withColumn("tas", F.expr("CASE WHEN model = 'M0' THEN tas - 273.15 ELSE tas END"))).select(*_KEYS, "tas")
)
query("c20_residual", "SELECT model, year, 365 * (pr - mrro - evapo) - (mrso - lag(mrso) OVER (PARTITION BY model ORDER BY year)) AS residual FROM (SELECT model, year, avg(pr) AS pr, avg(mrro) AS mrro, avg(evspsbl - tran) AS evapo, avg(mrsos) AS mrso FROM panel_month GROUP BY ALL)", "residual")(
    lambda v, s: panel.budget_series(v("panel_month").groupBy("model", "year").agg(F.avg("pr").alias("pr"), F.avg("mrro").alias("mrro"), F.avg(F.col("evspsbl") - F.col("tran")).alias("evapo"), F.avg("mrsos").alias("mrso")), ["model"]).select("model", "year", "residual")
)

# --- time ---
query("d1_select_period", f"SELECT {K6}, pr FROM panel_month WHERE year BETWEEN 1996 AND 1998", "pr")(lambda v, s: panel.select_years(v("panel_month"), 1996, 1998).select(*_KEYS, "pr"))
query("d3_subset_by_year", "SELECT cell, CAST(day AS VARCHAR) AS day, pr FROM panel_day WHERE year(day) BETWEEN 1996 AND 1997", "pr")(
    lambda v, s: panel.select_years(v("panel_day").withColumn("year", F.year("day")), 1996, 1997).select("cell", F.col("day").cast("string"), "pr")
)
query("e2_temporal_statistic", "SELECT experiment, model, lat, lon, stddev_pop(mrro) AS mrro_std, min(year) AS first, max(year) AS last FROM panel_month GROUP BY ALL", "mrro_std")(
    lambda v, s: v("panel_month").groupBy("experiment", "model", *CELL).agg(panel.STATS["std"]("mrro").alias("mrro_std"), F.min("year").alias("first"), F.max("year").alias("last"))
)
query("e4_period_mean", "SELECT experiment, model, lat, lon, avg(tas) AS tas_mean FROM panel_month GROUP BY ALL", "tas_mean")(lambda v, s: panel.stats(v("panel_month"), ["tas"], ["mean"], ["experiment", "model", *CELL]))
query("e5_landuse_period_mean", 'SELECT experiment, lat, lon, avg(primf) AS primf_mean, avg("range") AS range_mean FROM landuse_year GROUP BY experiment, lat, lon', "primf_mean range_mean")(lambda v, s: panel.stats(v("landuse_year"), ["primf", "range"], ["mean"], ["experiment", *CELL]))
query("e10_annual_mean", "SELECT model, lat, lon, year, avg(pr) AS pr, avg(tran) AS tran FROM panel_month GROUP BY ALL", "pr tran")(lambda v, s: panel.stats(v("panel_month"), ["pr", "tran"], ["mean"], ["model", *CELL, "year"], ""))
add_cte("e14_yearly_period_mean", "y AS (SELECT cell, year(day) AS year, max(pr) AS rx1day FROM panel_day GROUP BY ALL)", "SELECT cell, avg(rx1day) AS rx1day FROM y GROUP BY cell", "rx1day")(lambda v, s: panel.stats(panel.rolling_max(v("panel_day")), ["rx1day"], ["mean"], ["cell"], ""))
add_cte("e15_yearly_global_series", "y AS (SELECT model, lat, lon, year, avg(pr) AS pr FROM panel_month GROUP BY ALL)", f"SELECT model, year, sum(pr * {W}) / sum({W}) AS pr FROM y GROUP BY model, year", "pr")(
    lambda v, s: panel.spatial_stats(panel.stats(v("panel_month"), ["pr"], ["mean"], ["model", *CELL, "year"], ""), "pr", ["model", "year"]).select("model", "year", F.col("mean").alias("pr"))
)

# --- space ---
_LABEL = "CASE WHEN {x} > 0 THEN 'Positive Historical BGWS' WHEN {x} < 0 THEN 'Negative Historical BGWS' END"


def own_regimes(v, spark) -> DataFrame:
    """Each model's own regime by cell."""
    m = means(v, spark).where("period = 'hist'")
    return m.select("model", *CELL, regimes.regime(F.col("bgws_tran"), "historical", "bgws").alias("regime")).where("regime is not null")


def mean_regimes(v, spark) -> DataFrame:
    """The regime of the mean over models by cell."""
    m = panel.ensemble(means(v, spark).where("period = 'hist'"), ["bgws_tran"], CELL)
    return m.select(*CELL, regimes.regime(F.col("bgws_tran"), "historical", "bgws").alias("regime")).where("regime is not null")


_BASE = f"base AS (SELECT lat, lon, {_LABEL.format(x='avg(bgws_tran)')} AS regime FROM b WHERE period = 'hist' GROUP BY lat, lon)"
add_cte("f5_spatial_mean_by_regime", R._MEANS + f", own AS (SELECT model, lat, lon, {_LABEL.format(x='bgws_tran')} AS regime FROM b WHERE period = 'hist')",
        f"SELECT period, model, regime, sum(pr_mean * {W}) / sum({W}) AS pr FROM b JOIN own USING (model, lat, lon) WHERE regime IS NOT NULL GROUP BY period, model, regime", "pr")(
    lambda v, s: means(v, s).join(own_regimes(v, s), ["model", *CELL]).groupBy("period", "model", "regime").agg(C.weighted_mean(F.col("pr_mean"), C.weight(F.col("lat"))).alias("pr"))
)
_Y = ", y AS (SELECT model, lat, lon, year, avg(pr) AS pr, avg(mrro) AS mrro, avg(tran) AS tran, avg(evspsbl - tran) AS evapo, avg(mrsos) AS mrso FROM panel_month SEMI JOIN msk USING (lat, lon) GROUP BY ALL)"
add_cte("f7_regional_series", R._MEANS + _Y + f", g AS (SELECT model, year, {_REGION} AS region, {', '.join(f'sum({c} * {W}) / sum({W}) AS {c}' for c in ('pr', 'mrro', 'tran', 'evapo', 'mrso'))} FROM y GROUP BY ALL), d AS (SELECT *, mrso - lag(mrso) OVER (PARTITION BY model, region ORDER BY year) AS dS FROM g)",
        "SELECT model, region, year, dS / (pr * 365) * 100 AS dS_over_P, 365 * (pr - mrro - evapo) - dS AS residual, least(greatest((mrro - tran) / pr * 100, -100), 100) AS bgws_tran FROM d", "dS_over_P residual bgws_tran")(
    lambda v, s: panel.regional_series(v("panel_month").withColumns({"evapo": F.col("evspsbl") - F.col("tran"), "mrso": F.col("mrsos")}), hydro(v, s), region(v("panel_month"))).select("model", "region", "year", "dS_over_P", "residual", "bgws_tran")
)
add_cte("f8_regional_drivers", "y AS (SELECT model, lat, lon, year, avg(tas) AS tas, avg(lai) AS lai, stddev_pop(pr) AS pr_seasonality FROM panel_month GROUP BY ALL)",
        f"SELECT model, year, {_REGION} AS region, {', '.join(f'sum({c} * {W}) / sum({W}) AS {c}' for c in ('tas', 'lai', 'pr_seasonality'))} FROM y GROUP BY ALL", "tas lai pr_seasonality")(
    lambda v, s: panel.regional_mean(v("panel_month").groupBy("model", *CELL, "year").agg(F.avg("tas").alias("tas"), F.avg("lai").alias("lai"), F.stddev_pop("pr").alias("pr_seasonality")), region(v("panel_month")), ["tas", "lai", "pr_seasonality"], ["model", "year"])
)


# --- ensemble and change ---
def far(v, spark) -> DataFrame:
    """model, lat, lon, base, future, x, y: bgws of both ends, and the changes of bgws and pr."""
    of = lambda p, c, name: F.max(F.when(F.col("period") == p, F.col(c))).alias(name)
    ends = [of(p, c, n) for p, c, n in (("hist", "bgws_tran", "base"), ("far", "bgws_tran", "future"), ("hist", "pr_mean", "_p0"), ("far", "pr_mean", "_p1"))]
    both = means(v, spark).where("period in ('hist', 'far')").groupBy("model", *CELL).agg(F.count("*").alias("_n"), *ends).where("_n = 2")
    return both.select("model", *CELL, "base", "future", (F.col("future") - F.col("base")).alias("x"), (F.col("_p1") - F.col("_p0")).alias("y"))


_X = R._MEANS + ", x AS (SELECT model, lat, lon, h.bgws_tran AS base, a.bgws_tran AS future, a.bgws_tran - h.bgws_tran AS x, a.pr_mean - h.pr_mean AS y FROM b a JOIN b h USING (model, lat, lon) WHERE a.period = 'far' AND h.period = 'hist')"
_CATEGORY = "CASE WHEN base < 0 AND x < 0 THEN 'Greener' WHEN base < 0 AND x > 0 THEN 'Less green' WHEN base > 0 AND x < 0 THEN 'Less blue' WHEN base > 0 AND x > 0 THEN 'Bluer' END"
add_cte("f11_area_change_percent", _X + f", l AS (SELECT model, lat, {_CATEGORY} AS label FROM x)", f"SELECT model, label, 100 * sum({W}) / sum(sum({W})) OVER (PARTITION BY model) AS percent FROM l WHERE label IS NOT NULL GROUP BY model, label", "percent")(
    lambda v, s: regimes.areas(far(v, s), regimes.change_category(F.col("base"), F.col("x")), ["model"])
)
add_cte("f12_flip_percent", _X, f"SELECT model, 100 * sum(CASE WHEN base > 0 AND future < 0 THEN {W} ELSE 0 END) / sum({W}) AS pos_to_neg, 100 * sum(CASE WHEN base < 0 AND future > 0 THEN {W} ELSE 0 END) / sum({W}) AS neg_to_pos FROM x GROUP BY model", "pos_to_neg neg_to_pos")(
    lambda v, s: regimes.flips(far(v, s), "base", "future", ["model"])
)
add_cte("g2_member_ensemble", "m AS (SELECT model, lat, lon, year, month % 2 AS member, avg(pr) AS pr FROM panel_month GROUP BY ALL)", "SELECT model, lat, lon, year, avg(pr) AS pr FROM m GROUP BY ALL", "pr")(
    lambda v, s: panel.ensemble(v("panel_month").groupBy("model", *CELL, "year", (F.col("month") % 2).alias("member")).agg(F.avg("pr").alias("pr")), ["pr"], ["model", *CELL, "year"])
)
add_cte("g5_late_minus_early", R._MEANS, "SELECT lat, lon, avg(a.bgws_tran - h.bgws_tran) AS bgws_tran FROM b a JOIN b h USING (model, lat, lon) WHERE a.period = 'far' AND h.period = 'near' GROUP BY lat, lon", "bgws_tran")(
    lambda v, s: panel.ensemble(panel.change(means(v, s).where("period in ('near', 'far')"), ["bgws_tran"], "near"), ["bgws_tran"], CELL)
)
add_cte("g6_relative_change", R._MEANS + ", r AS (SELECT a.period || '-hist' AS period, model, lat, lon, 100 * (a.tran_mean - h.tran_mean) / h.tran_mean AS tran_mean FROM b a JOIN b h USING (model, lat, lon) WHERE a.period <> 'hist' AND h.period = 'hist')",
        "SELECT period, model, lat, lon, tran_mean FROM r UNION ALL SELECT period, 'ensemble mean', lat, lon, avg(tran_mean) FROM r GROUP BY period, lat, lon", "tran_mean")(
    lambda v, s: panel.relative_change(means(v, s), ["tran_mean"], "hist")
)
add_cte("g11_combine", R._MEANS + ", d AS (SELECT model, lat, lon, stddev_pop(m) AS pr_seasonality FROM (SELECT model, lat, lon, month, avg(pr) AS m FROM panel_month GROUP BY ALL) GROUP BY ALL)",
        "SELECT period, model, lat, lon, bgws_tran, pr_seasonality FROM b JOIN d USING (model, lat, lon) WHERE model <> 'M2'", "bgws_tran pr_seasonality")(
    lambda v, s: panel.combine(means(v, s).select("period", "model", *CELL, "bgws_tran"), panel.seasonality(v("panel_month"), "pr", ["model", *CELL]), ["model", *CELL], ("M2",))
)
_HIT = f"hit AS (SELECT p.*, period FROM panel_month p JOIN {R._PERIODS_SQL} ON p.experiment = periods.experiment AND p.year BETWEEN y0 AND y1)"
_OWN = ("tas_mean", "lai_mean", "pr_seasonality")
add_cte("g13_driver_period_stats", R._MEANS + f", {_HIT}, d AS (SELECT period, model, lat, lon, avg(tas) - 273.15 AS tas_mean, avg(lai) AS lai_mean FROM hit GROUP BY ALL), se AS (SELECT period, model, lat, lon, stddev_pop(m) AS pr_seasonality FROM (SELECT period, model, lat, lon, month, avg(pr) AS m FROM hit GROUP BY ALL) GROUP BY ALL), "
        + "k AS (SELECT period, model, d.lat, d.lon, " + ", ".join(f"CASE WHEN msk.lat IS NOT NULL THEN {c} END AS {c}" for c in _OWN) + " FROM d JOIN se USING (period, model, lat, lon) LEFT JOIN msk ON msk.lat = d.lat AND msk.lon = d.lon), "
        + "u AS (SELECT * FROM k UNION ALL SELECT a.period || '-hist', model, lat, lon, " + ", ".join(f"a.{c} - h.{c}" for c in _OWN) + " FROM k a JOIN k h USING (model, lat, lon) WHERE a.period <> 'hist' AND h.period = 'hist')",
        "SELECT period, lat, lon, " + ", ".join(f"avg({c}) AS {c}" for c in _OWN) + " FROM u GROUP BY period, lat, lon", " ".join(_OWN))(
    lambda v, s: panel.driver_product(panel.to_celsius(v("panel_month")), periods(s), "hist", ["tas", "lai"], ["pr"], hydro(v, s))
)
_SELECTED = ("pr_mean", "lai_mean", "pr_seasonality", "bgws_tran", "forest", "cropland")
add_cte("g14_selected_driver_product", f"{_HIT}, d AS (SELECT period, model, lat, lon, avg(pr) AS pr_mean, avg(tran) AS tran_mean, avg(mrro) AS mrro_mean, avg(lai) AS lai_mean FROM hit WHERE model IN ('M0', 'M1') GROUP BY ALL), se AS (SELECT period, model, lat, lon, stddev_pop(m) AS pr_seasonality FROM (SELECT period, model, lat, lon, month, avg(pr) AS m FROM hit GROUP BY ALL) GROUP BY ALL), "
        f"lu AS (SELECT period, lat, lon, avg(primf + secdf) * 100 AS forest, avg(c3ann + c4ann + c3per + c4per + c3nfx) * 100 AS cropland FROM landuse_year l JOIN {R._PERIODS_SQL} ON l.experiment = periods.experiment AND l.year BETWEEN y0 AND y1 GROUP BY period, lat, lon), "
        "b AS (SELECT *, least(greatest((mrro_mean - tran_mean) / (CASE WHEN pr_mean > 1e-12 THEN pr_mean END) * 100, -100), 100) AS bgws_tran FROM d JOIN se USING (period, model, lat, lon) LEFT JOIN lu USING (period, lat, lon)), msk AS (SELECT lat, lon FROM b WHERE period = 'hist' GROUP BY ALL HAVING avg(pr_mean) > 0.822 AND avg(tran_mean) > 0.05 AND avg(mrro_mean) > 0.05), "
        "k AS (SELECT period, model, b.lat, b.lon, " + ", ".join(f"CASE WHEN msk.lat IS NOT NULL THEN {c} END AS {c}" for c in _SELECTED) + " FROM b LEFT JOIN msk ON msk.lat = b.lat AND msk.lon = b.lon), "
        "u AS (SELECT * FROM k UNION ALL SELECT a.period || '-hist', model, lat, lon, " + ", ".join(f"a.{c} - h.{c}" for c in _SELECTED) + " FROM k a JOIN k h USING (model, lat, lon) WHERE a.period <> 'hist' AND h.period = 'hist')",
        "SELECT *, 'member' AS kind FROM u UNION ALL SELECT period, 'ensemble mean', lat, lon, " + ", ".join(f"avg({c})" for c in _SELECTED) + ", 'mean' FROM u GROUP BY period, lat, lon", " ".join(_SELECTED))(
    lambda v, s: panel.selected_driver_product(v("panel_month"), _land_of_models(v, s), periods(s), "hist", ["pr", "tran", "mrro", "lai"], ["pr"]).select("period", "model", *CELL, *_SELECTED, "kind")
)


def _land_of_models(v, spark) -> DataFrame:
    """Land use by period and cell, for two of the three models."""
    models = spark.createDataFrame([("M0",), ("M1",)], "model string")
    return _land_use_means(v, spark).drop("model").crossJoin(F.broadcast(models)).select("period", "model", *CELL, "forest", "cropland")  # two rows


add_cte("g15_monthly_product", R._MEANS + f", {_HIT}, c AS (SELECT period, model, lat, lon, month, least(greatest((avg(mrro) - avg(tran)) / CASE WHEN avg(pr) > 1e-12 THEN avg(pr) END * 100, -100), 100) AS bgws_tran FROM hit GROUP BY ALL), k AS (SELECT period, model, c.lat, c.lon, month, CASE WHEN msk.lat IS NOT NULL THEN bgws_tran END AS bgws_tran FROM c LEFT JOIN msk ON msk.lat = c.lat AND msk.lon = c.lon), "
        "u AS (SELECT * FROM k UNION ALL SELECT a.period || '-hist', model, lat, lon, month, a.bgws_tran - h.bgws_tran FROM k a JOIN k h USING (model, lat, lon, month) WHERE a.period <> 'hist' AND h.period = 'hist')",
        "SELECT period, lat, lon, month, avg(bgws_tran) AS bgws_tran FROM u GROUP BY ALL", "bgws_tran")(
    lambda v, s: panel.monthly_product(v("panel_month"), periods(s), "hist", ["pr", "tran", "mrro"], hydro(v, s))
)
add_cte("g16_reference_mean", R._MEANS, "SELECT period, 'ref' AS kind, lat, lon, bgws_tran FROM b WHERE model = 'M0'", "bgws_tran")(
    lambda v, s: means(v, s).where("model = 'M0'").select("period", F.lit("ref").alias("kind"), *CELL, "bgws_tran")
)
add_cte("g17_land_use_change", f"p AS (SELECT period, lat, lon, {', '.join(f'avg({c}) AS {c}' for c in ('primf', 'secdf', 'c3ann', 'c4ann', 'c3per', 'c4per', 'c3nfx', 'pastr', 'primn', 'secdn'))}, avg(\"range\") AS \"range\" FROM landuse_year l JOIN {R._PERIODS_SQL} ON l.experiment = periods.experiment AND l.year BETWEEN y0 AND y1 GROUP BY period, lat, lon), c AS (SELECT period, lat, lon, {_CLASSES} FROM p)",
        "SELECT a.period || '-hist' AS period, lat, lon, a.forest - h.forest AS forest, a.cropland - h.cropland AS cropland FROM c a JOIN c h USING (lat, lon) WHERE a.period <> 'hist' AND h.period = 'hist'", "forest cropland")(
    lambda v, s: _land_use_change(v, s)
)


def _land_use_means(v, spark) -> DataFrame:
    states = [c for names in panel.LAND_USE.values() for c in names]
    mean = panel.period_stats(v("landuse_year").withColumn("model", F.lit("LUH2")), periods(spark), states, ["mean"]).withColumnsRenamed({f"{c}_mean": c for c in states})
    return panel.land_use(mean)


def _land_use_change(v, spark) -> DataFrame:
    return panel.change(_land_use_means(v, spark), ["forest", "cropland"], "hist", by=tuple(CELL))


_SETS = [("3 models", "M0"), ("3 models", "M1"), ("3 models", "M2"), ("2 core models", "M0"), ("2 core models", "M1"), ("1 added model", "M2")]
add_cte("g17_subset_ensembles", R._PRODUCT + f", sets(ensemble, model) AS (VALUES {', '.join(map(repr, _SETS))})", "SELECT ensemble, period, lat, lon, avg(bgws_tran) AS bgws_tran FROM ch JOIN sets USING (model) GROUP BY ensemble, period, lat, lon", "bgws_tran")(
    lambda v, s: panel.subset_ensembles(R.product(v, s).where("kind = 'member' and period like '%-hist'"), ["bgws_tran"], ["period", *CELL], s.createDataFrame(_SETS, "ensemble string, model string"))
)
_FOUR = ("ssp126", "ssp126-ssp370Lu", "ssp370-ssp126Lu", "ssp370")
_SEASON = "CASE WHEN month IN (12, 1, 2) THEN 'DJF' WHEN month <= 5 THEN 'MAM' WHEN month <= 8 THEN 'JJA' ELSE 'SON' END"
_IN = "CASE WHEN msk.lat IS NOT NULL THEN {c} END AS {c}"
_MASKED = "LEFT JOIN msk ON msk.lat = u.lat AND msk.lon = u.lon"


def _sustain_sql(inner: str, own: tuple[str, ...], mean: bool) -> tuple[str, str]:
    """CTEs and select of G17's land-use effects, from means by experiment, model and cell."""
    parts = ", ".join("0.5 * ({0} - {1}) + 0.5 * ({2} - {3}) AS {c}".format(*[f"max(CASE WHEN experiment = '{e}' THEN {c} END)" for e in _FOUR], c=c) for c in own)
    both = "SELECT *, 'member' AS kind FROM f" + (f" UNION ALL SELECT 'ensemble mean', lat, lon, {', '.join(f'avg({c})' for c in own)}, 'mean' FROM f GROUP BY lat, lon" if mean else "")
    return R._MEANS + f", e AS ({inner}), f AS (SELECT model, lat, lon, {parts} FROM e GROUP BY ALL), u AS ({both})", f"SELECT u.model, u.lat, u.lon, {', '.join(_IN.format(c=c) for c in own)}, kind FROM u {_MASKED}"


def _four(v) -> DataFrame:
    return v("panel_month").withColumn("experiment", F.expr(_LULCC))


_BGWS = "least(greatest((mrro - tran) / (CASE WHEN pr > 1e-12 THEN pr END) * 100, -100), 100) AS bgws_tran"
_EFFECT = ("pr", "tran", "mrro", "lai", "bgws_tran")
add_cte("g17_sustain_annual", *_sustain_sql(f"SELECT *, {_BGWS} FROM (SELECT {_LULCC} AS experiment, model, lat, lon, avg(pr) AS pr, avg(tran) AS tran, avg(mrro) AS mrro, avg(lai) AS lai FROM panel_month GROUP BY ALL)", _EFFECT, True), " ".join(_EFFECT))(
    lambda v, s: panel.sustain_product(_four(v), list(_EFFECT[:4]), hydro(v, s), lambda m: panel.partition_metrics(m, ["tran"], ""), ("bgws_tran",))
)
add_cte("g17_land_cover", *_sustain_sql(f"SELECT {_LULCC} AS experiment, model, lat, lon, avg(lai) AS treeFrac, avg(gpp) AS fracLut FROM panel_month GROUP BY ALL", ("treeFrac", "fracLut"), False), "treeFrac fracLut")(
    lambda v, s: panel.sustain_product(_four(v).withColumnsRenamed({"lai": "treeFrac", "gpp": "fracLut"}), ["treeFrac", "fracLut"], hydro(v, s), with_mean=False)
)
_CARBON = ("cVeg", "cLeaf", "cRoot", "nVeg", "lai", "cWood", "cVeg_nVeg", "lai_cLeaf", "f_leaf", "f_root", "f_wood")
add_cte("g17_carbon_nitrogen", *_sustain_sql("SELECT *, cVeg - cLeaf - cRoot AS cWood, cVeg / nullif(nVeg, 0) AS cVeg_nVeg, lai / nullif(cLeaf, 0) AS lai_cLeaf, cLeaf / nullif(cVeg, 0) AS f_leaf, cRoot / nullif(cVeg, 0) AS f_root, (cVeg - cLeaf - cRoot) / nullif(cVeg, 0) AS f_wood FROM "
        f"(SELECT {_LULCC} AS experiment, model, lat, lon, avg(tas) AS cVeg, avg(pr) AS cLeaf, avg(mrsos) AS cRoot, avg(gpp) AS nVeg, avg(lai) AS lai FROM panel_month GROUP BY ALL)", _CARBON, False), " ".join(_CARBON))(
    lambda v, s: panel.sustain_product(_four(v).select("experiment", "model", *CELL, "lai", F.col("tas").alias("cVeg"), F.col("pr").alias("cLeaf"), F.col("mrsos").alias("cRoot"), F.col("gpp").alias("nVeg")), list(_CARBON[:5]), hydro(v, s), panel.carbon, _CARBON[5:], with_mean=False)
)
_HIST = "CASE WHEN year % 2 = 0 THEN 'historical' WHEN model <> 'M1' OR lat > 0 THEN 'hist-noLu' END"
_PAST = ("pr", "tran", "mrro", "bgws_tran")
add_cte("g17_historical_land_use", R._MEANS + f", e AS (SELECT *, {_BGWS} FROM (SELECT {_HIST} AS experiment, model, lat, lon, avg(pr) AS pr, avg(tran) AS tran, avg(mrro) AS mrro FROM panel_month GROUP BY ALL)), f AS (SELECT a.model, a.lat, a.lon, {', '.join(f'a.{c} - h.{c} AS {c}' for c in _PAST)} FROM e a JOIN e h ON a.model = h.model AND a.lat = h.lat AND a.lon = h.lon AND a.experiment = 'historical' AND h.experiment = 'hist-noLu'), "
        f"sets(ensemble, model) AS (VALUES {', '.join(map(repr, _SETS))}), u AS (SELECT * FROM f UNION ALL SELECT ensemble, lat, lon, {', '.join(f'avg({c})' for c in _PAST)} FROM f JOIN sets USING (model) GROUP BY ensemble, lat, lon)",
        f"SELECT u.model, u.lat, u.lon, {', '.join(_IN.format(c=c) for c in _PAST)} FROM u {_MASKED}", " ".join(_PAST))(
    lambda v, s: panel.land_use_history(v("panel_month").withColumn("experiment", F.expr(_HIST)), list(_PAST[:3]), hydro(v, s), s.createDataFrame(_SETS, "ensemble string, model string"), lambda m: panel.partition_metrics(m, ["tran"], ""), ("bgws_tran",))
)
add_cte("g17_sustain_seasonal", f"e AS (SELECT {_LULCC} AS experiment, model, lat, lon, {_SEASON} AS season, least(greatest((avg(mrro) - avg(tran)) / (CASE WHEN avg(pr) > 1e-12 THEN avg(pr) END) * 100, -100), 100) AS x FROM panel_month GROUP BY ALL), p AS (SELECT model, lat, lon, season, " + ", ".join(f"max(CASE WHEN experiment = '{e}' THEN x END) AS x{i}" for i, e in enumerate(_FOUR)) + " FROM e GROUP BY ALL), m AS (SELECT model, lat, lon, season, 0.5 * (x0 - x1) + 0.5 * (x2 - x3) AS bgws_tran FROM p)",
        "SELECT *, 'member' AS kind FROM m UNION ALL SELECT 'ensemble mean', lat, lon, season, avg(bgws_tran), 'mean' FROM m GROUP BY lat, lon, season", "bgws_tran")(
    lambda v, s: _sustain_seasonal(v("panel_month").withColumn("experiment", F.expr(_LULCC)))
)


def _sustain_seasonal(df: DataFrame) -> DataFrame:
    clim = panel.stats(panel.with_season(df), ["pr", "tran", "mrro"], ["mean"], ["experiment", "model", *CELL, "season"], "")
    effect = panel.sustain_lulcc(panel.partition_metrics(clim, ["tran"], ""), ["bgws_tran"], ["model", *CELL, "season"])
    return panel.with_ensemble(effect, ["bgws_tran"], [*CELL, "season"])


# --- regimes and agreement ---
add_cte("h2_subdivide", R._MEANS + ", " + _BASE, "SELECT period, model, lat, lon, regime, bgws_tran FROM b JOIN base USING (lat, lon) WHERE regime IS NOT NULL", "bgws_tran")(
    lambda v, s: regimes.subdivide(means(v, s).select("period", "model", *CELL, "bgws_tran"), mean_regimes(v, s))
)
add_cte("h4_regime_mask", R._MEANS + ", " + _BASE, "SELECT model, lat, lon, CASE WHEN regime = 'Positive Historical BGWS' THEN bgws_tran END AS bgws_tran FROM b JOIN base USING (lat, lon) WHERE regime IS NOT NULL AND period = 'far'", "bgws_tran")(
    lambda v, s: regimes.subdivide(means(v, s).where("period = 'far'"), mean_regimes(v, s)).select("model", *CELL, F.when(F.col("regime") == "Positive Historical BGWS", F.col("bgws_tran")).alias("bgws_tran"))
)
_MAJ = "greatest(avg(CASE WHEN {c} > 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN {c} < 0 THEN 1.0 ELSE 0 END))"
_LOW = "({m} < 0.70 AND {m} >= 0.54545455)"
add_cte("h5_low_agreement", _X + f", m AS (SELECT lat, lon, {_MAJ.format(c='x')} AS majority FROM x GROUP BY lat, lon)", f"SELECT lat, lon, majority, {_LOW.format(m='majority')} AS low FROM m", "majority")(
    lambda v, s: regimes.sign_agreement(far(v, s), "x").select(*CELL, "majority", regimes.low_agreement(F.col("majority")).alias("low"))
)
add_cte("h6_dual_agreement", _X + f", m AS (SELECT lat, lon, {_MAJ.format(c='x')} AS mx, {_MAJ.format(c='y')} AS my FROM x GROUP BY lat, lon), l AS (SELECT lat, lon, {_LOW.format(m='mx')} AS low_x, {_LOW.format(m='my')} AS low_y FROM m)",
        "SELECT lat, lon, low_x, low_y, low_x OR low_y AS any_low, low_x AND low_y AS all_low FROM l", "")(
    lambda v, s: _dual(far(v, s))
)


def _dual(df: DataFrame) -> DataFrame:
    low = lambda c: regimes.sign_agreement(df, c).select(*CELL, regimes.low_agreement(F.col("majority")).alias(f"low_{c}"))
    return low("x").join(low("y"), CELL).withColumns({"any_low": F.col("low_x") | F.col("low_y"), "all_low": F.col("low_x") & F.col("low_y")})


add_cte("h7_low_count", _X + ", m AS (SELECT lat, lon, avg(x) AS mean, CAST(greatest(count(*) FILTER (x > 0), count(*) FILTER (x < 0)) AS BIGINT) AS n_same FROM x GROUP BY lat, lon)", "SELECT lat, lon, n_same, CASE WHEN mean IS NOT NULL THEN n_same < 3 END AS low FROM m", "")(
    lambda v, s: regimes.low_count(far(v, s), "x", far(v, s).groupBy(*CELL).agg(F.avg("x").alias("mean")), 3)
)
add_cte("h9_low_quadrant_agreement", _X + ", q AS (SELECT lat, lon, CASE WHEN x > 0 AND y > 0 THEN 0 WHEN x > 0 AND y < 0 THEN 1 WHEN x < 0 AND y > 0 THEN 2 WHEN x < 0 AND y < 0 THEN 3 END AS q FROM x), n AS (SELECT lat, lon, CAST(greatest(count(*) FILTER (q = 0), count(*) FILTER (q = 1), count(*) FILTER (q = 2), count(*) FILTER (q = 3)) AS BIGINT) AS best, count(q) AS valid, count(*) AS n FROM q GROUP BY lat, lon)",
        "SELECT lat, lon, best, valid, CASE WHEN valid > 0 THEN best < 2 OR valid < ceil(0.55 * n) END AS low FROM n", "")(
    lambda v, s: regimes.low_quadrant_agreement(far(v, s).withColumn("quadrant", regimes.quadrant(F.col("x"), F.col("y"))), least=2)
)
add_cte("h13_ref_disagreement", _X + ", p AS (SELECT lat, lon, sign(avg(CASE WHEN model = 'M0' THEN x END)) AS m, sign(avg(CASE WHEN model = 'M1' THEN x END)) AS a, sign(avg(CASE WHEN model = 'M2' THEN x END)) AS b FROM x GROUP BY lat, lon)", "SELECT lat, lon, coalesce(m <> 0 AND a = -m AND b = -m, false) AS disagrees FROM p", "")(
    lambda v, s: far(v, s).groupBy(*CELL).agg(*[F.avg(F.when(F.col("model") == m, F.col("x"))).alias(m) for m in ("M0", "M1", "M2")]).select(*CELL, regimes.disagreement(F.col("M0"), F.col("M1"), F.col("M2")).alias("disagrees"))
)
add_cte("h17_sign_flip_field", _X, "SELECT model, lat, lon, CASE WHEN sign(base) <> sign(future) THEN future END AS flipped FROM x", "flipped")(lambda v, s: far(v, s).select("model", *CELL, regimes.flipped(F.col("base"), F.col("future")).alias("flipped")))
add_cte("h18_increase_decrease", _X, "SELECT model, lat, lon, x > 5 AS increase, x < -5 AS decrease FROM x", "")(
    lambda v, s: far(v, s).select("model", *CELL, *[c.alias(n) for c, n in zip(regimes.increase_decrease(F.col("x"), 5), ("increase", "decrease"), strict=True)])
)
_CONF = f", c AS (SELECT lat, lon, avg(x) AS mean, count(*) FILTER (x <> 0) AS n_valid, {_MAJ.format(c='x')} >= 0.8 AND count(*) FILTER (x <> 0) >= ceil(0.75 * count(*)) AS confident FROM x GROUP BY lat, lon)"
add_cte("h19_confidence_classes", _X + _CONF + ", k AS (SELECT lat, CAST(CASE WHEN NOT confident THEN 3 WHEN mean > 0 THEN 1 WHEN mean < 0 THEN 2 ELSE 3 END AS INT) AS class FROM c)", f"SELECT class, count(*) AS n, 100 * sum({W}) / sum(sum({W})) OVER () AS percent FROM k GROUP BY class", "percent")(
    lambda v, s: _class_table(regimes.confidence_classes(far(v, s), "x"))
)


def _class_table(df: DataFrame) -> DataFrame:
    return regimes.areas(df, F.col("class"), count="n").select(F.col("label").alias("class"), "n", "percent")


add_cte("h20_retained_fraction", _X + _CONF + ", " + _BASE, "SELECT regime, avg(CASE WHEN confident THEN 1.0 ELSE 0 END) AS retained, median(n_valid) AS n_valid FROM c JOIN base USING (lat, lon) WHERE regime IS NOT NULL GROUP BY regime", "retained n_valid")(
    lambda v, s: regimes.subdivide(regimes.confidence_classes(far(v, s), "x"), mean_regimes(v, s)).groupBy("regime").agg(F.avg(F.col("confident").cast("double")).alias("retained"), F.median("n_valid").alias("n_valid"))
)

# --- series ---
query("i6_linear_fit", "SELECT model, regr_slope(tran, pr) AS slope, regr_intercept(tran, pr) AS intercept FROM panel_month GROUP BY model", "slope intercept")(lambda v, s: series.pearson_and_bias(v("panel_month"), "tran", "pr", ["model"]).select("model", "slope", "intercept"))
query("i12_max_abs_scale", "SELECT cell, CASE WHEN m = 0 THEN 0 ELSE least(greatest(bgws / m, -1), 1) END AS bgws FROM change_frame, (SELECT max(abs(bgws)) AS m FROM change_frame)", "bgws")(
    lambda v, s: v("change_frame").crossJoin(F.broadcast(v("change_frame").agg(F.max(F.abs("bgws")).alias("m")))).select("cell", panel.scale(F.col("bgws"), F.col("m")).alias("bgws"))  # one row
)
_BOUND = "CASE WHEN m = 0 THEN 0 ELSE ceil(m / pow(10, floor(log10(m)))) * pow(10, floor(log10(m))) END"
add_cte("i15_min_max_bound", "m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, min({c}) AS lo, max({c}) AS hi, max(abs({c})) AS m FROM change_frame" for c in ("bgws", "pr", "tax")) + ")", f"SELECT variable, lo, hi, {_BOUND} AS bound FROM m", "lo hi bound")(
    lambda v, s: series.describe(v("change_frame"), ["bgws", "pr", "tax"]).select("variable", F.col("min").alias("lo"), F.col("max").alias("hi"), series.nice_bound(F.greatest(F.abs("min"), F.abs("max"))).alias("bound"))
)

# --- regression jobs ---
query("j1_regime_frame", "SELECT cell, bgws, pr, disc, tax FROM change_frame WHERE bgws > 0", "bgws pr disc tax")(lambda v, s: regress.regime_frame(v("change_frame"), "bgws", ["pr", "disc", "tax"], F.col("bgws") > 0).select("cell", "bgws", "pr", "disc", "tax"))


def _rows(v) -> DataFrame:
    rows = v("change_frame").where("bgws <> 0").withColumn("regime", F.when(F.col("bgws") > 0, "positive").otherwise("negative"))
    return rows.withColumns({"block": regress.block(F.col("lat"), F.col("lon")), "model": F.concat(F.lit("M"), (F.col("cell") % 3).cast("string"))})


def _fit(rows: DataFrame, predictors: list[str], keys: list[str], repeats: int = 40) -> DataFrame:
    moments = regress.block_moments(rows, "bgws", predictors, [*keys, "block"])
    return regress.repeated_elastic_net(moments, regress.group_shuffles(rows, repeats), "bgws", predictors, keys)


query("j11_compare_predictor_sets")(lambda v, s: regress.compare_sets(_fit(_rows(v), ["pr", "disc", "tax"], ["regime"]).withColumn("set", F.lit("full")).unionByName(_fit(_rows(v), ["pr", "tax"], ["regime"]).withColumn("set", F.lit("without disc"))), ["regime"]))
query("j14_per_model")(lambda v, s: regress.importance_table(_fit(_rows(v), ["pr", "disc", "tax"], ["model", "regime"], 20), ["model", "regime"]))


_PREDICTORS = ["pr", "disc", "tax"]


def _in_folds(v, k: int) -> DataFrame:
    """Rows of the forest module with the folds of blocks as data sets."""
    own = _rows(v).join(F.broadcast(catalog.few(regress.group_folds(_rows(v), k))), "block")  # folds: at most 324 rows
    every = F.array(*map(F.lit, range(k)))
    return catalog.stored(forests.forest_rows(own, "bgws", _PREDICTORS, "cell", F.array_remove(every, F.col("fold")), F.array("fold")), "rows")


def _in_repeats(v, repeats: int) -> DataFrame:
    """Rows of the forest module with the random parts of blocks as data sets."""
    which = lambda t: F.collect_list(F.when(F.col("is_test") == t, F.col("repeat")))
    sets = catalog.few(regress.group_shuffles(_rows(v), repeats)).groupBy("block").agg(which(False).alias("train"), which(True).alias("test"))
    rows = forests.forest_rows(_rows(v).join(F.broadcast(sets), "block"), "bgws", _PREDICTORS, "cell", F.col("train"), F.col("test"))  # sets: at most 324 rows
    return catalog.stored(rows, "rows")


query("j18_forest_grid")(lambda v, s: forests.grid_scores(_in_folds(v, 4), 3))
query("j23_overfit_guard")(lambda v, s: regress.overfit_gaps(forests.grid_scores(_in_folds(v, 5), 3, trees=50)))


@query("j19_forest_importance")
def _(v, spark):
    rows = _in_repeats(v, 10)
    forest = forests.grow(rows, 3, [forests.Setting(8, 5, 2, 0.5)], 200)
    permuted = forests.permutation_importance(rows, forest, _PREDICTORS)
    explained = catalog.few(forests.attribution_summary(forests.attribution(rows, forest, _PREDICTORS), _PREDICTORS))
    return forests.repeats_summary(permuted, "importance", "perm").join(forests.repeats_summary(explained, "mean_abs", "shap"), "predictor")


@query("j20_tree_shapley")
def _(v, spark):
    rows = _in_repeats(v, 1)
    forest = forests.grow(rows, 3, [forests.Setting(8, 5, 2, 0.5)], 200)
    return forests.attribution(rows, forest, _PREDICTORS).drop("data", "setting")


@query("j22_plain_forest")
def _(v, spark):
    _, found, table = forests.plain_forest(v("change_frame").where("bgws > 0"), "bgws", _PREDICTORS, "cell")
    return table.select("*", *[F.lit(x).alias(n) for n, x in found.items()])


@query("j19_forest_repeats")
def _(v, spark):
    predictors = ["pr", "disc", "tax"]
    found = regress.forest_repeats(_rows(v), catalog.few(regress.group_shuffles(_rows(v), 12)), "bgws", predictors)
    out = [(r, train, test, train - test, p, weights[p]) for r, train, test, weights in found for p in predictors]
    return spark.createDataFrame(out, "repeat int, train_r2 double, test_r2 double, gap double, predictor string, importance double")


@query("j20_shapley")
def _(v, spark):
    rows = _in_repeats(v, 1)
    forest = forests.grow(rows, 3, [forests.Setting(8, 5, 2, 0.5)], 200)
    others = forests.backgrounds(rows, forest, forests.cut_points(rows, 3))
    return forests.attribution_summary(forests.attribution_to(others, rows, forest, _PREDICTORS), _PREDICTORS).select("predictor", "mean_abs")


def _variant(name: str, where: str) -> str:
    return f"SELECT '{name}' AS variant, count(*) AS n_rows, count(DISTINCT {R._BLOCK}) AS n_blocks, regr_r2(bgws, pr) AS r2_pr, regr_r2(bgws, price) AS r2_price, regr_r2(bgws, pr) - regr_r2(bgws, price) AS delta_r2 FROM change_frame WHERE bgws > 0{where}"


def _sensitivity(v, name: str, where: str) -> DataFrame:
    r2 = lambda c: F.regr_r2("bgws", c)
    out = _rows(v).where("bgws > 0").where(where).agg(F.count("*").alias("n_rows"), F.count_distinct("block").alias("n_blocks"), r2("pr").alias("r2_pr"), r2("price").alias("r2_price"), (r2("pr") - r2("price")).alias("delta_r2"))
    return out.select(F.lit(name).alias("variant"), "*")


query("j24_sensitivity", f"{_variant('full', '')} UNION ALL {_variant('masked', ' AND size > 25')}", "r2_pr r2_price delta_r2")(lambda v, s: _sensitivity(v, "full", "true").unionByName(_sensitivity(v, "masked", "size > 25")))
query("j25_landuse_drivers", f"SELECT a.predictor, n_models, mean, median, mean_rank, positive, top3, {R._STAR}, z FROM ({R._AGREE.format(where="WHERE model <> 'M8'")}) a JOIN (SELECT predictor, least(greatest(avg(coef) / nullif(stddev_pop(coef), 0), -1), 1) AS z FROM importance_long WHERE model <> 'M8' GROUP BY predictor) c ON a.predictor = c.predictor", "mean median mean_rank positive top3 z")(
    lambda v, s: _drivers(v("importance_long").where("model <> 'M8'"))
)


def _drivers(df: DataFrame) -> DataFrame:
    z = regress.context_z(df, ["coef"], ["predictor"]).withColumnRenamed("coef", "z")
    return regress.model_agreement(df).join(z, "predictor").select("predictor", "n_models", "mean", "median", "mean_rank", "positive", "top3", "star", "z")


@query("j24_linear_against_forest")
def _(v, spark):
    linear = _fit(_rows(v), _PREDICTORS, ["regime"], 10)
    parts = []
    for regime in ("negative", "positive"):
        rows = _in_repeats(lambda n: v(n).where("bgws > 0" if regime == "positive" else "bgws < 0"), 10)  # noqa: B023
        found = forests.fit_scores(rows, 3, [forests.Setting(8, 5, 2, 0.5)], 100)
        parts.append(found.select(F.lit(regime).alias("regime"), F.col("data").alias("repeat"), "test_r2"))
    return regress.linear_against_forest(linear, parts[0].unionByName(parts[1]), ["regime"])


query("j25_driver_job")(lambda v, s: regress.driver_job(_rows(v), "bgws", _PREDICTORS))
