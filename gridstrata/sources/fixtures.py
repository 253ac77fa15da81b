"""Views with the shapes of climate panels over the test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CELL = "CAST(-50.5 + 20 * (l_partkey % 6) AS DOUBLE) AS lat, CAST(-135.5 + 90 * (floor(l_partkey / 6) % 4) AS DOUBLE) AS lon"

SQL = {
    "panel_month": f"""SELECT CASE WHEN year(l_shipdate) <= 1997 THEN 'historical' ELSE 'ssp370' END AS experiment, concat('M', CAST(l_suppkey % 3 AS VARCHAR(9))) AS model, {_CELL},
        CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, avg(l_quantity) / 10 AS pr, avg(l_extendedprice) / 40000 AS tran, avg(l_discount) * 24 AS mrro,
        avg(l_extendedprice) / 40000 + avg(l_tax) * 5 AS evspsbl, avg(l_tax) * 50 AS lai, avg(l_discount) * 100 + 10 AS mrsos, 270 + avg(l_quantity) AS tas, avg(l_tax) * 0.1 AS huss,
        CAST(100000.0 AS DOUBLE) AS ps, avg(l_quantity) / 5 AS gpp FROM lineitem GROUP BY ALL""",
    "panel_day": "SELECT l_partkey % 4 AS cell, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) / 5 AS pr FROM lineitem GROUP BY ALL",
    "change_frame": """SELECT p_partkey AS cell, CAST((p_partkey * 37) % 140 - 55 AS DOUBLE) AS lat, CAST((p_partkey * 91) % 360 - 180 AS DOUBLE) AS lon,
        avg(l_extendedprice) / 1000 - avg(l_discount) * 200 AS bgws, avg(l_quantity) AS pr, avg(l_discount) AS disc, avg(l_tax) AS tax, CAST(max(p_size) AS DOUBLE) AS size, max(p_retailprice) AS price
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey""",
    "landuse_year": f"""SELECT CASE WHEN year(l_shipdate) <= 1997 THEN 'historical' ELSE 'ssp370' END AS experiment, {_CELL}, CAST(year(l_shipdate) AS INT) AS year, avg(l_discount) AS primf, avg(l_tax) AS primn,
        avg(l_discount) / 2 AS secdf, avg(l_tax) / 2 AS secdn, avg(l_quantity) / 1000 AS c3ann, avg(l_quantity) / 2000 AS c4ann, avg(l_discount) / 10 AS c3per, avg(l_discount) / 20 AS c4per, avg(l_tax) / 10 AS c3nfx,
        avg(l_quantity) / 500 AS pastr, avg(l_tax) / 4 AS range FROM lineitem GROUP BY ALL""",
    "catalog": """SELECT concat('S', CAST(s_suppkey % 7 AS VARCHAR(9))) AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN 'historical' ELSE 'ssp370' END AS experiment_id, concat('r', CAST(s_suppkey % 2 AS VARCHAR(9))) AS member_id,
        'Amon' AS table_id, CASE WHEN s_nationkey % 2 = 0 THEN 'pr' ELSE 'tas' END AS variable_id, CASE WHEN s_suppkey % 5 = 0 THEN 'gn' ELSE 'gr' END AS grid, concat('v2019', CAST(1000 + s_nationkey AS VARCHAR(9))) AS version,
        concat('f_', CAST(1850 + s_nationkey AS VARCHAR(9)), '01-', CAST(1880 + s_nationkey AS VARCHAR(9)), '12.nc') AS file FROM supplier""",
    "importance_long": """SELECT concat('M', CAST(l_suppkey % 9 AS VARCHAR(9))) AS model, concat('P', CAST(l_linenumber AS VARCHAR(9))) AS predictor, avg(l_discount) - 0.04 - 0.001 * (l_suppkey % 9) AS importance, avg(l_tax) - 0.04 AS coef FROM lineitem GROUP BY l_suppkey % 9, l_linenumber""",
    "cv_results": """SELECT CAST(l_linenumber AS DOUBLE) AS alpha, CAST(l_suppkey % 7 AS DOUBLE) / 7 AS l1_ratio, avg(l_discount) AS mean_score, stddev_pop(l_discount) AS sd_score FROM lineitem GROUP BY ALL""",
}

_TABLES = {"panel_month": ["lineitem"], "panel_day": ["lineitem"], "change_frame": ["lineitem", "part"], "landuse_year": ["lineitem"], "catalog": ["supplier"], "importance_long": ["lineitem"], "cv_results": ["lineitem"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame."""
    text = SQL[name]
    for t in _TABLES[name]:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]})


def with_views(sql: str) -> str:
    """SQL with the fixture views it names put before it."""
    used = [n for n in SQL if n in sql]
    return ("WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in used) + " " if used else "") + sql
