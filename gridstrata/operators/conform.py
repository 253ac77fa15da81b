"""Cleaning, time axes, grids and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.functions.columns import convert


def drop_redundant(df: DataFrame, names: list[str]) -> DataFrame:
    """B1, B19. Columns that aren't there are left out; sdepth and solth become depth, which stays with mrsol or tsl."""
    df = df.withColumnsRenamed({c: "depth" for c in ("sdepth", "solth") if c in df.columns})
    return df.drop(*[n for n in names if n != "depth" or not {"mrsol", "tsl"} & set(df.columns)])


def by_rank(df: DataFrame, reference: DataFrame, keys: list[str], order: list[str], take: list[str], exact: bool = True) -> DataFrame:
    """B2, B3. Replace an axis by the reference's, by position. reference: rank (from 1 without gaps) and the columns `take`.

    A key whose number of positions isn't the reference's raises while the job runs; with exact=False a shorter one takes the reference's
    first positions, and only a longer one raises."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("rank", F.dense_rank().over(w.orderBy(*order)))
    size = reference.agg(F.max("rank").alias("_size"))  # one row
    ranked = ranked.withColumn("_n", F.max("rank").over(w)).crossJoin(F.broadcast(size))
    fits = (F.col("_n") == F.col("_size")) if exact else (F.col("_n") <= F.col("_size"))
    said = F.concat(F.lit(f"positions by {', '.join(keys)} and in the reference: "), F.col("_n").cast("string"), F.lit(" and "), F.coalesce(F.col("_size").cast("string"), F.lit("0")))
    # the check is part of the join's key, so it can't be pruned
    ranked = ranked.withColumn("rank", F.when(fits, F.col("rank")).otherwise(F.raise_error(said).cast("int"))).drop("_n", "_size")
    return ranked.drop(*[c for c in take if c in ranked.columns]).join(reference.select("rank", *take), "rank").drop("rank")


def by_axis(df: DataFrame, reference: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """B2. As by_rank for an axis that many rows share: only its distinct values are ranked. reference: rank, axis."""
    own = df.select(*keys, axis).distinct().withColumn("rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy(axis)))
    to = own.join(reference.select("rank", F.col(axis).alias("_to")), "rank").drop("rank")
    return df.join(to, [*keys, axis]).withColumn(axis, F.col("_to")).drop("_to")


def merge_tables(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """A1, B2. The outer merge of tables whose keys are unique, one shuffle for all of them; the first known value of a column that several have counts."""
    values = list(dict.fromkeys(c for t in tables for c in t.columns if c not in keys))
    union = None
    for i, t in enumerate(tables):
        part = t.select(*keys, *[F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("i"), F.col(c).alias("x"))).alias(c) for c in t.columns if c not in keys])
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return union.groupBy(*keys).agg(*[F.min(c).alias(c) for c in values]).select(*keys, *[F.col(f"{c}.x").alias(c) for c in values])


def slice_months(df: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """B4."""
    at = F.col("year") * 12 + F.col("month")
    return df.where(at.between(first[0] * 12 + first[1], last[0] * 12 + last[1]))


def pad_months(df: DataFrame, keys: list[str], first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """B6. NULL rows for the months before a cell's first and after its last; gaps between stay."""
    at = F.col("year") * 12 + F.col("month") - 1
    span = df.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    months = span.select(*keys, "_a", "_b", F.explode(F.sequence(F.lit(first[0] * 12 + first[1] - 1), F.lit(last[0] * 12 + last[1] - 1))).alias("_m")).where("_m < _a or _m > _b")
    return df.unionByName(months.select(*keys, F.floor(F.col("_m") / 12).cast("int").alias("year"), (F.col("_m") % 12 + 1).cast("int").alias("month")), allowMissingColumns=True)


def pad_days(df: DataFrame, keys: list[str], first: str, last: str, leap: bool = True) -> DataFrame:
    """B7. As pad_months, by day; leap=False leaves 29 February out."""
    span = df.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    days = span.select(*keys, "_a", "_b", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")).where("day < _a or day > _b")
    days = days if leap else days.where("not (month(day) = 2 and day(day) = 29)")
    return df.unionByName(days.drop("_a", "_b"), allowMissingColumns=True)


def conform_months(df: DataFrame, reference: DataFrame, keys: list[str], first: tuple[int, int], last: tuple[int, int], exact: bool = True) -> DataFrame:
    """B9. Slice, pad, and take over the reference's months by position. reference: rank, year, month; exact as in by_rank."""
    return by_rank(pad_months(slice_months(df, first, last), keys, first, last), reference, keys, ["year", "month"], ["year", "month"], exact)


def day_coverage(df: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """B9, for days, which are sliced only: first and last day of each key, and whether they cover the window."""
    there = df.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy(*keys).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    return there.withColumn("covered", (F.col("first") == F.lit(first).cast("date")) & (F.col("last") == F.lit(last).cast("date")))


def preprocess(df: DataFrame, drop: list[str], first: tuple[int, int], last: tuple[int, int], units: dict[str, tuple[str, str]], values: list[str], mask: DataFrame | None, grid: tuple[float, float] | None = None, calendar: DataFrame | None = None, regions: DataFrame | None = None, remove: list[str] | None = None) -> DataFrame:
    """B21. Redundant variables, grid (spacing, wanted spacing), months, units, landmask or names without it, and Antarctica: one lazy plan.

    calendar: rank, year, month of a reference; then months are sliced, padded and taken over by position, else only sliced. regions
    (cells and their region) and the names to remove: then these go with Antarctica, as Greenland and Iceland do."""
    out = drop_redundant(df, drop)
    if grid:
        out = regrid_conservative(out, values, ["experiment", "model", "year", "month"], *grid)
    keys = ["experiment", "model", "lat", "lon"]
    out = slice_months(out, first, last) if calendar is None else conform_months(out, calendar, keys, first, last)
    out = set_units(out, units)
    out = no_landmask_names(out, values) if mask is None else apply_landmask(out, mask, values)
    return remove_antarctica(out) if regions is None else remove_regions(out, regions, remove or [])


def drop_feb29(df: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """B8. Drop 29 February where that makes a cell's count the expected one."""
    leap = (F.month("day") == 2) & (F.day("day") == 29)
    w = Window.partitionBy(*keys)
    rest = F.count("*").over(w) - F.sum(leap.cast("int")).over(w)
    marked = df.withColumn("_drop", leap & (rest == expected))
    return marked.where("not _drop").drop("_drop")


def _overlap(df: DataFrame, target: DataFrame, name: str, size: Column) -> DataFrame:
    """src, dst, share: shares of each target interval that source intervals cover."""
    lo, hi = F.greatest("s_lo", "t_lo"), F.least("s_hi", "t_hi")
    pairs = df.join(F.broadcast(target), (F.col("s_lo") < F.col("t_hi")) & (F.col("t_lo") < F.col("s_hi")))  # axes: at most a few thousand rows
    return pairs.select("src", "dst", (size(hi) - size(lo)).alias(f"w_{name}"), (size(F.col("t_hi")) - size(F.col("t_lo"))).alias(f"a_{name}"))


def regrid_conservative(df: DataFrame, values: list[str], keys: list[str], step: float, target: float, normed: bool = False) -> DataFrame:
    """B10. First-order conservative remap of a regular grid with centres `step` apart onto one with spacing `target`.

    Weights are overlaps of latitude bounds (difference of sines) and longitude bounds modulo 360. Without `normed`, a
    target cell that its sources don't cover whole is NULL.
    """
    spark, sine = df.sparkSession, lambda x: F.sin(F.radians(x))
    bound = lambda c: F.greatest(F.lit(-90.0), F.least(F.lit(90.0), c))
    lats = df.select("lat").distinct().select(F.col("lat").alias("src"), bound(F.col("lat") - step / 2).alias("s_lo"), bound(F.col("lat") + step / 2).alias("s_hi"))
    lons = df.select("lon").distinct().select(F.col("lon").alias("src"), F.explode(F.array([F.lit(360.0 * k) for k in (-1, 0, 1)])).alias("k"))
    lons = lons.select("src", (F.col("src") + F.col("k") - step / 2).alias("s_lo"), (F.col("src") + F.col("k") + step / 2).alias("s_hi"))
    axis = lambda low, n: spark.range(n).select((F.lit(low) + (F.col("id") + 0.5) * target).alias("dst"), (F.lit(low) + F.col("id") * target).alias("t_lo"), (F.lit(low) + (F.col("id") + 1) * target).alias("t_hi"))
    wlat = _overlap(lats, axis(-90.0, int(180 / target)), "y", sine).withColumnsRenamed({"src": "lat", "dst": "to_lat"})
    wlon = _overlap(lons, axis(-180.0, int(360 / target)), "x", lambda x: x).withColumnsRenamed({"src": "lon", "dst": "to_lon"})
    both = df.join(F.broadcast(wlat), "lat").join(F.broadcast(wlon), "lon")
    w, full = F.col("w_y") * F.col("w_x"), F.first("a_y") * F.first("a_x")
    out = []
    for v in values:
        there = F.sum(F.when(F.col(v).isNotNull(), w))
        mean = F.sum(F.col(v) * w) / F.nullif(there, F.lit(0.0))
        out.append((mean if normed else F.when(there >= full * (1 - 1e-9), F.sum(F.col(v) * w) / full)).alias(v))
    return both.groupBy(*keys, "to_lat", "to_lon").agg(*out).withColumnsRenamed({"to_lat": "lat", "to_lon": "lon"})


def regrid_nearest(df: DataFrame, target: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """B11. The value of the nearest source latitude and longitude; target: lat, lon."""
    near = lambda axis, wrap: (
        target.select(F.col(axis).alias(f"to_{axis}")).distinct().crossJoin(F.broadcast(df.select(axis).distinct()))  # axes of a grid, not rows
        .groupBy(f"to_{axis}").agg(F.min_by(axis, F.struct(F.least(d := F.abs(F.col(axis) - F.col(f"to_{axis}")), F.abs(360 - d)) if wrap else F.abs(F.col(axis) - F.col(f"to_{axis}")), F.col(axis))).alias(axis))
    )
    out = df.join(F.broadcast(near("lat", False)), "lat").join(F.broadcast(near("lon", True)), "lon")
    return out.select(*keys, F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon"), *values)


def _bracket(df: DataFrame, target: DataFrame, axis: str, wrap: bool) -> DataFrame:
    """to_<axis>, <axis>, w_<axis>: the source coordinates around each target coordinate, with their weights."""
    to, places = F.col(f"to_{axis}"), F.array(*[F.col(axis) + k for k in ((-360.0, 0.0, 360.0) if wrap else (0.0,))])
    source = df.select(axis).distinct().select(axis, F.explode(places).alias("x"))
    pairs = target.select(F.col(axis).alias(f"to_{axis}")).distinct().crossJoin(F.broadcast(source))  # axes of a grid, not rows
    at = F.struct("x", axis)
    ends = pairs.groupBy(f"to_{axis}").agg(F.max(F.when(F.col("x") <= to, at)).alias("lo"), F.min(F.when(F.col("x") >= to, at)).alias("hi")).where("lo is not null and hi is not null")
    share = F.when(F.col("hi.x") > F.col("lo.x"), (to - F.col("lo.x")) / (F.col("hi.x") - F.col("lo.x"))).otherwise(0.0)
    sides = [F.struct(F.col(f"{end}.{axis}").alias(axis), w.alias(f"w_{axis}")) for end, w in (("lo", 1 - share), ("hi", share))]
    return ends.select(f"to_{axis}", F.inline(F.array(*sides))).where(F.col(f"w_{axis}") > 0)


def regrid_bilinear(df: DataFrame, target: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """B11. Linear in latitude and, modulo 360, in longitude; target: lat, lon. NULL where one of the neighbours with a weight is
    missing; latitudes beyond the source's go."""
    both = df.join(F.broadcast(_bracket(df, target, "lat", False)), "lat").join(F.broadcast(_bracket(df, target, "lon", True)), "lon")
    w = F.col("w_lat") * F.col("w_lon")
    mean = lambda v: F.when(F.sum(F.when(F.col(v).isNotNull(), w)) >= 1 - 1e-9, F.sum(F.col(v) * w))
    return both.groupBy(*keys, "to_lat", "to_lon").agg(*[mean(v).alias(v) for v in values]).withColumnsRenamed({"to_lat": "lat", "to_lon": "lon"})


def apply_landmask(df: DataFrame, mask: DataFrame, values: list[str]) -> DataFrame:
    """B12. mask: lat, lon, landseamask (1 or NULL)."""
    return df.join(mask, ["lat", "lon"]).withColumns({v: F.col(v) * F.col("landseamask") for v in values}).drop("landseamask")


def remove_antarctica(df: DataFrame) -> DataFrame:
    """B13."""
    return df.where("lat > -60")


def remove_regions(df: DataFrame, cell_region: DataFrame, regions: list[str]) -> DataFrame:
    """B14."""
    return remove_antarctica(df).join(cell_region.where(F.col("region").isin(regions)), ["lat", "lon"], "left_anti")


def region_of(cells: DataFrame, rings: DataFrame, band: float = 1.0) -> DataFrame:
    """B15. lat, lon, region: regions that hold a cell's centre, by ray casting. rings: region, ring array<struct<lon, lat>>.

    A region may have several rings, parts and holes alike: a centre is inside if the ray east of it crosses their edges an odd number
    of times. Edges are indexed by the bands of latitude that they pass, so that a cell meets the edges of its own band only; bands are
    joined by key, and crossings are counted before they are shuffled. Rings close themselves; edges along a parallel, and rings
    of fewer than three corners, hold nothing.
    """
    at = lambda lat: F.floor(lat / band)
    corners = rings.select("region", "ring", F.posexplode("ring").alias("_i", "_a"))
    edges = corners.select("region", "_a", F.get("ring", (F.col("_i") + 1) % F.size("ring")).alias("_b")).where("_a.lat <> _b.lat")
    low, high = F.least("_a.lat", "_b.lat"), F.greatest("_a.lat", "_b.lat")
    edges = edges.withColumn("_band", F.explode(F.sequence(at(low), at(high))))
    own = cells.select("lat", "lon").distinct().withColumn("_band", at(F.col("lat")))
    spans = (F.col("_a.lat") > F.col("lat")) != (F.col("_b.lat") > F.col("lat"))
    x = F.col("_a.lon") + (F.col("lat") - F.col("_a.lat")) * (F.col("_b.lon") - F.col("_a.lon")) / (F.col("_b.lat") - F.col("_a.lat"))
    hit = own.join(edges, "_band").where(spans & (F.col("lon") < x))
    return hit.groupBy("lat", "lon", "region").agg(F.count("*").alias("_n")).where("_n % 2 = 1").drop("_n")


def set_units(df: DataFrame, units: dict[str, tuple[str, str]]) -> DataFrame:
    """B16. units: column -> (unit, wanted unit)."""
    return df.withColumns({c: convert(F.col(c), a, b) for c, (a, b) in units.items() if c in df.columns})


def no_landmask_names(df: DataFrame, values: list[str]) -> DataFrame:
    """B18."""
    return df.withColumnsRenamed({v: f"{v}_no_landmask" for v in values})


def negatives_to_zero(df: DataFrame, values: list[str]) -> DataFrame:
    """B20."""
    return df.withColumns({v: F.when(F.col(v) < 0, 0.0).otherwise(F.col(v)) for v in values})
