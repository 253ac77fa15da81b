"""Column expressions: missing values are NULL, and no expression divides without a guard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NULL for NaN and infinities: the ingest rule."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_ratio(numer: Column, denom: Column, eps: float = 1e-12) -> Column:
    return numer / F.when(denom > eps, denom)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def inside(x: Column, low: float, high: float) -> Column:
    """NULL outside the closed interval."""
    return F.when(x.between(low, high), x)


def weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").when(month.isin(9, 10, 11), "SON")


def weighted_mean(x: Column, w: Column) -> Column:
    """Aggregate: sum(x*w) over the weights of what is there."""
    return F.sum(x * w) / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0))


def share(condition: Column, w: Column) -> Column:
    """Aggregate: percent of the weight where the condition is known that fulfils it."""
    return 100 * F.sum(F.when(condition, w).otherwise(0.0)) / F.nullif(F.sum(F.when(condition.isNotNull(), w)), F.lit(0.0))


def month_length(year: Column, month: Column, calendar: str = "standard") -> Column:
    gregorian = F.day(F.last_day(F.make_date(year, month, F.lit(1))))
    fixed = {"noleap": 28, "365_day": 28, "all_leap": 29, "366_day": 29}
    return F.lit(30) if calendar == "360_day" else F.when(month == 2, fixed[calendar]).otherwise(gregorian) if calendar in fixed else gregorian


def vapour_pressure_deficit(tas_c: Column, huss: Column, ps_pa: Column) -> Column:
    """hPa, from deg C, kg/kg and Pa; never below 0."""
    saturation = 611.21 * F.exp((18.678 - tas_c / 234.5) * (tas_c / (257.14 + tas_c)))
    actual = huss * ps_pa / (0.622 + 0.378 * huss)
    gap = saturation - actual
    return F.when(gap < 0, 0.0).otherwise(gap) / 100


def water_use_efficiency(gpp: Column, tran: Column, low: float = 0.1, high: float = 10, eps: float = 1e-6) -> Column:
    return inside(gpp / F.when(tran + eps != 0, tran + eps), low, high)


def partition(runoff: Column, term: Column, pr: Column, limits: str = "clip") -> Column:
    """Percent of precipitation that runs off more than it leaves as `term`; limits: clip, null or none."""
    x = safe_ratio(runoff - term, pr) * 100
    return {"clip": lambda: clip(x, -100, 100), "null": lambda: inside(x, -100, 100), "none": lambda: x}[limits]()


#: Fixed values: (quantity, from, to) -> scale, offset.
UNITS = {
    ("*", "kg m-2 s-1", "mm/day"): (86400.0, 0.0), ("*", "kg m-2 s-1", "gC/m2/day"): (86_400_000.0, 0.0), ("*", "Pa", "hPa"): (0.01, 0.0), ("*", "hPa", "Pa"): (100.0, 0.0), ("*", "K", "C"): (1.0, -273.15),
    ("*", "kg m-2", "mm"): (1.0, 0.0), ("*", "kg m-2", "um"): (1.0, 0.0), ("*", "mm", "um"): (1000.0, 0.0), ("*", "kg", "ppm"): (1e6 / 44.01 / 2.13e20, 0.0),
}


def convert(x: Column, unit: str, to: str) -> Column:
    """A column in another unit; raises for a conversion that isn't known."""
    if unit == to:
        return x
    scale, offset = UNITS["*", unit, to]
    return x * scale + offset
