"""Scalar column functions: soil, runoff, affine maps, scores."""

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from catchwater import params as P


def lookup(key: Column, table: Mapping, default: float) -> Column:
    """The table's value for a class, or the default."""
    found = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(found, key.cast("int")), F.lit(default))


def soil_group(clay: Column) -> Column:
    """Hydrologic group A..D as 0..3 from clay in g/kg; without clay data group C."""
    pct = clay / 10.0
    return F.when(clay.isNull(), 2).when(pct < 10, 0).when(pct > 40, 3).when(pct > 25, 2).otherwise(1)


def curve_number(cover: Column, group: Column) -> Column:
    values = F.create_map(*(x for k, v in P.CURVE_NUMBERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.get(F.element_at(values, cover.cast("int")), group), F.lit(80))


def runoff_mm(rain: Column, cn: Column) -> Column:
    """SCS-CN runoff depth."""
    s = 25400.0 / cn - 254.0
    over = rain - 0.2 * s
    return F.when(over > 0, over * over / (rain + 0.8 * s)).otherwise(0.0)


def infiltration(cover: Column, clay: Column) -> Column:
    """Metres a second, less in clay."""
    factor = F.when(clay.isNull(), 1.0).otherwise(F.least(F.greatest(1.2 - 0.02 * (clay / 10.0), F.lit(0.3)), F.lit(1.5)))
    return lookup(cover, P.INFILTRATION, 5.0) * factor / 1000.0 / 3600.0


def ksat_mm_hr(sand: Column, clay: Column) -> Column:
    """Saturated conductivity after Cosby."""
    return F.pow(F.lit(10.0), -0.6 + 0.0126 * (sand / 10.0) - 0.0064 * (clay / 10.0)) * 25.4


def level(ratio: Column, params: P.Params = P.DEFAULT) -> Column:
    return F.when(ratio >= params.red, "RED").when(ratio >= params.amber, "AMBER").otherwise("GREEN")


def severity(name: Column) -> Column:
    return F.when(name == "RED", 2).when(name == "AMBER", 1).otherwise(0)


def lon_at(c: Column, centre: bool) -> Column:
    return F.col("lon0") + F.col("dlon") * (c + (0.5 if centre else 0.0))


def lat_at(r: Column, centre: bool) -> Column:
    return F.col("lat0") + F.col("dlat") * (r + (0.5 if centre else 0.0))


def domain_cell(value: Column, origin: Column, step: Column, first: Column, n: int) -> Column:
    """Row or column in an n-wide domain of double cells whose first raster cell is ``first``; null outside."""
    at = F.floor((F.floor((value - origin) / step) - first) / 2)
    return F.when((at >= 0) & (at < n), at).cast("int")


def urban_multiplier(building: Column, road: Column) -> Column:
    return F.when(building, 30.0).when(road, 0.5).otherwise(1.0)


def safe_ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))
