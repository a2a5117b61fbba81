"""Rain totals, forecasts and event dates."""

from pyspark.sql import DataFrame, Window, functions as F


def next_hours(rain: DataFrame, hours: int = 24) -> DataFrame:
    """The sum of each point's first readings; a null reading is 0."""
    first = rain.withColumn("k", F.row_number().over(Window.partitionBy("point_id").orderBy("ts", "event_id"))).where(F.col("k") <= hours)
    return first.groupBy("area_id", "point_id").agg(F.sum(F.coalesce("mm", F.lit(0.0))).alias("rain_mm"))


def area_max(totals: DataFrame) -> DataFrame:
    """R2: the largest total among an area's points (centre and corners)."""
    return totals.groupBy("area_id").agg(F.max("rain_mm").alias("rain_mm"))


def sample_points(areas: DataFrame) -> DataFrame:
    """R2 points: centre and corners of each area's box."""
    lon1, lat1 = F.col("lon0") + F.col("dlon") * F.col("ncols"), F.col("lat0") + F.col("dlat") * F.col("nrows")
    at = lambda name, lat, lon: F.struct(F.lit(name).alias("name"), lat.alias("lat"), lon.alias("lon"))
    lon0, lat0 = F.col("lon0"), F.col("lat0")
    five = F.array(at("centre", (lat0 + lat1) / 2, (lon0 + lon1) / 2), at("nw", lat0, lon0), at("ne", lat0, lon1), at("sw", lat1, lon0), at("se", lat1, lon1))
    return areas.select("area_id", F.explode(five).alias("p")).select("area_id", "p.name", "p.lat", "p.lon")


def antecedent(rain: DataFrame, days: int) -> DataFrame:
    """Each area's total over [day - days, day], for each day with readings."""
    daily = rain.groupBy("area_id", "day").agg(F.sum(F.coalesce("mm", F.lit(0.0))).alias("mm"))
    w = Window.partitionBy("area_id").orderBy(F.unix_date("day")).rangeBetween(-days, 0)
    return daily.select("area_id", "day", F.sum("mm").over(w).alias("rain_mm"))


def usable_dates(passes: DataFrame, rain: DataFrame, days: int, least_mm: float, most: int) -> DataFrame:
    """An area's first pass dates with enough antecedent rain."""
    wet = passes.select("area_id", "day").distinct().join(antecedent(rain, days).where(F.col("rain_mm") >= least_mm), ["area_id", "day"])
    return wet.withColumn("k", F.row_number().over(Window.partitionBy("area_id").orderBy("day"))).where(F.col("k") <= most)


def hold_out(dates: DataFrame, n_test: int) -> DataFrame:
    """Marks the last n_test dates of each area as test, but never all of them."""
    w = Window.partitionBy("area_id")
    n = F.count("*").over(w)
    k = F.row_number().over(w.orderBy("day"))
    return dates.withColumn("is_test", k > n - F.least(F.lit(n_test), n - 1))
