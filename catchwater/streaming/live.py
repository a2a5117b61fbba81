"""Live rain to alerts."""

from pyspark.sql import DataFrame, functions as F

from catchwater.params import DEFAULT, Params


def live_alerts(readings: DataFrame, counts: DataFrame, sinks: DataFrame, late: str = "1 hour", params: Params = DEFAULT) -> DataFrame:
    """Readings (point_id, area_id, ts, mm) of a stream -> levels per sink for each closed day.

    A 24-hour sum per point, then the largest of an area's points, both in windows under one watermark; readings later
    than it are dropped. The (sink, curve number) histogram and the sinks are static. Append mode emits a day once it
    can change no more. A batch gives the same rows for all days.
    """
    rain = readings.select("point_id", "area_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("mm", F.lit(0.0)).alias("mm"))
    if rain.isStreaming:
        rain = rain.withWatermark("ts", late)
    points = rain.groupBy(F.window("ts", "24 hours").alias("w"), "area_id", "point_id").agg(F.sum("mm").alias("mm"))
    areas = points.groupBy(F.window(F.col("w"), "24 hours").alias("day"), "area_id").agg(F.max("mm").alias("rain_mm"))
    levels = fill_levels_of(counts, sinks, params)
    return areas.join(levels, "area_id").withColumns(level_columns(params)).select("area_id", F.col("day.start").alias("day"), "sink_id", "rain_mm", "fill_ratio", "level")


def fill_levels_of(counts: DataFrame, sinks: DataFrame, params: Params) -> DataFrame:
    """Per sink its capacity and its histogram as one array, so a stream needs no further aggregation after rain."""
    listed = counts.groupBy("area_id", "sink_id").agg(F.sort_array(F.collect_list(F.struct("cn", "n"))).alias("cells"))  # at most one entry a curve number
    return listed.join(sinks.select("area_id", "sink_id", "volume_m3"), ["area_id", "sink_id"])


def level_columns(params: Params) -> dict:
    from catchwater.functions import columns as C

    inflow = F.aggregate("cells", F.lit(0.0), lambda t, x: t + C.runoff_mm(F.col("rain_mm"), x["cn"]) * x["n"] / 1000.0 * params.cell_m2)
    ratio = C.safe_ratio(inflow, F.col("volume_m3"))
    return {"fill_ratio": F.bround(ratio, 2), "level": C.level(ratio, params)}
