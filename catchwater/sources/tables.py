"""Tables, raster tiles, reports, GeoJSON and rain payloads in and out."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from catchwater.checkpoints import cut

SINKS = T.StructType([T.StructField(n, t) for n, t in (("sink_id", T.IntegerType()), *((x, T.DoubleType()) for x in ("lat", "lon")), ("row", T.IntegerType()), ("col", T.IntegerType()), *((x, T.DoubleType()) for x in ("area_m2", "max_depth_m", "volume_m3", "catchment_m2")))])
STATIONS = "station string, lat double, lon double, depth_to_water_m double"
RECHARGE = T.StructType([*SINKS.fields, *(T.StructField(x, T.DoubleType()) for x in ("rsi", "gw_depth_m", "ksat_mm_hr", "recharge_score"))])
ALERTS = "sink_id int, lat double, lon double, inflow_m3 bigint, capacity_m3 double, fill_ratio double, level string"
#: Rows of an area's file, about.
FILE_ROWS = 1_000_000
RAIN = "hourly struct<time: array<string>, precipitation: array<double>>"


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A CSV with header, or Parquet by its suffix."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(schema).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: str | None = "area_id") -> None:
    """A folder per area, with a file for each FILE_ROWS rows or so.

    Small areas share all tasks, however few rows they are, and each task moves its own files to their folders when it ends
    (the driver would move them one by one): so a failed job may leave some of them, without _SUCCESS.
    """
    if by:
        df = cut(df)
        most = df.groupBy(by).count().agg(F.max("count")).first()[0] or 0
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by, F.pmod(F.xxhash64(*df.columns), F.lit(most // FILE_ROWS + 1)))
    writer = df.write.mode("overwrite").option("header", True).option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    (writer.partitionBy(by) if by else writer).format(kind).save(path)


def tiles_to_cells(tiles: DataFrame) -> DataFrame:
    """S3: raster tiles (area_id, layer, row0, col0, ncols, values) to a row per cell."""
    rows = tiles.select("area_id", "layer", "row0", "col0", "ncols", F.posexplode("values").alias("k", "value"))
    return rows.select("area_id", "layer", (F.col("row0") + F.floor(F.col("k") / F.col("ncols"))).cast("int").alias("r"), (F.col("col0") + F.col("k") % F.col("ncols")).cast("int").alias("c"), "value")


def cells_to_tiles(cells: DataFrame, layer: str, size: int, kind: str = "double") -> DataFrame:
    """Cells of a layer to tiles of size x size at most, values in row order as ``kind``."""
    at = cells.select("area_id", F.floor(F.col("r") / size).cast("int").alias("tile_r"), F.floor(F.col("c") / size).cast("int").alias("tile_c"), "r", "c", F.col(layer).cast(kind).alias("v"))
    got = at.groupBy("area_id", "tile_r", "tile_c").agg(F.min("r").alias("row0"), F.min("c").alias("col0"), (F.max("r") - F.min("r") + 1).alias("nrows"), (F.max("c") - F.min("c") + 1).alias("ncols"), F.sort_array(F.collect_list(F.struct("r", "c", "v"))).alias("x"))
    return got.select("area_id", F.lit(layer).alias("layer"), "tile_r", "tile_c", "row0", "col0", "nrows", "ncols", F.transform("x", lambda e: e["v"]).alias("values"))


def to_geojson(points: DataFrame, key: str = "area_id") -> DataFrame:
    """One FeatureCollection per area; every column but lat, lon and the key is a property."""
    props = [c for c in points.columns if c not in ("lat", "lon", key)]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(*props).alias("properties"))
    listed = points.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*props, feature.alias("f")))).alias("x"))
    return listed.select(key, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("x", lambda e: e["f"]).alias("features"))).alias("geojson"))


def read_reports(spark: SparkSession, path: str, schema=None, whole_files: bool = False) -> DataFrame:
    """Nested JSON reports with the date in the file's or its folder's name, null if there is none.

    A report a line, as write_reports has it; ``whole_files``: one a file, over many lines.
    """
    reader = spark.read.option("multiLine", whole_files)
    rows = (reader.schema(schema) if schema else reader).json(path)
    date = F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})[^\d]*(?:/[^/]*)?$", 1)
    return rows.withColumn("report_date", F.when(date != "", date))


def write_reports(df: DataFrame, path: str) -> None:
    """One JSON object a line, in a folder whose name should hold the reports' date."""
    df.write.mode("overwrite").json(path)


def collate(reports: DataFrame, key: str = "area_id", name: str = "scores") -> DataFrame:
    """All dated reports of an area as one map from date to report; of several for one date the greatest counts."""
    fields = [c for c in reports.columns if c not in (key, "report_date")]
    one = reports.groupBy(key, "report_date").agg(F.max(F.struct(*fields)).alias("x"))
    return one.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("report_date", "x")))).alias(name))


def facts(key: str, **reports: DataFrame) -> DataFrame:
    """An area's reports side by side, each as one struct named after it; all areas of any report.

    A report has one row an area; collate() makes one of dated ones. More rows raise an error when the result is read.
    """
    out = None
    for name, df in reports.items():
        x = F.struct(*(c for c in df.columns if c != key))
        once = F.when(F.count("*") > 1, F.raise_error(F.lit(f"several {name} reports of one area"))).otherwise(F.max(x))
        one = df.groupBy(key).agg(once.alias(name))
        out = one if out is None else out.join(one, key, "full")
    return out


def parse_rain(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Hourly rain JSON to a row per hour; a null reading counts 0, an empty payload gives no rows."""
    hours = payloads.withColumn("h", F.from_json(column, RAIN)).select("point_id", F.posexplode(F.arrays_zip("h.hourly.time", "h.hourly.precipitation")).alias("k", "x"))
    return hours.select("point_id", "k", F.to_timestamp(F.col("x.time")).alias("ts"), F.coalesce("x.precipitation", F.lit(0.0)).alias("mm"))


def rain_payloads(rain: DataFrame) -> DataFrame:
    """Readings back to one JSON payload per point, nulls kept."""
    listed = rain.groupBy("point_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "mm"))).alias("x"))
    text = F.transform("x", lambda e: F.concat(F.lit('"'), F.date_format(e["ts"], "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"')))
    mm = F.transform("x", lambda e: F.coalesce(e["mm"].cast("string"), F.lit("null")))
    return listed.select("point_id", F.concat(F.lit('{"hourly":{"time":['), F.array_join(text, ","), F.lit('],"precipitation":['), F.array_join(mm, ","), F.lit("]}}")).alias("payload"))
