"""Alignment, projection and resampling of cell tables keyed by (area_id, r, c)."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from catchwater.checkpoints import cut
from catchwater.functions import columns as C
from catchwater import params as P
from catchwater.operators.tiles import sizes, small

KEY = ["area_id", "r", "c"]


def align_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells that both layers have."""
    return left.join(right, KEY)


def align_padded(cells: DataFrame, layer: str, rows: int, cols: int) -> DataFrame:
    """Exactly rows x cols cells an area; past the edge the last row or column repeats."""
    inside = cells.join(small(cut(sizes(cells))), "area_id").where((F.col("r") < rows) & (F.col("c") < cols))
    reach = lambda x, most, n: F.explode(F.when(F.col(x) < F.col(most), F.array(x)).otherwise(F.sequence(F.col(x), F.lit(n - 1))))  # noqa: E731  where a cell is seen
    return inside.select("area_id", reach("r", "mr", rows).alias("r"), "c", "mc", layer).select("area_id", "r", reach("c", "mc", cols).alias("c"), layer)


def to_lonlat(cells: DataFrame, areas: DataFrame, centre: bool = True) -> DataFrame:
    """Coordinates of pixel centres, or of their corners as plan outputs use them."""
    return cells.join(areas.select("area_id", "lon0", "dlon", "lat0", "dlat"), "area_id").withColumns({"lon": C.lon_at(F.col("c"), centre), "lat": C.lat_at(F.col("r"), centre)}).drop("lon0", "dlon", "lat0", "dlat")


def to_domain(points: DataFrame, areas: DataFrame, n: int, row0: int = 0, col0: int = 0) -> DataFrame:
    """The domain cell (dr, dc) of points with lat and lon; null outside the domain."""
    at = points.join(small(areas.select("area_id", "lon0", "dlon", "lat0", "dlat")), "area_id")
    r, c = C.domain_cell(F.col("lat"), F.col("lat0"), F.col("dlat"), F.lit(row0), n), C.domain_cell(F.col("lon"), F.col("lon0"), F.col("dlon"), F.lit(col0), n)
    inside = r.isNotNull() & c.isNotNull()
    return at.withColumns({"dr": F.when(inside, r), "dc": F.when(inside, c)}).drop("lon0", "dlon", "lat0", "dlat")


def crop(cells: DataFrame, areas: DataFrame, n: int, lat: Column, lon: Column) -> DataFrame:
    """P5: the window of 2n x 2n cells round a centre, kept inside the raster; r and c count from its corner."""
    first = lambda v, o, d, size: F.greatest(F.lit(0), F.least(((v - F.col(o)) / F.col(d)).cast("int") - n, F.col(size) - 2 * n))
    at = areas.select("area_id", first(lat, "lat0", "dlat", "nrows").alias("row0"), first(lon, "lon0", "dlon", "ncols").alias("col0"))
    rows = cells.join(at, "area_id").where((F.col("r") >= F.col("row0")) & (F.col("r") < F.col("row0") + 2 * n) & (F.col("c") >= F.col("col0")) & (F.col("c") < F.col("col0") + 2 * n))
    return rows.withColumns({"r": F.col("r") - F.col("row0"), "c": F.col("c") - F.col("col0")})


def pool(cells: DataFrame, aggs: dict[str, str]) -> DataFrame:
    """2 x 2 cells to one: 'avg', 'max', or 'nearest' (the upper left) by layer."""
    one = {"avg": F.avg, "max": F.max, "nearest": lambda x: F.max(F.when((F.col("r") % 2 == 0) & (F.col("c") % 2 == 0), F.col(x)))}
    return cells.groupBy("area_id", F.floor(F.col("r") / 2).cast("int").alias("r"), F.floor(F.col("c") / 2).cast("int").alias("c")).agg(*(one[how](name).alias(name) for name, how in aggs.items()))


def domain_table(cells: DataFrame) -> DataFrame:
    """Height, Manning's n, infiltration, built mask and class of each domain cell (P5 done before)."""
    pooled = pool(cells, {"dem": "avg", "worldcover": "nearest", "clay": "avg"})
    wc = F.col("worldcover")
    return pooled.select(*KEY, F.col("dem").alias("z"), C.lookup(wc, P.MANNING, 0.035).alias("mann"), C.infiltration(wc, F.col("clay")).alias("infil"), (wc == 50).cast("int").alias("built"), wc.alias("wc"))


def class_multipliers(domain: DataFrame, logs: DataFrame) -> DataFrame:
    """N and infiltration scaled by exp of a class's log multipliers (1 without one)."""
    scaled = domain.join(logs, "wc", "left")
    return scaled.select(*KEY, (F.col("mann") * F.exp(F.coalesce("log_n", F.lit(0.0)))).alias("mann"), (F.col("infil") * F.exp(F.coalesce("log_f", F.lit(0.0)))).alias("infil"))


def feature_channels(domain: DataFrame, rain_mm: float, dig_m: Column) -> DataFrame:
    """Standardised height after digging, rain and dig depth as model inputs, per area."""
    z = domain.withColumn("d", dig_m).withColumn("zd", F.col("z") - F.col("d"))
    stats = z.groupBy("area_id").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s"))
    return z.join(stats, "area_id").select(*KEY, ((F.col("zd") - F.col("m")) / F.col("s")).alias("z_n"), F.lit(rain_mm / 100.0).alias("rain_n"), (F.col("d") / 3.0).alias("dig_n"))


def neighbourhood(cells: DataFrame, *layers: str) -> DataFrame:
    """Adds ``near``: 3 x 3 structs of the layers round each cell of a full grid (null past the edge), row by row.

    Two window passes, along rows and then along columns, so nothing multiplies and no window spans more than a line.
    """
    own = F.struct(*layers)
    across, down = Window.partitionBy("area_id", "r").orderBy("c"), Window.partitionBy("area_id", "c").orderBy("r")
    line = cells.withColumn("line", F.array(F.lag(own).over(across), own, F.lead(own).over(across)))
    up, below = F.lag("line").over(down), F.lead("line").over(down)
    return line.withColumn("near", F.array(up, F.col("line"), below)).drop("line")


def near(dr: int, dc: int, layer: str) -> Column:
    return F.get(F.get("near", F.lit(dr + 1)), F.lit(dc + 1))[layer]
