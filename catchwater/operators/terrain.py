"""Slope, wetness, height above drainage, neighbourhood statistics and the recharge index."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from catchwater.checkpoints import cut
from catchwater.functions import columns as C
from catchwater.operators.grid import KEY
from catchwater.operators.quantiles import quantiles
from catchwater.operators.tiles import TILE, Pack, by_tiles, numbered, placed, small, towards, whole_groups
from catchwater.params import DEFAULT, Params


def gradient(cells: DataFrame, layer: str) -> DataFrame:
    """Central differences along rows (gy) and columns (gx), one-sided at edges."""
    def along(fixed: str, order: str) -> Column:
        w = Window.partitionBy("area_id", fixed).orderBy(order)
        v, before, after = F.col(layer), F.lag(layer).over(w), F.lead(layer).over(w)
        return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2.0)

    return cells.withColumns({"gy": along("c", "r"), "gx": along("r", "c")})


def wetness(cells: DataFrame, cell_m2: float = DEFAULT.cell_m2) -> DataFrame:
    """Topographic wetness index from accumulation and slope."""
    return gradient(cells, "dem").withColumn("twi", F.log((F.col("acc") * cell_m2 + 1) / (F.hypot("gy", "gx") + 1e-3)))


def hillshade(cells: DataFrame, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Analytical shade in [0, 1]."""
    g = gradient(cells, "dem")
    slope, aspect = np.pi / 2 - F.atan(F.hypot("gx", "gy")), F.atan2(-F.col("gx"), F.col("gy"))
    az, alt = np.radians(360.0 - azimuth + 90.0), np.radians(altitude)
    shade = float(np.sin(alt)) * F.sin(slope) + float(np.cos(alt)) * F.cos(slope) * F.cos(float(az) - aspect)
    return g.withColumn("shade", (shade + 1.0) / 2.0)


def _nearest(cols: np.ndarray, up: np.ndarray, tie: np.ndarray, wide: int) -> np.ndarray:
    """For 0 <= x < wide the i with the least (x - cols[i])^2 + up[i], of equals the one with the lowest tie, in linear time.

    The lower envelope of the parabolas, from left to right; scaled whole numbers leave no two of them equal at a column.
    """
    scale = len(cols)
    base = [scale * (c * c + u) + t for c, u, t in zip(cols.tolist(), up.tolist(), tie.tolist())]
    c, kept, since = cols.tolist(), [], []
    for i in range(len(c)):
        at = 0
        while kept:
            j = kept[-1]
            at = (base[i] - base[j]) // (2 * scale * (c[i] - c[j])) + 1  # the first column where i is lower
            if at > since[-1]:
                break
            kept.pop()
            since.pop()
            at = 0
        if at < wide:
            kept.append(i)
            since.append(max(at, 0))
    return np.repeat(kept, np.diff([*since, wide]))


def _nearest_in_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """Of whole grid rows, by column: the height of the nearest drain of each cell, given each column's nearest drain row."""
    r, c, dr, dz = (rows[x].to_numpy() for x in ("r", "c", "dr", "dz"))
    out, heads = np.full(len(rows), np.nan), np.flatnonzero(np.diff(numbered(rows, ["area_id", "r"]), prepend=-1))
    for i, j in zip(heads, [*heads[1:], len(rows)]):
        have = np.flatnonzero(~np.isnan(dr[i:j])) + i
        if len(have):
            tie = np.empty(len(have), np.int64)
            tie[np.lexsort((c[have], dr[have]))] = np.arange(len(have))
            low, drains = int(c[i]), dr[have].astype(np.int64)
            best = _nearest(c[have].astype(np.int64) - low, (drains - int(r[i])) ** 2, tie, int(c[j - 1]) - low + 1)
            out[i:j] = dz[have[best[c[i:j] - low]]]
    return rows.assign(zr=out)


def hand_lite(cells: DataFrame, drain: Column | None = None) -> DataFrame:
    """T4: height over the nearest (Euclidean) drain cell; 0 where an area has none.

    Nearest drain along each column by two window passes, then the lower envelope of the columns' parabolas within each row,
    many rows to a task, in time that grows with the cells. Ties: upper, then left.
    """
    is_drain = F.col("jrc") >= DEFAULT.permanent_water if drain is None else drain
    up = Window.partitionBy("area_id", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("area_id", "c").orderBy("r").rowsBetween(0, Window.unboundedFollowing)
    own = F.when(is_drain, F.struct("r", F.col("dem").alias("z")))
    near = cells.withColumn("own", own).select(*KEY, "dem", F.last("own", True).over(up).alias("a"), F.first("own", True).over(down).alias("b"))
    pick = F.when(F.col("b").isNull() | (F.col("r") - F.col("a.r") <= F.col("b.r") - F.col("r")), F.col("a")).otherwise(F.col("b"))
    near = near.withColumn("p", pick).select(*KEY, "dem", F.col("p.r").cast("double").alias("dr"), F.col("p.z").alias("dz"))
    found = whole_groups(near, ["area_id", "r"], _nearest_in_rows, "area_id long, r int, c int, dem double, zr double", "c")
    return found.select(*KEY, F.coalesce(F.col("dem") - F.nanvl("zr", F.lit(None).cast("double")), F.lit(0.0)).alias("hand"))


def box_mean(cells: DataFrame, value: Column, half: int = 3) -> DataFrame:
    """T5: mean over a square of (2 half + 1) cells a side; the border is mirrored with its edge cell repeated."""
    size = cells.groupBy("area_id").agg(F.max("r").alias("mr"), F.max("c").alias("mc"))
    own = cells.select(*KEY, value.cast("double").alias("v")).join(size, "area_id")

    def padded(df: DataFrame, axis: str, most: str) -> DataFrame:
        low = F.when(F.col(axis) < half, -1 - F.col(axis))
        high = F.when(F.col(axis) > F.col(most) - half, 2 * F.col(most) + 1 - F.col(axis))
        return df.withColumn(axis, F.explode(F.array_compact(F.array(F.col(axis), low, high))))

    def smooth(df: DataFrame, axis: str, fixed: str, most: str) -> DataFrame:
        w = Window.partitionBy("area_id", fixed).orderBy(axis).rangeBetween(-half, half)
        return padded(df, axis, most).withColumn("v", F.avg("v").over(w)).where((F.col(axis) >= 0) & (F.col(axis) <= F.col(most)))

    return smooth(smooth(own, "c", "r", "mc"), "r", "c", "mr").select(*KEY, F.col("v").alias("box_mean"))


def site_mean(cells: DataFrame, sites: DataFrame, layer: str, half: int = 3) -> DataFrame:
    """Mean of a layer over the window round each site, clipped to the grid, without NaN."""
    offsets = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    spots = sites.select("area_id", "sink_id", F.col("r").alias("r0"), F.col("c").alias("c0")).withColumn("dr", offsets).withColumn("dc", offsets)
    spots = spots.select("area_id", "sink_id", (F.col("r0") + F.col("dr")).alias("r"), (F.col("c0") + F.col("dc")).alias("c"))
    return cells.join(spots, KEY).groupBy("area_id", "sink_id").agg(F.avg(F.when(~F.isnan(layer), F.col(layer))).alias("site_mean"))


def _circle(radius_m: float, cell_m: float) -> list[tuple[int, int]]:
    n = int(radius_m // cell_m)
    return [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if a * a + b * b <= (radius_m / cell_m) ** 2]


def _focal(cells: DataFrame, layer: str, keys: list[str], name: str, circle: list[tuple[int, int]], statistic, tile: int) -> DataFrame:
    """A statistic of the values in the circle round each cell that has one: tiles with a rim, shifted against themselves."""
    types, reach, by = dict(cells.dtypes), max(abs(a) for a, _ in circle), [*keys, "tr", "tc"]
    if not reach:
        reach = 1

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        p = Pack(rows, tile, by, reach)
        v, own = p.flat(rows["v"].to_numpy(np.float64)), np.flatnonzero(rows["own"].to_numpy(bool))
        out, step = np.empty(len(own)), max(1, (1 << 22) // len(circle))
        for i in range(0, len(own), step):
            at = p.spot[own[i : i + step]]
            out[i : i + step] = statistic(np.stack([v[at + a * p.width[at] + b] for a, b in circle]))
        return rows.iloc[own].assign(**{name: out})

    mine = placed(cells.where(F.col(layer).isNotNull()).select(*keys, "r", "c", F.col(layer).cast("double").alias("v")), tile)
    both = mine.withColumn("own", F.lit(True)).unionByName(towards(mine, tile, reach).withColumn("own", F.lit(False)))
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"r {types['r']}, c {types['c']}, {name} double"])
    return by_tiles(both, solve, schema, by)


def _median(values: np.ndarray) -> np.ndarray:
    values.sort(axis=0)  # NaN last
    n = (~np.isnan(values)).sum(axis=0)
    pick = lambda k: np.take_along_axis(values, k[None], axis=0)[0]
    return (pick((n - 1) // 2) + pick(n // 2)) / 2


def focal_median(cells: DataFrame, layer: str, keys: list[str], radius_m: float = 50.0, cell_m: float = 30.0, tile: int = TILE) -> DataFrame:
    """Median over a circle, at cells that have a value themselves."""
    return _focal(cells, layer, keys, "focal_median", _circle(radius_m, cell_m), _median, tile)


def focal_mode(cells: DataFrame, layer: str, keys: list[str], radius_m: float = 60.0, cell_m: float = 30.0, tile: int = TILE) -> DataFrame:
    """Majority of 0 and 1 over a circle, at cells that have a value themselves; a tie gives 0."""
    found = _focal(cells, layer, keys, "focal_mode", _circle(radius_m, cell_m), lambda v: np.nansum(v, axis=0) > 0.5 * (~np.isnan(v)).sum(axis=0), tile)
    return found.withColumn("focal_mode", F.col("focal_mode").cast("int"))


def rescale(cells: DataFrame, *layers: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """clip((v - p2) / max(p98 - p2, 1e-9)) to [0, 1] per area as ``<layer>_n``, with exact percentiles of all layers at once."""
    cells = cut(cells)
    stats = quantiles(cells, ["area_id"], list(layers), [low, high]).select("area_id", *(F.col(x).alias(f"_{x}") for x in layers))
    rows = cells.join(small(cut(stats)), "area_id")
    for x in layers:
        p = F.col(f"_{x}")
        rows = rows.withColumn(f"{x}_n", F.least(F.greatest((F.col(x) - p[0]) / F.greatest(p[1] - p[0], F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))).drop(f"_{x}")
    return rows


#: Stations that travel to the tasks at once, about; pairs of a point and a station that a task holds at once.
STATIONS, PAIRS = 20_000, 1 << 21


def _puller(shared, power: float):
    @F.pandas_udf("w double, wv double")
    def pull(lat: pd.Series, lon: pd.Series) -> pd.DataFrame:
        a, o, v, n = shared.value
        out, step = np.zeros((2, len(lat))), max(1, PAIRS // max(len(a), 1))
        for i in range(0, len(lat), step):
            y, x = lat.to_numpy()[i : i + step, None], lon.to_numpy()[i : i + step, None]
            w = n / ((a - y) ** 2 + (o - x) ** 2 + 1e-12) ** (power / 2)
            out[:, i : i + step] = w.sum(axis=1), w @ v
        return pd.DataFrame({"w": out[0], "wv": out[1]})

    return pull


def interpolate(points: DataFrame, stations: DataFrame, value: str, power: float = 2.0) -> DataFrame:
    """Inverse-distance weighting in degrees; null without stations. Stations without a value or place don't count.

    Up to about STATIONS stations are broadcast at once; each pass over the points adds a block's weights and weighted
    values, so memory stays bounded whatever their number.
    """
    known = stations.select(F.col("lat").cast("double").alias("a"), F.col("lon").cast("double").alias("o"), F.col(value).cast("double").alias("v")).where("a is not null and o is not null and v is not null")
    known = cut(known.groupBy("a", "o", "v").agg(F.count("*").cast("double").alias("n")))
    blocks = -(-known.count() // STATIONS)
    sums = points.withColumn("_sum", F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wv")))
    for k in range(blocks):
        block = known.where(F.pmod(F.xxhash64("a", "o", "v"), F.lit(blocks)) == k).toPandas()  # about STATIONS rows
        pull = _puller(points.sparkSession.sparkContext.broadcast([block[x].to_numpy() for x in "aovn"]), power)
        pulled = sums.withColumn("_more", pull("lat", "lon"))
        sums = pulled.withColumn("_sum", F.struct((F.col("_sum.w") + F.col("_more.w")).alias("w"), (F.col("_sum.wv") + F.col("_more.wv")).alias("wv"))).drop("_more")
        sums = cut(sums) if blocks > 1 else sums
    return sums.withColumn(value, F.when(F.col("_sum.w") > 0, F.col("_sum.wv") / F.col("_sum.w"))).drop("_sum")


def recharge_index(cells: DataFrame, areas: DataFrame, stations: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Weighted sum of rescaled groundwater depth, conductivity, pervious share and accumulation; 0 on water."""
    from catchwater.operators.grid import to_lonlat

    pervious = box_mean(cells, (~F.col("worldcover").isin(50, 80)).cast("int")).withColumnRenamed("box_mean", "pervious")
    rows = interpolate(to_lonlat(cells, areas), stations, "depth_to_water_m")
    rows = rows.withColumns({"gw": F.col("depth_to_water_m"), "ksat": C.ksat_mm_hr(F.col("sand"), F.col("clay")), "flow": F.log1p("acc")})
    rows = rescale(rows, "gw", "ksat", "flow")
    a, b, c, d = params.rsi_weights
    index = a * F.col("gw_n") + b * F.col("ksat_n") + c * F.col("pervious") + d * F.col("flow_n")
    return rows.join(pervious, KEY).select(*KEY, F.when(F.col("worldcover") == 80, 0.0).otherwise(index).alias("rsi"))
