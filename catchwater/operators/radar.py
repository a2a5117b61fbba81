"""Radar passes to water masks, wet frequency and verification of predictions."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from catchwater.operators.grid import KEY, pool
from catchwater.operators.quantiles import quantiles
from catchwater.operators.terrain import focal_mode
from catchwater.params import DEFAULT


def select_passes(passes: DataFrame, start, end) -> DataFrame:
    """V1: IW passes with VV within [start, end)."""
    return passes.where((F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(end)) & (F.col("mode") == "IW") & F.array_contains("polarisations", "VV"))


def dry_reference(cells: DataFrame) -> DataFrame:
    """V2: per cell the median of February and March."""
    return cells.where(F.col("mon").isin(2, 3)).groupBy(*KEY).agg(F.median("vv").alias("dry"))


def mosaic(cells: DataFrame, events: DataFrame) -> DataFrame:
    """V3: for each event day the latest valid value of each cell within [day - 1, day + 2)."""
    near = cells.where("vv is not null").withColumn("event", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.date_add("day", k))))
    return near.join(events, ["area_id", "event"]).groupBy(*KEY, "event").agg(F.max_by("vv", F.struct("day", "seq")).alias("vv"))


def wet_cells(vv: Column, dry: Column, jrc: Column) -> Column:
    """V4 rule: dark, or much darker than in the dry season, off permanent water; missing values are dry."""
    wet = F.coalesce(vv < -16, F.lit(False)) | F.coalesce(vv - dry < -4, F.lit(False))
    return (wet & (jrc < DEFAULT.permanent_water)).cast("int")


def water_mask(image: DataFrame, dry: DataFrame, cells: DataFrame, smooth: bool = True) -> DataFrame:
    """V4: 0 or 1 of each cell and event, with the majority filter."""
    rows = image.join(dry, KEY, "left").join(cells.select(*KEY, "jrc"), KEY)
    mask = rows.select(*KEY, "event", wet_cells(F.col("vv"), F.col("dry"), F.col("jrc")).alias("wet"))
    return focal_mode(mask, "wet", ["area_id", "event"]).withColumnRenamed("focal_mode", "wet") if smooth else mask


def wet_frequency(cells: DataFrame, dry: DataFrame, layers: DataFrame) -> DataFrame:
    """V5: wet monsoon passes over all monsoon passes of the area; null on permanent water."""
    monsoon = cells.where((F.month("day") * 100 + F.dayofmonth("day") >= 601) & (F.month("day") * 100 + F.dayofmonth("day") < 1015))
    passes = monsoon.select("area_id", "day").distinct().groupBy("area_id").agg(F.count("*").alias("n"))
    image = monsoon.groupBy(*KEY, "day").agg(F.max_by("vv", "seq").alias("vv"))
    wet = image.join(dry, KEY, "left").withColumn("wet", wet_cells(F.col("vv"), F.col("dry"), F.lit(0))).groupBy(*KEY).agg(F.sum("wet").alias("wet"))
    rows = layers.select(*KEY, "jrc").join(passes, "area_id").join(wet, KEY, "left")
    return rows.select(*KEY, F.when(F.col("jrc") < DEFAULT.permanent_water, F.coalesce("wet", F.lit(0)) / F.col("n")).alias("frequency"))


def scores(rows: DataFrame, predicted: Column, keys: list[str]) -> DataFrame:
    """V6: hits, misses, false alarms, POD, FAR and CSI of 0/1 ``wet`` against a predicted condition."""
    of = lambda cond, name: F.count_if(cond).alias(name)
    p, w = predicted, F.col("wet") == 1
    got = rows.groupBy(*keys).agg(of(p & w, "hits"), of(~p & w, "misses"), of(p & ~w, "false_alarms"))
    h, m, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    one = F.lit(1)
    return got.withColumns({"pod": h / F.greatest(h + m, one), "far": f / F.greatest(h + f, one), "csi": h / F.greatest(h + m + f, one)})


def domain_truth(mask: DataFrame, layers: DataFrame) -> DataFrame:
    """V7: truth (wet if any of four cells is) and validity (mean occurrence below 50) on double cells."""
    truth = mask.groupBy("area_id", "event", F.floor(F.col("r") / 2).cast("int").alias("r"), F.floor(F.col("c") / 2).cast("int").alias("c")).agg((F.max("wet") > 0.5).cast("int").alias("wet"))
    valid = pool(layers.select(*KEY, "jrc"), {"jrc": "avg"}).select(*KEY, (F.col("jrc") < DEFAULT.permanent_water).cast("int").alias("valid"))
    return truth.join(valid, KEY)


def mean_csi(scored: DataFrame, keys: list[str]) -> DataFrame:
    """V8: mean over events, to 4 places."""
    return scored.groupBy(*keys).agg(F.bround(F.avg("csi"), 4).alias("mean_csi"))


def sweep(rows: DataFrame, value: str, thresholds: DataFrame, above: bool = True, keys: list[str] | None = None) -> DataFrame:
    """V9: the mean CSI of every threshold over events; each cell is bucketed once, cumulative counts do the rest.

    rows: event_id, wet, value, keys; thresholds: one column t. Predicted wet: value > t (or < t).
    """
    keys = keys or []
    known = thresholds.agg(F.sort_array(F.collect_set("t")).alias("ts"))
    # the number of thresholds that call a cell wet: those below its value (or above it)
    n = F.size(F.filter("ts", lambda t: (F.col(value) > t) if above else (F.col(value) < t)))
    counted = rows.join(F.broadcast(known)).withColumn("n", n).groupBy(*keys, "event_id", "n").agg(F.count_if(F.col("wet") == 1).alias("w"), F.count("*").alias("all"))
    total = rows.groupBy(*keys, "event_id").agg(F.count_if(F.col("wet") == 1).alias("total"))
    ladder = total.join(F.broadcast(known)).select(*keys, "event_id", "total", F.size("ts").alias("m"), F.posexplode("ts").alias("k", "t"))
    need = F.col("k") + 1 if above else F.col("m") - F.col("k")
    steps = ladder.withColumn("n", need).join(counted, [*keys, "event_id", "n"], "left").withColumns({"w": F.coalesce("w", F.lit(0)), "all": F.coalesce("all", F.lit(0))})
    w = Window.partitionBy(*keys, "event_id").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    hit, called = F.sum("w").over(w), F.sum("all").over(w)
    csi = hit / F.greatest(F.col("total") + called - hit, F.lit(1))
    return steps.select(*keys, "event_id", "t", csi.alias("csi")).groupBy(*keys, "t").agg(F.avg("csi").alias("mean_csi"))


def best_threshold(swept: DataFrame, keys: list[str]) -> DataFrame:
    """V9 result: the threshold with the best mean CSI, the first on ties."""
    at = F.max_by(F.struct("t", "mean_csi"), F.struct("mean_csi", -F.col("t")))
    return swept.groupBy(*keys).agg(at.alias("b")).select(*keys, F.col("b.t").alias("threshold"), F.bround("b.mean_csi", 4).alias("mean_csi"))


def quantile_grid(rows: DataFrame, value: str, n: int = 25, low: float = 0.5, high: float = 0.99) -> DataFrame:
    """Candidate thresholds at n evenly spaced quantiles, exact however many rows there are."""
    at = [low + (high - low) * k / (n - 1) for k in range(n)]
    return quantiles(rows, [], [value], at).select(F.posexplode(value).alias("k", "t"))


def linear_grid(spark, low: float, high: float, n: int) -> DataFrame:
    """N evenly spaced thresholds."""
    return spark.range(n).select(F.col("id").cast("int").alias("k"), (low + (high - low) * F.col("id") / (n - 1)).alias("t"))


def compare_methods(swept: list[tuple[str, int | None, DataFrame]]) -> DataFrame:
    """Of each (method, rain window or None, sweep) the best threshold; of a method its best window; one ranked table."""
    rows = None
    for name, window, df in swept:
        one = best_threshold(df, []).select(F.lit(name).alias("method"), F.lit(window).cast("int").alias("window_days"), "threshold", "mean_csi")
        rows = one if rows is None else rows.unionByName(one)
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("method").orderBy(F.desc("mean_csi"), "window_days"))).where("k = 1").drop("k")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_csi"), "method")))  # a row a method


def soft_dice(rows: DataFrame, value: Column, tau: float, beta: float, keys: list[str]) -> DataFrame:
    """1 - (2 sum pt + 1) / (sum p + sum t + 1) with p = sigmoid((value - tau) / beta)."""
    p = 1.0 / (1.0 + F.exp(-(value - tau) / beta))
    return rows.groupBy(*keys).agg((1.0 - (2.0 * F.sum(p * F.col("wet")) + 1.0) / (F.sum(p) + F.sum("wet") + 1.0)).alias("loss"))


def ensemble_cells(runs: DataFrame, tau: float = DEFAULT.min_depth_m) -> DataFrame:
    """V13 per cell: share of members that flood it, and the spread of depths."""
    return runs.groupBy(*KEY).agg(F.avg((F.col("h") > tau).cast("int")).alias("p"), F.coalesce(F.stddev_samp("h"), F.lit(0.0)).alias("spread"))


def ensemble_summary(runs: DataFrame, tau: float = DEFAULT.min_depth_m, cell_m2: float = 3600.0) -> DataFrame:
    """V13 per area: mean and population spread of members' flooded km2, and km2 of likely and sure cells."""
    members = runs.groupBy("area_id", "scenario_id").agg((F.count_if(F.col("h") > tau) * cell_m2 / 1e6).alias("km2"))
    likely = ensemble_cells(runs, tau).groupBy("area_id").agg((F.count_if(F.col("p") >= 0.5) * cell_m2 / 1e6).alias("km2_p50"), (F.count_if(F.col("p") >= 0.9) * cell_m2 / 1e6).alias("km2_p90"))
    return members.groupBy("area_id").agg(F.avg("km2").alias("mean_km2"), F.stddev_pop("km2").alias("std_km2")).join(likely, "area_id")


def surrogate_error(rows: DataFrame, predicted: Column, target: Column, keys: list[str]) -> DataFrame:
    """RMSE, RMSE where the target floods (0 if nowhere), and the error that counts wet cells 21 times."""
    e2 = (predicted - target) * (predicted - target)
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(e2)).alias("rmse"), F.coalesce(F.sqrt(F.avg(F.when(target > DEFAULT.min_depth_m, e2))), F.lit(0.0)).alias("rmse_wet"), F.avg(e2 * (1.0 + 20.0 * (target > 0.05).cast("int"))).alias("weighted_mse"))


def disagreements(rows: DataFrame, predicted: Column) -> DataFrame:
    """Cells where observation and prediction differ."""
    return rows.withColumn("predicted", predicted.cast("int")).where(F.col("predicted") != F.col("wet"))
