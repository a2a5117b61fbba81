"""Exact quantiles of groups of any size."""

from pyspark.sql import DataFrame, Window, functions as F

from catchwater.checkpoints import cut
from catchwater.operators.tiles import small

#: Rows of a group up to which one aggregate takes its quantiles.
FEW = 200_000
#: Ranges that a range of values is cut into in one round.
RANGES = 256


def quantiles(df: DataFrame, keys: list[str], layers: list[str], shares: list[float]) -> DataFrame:
    """keys and, per layer, the array of its quantiles at the shares, interpolated linearly; nulls and NaN don't count.

    Groups of over FEW rows are searched for the values at the wanted ranks: counts of RANGES value ranges tell which range
    holds a rank, that range is cut again, and so on until it holds one value only. All layers and ranks go in the same
    rounds; a round combines counts before its shuffle, and no task holds the values of a group. Rounds grow with the
    logarithm of the values' range over the gaps at the ranks: three or four for plain data, dozens where values span many
    powers of ten.
    """
    rows = df.select(*keys, *(F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")).alias(x) for x in layers))
    plain = lambda d: d.groupBy(*keys).agg(*(F.percentile(x, F.array(*map(F.lit, shares))).alias(x) for x in layers))
    large = cut(rows.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > FEW).drop("rows"))
    n_large = large.count()
    if not n_large:
        return plain(rows)
    if not keys:
        return _searched(rows, keys, layers, shares)
    large = small(large)
    return plain(rows.join(large, keys, "left_anti")).unionByName(_searched(rows.join(large, keys, "left_semi"), keys, layers, shares))


def _searched(rows: DataFrame, keys: list[str], layers: list[str], shares: list[float]) -> DataFrame:
    key = [*keys, "layer"]
    long = cut(rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("layer"), F.col(x).alias("v")) for i, x in enumerate(layers)))).alias("x")).select(*keys, "x.*").where("v is not null"))
    place = lambda s: F.lit(float(s)) * (F.col("n") - 1)
    marks = F.explode(F.array(*(F.struct(F.lit(i).alias("share"), F.lit(e).alias("end"), (F.ceil(place(s)) if e else F.floor(place(s))).cast("long").alias("k")) for i, s in enumerate(shares) for e in (0, 1))))
    spans = long.groupBy(*key).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    open_ = cut(spans.select(*key, "n", "low", "high", marks.alias("m")).select(*key, "n", "low", "high", "m.*"))
    found = None
    while True:
        done = open_.where("low = high").select(*key, "n", "share", "end", F.col("low").alias("value"))
        found = done if found is None else found.unionByName(done)
        open_ = open_.where("low < high")
        ranges = open_.select(*key, "low", "high").distinct()
        if not open_.limit(1).count():
            break
        high, low, wide = F.col("high"), F.col("low"), F.col("high") - F.col("low")
        at = F.when(wide < float("inf"), (F.col("v") - low) / wide).otherwise((F.col("v") / 2 - low / 2) / (high / 2 - low / 2))
        held = long.join(F.broadcast(ranges) if not keys else small(ranges), key).where("v between low and high").withColumn("b", F.least(F.floor(at * RANGES), F.lit(RANGES - 1)))
        counts = held.groupBy(*key, "low", "high", "b").agg(F.count("*").alias("here"), F.min("v").alias("low2"), F.max("v").alias("high2"))
        run = Window.partitionBy(*key, "low", "high").orderBy("b")
        counts = counts.withColumn("before", F.sum("here").over(run) - F.col("here"))
        next_ = open_.join(counts, [*key, "low", "high"]).where("k >= before and k < before + here")
        open_ = cut(next_.select(*key, "n", F.col("low2").alias("low"), F.col("high2").alias("high"), "share", "end", (F.col("k") - F.col("before")).alias("k")))
    share = F.element_at(F.array(*map(F.lit, map(float, shares))), F.col("share") + 1)
    ends = found.groupBy(*key, "share").agg(F.first("n").alias("n"), F.max(F.when(F.col("end") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("value"))).alias("b"))
    at = share * (F.col("n") - 1)
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil(at) - at) * F.col("a") + (at - F.floor(at)) * F.col("b"))
    lists = ends.withColumn("q", value).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("share", "q"))), lambda x: x["q"]).alias("q"))
    return lists.groupBy(*keys).agg(*(F.max(F.when(F.col("layer") == i, F.col("q"))).alias(x) for i, x in enumerate(layers)))
