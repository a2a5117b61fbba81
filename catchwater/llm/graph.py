"""Connected components of a links table, as rounds of joins."""

from pyspark.sql import DataFrame, functions as F

from catchwater.llm.session import cut, few

#: Rows of a table that are broadcast, at most, and those of a partition.
SMALL, EACH = 100_000, 100_000


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (id, component_id): for each linked id the smallest id that it reaches.

    Each round, every id takes the smallest label among its own and its neighbours', then the label of that label, so
    chains shorten by half and more a round. Sums and minima are combined before each shuffle; no group is gathered.
    Duplicate links, self links and either direction are allowed; no links give an empty table.
    """
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    n = edges.count()
    edges, near_by = few(edges, n, EACH), F.broadcast if n <= SMALL else lambda x: x  # no more labels than edges
    labels = cut(few(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("c")), n, EACH))
    while True:
        near = edges.join(near_by(labels.select(F.col("id").alias("b"), "c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        low = near.join(near_by(labels), "id").select("id", F.col("c").alias("before"), F.least("c", "m").alias("c"))
        up = labels.select(F.col("id").alias("c"), F.col("c").alias("up"))
        after = cut(few(low.join(near_by(up), "c").select("id", "before", F.least("c", "up").alias("c")), n, EACH))
        moved = after.where("c <> before").limit(1).count()
        labels = after.select("id", "c")
        if not moved:
            return labels.withColumnRenamed("c", "component_id")
