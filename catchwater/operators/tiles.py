"""Cells dealt to tasks by tiles: whole tiles, as many at once as fit, each with a rim for its neighbours' cells."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

TILE = 256
#: Cells that a task holds at once, about; a tile more at most.
CELLS = 1 << 18
#: Rows of a side that is broadcast, at most; a larger one is joined by a shuffle.
SMALL = 500_000

EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]
TILE_KEY = ["area_id", "tr", "tc"]


def small(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if its counted rows are few."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def sizes(cells: DataFrame) -> DataFrame:
    """Last row and column of each area."""
    return cells.groupBy("area_id").agg(F.max("r").alias("mr"), F.max("c").alias("mc"))


def at_edge() -> Column:
    """The cell lies on the border of its area's grid."""
    return (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == F.col("mr")) | (F.col("c") == F.col("mc"))


def placed(cells: DataFrame, tile: int) -> DataFrame:
    """Adds the tile of each cell."""
    return cells.withColumns({"tr": F.floor(F.col("r") / tile).cast("int"), "tc": F.floor(F.col("c") / tile).cast("int")})


def on_rim(tile: int) -> Column:
    """The cell is in the first or last row or column of its tile."""
    return (F.col("r") % tile).isin(0, tile - 1) | (F.col("c") % tile).isin(0, tile - 1)


def towards(cells: DataFrame, tile: int, reach: int = 1) -> DataFrame:
    """A copy of each cell for every other tile within reach, with that tile's tr and tc; there may be no such tile."""
    if reach > tile:
        raise ValueError("a tile must be as wide as what it looks at beside it")
    beside = lambda x, t: F.array_compact(F.array(F.col(t), F.when((F.col(x) % tile < reach) & (F.col(t) > 0), F.col(t) - 1), F.when(F.col(x) % tile >= tile - reach, F.col(t) + 1)))
    near = lambda x: (F.col(x) % tile < reach) | (F.col(x) % tile >= tile - reach)
    rim = cells.where(near("r") | near("c")).withColumns({"tr0": F.col("tr"), "tc0": F.col("tc"), "tcs": beside("c", "tc")})
    spread = rim.withColumn("tr", F.explode(beside("r", "tr"))).withColumn("tc", F.explode("tcs"))
    return spread.where("tr <> tr0 or tc <> tc0").drop("tr0", "tc0", "tcs")


def whole_groups(rows: DataFrame, keys: list[str], solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *order: str) -> DataFrame:
    """Applies solve to whole groups of rows, one shuffle away, as many groups at once as CELLS allows."""
    names = [x.split()[0] for x in schema.split(",")]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < CELLS:
                continue
            whole = pd.concat(held, ignore_index=True)
            group = numbered(whole, keys)
            last = int((group == group[-1]).argmax())
            if last:
                yield solve(whole.iloc[:last].reset_index(drop=True))[names]
                whole = whole.iloc[last:].reset_index(drop=True)
            held, n = [whole], len(whole)
        if n:
            yield solve(pd.concat(held, ignore_index=True))[names]

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(stream, schema)


def numbered(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """0, 1, 2, ... for the groups, as they come."""
    return rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()


def by_tiles(rows: DataFrame, solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: list[str] = TILE_KEY) -> DataFrame:
    """Applies solve to whole tiles; the keys end with tr and tc."""
    return whole_groups(rows, keys, solve, schema)


class Pack:
    """Rows of whole tiles in one flat array; ``spot`` is each row's place in it, neighbours are ``width`` apart by rows.

    Each tile has an empty row before its first and after its last one, so that a step from any cell, the rim's included,
    ends in the same tile, however wide the tiles beside it in the array are.
    """

    def __init__(self, rows: pd.DataFrame, tile: int, keys: list[str] = TILE_KEY, rim: int = 1):
        self.tile, self.rim = numbered(rows, keys), rim
        self.r, self.c = rows["r"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)
        self.r0, self.c0 = rows["tr"].to_numpy(np.int64) * tile, rows["tc"].to_numpy(np.int64) * tile
        r, c = self.r - self.r0 + rim + 1, self.c - self.c0 + rim
        self.heads = np.flatnonzero(np.diff(self.tile, prepend=-1))
        high, wide = np.maximum.reduceat(r, self.heads) + rim + 1, np.maximum.reduceat(c, self.heads) + rim + 1  # small areas fill only a corner of their tile
        self.begin, self.wide, self.high = np.concatenate([[0], np.cumsum(high * wide)]), wide, high
        self.spot = self.begin[self.tile] + r * wide[self.tile] + c
        self.width = np.repeat(wide, high * wide)
        self.size = int(self.begin[-1])

    def flat(self, values: np.ndarray, empty=np.nan, rows=slice(None)) -> np.ndarray:
        out = np.full(self.size, empty, np.asarray(values).dtype if empty is not np.nan else np.float64)
        out[self.spot[rows]] = values[rows]
        return out

    def find(self, r: np.ndarray, c: np.ndarray, tile: int) -> np.ndarray:
        """Places of the cells (r, c) seen from each row's tile; -1 where they are outside it."""
        a, b = r - self.r0 + self.rim + 1, c - self.c0 + self.rim
        inside = (r >= self.r0) & (r < self.r0 + tile) & (c >= self.c0) & (c < self.c0 + tile) & (a < self.high[self.tile]) & (b < self.wide[self.tile])
        return np.where(inside, self.begin[self.tile] + a * self.wide[self.tile] + b, -1)
