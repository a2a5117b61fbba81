"""Depression filling, flow directions, accumulation, catchments, components and cheapest drainage routes."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from catchwater.checkpoints import cut
from catchwater.operators import spill
from catchwater.operators.fixpoint import relax
from catchwater.operators.grid import KEY, near, neighbourhood
from catchwater.operators.ranks import in_order
from catchwater.operators.tiles import EIGHT, TILE, TILE_KEY, Pack, at_edge, by_tiles, on_rim, placed, sizes, small


def fill(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """The filled surface and ponding depth: the lowest level from which water can leave over the grid's edge."""
    return spill.filled(cells, tile).select(*KEY, "dem", "filled", (F.col("filled") - F.col("dem")).alias("fill_depth"))


def _flat_edge(layers, start, to, diagonal):
    return np.where(layers["filled"][to] == layers["filled"][start], layers["v"][start] + 1, np.inf)


def _flat_start(layers, own, width):
    """0 on the edge and where a neighbour is lower, else inf."""
    z, at = layers["filled"], np.flatnonzero(own)
    low = layers["edge"][at] > 0
    for a, b in EIGHT:
        low |= z[at + a * width[at] + b] < z[at]
    v = np.full(len(own), np.inf)
    v[at[low]] = 0
    return v


def _descent(layers, at, width, r, c):
    """The receiver by steepest descent, on flats the neighbour with fewer steps; NaN on the edge and where there is none."""
    z, v = layers["filled"], layers["v"]
    best, to_r, to_c = np.full(len(at), np.inf), np.full(len(at), np.nan), np.full(len(at), np.nan)
    for a, b in EIGHT:
        to = at + a * width[at] + b
        drop = (z[at] - z[to]) / (2**0.5 if a and b else 1.0)
        with np.errstate(invalid="ignore"):
            rank = np.where(drop > 0, -drop, np.where((z[to] == z[at]) & (v[to] < v[at]), 1e9 + v[to], np.inf))
        better = rank < best
        best, to_r, to_c = np.where(better, rank, best), np.where(better, r + a, to_r), np.where(better, c + b, to_c)
    inner = layers["edge"][at] == 0
    return {"to_r": np.where(inner, to_r, np.nan), "to_c": np.where(inner, to_c, np.nan)}


def flow_direction(filled: DataFrame, tile: int = TILE, rounds: list[int] | None = None) -> DataFrame:
    """The receiver (tr, tc) of each cell that is not on the edge, by steepest descent of the filled surface.

    On flats the way is towards the nearest cell with lower ground or an edge, by steps. Ties: upper, then left.
    """
    cells = filled.select(*KEY, "filled").join(small(cut(sizes(filled))), "area_id").withColumn("edge", at_edge().cast("double"))
    found = relax(cells, ["filled", "edge"], _flat_edge, tile=tile, start=_flat_start, finish=_descent, outputs="to_r,to_c", rounds=rounds)
    whole = lambda x: F.when(~F.isnan(x), F.col(x).cast("int"))
    return found.select(*KEY, whole("to_r").alias("tr"), whole("to_c").alias("tc"))


def _double(flow: DataFrame, value: str, merge) -> DataFrame:
    """Pointer doubling over (cell -> receiver): merges each cell's value along its whole way in log2 rounds."""
    state = cut(flow)
    while state.where("tr is not null").limit(1).count():
        state = cut(merge(state).select(*KEY, "tr", "tc", value))
    return state


def _next_jump(state: DataFrame, *values: str) -> DataFrame:
    """Each cell with the receiver of its receiver, and the receiver's values as ``<name>_2``; roots keep nulls."""
    ahead = state.select("area_id", F.col("r").alias("tr"), F.col("c").alias("tc"), F.col("tr").alias("tr2"), F.col("tc").alias("tc2"), *(F.col(v).alias(f"{v}_2") for v in values))
    going, there = state.where("tr is not null"), state.where("tr is null").withColumns({"tr2": F.lit(None).cast("int"), "tc2": F.lit(None).cast("int"), **{f"{v}_2": F.lit(None).cast(state.schema[v].dataType) for v in values}})
    return going.join(ahead, ["area_id", "tr", "tc"]).unionByName(there)


class _Trees:
    """The flow trees within a pack's tiles: ``jump`` is the place each place drains to, -1 where it ends or leaves its tile."""

    def __init__(self, rows: pd.DataFrame, tile: int):
        self.pack = p = Pack(rows, tile)
        self.down = [rows[x].to_numpy(np.float64) for x in ("down_r", "down_c")]
        going = ~np.isnan(self.down[0])
        to = p.find(*(np.where(going, x, -1).astype(np.int64) for x in self.down), tile)
        self.leaves = going & (to < 0)
        self.to = np.where(going, to, -1)
        self.jump = np.full(p.size, -1)
        self.jump[p.spot] = self.to

    def sums(self, amount: np.ndarray) -> np.ndarray:
        """What drains through each place, of the amounts on all places, by doubling."""
        total, jump = amount.copy(), self.jump.copy()
        while (some := np.flatnonzero(jump >= 0)).size:
            total += np.bincount(jump[some], total[some], len(total))
            jump[some] = jump[jump[some]]
        return total

    def ends(self) -> np.ndarray:
        """The last place of each place's way."""
        end = np.where(self.jump >= 0, self.jump, np.arange(len(self.jump)))
        while True:
            further = end[end]
            if (further == end).all():
                return end
            end = further

    def least(self, rank: np.ndarray) -> np.ndarray:
        """The lowest rank on each place's way."""
        low, jump = rank.copy(), self.jump.copy()
        while (some := np.flatnonzero(jump >= 0)).size:
            low[some] = np.minimum(low[some], low[jump[some]])
            jump[some] = jump[jump[some]]
        return low

    def exits(self) -> dict[str, np.ndarray]:
        """The cell of another tile that each row's way enters next; NaN if it ends before."""
        end, out = self.ends()[self.pack.spot], {}
        for name, values in zip(("exit_r", "exit_c"), self.down):
            out[name] = self.pack.flat(np.where(self.leaves, values, np.nan))[end]
        return out


_TREES = "area_id long, tr int, tc int, r int, c int, down_r int, down_c int, exit_r int, exit_c int"


def _flow_rows(flow: DataFrame, tile: int, *more) -> DataFrame:
    rows = flow.select(F.col("area_id").cast("long").alias("area_id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("tr").cast("int").alias("down_r"), F.col("tc").cast("int").alias("down_c"), *more)
    return placed(rows, tile)


def _whole(values: dict[str, np.ndarray]) -> dict[str, pd.Series]:
    return {k: pd.Series(v).astype("Int32") for k, v in values.items()}


def accumulation(flow: DataFrame, tile: int = TILE) -> DataFrame:
    """Cells that drain through each cell, itself included. A cell drains to a neighbour (tr, tc), or nowhere.

    Sums run down the flow trees within tiles. Only cells that water enters from another tile are joined by doubling, and
    tiles that it enters run once more.
    """

    def once(rows: pd.DataFrame) -> pd.DataFrame:
        trees = _Trees(rows, tile)
        ones = np.zeros(trees.pack.size)
        ones[trees.pack.spot] = 1
        return rows.assign(acc=trees.sums(ones)[trees.pack.spot].astype(np.int64), leaves=trees.leaves, **_whole(trees.exits()))

    def more(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["acc"].notna().to_numpy()
        trees = _Trees(rows, tile)
        extra = np.zeros(trees.pack.size)
        extra[trees.pack.spot[~own]] = rows["entering"].to_numpy(np.float64)[~own]
        trees.jump[trees.pack.spot[own]] = trees.to[own]  # rows of water that enters have no receiver
        return rows.assign(acc=rows["acc"] + trees.sums(extra)[trees.pack.spot])[own]

    trees = cut(by_tiles(_flow_rows(flow, tile), once, _TREES + ", acc long, leaves boolean"))
    leaving = trees.where("leaves").groupBy("area_id", F.col("down_r").alias("r"), F.col("down_c").alias("c")).agg(F.sum("acc").alias("acc"))
    if not leaving.limit(1).count():
        return trees.select(*KEY, "acc")
    entries = leaving.join(trees.where(on_rim(tile)).select(*KEY, F.col("exit_r").alias("tr"), F.col("exit_c").alias("tc")), KEY)

    def merge(state: DataFrame) -> DataFrame:
        gained = state.where("tr is not null").groupBy("area_id", F.col("tr").alias("r"), F.col("tc").alias("c")).agg(F.sum("acc").alias("more"))
        jumped = _next_jump(state).join(gained, KEY, "left")
        return jumped.select(*KEY, F.col("tr2").alias("tr"), F.col("tc2").alias("tc"), (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc"))

    entering = cut(placed(_double(entries, "acc", merge).select(*KEY, F.col("acc").alias("entering")), tile))
    entered = small(entering.select(*TILE_KEY).distinct())
    rows = trees.select(*TILE_KEY, "r", "c", "down_r", "down_c", "acc")
    both = rows.join(entered, TILE_KEY, "left_semi").unionByName(entering, allowMissingColumns=True)
    again = by_tiles(both, more, "area_id long, r int, c int, acc long")
    return rows.join(entered, TILE_KEY, "left_anti").select(*KEY, "acc").unionByName(again)


def catchments(flow: DataFrame, sinks: DataFrame, tile: int = TILE) -> DataFrame:
    """T15 labels: the largest sink (by volume, then id) on each cell's way down; null where there is none.

    Ways run down the flow trees within tiles; beyond, only cells that water enters from another tile are joined by doubling.
    """
    ranked = sinks.withColumn("rank", F.row_number().over(Window.partitionBy("area_id").orderBy(F.desc("volume_m3"), "sink_id")))
    points = small(cut(ranked.groupBy(*KEY).agg(F.min("rank").alias("rank"))))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        trees = _Trees(rows, tile)
        low = trees.least(trees.pack.flat(rows["rank"].fillna(np.inf).to_numpy(np.float64), np.inf))[trees.pack.spot]
        return rows.assign(rank=pd.Series(np.where(np.isfinite(low), low, np.nan)).astype("Int32"), leaves=trees.leaves, **_whole(trees.exits()))

    rows = _flow_rows(flow.join(points, KEY, "left"), tile, F.col("rank").cast("double").alias("rank"))
    trees = cut(by_tiles(rows, solve, _TREES + ", rank int, leaves boolean"))
    names = ranked.select("area_id", "rank", "sink_id")
    entries = trees.where("leaves").select("area_id", F.col("down_r").alias("r"), F.col("down_c").alias("c")).distinct()
    if not entries.limit(1).count():
        return trees.join(small(cut(names)), ["area_id", "rank"], "left").select(*KEY, "sink_id")
    start = entries.join(trees.where(on_rim(tile)).select(*KEY, F.col("exit_r").alias("tr"), F.col("exit_c").alias("tc"), "rank"), KEY)

    def merge(state: DataFrame) -> DataFrame:
        return _next_jump(state, "rank").select(*KEY, F.col("tr2").alias("tr"), F.col("tc2").alias("tc"), F.least("rank", "rank_2").alias("rank"))

    ahead = small(cut(_double(start, "rank", merge).select("area_id", F.col("r").alias("exit_r"), F.col("c").alias("exit_c"), F.col("rank").alias("beyond"))))
    found = trees.join(ahead, ["area_id", "exit_r", "exit_c"], "left").select(*KEY, F.least("rank", "beyond").alias("rank"))
    return found.join(small(cut(names)), ["area_id", "rank"], "left").select(*KEY, "sink_id")


def catchment_areas(flow: DataFrame, sinks: DataFrame, cell_m2: float = 900.0, tile: int = TILE) -> DataFrame:
    """T15 areas: the whole upstream area of each sink, claimed or not; 0 for a sink off the grid."""
    return sinks.join(accumulation(flow, tile), KEY, "left").select("area_id", "sink_id", (F.coalesce("acc", F.lit(0)) * cell_m2).alias("catchment_m2"))


def components(masked: DataFrame, tile: int = TILE) -> DataFrame:
    """4-connected regions of the given cells, numbered from 1 by their first cell in row order."""
    low = spill.labelled(masked, tile)
    heads = in_order(low.groupBy("area_id", "node").agg(F.count("*").alias("n_cells")), ["area_id"], ["node"]).withColumnRenamed("rank", "label")
    return low.join(small(cut(heads)), ["area_id", "node"]).select(*KEY, "label", "n_cells")


def _route_edge(dx: float, penalty: float):
    def edge(layers, start, to, diagonal):  # water runs from ``to`` to ``start``: it pays for the climb and the land use there
        climb = np.maximum(layers["z"][start] - layers["z"][to], 0)
        return layers["v"][start] + dx * (1.41421 if diagonal else 1.0) * (1 + penalty * climb) * layers["mult"][start]

    return edge


def cost_to_outfall(cells: DataFrame, dx: float = 60.0, penalty: float = 40.0, tile: int = TILE, rounds: list[int] | None = None) -> DataFrame:
    """C9 costs: the least cost from each cell (z, mult, is_outfall) to any outfall; inf if none can be reached.

    ``rounds`` gets the number of tiles that each round had to run again.
    """
    seeds = cells.withColumn("v", F.when(F.col("is_outfall"), 0.0).otherwise(float("inf")))
    return relax(seeds, ["z", "mult"], _route_edge(dx, penalty), tile=tile, rounds=rounds).withColumnRenamed("v", "cost")


def next_cells(costs: DataFrame, dx: float = 60.0, penalty: float = 40.0) -> DataFrame:
    """C9 steps: the neighbour through which each cell reaches its outfall most cheaply (ties: upper, then left)."""
    around = neighbourhood(costs, "z", "mult", "cost")
    options = []
    for k, (a, b) in enumerate(EIGHT):
        far = 1.41421 if a and b else 1.0
        total = near(a, b, "cost") + dx * far * (1 + penalty * F.greatest(near(a, b, "z") - F.col("z"), F.lit(0.0))) * near(a, b, "mult")
        options.append(F.when(total.isNotNull(), F.struct(total.alias("t"), F.lit(k).alias("k"))))
    best = F.array_min(F.array_compact(F.array(*options)))["k"]
    step = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, d in enumerate(EIGHT) for x in (k, d[i]))), best)
    going = (F.col("cost") > 0) & (F.col("cost") < float("inf"))
    return around.select(*KEY, "cost", F.when(going, F.col("r") + step(0)).alias("tr"), F.when(going, F.col("c") + step(1)).alias("tc"))


def routes(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """C9 paths: from each source (area_id, route_id, r, c) the cells k = 0.. to its outfall; none if unreachable.

    Jumps of 1, 2, 4, ... cells are made by doubling; then each level, from the longest, adds the cells that lie one such
    jump behind those known, so rounds grow with the logarithm of a route's length.
    """
    jumps = [cut(steps.where("tr is not null").select(*KEY, "tr", "tc"))]
    while jumps[-1].limit(1).count():
        ahead = jumps[-1].select("area_id", F.col("r").alias("tr"), F.col("c").alias("tc"), F.col("tr").alias("tr2"), F.col("tc").alias("tc2"))
        jumps.append(cut(jumps[-1].join(ahead, ["area_id", "tr", "tc"]).select(*KEY, F.col("tr2").alias("tr"), F.col("tc2").alias("tc"))))
    reached = steps.where(F.col("cost") < float("inf")).select(*KEY)
    out = cut(sources.join(reached, KEY, "left_semi").select("area_id", "route_id", F.lit(0).alias("k"), "r", "c"))
    for level in reversed(range(len(jumps) - 1)):
        behind = out.join(jumps[level], KEY).select("area_id", "route_id", (F.col("k") + (1 << level)).alias("k"), F.col("tr").alias("r"), F.col("tc").alias("c"))
        out = cut(out.union(behind))
    return out
