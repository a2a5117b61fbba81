"""Monotone relaxation over a grid: tiles are solved whole, and only those whose neighbours' border fell are solved again."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from catchwater.checkpoints import cut
from catchwater.operators.tiles import EIGHT, TILE, TILE_KEY, Pack, by_tiles, on_rim, placed, small, towards

Edge = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray, bool], np.ndarray]
#: Rows of a tile: its own cells, its neighbours' cells beside it, and values that have arrived for the latter.
OWN, BESIDE, ARRIVED = 0, 1, 2


def spread(layers: dict[str, np.ndarray], v: np.ndarray, own: np.ndarray, width: np.ndarray, edge: Edge, around, front: np.ndarray) -> None:
    """Lowers v in place over flat tiles: only cells beside one that has just fallen are looked at again."""
    while len(front):
        fallen = []
        for a, b in around:
            to = front + a * width[front] + b
            keep = own[to]
            start, to = front[keep], to[keep]
            value = edge(layers | {"v": v}, start, to, bool(a and b))
            lower = value < v[to]
            to, value = to[lower], value[lower]
            np.minimum.at(v, to, value)
            fallen.append(to)
        front = np.unique(np.concatenate(fallen))


def relax(cells: DataFrame, layers: list[str], edge: Edge, around=EIGHT, tile: int = TILE, start=None, finish=None, outputs: str = "", rounds: list[int] | None = None) -> DataFrame:
    """Lowers v (a double; inf where nothing reaches) until no neighbour lowers a cell any more.

    cells: area_id, r, c, v and the layers; ``start(layers, own, width)`` may give v instead. ``edge(layers, start, to,
    diagonal)`` gives the value that the cells ``to`` may fall to from their neighbours ``start``, indices into flat arrays
    of the layers and v. ``finish(layers, at, width, r, c)`` may add the columns ``outputs`` (all double) for the cells
    ``at`` from the final v, their neighbours in other tiles included.

    Cells are shuffled once; tiles that touch no other are done then. Of the others, border values travel from round to
    round; a tile runs again only if a value beside it fell, and a last pass gives the cells. ``rounds`` gets the number of
    tiles run in each round.
    """
    key = ["area_id", "r", "c"]
    names = [x.split()[0] for x in outputs.split(",") if x]
    extra = "".join(f", {n} double" for n in names)
    schema = "area_id long, tr int, tc int, r int, c int, kind int, open boolean, v double" + "".join(f", {x} double" for x in layers) + extra

    def solved(rows: pd.DataFrame, first: bool):
        p, kind, before = Pack(rows, tile), rows["kind"].to_numpy(), rows["v"].to_numpy(np.float64)
        flat = {x: p.flat(rows[x].to_numpy(np.float64), rows=kind != ARRIVED) for x in layers}
        own = np.zeros(p.size, bool)
        own[p.spot[kind == OWN]] = True
        v = np.full(p.size, np.inf)
        if first:
            v[p.spot[kind == OWN]] = before[kind == OWN]
            if start:
                v = np.where(own, start(flat, own, p.width), np.inf)
            front = np.flatnonzero(np.isfinite(v))
        else:
            use = kind != BESIDE
            v[p.spot[use]] = before[use]
            front = np.unique(p.spot[kind == ARRIVED])
        spread(flat, v, own, p.width, edge, around, front)
        return p, kind, flat | {"v": v}

    def finished(rows: pd.DataFrame, p: Pack, flat: dict, at: np.ndarray) -> dict:
        return finish(flat, p.spot[at], p.width, p.r[at], p.c[at]) if finish else {}

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        p, kind, flat = solved(rows, True)
        opened = np.maximum.reduceat(kind, p.heads)[p.tile] > OWN
        made = finished(rows, p, flat, np.arange(len(rows)))
        alone = np.minimum.reduceat(kind, p.heads)[p.tile] == OWN  # a tile that only its neighbours name has no cells
        return rows.assign(open=opened, v=flat["v"][p.spot], **made)[alone]

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        p, kind, flat = solved(rows, False)
        k, c = (p.r - p.r0) % tile, (p.c - p.c0) % tile
        rim = (kind == OWN) & ((k == 0) | (k == tile - 1) | (c == 0) | (c == tile - 1))
        return rows.assign(v=flat["v"][p.spot])[rim][[*TILE_KEY, "r", "c", "v"]]

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        p, kind, flat = solved(rows, False)
        at = np.flatnonzero(kind == OWN)
        return rows.iloc[at].assign(v=flat["v"][p.spot[at]], **finished(rows, p, flat, at))

    def sent(border: DataFrame) -> DataFrame:
        return towards(border.where("v < double('inf')").where(on_rim(tile)), tile).select(*TILE_KEY, "r", "c", "v")

    own = cells.withColumn("v", F.lit(float("inf"))) if start else cells
    own = placed(own.select(F.col("area_id").cast("long").alias("area_id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *(F.col(x).cast("double").alias(x) for x in ["v", *layers])), tile)
    rows = own.withColumn("kind", F.lit(OWN)).unionByName(towards(own, tile).withColumn("kind", F.lit(BESIDE)))
    now = cut(by_tiles(rows.select(*TILE_KEY, "r", "c", "kind", "v", *layers), first, schema))
    done = now.where("not open").select(*key, "v", *layers, *names)
    opened = now.where("open").drop("open", *names)
    arriving = sent(opened.where(f"kind = {OWN}"))
    if not arriving.limit(1).count() and not opened.limit(1).count():
        return done

    def dealt(tiles: DataFrame, values: DataFrame) -> DataFrame:
        return tiles.unionByName(values.select(*TILE_KEY, "r", "c", "v").withColumn("kind", F.lit(ARRIVED)), allowMissingColumns=True)

    homes = small(cut(opened.select(*TILE_KEY).distinct()))
    known = cut(arriving.join(homes, TILE_KEY, "left_semi").groupBy(*TILE_KEY, "r", "c").agg(F.min("v").alias("v"))).withColumn("fell", F.lit(True))
    while True:
        active = small(cut(known.where("fell").select(*TILE_KEY).distinct()))
        n = active.count()
        if not n:
            break
        if rounds is not None:
            rounds.append(n)
        moved = by_tiles(dealt(opened.join(active, TILE_KEY, "left_semi"), known.join(active, TILE_KEY, "left_semi")), again, "area_id long, tr int, tc int, r int, c int, v double")
        both = known.select(*TILE_KEY, "r", "c", "v", F.col("v").alias("old")).unionByName(sent(moved).join(homes, TILE_KEY, "left_semi"), allowMissingColumns=True)
        told = both.groupBy(*TILE_KEY, "r", "c").agg(F.min("v").alias("v"), F.min("old").alias("old"))
        known = cut(told.select(*TILE_KEY, "r", "c", "v", (F.col("old").isNull() | (F.col("v") < F.col("old"))).alias("fell")))
    final = by_tiles(dealt(opened, known), last, schema.replace("open boolean, ", ""))
    return done.unionByName(final.select(*key, "v", *layers, *names))
