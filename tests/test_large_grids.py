"""Areas of many tiles against searches of the whole grid, and what the passes over them cost."""

import functools
import heapq

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame, functions as F

from catchwater.operators import fixpoint, hydrology, spill, tiles
from test_operators import EIGHT, back, flooded, frame


def grid(spark, rows, cols, **layers):
    """Cells made by Spark; layers are SQL over r and c."""
    return spark.range(rows * cols).selectExpr("1L as area_id", f"cast(id div {cols} as int) as r", f"cast(id % {cols} as int) as c").selectExpr("*", *(f"cast({v} as double) as {k}" for k, v in layers.items()))


def counted(monkeypatch, module, name):
    calls, plain = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **b: (calls.append(name), plain(*a, **b))[1])
    return calls


@pytest.mark.parametrize("steps", [3, 1000])
@pytest.mark.parametrize("tile, block", [(7, 2), (4, 3)])
def test_fill_over_many_tiles(spark, monkeypatch, tile, block, steps):
    monkeypatch.setattr(spill, "BLOCK", block)
    z = np.random.default_rng(tile + steps).integers(0, steps, (45, 61)).astype(float)
    assert np.array_equal(back(hydrology.fill(frame(spark, dem=z), tile), "filled", z.shape), flooded(z))


def test_fill_of_a_basin_behind_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(spill, "BLOCK", 2)
    z = np.full((48, 48), 9.0)
    z[4:44, 4:44] = 1.0  # a lake that ends at a winding gap
    z[4:44:8, 4:40], z[8:44:8, 8:44] = 9.0, 9.0
    z[0:5, 43] = 2.0
    assert np.array_equal(back(hydrology.fill(frame(spark, dem=z), 6), "filled", z.shape), flooded(z))


def test_fill_without_a_way_out_and_with_holes(spark):
    z = np.random.default_rng(2).integers(0, 9, (20, 20)).astype(float)
    df = frame(spark, dem=z).where("not (r between 8 and 12 and c in (8, 12)) and not (c between 8 and 12 and r in (8, 12))")
    got = back(hydrology.fill(df, 5), "filled", z.shape)
    assert np.isinf(got[9:12, 9:12]).all() and np.isfinite(got[0]).all() and np.isnan(got[8, 8])
    assert hydrology.fill(df.where("r < 0")).count() == 0


def test_cuts_of_fill_do_not_grow_with_the_way(spark, monkeypatch):
    calls = counted(monkeypatch, spill, "cut")
    counts = []
    for dem in ("pmod(r * 7 + c * 3, 5)", "if(r % 4 = 3 and c <> if(r % 8 = 3, 1, 62) or r in (0, 63) or c in (0, 63), 50, 1)"):
        del calls[:]
        hydrology.fill(grid(spark, 64, 64, dem=dem), 8).write.format("noop").mode("overwrite").save()
        counts.append(len(calls))
    assert counts[0] == counts[1] < 10


@pytest.mark.parametrize("tile", [5, 8])
def test_directions_on_wide_flats(spark, tile):
    z = np.full((26, 31), 4.0)
    z[20:, :] = np.random.default_rng(1).integers(2, 7, (6, 31))
    filled = flooded(z)
    one, many = (hydrology.flow_direction(frame(spark, filled=filled), t) for t in (64, tile))
    for x in ("tr", "tc"):
        assert np.array_equal(back(one, x, z.shape, int), back(many, x, z.shape, int))
    assert back(many, "tr", z.shape, int)[13, 1] == 12  # one step from the edge, the upper of equal ways


def test_flow_trees_over_tiles(spark):
    z = np.random.default_rng(5).integers(0, 30, (33, 27)).astype(float)
    flow = hydrology.flow_direction(frame(spark, filled=flooded(z)), 64).cache()
    tr, tc = back(flow, "tr", z.shape, int), back(flow, "tc", z.shape, int)
    spots = [(6, 6, 5.0), (20, 13, 9.0), (20, 14, 9.0), (30, 2, 1.0), (11, 19, 7.0)]
    ponds = spark.createDataFrame([(1, i, r, c, v) for i, (r, c, v) in enumerate(spots)] + [(1, 9, 99, 99, 3.0)], "area_id long, sink_id int, r int, c int, volume_m3 double")
    rank = {spots[i][:2]: k for k, i in enumerate(sorted(range(len(spots)), key=lambda i: (-spots[i][2], i)))}
    names = sorted(range(len(spots)), key=lambda i: (-spots[i][2], i))
    acc, label = np.zeros(z.shape), np.full(z.shape, -1)
    for i in range(z.shape[0]):
        for j in range(z.shape[1]):
            x, y, best = i, j, 99
            while True:
                acc[x, y] += 1
                best = min(best, rank.get((x, y), 99))
                if tr[x, y] < 0:
                    break
                x, y = tr[x, y], tc[x, y]
            label[i, j] = names[best] if best < 99 else -1
    for tile in (4, 64):
        assert np.array_equal(back(hydrology.accumulation(flow, tile), "acc", z.shape), acc)
        assert np.array_equal(back(hydrology.catchments(flow, ponds, tile), "sink_id", z.shape, int), label)
    areas = {r.sink_id: r.catchment_m2 for r in hydrology.catchment_areas(flow, ponds, 1.0, 6).collect()}
    assert areas == {i: acc[r, c] for i, (r, c, _) in enumerate(spots)} | {9: 0}


def test_only_border_cells_are_doubled(spark, monkeypatch):
    seen, plain = [], hydrology._double
    monkeypatch.setattr(hydrology, "_double", lambda flow, value, merge: (seen.append(flow.count()), plain(flow, value, merge))[1])
    flow = grid(spark, 64, 64, x="0").selectExpr("area_id", "r", "c", "if(r = 63, null, r + 1) as tr", "if(r = 63, null, c) as tc")
    got = hydrology.accumulation(flow, 16)
    assert got.where("acc <> r + 1").count() == 0 and got.count() == 64 * 64
    assert seen == [3 * 64]  # the first rows of the tiles below others


def test_components_over_tiles(spark, monkeypatch):
    calls = counted(monkeypatch, spill, "by_tiles")
    rng = np.random.default_rng(6)
    for on in (rng.random((40, 40)) < 0.6, np.ones((40, 40), bool)):
        want = np.zeros(on.shape, int)
        for i, j in np.argwhere(on):
            if not want[i, j]:
                want[i, j], todo = want.max() + 1, [(i, j)]
                while todo:
                    x, y = todo.pop()
                    for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                        p, q = x + a, y + b
                        if 0 <= p < 40 and 0 <= q < 40 and on[p, q] and not want[p, q]:
                            want[p, q] = want[i, j]
                            todo.append((p, q))
        got = hydrology.components(frame(spark, on=on.astype(float)).where("on = 1"), 5)
        assert np.array_equal(np.maximum(back(got, "label", on.shape, int), 0), want)
    snake = np.zeros((40, 40))
    snake[::2, :] = 1
    snake[1::4, 39] = snake[3::4, 0] = 1
    del calls[:]
    assert {(r.label, r.n_cells) for r in hydrology.components(frame(spark, on=snake).where("on = 1"), 5).collect()} == {(1, int(snake.sum()))}
    assert len(calls) == 1  # cells meet in tasks once, whatever the shape


def cheapest(z, mult, end):
    best = np.where(end == 1, 0.0, np.inf)
    heap = [(0.0, *map(int, at)) for at in np.argwhere(end == 1)]
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > best[i, j]:
            continue
        for a, b in EIGHT:
            x, y = i + a, j + b
            if 0 <= x < z.shape[0] and 0 <= y < z.shape[1] and cost + (step := 60.0 * (1.41421 if a and b else 1.0) * (1 + 40.0 * max(z[i, j] - z[x, y], 0)) * mult[i, j]) < best[x, y]:
                best[x, y] = cost + step
                heapq.heappush(heap, (best[x, y], x, y))
    return best


def test_routes_run_only_tiles_that_change(spark):
    mult = np.random.default_rng(4).choice([0.5, 1.0, 30.0], (64, 64))
    z, end = np.random.default_rng(9).random((64, 64)), np.zeros((64, 64))
    end[2, 3], mult[40, :] = 1, 30.0
    best, rounds = cheapest(z, mult, end), []
    cells = frame(spark, z=z, mult=mult, end=end).withColumn("is_outfall", F.col("end") == 1)
    assert np.allclose(back(hydrology.cost_to_outfall(cells, tile=8, rounds=rounds), "cost", z.shape), best)
    assert rounds[0] == 3 and max(rounds) < 64 and sum(rounds) < 0.4 * 64 * len(rounds)  # the first outfall's tile wakes its three neighbours
    alone = cells.where("r < 30 or r > 33")
    rounds.clear()
    got = back(hydrology.cost_to_outfall(alone, tile=8, rounds=rounds), "cost", z.shape)
    assert np.isinf(got[34:]).all() and sum(rounds) < 32 * len(rounds)  # the lower half is never run again


def test_steps_stay_in_their_tile():
    places = [(area, tr, tc, r, c) for area, high, wide in [(1, 3, 2), (2, 9, 9), (3, 1, 5)] for tr in range(-(-high // 4)) for tc in range(-(-wide // 4)) for r in range(max(tr * 4 - 1, 0), min(tr * 4 + 5, high)) for c in range(max(tc * 4 - 1, 0), min(tc * 4 + 5, wide))]
    p = tiles.Pack(pd.DataFrame(places, columns=["area_id", "tr", "tc", "r", "c"]), 4)
    at = {spot: (p.tile[i], p.r[i], p.c[i]) for i, spot in enumerate(p.spot)}
    assert len(at) == len(places)
    for spot, (tile, r, c) in at.items():
        for a, b in EIGHT:
            assert 0 <= (to := spot + a * p.width[spot] + b) < p.size
            assert at.get(to, (tile, r + a, c + b)) == (tile, r + a, c + b)


@pytest.mark.parametrize("shapes", [[(64, 64), (3, 5)], [(5, 3), (20, 9), (9, 20), (1, 1), (17, 16)]])
def test_route_costs_of_areas_of_many_shapes(spark, shapes):
    rng, made, wanted = np.random.default_rng(len(shapes)), [], []
    for area, shape in enumerate(shapes):
        z, mult, end = rng.random(shape), rng.choice([0.5, 1.0, 30.0], shape), np.zeros(shape)
        end[shape[0] // 2, 0] = 1
        made.append(frame(spark, z=z, mult=mult, end=end).withColumn("area_id", F.lit(area).cast("long")))
        wanted.append(cheapest(z, mult, end))
    cells = functools.reduce(DataFrame.unionByName, made).withColumn("is_outfall", F.col("end") == 1)
    got = hydrology.cost_to_outfall(cells, tile=8).cache()
    for area, best in enumerate(wanted):
        assert np.allclose(back(got.where(f"area_id = {area}"), "cost", best.shape), best)


def test_tiles_come_whole(spark, monkeypatch):
    monkeypatch.setattr(tiles, "CELLS", 64)
    cells = grid(spark, 50, 50, dem="pmod(r * 31 + c * 17, 23)")
    many = cells.union(cells.withColumn("area_id", F.lit(2).cast("long")).where("r < 3 and c < 3"))
    got = hydrology.fill(many, 6)
    z = back(cells, "dem", (50, 50))
    assert np.array_equal(back(got.where("area_id = 1"), "filled", z.shape), flooded(z))
    assert got.where("area_id = 2").count() == 9 and fixpoint.relax(many.where("r < 0").withColumn("v", F.lit(0.0)), [], None).count() == 0
