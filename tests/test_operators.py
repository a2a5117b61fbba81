"""Operators against brute force and hand-worked values."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwater.operators import alerts, hydrology, planning, radar, sinks, terrain
from catchwater.sources import tables

EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def frame(spark, **layers):
    first = next(iter(layers.values()))
    rows = [(1, i, j, *(float(x[i, j]) for x in layers.values())) for i in range(first.shape[0]) for j in range(first.shape[1])]
    return spark.createDataFrame(rows, "area_id long, r int, c int, " + ", ".join(f"{k} double" for k in layers))


def back(df, name, shape, kind=float):
    out = np.full(shape, np.nan if kind is float else -1, kind)
    for row in df.collect():
        if row[name] is not None:
            out[row.r, row.c] = row[name]
    return out


@pytest.fixture(scope="module")
def dem():
    return np.round(np.random.default_rng(3).random((13, 17)) * 10, 1)


def flooded(z):
    level, heap, seen = z.copy(), [], np.zeros(z.shape, bool)
    for i in range(z.shape[0]):
        for j in range(z.shape[1]):
            if i in (0, z.shape[0] - 1) or j in (0, z.shape[1] - 1):
                heapq.heappush(heap, (z[i, j], i, j))
                seen[i, j] = True
    while heap:
        h, i, j = heapq.heappop(heap)
        for a, b in EIGHT:
            x, y = i + a, j + b
            if 0 <= x < z.shape[0] and 0 <= y < z.shape[1] and not seen[x, y]:
                seen[x, y] = True
                level[x, y] = max(z[x, y], h)
                heapq.heappush(heap, (level[x, y], x, y))
    return level


@pytest.mark.parametrize("tile", [5, 64])
def test_fill_matches_priority_flood(spark, dem, tile):
    got = hydrology.fill(frame(spark, dem=dem), tile)
    assert np.allclose(back(got, "filled", dem.shape), flooded(dem))


def test_flow_reaches_the_edge_and_accumulates_all(spark, dem):
    filled = flooded(dem)
    flow = hydrology.flow_direction(frame(spark, filled=filled), 6)
    tr, tc = back(flow, "tr", dem.shape, int), back(flow, "tc", dem.shape, int)
    for i in range(dem.shape[0]):
        for j in range(dem.shape[1]):
            x, y, n = i, j, 0
            while tr[x, y] >= 0:
                assert filled[tr[x, y], tc[x, y]] <= filled[x, y]
                x, y, n = tr[x, y], tc[x, y], n + 1
                assert n < dem.size
            assert x in (0, dem.shape[0] - 1) or y in (0, dem.shape[1] - 1)
    acc = hydrology.accumulation(flow)
    ends = acc.join(flow.where("tr is null"), ["area_id", "r", "c"]).agg(F.sum("acc")).first()[0]
    assert ends == dem.size


def test_components_across_tiles(spark):
    snake = np.zeros((9, 9))
    snake[::2, :] = 1
    snake[1::4, 8] = snake[3::4, 0] = 1
    got = hydrology.components(frame(spark, on=snake).where("on = 1"), 2).collect()
    assert {r.label for r in got} == {1} and len(got) == snake.sum()


def test_routes_go_round_buildings(spark):
    mult, z = np.ones((21, 21)), np.zeros((21, 21))
    mult[3:18, 10] = 30
    end = np.zeros((21, 21))
    end[10, 18] = 1
    costs = hydrology.cost_to_outfall(frame(spark, z=z, mult=mult, end=end).withColumn("is_outfall", F.col("end") == 1), tile=8)
    source = spark.createDataFrame([(1, 7, 10, 2)], "area_id long, route_id int, r int, c int")
    path = sorted((r.k, r.r, r.c) for r in hydrology.routes(hydrology.next_cells(costs), source).collect())
    assert path[0][1:] == (10, 2) and path[-1][1:] == (10, 18)
    assert all(mult[r, c] == 1 for _, r, c in path)


def test_routes_follow_a_cheap_road(spark):
    mult, z, end = np.ones((10, 40)), np.zeros((10, 40)), np.zeros((10, 40))
    mult[1, :], end[8, 39] = 0.3, 1
    costs = hydrology.cost_to_outfall(frame(spark, z=z, mult=mult, end=end).withColumn("is_outfall", F.col("end") == 1), tile=16)
    source = spark.createDataFrame([(1, 7, 8, 0), (2, 8, 0, 0)], "area_id long, route_id int, r int, c int")
    path = sorted((r.k, r.r, r.c) for r in hydrology.routes(hydrology.next_cells(costs), source).collect())
    assert [k for k, _, _ in path] == list(range(len(path))) and path[-1][1:] == (8, 39)
    assert sum(r == 1 for _, r, _ in path) > 20
    assert all(max(abs(a[1] - b[1]), abs(a[2] - b[2])) == 1 for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("tile", [5, 64])
def test_route_costs_match_a_heap(spark, dem, tile):
    rng = np.random.default_rng(8)
    mult, end = rng.choice([0.5, 1.0, 30.0], dem.shape), np.zeros(dem.shape)
    end[2, 3] = end[11, 15] = 1
    best, heap = np.where(end == 1, 0.0, np.inf), [(0.0, 2, 3), (0.0, 11, 15)]
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > best[i, j]:
            continue
        for a, b in EIGHT:
            x, y = i + a, j + b
            if 0 <= x < dem.shape[0] and 0 <= y < dem.shape[1]:
                step = cost + 60.0 * (1.41421 if a and b else 1.0) * (1 + 40.0 * max(dem[i, j] - dem[x, y], 0)) * mult[i, j]
                if step < best[x, y]:
                    best[x, y] = step
                    heapq.heappush(heap, (step, x, y))
    got = hydrology.cost_to_outfall(frame(spark, z=dem, mult=mult, end=end).withColumn("is_outfall", F.col("end") == 1), tile=tile)
    assert np.allclose(back(got, "cost", dem.shape), best)


def test_reports_by_line_and_by_date(spark, tmp_path):
    for day, rows in (("2024-06-01", [(1, 0.5), (2, 0.25)]), ("2024-06-03", [(1, 0.75)])):
        tables.write_reports(spark.createDataFrame(rows, "area_id long, csi double").coalesce(1), str(tmp_path / day))
    read = tables.read_reports(spark, str(tmp_path / "*"), "area_id long, csi double")
    assert read.count() == 3
    got = {r.area_id: {k: v.csi for k, v in r.scores.items()} for r in tables.collate(read).collect()}
    assert got == {1: {"2024-06-01": 0.5, "2024-06-03": 0.75}, 2: {"2024-06-01": 0.25}}
    (tmp_path / "twin_2024-07-01.json").write_text('{\n"area_id": 9,\n"csi": 1.0\n}')
    assert [tuple(r) for r in tables.read_reports(spark, str(tmp_path / "twin_*.json"), "area_id long, csi double", whole_files=True).collect()] == [(9, 1.0, "2024-07-01")]
    with pytest.raises(Exception, match="several scores reports"):
        tables.facts("area_id", scores=read.drop("report_date")).collect()


def test_wards_by_polygons_or_grid(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 1.5), (3, 9.0, 9.0)], "sink_id int, lat double, lon double")
    square = lambda x: [{"lon": x + a, "lat": b} for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
    rings = lambda n: spark.createDataFrame([(f"w{i}", square(float(i))) for i in range(n)], "ward string, ring array<struct<lon: double, lat: double>>")
    ward = lambda n: {r.sink_id: r.ward for r in alerts.assign_wards(points, rings(n), (0.0, 0.0, 2.0, 2.0)).collect()}
    assert ward(5) == {1: "w0", 2: "w1", 3: None}
    assert ward(4)[1] is None and ward(4)[3] is None  # on the grid's edges, and off it


def test_perfect_threshold(spark):
    rows = [(1, 1 if i < 4 else 0, 5.0 if i < 4 else 0.0) for i in range(8) for _ in range(8)]
    df = spark.createDataFrame(rows, "event_id int, wet int, pred double")
    ts = spark.createDataFrame([(0.5,), (1.0,), (6.0,)], "t double")
    best = radar.best_threshold(radar.sweep(df, "pred", ts), []).first()
    assert best.mean_csi == 1.0 and best.threshold == 0.5


def test_storage_targets(spark):
    curve = spark.createDataFrame([(1, 100, 10.0, 1000), (1, 500, 21.4, 5000), (1, 1000, 40.3, 9000), (1, 2000, 67.3, 15000), (1, 2775, 100.0, 20000)], "area_id long, sites int, reduction_pct double, storage_m3 long").withColumn("unstable", F.lit(False))
    got = {r.target: r for r in planning.sites_for_targets(curve, spark.createDataFrame([(30.0,), (50.0,), (70.0,), (101.0,), (5.0,)], "target double")).collect()}
    assert [got[t].sites for t in (30.0, 50.0, 70.0)] == [727, 1359, 2063]
    assert got[101.0].sites is None and got[101.0].note and got[5.0].sites == 100


def test_storage_curve_sums_are_exact(spark):
    h = [0.7 - 0.15] * 3
    minima = spark.createDataFrame([(1, 0, j, x, j + 1) for j, x in enumerate(h)], "area_id long, r int, c int, pooled double, rank int")
    got = planning.storage_curve(minima, minima.where("rank > 9"), [1], cell_m2=10.0).orderBy("sites").collect()
    assert [(r.sites, r.storage_m3, r.median_site_m3) for r in got] == [(1, 6, 6), (3, 16, 6)]  # 5.5 and 16.5, halves to even
    deep = [1000.1, 999.7, 0.8]  # the rest after two sites must not come from what is left of a large total
    minima = spark.createDataFrame([(1, 0, j, x, j + 1) for j, x in enumerate(deep)], "area_id long, r int, c int, pooled double, rank int")
    after = minima.select("area_id", "r", "c", F.when(F.col("rank") == 3, 0.25).otherwise(1000.3).alias("pooled"))
    got = planning.storage_curve(minima, after, [2, 7]).orderBy("sites").collect()
    assert [(r.sites, r.reduction_pct) for r in got] == [(2, 68.8), (3, 100.0)]
    got = planning.storage_curve(minima, after.withColumn("pooled", F.lit(float("nan"))), [2]).orderBy("sites").collect()
    assert [(r.sites, r.unstable) for r in got] == [(2, True), (3, False)]


def test_basins_of_equal_volume_tie(spark):
    depth = np.zeros((6, 9))
    depth[0, :4], depth[3, :3], depth[3, 3] = 0.25, 0.25, 0.2500000001
    got = sinks.basins(frame(spark, depth=depth), "depth", F.lit(1.0)).collect()
    assert [r.label for r in sorted(got, key=lambda r: r.rank)] == [1, 2]


def test_edge_cells_of_equal_height_tie(spark):
    z = np.full((4, 4), 50.0)
    z[0, 2], z[3, 1] = 40.325, 40.325 - 1e-14
    none = spark.createDataFrame([], "area_id long, r int, c int, jrc double")
    got = planning.outfalls(frame(spark, z=z), none, none).collect()
    assert [(r.r, r.c, r.kind) for r in got] == [(0, 2, "edge")]


def test_bed_falls_and_stays_under_ground(spark):
    rows = [(1, 1, k, 0, k, float(z)) for k, z in enumerate([5, 5.2, 4.9, 6, 4.5])]
    out = planning.descending_bed(spark.createDataFrame(rows, "area_id long, route_id int, k int, r int, c int, z double"), 1.0).orderBy("k").collect()
    assert all(a.bed - b.bed >= 0.12 - 1e-9 for a, b in zip(out, out[1:])) and all(r.bed <= r.z - 1.0 + 1e-9 for r in out)


def test_candidate_sites_are_apart(spark):
    h = np.zeros((32, 32))
    h[10, 10], h[11, 11], h[25, 20], h[0, 0] = 3, 2.9, 2, 5
    none = spark.createDataFrame([], "area_id long, sink_id int, r int, c int, volume_m3 double")
    got = planning.candidate_sites(none, frame(spark, h=h), 32, 3).collect()
    assert [(r.r, r.c) for r in sorted(got, key=lambda r: r.site)] == [(10, 10), (25, 20)]


def test_box_mean_mirrors_the_border(spark, dem):
    padded = np.pad(dem, 3, mode="symmetric")
    want = np.array([[padded[i : i + 7, j : j + 7].mean() for j in range(dem.shape[1])] for i in range(dem.shape[0])])
    assert np.allclose(back(terrain.box_mean(frame(spark, dem=dem), F.col("dem")), "box_mean", dem.shape), want)


def test_levels_rise_with_rain(spark):
    cells = spark.createDataFrame([(1, 0, j, 50, 200) for j in range(10)], "area_id long, r int, c int, worldcover int, clay int")
    catch = cells.select("area_id", "r", "c", F.lit(1).alias("sink_id"))
    ponds = spark.createDataFrame([(1, 1, 500.0)], "area_id long, sink_id int, volume_m3 double")
    rain = spark.createDataFrame([(1, float(x)) for x in (0, 20, 60, 120)], "area_id long, rain_mm double")
    got = [r for r in alerts.fill_levels(alerts.histogram(cells, catch), ponds, rain).orderBy("rain_mm").collect()]
    assert got[0].level == "GREEN" and got[0].inflow_m3 == 0 and got[-1].level == "RED"
    assert all(a.fill_ratio <= b.fill_ratio for a, b in zip(got, got[1:]))


def test_empty_cells_have_no_sinks(spark):
    cells = spark.createDataFrame([], "area_id long, r int, c int, depth double, jrc int")
    areas = spark.createDataFrame([(1, 0.0, 1.0, 0.0, -1.0)], "area_id long, lon0 double, dlon double, lat0 double, dlat double")
    assert sinks.find_sinks(cells, areas).count() == 0
