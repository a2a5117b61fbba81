"""Quantiles, ranks, filters, distances and interpolation at sizes where one task would not do, against numpy."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwater.operators import alerts, exposure, grid, planning, quantiles, radar, ranks, terrain
from catchwater.plans import adapter
from catchwater.sources import tables
from test_operators import back, frame


def test_quantiles_by_narrowing_ranges(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 50)
    monkeypatch.setattr(quantiles, "RANGES", 64)
    rng = np.random.default_rng(1)
    groups = {1: rng.normal(size=400), 2: np.round(rng.random(300), 1), 3: np.array([1e300, -1e300, 5e-324, 0.0] * 20), 4: rng.random(9), 5: np.full(70, 2.5), 6: np.exp(rng.normal(size=101) * 2)}
    rows = [(k, float(v), float(-v) if i % 3 else None) for k, values in groups.items() for i, v in enumerate(values)] + [(1, float("nan"), None), (4, None, None)]
    df = spark.createDataFrame(rows, "area_id long, x double, y double")
    shares = [0.0, 0.02, 0.5, 0.98, 1.0]
    got = {r.area_id: r for r in quantiles.quantiles(df, ["area_id"], ["x", "y"], shares).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert np.allclose(got[k].x, np.quantile(values, shares))
        assert np.allclose(got[k].y, np.quantile([-v for i, v in enumerate(values) if i % 3], shares))
    assert np.allclose(quantiles.quantiles(df.where("area_id < 3"), [], ["x"], shares).first().x, np.quantile(np.concatenate([groups[1], groups[2]]), shares))
    grid = [r.t for r in radar.quantile_grid(df.where("area_id = 1"), "x").orderBy("k").collect()]
    assert np.allclose(grid, np.quantile(groups[1], np.linspace(0.5, 0.99, 25)))
    assert quantiles.quantiles(df.where("area_id > 9"), ["area_id"], ["x"], shares).count() == 0


@pytest.mark.parametrize("few", [10, 10**6])
def test_ranks_and_running_sums_over_many_tasks(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    rng = np.random.default_rng(2)
    rows = [(int(a), int(i), float(v)) for i, (a, v) in enumerate(zip(rng.choice([1, 1, 1, 1, 2, 3, 4], 3000), rng.integers(0, 50, 3000)))]
    df = spark.createDataFrame(rows, "area_id long, i int, v double").repartition(7)
    got = ranks.in_order(df, ["area_id"], [F.desc("v"), "i"], ("v",)).collect()
    assert len(got) == 3000 and got[0].asDict().keys() == {"area_id", "i", "v", "rank", "sum_v"}
    for area in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == area), key=lambda r: (-r[2], r[1]))
        own = sorted((r for r in got if r.area_id == area), key=lambda r: r["rank"])
        assert [r.i for r in own] == [r[1] for r in want] and [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert np.allclose([r.sum_v for r in own], np.cumsum([r[2] for r in want]))
    assert ranks.in_order(df.where("i < 0"), ["area_id"], ["i"], ("v",)).count() == 0


def test_nearest_column_in_linear_time():
    rng = np.random.default_rng(3)
    for _ in range(300):
        wide = int(rng.integers(1, 40))
        cols = np.sort(rng.choice(wide, int(rng.integers(1, wide + 1)), replace=False))
        up, tie = rng.integers(0, 9, len(cols)) ** 2, rng.permutation(len(cols))
        want = [min(range(len(cols)), key=lambda i: ((x - cols[i]) ** 2 + up[i], tie[i])) for x in range(wide)]
        assert terrain._nearest(cols, up, tie, wide).tolist() == want
    cols = np.arange(0, 10_000, 2)
    assert len(terrain._nearest(cols, rng.integers(0, 10**8, len(cols)), rng.permutation(len(cols)), 10_000)) == 10_000


def test_height_above_the_nearest_drain(spark):
    rng = np.random.default_rng(4)
    z, jrc = np.round(rng.random((14, 19)) * 9, 2), np.where(rng.random((14, 19)) < 0.04, 80.0, 0.0)
    drains = [tuple(x) for x in np.argwhere(jrc > 0)]
    want = np.array([[z[i, j] - z[min(drains, key=lambda d: ((d[0] - i) ** 2 + (d[1] - j) ** 2, d))] for j in range(19)] for i in range(14)])
    assert np.allclose(back(terrain.hand_lite(frame(spark, dem=z, jrc=jrc)), "hand", z.shape), want)


@pytest.mark.parametrize("tile", [3, 64])
def test_focal_filters_over_tiles(spark, tile):
    rng = np.random.default_rng(5)
    v = np.where(rng.random((17, 13)) < 0.2, np.nan, rng.integers(0, 9, (17, 13)))
    on = np.where(np.isnan(v), np.nan, v > 4)
    around = [(a, b) for a in range(-3, 4) for b in range(-3, 4)]

    def circle(x, i, j, reach):
        own = [x[i + a, j + b] for a, b in around if a * a + b * b <= reach**2 and 0 <= i + a < 17 and 0 <= j + b < 13]
        return [y for y in own if not np.isnan(y)]

    df = frame(spark, v=v, w=on).select("area_id", "r", "c", F.nanvl("v", F.lit(None)).alias("v"), F.nanvl("w", F.lit(None)).cast("int").alias("w"), F.lit("2024-05-01").cast("date").alias("event"))
    got = back(terrain.focal_median(df, "v", ["area_id", "event"], 100.0, 33.0, tile), "focal_median", v.shape)
    mode = back(terrain.focal_mode(df, "w", ["area_id"], tile=tile), "focal_mode", v.shape, int)
    for i in range(17):
        for j in range(13):
            if np.isnan(v[i, j]):
                assert np.isnan(got[i, j]) and mode[i, j] == -1
            else:
                assert got[i, j] == np.median(circle(v, i, j, 100 / 33)) and mode[i, j] == (np.mean(circle(on, i, j, 2)) > 0.5)


@pytest.mark.parametrize("block", [7, 100])
def test_interpolation_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(terrain, "STATIONS", block)
    rng = np.random.default_rng(6)
    stations = [(float(a), float(b), float(v)) for a, b, v in rng.random((40, 3))] + [(0.5, 0.5, 3.0)] * 3
    points = rng.random((50, 2))
    df = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(points)], "i int, lat double, lon double")
    known = spark.createDataFrame([*stations, (None, 0.1, 9.0), (0.1, 0.1, None)], "lat double, lon double, depth double")
    got = {r.i: r.depth for r in terrain.interpolate(df, known, "depth").collect()}
    for i, (a, o) in enumerate(points):
        w = np.array([1 / ((a - x) ** 2 + (o - y) ** 2 + 1e-12) for x, y, _ in stations])
        assert np.isclose(got[i], (w * [v for *_, v in stations]).sum() / w.sum())
    assert [r.depth for r in terrain.interpolate(df, known.where("lat > 9"), "depth").collect()] == [None] * 50


def greedy(h, given, k, margin, n):
    sites, left = list(given), sorted((-h[i, j], i, j) for i in range(n) for j in range(n) if h[i, j] > 0)
    while left and len(sites) < k:
        _, i, j = left[0]
        if margin <= i < n - margin and margin <= j < n - margin:
            sites.append((i, j))
        left = [x for x in left if not (-8 <= x[1] - i < 8 and -8 <= x[2] - j < 8)]
    return sites


@pytest.mark.parametrize("tile, k", [(9, 200), (16, 8)])
def test_candidate_sites_as_a_greedy_walk_finds_them(spark, tile, k):
    rng = np.random.default_rng(tile)
    for h in (rng.integers(0, 99, (60, 60)).astype(float), np.ones((60, 60))):
        none = spark.createDataFrame([(1, 4, 20, 30, 9.0), (1, 5, 60, 60, 4.0), (1, 6, 0, 0, 99.0)], "area_id long, sink_id int, r int, c int, volume_m3 double")
        got = planning.candidate_sites(none, frame(spark, h=h), 60, k, tile=tile).collect()
        assert [(r.r, r.c) for r in sorted(got, key=lambda r: r.site)] == greedy(h, [(10, 15), (30, 30)][:k], k, 5, 60)


def inside(ring, x, y):
    odd = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        if (b > y) != (d > y) and x < a + (y - b) * (c - a) / (d - b):
            odd = not odd
    return odd


def test_wards_by_cell_cover_as_by_ray_casting(spark):
    rng = np.random.default_rng(8)
    rings = {}
    for w, (n, size) in enumerate([(3, 0.05), (7, 0.004), (40, 0.08), (900, 0.1), (12, 0.2), (4, 0.03)]):
        turn, far = np.sort(rng.random(n)) * 2 * np.pi, size * (0.3 + rng.random(n))
        rings[f"w{w}"] = [(float(a), float(b)) for a, b in zip(np.round(0.1 + far * np.cos(turn), 3 if w > 3 else 9), np.round(0.1 + far * np.sin(turn), 3 if w > 3 else 9))]
    rings["square"] = [(0.0, 0.0), (0.2, 0.0), (0.2, 0.11), (0.05, 0.11), (0.05, 0.03), (0.0, 0.03)]
    points = [(i, float(y), float(x)) for i, (x, y) in enumerate(np.concatenate([rng.random((700, 2)) * 0.3 - 0.05, np.round(rng.random((300, 2)) * 0.2, 2)]))]
    df = spark.createDataFrame(points, "i int, lat double, lon double")
    wards = spark.createDataFrame([(w, [{"lon": x, "lat": y} for x, y in ring]) for w, ring in rings.items()], "ward string, ring array<struct<lon: double, lat: double>>")
    want = sorted((i, w) for i, y, x in points for w, ring in rings.items() if inside(ring, x, y))
    assert sorted((r.i, r.ward) for r in alerts.polygon_wards(df, wards).collect()) == want
    cover = alerts.cell_cover(wards.where("ward = 'w3'"))
    assert cover.agg(F.sum(F.coalesce(F.size("sides"), F.lit(0)))).first()[0] < 10 * 900  # not the whole ring in each cell
    assert cover.where("sides is null and ends is null and odd = 1").count() > 20


def test_a_site_strikes_out_only_cells_after_it_in_the_walk(spark):
    h = np.zeros((16, 16))
    for at in [(5, 7), (7, 2), (7, 15), (13, 5), (15, 13)]:
        h[at] = 0.7
    none = spark.createDataFrame([], "area_id long, sink_id int, r int, c int, volume_m3 double")
    for tile in (8, 16):
        got = planning.candidate_sites(none, frame(spark, h=h), 16, 4, 2, tile=tile).collect()
        assert [(r.r, r.c) for r in sorted(got, key=lambda r: r.site)] == greedy(h, [], 4, 2, 16) == [(5, 7), (13, 5)]


def test_sinks_meet_the_parts_of_their_class_together(spark, tmp_path):
    spark.range(3000).selectExpr("id AS p_partkey", "CAST(id * 13 % 51 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(120).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    for t in adapter.TABLES:
        if t not in ("part", "supplier"):
            spark.range(0).write.parquet(f"{tmp_path}/{t}.parquet")
    got = adapter.views(spark, str(tmp_path), "sinks")[0]
    rows = duckdb.sql(adapter.VIEWS["sinks"].replace("FROM part JOIN supplier", f"FROM '{tmp_path}/part.parquet/*.parquet' JOIN '{tmp_path}/supplier.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows) and len(rows) == 120
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        plan = adapter.views(spark, str(tmp_path), "sinks")[0]._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Aggregate" not in plan.split("Join")[0] and plan.count("Aggregate") >= 2  # nothing is left to group after the join


def test_an_area_has_one_folder_and_few_areas_share_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FILE_ROWS", 10)
    df = spark.range(64).selectExpr("CASE WHEN id < 40 THEN 0 ELSE id END AS area_id", "id AS x").coalesce(1)
    tables.write_table(df, f"{tmp_path}/t", "csv")
    files = [p.relative_to(tmp_path / "t") for p in (tmp_path / "t").rglob("*.csv")]
    assert len({f.parts[0] for f in files}) == 25 and len({f.name[:10] for f in files}) > 1  # part-00000, part-00001, ...
    assert sorted(r.x for r in tables.read_table(spark, f"{tmp_path}/t", "x long, area_id long").collect()) == list(range(64))


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_padding_joins_before_it_spreads_cells(spark):
    rows = [(a, i, j, float(100 * a + 10 * i + j)) for a, n, m in ((1, 3, 4), (2, 7, 2)) for i in range(n) for j in range(m)]
    out = grid.align_padded(spark.createDataFrame(rows, "area_id long, r int, c int, dem double"), "dem", 5, 6)
    got = {(r.area_id, r.r, r.c): r.dem for r in out.collect()}
    assert got == {(a, i, j): 100.0 * a + 10 * min(i, n - 1) + min(j, m - 1) for a, n, m in ((1, 3, 4), (2, 7, 2)) for i in range(5) for j in range(6)}
    assert "Generate" in physical(out).split("Join")[0]  # a padded grid, whose size Spark underrates, is never a side of a join


def test_points_are_not_dealt_to_tasks_to_meet_their_areas(spark):
    areas = spark.createDataFrame([(1, 0.0, 1.0, 8.0, -1.0)], "area_id long, lon0 double, dlon double, lat0 double, dlat double")
    points = spark.createDataFrame([(1, i, 8.0 - i % 5 - 0.5, i % 3 + 0.5) for i in range(60)], "area_id long, feature_id int, lat double, lon double")
    depths = spark.createDataFrame([(1, 0, 0, 1.0)], "area_id long, r int, c int, h double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Exchange hashpartitioning" not in physical(grid.to_domain(points, areas, 2))
        plan = physical(exposure.building_exposure(points, areas, depths, 2))
        assert plan.split("SortMergeJoin")[1].index("HashAggregate") < plan.split("SortMergeJoin")[1].index("BroadcastHashJoin")  # counted by cell first
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = exposure.building_exposure(points, areas, depths, 2).first()
    assert (got.in_domain, got.at_risk) == (48, 16)


def test_equal_points_keep_one_ward_each(spark):
    rings = [(f"w{k}", [{"lon": k + x, "lat": y} for x, y in ((0.0, 0.0), (0.02, 0.0), (0.02, 0.02), (0.0, 0.02))]) for k in range(5)]
    wards = spark.createDataFrame(rings, "ward string, ring array<struct<lon: double, lat: double>>")
    points = spark.createDataFrame([(1, 0.011, 2.013)] * 2 + [(2, 0.5, 0.5), (3, None, None)], "i int, lat double, lon double")
    got = [(r.i, r.ward) for r in alerts.assign_wards(points, wards, (0.0, 0.0, 9.0, 9.0)).collect()]
    assert sorted(got, key=str) == [(1, "w2"), (1, "w2"), (2, None), (3, None)]
