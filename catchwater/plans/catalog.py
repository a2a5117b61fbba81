"""All queries by name, with the SQL that gives the same rows. Names begin with the operator's number in the survey."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from catchwater.checkpoints import cut, scratch
from catchwater.functions import columns as C
from catchwater.operators import alerts, exposure, grid, hydrology, planning, radar, rain, sinks, terrain
from catchwater.plans import adapter
from catchwater.sources import tables
from catchwater.streaming import live

QUERIES = {}
ORACLE = {}
KEY = ["area_id", "r", "c"]
BOX = (85.0, 25.55, 86.0, 25.7)


def query(name: str, sql: str | None = None):
    """Registers a function of (views, spark, sf_dir); doubles in its result are rounded to 6 places."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(lambda *names: adapter.views(spark, sf_dir, *names), spark, sf_dir)
            return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE[name] = adapter.oracle(sql)
        return fn

    return add


def _curve_number(clay: str, cover: str) -> str:
    from catchwater.params import CURVE_NUMBERS

    pick = lambda k: f"CASE {cover} " + " ".join(f"WHEN {w} THEN {v[k]}" for w, v in CURVE_NUMBERS.items()) + " ELSE 80 END"
    return f"CASE WHEN {clay} / 10.0e0 < 10 THEN {pick(0)} WHEN {clay} / 10.0e0 > 40 THEN {pick(3)} WHEN {clay} / 10.0e0 > 25 THEN {pick(2)} ELSE {pick(1)} END"


def _case(column: str, table: dict, default: float) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {v!r}e0" for k, v in table.items()) + f" ELSE {default!r}e0 END"


def _runoff(rain_mm: str, cn: str) -> str:
    s = f"(25400.0e0 / {cn} - 254.0e0)"
    return f"CASE WHEN {rain_mm} - 0.2e0 * {s} > 0 THEN ({rain_mm} - 0.2e0 * {s}) * ({rain_mm} - 0.2e0 * {s}) / ({rain_mm} + 0.8e0 * {s}) ELSE 0 END"


from catchwater import params as P  # noqa: E402

CN = _curve_number("clay", "worldcover")
INFIL = f"{_case('worldcover', P.INFILTRATION, 5.0)} * least(greatest(1.2e0 - 0.02e0 * (clay / 10.0e0), 0.3e0), 1.5e0) / 1000.0e0 / 3600.0e0"
#: How cells of the 8 x 8 domain are made from the 16 x 16 grid.
DOMAIN = f"""domain AS (
    SELECT area_id, r, c, z, mann, infil, CASE WHEN wc = 50 THEN 1 ELSE 0 END AS built, wc FROM (
        SELECT area_id, r, c, z, wc, {_case('wc', P.MANNING, 0.035)} AS mann, {INFIL.replace('worldcover', 'wc')} AS infil FROM (
            SELECT area_id, CAST(floor(r / 2) AS INT) AS r, CAST(floor(c / 2) AS INT) AS c, avg(dem) AS z, avg(clay) AS clay, max(CASE WHEN r % 2 = 0 AND c % 2 = 0 THEN worldcover END) AS wc FROM cells GROUP BY 1, 2, 3)))"""
HIST = f"hist AS (SELECT area_id, sink_id, {CN} AS cn, count(*) AS n FROM cells JOIN catch USING (area_id, r, c) WHERE sink_id IS NOT NULL GROUP BY 1, 2, 3)"
LEVELS = f"""levels AS (
    SELECT area_id, sink_id, rain_mm, CAST(round_even(inflow, 0) AS BIGINT) AS inflow_m3, volume_m3 AS capacity_m3, round_even(inflow / greatest(volume_m3, 1), 2) AS fill_ratio,
           CASE WHEN inflow / greatest(volume_m3, 1) >= 1 THEN 'RED' WHEN inflow / greatest(volume_m3, 1) >= 0.5 THEN 'AMBER' ELSE 'GREEN' END AS level
    FROM (SELECT area_id, sink_id, rain_mm, sum(({_runoff('rain_mm', 'cn')}) * n / 1000.0e0 * 900.0e0) AS inflow FROM hist CROSS JOIN amounts GROUP BY 1, 2, 3) JOIN sinks USING (area_id, sink_id))"""
ALERTS = f"{HIST}, amounts AS (SELECT unnest([20.0e0, 60.0e0, 100.0e0]) AS rain_mm), {LEVELS}"
ONE = f"{HIST}, amounts AS (SELECT 100.0e0 AS rain_mm), {LEVELS}"
DAILY = "daily AS (SELECT area_id, day, sum(coalesce(mm, 0)) AS mm FROM rain GROUP BY 1, 2)"
BUILT = "built AS (SELECT area_id, r, c, CASE WHEN worldcover IN (40, 50, 60) THEN 1 ELSE 0 END AS built, dem AS z FROM cells)"


def amounts(spark, areas: DataFrame, *mm: float) -> DataFrame:
    return areas.select("area_id", F.explode(F.array(*map(F.lit, mm))).alias("rain_mm"))


def levels(v, spark, *mm: float) -> DataFrame:
    cells, catch, ponds, areas = v("cells", "catch", "sinks", "areas")
    return alerts.fill_levels(alerts.histogram(cells, catch), ponds, amounts(spark, areas, *mm))


def built(v) -> DataFrame:
    return v("cells")[0].select(*KEY, F.col("worldcover").isin(40, 50, 60).cast("int").alias("built"), F.col("dem").alias("z"))


# --- sources and sinks ----------------------------------------------------------------------------------------------


@query("s1_read_table", "SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1")
def _(v, spark, d):
    return tables.read_table(spark, f"{d}/supplier.parquet", None).groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("s2_write_table", "SELECT area_id, sink_id, volume_m3 FROM sinks")
def _(v, spark, d):
    path = scratch(spark)
    tables.write_table(v("sinks")[0].select("area_id", "sink_id", "volume_m3"), path, "csv")
    return tables.read_table(spark, path, "sink_id bigint, volume_m3 double, area_id bigint")


@query("s3_s4_tiles", "SELECT area_id, 'dem' AS layer, r, c, dem AS value FROM cells")
def _(v, spark, d):
    return tables.tiles_to_cells(tables.cells_to_tiles(v("cells")[0], "dem", 7))


@query("s4_cells_to_tiles", "SELECT area_id, 'jrc' AS layer, CAST(r // 8 AS INT) AS tile_r, CAST(c // 8 AS INT) AS tile_c, min(r) AS row0, min(c) AS col0, max(r) - min(r) + 1 AS nrows, max(c) - min(c) + 1 AS ncols, string_agg(CAST(jrc AS VARCHAR), ' ' ORDER BY r, c) AS data FROM cells GROUP BY ALL")
def _(v, spark, d):
    return tables.cells_to_tiles(v("cells")[0], "jrc", 8, "int").withColumn("data", F.concat_ws(" ", F.col("values").cast("array<string>"))).drop("values")


@query("s5_geojson", "SELECT area_id, sink_id, round(lon0 + dlon * (c + 0.5e0), 6) AS lon, round(lat0 + dlat * (r + 0.5e0), 6) AS lat, r, c, volume_m3, 'FeatureCollection' AS type, 'Feature' AS kind, 'Point' AS shape FROM sinks JOIN areas USING (area_id)")
def _(v, spark, d):
    ponds, areas = v("sinks", "areas")
    made = tables.to_geojson(grid.to_lonlat(ponds.select("area_id", "sink_id", "r", "c", "volume_m3"), areas))
    schema = "type string, features array<struct<type: string, geometry: struct<type: string, coordinates: array<double>>, properties: struct<sink_id: bigint, r: int, c: int, volume_m3: double>>>"
    rows = made.select("area_id", F.from_json("geojson", schema).alias("g")).select("area_id", "g.type", F.explode("g.features").alias("f"))
    return rows.select("area_id", "f.properties.*", F.element_at("f.geometry.coordinates", 1).alias("lon"), F.element_at("f.geometry.coordinates", 2).alias("lat"), "type", F.col("f.type").alias("kind"), F.col("f.geometry.type").alias("shape"))


@query("s6_facts", f"WITH {ONE}, a AS (SELECT area_id, count(*) AS n FROM levels GROUP BY 1), b AS (SELECT area_id, round(max(h), 6) AS peak FROM runs GROUP BY 1) SELECT coalesce(a.area_id, b.area_id) AS area_id, n, peak FROM a FULL JOIN b ON a.area_id = b.area_id")
def _(v, spark, d):
    made = tables.facts("area_id", alerts=levels(v, spark, 100.0).groupBy("area_id").agg(F.count("*").alias("n")), floods=v("runs")[0].groupBy("area_id").agg(F.max("h").alias("peak")))
    path = f"{scratch(spark)}/2024-06-01"
    tables.write_reports(made, path)
    return tables.read_reports(spark, path, made.schema).select("area_id", "alerts.n", "floods.peak")


@query("s6_collated_reports", "SELECT area_id, CAST(strftime(DATE '2024-06-01' + CAST(scenario_id AS INT), '%Y-%m-%d') AS VARCHAR) AS report_date, max(h) AS peak FROM runs GROUP BY 1, scenario_id")
def _(v, spark, d):
    top = scratch(spark)
    peaks = v("runs")[0].groupBy("area_id", "scenario_id").agg(F.max("h").alias("peak"))
    for k in range(1, 8):  # a folder a date
        tables.write_reports(peaks.where(F.col("scenario_id") == k).select("area_id", "peak"), f"{top}/2024-06-{k + 1:02}")
    read = tables.read_reports(spark, f"{top}/*", "area_id long, peak double")
    return tables.collate(read).select("area_id", F.explode("scores").alias("report_date", "x")).select("area_id", "report_date", "x.peak")


@query("s7_rain_payload", "SELECT point_id, CAST(row_number() OVER (PARTITION BY point_id ORDER BY ts, event_id) - 1 AS INT) AS k, date_trunc('second', ts) AS ts, coalesce(mm, 0) AS mm FROM rain")
def _(v, spark, d):
    return tables.parse_rain(tables.rain_payloads(v("rain")[0]))


# --- alignment, projection, lookup ----------------------------------------------------------------------------------


@query("p1_align_common", "SELECT area_id, r, c, dem, wet FROM cells JOIN (SELECT area_id, r, c, max(wet) AS wet FROM truth GROUP BY 1, 2, 3) USING (area_id, r, c)")
def _(v, spark, d):
    cells, truth = v("cells", "truth")
    return grid.align_common(cells.select(*KEY, "dem"), truth.groupBy(*KEY).agg(F.max("wet").alias("wet")))


@query("p2_align_padded", "SELECT s.area_id, CAST(a.k AS INT) AS r, CAST(b.k AS INT) AS c, s.dem FROM range(18) a(k) CROSS JOIN range(20) b(k) JOIN cells s ON s.r = least(a.k, 15) AND s.c = least(b.k, 15)")
def _(v, spark, d):
    return grid.align_padded(v("cells")[0], "dem", 18, 20)


@query("p3_pixel_to_lonlat", "SELECT area_id, r, c, round(lon0 + dlon * (c + 0.5e0), 6) AS lon, round(lat0 + dlat * (r + 0.5e0), 6) AS lat, round(lon0 + dlon * c, 6) AS lon_corner, round(lat0 + dlat * r, 6) AS lat_corner FROM cells JOIN areas USING (area_id)")
def _(v, spark, d):
    cells, areas = v("cells", "areas")
    corner = grid.to_lonlat(cells.select(*KEY), areas, False).withColumnsRenamed({"lon": "lon_corner", "lat": "lat_corner"})
    return grid.to_lonlat(corner, areas)


POINT = "CASE WHEN floor((floor((lat - lat0) / dlat)) / 2) BETWEEN 0 AND 7 AND floor((floor((lon - lon0) / dlon)) / 2) BETWEEN 0 AND 7 THEN {} END"
DR, DC = POINT.format("CAST(floor(floor((lat - lat0) / dlat) / 2) AS INT)"), POINT.format("CAST(floor(floor((lon - lon0) / dlon) / 2) AS INT)")


@query("p4_lonlat_to_cell", f"SELECT feature_id, area_id, {DR} AS dr, {DC} AS dc FROM buildings JOIN areas USING (area_id)")
def _(v, spark, d):
    buildings, areas = v("buildings", "areas")
    return grid.to_domain(buildings, areas, 8).select("feature_id", "area_id", "dr", "dc")


@query("p5_domain_crop", "SELECT area_id, r - row0 AS r, c - col0 AS c, dem FROM cells JOIN (SELECT area_id, greatest(0, least(CAST(trunc((25.655e0 - lat0) / dlat) AS INT) - 4, nrows - 8)) AS row0, greatest(0, least(CAST(trunc((85.002e0 - lon0) / dlon) AS INT) - 4, ncols - 8)) AS col0 FROM areas) USING (area_id) WHERE r >= row0 AND r < row0 + 8 AND c >= col0 AND c < col0 + 8")
def _(v, spark, d):
    cells, areas = v("cells", "areas")
    return grid.crop(cells, areas, 4, F.lit(25.655), F.lit(85.002)).select(*KEY, "dem")


@query("p6_pooling", "SELECT area_id, CAST(r // 2 AS INT) AS r, CAST(c // 2 AS INT) AS c, round(avg(dem), 6) AS dem, max(acc) AS acc, max(CASE WHEN r % 2 = 0 AND c % 2 = 0 THEN worldcover END) AS worldcover FROM cells GROUP BY 1, 2, 3")
def _(v, spark, d):
    return grid.pool(v("cells")[0], {"dem": "avg", "acc": "max", "worldcover": "nearest"})


@query("p7_class_lookup", f"SELECT area_id, r, c, {_case('worldcover', P.MANNING, 0.035)} AS mann, {_case('worldcover', P.INFILTRATION, 5.0)} AS f, {CN} AS cn FROM cells")
def _(v, spark, d):
    wc = F.col("worldcover")
    return v("cells")[0].select(*KEY, C.lookup(wc, P.MANNING, 0.035).alias("mann"), C.lookup(wc, P.INFILTRATION, 5.0).alias("f"), C.curve_number(wc, C.soil_group(F.col("clay"))).alias("cn"))


@query("p8_soil_group", "SELECT area_id, r, c, CASE WHEN clay / 10.0e0 < 10 THEN 0 WHEN clay / 10.0e0 > 40 THEN 3 WHEN clay / 10.0e0 > 25 THEN 2 ELSE 1 END AS soil FROM cells")
def _(v, spark, d):
    return v("cells")[0].select(*KEY, C.soil_group(F.col("clay")).alias("soil"))


@query("p9_infiltration", f"SELECT area_id, r, c, round(({INFIL}) * 1e6, 6) AS infil_um_s FROM cells")
def _(v, spark, d):
    return v("cells")[0].select(*KEY, (C.infiltration(F.col("worldcover"), F.col("clay")) * 1e6).alias("infil_um_s"))


@query("p10_ksat", "SELECT area_id, r, c, round(pow(10.0e0, -0.6e0 + 0.0126e0 * (sand / 10.0e0) - 0.0064e0 * (clay / 10.0e0)) * 25.4e0, 6) AS ksat FROM cells")
def _(v, spark, d):
    return v("cells")[0].select(*KEY, C.ksat_mm_hr(F.col("sand"), F.col("clay")).alias("ksat"))


@query("p11_class_multipliers", f"WITH {DOMAIN} SELECT area_id, r, c, round(mann * exp(CASE WHEN wc = 50 THEN 0.2e0 WHEN wc = 40 THEN -0.1e0 ELSE 0 END), 6) AS mann, round(infil * exp(CASE WHEN wc = 50 THEN -0.3e0 WHEN wc = 40 THEN 0.15e0 ELSE 0 END) * 1e6, 6) AS infil FROM domain")
def _(v, spark, d):
    logs = spark.createDataFrame([(50, 0.2, -0.3), (40, -0.1, 0.15)], "wc int, log_n double, log_f double")
    return grid.class_multipliers(grid.domain_table(v("cells")[0]), logs).withColumn("infil", F.col("infil") * 1e6)


@query("p12_urban_cost", "SELECT area_id, r, c, CASE WHEN worldcover = 50 THEN 30.0e0 WHEN acc % 3 = 0 THEN 0.5e0 ELSE 1.0e0 END AS mult FROM cells")
def _(v, spark, d):
    return v("cells")[0].select(*KEY, C.urban_multiplier(F.col("worldcover") == 50, F.col("acc") % 3 == 0).alias("mult"))


@query("p13_feature_channels", f"WITH {DOMAIN}, s AS (SELECT area_id, avg(z) AS m, stddev_samp(z) AS sd FROM domain GROUP BY 1) SELECT area_id, r, c, round((z - built * 1.5e0 - m) / sd, 6) AS z_n, 1.0e0 AS rain_n, round(built * 1.5e0 / 3.0e0, 6) AS dig_n FROM domain JOIN s USING (area_id)")
def _(v, spark, d):
    return grid.feature_channels(grid.domain_table(v("cells")[0]), 100.0, F.col("built") * 1.5)


@query("p14_domain_table", f"WITH {DOMAIN} SELECT area_id, r, c, round(z, 6) AS z, mann, round(infil * 1e6, 6) AS infil, built, wc FROM domain")
def _(v, spark, d):
    return grid.domain_table(v("cells")[0]).withColumn("infil", F.col("infil") * 1e6)


# --- terrain --------------------------------------------------------------------------------------------------------

GRAD = """g AS (SELECT *, CASE WHEN r = 0 THEN lead(dem) OVER y - dem WHEN r = 15 THEN dem - lag(dem) OVER y ELSE (lead(dem) OVER y - lag(dem) OVER y) / 2.0e0 END AS gy,
    CASE WHEN c = 0 THEN lead(dem) OVER x - dem WHEN c = 15 THEN dem - lag(dem) OVER x ELSE (lead(dem) OVER x - lag(dem) OVER x) / 2.0e0 END AS gx
    FROM cells WINDOW y AS (PARTITION BY area_id, c ORDER BY r), x AS (PARTITION BY area_id, r ORDER BY c))"""
HYP = "sqrt(gx * gx + gy * gy)"


@query("t1_gradient", f"WITH {GRAD} SELECT area_id, r, c, round(gy, 6) AS gy, round(gx, 6) AS gx FROM g")
def _(v, spark, d):
    return terrain.gradient(v("cells")[0], "dem").select(*KEY, "gy", "gx")


@query("t2_twi", f"WITH {GRAD} SELECT area_id, r, c, round(ln((acc * 900.0e0 + 1) / ({HYP} + 1e-3)), 6) AS twi FROM g")
def _(v, spark, d):
    return terrain.wetness(v("cells")[0]).select(*KEY, "twi")


@query("t3_hillshade", f"WITH {GRAD} SELECT area_id, r, c, round((sin(radians(45)) * sin(pi() / 2 - atan({HYP})) + cos(radians(45)) * cos(pi() / 2 - atan({HYP})) * cos(radians(360.0e0 - 315 + 90) - atan2(-gx, gy)) + 1) / 2, 5) AS shade FROM g")
def _(v, spark, d):
    return terrain.hillshade(v("cells")[0]).select(*KEY, F.round("shade", 5).alias("shade"))


@query("t4_hand_lite", "WITH drains AS (SELECT area_id, r, c, dem FROM cells WHERE jrc >= 50), n AS (SELECT a.area_id, a.r, a.c, a.dem - d.dem AS hand, row_number() OVER (PARTITION BY a.area_id, a.r, a.c ORDER BY (a.r - d.r) ** 2 + (a.c - d.c) ** 2, d.r, d.c) AS k FROM cells a JOIN drains d USING (area_id)) SELECT area_id, r, c, round(coalesce(hand, 0), 6) AS hand FROM cells LEFT JOIN (SELECT * FROM n WHERE k = 1) USING (area_id, r, c)")
def _(v, spark, d):
    return terrain.hand_lite(v("cells")[0])


MIRROR = "CASE WHEN {0} + {1} < 0 THEN -1 - ({0} + {1}) WHEN {0} + {1} > 15 THEN 31 - ({0} + {1}) ELSE {0} + {1} END"
BOX7 = f"box AS (SELECT a.area_id, a.r, a.c, avg(CASE WHEN b.worldcover IN (50, 80) THEN 0.0e0 ELSE 1.0e0 END) AS box_mean FROM cells a CROSS JOIN range(-3, 4) y(i) CROSS JOIN range(-3, 4) x(j) JOIN cells b ON b.area_id = a.area_id AND b.r = {MIRROR.format('a.r', 'y.i')} AND b.c = {MIRROR.format('a.c', 'x.j')} GROUP BY 1, 2, 3)"


@query("t5_box_mean", f"WITH {BOX7} SELECT area_id, r, c, round(box_mean, 6) AS box_mean FROM box")
def _(v, spark, d):
    return terrain.box_mean(v("cells")[0], (~F.col("worldcover").isin(50, 80)).cast("int"))


@query("t6_site_mean", "SELECT s.area_id, sink_id, round(avg(dem), 6) AS site_mean FROM sinks s JOIN cells a ON a.area_id = s.area_id AND abs(a.r - s.r) <= 3 AND abs(a.c - s.c) <= 3 GROUP BY 1, 2")
def _(v, spark, d):
    cells, ponds = v("cells", "sinks")
    return terrain.site_mean(cells, ponds, "dem")


@query("t7_focal_median", "SELECT a.area_id, a.r, a.c, round(median(b.dem), 6) AS focal_median FROM cells a JOIN cells b ON a.area_id = b.area_id AND (a.r - b.r) ** 2 + (a.c - b.c) ** 2 <= 2 GROUP BY 1, 2, 3")
def _(v, spark, d):
    return terrain.focal_median(v("cells")[0], "dem", ["area_id"])


@query("t8_focal_mode", "WITH w AS (SELECT area_id, r, c, CASE WHEN depth > 0.15e0 THEN 1 ELSE 0 END AS wet FROM cells) SELECT a.area_id, a.r, a.c, CASE WHEN avg(b.wet) > 0.5 THEN 1 ELSE 0 END AS focal_mode FROM w a JOIN w b ON a.area_id = b.area_id AND (a.r - b.r) ** 2 + (a.c - b.c) ** 2 <= 4 GROUP BY 1, 2, 3")
def _(v, spark, d):
    return terrain.focal_mode(v("cells")[0].withColumn("wet", (F.col("depth") > 0.15).cast("int")), "wet", ["area_id"])


@query("t9_rescale", "WITH p AS (SELECT area_id, quantile_cont(dem, 0.02) AS lo, quantile_cont(dem, 0.98) AS hi FROM cells GROUP BY 1) SELECT area_id, r, c, round(least(greatest((dem - lo) / greatest(hi - lo, 1e-9), 0), 1), 6) AS dem_n FROM cells JOIN p USING (area_id)")
def _(v, spark, d):
    return terrain.rescale(v("cells")[0].select(*KEY, "dem"), "dem").drop("dem")


IDW = "idw AS (SELECT area_id, r, c, sum(depth_to_water_m * w) / sum(w) AS gw FROM (SELECT a.area_id, r, c, depth_to_water_m, 1 / ((lat - (lat0 + dlat * (r + 0.5e0))) ** 2 + (lon - (lon0 + dlon * (c + 0.5e0))) ** 2 + 1e-12) AS w FROM cells a JOIN areas USING (area_id) CROSS JOIN stations) GROUP BY 1, 2, 3)"


@query("t10_idw", f"WITH {IDW} SELECT area_id, r, c, round(gw, 6) AS gw FROM idw")
def _(v, spark, d):
    cells, areas, stations = v("cells", "areas", "stations")
    return terrain.interpolate(grid.to_lonlat(cells.select(*KEY), areas), stations, "depth_to_water_m").select(*KEY, F.col("depth_to_water_m").alias("gw"))


NORM = "least(greatest(({0} - quantile_cont({0}, 0.02) OVER w) / greatest(quantile_cont({0}, 0.98) OVER w - quantile_cont({0}, 0.02) OVER w, 1e-9), 0), 1)"
RSI = f"""{IDW}, {BOX7}, l AS (SELECT area_id, r, c, worldcover, box_mean, gw, pow(10.0e0, -0.6e0 + 0.0126e0 * (sand / 10.0e0) - 0.0064e0 * (clay / 10.0e0)) * 25.4e0 AS ksat, ln(1 + acc) AS flow FROM cells JOIN idw USING (area_id, r, c) JOIN box USING (area_id, r, c)),
    rsi AS (SELECT area_id, r, c, gw, ksat, CASE WHEN worldcover = 80 THEN 0 ELSE 0.35e0 * {NORM.format('gw')} + 0.30e0 * {NORM.format('ksat')} + 0.20e0 * box_mean + 0.15e0 * {NORM.format('flow')} END AS rsi FROM l WINDOW w AS (PARTITION BY area_id))"""


@query("t11_recharge_index", f"WITH {RSI} SELECT area_id, r, c, round(rsi, 6) AS rsi FROM rsi")
def _(v, spark, d):
    return terrain.recharge_index(*v("cells", "areas", "stations"))


@query("t12_fill_depressions", "WITH RECURSIVE f AS (SELECT area_id, r, c, dem AS lev FROM cells WHERE r IN (0, 15) OR c IN (0, 15) UNION SELECT n.area_id, n.r, n.c, greatest(n.dem, f.lev) FROM f JOIN cells n ON n.area_id = f.area_id AND abs(n.r - f.r) <= 1 AND abs(n.c - f.c) <= 1), low AS (SELECT area_id, r, c, min(lev) AS filled FROM f GROUP BY 1, 2, 3) SELECT area_id, r, c, dem, filled, round(filled - dem, 6) AS fill_depth FROM low JOIN (SELECT area_id, r, c, dem FROM cells) USING (area_id, r, c)")
def _(v, spark, d):
    return hydrology.fill(v("cells")[0])


AROUND = "abs(n.r - f.r) <= 1 AND abs(n.c - f.c) <= 1"
FILLED = f"f AS (SELECT area_id, r, c, dem AS lev FROM cells WHERE r IN (0, 15) OR c IN (0, 15) UNION SELECT n.area_id, n.r, n.c, greatest(n.dem, f.lev) FROM f JOIN cells n ON n.area_id = f.area_id AND {AROUND}), filled AS (SELECT area_id, r, c, min(lev) AS z FROM f GROUP BY 1, 2, 3)"
SIDES = "sides(k, a, b) AS (VALUES (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, -1), (4, 0, 1), (5, 1, -1), (6, 1, 0), (7, 1, 1))"
DIRECTION = f"""{FILLED}, {SIDES}, beside AS (SELECT n.area_id, n.r, n.c, n.z, k, a, b, m.z AS z2, m.r AS r2, m.c AS c2 FROM filled n CROSS JOIN sides JOIN filled m ON m.area_id = n.area_id AND m.r = n.r + a AND m.c = n.c + b),
    steps(area_id, r, c, n) USING KEY (area_id, r, c) AS (
        SELECT DISTINCT area_id, r, c, 0 FROM beside WHERE z2 < z OR r IN (0, 15) OR c IN (0, 15)
        UNION SELECT x.area_id, x.r, x.c, min(steps.n + 1) FROM steps JOIN beside x ON x.area_id = steps.area_id AND x.r2 = steps.r AND x.c2 = steps.c AND x.z = x.z2 LEFT JOIN recurring.steps o ON o.area_id = x.area_id AND o.r = x.r AND o.c = x.c WHERE o.n IS NULL OR steps.n + 1 < o.n GROUP BY 1, 2, 3),
    ways AS (SELECT x.*, CASE WHEN z2 < z THEN -(z - z2) / CASE WHEN a <> 0 AND b <> 0 THEN sqrt(2.0e0) ELSE 1 END WHEN z2 = z AND t.n < o.n THEN 1e9 + t.n END AS s FROM beside x JOIN steps o USING (area_id, r, c) JOIN steps t ON t.area_id = x.area_id AND t.r = r2 AND t.c = c2),
    flow AS (SELECT area_id, r, c, CASE WHEN r NOT IN (0, 15) AND c NOT IN (0, 15) THEN r + w.a END AS tr, CASE WHEN r NOT IN (0, 15) AND c NOT IN (0, 15) THEN c + w.b END AS tc FROM filled LEFT JOIN (SELECT area_id, r, c, arg_min({{'a': a, 'b': b}}, (s, k)) AS w FROM ways WHERE s IS NOT NULL GROUP BY 1, 2, 3) USING (area_id, r, c))"""


def directions(cells: DataFrame) -> DataFrame:
    return hydrology.flow_direction(hydrology.fill(cells).select(*KEY, "filled"))


@query("t13_flow_direction", f"WITH RECURSIVE {DIRECTION} SELECT area_id, r, c, CAST(tr AS INT) AS tr, CAST(tc AS INT) AS tc FROM flow")
def _(v, spark, d):
    return directions(v("cells")[0])


FLOW = "flow AS (SELECT area_id, r, c, CASE WHEN (r + c) % 13 = 0 OR (r = 15 AND c = 15) THEN NULL WHEN r < 15 AND (acc % 2 = 0 OR c = 15) THEN r + 1 ELSE r END AS tr, CASE WHEN (r + c) % 13 = 0 OR (r = 15 AND c = 15) THEN NULL WHEN r < 15 AND (acc % 2 = 0 OR c = 15) THEN c ELSE c + 1 END AS tc FROM cells)"


def receivers(cells: DataFrame) -> DataFrame:
    """Given directions: down or right, with outlets here and there."""
    stop = ((F.col("r") + F.col("c")) % 13 == 0) | ((F.col("r") == 15) & (F.col("c") == 15))
    down = (F.col("r") < 15) & ((F.col("acc") % 2 == 0) | (F.col("c") == 15))
    return cells.select(*KEY, F.when(~stop, F.when(down, F.col("r") + 1).otherwise(F.col("r"))).alias("tr"), F.when(~stop, F.when(down, F.col("c")).otherwise(F.col("c") + 1)).alias("tc"))


WAYS = f"{FLOW}, way AS (SELECT area_id, r AS r0, c AS c0, r, c, tr, tc FROM flow UNION ALL SELECT w.area_id, w.r0, w.c0, f.r, f.c, f.tr, f.tc FROM way w JOIN flow f ON f.area_id = w.area_id AND f.r = w.tr AND f.c = w.tc)"


@query("t14_flow_accumulation", f"WITH RECURSIVE {WAYS} SELECT area_id, r, c, count(*) AS acc FROM way GROUP BY 1, 2, 3")
def _(v, spark, d):
    return hydrology.accumulation(receivers(v("cells")[0]))


RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY volume_m3 DESC, sink_id) AS k FROM sinks)"


@query("t15_catchments", f"WITH RECURSIVE {WAYS}, {RANKED}, hit AS (SELECT w.area_id, w.r0 AS r, w.c0 AS c, min(k) AS k FROM way w JOIN ranked s ON s.area_id = w.area_id AND s.r = w.r AND s.c = w.c GROUP BY 1, 2, 3) SELECT f.area_id, f.r, f.c, s.sink_id FROM flow f LEFT JOIN hit h ON h.area_id = f.area_id AND h.r = f.r AND h.c = f.c LEFT JOIN ranked s ON s.area_id = h.area_id AND s.k = h.k")
def _(v, spark, d):
    cells, ponds = v("cells", "sinks")
    return hydrology.catchments(receivers(cells), ponds)


@query("t15_catchment_areas", f"WITH RECURSIVE {WAYS}, a AS (SELECT area_id, r, c, count(*) AS n FROM way GROUP BY 1, 2, 3) SELECT area_id, sink_id, coalesce(n, 0) * 900.0e0 AS catchment_m2 FROM sinks LEFT JOIN a USING (area_id, r, c)")
def _(v, spark, d):
    cells, ponds = v("cells", "sinks")
    return hydrology.catchment_areas(receivers(cells), ponds)


DOWN = f"{DIRECTION}, way AS (SELECT area_id, r AS r0, c AS c0, r, c, tr, tc FROM flow UNION ALL SELECT w.area_id, w.r0, w.c0, f.r, f.c, f.tr, f.tc FROM way w JOIN flow f ON f.area_id = w.area_id AND f.r = w.tr AND f.c = w.tc)"


@query("t15_terrain_catchments", f"WITH RECURSIVE {DOWN}, {RANKED}, hit AS (SELECT w.area_id, w.r0 AS r, w.c0 AS c, min(k) AS k FROM way w JOIN ranked s ON s.area_id = w.area_id AND s.r = w.r AND s.c = w.c GROUP BY 1, 2, 3) SELECT f.area_id, f.r, f.c, s.sink_id FROM flow f LEFT JOIN hit h ON h.area_id = f.area_id AND h.r = f.r AND h.c = f.c LEFT JOIN ranked s ON s.area_id = h.area_id AND s.k = h.k")
def _(v, spark, d):
    cells, ponds = v("cells", "sinks")
    return hydrology.catchments(directions(cells), ponds)


@query("t14_terrain_accumulation", f"WITH RECURSIVE {DOWN} SELECT area_id, r, c, count(*) AS acc FROM way GROUP BY 1, 2, 3")
def _(v, spark, d):
    return hydrology.accumulation(directions(v("cells")[0]))


WET = "wet AS (SELECT area_id, r, c, depth, r * 16 + c AS id FROM cells WHERE depth > 0.15e0 AND jrc < 50)"
LABELS = f"""{WET}, reach AS (SELECT area_id, id, id AS seen FROM wet UNION SELECT p.area_id, p.id, n.id FROM reach p JOIN wet m ON m.area_id = p.area_id AND m.id = p.seen JOIN wet n ON n.area_id = p.area_id AND abs(n.r - m.r) + abs(n.c - m.c) = 1),
    low AS (SELECT area_id, id, min(seen) AS first FROM reach GROUP BY 1, 2), parts AS (SELECT area_id, r, c, depth, first, dense_rank() OVER (PARTITION BY area_id ORDER BY first) AS label, count(*) OVER (PARTITION BY area_id, first) AS n_cells FROM low JOIN wet USING (area_id, id))"""


@query("t16_components", f"WITH RECURSIVE {LABELS} SELECT area_id, r, c, CAST(label AS INT) AS label, n_cells FROM parts")
def _(v, spark, d):
    return hydrology.components(v("cells")[0].where("depth > 0.15 and jrc < 50"))


# --- sinks and basins -----------------------------------------------------------------------------------------------

FOUND = f"{LABELS}, found AS (SELECT area_id, label AS sink_id, count(*) AS n, sum(depth) AS total, max(depth) AS max_depth_m, arg_min(r * 16 + c, (-depth, r, c)) AS pos FROM parts WHERE n_cells >= 10 GROUP BY 1, 2), top AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY round(total, 6) DESC, sink_id) AS k FROM found)"


@query("a1_find_sinks", f"WITH RECURSIVE {FOUND} SELECT area_id, CAST(sink_id AS INT) AS sink_id, CAST(pos // 16 AS INT) AS r, CAST(pos % 16 AS INT) AS c, n * 900.0e0 AS area_m2, max_depth_m, round(total * 900, 3) AS volume_m3, round(lon0 + dlon * (pos % 16 + 0.5e0), 6) AS lon, round(lat0 + dlat * (pos // 16 + 0.5e0), 6) AS lat FROM top JOIN areas USING (area_id) WHERE k <= 25")
def _(v, spark, d):
    return sinks.find_sinks(*v("cells", "areas")).withColumn("volume_m3", F.round("volume_m3", 3))


@query("a1_terrain_to_catchments", f"WITH RECURSIVE {FOUND}, {DOWN}, size AS (SELECT area_id, r, c, count(*) AS n FROM way GROUP BY 1, 2, 3) SELECT area_id, CAST(sink_id AS INT) AS sink_id, round(total * 900, 3) AS volume_m3, size.n * 900.0e0 AS catchment_m2 FROM top JOIN size USING (area_id) WHERE k <= 25 AND size.r = pos // 16 AND size.c = pos % 16")
def _(v, spark, d):
    cells, areas = v("cells", "areas")
    found = sinks.find_sinks(cells, areas)
    sizes = hydrology.catchment_areas(directions(cells), found)
    return found.select("area_id", "sink_id", F.round("volume_m3", 3).alias("volume_m3")).join(sizes, ["area_id", "sink_id"])


@query("a2_basins", f"WITH RECURSIVE {LABELS}, b AS (SELECT area_id, label, sum(depth * (1 + acc % 5)) AS basin_volume, arg_min(r * 16 + c, (-depth, r, c)) AS pos FROM parts JOIN (SELECT area_id, r, c, acc FROM cells) USING (area_id, r, c) WHERE n_cells >= 4 GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY round(basin_volume, 6) DESC, label) AS rank FROM b) SELECT area_id, CAST(label AS INT) AS label, CAST(pos // 16 AS INT) AS r, CAST(pos % 16 AS INT) AS c, round(basin_volume, 6) AS basin_volume, CAST(rank AS INT) AS rank FROM t WHERE rank <= 6")
def _(v, spark, d):
    cells = v("cells")[0].withColumn("flood", F.when((F.col("depth") > 0.15) & (F.col("jrc") < 50), F.col("depth")).otherwise(0.0))
    return sinks.basins(cells, "flood", (1 + F.col("acc") % 5).cast("double"))


@query("a3_priority_weight", "SELECT area_id, CAST(r // 2 AS INT) AS r, CAST(c // 2 AS INT) AS c, round(1 + 2 * avg(CASE WHEN acc % 9 = 0 THEN 0 ELSE jrc / 100.0e0 END), 6) AS weight FROM cells GROUP BY 1, 2, 3")
def _(v, spark, d):
    cells = v("cells")[0].withColumn("f", F.when(F.col("acc") % 9 == 0, float("nan")).otherwise(F.col("jrc") / 100.0))
    return grid.pool(cells.withColumn("f", F.nanvl("f", F.lit(0.0))), {"f": "avg"}).select(*KEY, sinks.priority(F.col("f")).alias("weight"))


RANK = "rk AS (SELECT s.area_id, s.sink_id, s.volume_m3, m.rsi, s.volume_m3 * m.rsi AS recharge_score, row_number() OVER (PARTITION BY s.area_id ORDER BY s.volume_m3 * m.rsi DESC, s.sink_id) AS rank FROM sinks s JOIN (SELECT s.area_id, sink_id, avg(sand / 700.0e0) AS rsi FROM sinks s JOIN cells a ON a.area_id = s.area_id AND abs(a.r - s.r) <= 3 AND abs(a.c - s.c) <= 3 GROUP BY 1, 2) m USING (area_id, sink_id))"


def ranked_recharge(v) -> DataFrame:
    cells, ponds = v("cells", "sinks")
    return sinks.rank_recharge(ponds, cells.select(*KEY, (F.col("sand") / 700.0).alias("rsi"), F.col("dem").alias("gw"), F.col("clay").alias("ksat")))


@query("a4_rank_recharge", f"WITH {RANK} SELECT area_id, sink_id, round(volume_m3, 6) AS volume_m3, round(rsi, 6) AS rsi, round(recharge_score, 4) AS recharge_score, CAST(rank AS INT) AS rank, round(dem, 6) AS gw, clay AS ksat FROM rk JOIN sinks USING (area_id, sink_id) JOIN (SELECT area_id, r, c, dem, clay FROM cells) USING (area_id, r, c)".replace("round(volume_m3", "round(rk.volume_m3"))
def _(v, spark, d):
    return ranked_recharge(v).select("area_id", "sink_id", "volume_m3", "rsi", F.round("recharge_score", 4).alias("recharge_score"), "rank", "gw", "ksat")


@query("a5_top_recharge", f"WITH {RANK} SELECT area_id, sink_id, volume_m3, round(rsi, 6) AS rsi, round(recharge_score, 4) AS recharge_score, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 3")
def _(v, spark, d):
    return sinks.top_recharge(ranked_recharge(v), 3).withColumn("recharge_score", F.round("recharge_score", 4))


@query("a6_sample_flag", "SELECT station, starts_with(station, 'SAMPLE') AS is_sample FROM stations")
def _(v, spark, d):
    return sinks.flag_samples(v("stations")[0]).select("station", "is_sample")


# --- rain -----------------------------------------------------------------------------------------------------------

FIRST = "first AS (SELECT area_id, point_id, sum(coalesce(mm, 0)) AS rain_mm FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ts, event_id) AS k FROM rain) WHERE k <= 24 GROUP BY 1, 2)"


@query("r1_next_hours", f"WITH {FIRST} SELECT area_id, point_id, round(rain_mm, 6) AS rain_mm FROM first")
def _(v, spark, d):
    return rain.next_hours(v("rain")[0])


@query("r2_area_max", f"WITH {FIRST} SELECT area_id, round(max(rain_mm), 6) AS rain_mm FROM first GROUP BY 1")
def _(v, spark, d):
    return rain.area_max(rain.next_hours(v("rain")[0]))


@query("r2_sample_points", "SELECT area_id, p.name, round(p.lat, 6) AS lat, round(p.lon, 6) AS lon FROM (SELECT area_id, unnest([{'name': 'centre', 'lat': lat0 + dlat * 8, 'lon': lon0 + dlon * 8}, {'name': 'nw', 'lat': lat0, 'lon': lon0}, {'name': 'ne', 'lat': lat0, 'lon': lon0 + dlon * 16}, {'name': 'sw', 'lat': lat0 + dlat * 16, 'lon': lon0}, {'name': 'se', 'lat': lat0 + dlat * 16, 'lon': lon0 + dlon * 16}]) AS p FROM areas)")
def _(v, spark, d):
    return rain.sample_points(v("areas")[0])


ANTE = f"{DAILY}, ante AS (SELECT area_id, day, sum(mm) OVER (PARTITION BY area_id ORDER BY day RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW) AS rain_mm FROM daily)"


@query("r3_antecedent", f"WITH {ANTE} SELECT area_id, day, round(rain_mm, 6) AS rain_mm FROM ante")
def _(v, spark, d):
    return rain.antecedent(v("rain")[0], 2)


USABLE = f"{ANTE}, usable AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY day) AS k FROM (SELECT DISTINCT area_id, day FROM rain) JOIN ante USING (area_id, day) WHERE rain_mm >= 50)"


@query("r4_usable_dates", f"WITH {USABLE} SELECT area_id, day, round(rain_mm, 6) AS rain_mm, CAST(k AS INT) AS k FROM usable WHERE k <= 8")
def _(v, spark, d):
    r = v("rain")[0]
    return rain.usable_dates(r, r, 2, 50.0, 8)


@query("r5_hold_out", f"WITH {USABLE}, u AS (SELECT * FROM usable WHERE k <= 8) SELECT area_id, day, k > count(*) OVER (PARTITION BY area_id) - least(2, count(*) OVER (PARTITION BY area_id) - 1) AS is_test FROM u")
def _(v, spark, d):
    r = v("rain")[0]
    return rain.hold_out(rain.usable_dates(r, r, 2, 50.0, 8).select("area_id", "day"), 2)


# --- alerts ---------------------------------------------------------------------------------------------------------


@query("l1_runoff", f"SELECT area_id, r, c, CASE WHEN clay / 10.0e0 < 10 THEN 0 WHEN clay / 10.0e0 > 40 THEN 3 WHEN clay / 10.0e0 > 25 THEN 2 ELSE 1 END AS soil, {CN} AS cn, round({_runoff('100.0e0', f'({CN})')}, 6) AS q_mm FROM cells")
def _(v, spark, d):
    return alerts.runoff(v("cells")[0], F.lit(100.0))


@query("alerts_fill_ratio", f"WITH {ONE} SELECT * FROM levels")
def _(v, spark, d):
    return levels(v, spark, 100.0)


@query("l3_rain_sweep", f"WITH {ALERTS} SELECT * FROM levels")
def _(v, spark, d):
    return levels(v, spark, 20.0, 60.0, 100.0)


PLACED = "placed AS (SELECT sink_id, lat, lon, CASE WHEN x > 0 AND y > 0 AND x < 100 AND y < 15 AND x <> floor(x) AND y <> floor(y) THEN 'zone_' || CAST(CAST(floor(x) * 15 + floor(y) AS BIGINT) AS VARCHAR) END AS ward FROM (SELECT sink_id, lat0 + dlat * (r + 0.5e0) AS lat, lon0 + dlon * (c + 0.5e0) AS lon, (lon0 + dlon * (c + 0.5e0) - 85.0e0) / 0.01e0 AS x, (lat0 + dlat * (r + 0.5e0) - 25.55e0) / 0.01e0 AS y FROM sinks JOIN areas USING (area_id)))"


def placed(v) -> DataFrame:
    ponds, areas = v("sinks", "areas")
    return alerts.grid_wards(grid.to_lonlat(ponds, areas), BOX)


@query("l4_grid_wards", f"WITH {PLACED} SELECT sink_id, round(lat, 6) AS lat, round(lon, 6) AS lon, ward FROM placed")
def _(v, spark, d):
    return placed(v).select("sink_id", "lat", "lon", "ward")


@query("l5_polygon_wards", "SELECT b.area_id, feature_id, 'w' || CAST(a.area_id AS VARCHAR) AS ward FROM buildings b JOIN areas a ON abs(b.lon - (a.lon0 + 0.0022e0)) + abs(b.lat - (a.lat0 - 0.0022e0)) < 0.0017e0")
def _(v, spark, d):
    buildings, areas = v("buildings", "areas")
    corner = lambda x, y: F.struct((F.col("lon0") + 0.0022 + x).alias("lon"), (F.col("lat0") - 0.0022 + y).alias("lat"))
    rings = areas.select(F.concat(F.lit("w"), F.col("area_id").cast("string")).alias("ward"), F.array(corner(0.0017, 0.0), corner(0.0, 0.0017), corner(-0.0017, 0.0), corner(0.0, -0.0017)).alias("ring"))
    return alerts.assign_wards(buildings.select("area_id", "feature_id", "lat", "lon"), rings, BOX).where("ward is not null").drop("lat", "lon")


@query("l6_ward_levels", f"WITH {ONE}, {PLACED}, worst AS (SELECT ward, arg_max(level, CASE level WHEN 'RED' THEN 2 WHEN 'AMBER' THEN 1 ELSE 0 END) AS level, count(*) AS n_sinks FROM levels JOIN placed USING (sink_id) WHERE ward IS NOT NULL GROUP BY 1) SELECT 'zone_' || CAST(k AS VARCHAR) AS ward, coalesce(level, 'GREEN') AS level, coalesce(n_sinks, 0) AS n_sinks FROM range(1500) z(k) LEFT JOIN worst ON ward = 'zone_' || CAST(k AS VARCHAR)")
def _(v, spark, d):
    rows = levels(v, spark, 100.0).join(placed(v).select("sink_id", "ward"), "sink_id")
    return alerts.ward_levels(alerts.all_grid_wards(spark, BOX), rows)


@query("l6_wards_in_alert", f"WITH {ONE}, {PLACED} SELECT ward, arg_max(level, CASE level WHEN 'RED' THEN 2 WHEN 'AMBER' THEN 1 ELSE 0 END) AS level, count(*) AS n_sinks FROM levels JOIN placed USING (sink_id) WHERE ward IS NOT NULL GROUP BY 1 HAVING max(level <> 'GREEN')")
def _(v, spark, d):
    rows = levels(v, spark, 100.0).join(placed(v).select("sink_id", "ward"), "sink_id")
    return alerts.wards_in_alert(alerts.ward_levels(alerts.all_grid_wards(spark, BOX), rows))


@query("l7_level_counts", f"WITH {ALERTS} SELECT area_id, rain_mm, count(*) FILTER (level = 'RED') AS red, count(*) FILTER (level = 'AMBER') AS amber, count(*) FILTER (level = 'GREEN') AS green FROM levels GROUP BY 1, 2")
def _(v, spark, d):
    return alerts.level_counts(levels(v, spark, 20.0, 60.0, 100.0))


@query("l8_digest", f"WITH {ALERTS}, k AS (SELECT *, row_number() OVER (PARTITION BY area_id, rain_mm, level ORDER BY fill_ratio DESC, sink_id) AS k FROM levels) SELECT area_id, rain_mm, 'Flood outlook, next 24h: ' || CAST(CAST(rain_mm AS BIGINT) AS VARCHAR) || ' mm forecast.' || chr(10) || 'RED sinks: ' || CAST(count(*) FILTER (level = 'RED') AS VARCHAR) || ' ' || ' AMBER: ' || CAST(count(*) FILTER (level = 'AMBER') AS VARCHAR) || '.' || chr(10) || coalesce(string_agg('- sink ' || CAST(sink_id AS VARCHAR) || ' fill ' || printf('%.2f', fill_ratio), chr(10) ORDER BY fill_ratio DESC, sink_id) FILTER (level = 'RED' AND k <= 5), '') AS message FROM k GROUP BY 1, 2")
def _(v, spark, d):
    return alerts.digest(levels(v, spark, 20.0, 60.0, 100.0))


# --- radar and verification -----------------------------------------------------------------------------------------


def passes(v) -> DataFrame:
    days = v("sar")[0].select("area_id", "day").distinct()
    return days.select("area_id", "day", F.when(F.dayofmonth("day") % 5 == 0, "EW").otherwise("IW").alias("mode"), F.when(F.dayofmonth("day") % 7 == 0, F.array(F.lit("VH"))).otherwise(F.array(F.lit("VV"), F.lit("VH"))).alias("polarisations"))


@query("v1_select_passes", "SELECT DISTINCT area_id, day FROM sar WHERE day >= DATE '1995-01-01' AND day < DATE '1996-01-01' AND extract(day FROM day) % 5 <> 0 AND extract(day FROM day) % 7 <> 0")
def _(v, spark, d):
    from datetime import date

    return radar.select_passes(passes(v), date(1995, 1, 1), date(1996, 1, 1)).select("area_id", "day")


DRY = "dry AS (SELECT area_id, r, c, median(vv) AS dry FROM sar WHERE mon IN (2, 3) GROUP BY 1, 2, 3)"


@query("v2_dry_reference", f"WITH {DRY} SELECT area_id, r, c, round(dry, 6) AS dry FROM dry")
def _(v, spark, d):
    return radar.dry_reference(v("sar")[0])


EVENTS = "ev AS (SELECT DISTINCT area_id, day AS event FROM sar)"
MOSAIC = f"{EVENTS}, mosaic AS (SELECT s.area_id, r, c, event, arg_max(vv, (day, seq)) AS vv FROM sar s JOIN ev ON ev.area_id = s.area_id AND s.day >= event - 1 AND s.day < event + 2 GROUP BY 1, 2, 3, 4)"


def event_days(v) -> DataFrame:
    return v("sar")[0].select("area_id", F.col("day").alias("event")).distinct()


@query("v3_event_mosaic", f"WITH {MOSAIC} SELECT * FROM mosaic")
def _(v, spark, d):
    return radar.mosaic(v("sar")[0], event_days(v))


RULE = "CASE WHEN (coalesce(vv < -16, false) OR coalesce(vv - dry < -4, false)) AND jrc < 50 THEN 1 ELSE 0 END"
MASK = f"{DRY}, {MOSAIC}, raw AS (SELECT area_id, r, c, event, {RULE} AS wet FROM mosaic LEFT JOIN dry USING (area_id, r, c) JOIN (SELECT area_id, r, c, jrc FROM cells) USING (area_id, r, c)), mask AS (SELECT a.area_id, a.event, a.r, a.c, CASE WHEN avg(b.wet) > 0.5 THEN 1 ELSE 0 END AS wet FROM raw a JOIN raw b ON a.area_id = b.area_id AND a.event = b.event AND (a.r - b.r) ** 2 + (a.c - b.c) ** 2 <= 4 GROUP BY 1, 2, 3, 4)"


def mask(v) -> DataFrame:
    sar, cells = v("sar", "cells")
    return radar.water_mask(radar.mosaic(sar, event_days(v)), radar.dry_reference(sar), cells)


@query("v4_water_mask", f"WITH {MASK} SELECT * FROM mask")
def _(v, spark, d):
    return mask(v)


@query("v5_wet_frequency", f"WITH {DRY}, m AS (SELECT * FROM sar WHERE extract(month FROM day) * 100 + extract(day FROM day) >= 601 AND extract(month FROM day) * 100 + extract(day FROM day) < 1015), n AS (SELECT area_id, count(DISTINCT day) AS n FROM m GROUP BY 1), i AS (SELECT area_id, r, c, day, arg_max(vv, seq) AS vv FROM m GROUP BY 1, 2, 3, 4), w AS (SELECT area_id, r, c, sum({RULE.replace(' AND jrc < 50', '')}) AS wet FROM i LEFT JOIN dry USING (area_id, r, c) GROUP BY 1, 2, 3) SELECT area_id, r, c, CASE WHEN jrc < 50 THEN round(coalesce(wet, 0) / n, 6) END AS frequency FROM (SELECT area_id, r, c, jrc FROM cells) JOIN n USING (area_id) LEFT JOIN w USING (area_id, r, c)")
def _(v, spark, d):
    sar, cells = v("sar", "cells")
    return radar.wet_frequency(sar, radar.dry_reference(sar), cells)


SCORES = "sc AS (SELECT area_id, event_id, count(*) FILTER (pred > 0.4 AND wet = 1) AS hits, count(*) FILTER (pred <= 0.4 AND wet = 1) AS misses, count(*) FILTER (pred > 0.4 AND wet = 0) AS false_alarms FROM truth GROUP BY 1, 2), scored AS (SELECT *, hits / greatest(hits + misses, 1) AS pod, false_alarms / greatest(hits + false_alarms, 1) AS far, hits / greatest(hits + misses + false_alarms, 1) AS csi FROM sc)"


@query("v6_scores", f"WITH {SCORES} SELECT area_id, event_id, hits, misses, false_alarms, round(pod, 6) AS pod, round(far, 6) AS far, round(csi, 6) AS csi FROM scored")
def _(v, spark, d):
    return radar.scores(v("truth")[0], F.col("pred") > 0.4, ["area_id", "event_id"])


@query("v7_domain_truth", f"WITH {MASK}, t AS (SELECT area_id, event, CAST(r // 2 AS INT) AS r, CAST(c // 2 AS INT) AS c, max(wet) AS wet FROM mask GROUP BY 1, 2, 3, 4), o AS (SELECT area_id, CAST(r // 2 AS INT) AS r, CAST(c // 2 AS INT) AS c, CASE WHEN avg(jrc) < 50 THEN 1 ELSE 0 END AS valid FROM cells GROUP BY 1, 2, 3) SELECT * FROM t JOIN o USING (area_id, r, c)")
def _(v, spark, d):
    return radar.domain_truth(mask(v), v("cells")[0])


@query("v8_mean_csi", f"WITH {SCORES} SELECT area_id, round_even(avg(csi), 4) AS mean_csi FROM scored GROUP BY 1")
def _(v, spark, d):
    return radar.mean_csi(radar.scores(v("truth")[0], F.col("pred") > 0.4, ["area_id", "event_id"]), ["area_id"])


def _sweep(sign: str, name: str = "sw", value: str = "pred", grid_sql: str = "SELECT k / 20.0e0 AS t FROM range(20) g(k)") -> str:
    return f"{name} AS (SELECT t, avg(csi) AS mean_csi FROM (SELECT t, event_id, count(*) FILTER ({value} {sign} t AND wet = 1) / greatest(count(*) FILTER (wet = 1) + count(*) FILTER ({value} {sign} t AND wet = 0), 1) AS csi FROM truth CROSS JOIN ({grid_sql}) GROUP BY 1, 2) GROUP BY 1)"


def thresholds(spark) -> DataFrame:
    return spark.range(20).select((F.col("id") / 20.0).alias("t"))


@query("v9_threshold_sweep", f"WITH {_sweep('>')}, {_sweep('<', 'lo')} SELECT 'above' AS side, t, round(mean_csi, 6) AS mean_csi FROM sw UNION ALL SELECT 'below', t, round(mean_csi, 6) FROM lo")
def _(v, spark, d):
    truth = v("truth")[0]
    up, down = radar.sweep(truth, "pred", thresholds(spark)), radar.sweep(truth, "pred", thresholds(spark), above=False)
    return up.select(F.lit("above").alias("side"), "t", "mean_csi").union(down.select(F.lit("below"), "t", "mean_csi"))


@query("v9_best_threshold", f"WITH {_sweep('>')} SELECT arg_max(t, (round(mean_csi, 9), -t)) AS threshold, round_even(max(mean_csi), 4) AS mean_csi FROM sw")
def _(v, spark, d):
    return radar.best_threshold(radar.sweep(v("truth")[0], "pred", thresholds(spark)).withColumn("mean_csi", F.round("mean_csi", 9)), [])


@query("v10_threshold_grids", "WITH q AS (SELECT unnest([quantile_cont(depth, 0.5e0), quantile_cont(depth, 0.6225e0), quantile_cont(depth, 0.745e0), quantile_cont(depth, 0.8675e0), quantile_cont(depth, 0.99e0)]) AS t, unnest([0, 1, 2, 3, 4]) AS k FROM cells) SELECT 'quantile' AS kind, k, round(t, 6) AS t FROM q UNION ALL SELECT 'linear', k, round(0.05e0 + 0.95e0 * k / 4, 6) FROM range(5) g(k)")
def _(v, spark, d):
    q = radar.quantile_grid(v("cells")[0], "depth", 5)
    return q.select(F.lit("quantile").alias("kind"), F.col("k").cast("long").alias("k"), "t").union(radar.linear_grid(spark, 0.05, 1.0, 5).select(F.lit("linear"), F.col("k").cast("long"), "t"))


DEPTHS = "SELECT 0.05e0 + 1.45e0 * k / 29 AS t FROM range(30) g(k)"
HEIGHTS = "SELECT 0.25e0 + 14.75e0 * k / 39 AS t FROM range(40) g(k)"
QUANTILES = "SELECT unnest([" + ", ".join(f"quantile_cont(twi, {(0.5 + 0.49 * k / 24)!r}e0)" for k in range(25)) + "]) AS t FROM twi"
TAUS = "SELECT unnest([0.02e0, 0.05e0, 0.1e0, 0.15e0, 0.2e0, 0.3e0]) AS t"
HAND = "hand AS (SELECT area_id, r, c, coalesce(hand, 0) AS hand FROM cells LEFT JOIN (SELECT a.area_id, a.r, a.c, arg_min(a.dem - d.dem, ((a.r - d.r) ** 2 + (a.c - d.c) ** 2, d.r, d.c)) AS hand FROM cells a JOIN (SELECT area_id, r, c, dem FROM cells WHERE jrc >= 50) d ON d.area_id = a.area_id GROUP BY 1, 2, 3) USING (area_id, r, c))"


def _best(rows: str, sign: str, grid_sql: str, method: str, window: str = "NULL") -> str:
    swept = f"SELECT t, avg(csi) AS mean_csi FROM (SELECT t, event_id, count(*) FILTER (x {sign} t AND wet = 1) / greatest(count(*) FILTER (wet = 1) + count(*) FILTER (x {sign} t AND wet = 0), 1) AS csi FROM ({rows}) CROSS JOIN ({grid_sql}) GROUP BY 1, 2) GROUP BY 1"
    return f"SELECT '{method}' AS method, CAST({window} AS INT) AS window_days, round(arg_max(t, (round(mean_csi, 9), -t)), 6) AS threshold, round_even(max(round(mean_csi, 9)), 4) AS mean_csi FROM ({swept})"


#: Depths after rain are the area's depth scaled by the real total of the days before an event; the simulator's grids would be given.
METHODS = f"""WITH {GRAD}, {DAILY}, {', '.join(f"ante{w} AS (SELECT d.area_id AS place, d.day, round(sum(e.mm), 4) AS rain_mm FROM daily d JOIN daily e ON e.area_id = d.area_id AND e.day BETWEEN d.day - {w} AND d.day GROUP BY 1, 2)" for w in (1, 3, 5))}, twi AS (SELECT area_id, r, c, round(ln((acc * 900.0e0 + 1) / ({HYP} + 1e-3)), 6) AS twi FROM g), {HAND}, dry AS (SELECT area_id, r, c, depth FROM cells WHERE jrc < 50), obs AS (SELECT area_id, r, c, event_id, wet FROM truth),
    found AS ({_best('SELECT event_id, wet, depth AS x FROM obs JOIN dry USING (area_id, r, c)', '>', DEPTHS, 'static depth')}
    UNION ALL {_best('SELECT event_id, wet, twi AS x FROM obs JOIN dry USING (area_id, r, c) JOIN twi USING (area_id, r, c)', '>', QUANTILES, 'wetness')}
    UNION ALL {_best('SELECT event_id, wet, round(hand, 6) AS x FROM obs JOIN dry USING (area_id, r, c) JOIN hand USING (area_id, r, c)', '<', HEIGHTS, 'height above drains')}
    UNION ALL {' UNION ALL '.join(_best(f"SELECT event_id, wet, round(depth * rain_mm / 400.0e0, 6) AS x FROM obs JOIN dry USING (area_id, r, c) JOIN ante{w} ON place = area_id % 10 AND day = DATE '2024-01-01' + CAST(4 * event_id AS INT)", '>', TAUS, 'depth after rain', str(w)) for w in (1, 3, 5))}),
    best AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY mean_csi DESC, window_days) AS k FROM found)"""


@query("v11_compare_methods", f"{METHODS} SELECT method, window_days, threshold, mean_csi, CAST(row_number() OVER (ORDER BY mean_csi DESC, method) AS INT) AS rank FROM best WHERE k = 1")
def _(v, spark, d):
    cells, truth = v("cells", "truth")
    wet = truth.select(*KEY, "event_id", "wet").join(cells.where("jrc < 50").select(*KEY, "depth"), KEY)
    twi = terrain.wetness(cells).select(*KEY, F.round("twi", 6).alias("twi"))
    hand = terrain.hand_lite(cells).select(*KEY, F.round("hand", 6).alias("hand"))
    dated = wet.withColumns({"place": F.col("area_id") % 10, "day": F.date_add(F.lit("2024-01-01").cast("date"), (4 * F.col("event_id")).cast("int"))})
    before = lambda w: rain.antecedent(v("rain")[0], w).select(F.col("area_id").alias("place"), "day", F.round("rain_mm", 4).alias("rain_mm"))
    after = {w: dated.join(before(w), ["place", "day"]).withColumn("x", F.round(F.col("depth") * F.col("rain_mm") / 400.0, 6)) for w in (1, 3, 5)}
    taus = spark.createDataFrame([(t,) for t in (0.02, 0.05, 0.1, 0.15, 0.2, 0.3)], "t double")
    swept = [
        ("static depth", None, radar.sweep(wet, "depth", radar.linear_grid(spark, 0.05, 1.5, 30).select("t"))),
        ("wetness", None, radar.sweep(wet.join(twi, KEY), "twi", radar.quantile_grid(twi, "twi").select("t"))),
        ("height above drains", None, radar.sweep(wet.join(hand, KEY), "hand", radar.linear_grid(spark, 0.25, 15.0, 40).select("t"), above=False)),
        *(("depth after rain", w, radar.sweep(rows, "x", taus)) for w, rows in after.items()),
    ]
    return radar.compare_methods([(name, w, df.withColumn("mean_csi", F.round("mean_csi", 9))) for name, w, df in swept])


@query("v12_soft_dice", "SELECT area_id, event_id, round(1 - (2 * sum(wet / (1 + exp(-(pred - 0.4e0) / 0.1e0))) + 1) / (sum(1 / (1 + exp(-(pred - 0.4e0) / 0.1e0))) + sum(wet) + 1), 6) AS loss FROM truth GROUP BY 1, 2")
def _(v, spark, d):
    return radar.soft_dice(v("truth")[0], F.col("pred"), 0.4, 0.1, ["area_id", "event_id"])


@query("v13_ensemble_cells", "SELECT area_id, r, c, round(avg(CASE WHEN h > 0.15e0 THEN 1.0e0 ELSE 0 END), 6) AS p, round(coalesce(stddev_samp(h), 0), 6) AS spread FROM runs GROUP BY 1, 2, 3")
def _(v, spark, d):
    return radar.ensemble_cells(v("runs")[0])


@query("v13_ensemble_summary", "WITH m AS (SELECT area_id, scenario_id, count(*) FILTER (h > 0.15e0) * 3600.0e0 / 1e6 AS km2 FROM runs GROUP BY 1, 2), p AS (SELECT area_id, r, c, avg(CASE WHEN h > 0.15e0 THEN 1.0e0 ELSE 0 END) AS p FROM runs GROUP BY 1, 2, 3), l AS (SELECT area_id, round(count(*) FILTER (p >= 0.5) * 3600.0e0 / 1e6, 6) AS km2_p50, round(count(*) FILTER (p >= 0.9) * 3600.0e0 / 1e6, 6) AS km2_p90 FROM p GROUP BY 1) SELECT area_id, round(avg(km2), 6) AS mean_km2, round(stddev_pop(km2), 6) AS std_km2, any_value(km2_p50) AS km2_p50, any_value(km2_p90) AS km2_p90 FROM m JOIN l USING (area_id) GROUP BY 1")
def _(v, spark, d):
    return radar.ensemble_summary(v("runs")[0])


@query("v14_surrogate_error", "SELECT area_id, round(sqrt(avg((pred - wet) ** 2)), 6) AS rmse, round(coalesce(sqrt(avg((pred - wet) ** 2) FILTER (wet > 0.15)), 0), 6) AS rmse_wet, round(avg((pred - wet) ** 2 * (1 + 20 * CASE WHEN wet > 0.05 THEN 1 ELSE 0 END)), 6) AS weighted_mse FROM truth GROUP BY 1")
def _(v, spark, d):
    return radar.surrogate_error(v("truth")[0], F.col("pred"), F.col("wet").cast("double"), ["area_id"])


@query("v15_disagreements", "SELECT area_id, event_id, r, c, wet, CASE WHEN pred > 0.4 THEN 1 ELSE 0 END AS predicted FROM truth WHERE wet <> CASE WHEN pred > 0.4 THEN 1 ELSE 0 END")
def _(v, spark, d):
    return radar.disagreements(v("truth")[0], F.col("pred") > 0.4).drop("pred")


# --- scenarios and plans --------------------------------------------------------------------------------------------

OVER = "greatest(h - 0.15e0, 0)"


@query("c1_flood_metrics", f"WITH {BUILT} SELECT area_id, scenario_id, count(*) FILTER (h > 0.15e0 AND built = 1) * 3600.0e0 AS area_m2, round(sum({OVER} * built) * 3600, 4) AS volume_m3, max(h) AS peak_m FROM runs JOIN built USING (area_id, r, c) GROUP BY 1, 2")
def _(v, spark, d):
    return planning.flood_metrics(v("runs")[0], built(v)).withColumn("volume_m3", F.round("volume_m3", 4))


@query("c2_compare_strategies", f"WITH {BUILT}, x AS (SELECT area_id, scenario_id, sum({OVER}) * 3600 AS after_m3 FROM runs JOIN built USING (area_id, r, c) WHERE built = 1 AND NOT (r BETWEEN 4 AND 6 AND c BETWEEN 4 AND 6) GROUP BY 1, 2) SELECT a.area_id, a.scenario_id, round(a.after_m3, 4) AS after_m3, round(b.after_m3, 4) AS before_m3, round_even(100 * (1 - round(a.after_m3, 4) / greatest(round(b.after_m3, 4), 1)), 1) AS reduction_pct FROM x a JOIN x b ON a.area_id = b.area_id AND b.scenario_id = 1 WHERE a.scenario_id <> 1")
def _(v, spark, d):
    off = v("cells")[0].where("r between 4 and 6 and c between 4 and 6")
    out = planning.compare_strategies(v("runs")[0], built(v), off, 1)
    a, b = F.round("after_m3", 4), F.round("before_m3", 4)
    return out.withColumns({"after_m3": a, "before_m3": b}).withColumn("reduction_pct", F.bround(100.0 * (1.0 - F.col("after_m3") / F.greatest("before_m3", F.lit(1.0))), 1))


FRAMES = "frames AS (SELECT area_id, scenario_id AS step, r, c, h FROM runs)"


def frames(v) -> DataFrame:
    return v("runs")[0].withColumnRenamed("scenario_id", "step")


@query("c3_mass_curve", f"WITH {FRAMES} SELECT area_id, step, round(sum(h) * 3600, 4) AS volume_m3 FROM frames WHERE step % 3 = 0 OR step = (SELECT max(step) FROM frames g WHERE g.area_id = frames.area_id) GROUP BY 1, 2")
def _(v, spark, d):
    return planning.mass_curve(planning.frames_kept(frames(v), 3)).withColumn("volume_m3", F.round("volume_m3", 4))


@query("c3_probe_series", f"WITH {FRAMES} SELECT area_id, r, c, step, h, max(h) OVER (PARTITION BY area_id, r, c) AS hmax FROM frames JOIN (SELECT DISTINCT area_id, r, c FROM sinks) USING (area_id, r, c)")
def _(v, spark, d):
    return planning.probe_series(frames(v), v("sinks")[0])


def sites(v) -> DataFrame:
    return v("sinks")[0].select("area_id", (F.col("sink_id") % 5).cast("int").alias("site"), F.floor(F.col("r") / 2).cast("int").alias("r"), F.floor(F.col("c") / 2).cast("int").alias("c"))


SITES = "sites AS (SELECT area_id, CAST(sink_id % 5 AS INT) AS site, CAST(r // 2 AS INT) AS r, CAST(c // 2 AS INT) AS c FROM sinks)"
FOOT = f"{SITES}, foot AS (SELECT area_id, site, CAST(r + i AS INT) AS r, CAST(c + j AS INT) AS c FROM sites CROSS JOIN range(-2, 3) a(i) CROSS JOIN range(-2, 3) b(j) WHERE i * i + j * j <= 4 AND r + i BETWEEN 0 AND 7 AND c + j BETWEEN 0 AND 7)"


GIVEN = "given AS (SELECT area_id, r, c, row_number() OVER (PARTITION BY area_id ORDER BY volume_m3 DESC, sink_id) AS k FROM sinks WHERE r BETWEEN 2 AND 13 AND c BETWEEN 2 AND 13)"
PICKS = f"""{GIVEN}, have AS (SELECT area_id, least(count(g.k), 4) AS n FROM areas LEFT JOIN given g USING (area_id) GROUP BY 1), deep AS (SELECT area_id, depth AS h, r, c, n AS given FROM cells JOIN have USING (area_id) WHERE depth > 0),
    picks(area_id, turn, n, seen, r, c, inner_) AS (SELECT area_id, 0, n, CAST([] AS STRUCT(r INT, c INT)[]), NULL::INT, NULL::INT, false FROM have
        UNION ALL SELECT p.area_id, p.turn + 1, p.n + CASE WHEN x.r BETWEEN 2 AND 13 AND x.c BETWEEN 2 AND 13 THEN 1 ELSE 0 END, list_append(p.seen, {{'r': x.r, 'c': x.c}}), x.r, x.c, x.r BETWEEN 2 AND 13 AND x.c BETWEEN 2 AND 13
        FROM picks p JOIN LATERAL (SELECT arg_min({{'r': d.r, 'c': d.c}}, (-d.h, d.r, d.c)) AS x FROM deep d WHERE d.area_id = p.area_id AND len(list_filter(p.seen, lambda q: d.r >= q.r - 8 AND d.r < q.r + 8 AND d.c >= q.c - 8 AND d.c < q.c + 8)) = 0) ON x IS NOT NULL WHERE p.n < 4)"""


@query("c4_candidate_sites", f"WITH RECURSIVE {PICKS} SELECT area_id, CAST(k - 1 AS INT) AS site, r, c FROM given WHERE k <= 4 UNION ALL SELECT area_id, CAST(n - 1 AS INT), r, c FROM picks WHERE inner_")
def _(v, spark, d):
    deep = v("cells")[0].select(*KEY, F.col("depth").alias("h"))
    return planning.candidate_sites(v("sinks")[0].withColumn("r", F.col("r") * 2).withColumn("c", F.col("c") * 2), deep, 16, 4, 2)


@query("c5_footprints", f"WITH {FOOT} SELECT area_id, site, count(*) * 3600.0e0 AS site_m2 FROM foot GROUP BY 1, 2")
def _(v, spark, d):
    return planning.site_areas(planning.footprints(sites(v), 8))


@query("c6_dig_depths", f"WITH {FOOT} SELECT area_id, r, c, round(sum(least(greatest(site * 1.0e0 - 0.5e0, 0), 3)), 6) AS dig_m FROM foot GROUP BY 1, 2, 3")
def _(v, spark, d):
    where = sites(v)
    return planning.dig_depths(planning.footprints(where, 8), where.select("area_id", "site", (F.col("site") * 1.0 - 0.5).alias("depth_m")))


@query("c6_dig_from_theta", f"WITH {FOOT} SELECT area_id, r, c, round(sum(3 / (1 + exp(-(site - 2.0e0)))), 6) AS dig_m FROM foot GROUP BY 1, 2, 3")
def _(v, spark, d):
    where = sites(v)
    return planning.dig_depths(planning.footprints(where, 8), where.select("area_id", "site", (F.col("site") - 2.0).alias("theta")))


@query("c7_excavation_plan", f"WITH {FOOT}, m AS (SELECT area_id, site, count(*) * 3600.0e0 AS site_m2 FROM foot GROUP BY 1, 2) SELECT area_id, site, round_even(lat0 + dlat * r * 2, 5) AS lat, round_even(lon0 + dlon * c * 2, 5) AS lon, round_even(site * 0.5e0, 2) AS dig_depth_m, CAST(round_even(site * 0.5e0 * site_m2, 0) AS BIGINT) AS excavation_m3, round(least(150000.0e0 / sum(site_m2) OVER (PARTITION BY area_id), 3), 6) AS equal_depth_m FROM sites JOIN m USING (area_id, site) JOIN areas USING (area_id)")
def _(v, spark, d):
    where = sites(v)
    return planning.excavation_plan(where, planning.site_areas(planning.footprints(where, 8)), where.select("area_id", "site", (F.col("site") * 0.5).alias("depth_m")), v("areas")[0])


@query("c7_excavation_totals", f"WITH {FOOT}, {BUILT}, m AS (SELECT area_id, site, count(*) * 3600.0e0 AS site_m2 FROM foot GROUP BY 1, 2), t AS (SELECT area_id, sum(CAST(round_even(site * 0.5e0 * site_m2, 0) AS BIGINT)) AS total FROM m GROUP BY 1), v AS (SELECT area_id, sum(CASE WHEN scenario_id = 1 THEN {OVER} ELSE 0 END) * 3600 AS a, sum(CASE WHEN scenario_id = 2 THEN {OVER} ELSE 0 END) * 3600 AS b, sum(CASE WHEN scenario_id = 3 THEN {OVER} ELSE 0 END) * 3600 AS o FROM runs JOIN built USING (area_id, r, c) WHERE built = 1 AND NOT EXISTS (SELECT 1 FROM foot WHERE foot.area_id = runs.area_id AND foot.r = runs.r AND foot.c = runs.c) GROUP BY 1) SELECT area_id, CAST(total AS BIGINT) AS total_excavation_m3, CAST(round_even(round(a, 4), 0) AS BIGINT) AS do_nothing_m3, CAST(round_even(round(b, 4), 0) AS BIGINT) AS equal_split_m3, CAST(round_even(round(o, 4), 0) AS BIGINT) AS optimal_m3, round_even(round(100 * (1 - o / greatest(a, 1)), 6), 1) AS reduction_pct FROM t JOIN v USING (area_id)")
def _(v, spark, d):
    where = sites(v)
    foot = planning.footprints(where, 8)
    plan = planning.excavation_plan(where, planning.site_areas(foot), where.select("area_id", "site", (F.col("site") * 0.5).alias("depth_m")), v("areas")[0])
    return planning.excavation_totals(plan, v("runs")[0], built(v), foot, {"do_nothing": 1, "equal_split": 2, "optimal": 3})


@query("c8_outfalls", f"WITH {DOMAIN}, {SITES}, e AS (SELECT area_id, r, c, row_number() OVER (PARTITION BY area_id ORDER BY z, CASE WHEN r = 0 THEN 0 WHEN r = 7 THEN 1 WHEN c = 0 THEN 2 ELSE 3 END, CASE WHEN r IN (0, 7) THEN c ELSE r END) AS k FROM domain WHERE r IN (0, 7) OR c IN (0, 7)) SELECT area_id, CAST(r // 2 AS INT) AS r, CAST(c // 2 AS INT) AS c, 'river' AS kind FROM cells GROUP BY 1, 2, 3 HAVING avg(jrc) > 50 UNION ALL SELECT area_id, r, c, 'edge' FROM e WHERE k = 1 UNION ALL SELECT area_id, r, c, 'site' FROM sites")
def _(v, spark, d):
    cells = v("cells")[0]
    return planning.outfalls(grid.domain_table(cells), grid.pool(cells, {"jrc": "avg"}), sites(v))


def costs(v) -> DataFrame:
    cells = v("cells")[0]
    rows = cells.select(*KEY, F.col("dem").alias("z"), C.urban_multiplier(F.col("worldcover") == 50, F.col("acc") % 3 == 0).alias("mult"), (F.col("jrc") >= 50).alias("is_outfall"))
    return hydrology.cost_to_outfall(rows)


MULT = "CASE WHEN worldcover = 50 THEN 30.0e0 WHEN acc % 3 = 0 THEN 0.5e0 ELSE 1.0e0 END"
COSTS = f"""land AS (SELECT area_id, r, c, dem AS z, {MULT} AS mult, jrc >= 50 AS stop FROM cells), {SIDES},
    moves AS (SELECT n.area_id, n.r, n.c, k, m.r AS r2, m.c AS c2, 60.0e0 * CASE WHEN a <> 0 AND b <> 0 THEN 1.41421e0 ELSE 1.0e0 END * (1 + 40.0e0 * greatest(m.z - n.z, 0)) * m.mult AS price FROM land n CROSS JOIN sides JOIN land m ON m.area_id = n.area_id AND m.r = n.r + a AND m.c = n.c + b),
    cheap(area_id, r, c, cost) USING KEY (area_id, r, c) AS (
        SELECT area_id, r, c, 0.0e0 FROM land WHERE stop
        UNION SELECT x.area_id, x.r, x.c, min(cheap.cost + x.price) FROM cheap JOIN moves x ON x.area_id = cheap.area_id AND x.r2 = cheap.r AND x.c2 = cheap.c LEFT JOIN recurring.cheap o ON o.area_id = x.area_id AND o.r = x.r AND o.c = x.c WHERE o.cost IS NULL OR cheap.cost + x.price < o.cost GROUP BY 1, 2, 3)"""
STEPS = f"{COSTS}, best AS (SELECT x.area_id, x.r, x.c, arg_min({{'r': r2, 'c': c2}}, (t.cost + price, k)) AS w FROM moves x JOIN cheap t ON t.area_id = x.area_id AND t.r = r2 AND t.c = c2 JOIN cheap o ON o.area_id = x.area_id AND o.r = x.r AND o.c = x.c WHERE o.cost > 0 GROUP BY 1, 2, 3)"
ROUTES = f"{STEPS}, trail AS (SELECT s.area_id, sink_id AS route_id, 0 AS k, s.r, s.c FROM sinks s JOIN cheap ON cheap.area_id = s.area_id AND cheap.r = s.r AND cheap.c = s.c UNION ALL SELECT t.area_id, route_id, t.k + 1, w.r, w.c FROM trail t JOIN best b ON b.area_id = t.area_id AND b.r = t.r AND b.c = t.c)"


@query("c9_route_costs", f"WITH RECURSIVE {COSTS} SELECT area_id, r, c, coalesce(round(cost, 6), CAST('inf' AS DOUBLE)) AS cost FROM land LEFT JOIN cheap USING (area_id, r, c)")
def _(v, spark, d):
    return costs(v).select(*KEY, "cost")


@query("c9_routes", f"WITH RECURSIVE {ROUTES} SELECT area_id, route_id, CAST(k AS INT) AS k, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM trail")
def _(v, spark, d):
    return canals(v)


def canals(v) -> DataFrame:
    return hydrology.routes(hydrology.next_cells(costs(v)), v("sinks")[0].select("area_id", F.col("sink_id").alias("route_id"), "r", "c"))


PATHS = f"{ROUTES}, paths AS (SELECT t.area_id, route_id, t.k, t.r, t.c, a.dem AS z FROM trail t JOIN (SELECT area_id, r, c, dem FROM cells) a ON a.area_id = t.area_id AND a.r = t.r AND a.c = t.c)"
BEDS = f"{PATHS}, beds AS (SELECT *, min(z - 1.5e0 + k * 0.12e0) OVER (PARTITION BY area_id, route_id ORDER BY k) - k * 0.12e0 AS bed FROM paths)"


def lines(v) -> DataFrame:
    return cut(canals(v).join(v("cells")[0].select(*KEY, F.col("dem").alias("z")), KEY))


@query("c10_descending_bed", f"WITH RECURSIVE {BEDS} SELECT area_id, route_id, CAST(k AS INT) AS k, r, c, z, round(bed, 6) AS bed FROM beds")
def _(v, spark, d):
    return planning.descending_bed(lines(v), 1.5)


@query("c11_carve", f"WITH RECURSIVE {BEDS}, b AS (SELECT area_id, r, c, min(bed) AS bed FROM beds GROUP BY 1, 2, 3) SELECT area_id, r, c, round(least(dem, coalesce(bed, dem)) - CASE WHEN jrc > 30 THEN 1.0e0 ELSE 0 END, 6) AS z, CASE WHEN bed IS NOT NULL THEN 0.02e0 ELSE {_case('worldcover', P.MANNING, 0.035)} END AS mann FROM cells LEFT JOIN b USING (area_id, r, c)")
def _(v, spark, d):
    cells = v("cells")[0]
    domain = cells.select(*KEY, F.col("dem").alias("z"), C.lookup(F.col("worldcover"), P.MANNING, 0.035).alias("mann"))
    return planning.carve(domain, planning.descending_bed(lines(v), 1.5), cells.where("jrc > 30").select(*KEY, F.lit(1.0).alias("dig_m")))


@query("c12_canal_report", f"WITH RECURSIVE {PATHS} SELECT area_id, route_id, count(*) * 60 AS length_m, count(*) AS n_cells, string_agg(printf('%.5f %.5f', round_even(lat0 + dlat * r * 2, 5), round_even(lon0 + dlon * c * 2, 5)), ';' ORDER BY k) FILTER (k % 3 = 0) AS path FROM paths JOIN areas USING (area_id) GROUP BY 1, 2")
def _(v, spark, d):
    return planning.canal_report(lines(v), v("areas")[0])


@query("c12_canal_effect", f"WITH RECURSIVE {PATHS}, {BUILT}, streets AS (SELECT area_id, r, c FROM built b WHERE built = 1 AND NOT EXISTS (SELECT 1 FROM paths p WHERE p.area_id = b.area_id AND p.r = b.r AND p.c = b.c) AND NOT EXISTS (SELECT 1 FROM sinks s WHERE s.area_id = b.area_id AND s.r = b.r AND s.c = b.c)), x AS (SELECT area_id, coalesce(sum({OVER}) FILTER (scenario_id = 1), 0) * 3600 AS v0, coalesce(sum({OVER}) FILTER (scenario_id = 2), 0) * 3600 AS v1 FROM streets JOIN runs USING (area_id, r, c) GROUP BY 1), n AS (SELECT area_id, count(DISTINCT route_id) AS n_canals FROM paths GROUP BY 1) SELECT area_id, coalesce(n_canals, 0) AS n_canals, CAST(round_even(round(coalesce(v0, 0), 4), 0) AS BIGINT) AS before_m3, CAST(round_even(round(coalesce(v1, 0), 4), 0) AS BIGINT) AS after_m3, round_even(round(100 * (1 - coalesce(v1, 0) / greatest(coalesce(v0, 0), 1)), 6), 1) AS reduction_pct FROM areas LEFT JOIN x USING (area_id) LEFT JOIN n USING (area_id)")
def _(v, spark, d):
    runs, ponds = v("runs", "sinks")
    depth = lambda k: runs.where(F.col("scenario_id") == k)
    return planning.canal_effect(depth(1), depth(2), built(v), lines(v), ponds)


MINIMA = f"{BUILT}, minima AS (SELECT area_id, r, c, pooled, row_number() OVER (PARTITION BY area_id ORDER BY pooled DESC, r, c) AS rank FROM (SELECT area_id, r, c, {OVER} AS pooled FROM runs JOIN built USING (area_id, r, c) WHERE scenario_id = 1 AND built = 1) WHERE pooled > 0), later AS (SELECT area_id, r, c, {OVER} AS later FROM runs WHERE scenario_id = 2)"


def minima(v) -> DataFrame:
    return planning.ranked_minima(v("runs")[0], built(v), 1)


@query("c13_ranked_minima", f"WITH {MINIMA} SELECT area_id, r, c, round(pooled, 6) AS pooled, CAST(rank AS INT) AS rank FROM minima")
def _(v, spark, d):
    return minima(v)


CURVE = f"{MINIMA}, m AS (SELECT *, count(*) OVER (PARTITION BY area_id) AS n FROM minima LEFT JOIN later USING (area_id, r, c)), k AS (SELECT DISTINCT area_id, CAST(k AS INT) AS k, n FROM m CROSS JOIN (SELECT unnest([2, 5, 9]) AS k) WHERE k < n UNION SELECT DISTINCT area_id, CAST(n AS INT), n FROM m), curve AS (SELECT area_id, k AS sites, CASE WHEN k = any_value(k.n) THEN 100 ELSE round_even(100 * (1 - coalesce(sum(later) FILTER (rank > k), 0) * 3600 / greatest(coalesce(sum(pooled) FILTER (rank > k), 0) * 3600, 1)), 1) END AS reduction_pct, CAST(round_even(round(sum(pooled) FILTER (rank <= k) * 3600, 4), 0) AS BIGINT) AS storage_m3, CAST(round_even(round(median(pooled) FILTER (rank <= k) * 3600, 4), 0) AS BIGINT) AS median_site_m3 FROM m JOIN k USING (area_id) GROUP BY area_id, k)"


def curve(v) -> DataFrame:
    after = v("runs")[0].where("scenario_id = 2").select(*KEY, planning.over(F.col("h")).alias("pooled"))
    return planning.storage_curve(minima(v), after, [2, 5, 9])


@query("c14_storage_curve", f"WITH {CURVE} SELECT *, reduction_pct < -50 AS unstable FROM curve")
def _(v, spark, d):
    return curve(v)


TARGETS = f"""{CURVE}, s AS (SELECT *, max(reduction_pct) OVER w AS best FROM curve WHERE NOT reduction_pct < -50 WINDOW w AS (PARTITION BY area_id ORDER BY sites)),
    g AS (SELECT *, lead(sites) OVER w AS sites2, lead(best) OVER w AS best2, lead(storage_m3) OVER w AS storage2, max(best) OVER (PARTITION BY area_id) AS top, min(sites) OVER (PARTITION BY area_id) AS s0 FROM s WINDOW w AS (PARTITION BY area_id ORDER BY sites)),
    t AS (SELECT area_id, target, CASE WHEN target <= any_value(top) THEN CAST(trunc(coalesce(max(CASE WHEN best <= target AND target < coalesce(best2, 1e300) THEN sites + coalesce((target - best) / (best2 - best) * (sites2 - sites), 0) END), any_value(s0))) AS INT) END AS sites FROM g CROSS JOIN (SELECT unnest([30.0e0, 50.0e0, 70.0e0]) AS target) GROUP BY 1, 2),
    v AS (SELECT t.area_id, target, t.sites, arg_max(g.storage_m3 + coalesce((t.sites - g.sites) / (sites2 - g.sites) * (storage2 - g.storage_m3), 0), g.sites) AS m3 FROM t JOIN g ON g.area_id = t.area_id AND (t.sites IS NULL OR g.sites <= t.sites) GROUP BY 1, 2, 3)"""


@query("c15_sites_for_targets", f"WITH {TARGETS} SELECT area_id, target, sites, CASE WHEN sites IS NOT NULL THEN CAST(round_even(m3, 0) AS BIGINT) END AS storage_m3, CASE WHEN sites IS NOT NULL THEN CAST(round_even(m3 / 50, 0) AS BIGINT) END AS units, CASE WHEN sites IS NULL THEN 'target beyond the stable part of the curve' END AS note FROM v")
def _(v, spark, d):
    return planning.sites_for_targets(curve(v), spark.createDataFrame([(30.0,), (50.0,), (70.0,)], "target double"))


@query("c16_rank_interventions", "WITH i AS (SELECT s_suppkey AS area_id, n.name, greatest(s_acctbal * n.f, 0) AS reduced_m3, n.cost FROM supplier CROSS JOIN (VALUES ('canals', 1.0e0, 600 * 9000.0e0 + 200 * 300.0e0), ('excavation', 0.5e0, 500 * 300.0e0), ('storage', 0.8e0, 90 * 6000.0e0)) n(name, f, cost) WHERE NOT (n.name = 'storage' AND s_suppkey % 3 = 0)), e AS (SELECT *, CASE WHEN reduced_m3 > 0 THEN round_even(cost / reduced_m3, 1) END AS cost_per_m3 FROM i) SELECT area_id, name, round(reduced_m3, 6) AS reduced_m3, cost, cost_per_m3, CAST(row_number() OVER (PARTITION BY area_id ORDER BY cost_per_m3 ASC NULLS LAST, name) AS INT) AS rank FROM e")
def _(v, spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    items = s.select(F.col("s_suppkey").alias("area_id"), "s_acctbal", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(f).alias("f"), F.lit(a).alias("canal_m"), F.lit(b).alias("excavation_m3"), F.lit(c).alias("given"), F.lit(n == "storage").alias("needs_storage")) for n, f, a, b, c in (("canals", 1.0, 600.0, 200.0, None), ("excavation", 0.5, None, 500.0, None), ("storage", 0.8, None, None, 90.0))))).alias("i"))
    items = items.select("area_id", "i.*", (F.col("s_acctbal") * F.col("i.f")).alias("reduced_m3"))
    return planning.rank_interventions(items.withColumn("storage_m3", F.when(F.col("area_id") % 3 != 0, F.col("given"))))


# --- exposure -------------------------------------------------------------------------------------------------------

HMAX = "hmax AS (SELECT area_id, CAST(r // 2 AS INT) AS dr, CAST(c // 2 AS INT) AS dc, max(depth) AS h FROM cells GROUP BY 1, 2, 3)"


def hmax(v) -> DataFrame:
    return grid.pool(v("cells")[0], {"depth": "max"}).withColumnRenamed("depth", "h")


AT = f"at_b AS (SELECT feature_id, area_id, coalesce(h, 0) AS h FROM (SELECT feature_id, area_id, {DR} AS dr, {DC} AS dc FROM buildings JOIN areas USING (area_id)) LEFT JOIN hmax USING (area_id, dr, dc) WHERE dr IS NOT NULL)"


@query("e1_building_exposure", f"WITH {HMAX}, {AT} SELECT area_id, count(*) AS in_domain, count(*) FILTER (h > 0.15e0) AS at_risk, round_even(100.0e0 * count(*) FILTER (h > 0.15e0) / greatest(count(*), 1), 1) AS at_risk_pct FROM at_b GROUP BY 1")
def _(v, spark, d):
    return exposure.building_exposure(*v("buildings", "areas"), hmax(v), 8)


@query("e1_building_points", f"WITH {HMAX}, {AT}, k AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY feature_id) AS k FROM at_b WHERE h > 0.15e0) SELECT area_id, feature_id, h, CAST(row_number() OVER (PARTITION BY area_id ORDER BY h DESC, feature_id) AS INT) AS rank FROM k WHERE k <= 1500")
def _(v, spark, d):
    return exposure.building_points(*v("buildings", "areas"), hmax(v), 8)


@query("e2_road_exposure", f"WITH {HMAX}, p AS (SELECT feature_id, area_id, {DR} AS dr, {DC} AS dc FROM vertices JOIN areas USING (area_id)), x AS (SELECT area_id, feature_id, max(CASE WHEN dr IS NOT NULL THEN coalesce(h, 0) END) AS h FROM p LEFT JOIN hmax USING (area_id, dr, dc) GROUP BY 1, 2) SELECT *, CASE WHEN h IS NULL THEN 'outside' WHEN h > 0.15e0 THEN 'flooded' ELSE 'dry' END AS state FROM x")
def _(v, spark, d):
    return exposure.road_exposure(*v("vertices", "areas"), hmax(v), 8)


@query("e2_road_lines", f"WITH {HMAX}, p AS (SELECT feature_id, area_id, {DR} AS dr, {DC} AS dc FROM vertices JOIN areas USING (area_id)), x AS (SELECT area_id, feature_id, max(CASE WHEN dr IS NOT NULL THEN coalesce(h, 0) END) AS h FROM p LEFT JOIN hmax USING (area_id, dr, dc) GROUP BY 1, 2), s AS (SELECT area_id, feature_id, CASE WHEN h > 0.15e0 THEN 'flooded' ELSE 'dry' END AS state FROM x WHERE h IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY area_id, state ORDER BY feature_id) AS rank FROM s) SELECT area_id, feature_id, n, round(lat, 6) AS lat, round(lon, 6) AS lon, state, CAST(rank AS INT) AS rank FROM vertices JOIN k USING (area_id, feature_id) WHERE rank <= 1500")
def _(v, spark, d):
    return exposure.road_lines(*v("vertices", "areas"), hmax(v), 8)


@query("e3_domain_box", "SELECT area_id, round(lat0, 6) AS north, round(lat0 + dlat * 16, 6) AS south, round(lon0, 6) AS west, round(lon0 + dlon * 16, 6) AS east FROM areas")
def _(v, spark, d):
    return exposure.domain_box(v("areas")[0], 8)


@query("e4_rasterise", f"WITH b AS (SELECT area_id, {DR} AS r, {DC} AS c, 1 AS building, 0 AS road FROM buildings JOIN areas USING (area_id)), s AS (SELECT area_id, lat AS la, lon AS lo, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM vertices WINDOW w AS (PARTITION BY area_id, feature_id ORDER BY n, lat, lon)), k AS (SELECT *, greatest(2, CAST(floor(greatest(abs(lat2 - la), abs(lon2 - lo)) / 0.00027e0) AS INT) + 1) AS k FROM s WHERE lat2 IS NOT NULL), q AS (SELECT area_id, la + i / (k - 1) * (lat2 - la) AS lat, lo + i / (k - 1) * (lon2 - lo) AS lon FROM (SELECT *, unnest(range(k)) AS i FROM k)), rd AS (SELECT area_id, {DR} AS r, {DC} AS c, 0 AS building, 1 AS road FROM q JOIN areas USING (area_id)) SELECT area_id, r, c, max(building) AS building, max(road) AS road FROM (SELECT * FROM b UNION ALL SELECT * FROM rd) WHERE r IS NOT NULL GROUP BY 1, 2, 3")
def _(v, spark, d):
    return exposure.rasterise(*v("buildings", "vertices", "areas"), 8)


# --- live alerts ----------------------------------------------------------------------------------------------------


@query("w1_live_alerts", f"WITH {HIST}, pt AS (SELECT area_id, point_id, CAST(day AS TIMESTAMP) AS day, sum(coalesce(mm, 0)) AS mm FROM rain GROUP BY 1, 2, 3), ar AS (SELECT area_id, day, max(mm) AS rain_mm FROM pt GROUP BY 1, 2), f AS (SELECT area_id, day, sink_id, rain_mm, sum(({_runoff('rain_mm', 'cn')}) * n / 1000.0e0 * 900.0e0) / greatest(any_value(volume_m3), 1) AS ratio FROM ar JOIN hist USING (area_id) JOIN sinks USING (area_id, sink_id) GROUP BY 1, 2, 3, 4) SELECT area_id, day, sink_id, round(rain_mm, 6) AS rain_mm, round_even(ratio, 2) AS fill_ratio, CASE WHEN ratio >= 1 THEN 'RED' WHEN ratio >= 0.5 THEN 'AMBER' ELSE 'GREEN' END AS level FROM f")
def _(v, spark, d):
    readings, cells, catch, ponds = v("rain", "cells", "catch", "sinks")
    return live.live_alerts(readings, alerts.histogram(cells, catch), ponds)


from catchwater.plans import one_area  # noqa: E402, F401
