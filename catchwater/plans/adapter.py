"""Raster-like inputs from the driver's relational tables, as SQL that Spark and other engines both read.

Cells: a 16 x 16 grid per supplier; layers are whole-number arithmetic over its order lines, so any engine agrees. Plain: one
area of four cells an order, 480 columns wide, with flats, noise and ridges that have few gaps.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events".split()
_N = ", ".join(f"({k})" for k in range(16))
_GRID = f"(VALUES {_N}) AS g(r) CROSS JOIN (VALUES {_N}) AS h(c)"

#: Views in order; a view may read those before it. ``//`` is whole-number division.
VIEWS = {
    "lines": """
        SELECT l_suppkey AS area_id, CAST(l_partkey % 16 AS INT) AS r, CAST(l_orderkey % 16 AS INT) AS c, l_orderkey, l_linenumber AS k,
               CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax, CAST(l_quantity AS BIGINT) AS qty,
               CAST(round(l_extendedprice) AS BIGINT) AS price, CAST(l_shipdate AS DATE) AS day
        FROM lineitem""",
    "areas": """
        SELECT s_suppkey AS area_id, 85.0e0 + (s_suppkey % 100) * 0.01e0 AS lon0, 0.00027e0 AS dlon, 25.66e0 - (s_suppkey % 7) * 0.01e0 AS lat0, -0.00027e0 AS dlat, 16 AS nrows, 16 AS ncols, 30.0e0 AS scale_m
        FROM supplier""",
    "cells": f"""
        SELECT s.s_suppkey AS area_id, CAST(g.r AS INT) AS r, CAST(h.c AS INT) AS c,
               coalesce(dem, 45.0e0) AS dem, coalesce(worldcover, 10) AS worldcover, coalesce(clay, 200) AS clay, coalesce(sand, 300) AS sand, coalesce(jrc, 0) AS jrc, coalesce(depth, 0.0e0) AS depth, coalesce(acc, 1) AS acc
        FROM supplier s CROSS JOIN {_GRID} LEFT JOIN (
            SELECT area_id, r, c, 40 + (sum(price) // (200 * count(*))) / 100.0e0 AS dem,
                   CASE max(qty) % 8 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 40 WHEN 4 THEN 50 WHEN 5 THEN 60 WHEN 6 THEN 80 ELSE 90 END AS worldcover,
                   CAST((sum(disc) * 60) // count(*) AS INT) AS clay, CAST((sum(tax) * 80) // count(*) AS INT) AS sand, CAST(min(tax) * 10 AS INT) AS jrc,
                   greatest((sum(disc) * 100) // count(*) - 300, 0) / 1000.0e0 AS depth, CAST(count(*) + sum(qty) AS INT) AS acc
            FROM lines GROUP BY area_id, r, c) a ON a.area_id = s.s_suppkey AND a.r = g.r AND a.c = h.c""",
    "plain": """
        SELECT CAST(7 AS BIGINT) AS area_id, r, c, u, 40.0e0 + (CASE WHEN (r // 20 + c // 60) % 3 = 0 THEN 0 ELSE u END + CASE WHEN r % 40 = 39 AND c % 160 <> 80 THEN 3000 ELSE 0 END) / 100.0e0 AS dem,
               CASE WHEN u % 100 < 60 THEN 16 + u % 50 ELSE 0 END / 100.0e0 AS depth, CASE WHEN u % 11 = 0 THEN 30.0e0 WHEN u % 3 = 0 THEN 0.5e0 ELSE 1.0e0 END AS mult, r % 32 = 16 AND c % 96 = 3 AS is_outfall
        FROM (SELECT CAST((o_orderkey * 4 + k) // 480 AS INT) AS r, CAST((o_orderkey * 4 + k) % 480 AS INT) AS c, (CAST(round(o_totalprice * 100) AS BIGINT) // (k + 1)) % 700 AS u
              FROM orders CROSS JOIN (VALUES (0), (1), (2), (3)) AS q(k)) AS p""",
    "ponds": """
        SELECT area_id, CAST(r * 480 + c AS BIGINT) AS sink_id, r, c, u * 1.0e0 AS volume_m3 FROM plain WHERE u % 50 = 7""",
    "sinks": """
        SELECT p_partkey % 5 + 5 * s_suppkey AS sink_id, s_suppkey AS area_id, CAST(max(p_partkey * 7 % 16) AS INT) AS r, CAST(max(p_partkey * 11 % 16) AS INT) AS c, max(p_size) * 100.0e0 AS volume_m3, max(p_size) / 20.0e0 AS max_depth_m
        FROM part JOIN supplier ON p_partkey % 50 = s_suppkey % 50 GROUP BY s_suppkey, p_partkey % 5""",
    "catch": """
        SELECT area_id, r, c, CASE WHEN acc % 7 < 5 THEN acc % 7 + 5 * area_id END AS sink_id FROM cells""",
    "stations": """
        SELECT n_nationkey AS station_id, CASE WHEN n_nationkey % 4 = 0 THEN 'SAMPLE ' ELSE '' END || n_name AS station, 25.6e0 + (n_nationkey % 5) * 0.02e0 AS lat, 85.0e0 + (n_nationkey % 9) * 0.12e0 AS lon, 2.0e0 + n_nationkey % 6 AS depth_to_water_m
        FROM nation""",
    "rain": """
        SELECT user_id AS point_id, user_id % 10 AS area_id, CAST(ts AS TIMESTAMP) AS ts, CAST(CAST(ts AS TIMESTAMP) AS DATE) AS day, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) % 4000 / 100.0e0 END AS mm, event_id
        FROM events""",
    "sar": """
        SELECT area_id, r, c, day, l_orderkey * 10 + k AS seq, CAST(extract(year FROM day) AS INT) AS yr, CAST(extract(month FROM day) AS INT) AS mon, -(qty / 2.0e0) AS vv FROM lines""",
    "runs": """
        SELECT area_id, k AS scenario_id, r, c, max(greatest(disc - 3, 0)) / 10.0e0 AS h FROM lines GROUP BY area_id, k, r, c""",
    "truth": """
        SELECT area_id, k AS event_id, r, c, CASE WHEN max(qty) > 25 THEN 1 ELSE 0 END AS wet, max(disc) / 10.0e0 AS pred FROM lines GROUP BY area_id, k, r, c""",
    "buildings": """
        SELECT c_custkey AS feature_id, s_suppkey AS area_id, 25.66e0 - (s_suppkey % 7) * 0.01e0 - (c_custkey * 7 % 20) * 0.00027e0 - 0.0001e0 AS lat, 85.0e0 + (s_suppkey % 100) * 0.01e0 + (c_custkey * 3 % 20) * 0.00027e0 + 0.0001e0 AS lon
        FROM customer JOIN supplier ON c_custkey % 50 = s_suppkey % 50""",
    "vertices": """
        SELECT l_orderkey AS feature_id, s.s_suppkey AS area_id, k AS n, 25.66e0 - (s.s_suppkey % 7) * 0.01e0 - (r * 1.2e0) * 0.00027e0 - 0.0001e0 AS lat, 85.0e0 + (s.s_suppkey % 100) * 0.01e0 + (c * 1.2e0 + k) * 0.00027e0 + 0.0001e0 AS lon
        FROM lines JOIN supplier s ON l_orderkey % 50 = s.s_suppkey % 50""",
}

#: What Spark reads in place of a view: the same rows. The view of sinks joins each part with each supplier of its class and only
#: then takes the greatest; here the parts of a class (50 rows in all) are taken together before they meet the suppliers.
PLANS = {
    "sinks": """
        SELECT /*+ BROADCAST(p) */ p.k + 5 * s.s_suppkey AS sink_id, s.s_suppkey AS area_id, p.r, p.c, p.size * 100.0e0 AS volume_m3, p.size / 20.0e0 AS max_depth_m
        FROM (SELECT DISTINCT s_suppkey FROM supplier) s JOIN (
            SELECT p_partkey % 50 AS class, p_partkey % 5 AS k, CAST(max(p_partkey * 7 % 16) AS INT) AS r, CAST(max(p_partkey * 11 % 16) AS INT) AS c, max(p_size) AS size
            FROM part GROUP BY p_partkey % 50, p_partkey % 5) p ON p.class = s.s_suppkey % 50""",
}


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views as DataFrames."""
    made = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}

    def get(name: str) -> DataFrame:
        if name not in made:
            text = PLANS.get(name, VIEWS[name])
            sql, needed = spark_text(text), {t for t in [*TABLES, *VIEWS] if reads(text, t)}
            for t in needed:
                sql = substitute(sql, t, "{" + t + "}")
            made[name] = spark.sql(sql, **{t: get(t) for t in needed})
        return made[name]

    return [get(n) for n in names]


def reads(sql: str, name: str) -> bool:
    return any(f" {word} {name}{end}" in f" {' '.join(sql.split())} " for word in ("FROM", "JOIN") for end in (" ", ")", ","))


def substitute(sql: str, name: str, by: str) -> str:
    sql = f" {' '.join(sql.split())} "
    pairs = [(f" {w} {name}{e}", f" {w} {by}{e}") for w in ("FROM", "JOIN") for e in (" ", ")", ",")]
    return reduce(lambda s, p: s.replace(*p), pairs, sql)


def spark_text(sql: str) -> str:
    return sql.replace("//", "div")


def oracle(sql: str) -> str:
    """A query over the views as one statement over the driver's tables."""
    needed, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in needed and reads(text, name):
                needed.add(name)
                todo.append(VIEWS[name])
    parts = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed]
    body = " ".join(sql.split())
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(parts)}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"
