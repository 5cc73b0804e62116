"""The urban-mobility tables as views over the driver's tables: text that Spark and DuckDB both read.

They stand for inputs, not for operators: the queries read them through ``view``, the oracles through ``with_views``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events".split()

# Road class, speed in mph and capacity of a lane for each kind of part.
CLASSES = [("ECONOMY", "tertiary", 20, 1200), ("SMALL", "unclassified", 20, 800), ("STANDARD", "secondary", 25, 1400), ("MEDIUM", "primary", 30, 1600), ("LARGE", "trunk", 45, 1800), ("PROMO", "motorway", 50, 2000)]


def _case(column: int) -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return "CASE p_type " + " ".join(f"WHEN '{c[0]}' THEN {quote(c[column])}" for c in CLASSES) + " END"


VIEWS = {
    "node_count": "SELECT count(*) AS n_nodes FROM part",
    "edges": f"""SELECT p_partkey AS uniqueid, (37 * p_partkey + 11) % n_nodes AS u, (101 * p_partkey + 17 * p_size + 53) % n_nodes AS v,
        cast(1000 + 200 * p_size AS double) AS length, cast(1 + p_size % 4 AS bigint) AS lanes, {_case(1)} AS highway,
        cast({_case(2)} AS bigint) AS speed_mph, cast({_case(3)} * (1 + p_size % 4) AS bigint) AS capacity FROM part CROSS JOIN node_count""",
    "routes": """SELECT l_orderkey AS p, l_partkey AS route, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS bigint) AS pos FROM lineitem""",
    "people": """SELECT o_orderkey AS p, o_custkey, cast(21600 + (7919 * o_orderkey) % 10800 AS bigint) AS time_departure, coalesce(d, cast(0 AS double)) AS distance,
        cast(floor(coalesce(d, cast(0 AS double)) / (3 + o_custkey % 12)) AS bigint) AS num_steps,
        cast(21600 + (7919 * o_orderkey) % 10800 + floor(coalesce(d, cast(0 AS double)) / (3 + o_custkey % 12)) AS bigint) AS last_time_simulated
        FROM orders LEFT JOIN (SELECT p, sum(length) AS d FROM routes JOIN edges ON route = uniqueid GROUP BY p) AS w ON o_orderkey = p""",
    "runs": """SELECT o_orderkey AS p, cast(1 + n_regionkey AS bigint) AS uci10,
        cast(100 + 20 * CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS bigint) AS r
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "cells": """SELECT cast(n_nationkey AS bigint) AS idx, cast(floor(n_nationkey / 5) AS bigint) AS i, cast(n_nationkey % 5 AS bigint) AS j,
        cast(-71.2 AS double) + cast(0.02 AS double) * floor(n_nationkey / 5) AS cx, cast(42.2 AS double) + cast(0.02 AS double) * (n_nationkey % 5) AS cy,
        cast(coalesce(population, 0) AS bigint) AS population,
        CASE WHEN n_nationkey IN (0, 24) THEN 'outside' ELSE 'inside' END AS position,
        CASE WHEN floor(n_nationkey / 5) IN (0, 4) OR n_nationkey % 5 IN (0, 4) THEN 'edge' ELSE 'none' END AS relation_to_line
        FROM nation LEFT JOIN (SELECT c_nationkey, sum(cast(1 + floor(abs(c_acctbal) / 100) AS bigint)) AS population FROM customer GROUP BY c_nationkey) AS q ON c_nationkey = n_nationkey""",
    "tij": """SELECT cast(c_nationkey AS bigint) AS origin, cast(s_nationkey AS bigint) AS destination, count(*) AS number_people
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY c_nationkey, s_nationkey""",
    "nodes": """SELECT cast(p_partkey AS bigint) AS index, cast(1000000 + 17 * p_partkey AS bigint) AS osmid, cast(-71.21 AS double) + cast(0.0001 AS double) * (p_partkey % 1000) AS x,
        cast(42.19 AS double) + cast(0.0001 AS double) * ((p_partkey * 7 + cast(floor(p_partkey / 1000) AS bigint)) % 1000) AS y FROM part""",
    "raw_roads": f"""SELECT p_partkey AS uniqueid, (37 * p_partkey + 11) % n_nodes AS u, (101 * p_partkey + 17 * p_size + 53) % n_nodes AS v, CASE WHEN p_partkey % 11 = 3 THEN 'road' WHEN p_partkey % 11 = 7 THEN 'service' WHEN p_partkey % 11 = 8 THEN 'living_street'
        WHEN p_partkey % 11 = 5 AND p_type <> 'SMALL' THEN concat({_case(1)}, '_link') ELSE {_case(1)} END AS highway, p_size % 2 = 0 AS oneway,
        CASE p_partkey % 6 WHEN 0 THEN '35 mph' WHEN 1 THEN '40' WHEN 2 THEN '["30 mph", "40 mph"]' WHEN 3 THEN '35;45' WHEN 4 THEN 'signals' END AS maxspeed,
        CASE p_partkey % 5 WHEN 0 THEN '2' WHEN 1 THEN '["2", "3"]' WHEN 2 THEN '3-4' WHEN 3 THEN '2;3' END AS lanes FROM part CROSS JOIN node_count""",
    "boxes": "SELECT idx, cx - cast(0.01 AS double) AS minx, cy - cast(0.01 AS double) AS miny, cx + cast(0.01 AS double) AS maxx, cy + cast(0.01 AS double) AS maxy, population FROM cells",
}
#: The oracles' own statements of results that many of them start from.
DERIVED = {
    "pairs": """SELECT a.idx AS i, b.idx AS j, round(2 * 6371.0088::double * asin(sqrt(pow(sin(radians(b.cy - a.cy) / 2), 2) + cos(radians(a.cy)) * cos(radians(b.cy)) * pow(sin(radians(b.cx - a.cx) / 2), 2))), 9) AS distance,
        CASE WHEN a.idx = b.idx THEN 0::double ELSE (b.cx - a.cx) / sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy)) END AS dx,
        CASE WHEN a.idx = b.idx THEN 0::double ELSE (b.cy - a.cy) / sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy)) END AS dy
        FROM cells a CROSS JOIN cells b""",
    "traj": """SELECT *, time_leaving_road - own AS time_entering_road FROM (
        SELECT *, time_departure + sum(own) OVER (PARTITION BY p ORDER BY pos ROWS UNBOUNDED PRECEDING) AS time_leaving_road FROM (
        SELECT p, pos, route, length, capacity, speed_mph, time_departure, last_time_simulated, distance, distance / num_steps * 3.6::double AS kmh, length / (distance / num_steps) AS own
        FROM routes JOIN people USING (p) JOIN edges ON route = uniqueid WHERE num_steps <> 0 AND distance / num_steps * 3.6::double < 150))""",
    "spine": "SELECT cast(unnest(range(95)) AS BIGINT) AS k",
    "unload": """SELECT g.uci10, g.r, s.k, cast(coalesce(n_rows, 0) AS BIGINT) AS n_rows, cast(coalesce(n_people, 0) AS BIGINT) AS n_people
        FROM (SELECT DISTINCT uci10, r FROM runs JOIN traj USING (p) WHERE time_departure >= 25200 AND time_departure < 28800) g CROSS JOIN spine s LEFT JOIN
        (SELECT uci10, r, ((last_time_simulated + 1) * 95 - 1) // 86400 AS k, count(*) AS n_rows, count(DISTINCT p) AS n_people FROM traj JOIN runs USING (p)
         WHERE time_departure >= 25200 AND time_departure < 28800 GROUP BY ALL) x ON x.uci10 = g.uci10 AND x.r = g.r AND x.k = s.k AND s.k < 94""",
    "fits": """SELECT uci10, r, w.t0, w.t AS t, count(*) AS n, regr_slope(ln(y), ln(x)) AS alpha_pl, exp(regr_intercept(ln(y), ln(x))) AS a_pl,
        round(sqrt(greatest((regr_syy(ln(y), ln(x)) - pow(regr_sxy(ln(y), ln(x)), 2) / regr_sxx(ln(y), ln(x))) / count(*), 0)), 12) AS err_pl,
        regr_slope(ln(y), x) AS alpha_exp, exp(regr_intercept(ln(y), x)) AS a_exp,
        round(sqrt(greatest((regr_syy(ln(y), x) - pow(regr_sxy(ln(y), x), 2) / regr_sxx(ln(y), x)) / count(*), 0)), 12) AS err_exp
        FROM (SELECT uci10, r, i, t - max(CASE WHEN i = 3 THEN t END) OVER (PARTITION BY uci10, r) AS x, lag(n) OVER (PARTITION BY uci10, r ORDER BY i) AS y FROM curve) c
        JOIN (SELECT uci10, r, i AS t0, t FROM curve WHERE i >= 10) w USING (uci10, r) WHERE c.i >= 4 AND c.i < w.t0 GROUP BY ALL""",
    "curve": """SELECT uci10, r, cast(row_number() OVER (PARTITION BY uci10, r ORDER BY k) - 1 AS BIGINT) AS i, k, cast(cast(floor(k * 86400 / 95.0) AS BIGINT) AS DOUBLE) / 3600 AS t, cast(n_rows AS DOUBLE) AS n FROM unload WHERE n_rows > 0""",
}
ORDER = [*VIEWS, "pairs", "traj", "spine", "unload", "curve", "fits"]


def _needed(sql: str) -> list[str]:
    texts, need = VIEWS | DERIVED, set()

    def visit(text: str) -> None:
        for name in ORDER:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need.add(name)
                visit(texts[name])

    visit(sql)
    return [n for n in ORDER if n in need]


def with_views(sql: str) -> str:
    """A DuckDB query over the views, with those it needs in front."""
    names = _needed(sql)
    if not names:
        return sql
    head = ",\n".join(f"{n} AS ({(VIEWS | DERIVED)[n]})" for n in names)
    recursive = "RECURSIVE " if re.match(r"\s*WITH RECURSIVE", sql) else ""
    body = re.sub(r"^\s*WITH (RECURSIVE )?", "", sql) if re.match(r"\s*WITH ", sql) else None
    return f"WITH {recursive}{head}" + (f",\n{body}" if body else f"\n{sql}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame."""
    names = [n for n in _needed(f"FROM {name}")]
    text = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    used = [t for t in BASE if re.search(rf"\b{t}\b", text)]
    frames = {f"t_{t}": table(spark, sf_dir, t) for t in used}
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{t_{t}}}", text)
    return spark.sql(f"WITH {text} SELECT * FROM {name}", **frames)
