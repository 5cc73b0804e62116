"""Grids, rings and other tilings: where points lie, how cells relate, how population moves between tilings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance on the sphere."""
    lon1, lat1, lon2, lat2 = (F.col(c) if isinstance(c, str) else c for c in (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def tangent_xy(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """Metres east and north of (lat0, lon0) on the local plane. Callers that swap the axes pass x as ``lat``."""
    lat, lon, lat0, lon0 = (F.col(c) if isinstance(c, str) else c for c in (lat, lon, lat0, lon0))
    c = F.lit(6e4) * (F.lit(1.85533) - F.lit(0.006222) * F.sin(F.radians(lat0)))
    return c * F.cos(F.radians(lat0)) * (lon - lon0), c * (lat - lat0)


def cell_area_km2(minx, miny, maxx, maxy) -> Column:
    """Product of a box's side lengths on the local plane at its lower corner."""
    x, _ = tangent_xy(F.col(miny), F.col(maxx), F.col(miny), F.col(minx))
    _, y = tangent_xy(F.col(maxy), F.col(minx), F.col(miny), F.col(minx))
    return x * y / F.lit(1e6)


def make_grid(spark: SparkSession, box: tuple[float, float, float, float], size: float) -> DataFrame:
    """idx, i, j, minx, miny, maxx, maxy, cx, cy of the boxes that cover ``box``, cut at its upper edges."""
    nx, ny = (math.ceil(round((box[k + 2] - box[k]) / size, 9)) for k in (0, 1))
    g = spark.range(nx * ny).select(F.col("id").alias("idx"), F.floor(F.col("id") / F.lit(float(ny))).alias("i"), (F.col("id") % ny).alias("j"))
    g = g.withColumns({"minx": F.lit(box[0]) + F.col("i") * size, "miny": F.lit(box[1]) + F.col("j") * size})
    g = g.withColumns({"maxx": F.least(F.col("minx") + size, F.lit(box[2])), "maxy": F.least(F.col("miny") + size, F.lit(box[3]))})
    return g.withColumns({"cx": (F.col("minx") + F.col("maxx")) / 2, "cy": (F.col("miny") + F.col("maxy")) / 2})


def locate(points: DataFrame, box: tuple[float, float, float, float], size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Adds cell: the number of the grid cell that holds the point strictly inside, null outside the box or on a line."""
    ny = math.ceil(round((box[3] - box[1]) / size, 9))
    fx, fy = F.round((F.col(x) - F.lit(box[0])) / F.lit(size), 9), F.round((F.col(y) - F.lit(box[1])) / F.lit(size), 9)
    inside = (F.col(x) > box[0]) & (F.col(x) < box[2]) & (F.col(y) > box[1]) & (F.col(y) < box[3]) & (fx != F.floor(fx)) & (fy != F.floor(fy))
    return points.withColumn("cell", F.when(inside, F.floor(fx) * ny + F.floor(fy)))


def outside_share(located: DataFrame) -> DataFrame:
    return located.agg((F.count_if(F.col("cell").isNull()) / F.count("*")).alias("outside"))


def outside_gate(located: DataFrame, most: float = 0.4) -> DataFrame:
    """``located``, or an error if too many points are outside."""
    share = outside_share(located).first().outside
    if share is not None and share > most:
        raise ValueError(f"{share:.1%} of the points are in no cell")
    return located


def with_roads(cells: DataFrame, located: DataFrame) -> DataFrame:
    """Adds with_roads: the cell holds a node."""
    hit = located.filter("cell is not null").select(F.col("cell").alias("idx")).distinct().withColumn("with_roads", F.lit(True))
    return cells.join(hit, "idx", "left").fillna(False, ["with_roads"])


def cell_pairs(cells: DataFrame) -> DataFrame:
    """i, j, distance (km) and unit direction (dx, dy) of all pairs of cells; the direction of a cell to itself is 0.

    The result is all pairs by definition. The cells of one city (a few thousand) are the side that Spark may broadcast.
    """
    a = cells.select(F.col("idx").alias("i"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    b = cells.select(F.col("idx").alias("j"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    norm = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    unit = lambda p, q: F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col(p) - F.col(q), norm), F.lit(0.0)))
    return a.crossJoin(b).select("i", "j", haversine_km("ax", "ay", "bx", "by").alias("distance"), unit("bx", "ax").alias("dx"), unit("by", "ay").alias("dy"))


def lattice_edges(cells: DataFrame) -> DataFrame:
    """a, b, way ('i' or 'j'), dx, dy (swapped-axes local metres), distance (km), inv_dx, inv_dy (0 for none) of grid neighbours."""
    a = cells.select(F.col("idx").alias("a"), F.col("i").alias("ai"), F.col("j").alias("aj"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    step = F.explode(F.array(F.struct(F.lit(1).alias("si"), F.lit(0).alias("sj"), F.lit("i").alias("way")), F.struct(F.lit(0).alias("si"), F.lit(1).alias("sj"), F.lit("j").alias("way"))))
    b = cells.select(F.col("idx").alias("b"), F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    e = a.withColumn("s", step).withColumns({"bi": F.col("ai") + F.col("s.si"), "bj": F.col("aj") + F.col("s.sj")}).join(b, ["bi", "bj"])
    x, y = tangent_xy("bx", "by", "ax", "ay")
    inverse = lambda v: F.coalesce(F.try_divide(F.lit(1.0), F.round(v, 6)), F.lit(0.0))
    return e.select("a", "b", F.col("s.way").alias("way"), x.alias("dx"), y.alias("dy"), haversine_km("ax", "ay", "bx", "by").alias("distance"), F.atan2(y, x).alias("angle"), inverse(x).alias("inv_dx"), inverse(y).alias("inv_dy"))


def rings(points: DataFrame, center: tuple[float, float], radius: float, n: int, x: str = "cx", y: str = "cy") -> DataFrame:
    """Adds r_km and ring: which of ``n`` bands of equal width up to ``radius`` km the point is in; null beyond."""
    r = F.round(haversine_km(F.lit(center[0]), F.lit(center[1]), F.col(x), F.col(y)), 9)
    ring = F.floor(r / F.lit(radius / n))
    return points.withColumn("r_km", r).withColumn("ring", F.when(ring < n, ring))


def area_overlap(source: DataFrame, target: DataFrame, tile: float) -> DataFrame:
    """idx, population: what each target box gets of the source boxes' population by shared area.

    Boxes meet on the tiles they touch; a pair that shares several tiles counts at the first.
    """
    def tiles(df: DataFrame, tag: str) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.round(F.col(lo) / F.lit(tile), 6)).cast("bigint"), F.floor(F.round(F.col(hi) / F.lit(tile), 6)).cast("bigint"))
        rows = df.select(*[F.col(c).alias(f"{c}_{tag}") for c in ("idx", "minx", "miny", "maxx", "maxy", "population")], span("minx", "maxx").alias("tx"), span("miny", "maxy").alias("ty"))
        return rows.withColumn("tx", F.explode("tx")).withColumn("ty", F.explode("ty"))

    pairs = tiles(source, "s").join(tiles(target, "t"), ["tx", "ty"]).drop("tx", "ty").distinct()
    side = lambda lo, hi: F.greatest(F.least(f"{hi}_s", f"{hi}_t") - F.greatest(f"{lo}_s", f"{lo}_t"), F.lit(0.0))
    share = side("minx", "maxx") * side("miny", "maxy") / ((F.col("maxx_s") - F.col("minx_s")) * (F.col("maxy_s") - F.col("miny_s")))
    return pairs.groupBy(F.col("idx_t").alias("idx")).agg(F.sum(F.col("population_s") * share).alias("population"))


def metric_grid(polygons: DataFrame, size: float) -> DataFrame:
    """component, i, j, x, y, inside: squares of ``size`` metres over the polygons' common bounds, once for each component.

    ``polygons``: component (0, 1, ...) and ring in metres. x and y are a square's lower corner; inside: one polygon holds
    all four corners. The numbers i and j of a component start at the squares before it times its own number. An empty
    table gives no square; polygons without a ring are left out.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    shapes = polygons.filter(F.size("ring") > 0)
    ext = shapes.agg(F.min(F.array_min(xs)).alias("x0"), F.min(F.array_min(ys)).alias("y0"), F.max(F.array_max(xs)).alias("x1"), F.max(F.array_max(ys)).alias("y1"))
    steps = lambda a, b: F.ceil((F.col(b) - F.col(a)) / F.lit(size))
    ext = ext.filter("x0 is not null").withColumns({"nx": steps("x0", "x1"), "ny": steps("y0", "y1")})
    squares = ext.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)))
    squares = squares.withColumns({"x": F.col("x0") + F.col("i") * size, "y": F.col("y0") + F.col("j") * size})
    # a hair inwards, so that a square that ends on the outline counts
    e = size * 1e-9
    corner = F.explode(F.array(*[F.struct((F.col("x") + a).alias("px"), (F.col("y") + b).alias("py")) for a in (e, size - e) for b in (e, size - e)])).alias("c")
    corners = squares.select("i", "j", corner).select("i", "j", "c.px", "c.py")
    from flowgrid.operators.polygons import point_in_polygon

    held = point_in_polygon(corners, shapes.select(F.col("component").alias("polygon"), "ring"), 10 * size, "px", "py")
    inside = held.groupBy("i", "j", "polygon").count().filter("count = 4").select("i", "j", F.lit(True).alias("holds")).distinct()
    rows = squares.join(inside, ["i", "j"], "left").crossJoin(F.broadcast(shapes.select("component").distinct()))  # a city's components
    shift = F.col("nx") * F.col("ny") * F.col("component") * F.col("component")
    return rows.select("component", (F.col("i") + shift).alias("i"), (F.col("j") + shift).alias("j"), "x", "y", F.coalesce("holds", F.lit(False)).alias("inside"))


def zonal_sum(pixels: DataFrame, box, size: float) -> DataFrame:
    """cell, value: sum of the pixels (x, y, value) inside each cell, negative ones as 0."""
    return locate(pixels, box, size).filter("cell is not null").groupBy("cell").agg(F.sum(F.greatest("value", F.lit(0))).alias("value"))


def refine(points: DataFrame, box, sizes: list[float]) -> DataFrame:
    """size, cell, n: points per cell for several grid sizes in one job."""
    rows = [locate(points, box, s).withColumn("size", F.lit(s)).select("size", "cell") for s in sizes]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.filter("cell is not null").groupBy("size", "cell").agg(F.count("*").alias("n"))


def polar(df: DataFrame, center: tuple[float, float], x: str = "cx", y: str = "cy") -> DataFrame:
    """Adds r (of the offsets) and theta = atan(y / x), null on the vertical."""
    dx, dy = F.col(x) - F.lit(center[0]), F.col(y) - F.lit(center[1])
    return df.withColumns({"r": F.sqrt(dx * dx + dy * dy), "theta": F.atan(F.try_divide(dy, dx))})


def convex_hull(points: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """group, at, x, y: the corners of each group's hull, counter-clockwise from the leftmost.

    Every partition reduces its points to hulls first, so a group of any size reaches one task as few points.
    """
    import pandas as pd

    def hull(p):
        p = sorted(set(p))
        if len(p) < 3:
            return p

        def half(q):
            out = []
            for z in q:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (z[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (z[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(z)
            return out[:-1]

        return half(p) + half(p[::-1])

    def local(batches):
        for b in batches:
            for g, part in b.groupby("g"):
                h = hull(list(zip(part.x, part.y)))
                yield pd.DataFrame({"g": g, "x": [q[0] for q in h], "y": [q[1] for q in h]})

    def final(pdf):
        h = hull(list(zip(pdf.x, pdf.y)))
        return pd.DataFrame({"g": pdf.g.iloc[0], "at": range(len(h)), "x": [q[0] for q in h], "y": [q[1] for q in h]})

    rows = points.select(F.col(by).cast("long").alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return rows.mapInPandas(local, "g long, x double, y double").groupBy("g").applyInPandas(final, "g long, at long, x double, y double")
