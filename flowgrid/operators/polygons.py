"""Polygons: overlap by clipping, segments against boxes, points in regions with holes. Everything is column expressions.

A ring is an array of (x, y) without the first point again at the end. Polygons, segments and points meet on the tiles they touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgrid.functions.storage import materialize

RING = "array<struct<x: double, y: double>>"


def _tile(value: Column, tile: float) -> Column:
    return F.floor(value / F.lit(tile)).cast("bigint")


def _on_tiles(df: DataFrame, tile: float, bounds: dict[str, Column], tag: str = "") -> DataFrame:
    """``df`` once for each tile that its bounds touch, with the tile (tx, ty) and its least tile (lx, ly) under names with ``tag``."""
    at = {k: _tile(c, tile) for k, c in bounds.items()}
    rows = df.withColumns({f"lx{tag}": at["x0"], f"ly{tag}": at["y0"], "tx": F.sequence(at["x0"], at["x1"]), "ty": F.sequence(at["y0"], at["y1"])})
    return rows.withColumn("tx", F.explode("tx")).withColumn("ty", F.explode("ty"))


def _first_meeting(a: str, b: str) -> Column:
    """A pair of things that share several tiles counts at the first of them."""
    return (F.col("tx") == F.greatest(f"lx{a}", f"lx{b}")) & (F.col("ty") == F.greatest(f"ly{a}", f"ly{b}"))


def ring_bounds(ring: str) -> dict[str, Column]:
    side = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return {"x0": side(F.array_min, "x"), "y0": side(F.array_min, "y"), "x1": side(F.array_max, "x"), "y1": side(F.array_max, "y")}


def ring_segments(ring: str) -> Column:
    """The ring's sides as an array of (ax, ay, bx, by)."""
    return F.expr(f"transform({ring}, (p, k) -> named_struct('ax', p.x, 'ay', p.y, 'bx', {ring}[(k + 1) % size({ring})].x, 'by', {ring}[(k + 1) % size({ring})].y))")


def signed_area(ring: str) -> Column:
    """Half the sum of cross products, measured from the ring's first point; above 0 if it runs counter-clockwise."""
    terms = f"""transform({ring}, (p, k) -> (p.x - {ring}[0].x) * ({ring}[(k + 1) % size({ring})].y - {ring}[0].y) - ({ring}[(k + 1) % size({ring})].x - {ring}[0].x) * (p.y - {ring}[0].y))"""
    return F.expr(f"if(size({ring}) < 3, 0D, aggregate({terms}, 0D, (s, v) -> s + v) / 2)")


def is_convex(ring: str) -> Column:
    """No corner turns against the others (by more than rounding)."""
    at = lambda n: f"{ring}[(k + {n}) % size({ring})]"
    turns = f"transform({ring}, (p, k) -> ({at(1)}.x - p.x) * ({at(2)}.y - {at(1)}.y) - ({at(1)}.y - p.y) * ({at(2)}.x - {at(1)}.x))"
    return F.expr(f"not (array_min({turns}) < -1e-9 * array_max(transform({turns}, v -> abs(v))) and array_max({turns}) > 1e-9 * array_max(transform({turns}, v -> abs(v))))")


def clipped(ring: str, window: str) -> Column:
    """What is left of ``ring`` (any simple polygon) inside ``window`` (a convex ring), cut by the line of each of its sides in turn.

    Parts of a concave ring stay joined by seams along the window, which have no area.
    """
    at = f"{window}[(k + 1) % size({window})]"
    # left of the line is inside; a window that runs clockwise has it on the right
    lines = f"transform({window}, (p, k) -> named_struct('x', p.x, 'y', p.y, 'u', ({at}.x - p.x) * way, 'v', ({at}.y - p.y) * way))"
    side = lambda p: f"(l.u * ({p}.y - l.y) - l.v * ({p}.x - l.x))"
    cut = "named_struct('x', p.x + (q.x - p.x) * s / (s - t), 'y', p.y + (q.y - p.y) * s / (s - t))"
    # with each corner p its side s and the next corner q with its side t
    corners = f"transform(r, (p, k) -> named_struct('p', p, 'q', r[(k + 1) % size(r)], 's', {side('p')}, 't', {side('r[(k + 1) % size(r)]')}))"
    cut = cut.replace("p.", "c.p.").replace("q.", "c.q.").replace(" s ", " c.s ").replace("(s - t)", "(c.s - c.t)")
    kept = f"flatten(transform({corners}, c -> concat(if(c.s >= 0, array(c.p), cast(array() as {RING})), if(c.s * c.t < 0, array({cut}), cast(array() as {RING})))))"
    way = f"if(aggregate(transform({window}, (p, k) -> p.x * {at}.y - {at}.x * p.y), 0D, (a, v) -> a + v) < 0, -1D, 1D)"
    return F.expr(f"aggregate({lines.replace('way', way)}, cast({ring} as {RING}), (r, l) -> cast({kept} as {RING}))")


def polygon_overlap(source: DataFrame, target: DataFrame, tile: float, most: float = 1.01) -> DataFrame:
    """idx, population: what each target polygon gets of the source polygons' population by shared area.

    ``source``: idx, ring (convex, as hexagons are), population; ``target``: idx, ring (any simple polygon). Targets that meet no
    source with population are left out, as are rings of under three points; null populations count as none. A source that isn't
    convex, or that gives a target more than ``most`` of itself, is an error: the shapes overlap themselves. Both tables are stored first,
    so a polygon is tested once, not for every row that it was made from.
    """
    s = materialize(source.select(F.col("idx").alias("source"), F.col("ring").cast(RING).alias("shape"), F.col("population").cast("double").alias("population")), "polygons")
    t = materialize(target.select(F.col("idx").alias("target"), F.col("ring").cast(RING).alias("ring")), "polygons")
    s, t = s.filter((F.col("population") > 0) & (F.size("shape") > 2)), t.filter(F.size("ring") > 2)
    s = s.withColumn("area", F.abs(signed_area("shape"))).filter(F.when(~is_convex("shape"), F.raise_error(F.lit("a source polygon is not convex")).cast("boolean")).otherwise(F.col("area") > 0))
    pairs = _on_tiles(s, tile, ring_bounds("shape"), "_s").join(_on_tiles(t, tile, ring_bounds("ring"), "_t"), ["tx", "ty"]).filter(_first_meeting("_s", "_t"))
    shared = pairs.withColumn("part", clipped("ring", "shape"))
    shared = shared.withColumn("share", F.abs(signed_area("part")) / F.col("area")).filter("share > 0")
    share = F.when(F.col("share") <= most, F.col("share")).otherwise(F.raise_error(F.lit("a source polygon lies in a target with more than its area")).cast("double"))
    return shared.groupBy(F.col("target").alias("idx")).agg(F.sum(F.col("population") * share).alias("population"))


def segments_in_boxes(segments: DataFrame, boxes: DataFrame, tile: float) -> DataFrame:
    """Box (idx), segment (its columns), t0, t1: the stretch of each segment in each closed box that it touches, as shares of its length.

    ``segments``: ax, ay, bx, by and others; ``boxes``: idx, minx, miny, maxx, maxy. A segment's line is cut at a box's four sides: it enters
    at the last of its entries and leaves at the first of its exits.
    """
    low, high = lambda a, b: F.least(a, b), lambda a, b: F.greatest(a, b)
    ends = {"x0": low("ax", "bx"), "y0": low("ay", "by"), "x1": high("ax", "bx"), "y1": high("ay", "by")}
    sides = {"x0": F.col("minx"), "y0": F.col("miny"), "x1": F.col("maxx"), "y1": F.col("maxy")}
    pairs = _on_tiles(segments, tile, ends, "_s").join(_on_tiles(boxes.select("idx", "minx", "miny", "maxx", "maxy"), tile, sides, "_b"), ["tx", "ty"]).filter(_first_meeting("_s", "_b"))
    enter, leave, beside = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for a, b, lo, hi in (("ax", "bx", "minx", "maxx"), ("ay", "by", "miny", "maxy")):
        step = F.col(b) - F.col(a)
        first, second = F.try_divide(F.col(lo) - F.col(a), step), F.try_divide(F.col(hi) - F.col(a), step)
        enter.append(F.least(first, second))
        leave.append(F.greatest(first, second))
        beside = beside | ((step == 0) & ((F.col(a) < F.col(lo)) | (F.col(a) > F.col(hi))))
    # a segment along one axis has no entry on it
    cut = pairs.filter(~beside).withColumns({"t0": F.greatest(*enter), "t1": F.least(*leave)}).filter("t0 <= t1")
    return cut.select("idx", "minx", "miny", "maxx", "maxy", *segments.columns, "t0", "t1")


def covering(polygons: DataFrame, tile: float) -> DataFrame:
    """polygon, tx, ty, sides: the tiles that a polygon covers. ``sides`` is null where the whole tile is inside, else all of its sides.

    ``polygons``: polygon, ring and, if there are any, holes (an array of rings). A tile that no side touches is inside or outside as
    its centre is, so it takes one ray for all of its points.
    """
    rings = F.array(F.col("ring").cast(RING))
    if "holes" in polygons.columns:
        rings = F.concat(rings, F.coalesce(F.col("holes").cast(f"array<{RING}>"), F.array().cast(f"array<{RING}>")))
    shapes = polygons.filter(F.size("ring") > 2).select("polygon", F.col("ring").cast(RING).alias("ring"), F.explode(rings).alias("r"))
    shapes = shapes.groupBy("polygon").agg(F.first("ring").alias("ring"), F.flatten(F.collect_list(ring_segments("r"))).alias("sides"))
    tiles = _on_tiles(shapes, tile, ring_bounds("ring")).select("polygon", "sides", "tx", "ty")
    lo = {k: f"t{k} * {tile!r}D" for k in "xy"}
    hi = {k: f"(t{k} + 1) * {tile!r}D" for k in "xy"}
    # no side meets the closed tile: bounds apart, or all corners on one side of the side's line
    turn = lambda x, y: f"(s.bx - s.ax) * ({y} - s.ay) - (s.by - s.ay) * ({x} - s.ax)"
    turns = ", ".join(turn(x[k], y[m]) for k in "x" for m in "y" for x in (lo, hi) for y in (lo, hi))
    touched = F.expr(f"""exists(sides, s -> least(s.ax, s.bx) <= {hi['x']} and greatest(s.ax, s.bx) >= {lo['x']} and least(s.ay, s.by) <= {hi['y']} and greatest(s.ay, s.by) >= {lo['y']}
        and least({turns}) <= 0 and greatest({turns}) >= 0)""")
    tiles = tiles.withColumn("touched", touched).filter(F.col("touched") | _inside("sides", f"(tx + 0.5D) * {tile!r}D", f"(ty + 0.5D) * {tile!r}D"))
    return tiles.select("polygon", "tx", "ty", F.when(F.col("touched"), F.col("sides")).alias("sides"))


def _inside(sides: str, x: str, y: str) -> Column:
    """A ray to the right crosses an odd number of sides."""
    return F.expr(f"""size(filter({sides}, s -> (s.ay > {y}) <> (s.by > {y}) and {x} < (s.bx - s.ax) * ({y} - s.ay) / nullif(s.by - s.ay, 0) + s.ax)) % 2 = 1""")


def point_in_polygon(points: DataFrame, polygons: DataFrame, tile: float, x: str = "x", y: str = "y", several: str = "keep", key: str | None = None) -> DataFrame:
    """Points (all columns) with ``polygon``, the id of a polygon that holds them.

    ``polygons``: polygon, ring, and holes if there are any. Points meet the polygons that cover their tile; only those in a tile
    with a side cast a ray. Points without a coordinate are in none. A point in several polygons comes once for each ('keep'),
    is left out ('skip'), or is an error ('raise'); for the last two ``key`` names a column that tells points apart.
    """
    at = points.withColumns({"tx": _tile(F.col(x), tile), "ty": _tile(F.col(y), tile)})
    held = at.join(covering(polygons, tile), ["tx", "ty"]).filter(F.col("sides").isNull() | _inside("sides", f"`{x}`", f"`{y}`")).drop("tx", "ty", "sides")
    if several == "keep":
        return held
    alone = F.count("*").over(Window.partitionBy(key)) == 1  # the polygons around one point
    if several == "raise":
        alone = F.when(alone, True).otherwise(F.raise_error(F.lit("a point is in several polygons")).cast("boolean"))
    return held.withColumn("_alone", alone).filter("_alone").drop("_alone")


def boundary_class(cells: DataFrame, outline: DataFrame, tile: float) -> DataFrame:
    """``cells`` (idx, minx, miny, maxx, maxy and others) with position and relation_to_line.

    ``outline``: polygon, ring; the polygons may be concave. position: inside if the cell meets one of them, else outside.
    relation_to_line: edge if the boundary of the convex hull of all their corners runs through the cell's interior, else none;
    a cell that holds the whole hull isn't crossed by it. Without an outline all cells are outside.
    """
    from flowgrid.operators.tiling import convex_hull

    shapes = outline.filter(F.size("ring") > 2).select("polygon", F.col("ring").cast(RING).alias("ring"))
    sides = shapes.select(F.explode(ring_segments("ring")).alias("s")).select("s.*")
    met = segments_in_boxes(sides, cells, tile).select("idx")
    centers = cells.select("idx", ((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    inside = met.unionByName(point_in_polygon(centers, shapes, tile).select("idx")).distinct().withColumn("_met", F.lit(True))

    corners = shapes.select(F.explode("ring").alias("p")).select(F.lit(0).alias("one"), "p.x", "p.y")
    ring = Window.partitionBy("g")  # the corners of a hull
    after = lambda c: F.coalesce(F.lead(c).over(ring.orderBy("at")), F.first(c).over(ring.orderBy("at")))
    ends = lambda f, c: f(c).over(ring)
    hull = convex_hull(corners, "one").select(F.col("x").alias("ax"), F.col("y").alias("ay"), after("x").alias("bx"), after("y").alias("by"), *[ends(f, c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"])
    through = segments_in_boxes(hull, cells, tile).filter("t0 < t1")
    middle = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (F.col("t0") + F.col("t1")) / 2
    x, y = middle("ax", "bx"), middle("ay", "by")
    whole = (F.col("lo_x") >= F.col("minx")) & (F.col("hi_x") <= F.col("maxx")) & (F.col("lo_y") >= F.col("miny")) & (F.col("hi_y") <= F.col("maxy"))
    strictly = (x > F.col("minx")) & (x < F.col("maxx")) & (y > F.col("miny")) & (y < F.col("maxy"))
    crossed = through.filter(strictly & ~whole).select("idx").distinct().withColumn("_crossed", F.lit(True))
    out = cells.join(inside, "idx", "left").join(crossed, "idx", "left")
    position, relation = F.when(F.col("_met"), "inside").otherwise("outside"), F.when(F.col("_crossed"), "edge").otherwise("none")
    return out.withColumns({"position": position, "relation_to_line": relation}).drop("_met", "_crossed")
