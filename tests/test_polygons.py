"""Overlap, crossing and covering of polygons by hand-made shapes."""

import pytest
from pyspark.sql import functions as F

from flowgrid.operators import polygons

SHAPES = "idx long, ring array<struct<x: double, y: double>>, population long"


def overlap(spark, source, target, tile=1.0):
    s = spark.createDataFrame([(k, r, p) for k, (r, p) in enumerate(source)], SHAPES)
    t = spark.createDataFrame([(k, r, 0) for k, r in enumerate(target)], SHAPES)
    return {r.idx: r.population for r in polygons.polygon_overlap(s, t, tile).collect()}


def hexagon(x, y, r):
    h = 0.75**0.5
    return [(x + r * a, y + r * b) for a, b in ((1, 0), (0.5, h), (-0.5, h), (-1, 0), (-0.5, -h), (0.5, -h))]


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_concave_target(spark):
    ell = [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]
    # the source square has a quarter outside of the L's notch
    assert overlap(spark, [(square(0.5, 0.5, 1.5, 1.5), 400)], [ell]) == pytest.approx({0: 300.0})
    # both arms of a U meet the source; what lies between them doesn't count
    u = [(0.0, 0.0), (5.0, 0.0), (5.0, 4.0), (4.0, 4.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]
    assert overlap(spark, [(square(0.0, 2.0, 5.0, 3.0), 500)], [u, u[::-1]]) == pytest.approx({0: 200.0, 1: 200.0})


def test_population_is_conserved_in_any_direction_and_tiling(spark):
    source = [(hexagon(0.3 + 1.5 * i, 0.2 + 1.3 * j, 0.9)[:: (-1) ** (i + j)], 100 + i) for i in range(4) for j in range(4)]
    target = [square(-2.0 + 2 * i, -2.0 + 2 * j, 2.0 * i, 2.0 * j) for i in range(6) for j in range(6)]
    first = overlap(spark, source, target, 1.0)
    assert sum(first.values()) == pytest.approx(sum(p for _, p in source))
    for tile in (0.31, 7.0):
        assert overlap(spark, source, target, tile) == pytest.approx(first)


def test_odd_shapes(spark):
    assert overlap(spark, [(square(0.0, 0.0, 1.0, 1.0), 0), (square(0.0, 0.0, 1.0, 1.0), None), ([(0.0, 0.0), (1.0, 1.0)], 5), (None, 5)], [square(0.0, 0.0, 2.0, 2.0), [], None]) == {}
    assert overlap(spark, [], []) == {}
    with pytest.raises(Exception, match="not convex"):
        overlap(spark, [([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 0.5)], 5)], [square(0.0, 0.0, 2.0, 2.0)])
    twice = square(0.0, 0.0, 2.0, 2.0) * 2  # winds around itself
    with pytest.raises(Exception, match="more than its area"):
        overlap(spark, [(square(0.0, 0.0, 2.0, 2.0), 5)], [twice])


def test_hull_through_a_cell_between_its_corners(spark):
    cells = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0), (1, 1.0, 0.0, 2.0, 1.0), (2, 5.0, 5.0, 6.0, 6.0), (3, -9.0, -9.0, 9.0, 9.0)], "idx long, minx double, miny double, maxx double, maxy double")
    spike = spark.createDataFrame([(0, [(1.5, 0.4), (3.0, 0.5), (1.5, 0.6), (0.5, 0.5)])], "polygon long, ring array<struct<x: double, y: double>>")
    got = {r.idx: (r.position, r.relation_to_line) for r in polygons.boundary_class(cells, spike, 1.0).collect()}
    assert got == {0: ("inside", "edge"), 1: ("inside", "edge"), 2: ("outside", "none"), 3: ("inside", "none")}
    # the notch of a concave outline is outside, but the hull runs through it
    vee = spark.createDataFrame([(0, [(-5.0, -5.0), (0.5, 0.2), (6.0, -5.0), (0.5, 9.0)]), (1, [(0.0, 0.0)])], "polygon long, ring array<struct<x: double, y: double>>")
    low = spark.createDataFrame([(0, 0.0, -6.0, 1.0, -4.0), (1, 0.0, -4.0, 1.0, -2.0)], "idx long, minx double, miny double, maxx double, maxy double")
    assert {r.idx: (r.position, r.relation_to_line) for r in polygons.boundary_class(low, vee, 1.0).collect()} == {0: ("outside", "edge"), 1: ("outside", "none")}
    assert {r.position for r in polygons.boundary_class(cells, vee.limit(0), 1.0).collect()} == {"outside"}


def test_points_in_polygons_with_holes(spark):
    shapes = spark.createDataFrame(
        [(1, square(0.0, 0.0, 10.0, 10.0), [square(2.0, 2.0, 8.0, 8.0), square(9.0, 9.0, 9.5, 9.5)]), (2, square(3.0, 3.0, 4.0, 4.0), None), (3, square(0.5, 0.5, 1.5, 1.5), [])],
        "polygon long, ring array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>",
    )
    points = [(k, i + 0.05, j + 0.07) for k, (i, j) in enumerate((x / 4, y / 4) for x in range(-2, 44) for y in range(-2, 44))] + [(9999, None, 1.0)]
    df = spark.createDataFrame(points, "node long, x double, y double")

    def holds(x, y):
        box = lambda a, b, c, d: a < x < c and b < y < d
        return {p for p, ok in ((1, box(0, 0, 10, 10) and not box(2, 2, 8, 8) and not box(9, 9, 9.5, 9.5)), (2, box(3, 3, 4, 4)), (3, box(0.5, 0.5, 1.5, 1.5))) if ok}

    want = {(k, p) for k, x, y in points if x is not None for p in holds(x, y)}
    for tile in (0.3, 1.0, 20.0):
        assert {(r.node, r.polygon) for r in polygons.point_in_polygon(df, shapes, tile).collect()} == want
    twice = {k for k, p in want if p == 3}
    assert {(r.node, r.polygon) for r in polygons.point_in_polygon(df, shapes, 1.0, several="skip", key="node").collect()} == {(k, p) for k, p in want if k not in twice}
    with pytest.raises(Exception, match="several polygons"):
        polygons.point_in_polygon(df, shapes, 1.0, several="raise", key="node").collect()


def test_few_points_cast_a_ray(spark):
    """A disc of 64 corners over tiles of a twentieth of its radius: most of its points are in tiles without a side."""
    import math

    disc = spark.createDataFrame([(1, [(math.cos(k * math.pi / 32), math.sin(k * math.pi / 32)) for k in range(64)])], "polygon long, ring array<struct<x: double, y: double>>")
    tiles = polygons.covering(disc, 0.05).groupBy(F.col("sides").isNull().alias("whole")).count().collect()
    n = {r.whole: r["count"] for r in tiles}
    assert n[True] > 1000 > 200 > n[False] > 100


def test_polygons_are_tested_once_not_for_each_row_they_are_made_of(spark):
    people = spark.range(1000).groupBy((F.col("id") % 3).alias("k")).agg(F.count("*").alias("population"))
    corners = F.array(*[F.struct((F.col("k") + a).cast("double").alias("x"), F.lit(b).alias("y")) for a, b in ((0, 0.0), (1, 0.0), (1, 1.0), (0, 1.0))])
    shapes = spark.range(3).withColumnRenamed("id", "k").join(people, "k").select(F.col("k").alias("idx"), corners.alias("ring"), "population")
    out = polygons.polygon_overlap(shapes, shapes, 1.0)
    # the test for convexity was pushed below the sum of the population, to every row
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.idx: r.population for r in out.collect()} == pytest.approx({0: 334.0, 1: 333.0, 2: 333.0})
