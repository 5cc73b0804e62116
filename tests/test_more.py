"""Hand-made cases of what SQL doesn't cover: writers, fits, synthetic cities, strong components, grids."""

import math

from pyspark.sql import functions as F

from flowgrid.functions.storage import fresh_path
from flowgrid.operators import demand, networks, nonlinear, roads, tiling
from flowgrid.plans import catalogue
from flowgrid.sources import files


def test_strong_components_of_long_cycles_and_chains(spark):
    ring = [(k, (k + 1) % 12) for k in range(12)]  # the least node is known one step at a time against the edges
    chain = [(1000 + k, 1001 + k) for k in range(8)]
    e = spark.createDataFrame([*ring, *chain, (11, 1000), (2000, 2001), (2001, 2000), (2001, 2001), (None, 5)], "u long, v long")
    got = {r.node: r.component for r in networks.strong_components(e).collect()}
    assert all(got[k] == 0 for k in range(12)) and all(got[k] == k for k in range(1000, 1009)) and got[2000] == got[2001] == 2000
    assert {r.node for r in networks.largest_scc(e).collect()} == set(range(12))
    assert networks.strong_components(e.limit(0)).count() == 0


def test_roads_by_class_and_lanes(spark):
    rows = [("motorway", None, None), ("motorway", 2, None), ("motorway", 7, 30.0), ("trunk_link", None, None), ("road", 1, None), ("pier", None, None), (None, 2, None)]
    r = spark.createDataFrame([(k, h, n, m, True) for k, (h, n, m) in enumerate(rows)], "id long, highway string, lanes long, maxspeed double, oneway boolean")
    out = roads.infer_capacity(roads.infer_speed(roads.allocate_lanes(roads.impute_lanes(r)))).orderBy("id").collect()
    assert [(x.lanes, x.speed_mph, x.capacity) for x in out] == [(4, 65, 8800), (2, 50, 4000), (7, 30, 15400), (1, 45, 1900), (1, 30, 900), (1, None, None), (2, None, None)]
    assert [x.capacity for x in roads.capacity_us(roads.impute_lanes(r)).orderBy("id").collect()] == [8000, 4000, 14000, 1600, 1000, 0, 0]


def test_text_flows_and_hours_from_names(spark, tmp_path):
    for h in (7, 18):
        (tmp_path / f"cityD{h}.fma").write_text("\n".join([*["* head"] * 6, f"1 2 {h}.9", f" 3  4 {h + 1}", ""]))
    got = {tuple(r) for r in files.read_od_by_hour(spark, f"file://{tmp_path}").collect()}
    assert got == {(7, 1, 2, 7), (7, 3, 4, 8), (18, 1, 2, 18), (18, 3, 4, 19)}
    flows = spark.createDataFrame([(k, k + 1, 5 * k) for k in range(40)], "origin long, destination long, number_people long")
    back = files.stored_and_read(flows, files.write_od_text, files.read_od_text)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in flows.collect()}
    assert files.stored_and_read(flows.limit(0), files.write_od_text, lambda s, p: s.createDataFrame([], "a int")).count() == 0


def test_run_output_replaces_only_its_runs(spark):
    path = fresh_path(spark, "test-runs")
    rows = lambda *x: spark.createDataFrame(x, "v long, uci10 long, r long")
    files.write_run_output(rows((1, 1, 100), (2, 1, 200)), path)
    files.write_run_output(rows((3, 1, 200)), path)
    assert {tuple(r) for r in spark.read.parquet(path).select("v", "uci10", "r").collect()} == {(1, 1, 100), (3, 1, 200)}


def test_demand_and_fit_files_come_back(spark, sf):
    q = catalogue.queries()
    persons, back = q["d04_day_demand"](spark, sf), q["s12_write_demand"](spark, sf)
    assert back.count() > 0 and {"uci10", "r"} <= set(back.columns) and persons.count() > 0
    fitted, read = q["w05_expanding_fits"](spark, sf), q["s14_fit_results"](spark, sf)
    key = lambda df: sorted((r.uci10, r.r, r.t0, r.n) for r in df.select("uci10", "r", "t0", "n").collect())
    assert key(fitted) == key(read)
    curve = {(r.uci10, r.r, round(r.t, 9)): r.alpha_exp for r in q["m18_curve_json"](spark, sf).collect()}
    assert curve == {(r.uci10, r.r, round(r.t, 9)): r.alpha_exp for r in read.select("uci10", "r", "t", "alpha_exp").collect()}


def test_scenario_grids_come_back(spark, sf):
    got = catalogue.queries()["s09_scenario_population"](spark, sf)
    assert got.count() == 50 and got.select("uci").distinct().count() == 2


def test_curve_fits_find_planted_curves(spark):
    grid = [0.2 * k for k in range(1, 50)]
    planted = {
        "power": ((3.0, -1.5, None), lambda x: 3 * x**-1.5), "exponential": ((2.0, -0.7, None), lambda x: 2 * math.exp(-0.7 * x)), "linear": ((1.0, 0.5, None), lambda x: 1 + 0.5 * x),
        "lognormal": ((1.7, 0.4, 0.5), lambda x: 1.7 * math.exp(-(((math.log(x) - 0.4) / 0.5) ** 2) / 2) / (x * 0.5 * math.sqrt(2 * math.pi))),
        "gamma": ((0.9, 2.5, 0.7), lambda x: 0.9 * x**1.5 * math.exp(-x / 0.7) / (math.gamma(2.5) * 0.7**2.5)), "weibull": ((2.2, 2.0, 1.5), lambda x: 2.2 * 2 / 1.5 * (x / 1.5) * math.exp(-((x / 1.5) ** 2))),
    }
    for model, (want, curve) in planted.items():
        points = [("s", x, curve(x)) for x in grid] + [("few", 1.0, 2.0), ("s", None, 1.0), ("s", 2.0, None)]
        out = {r.series: r for r in nonlinear.fit_curves(spark.createDataFrame(points, "series string, x double, y double"), [model], by_sum=False).collect()}
        r = out["s"]
        assert r.converged and r.n == len(grid) and r.loss < 1e-12, model
        assert all(a == b or abs(a - b) < 1e-5 for a, b in zip((r.a, r.b, r.c), want)), (model, r)
        assert (out["few"].a, out["few"].converged) == (None, False)


def test_empty_bins_bend_a_raw_fit(spark):
    """A tail of empty bins counts: the decay over the sum is faster than without them."""
    points = [(1, float(k), y) for k, y in enumerate([50, 30, 18, 11, 7, 4, 2, 1, 0, 0, 0, 0, 0, 0])]
    points += [(2, x, y) for _, x, y in points if y]
    out = {r.series: r for r in nonlinear.fit_curves(spark.createDataFrame(points, "series long, x double, y long"), ["exponential"]).collect()}
    assert out[1].converged and out[2].converged and (out[1].n, out[2].n) == (14, 8)
    assert out[1].b < out[2].b < -0.4 and abs(out[1].a - 50 / 123) < 0.02


def cells(spark, n=5):
    rows = [(i * n + j, -71.2 + 0.02 * i, 42.2 + 0.02 * j, 10 + 50 * (i == j == 2), (i, j) != (0, 0)) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "idx long, cx double, cy double, population long, with_roads boolean")


def test_centers_are_live_cells_and_repeatable(spark):
    some = spark.range(40).select(F.col("id").alias("scenario"), F.lit(0).alias("center"))
    a, b, c = (sorted(map(tuple, demand.draw_centers(cells(spark), some, seed).collect())) for seed in (5, 5, 6))
    assert a == b and a != c and len(a) == 40 and all(x[2] != 0 for x in a)
    wide = demand.spread(demand.draw_centers(cells(spark), some, 5), 5, isotropic=False).collect()
    assert all(2 <= r.sx <= 15 and 2 <= r.sy <= 15 for r in wide) and any(r.sx != r.sy for r in wide)
    assert all(r.sx == r.sy for r in demand.spread(demand.draw_centers(cells(spark), some, 5), 5).collect())


def test_synthetic_populations_of_both_kinds(spark):
    centers = spark.createDataFrame([(1, 0, -71.16, 42.24, 3.0, 3.0)], "scenario long, center long, cx double, cy double, sx double, sy double")
    for kind in ("gaussian", "exponential"):
        got = {r.idx: r.population for r in demand.synth_population(cells(spark), centers, kind, 1000.0).collect()}
        assert abs(sum(got.values()) - 1000) < 1e-6 and got[0] == 0 and max(got, key=got.get) == 12


def test_search_goes_on_until_buckets_are_full(spark):
    asked = []

    def block(k):
        asked.append(k)
        return spark.createDataFrame([(f"{k}-{i}", 0.05 + 0.1 * (i % 2)) for i in range(4)], "scenario string, uci double")

    got = demand.scenario_search(block, most=4)
    assert asked == [0, 1] and got.count() == 8 and got.filter("not full").isEmpty()
    few = lambda k: block(k).filter("scenario in ('0-0', '0-1')")
    asked.clear()
    assert demand.scenario_search(few, most=4).filter("not full").count() == 2 and asked == [0, 1]  # the second block brings nothing


def test_metric_grid_flags_whole_squares(spark):
    ring = lambda x, y, w: [{"x": x + a, "y": y + b} for a, b in ((0.0, 0.0), (w, 0.0), (w, w), (0.0, w))]
    shapes = spark.createDataFrame([(0, ring(0.0, 0.0, 20.0)), (1, ring(30.0, 30.0, 15.0))], "component long, ring array<struct<x: double, y: double>>")
    got = tiling.metric_grid(shapes, 10.0).collect()
    assert len(got) == 2 * 25 and {r.component for r in got} == {0, 1}
    assert {(r.i, r.j) for r in got if r.inside and r.component == 0} == {(0, 0), (0, 1), (1, 0), (1, 1), (3, 3)}
    assert {(r.i, r.j) for r in got if r.inside and r.component == 1} == {(25, 25), (25, 26), (26, 25), (26, 26), (28, 28)}
    assert tiling.metric_grid(shapes.limit(0), 10.0).count() == 0


def test_a_cross_join_would_not_pass_for_points_in_polygons(spark, sf):
    got = catalogue.queries()["j11_point_in_polygon"](spark, sf)
    points = spark.read.parquet(f"{sf}/part.parquet").count()
    assert 0 < got.count() < points


def test_flows_of_a_cell(spark):
    t = spark.createDataFrame([(1, 2, 5), (2, 1, 6), (1, 1, 7), (None, 1, 8)], "origin long, destination long, number_people long")
    got = roads.subsample(t, [1]).groupBy("kind").agg(F.sum("number_people").alias("n")).collect()
    assert {r.kind: r.n for r in got} == {"origin": 12, "destination": 21, "cell": 26}
