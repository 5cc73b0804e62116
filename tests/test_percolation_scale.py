"""What percolation shuffles and keeps: rows once for their road and once for their slice, nodes as arrays."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowgrid.operators import merging, slices, trajectory


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def peak(links):
    """(weight, second, largest) of (u, v, weight), components made anew after each weight."""
    best = None
    for x in sorted({w for *_, w in links}):
        part = {n: {n} for u, v, w in links if w <= x for n in (u, v)}
        for u, v, w in links:
            if w <= x and part[u] is not part[v]:
                part[u] |= part[v]
                for n in part[v]:
                    part[n] = part[u]
        sizes = sorted((len(p) for p in {id(p): p for p in part.values()}.values()), reverse=True) + [0]
        if best is None or sizes[1] > best[1]:
            best = (x, sizes[1], sizes[0])
    return best


def test_a_slice_is_shuffled_for_its_road_and_for_its_instant_only(unbroadcast):
    draw = random.Random(4)
    trips = [(p, draw.randrange(12), 20000 + draw.randrange(9000), draw.choice([5.0, 20.0, 30.0, 55.0])) for p in range(60)]
    traj = unbroadcast.createDataFrame([(p, r, t, t + draw.random() * 4000, x) for p, r, t, x in trips], "p long, route long, time_departure long, time_leaving_road double, kmh double")
    roads = unbroadcast.createDataFrame([(k, k % 5, (3 * k) % 7, 30) for k in range(10)], "uniqueid long, u long, v long, speed_mph long")
    classes = slices.traffic_classes(slices.edge_slices(traj), roads)
    out = merging.second_peak(classes, ["k"], "ratio")
    assert shuffles(out) == 3, "roads, rows by road, slices by instant"
    links = {}
    for r in slices.stab(traj).groupBy("route", "k").agg(F.round(F.avg("kmh") / F.lit(48.0), 9).alias("ratio")).collect():
        if r.route < 10:
            links.setdefault(r.k, []).append((r.route % 5, (3 * r.route) % 7, r.ratio))
    assert {r.k: (r.threshold, r.second, r.largest) for r in out.collect()} == {k: peak(x) for k, x in links.items()}
    kept = {(r.route, r.k): (r.flux, round(r.speed_kmh, 9)) for r in slices.edge_slices(traj, parts=7).collect()}
    plain = slices.stab(traj).groupBy("route", "k").agg(F.count("p").alias("n"), F.avg("kmh").alias("x"))
    assert kept == {(r.route, r.k): (r.n, round(r.x, 9)) for r in plain.collect()}


def test_dealt_routes_are_shuffled_once_for_trips_and_order(unbroadcast):
    draw = random.Random(6)
    routes = [(p, pos, draw.randrange(25)) for p in range(80) for pos in range(draw.randrange(6))] + [(None, 0, 3), (3, 9, None)]
    people = [(p, 21600 + p, float(draw.choice([0, 900, 4000])), draw.choice([0, 100, 300])) for p in range(0, 80, 1)] + [(None, 0, 1.0, 1), (7, 30000, 500.0, 100)]
    roads = [(k, 100.0 + k) for k in range(20)] + [(5, 77.0)]
    routes = unbroadcast.createDataFrame(routes, "p long, pos long, route long")
    people = unbroadcast.createDataFrame(people, "p long, time_departure long, distance double, num_steps long")
    edges = unbroadcast.createDataFrame(roads, "uniqueid long, length double")
    dealt = trajectory.road_times(trajectory.trajectory(routes, people, edges, 9))
    assert shuffles(dealt) == 4, "roads, routes by road, routes and trips by person"
    sums = lambda t: sorted(map(tuple, t.select("p", "pos", "route", "length", F.round("kmh", 6)).collect()))
    assert sums(dealt) == sums(trajectory.road_times(trajectory.trajectory(routes, people, edges))) != []


@pytest.mark.parametrize("few", [1, 4, 30, 10**6])
def test_the_peak_with_links_dropped_that_join_nothing(monkeypatch, few):
    monkeypatch.setattr(merging, "FEW_LINKS", few)
    monkeypatch.setattr(merging, "BLOCK", 7)
    draw, held = random.Random(few), []
    add = merging._Growth.add
    monkeypatch.setattr(merging._Growth, "add", lambda self, *c: add(self, *c) or held.append(sum(map(len, self.columns[0]))))
    for _ in range(150):
        n = draw.randint(1, 12)
        links = {k: [(draw.randrange(n), draw.randrange(n), draw.choice([0.1, 0.2, 0.25, 0.5, draw.random()])) for _ in range(draw.randint(1, 60))] for k in range(3)}
        rows = pd.DataFrame([(k, *x) for k, e in links.items() for x in sorted(e, key=lambda x: x[2])], columns=["k", "u", "v", "w"])
        step = draw.choice([1, 3, 100])
        found = merging._fold(["k"], True)(rows[at : at + step].reset_index(drop=True) for at in range(0, len(rows), step))
        assert {k: tuple(x) for f in found for k, *x in f.itertuples(index=False, name=None)} == {k: peak(e) for k, e in links.items()}
    if few == 1:
        assert max(held) <= 2 * (11 + 12) + 100, "twice the links that join 12 nodes or show one first, and a batch"


def test_the_peak_takes_few_bytes_a_node():
    draw, n = np.random.default_rng(1), 40_000
    links = pd.DataFrame({"k": 1, "u": draw.integers(0, n, n) * 37, "v": draw.integers(0, n, n) * 37, "w": np.arange(n) / n})
    tracemalloc.start()
    (out,) = merging._fold(["k"], True)(links[at : at + 2_000] for at in range(0, n, 2_000))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 1 and most < 110 * n, most


def test_pairs_of_the_merge_tree_are_made_distinct_by_sorts_where_their_group_is(spark):
    links = [(1, 2, 1, 0.5), (1, 1, 2, 0.3), (1, 1, 2, 0.9), (1, 2, 3, 0.9), (2, 1, 2, 0.3), (2, 4, 4, 0.3)]
    tree = merging.merge_tree(spark.createDataFrame(links, "k long, u long, v long, ratio double"), ["k"], "ratio")
    assert shuffles(tree) == 1 and "HashAggregate" not in tree._jdf.queryExecution().executedPlan().toString()
    never = float("inf")
    assert sorted(map(tuple, tree.collect())) == [(1, 1, 0.3, 0.9, 2, 1), (1, 1, 0.9, never, 3, 2), (2, 1, 0.3, never, 2, 1), (2, 4, 0.3, never, 1, 1)]
