"""Work that must not grow with the length of paths, the density of points or the size of a group."""

import random

from pyspark.sql import functions as F

from flowgrid.operators import components, demand, merging, networks
from flowgrid.plans import trips


def test_strong_components_of_long_paths_take_few_rounds(spark, monkeypatch):
    draw = random.Random(7)
    n = 400
    one_out = [(k, draw.randrange(n)) for k in range(n)]
    dense = [(1000 + draw.randrange(20), 1000 + draw.randrange(20)) for _ in range(60)]
    edges = [*one_out, *dense, (5, 1000), (1007, 1007), (None, 3)]
    want = {k: v for k, v in networks._least_of_strong([e for e in edges if None not in e]).items()}
    stored, materialize = [], networks.materialize
    monkeypatch.setattr(networks, "LAST_EDGES", 20)
    monkeypatch.setattr(networks, "materialize", lambda df, name: stored.append(name) or materialize(df, name))
    got = networks.strong_components(spark.createDataFrame(edges, "u long, v long"))
    got = {r.node: r.component for r in got.collect()}
    assert {k: got[k] for k in want} == want and all(got[k] == k for k in got.keys() - want.keys())
    assert len(stored) < 120, len(stored)


def test_the_local_search_equals_reachability():
    draw = random.Random(1)
    for _ in range(300):
        n = draw.randint(1, 12)
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(draw.randint(1, 22))]
        reach = {x: {x} for e in edges for x in e}
        for _ in reach:
            for u, v in edges:
                reach[u] |= reach[v]
        assert networks._least_of_strong(edges) == {x: min(y for y in reach[x] if x in reach[y]) for x in reach}


def test_relative_neighbours_equal_brute_force_at_any_density(spark):
    draw = random.Random(3)
    crowd = [(draw.randrange(40) / 10000, draw.randrange(40) / 10000) for _ in range(250)]  # lattice with copies and ties
    apart = [(0.012 + draw.random() / 50, draw.random() / 50) for _ in range(60)]
    close = [(0.02 + k * 1e-7, 0.03) for k in range(6)]  # distances that round to nothing
    at = dict(enumerate([*crowd, *apart, *close, (0.012, 0.03), (0.0155, 0.03)]))
    d2 = {(a, b): round((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2, 12) for a in at for b in at}
    r2 = 0.004**2
    near = {a: [b for b in at if b != a and d2[a, b] < r2] for a in at}
    want = {(a, b) for a in at for b in near[a] if a < b and not any(d2[a, c] < d2[a, b] and d2[b, c] < d2[a, b] for c in near[a] if c != b)}
    points = spark.createDataFrame([(k, x, y) for k, (x, y) in at.items()] + [(900, None, 0.0)], "id long, x double, y double")
    got = [(r.a, r.b) for r in networks.relative_neighbours(points, 0.004).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_relative_neighbours_of_a_crowd_compare_few_points(spark, monkeypatch):
    made, materialize = [], networks.materialize

    def counted(df, name):
        out = materialize(df, name)
        made.append(out.count())
        return out

    monkeypatch.setattr(networks, "materialize", counted)
    points = spark.createDataFrame([(k, (k % 40) / 10000, (k // 40) / 10000) for k in range(1600)], "id long, x double, y double")
    assert networks.relative_neighbours(points, 0.004).count() == 2 * 40 * 39
    assert max(made) < 20 * 1600


def test_trajectories_are_dealt_by_their_number_of_rows(spark, sf, monkeypatch):
    small = trips.traj(spark, sf).select("p", "pos", "time_leaving_road")
    want = sorted(map(tuple, small.collect()))
    monkeypatch.setattr(trips, "TASK_ROWS", 1000, raising=False)
    dealt = trips.traj(spark, sf).select("p", "pos", "time_leaving_road")
    assert dealt.rdd.getNumPartitions() in (5, 6)  # of about 6,000 rows
    assert sorted(map(tuple, dealt.collect())) == want


def test_the_peak_keeps_no_states(monkeypatch):
    import pandas as pd

    made, growth = [], merging._Growth
    monkeypatch.setattr(merging, "_Growth", lambda *a: made.append(growth(*a)) or made[-1])
    links = pd.DataFrame({"k": 1, "u": range(50), "v": range(1, 51), "w": [x / 50 for x in range(50)]})
    (out,) = merging._fold(["k"], True)(iter([links]))
    assert list(out.itertuples(index=False, name=None)) == [(1, 0.0, 0, 2)] and len(made[0].out) <= 1


def test_persons_of_a_large_flow_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(demand, "TASK_PERSONS", 100, raising=False)
    monkeypatch.setattr(demand, "BLOCK_PERSONS", 7, raising=False)
    od = spark.createDataFrame([(0, 1, 950), (0, 2, None), (1, 0, 14), (1, 1, 0), (2, 0, 36)], "origin long, destination long, n long")
    persons = demand.expand_persons(od, F.lit(7))
    sizes = persons.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 11 and max(sizes) < 250
    got = sorted((r.person, r.origin, r.destination, r.pos, r.departure) for r in persons.collect())
    flows = [(o, d, k, n) for o, d, n in ((0, 1, 950), (1, 0, 14), (2, 0, 36)) for k in range(n)]
    assert got == [(i, o, d, k, 25200 + k * 3600 / n) for i, (o, d, k, n) in enumerate(flows)]


def test_a_days_flows_are_made_once(spark, monkeypatch):
    stored, materialize = [], demand.materialize
    monkeypatch.setattr(demand, "materialize", lambda df, name: stored.append(name) or materialize(df, name))
    hours = spark.createDataFrame([(6, 0, 1, 3600), (7, 0, 1, 5), (8, 1, 0, 7200)], "hour long, origin long, destination long, n long")
    got = demand.day_demand(hours, 7, 1).groupBy("hour").count().collect()
    assert {r.hour: r["count"] for r in got} == {6: 3600, 7: 3600, 8: 7200} and stored == ["hours", "flows"]


def test_components_store_nodes_without_hashes_and_links_once(spark, monkeypatch):
    tables, materialize = [], components.materialize
    noted = lambda df, name: tables.append((name, df.columns, df.dtypes)) or materialize(df, name)
    monkeypatch.setattr(components, "materialize", noted)
    monkeypatch.setattr(networks, "materialize", noted)
    monkeypatch.setattr(components, "LAST_EDGES", 3)
    edges = [(k, u, v) for k in (1, 2, None) for u, v in ((1, 2), (2, 1), (3, 2), (4, 5), (5, 6), (6, 7), (9, 9))] + [(1, 20, None), (1, None, 4)]
    got = networks.giant_sizes(spark.createDataFrame(edges, "k long, u long, v long").filter("k is not null"), ["k"])
    assert sorted((r.k, r["rank"], r.component, r.nodes, r.links) for r in got.collect()) == [(k, n + 1, *x) for k in (1, 2) for n, x in enumerate(((4, 4, 3), (1, 3, 2)))]
    assert [n for n, *_ in tables].count("links") == 1
    assert not any("h:int" in t or "h:bigint" in t for _, _, kinds in tables for _, t in kinds)
