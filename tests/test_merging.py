"""The merge tree against components found anew at every threshold, and components in many rounds."""

import random

from pyspark.sql import functions as F

from flowgrid.operators import components, merging, networks


def two_largest(edges, q, most=2):
    """(nodes, least node, links) of the largest components of the pairs whose least weight is under q."""
    pairs = {}
    for u, v, w in edges:
        if None not in (u, v, w):
            pairs[min(u, v), max(u, v)] = min(w, pairs.get((min(u, v), max(u, v)), w))
    near = {}
    for (u, v), w in pairs.items():
        if w < q:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    found, seen = [], set()
    for x in near:
        if x not in seen:
            part, todo = {x}, [x]
            while todo:
                for y in near[todo.pop()] - part:
                    part.add(y)
                    todo.append(y)
            seen |= part
            found.append((len(part), min(part), sum(w < q and u in part for (u, v), w in pairs.items())))
    return sorted(found, key=lambda f: (-f[0], f[1]))[:most]


def graphs():
    random.seed(5)
    for k in range(6):
        n = random.randint(2, 40)
        yield k, [(random.randrange(n), random.randrange(n), random.choice([0.1, 0.2, 0.25, 0.5, 0.7, 0.9, 1.5])) for _ in range(random.randint(1, 70))]
    yield 6, [(3, 3, 0.5)]
    yield 7, [(1, None, 0.1), (1, 2, None), (None, 2, 0.3)]
    yield None, [(1, 2, 0.1)]


def test_components_at_every_threshold(spark):
    known = dict(graphs())
    rows = [(k, u, v, w) for k, edges in known.items() for u, v, w in edges]
    df = spark.createDataFrame(rows, "k long, u long, v long, ratio double").repartition(5)
    qs = [0.0, 0.1, 0.15, 0.25, 0.5, 0.6, 0.9, 1.0, 2.0]
    got = {}
    for r in networks.percolation_sweep(df, qs, ["k"]).orderBy("rank").collect():
        got.setdefault((r.k, r.q), []).append((r.nodes, r.component, r.links))
    want = {(k, q): f for k, edges in known.items() if k is not None for q in qs if (f := two_largest(edges, q))}
    assert got == want
    tree = merging.merge_tree(df, ["k"], "ratio")
    assert tree.filter("low >= high or nodes < 1 or links < 1").count() == 0
    assert tree.count() <= len(rows)  # whatever the thresholds are


def test_peak_of_the_second_largest(spark):
    known = {k: e for k, e in graphs() if k is not None and k < 7}
    df = spark.createDataFrame([(k, *e) for k, edges in known.items() for e in edges], "k long, u long, v long, ratio double")
    got = {r.k: (r.threshold, r.second) for r in merging.second_peak(df, ["k"], "ratio").collect()}
    for k, edges in known.items():
        weights = sorted({w for *_, w in edges})
        sizes = [(lambda f: f[1][0] if len(f) > 1 else 0)(two_largest(edges, w + 1e-9)) for w in weights]
        assert got[k] == (weights[sizes.index(max(sizes))], max(sizes)), k


def test_rounds_and_the_last_edges(spark, monkeypatch):
    random.seed(8)
    edges = [(k, k + 1) for k in range(0, 300) if k % 60] + [(random.randrange(400, 600), random.randrange(400, 600)) for _ in range(120)] + [(900, 900), (None, 4), (901, None)]
    df = spark.createDataFrame(edges, "u long, v long")
    kept = [(u, v) for u, v in edges if u is not None and v is not None]

    def parts(found):
        out = {}
        for r in found.collect():
            assert r.node not in {n for p in out.values() for n in p}
            out.setdefault(r.component, set()).add(r.node)
        return sorted(map(sorted, out.values()))

    once = parts(components.components(df))
    for most in (0, 20):
        monkeypatch.setattr(components, "LAST_EDGES", most)
        assert parts(components.components(df)) == once
    near = {}
    for u, v in kept:
        near.setdefault(u, {u}).add(v)
        near.setdefault(v, {v}).add(u)
    assert {n for p in once for n in p} == set(near) and all(near[n] <= set(p) for p in once for n in p)
    assert len(once) == len(two_largest([(u, v, 0.0) for u, v in kept], 1.0, 10**6))
    assert components.components(df.limit(0)).count() == 0
    nested = df.select(F.struct(F.lit("a").alias("s"), F.col("u").alias("x")).alias("u"), F.struct(F.lit("a").alias("s"), F.col("v").alias("x")).alias("v"))
    assert components.components(nested.filter("u.x is not null and v.x is not null")).select("component").distinct().count() == len(once)
