"""Queries on fields and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgrid.operators import centrality, field, merging, networks, roads, slices
from flowgrid.plans.catalogue import query
from flowgrid.plans.flows import pairs
from flowgrid.plans.tiling import LATTICE, lattice
from flowgrid.plans.trips import CLASSED, road_slices, rounded
from flowgrid.plans.views import view

FIELD = """SELECT idx, coalesce(ox, 0) AS out_x, coalesce(oy, 0) AS out_y, coalesce(nx, 0) AS in_x, coalesce(ny, 0) AS in_y FROM (SELECT DISTINCT origin AS idx FROM tij UNION SELECT destination FROM tij) k
    LEFT JOIN (SELECT origin, sum(number_people * dx) AS ox, sum(number_people * dy) AS oy FROM tij JOIN pairs ON origin = i AND destination = j GROUP BY origin) o ON o.origin = idx
    LEFT JOIN (SELECT destination, sum(number_people * dx) AS nx, sum(number_people * dy) AS ny FROM tij JOIN pairs ON origin = i AND destination = j GROUP BY destination) n ON n.destination = idx"""
WITH = f"lat AS ({LATTICE}), fld AS ({FIELD}), fc AS (SELECT c.idx, c.i, c.j, c.population, coalesce(out_x, 0) AS x, coalesce(out_y, 0) AS y FROM cells c LEFT JOIN fld USING (idx))"
STEPS = "st AS (SELECT b AS idx, way, dy * x + dx * y AS c FROM lat JOIN fc ON fc.idx = a)"
POT = f"""{STEPS}, rw AS (SELECT fc.idx, i, j, sum(coalesce(cj, 0)) OVER (PARTITION BY i ORDER BY j) AS r, coalesce(ci, 0) AS ci FROM fc LEFT JOIN (SELECT idx, c AS cj FROM st WHERE way = 'j') z1 ON z1.idx = fc.idx LEFT JOIN (SELECT idx, c AS ci FROM st WHERE way = 'i') z2 ON z2.idx = fc.idx),
    pot AS (SELECT rw.idx, r + q.col AS potential FROM rw JOIN (SELECT i, sum(ci) OVER (ORDER BY i) AS col FROM rw WHERE j = 0) q ON q.i = rw.i)"""
INV = "coalesce(1 / nullif(round({0}, 6), 0), 0)"


def the_field(spark, d):
    return field.vector_field(view(spark, d, "tij"), pairs(spark, d))


def potential(spark, d):
    return field.lattice_potential(the_field(spark, d), view(spark, d, "cells"), lattice(spark, d))


@query("a09_vector_field", f"SELECT idx, round(out_x, 6) AS out_x, round(out_y, 6) AS out_y, round(in_x, 6) AS in_x, round(in_y, 6) AS in_y FROM ({FIELD})")
def a09(spark, d):
    return rounded(the_field(spark, d))


@query("w04_potential", f"WITH {WITH}, {POT} SELECT idx, round(potential, 2) AS potential FROM pot")
def w04(spark, d):
    return rounded(potential(spark, d), 2)


@query("c07_rotor", f"WITH {WITH} SELECT fc.idx, round(coalesce(r, 0), 6) AS rotor FROM fc LEFT JOIN (SELECT b, (q.y - p.y) * {INV.format('dx')} - (q.x - p.x) * {INV.format('dy')} AS r FROM lat JOIN fc p ON p.idx = a JOIN fc q ON q.idx = b WHERE way = 'j' OR q.j = 0) z ON z.b = fc.idx")
def c07(spark, d):
    f = view(spark, d, "cells").select("idx").join(the_field(spark, d), "idx", "left").fillna(0.0)
    return rounded(field.rotor(f, view(spark, d, "cells"), lattice(spark, d)))


HARMONIC = f"SELECT a AS idx, sum((pow({INV.format('dx')}, 2) + pow({INV.format('dy')}, 2)) * (p.potential - q.potential)) AS harmonic FROM (SELECT a, b, dx, dy FROM lat UNION ALL SELECT b, a, dx, dy FROM lat) e JOIN pot p ON p.idx = a JOIN pot q ON q.idx = b GROUP BY a"


@query("c08_harmonic", f"WITH {WITH}, {POT} SELECT idx, round(harmonic, 4) AS harmonic FROM ({HARMONIC})")
def c08(spark, d):
    return rounded(field.harmonic(potential(spark, d), lattice(spark, d)), 4)


@query("c09_smooth", f"WITH {WITH}, {POT} SELECT a AS idx, round(avg(potential), 2) AS potential FROM (SELECT a, b FROM lat UNION ALL SELECT b, a FROM lat) e JOIN pot ON pot.idx = b GROUP BY a")
def c09(spark, d):
    return rounded(field.smooth(potential(spark, d), lattice(spark, d), "potential"), 2)


def _side(tag):
    """idx, potential, rotor and harmonic of the field out of the cells or into them, as one SELECT with its own WITH."""
    mine = WITH.replace("out_x", f"{tag}_x").replace("out_y", f"{tag}_y") if tag != "out" else WITH
    mine = mine.replace(FIELD.replace("out_x", f"{tag}_x").replace("out_y", f"{tag}_y"), FIELD)
    rotor = f"SELECT b, (q.y - p.y) * {INV.format('dx')} - (q.x - p.x) * {INV.format('dy')} AS r FROM lat JOIN fc p ON p.idx = a JOIN fc q ON q.idx = b WHERE way = 'j' OR q.j = 0"
    return f"WITH {mine}, {POT} SELECT fc.idx, population, potential, coalesce(r, 0) AS rotor, harmonic FROM fc JOIN pot ON pot.idx = fc.idx JOIN ({HARMONIC}) h ON h.idx = fc.idx LEFT JOIN ({rotor}) z ON z.b = fc.idx"


C10_SQL = f"""SELECT o.idx, o.population, round(o.potential, 2) AS v_out, round(n.potential, 2) AS v_in, round(o.rotor, 5) AS rotor_out, round(n.rotor, 5) AS rotor_in, round(o.harmonic, 4) AS harmonic_out, round(n.harmonic, 4) AS harmonic_in
    FROM ({_side('out')}) o JOIN ({_side('in')}) n USING (idx)"""


@query("c10_potential_table", C10_SQL)
def c10(spark, d):
    t = field.potential_table(the_field(spark, d), view(spark, d, "cells"), lattice(spark, d))
    return t.select("idx", "population", *[F.round(c, n).alias(c) for c, n in (("v_out", 2), ("v_in", 2), ("rotor_out", 5), ("rotor_in", 5), ("harmonic_out", 4), ("harmonic_in", 4))])


A16_SQL = f"""WITH {WITH}, {POT}, pc AS (SELECT c.*, round(potential, 6) AS v FROM cells c JOIN pot ON pot.idx = c.idx),
    prox AS (SELECT 1 - sum(distance * a.v * b.v) FILTER (a.position = 'inside' AND b.position = 'inside') / pow((SELECT sum(v) FROM pc), 2)
        / (sum(distance) FILTER (a.relation_to_line = 'edge' AND b.relation_to_line = 'edge') / pow((SELECT count(*) FROM pc WHERE relation_to_line = 'edge'), 2)) AS pi FROM pairs z JOIN pc a ON a.idx = z.i JOIN pc b ON b.idx = z.j),
    conc AS (SELECT floor(round(count(*) + 1 - (sum(v) - least(min(v), 0) * count(*)) / (max(v) - least(min(v), 0)), 9)) / count(*) AS lc FROM pc)
    SELECT round(pi, 6) AS pi, round(lc, 9) AS lc, round(pi * lc, 6) AS uci FROM prox, conc"""


@query("a16_uci_potential", A16_SQL)
def a16_potential(spark, d):
    v = potential(spark, d).select("idx", F.round("potential", 6).alias("v"))
    out = centrality.uci(pairs(spark, d), view(spark, d, "cells").join(v, "idx"), "v", potential=True)
    return out.select(F.round("pi", 6).alias("pi"), F.round("lc", 9).alias("lc"), F.round("uci", 6).alias("uci"))


def classes(spark, d):
    return slices.traffic_classes(road_slices(spark, d), view(spark, d, "edges"))


def moderate(spark, d):
    return classes(spark, d).filter("moderate").select("k", "u", "v")


# links of each slice, both ways, and the least node of each component by steps that only keep each node's least one
LINKED = """bw AS (SELECT k, u, v FROM lk UNION SELECT k, v, u FROM lk), comp(k, node, component) USING KEY (k, node) AS (SELECT k, u, min(least(u, v)) FROM bw GROUP BY k, u
    UNION SELECT c.k, c.node, min(n.component) FROM comp n JOIN bw ON bw.k = n.k AND bw.u = n.node JOIN recurring.comp c ON c.k = bw.k AND c.node = bw.v WHERE n.component < c.component GROUP BY c.k, c.node)"""
CLOSED = f"lk AS (SELECT DISTINCT k, u, v FROM ({CLASSED}) WHERE ratio < 0.5), {LINKED}"


@query("c02_components", f"WITH RECURSIVE {CLOSED} SELECT k, node, component FROM comp")
def c02(spark, d):
    return networks.grouped_components(moderate(spark, d), ["k"])


GIANTS = f"nd AS (SELECT k, component, count(*) AS nodes FROM comp GROUP BY ALL), ln AS (SELECT l.k, component, count(*) AS links FROM (SELECT DISTINCT k, least(u, v) AS a, greatest(u, v) AS b FROM lk) l JOIN comp ON comp.k = l.k AND comp.node = l.a GROUP BY ALL), ranked AS (SELECT nd.k, row_number() OVER (PARTITION BY nd.k ORDER BY nodes DESC, nd.component) AS rank, nd.component, nodes, links FROM nd JOIN ln ON ln.k = nd.k AND ln.component = nd.component)"
for _n in ("c03_giant_sizes", "t06_two_largest"):
    query(_n, f"WITH RECURSIVE {CLOSED}, {GIANTS} SELECT k, rank, component, nodes, links FROM ranked WHERE rank <= 2")(lambda spark, d: networks.giant_sizes(moderate(spark, d), ["k"]))

# the twenty steps of a line from 0 to 1, at the slice of the peak
SWEPT = f"lk AS (SELECT DISTINCT q AS k, u, v FROM ({CLASSED}) c CROSS JOIN (SELECT unnest(range(20)) / 19.0::DOUBLE AS q) z WHERE ratio < q AND c.k = 34), {LINKED}"
THRESHOLDS = [k / 19 for k in range(20)]


@query("c04_percolation_sweep", f"WITH RECURSIVE {SWEPT}, {GIANTS} SELECT round(k, 9) AS q, rank, component, nodes, links FROM ranked WHERE rank <= 2")
def c04(spark, d):
    return networks.percolation_sweep(classes(spark, d).filter("k = 34"), THRESHOLDS, ["k"]).select(F.round("q", 9).alias("q"), "rank", "component", "nodes", "links")


@query("c04_merge_tree", f"WITH RECURSIVE {CLOSED}, {GIANTS} SELECT k, rank, component, nodes, links FROM ranked WHERE rank <= 2")
def c04_merge_tree(spark, d):
    """The moderate roads' two largest components of every slice, read from the merge trees of all slices."""
    return networks.percolation_sweep(classes(spark, d), [0.5], ["k"]).drop("q")


@query("c04_second_peak")
def c04_second_peak(spark, d):
    out = merging.second_peak(classes(spark, d), ["k"], "ratio")
    return out.select("k", F.round("threshold", 9).alias("threshold"), "second", "largest")


@query("c05_largest_scc", "WITH RECURSIVE dir AS (SELECT DISTINCT u, v FROM edges WHERE u <> v), rec AS (SELECT u AS root, u AS node FROM (SELECT u FROM dir UNION SELECT v FROM dir) x UNION SELECT rec.root, dir.v FROM rec JOIN dir ON dir.u = rec.node), comp AS (SELECT a.root AS node, min(a.node) AS component FROM rec a JOIN rec b ON b.root = a.node AND b.node = a.root GROUP BY a.root), best AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT node, component FROM comp JOIN best USING (component)")
def c05(spark, d):
    e = view(spark, d, "edges").select("u", "v")
    return networks.largest_scc(e.filter("u <> v"))


@query("c06_is_connected", "WITH RECURSIVE bw AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges), rec AS (SELECT min(u) AS node FROM bw UNION SELECT bw.v FROM rec JOIN bw ON bw.u = rec.node) SELECT (SELECT count(*) FROM rec) = (SELECT count(DISTINCT u) FROM bw) AS connected")
def c06(spark, d):
    return networks.is_connected(view(spark, d, "edges")).select("connected")


@query("c11_relative_neighbours", "WITH pt AS (SELECT index AS id, x, y FROM nodes), nr AS (SELECT a.id AS a, b.id AS b, round(pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 12) AS d2 FROM pt a JOIN pt b ON a.id <> b.id WHERE round(pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 12) < 0.004 * 0.004) SELECT a, b FROM nr p WHERE a < b AND NOT EXISTS (SELECT 1 FROM nr q JOIN nr r ON r.a = p.b AND r.b = q.b WHERE q.a = p.a AND q.b <> p.b AND q.d2 < p.d2 AND r.d2 < p.d2)")
def c11(spark, d):
    return networks.relative_neighbours(view(spark, d, "nodes").select(F.col("index").alias("id"), "x", "y"), 0.004)


@query("g11_largest_patch", "WITH RECURSIVE keep AS (SELECT idx, i, j, population FROM cells WHERE idx % 5 <> 2), bw AS (SELECT a.idx AS u, b.idx AS v FROM keep a JOIN keep b ON abs(a.i - b.i) + abs(a.j - b.j) <= 1), rec AS (SELECT idx AS root, idx AS node FROM keep UNION SELECT rec.root, bw.v FROM rec JOIN bw ON bw.u = rec.node), comp AS (SELECT node, min(root) AS c FROM rec GROUP BY node), best AS (SELECT c FROM comp JOIN keep ON idx = node GROUP BY c ORDER BY sum(population) DESC, c LIMIT 1) SELECT node AS idx FROM comp JOIN best USING (c)")
def g11(spark, d):
    c = view(spark, d, "cells").filter("idx % 5 <> 2")
    e = lattice(spark, d).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return networks.largest_patch(c, roads.restrict_pairs(e, c, "u", "v"), "population")


@query("a24_degree_distribution", "SELECT degree, count(*) AS n FROM (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) e GROUP BY node) GROUP BY degree")
def a24(spark, d):
    return networks.degree_distribution(view(spark, d, "edges"))


@query("a28_neighbour_lists", "SELECT u, string_agg(v::VARCHAR, ',' ORDER BY v) AS neighbours FROM (SELECT DISTINCT u, v FROM edges) e GROUP BY u")
def a28(spark, d):
    return networks.neighbour_lists(view(spark, d, "edges")).select("u", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))
