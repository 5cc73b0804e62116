"""Connected components by contraction, as DataFrame joins over stored rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.functions.storage import discard, materialize

#: So few edges are finished by one task, whose memory they fit whatever the graph was.
LAST_EDGES = 100_000


def _finish(batches):
    """One node of the component of each end of all edges, by union and find over the places where nodes were met first."""
    place, nodes, parent = {}, [], []

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def at(node):
        key = tuple(_flat(node))
        if key not in place:
            place[key] = len(nodes)
            nodes.append(node)
            parent.append(place[key])
        return find(place[key])

    kind = None
    for b in batches:
        kind = b.schema.field("u").type
        for u, v in zip(*(b.column(c).to_pylist() for c in ("u", "v"))):
            p, q = at(u), at(v)
            parent[max(p, q)] = min(p, q)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([nodes[find(k)] for k in range(len(nodes))], kind)], ["n", "m"])


def _flat(x):
    """A node's values in order, however they nest."""
    if isinstance(x, dict):
        for v in x.values():
            yield from _flat(v)
    else:
        yield x


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node and component (one of its nodes) for every node of an undirected edge list, stored.

    Every round each node joins the least of its neighbours in a hashed order, another one each round, and edges are rewritten
    between the nodes that were joined; rounds go on until no edge is left or so few are that one task can finish them. Nodes may
    be of any type that can be ordered. Edges with a null end are left out, self-loops give a component of one; repeated edges and
    an empty list are fine. Hashes are made where they are compared, so that shuffles and stored tables hold nodes only.
    """
    distinct = lambda rows: rows.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    rows = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u is not null and v is not null")
    now, maps = materialize(distinct(rows), "edges"), []
    while not now.isEmpty():
        kind = now.schema["u"].dataType.simpleString()
        if now.count() <= LAST_EDGES:
            maps.append(materialize(now.coalesce(1).mapInArrow(_finish, f"n {kind}, m {kind}"), "chosen"))
            break
        key = lambda c: F.struct(F.hash(F.lit(len(maps)), c).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        # each edge row tells both its ends; counted up before the shuffle
        ends = now.select(F.least(key("u"), key("v")).alias("m"), F.explode(F.array("u", "v")).alias("n"))
        chosen = materialize(ends.groupBy("n").agg(F.min("m").alias("m")).select("n", F.col("m.id").alias("m")), "chosen")
        maps.append(chosen)
        left = now.filter("u != v").join(chosen.select(F.col("n").alias("u"), F.col("m").alias("mu")), "u").join(chosen.select(F.col("n").alias("v"), F.col("m").alias("mv")), "v")
        old, now = now, materialize(distinct(left.filter("mu != mv").select(F.col("mu").alias("u"), F.col("mv").alias("v"))), "edges")
        discard(old)
    discard(now)
    if not maps:
        return rows.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    out = maps[0].select(F.col("n").alias("node"), F.col("m").alias("at"))
    for later in maps[1:]:
        out = out.join(later.select(F.col("n").alias("at"), "m"), "at", "left").select("node", F.coalesce("m", "at").alias("at"))
    stored = materialize(out.select("node", F.col("at").alias("component")), "components")
    for m in maps:
        discard(m)
    return stored
