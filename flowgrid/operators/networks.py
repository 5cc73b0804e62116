"""Road networks as edge lists: components per time slice, percolation, strong components, neighbour graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgrid.functions.storage import discard, materialize
from flowgrid.operators import merging
from flowgrid.operators.components import components


def grouped_components(edges: DataFrame, by: list[str], u: str = "u", v: str = "v") -> DataFrame:
    """by columns, node, component: connected components of every group's undirected graph, all groups in one job."""
    key = lambda c: F.struct(*by, F.col(c).alias("x"))
    found = components(edges.select(key(u).alias("u"), key(v).alias("v")))
    rows = found.select(*[F.col(f"node.{c}").alias(c) for c in by], F.col("node.x").alias("node"), F.col("component.x").alias("c"))
    least = rows.groupBy(*by, "c").agg(F.min("node").alias("component"))
    return rows.join(least, [*by, "c"]).select(*by, "node", "component")


def giant_sizes(edges: DataFrame, by: list[str], most: int = 2) -> DataFrame:
    """by columns, rank, component, nodes, links of the ``most`` largest components; links are distinct undirected pairs.

    The links are stored first: they are read twice, and what they are made from may be far larger. Rows with a null end are no links.
    """
    pairs = edges.filter("u is not null and v is not null").select(*by, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = materialize(pairs, "links")
    found = grouped_components(pairs, by)
    # a node's links are those to greater nodes, so a component's are the sum over its nodes
    links = pairs.groupBy(*by, F.col("u").alias("node")).agg(F.count("*").alias("links"))
    sizes = found.join(links, [*by, "node"], "left").groupBy(*by, "component").agg(F.count("*").alias("nodes"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("nodes"), "component"))
    return sizes.withColumn("rank", rank).filter(F.col("rank") <= most).select(*by, "component", "nodes", "links", "rank")


def percolation_sweep(classes: DataFrame, thresholds: list[float], by: list[str]) -> DataFrame:
    """``by``, q, rank, component, nodes, links: the two largest components of the roads with a ratio under q, for each group and threshold."""
    return merging.largest_at(merging.merge_tree(classes, by, "ratio"), by, thresholds)


def is_connected(edges: DataFrame) -> DataFrame:
    """One row: the number of components and whether it is one; no edge: 0 and false."""
    return components(edges).agg(F.count_distinct("component").alias("components"), (F.count_distinct("component") == 1).alias("connected"))


#: Steps along the edges between two stored tables.
STEPS = 3


def _least_reaching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, least: the least node that reaches each node along the edges (u, v), itself included.

    In a step a node takes the least of its predecessors' and of its own least one's; every STEPS of them what is known
    is stored, until nothing changes, however long the paths are.
    """
    now = materialize(nodes.select("node", F.col("node").alias("least")), "least")
    while True:
        new = now
        for _ in range(STEPS):
            pulled = edges.join(new.select(F.col("node").alias("u"), "least"), "u").select(F.col("v").alias("node"), "least")
            jumped = new.join(now.select(F.col("node").alias("least"), F.col("least").alias("next")), "least").select("node", F.col("next").alias("least"))
            new = new.unionByName(pulled).unionByName(jumped).groupBy("node").agg(F.min("least").alias("least"))
        new = materialize(new.join(now.withColumnRenamed("least", "old"), "node"), "least")
        settled = new.filter("least <> old").isEmpty()
        discard(now)
        now, path = new.select("node", "least"), new._stored_at
        now._stored_at = path
        if settled:
            return now


#: A group of so few edges is finished by the task that holds it.
LAST_EDGES = 100_000


def _least_of_strong(edges: list[tuple]) -> dict:
    """The least node of the strong component of every end of the edges, by depth-first search without recursion."""
    after: dict = {}
    for u, v in edges:
        after.setdefault(u, []).append(v)
        after.setdefault(v, [])
    seen, low, path, found = {}, {}, [], {}
    for root in after:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        path.append(root)
        work = [(root, iter(after[root]))]
        while work:
            node, rest = work[-1]
            for x in rest:
                if x not in seen:
                    seen[x] = low[x] = len(seen)
                    path.append(x)
                    work.append((x, iter(after[x])))
                    break
                if x not in found:
                    low[node] = min(low[node], seen[x])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == seen[node]:
                    members = [path.pop()]
                    while members[-1] != node:
                        members.append(path.pop())
                    found |= dict.fromkeys(members, min(members))
    return found


def _finish_strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of the ends of edges (group, u, v) that come group by group; no component lies in two groups."""
    held, now, kind = [], None, None

    def done():
        found = _least_of_strong(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(found), kind), pa.array(list(found.values()), kind)], ["node", "component"])

    for b in batches:
        kind = b.schema.field("u").type
        for g, u, v in zip(*(b.column(c).to_pylist() for c in ("group", "u", "v"))):
            if g != now and len(held) >= FLUSH:
                yield done()
            now = g
            held.append((u, v))
    if held:
        yield done()


#: Edges of whole groups that are searched together.
FLUSH = 10_000


def _bypass(edges: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) without some of their nodes, and (node, anchor, other) of those that were bypassed.

    Nodes without an edge out or in go. Of nodes with one edge out (or in), to their anchor, some that aren't neighbours are taken,
    and their edges from (or to) others are led to the anchor: all other nodes reach each other as before. A bypassed node is
    in its anchor's component if one of the others is, else alone.
    """
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("v").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    degrees = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i")).filter("o > 0 and i > 0")
    rank = F.when((F.col("o") == 1) | (F.col("i") == 1), F.struct(F.xxhash64(F.lit(seed), "node").alias("h"), F.col("node").alias("id")))
    info = materialize(degrees.select("node", rank.alias("rank"), (F.col("o") == 1).alias("out")), "degrees")
    side = lambda k: info.select(F.col("node").alias(k), F.col("rank").alias(f"rank_{k}"), F.col("out").alias(f"out_{k}"))
    live = materialize(edges.join(side("u"), "u").join(side("v"), "v"), "scc-live")
    lost = materialize(live.filter("rank_u is not null and rank_v is not null").select(F.when(F.col("rank_u") < F.col("rank_v"), F.col("u")).otherwise(F.col("v")).alias("node")).distinct().withColumn("lost", F.lit(True)), "lost")
    flagged = live.join(lost.select(F.col("node").alias("u"), F.col("lost").alias("lost_u")), "u", "left").join(lost.select(F.col("node").alias("v"), F.col("lost").alias("lost_v")), "v", "left")
    taken = lambda k: F.col(f"rank_{k}").isNotNull() & F.col(f"lost_{k}").isNull()
    flagged = materialize(flagged.select("u", "v", "out_u", "out_v", taken("u").alias("take_u"), taken("v").alias("take_v")), "scc-flagged")
    near = lambda node, other, rows: flagged.filter(rows).select(F.col(node).alias("node"), F.col(other).alias("at"), F.col(f"out_{node}").alias("out"))
    anchors = near("u", "v", "take_u and out_u").unionByName(near("v", "u", "take_v and not out_v"))
    others = near("v", "u", "take_v and out_v").unionByName(near("u", "v", "take_u and not out_u"))
    gone = materialize(anchors.withColumnRenamed("at", "anchor").join(others.select("node", F.col("at").alias("other")), "node"), "bypassed")
    led = gone.select(F.when(F.col("out"), F.col("other")).otherwise(F.col("anchor")).alias("u"), F.when(F.col("out"), F.col("anchor")).otherwise(F.col("other")).alias("v"))
    left = materialize(flagged.filter("not take_u and not take_v").select("u", "v").unionByName(led).filter("u <> v").distinct(), "scc-edges")
    for x in (info, live, lost, flagged):
        discard(x)
    return left, gone.select("node", "anchor", "other")


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node): nodes that reach each other along directed edges.

    Paths are shortened by bypassing nodes as long as that takes a tenth of the edges away, what is left is searched, and bypassed nodes
    are put back round by round.
    """
    ends = edges.select(F.col("u").alias("node")).union(edges.select("v")).filter("node is not null").distinct()
    now, rounds = materialize(edges.select("u", "v").filter("u <> v").distinct(), "scc-edges"), []
    n = now.count()
    while n > LAST_EDGES:
        left, gone = _bypass(now, len(rounds))
        discard(now)
        now, before, n = left, n, left.count()
        rounds.append(gone)
        if 10 * n > 9 * before:
            break
    found = _searched_components(now)
    for gone in reversed(rounds):
        of = lambda k: found.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}"))  # noqa: B023, E731
        rows = gone.join(of("anchor"), "anchor", "left").join(of("other"), "other", "left")
        rows = rows.select("node", F.coalesce("of_anchor", "anchor").alias("component"), F.coalesce("of_other", "other").alias("reached"))
        # a node that isn't here is a component of its own
        found = found.unionByName(materialize(rows.filter("component = reached").select("node", "component").distinct(), "scc"))
    every = ends.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("c"))
    least = every.groupBy("c").agg(F.min("node").alias("component"))
    return every.join(least, "c").select("node", "component")


def _searched_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of the ends of distinct edges without loops.

    Nodes of a component have the same least node that reaches them and the same least node that they reach. Where both
    are one node its component is complete; the others go on with only the edges inside a group of equal pairs. No component
    lies in two groups, so groups of at most LAST_EDGES edges are dealt to tasks that finish them, and only larger ones take another round.
    """
    ends = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    left, open_, done = materialize(edges.select(F.lit(0).alias("group"), "u", "v"), "scc-edges"), materialize(ends, "scc-nodes"), None
    while not open_.isEmpty():
        sizes = left.groupBy("group").agg(F.count("*").alias("n"))
        small = left.join(sizes.filter(F.col("n") <= LAST_EDGES), "group", "left_semi").repartition("group").sortWithinPartitions("group")
        kind = left.schema["u"].dataType.simpleString()
        local = materialize(small.select("group", "u", "v").mapInArrow(_finish_strong, f"node {kind}, component {kind}"), "scc")
        large = materialize(left.join(sizes.filter(F.col("n") > LAST_EDGES), "group", "left_semi").select("u", "v"), "scc-edges")
        inside = large.select(F.col("u").alias("node")).union(large.select("v")).distinct()
        # a node without an edge in its group is a component of its own
        alone = open_.join(local, "node", "left_anti").join(inside, "node", "left_anti").select("node", F.col("node").alias("component"))
        found = materialize(local.unionByName(alone), "scc")
        done = found if done is None else done.unionByName(found)
        nodes = materialize(inside, "scc-nodes")
        for x in (left, open_, local):
            discard(x)
        left, open_ = large, nodes
        if open_.isEmpty():
            break
        to, back = _least_reaching(left, open_), _least_reaching(left.select(F.col("v").alias("u"), F.col("u").alias("v")), open_)
        pairs = materialize(to.join(back.withColumnRenamed("least", "reached"), "node"), "scc-pairs")
        done = done.unionByName(materialize(pairs.filter("least = reached").select("node", F.col("least").alias("component")), "scc"))
        rest = pairs.filter("least <> reached")
        side = lambda k: rest.select(F.col("node").alias(k), F.struct("least", "reached").alias(f"group_{k}"))  # noqa: B023, E731
        old = (left, open_, to, back)
        left = left.join(side("u"), "u").join(side("v"), "v").filter("group_u = group_v")
        left = materialize(left.select(F.col("group_u").alias("group"), "u", "v"), "scc-edges")
        open_ = materialize(rest.select("node"), "scc-nodes")
        for x in (*old, pairs):
            discard(x)
    return done if done is not None else open_.withColumn("component", F.col("node"))


def largest_scc(edges: DataFrame) -> DataFrame:
    """node of the largest strong component; of equals the one with the least node."""
    found = materialize(strong_components(edges), "scc")
    best = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return found.join(best, "component").select("node", "component")


def degree_distribution(edges: DataFrame) -> DataFrame:
    """degree, n."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n"))


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """u and its distinct successors in ascending order; null ones are left out."""
    return edges.groupBy("u").agg(F.array_sort(F.collect_set("v")).alias("neighbours"))


#: Levels of tiles that are tried, each half as wide as the one before, and how many points a point may have on its tile.
LEVELS, ON_A_TILE = 16, 6
#: Squared distances under this close no sector: rounding could hide what follows from them.
TINY = 1e-11


def _around(spots: DataFrame, size: float) -> DataFrame:
    """b, bx, by, tx, ty: every spot on its own tile and the eight around it."""
    near = F.sequence(F.lit(-1), F.lit(1))
    rows = spots.select(F.col("s").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(near).alias("i"), (F.floor(F.col("x") / F.lit(size))).alias("tx"), (F.floor(F.col("y") / F.lit(size))).alias("ty"))
    return rows.select("b", "bx", "by", (F.col("tx") + F.col("i")).alias("tx"), F.explode(F.transform(near, lambda j: F.col("ty") + j)).alias("ty"))


def _squared(ax: str, ay: str, bx: str, by: str) -> Column:
    return F.round(F.pow(F.col(ax) - F.col(bx), 2) + F.pow(F.col(ay) - F.col(by), 2), 12)


def _tile_level(spots: DataFrame, radius: float) -> int:
    """The first level (0: tiles of the radius) on which a spot shares its tile with few others, on the average."""
    size = F.lit(radius) / F.pow(F.lit(2.0), F.col("level"))
    tiles = spots.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    tiles = tiles.groupBy("level", F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty")).agg(F.count("*").alias("n"))
    mean = {r.level: r.mean for r in tiles.groupBy("level").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("mean")).collect()}
    return next((k for k in sorted(mean) if mean[k] <= ON_A_TILE), LEVELS)


def relative_neighbours(points: DataFrame, radius: float) -> DataFrame:
    """a, b: pairs closer than ``radius`` with no third point nearer to both than they are to each other.

    Points at one spot have the same neighbours, so spots are compared. In a sector of 45 degrees seen from a spot only the
    nearest others can be its neighbours: any one farther away is nearer to those than to the spot. So spots look for the nearest of
    each sector on small tiles, and only those with empty sectors go on with tiles twice as wide, up to the radius. Pairs that are
    nearest from both sides are compared with all spots around.
    """
    points = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    spots = materialize(points.groupBy("x", "y").agg(F.min("id").alias("s")), "spots")
    level = _tile_level(spots, radius)
    open_, from_, found = spots.withColumn("closed", F.lit(0)), 0.0, []
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    octant = (dx > 0).cast("int") + F.lit(2) * (dy > 0).cast("int") + F.lit(4) * (F.abs(dx) > F.abs(dy)).cast("int")
    for k in range(level, -1, -1):
        reach = radius / 2**k
        size = reach * (1 + 1e-9)
        here = open_.select(F.col("s").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "closed", F.floor(F.col("x") / F.lit(size)).alias("tx"), F.floor(F.col("y") / F.lit(size)).alias("ty"))
        near = here.join(_around(spots, size), ["tx", "ty"]).filter("a <> b").withColumns({"d2": _squared("ax", "ay", "bx", "by"), "sector": F.pow(F.lit(2), octant).cast("int")})
        near = near.filter((F.col("d2") < reach * reach) & (F.col("d2") >= from_ * from_) & (F.col("closed").bitwiseAND(F.col("sector")) == 0))
        near = near.withColumn("sector", F.when(F.col("d2") < TINY, 0).otherwise(F.col("sector"))).withColumn("order", F.when(F.col("sector") == 0, 0.0).otherwise(F.col("d2")))
        first = near.withColumn("rank", F.rank().over(Window.partitionBy("a", "sector").orderBy("order"))).filter("rank = 1")
        first = materialize(first.select("a", "ax", "ay", "b", "bx", "by", "d2", "sector"), "nearest")
        mutual = first.filter("a < b").join(first.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_semi")
        mutual = mutual.withColumns({"tx": F.floor(F.col("ax") / F.lit(size)), "ty": F.floor(F.col("ay") / F.lit(size))})
        third = _around(spots, size).select(F.col("b").alias("c"), F.col("bx").alias("cx"), F.col("by").alias("cy"), "tx", "ty")
        inside = (F.col("c") != F.col("a")) & (F.col("c") != F.col("b")) & (_squared("ax", "ay", "cx", "cy") < F.col("d2")) & (_squared("bx", "by", "cx", "cy") < F.col("d2"))
        ruled = mutual.join(third, ["tx", "ty"]).filter(inside).select("a", "b").distinct()
        found.append(materialize(mutual.select("a", "b").join(ruled, ["a", "b"], "left_anti"), "neighbours"))
        if k:
            shut = first.groupBy(F.col("a").alias("s")).agg(F.bit_or("sector").alias("shut"))
            rest = open_.join(shut, "s", "left").withColumn("closed", F.col("closed").bitwiseOR(F.coalesce("shut", F.lit(0)))).drop("shut")
            old, open_, from_ = open_, materialize(rest.filter("closed <> 255"), "open"), reach
            discard(old)
        discard(first)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    members = points.join(spots, ["x", "y"]).select("s", "id")
    side = lambda s, i: members.select(F.col("s").alias(s), F.col("id").alias(i))
    apart = pairs.join(side("a", "p"), "a").join(side("b", "q"), "b").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    together = side("s", "a").join(side("s", "b"), "s").filter("a < b").select("a", "b")
    return apart.unionByName(together)


def largest_patch(cells: DataFrame, links: DataFrame, size: str) -> DataFrame:
    """idx of the cells in the connected patch of most ``size``; links (u, v) join neighbours."""
    found = components(cells.select(F.col("idx").alias("u"), F.col("idx").alias("v")).union(links.select("u", "v")))
    sized = found.join(cells.select(F.col("idx").alias("node"), F.col(size).alias("s")), "node")
    best = sized.groupBy("component").agg(F.sum("s").alias("s"), F.min("node").alias("first")).orderBy(F.desc("s"), "first").limit(1)
    return sized.join(best.select("component"), "component").select(F.col("node").alias("idx"))
