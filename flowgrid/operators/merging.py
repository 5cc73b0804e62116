"""The merge tree of percolation: how components grow as links are added in the order of a weight.

One fold over the links of each group, in the order of their weight, gives every state that a component ever has: from which weight
on, up to which, with how many nodes and links. Components at any threshold are read from it, so its rows are as many as links
and don't depend on the thresholds. Links are streamed; a task holds the nodes of one group (a road network).

The peak of the second largest component needs nodes only: its fold keeps a group's links as columns, drops those that join nothing
as soon as they outnumber the others, and finds components on arrays.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgrid.operators.trajectory import dedupe

NEVER = float("inf")

#: So many links of a group come in before those that join nothing are dropped, and so many are turned into Python numbers at a time.
FEW_LINKS, BLOCK = 4_000_000, 10_000


def _percolate(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[bytearray, tuple[float, int, int]]:
    """Which links, in the order of their weight, join components or show a node first; (weight, second, largest) of the peak."""
    nodes = np.concatenate([u, v])
    nodes.sort()
    nodes = nodes[np.concatenate([[True], nodes[1:] != nodes[:-1]])]
    parent, size, looped, used = array("i", range(len(nodes))), array("i", [1]) * len(nodes), bytearray(len(nodes)), bytearray(len(u))
    over, second, peak, weight = {}, 0, None, float(w[0])  # over: the components with more nodes than the second of the peak

    def settled(weight, over):
        sizes = sorted(over.values(), reverse=True)
        return weight, sizes[1] if len(sizes) > 1 else 0, sizes[0]

    for at in range(0, len(u), BLOCK):
        ends = (np.searchsorted(nodes, c[at : at + BLOCK]).tolist() for c in (u, v))
        for k, (p, q, x) in enumerate(zip(*ends, w[at : at + BLOCK].tolist()), at):
            if x != weight:  # all links of a weight are in: is the second largest component larger than it ever was?
                if peak is None or len(over) > 1:
                    peak = settled(weight, over)
                    second = peak[1]
                    over = {root: n for root, n in over.items() if n > second}
                weight = x
            while parent[p] != p:
                parent[p] = p = parent[parent[p]]
            while parent[q] != q:
                parent[q] = q = parent[parent[q]]
            if p != q:
                if size[p] < size[q]:
                    p, q = q, p
                parent[q], used[k] = p, 1
                size[p] = n = size[p] + size[q]
                if n > second:
                    over.pop(q, None)
                    over[p] = n
            elif size[p] == 1 and not looped[p]:  # a node linked to itself
                looped[p] = used[k] = 1
                if not second:
                    over[p] = 1
    return used, settled(weight, over) if peak is None or len(over) > 1 else peak


class _Growth:
    """The components of one group while its links come in; their states are kept only if they are given out, else its links are."""

    def __init__(self, key: tuple, keep: bool = True):
        self.keep = keep
        self.key, self.parent, self.state, self.out = key, {}, {}, []
        self.columns, self.new, self.few, self.peak = ([], [], []), 0, FEW_LINKS, None

    def find(self, x):
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def _end(self, root, weight: float) -> tuple[int, int]:
        """Close a component's state; one that began at this weight was never seen by a threshold."""
        since, nodes, links = self.state.pop(root, (None, 1, 0))
        if since is not None and since < weight:
            self.out.append((*self.key, root, since, weight, nodes, links))
        return nodes, links

    def _link(self, u, v, weight: float) -> None:
        for x in (u, v):
            self.parent.setdefault(x, x)
        p, q = self.find(u), self.find(v)
        nodes, links = self._end(p, weight)
        if p != q:
            more = self._end(q, weight)
            nodes, links = nodes + more[0], links + more[1]
            p, q = min(p, q), max(p, q)
            self.parent[q] = p
        self.state[p] = (weight, nodes, links + 1)

    def _gathered(self) -> list[np.ndarray]:
        found = []
        for c in self.columns:
            found.append(np.concatenate(c))
            c.clear()
        return found

    def add(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        """Links of the group, none lighter than those before."""
        if self.keep:
            for link in zip(u.tolist(), v.tolist(), w.tolist()):
                self._link(*link)
            return
        for kept, c in zip(self.columns, (u, v, w)):
            kept.append(c.copy())
        self.new += len(u)
        if self.new >= self.few:
            rows = self._gathered()
            used = np.frombuffer(_percolate(*rows)[0], bool)
            for kept, c in zip(self.columns, rows):
                kept.append(c[used])
            self.new, self.few = 0, max(FEW_LINKS, 2 * int(used.sum()))

    def close(self) -> None:
        if self.keep:
            self.out += [(*self.key, root, since, NEVER, nodes, links) for root, (since, nodes, links) in self.state.items()]
        else:
            self.peak = _percolate(*self._gathered())[1]


def _groups(b: pd.DataFrame, by: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Keys (the first ``by`` columns) and other columns of each run of rows with the same keys."""
    columns = [b.iloc[:, k].to_numpy() for k in range(b.shape[1])]
    first = np.zeros(len(b), bool)
    first[:1] = True
    for c in columns[:by]:
        first[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(first).tolist()
    for s, e in zip(starts, [*starts[1:], len(b)]):
        yield tuple(c[s] for c in columns[:by]), [c[s:e] for c in columns[by:]]


def _fold(by: list[str], peak: bool):
    columns = [*by, *(("threshold", "second", "largest") if peak else ("component", "low", "high", "nodes", "links"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None

        def rows():
            if not peak:
                found, now.out = now.out, []
                return found
            return [(*now.key, *now.peak)] if now.peak else []

        for b in batches:
            done = []
            for key, links in _groups(b, len(by)):
                if now is None or now.key != key:
                    if now is not None:
                        now.close()
                        done += rows()
                    now = _Growth(key, not peak)
                now.add(*links)
            if not peak and now is not None:
                done += rows()
            if done:
                yield pd.DataFrame(done, columns=columns)
        if now is not None:
            now.close()
            if found := rows():
                yield pd.DataFrame(found, columns=columns)

    return run


def _links(edges: DataFrame, by: list[str], weight: str) -> DataFrame:
    """``by``, u <= v and w of whole links, each group in one partition."""
    links = edges.dropna(subset=by).filter(F.col(weight).isNotNull() & ~F.isnan(weight) & F.col("u").isNotNull() & F.col("v").isNotNull())
    links = links.select(*by, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col(weight).cast("double").alias("w"))
    return links.repartition(*by)


def merge_tree(edges: DataFrame, by: list[str], weight: str) -> DataFrame:
    """``by``, component (its least node), low, high, nodes, links: every state of every component.

    ``edges``: u, v (numbers) and ``weight``, for each group of ``by`` (numbers). A state holds for thresholds q with
    low < q <= high when the links of weight under q are taken; links are distinct undirected pairs, with their least weight.
    Rows with a null end or weight are left out; a null key is no group.
    """
    kinds = dict(edges.dtypes)
    # pairs are made distinct where their group is, by sorts: a table of all pairs would take more of a task's memory
    rows = dedupe(_links(edges, by, weight), [*by, "u", "v"], ["w"]).sortWithinPartitions(*by, "w")
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), f"component {kinds['u']}, low double, high double, nodes long, links long"])
    return rows.mapInPandas(_fold(by, False), schema)


def second_peak(edges: DataFrame, by: list[str], weight: str) -> DataFrame:
    """``by``, threshold, second, largest: above which weight the second largest component is larger than at any other, and both sizes in nodes.

    The least such weight of equals: the transition at which the giant component takes over.
    """
    kinds = dict(edges.dtypes)
    rows = _links(edges, by, weight).sortWithinPartitions(*by, "w")  # a repeated pair joins nothing
    return rows.mapInPandas(_fold(by, True), ", ".join([*(f"{k} {kinds[k]}" for k in by), "threshold double, second long, largest long"]))


def largest_at(tree: DataFrame, by: list[str], thresholds: list[float], most: int = 2) -> DataFrame:
    """``by``, q, rank, component, nodes, links: the ``most`` largest components at each threshold, ties by the least node."""
    q = F.filter(F.array(*[F.lit(float(x)) for x in thresholds]), lambda x: (F.col("low") < x) & (x <= F.col("high")))
    rows = tree.withColumn("q", F.explode(q)).drop("low", "high")
    rank = F.row_number().over(Window.partitionBy(*by, "q").orderBy(F.desc("nodes"), "component"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).select(*by, "q", "rank", "component", "nodes", "links")
