"""Products of a matrix of cells with the weights of many scenarios, in blocks.

A matrix of cells by cells is cut into square blocks, and the weights of some scenarios on a block's cells are one row too. A block meets the
weights of its two sides once for every group of scenarios, and the sums over its cells are a product of small matrices inside the
task. So the rows that are shuffled grow with the blocks and groups, not with pairs of cells times scenarios.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells along the side of a block, and scenarios in a group on average.
SIDE, GROUP = 256, 64


def matrix_blocks(pairs: DataFrame, value: str, side: int = SIDE) -> DataFrame:
    """bi, bj, at, v: the blocks of a matrix given as i, j and ``value`` (cells are numbers from 0); ``at`` is a value's place in its block.

    Pairs with a null are left out; at most side * side distinct pairs are in a block.
    """
    i, j = F.col("i").cast("long"), F.col("j").cast("long")
    rows = pairs.select(F.floor(i / side).alias("bi"), F.floor(j / side).alias("bj"), ((i % side) * side + j % side).cast("int").alias("at"), F.col(value).cast("double").alias("v")).dropna()
    rows = rows.groupBy("bi", "bj", "at").agg(F.sum("v").alias("v"))
    return rows.groupBy("bi", "bj").agg(F.collect_list(F.struct("at", "v")).alias("m")).select("bi", "bj", F.col("m.at").alias("at"), F.col("m.v").alias("v"))


def weight_blocks(weights: DataFrame, by: list[str], columns: list[str], side: int = SIDE, group: int = GROUP) -> DataFrame:
    """block, part, rows: for each block of cells and group of scenarios the scenarios' weights, as structs of ``by``, the cells' places and ``columns``.

    ``weights``: ``by``, idx and the columns. Scenarios are dealt to groups by hash, about ``group`` in each.
    """
    n = weights.select(F.approx_count_distinct(F.struct(*by))).first()[0] if by else 1
    part = F.pmod(F.xxhash64(*by), F.lit(-(-max(n, 1) // group))).cast("int") if by else F.lit(0)
    idx = F.col("idx").cast("long")
    rows = weights.filter(idx.isNotNull()).select(*by, part.alias("part"), F.floor(idx / side).alias("block"), (idx % side).cast("int").alias("at"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    vectors = rows.groupBy(*by, "part", "block").agg(F.collect_list(F.struct("at", *columns)).alias("w"))
    vectors = vectors.select("part", "block", F.struct(*by, F.col("w.at").alias("at"), *[F.col(f"w.{c}").alias(c) for c in columns]).alias("_row"))
    return vectors.groupBy("part", "block").agg(F.collect_list("_row").alias("rows"))


def _met(matrix: DataFrame, weights: DataFrame) -> DataFrame:
    """Every block of the matrix with the weights of both its sides, for each group of scenarios."""
    a = weights.select(F.col("block").alias("bi"), "part", F.col("rows").alias("a"))
    b = weights.select(F.col("block").alias("bj"), "part", F.col("rows").alias("b"))
    return matrix.join(a, "bi").join(b, ["bj", "part"])


def _dense(at, values, size: int) -> np.ndarray:
    out = np.zeros(size)
    np.add.at(out, np.asarray(at, np.int64), np.asarray(values, float))
    return out


def _sides(row, by: list[str], columns: list[str], side: int) -> tuple[list[tuple], list[tuple[np.ndarray, np.ndarray]]]:
    """The scenarios that both sides have, and each column's weights of either side, a row a scenario."""
    left, right = ({tuple(s[k] for k in by): s for s in rows} for rows in (row.a, row.b))
    keys = [k for k in left if k in right]
    return keys, [tuple(np.array([_dense(s[k]["at"], s[k][c], side) for k in keys]).reshape(len(keys), side) for s in (left, right)) for c in columns]


def quadratic_sums(pairs: DataFrame, value: str, weights: DataFrame, by: list[str], columns: list[str], side: int = SIDE) -> DataFrame:
    """``by`` and for each column w the sum over all pairs of w[i] * value[i, j] * w[j], for all scenarios of ``weights`` (``by``, idx, columns).

    Cells without a weight count as 0, scenarios without a pair have no row.
    """
    kinds = dict(weights.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                m = _dense(row.at, row.v, side * side).reshape(side, side)
                keys, sides = _sides(row, by, columns, side)
                if keys:
                    out = pd.DataFrame(keys, columns=by) if by else pd.DataFrame(index=range(1))
                    yield out.assign(**{c: ((a @ m) * b).sum(1) for c, (a, b) in zip(columns, sides)})

    parts = _met(matrix_blocks(pairs, value, side), weight_blocks(weights, by, columns, side)).select("at", "v", "a", "b")
    found = parts.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in by), *(f"{c} double" for c in columns)]))
    return found.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])


def pair_products(pairs: DataFrame, value: str, weights: DataFrame, by: list[str], sources: str, targets: str, total: float, side: int = SIDE) -> DataFrame:
    """``by``, i, j, amount: w[i] * value[i, j] * u[j] of every pair and scenario, scaled so that a scenario's amounts add up to ``total``.

    ``weights``: ``by``, idx and the columns ``sources`` (w) and ``targets`` (u). Pairs and scenarios are all in the result, so its rows are made in the tasks
    that hold a block; a scenario whose amounts are all 0 stays at 0.
    """
    kinds = dict(weights.dtypes)
    met = _met(matrix_blocks(pairs, value, side), weight_blocks(weights, by, [sources, targets], side))

    def sums(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                m = _dense(row.at, row.v, side * side).reshape(side, side)
                keys, ((a, _), (_, b)) = _sides(row, by, [sources, targets], side)
                if keys:
                    yield (pd.DataFrame(keys, columns=by) if by else pd.DataFrame(index=range(1))).assign(_all=((a @ m) * b).sum(1))

    def emitted(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                at = np.asarray(row.at, np.int64)
                v = np.asarray(row.v, float)
                keys, ((a, _), (_, b)) = _sides(row, by, [sources, targets], side)
                left, right = ({tuple(s[k] for k in by): set(s["at"]) for s in rows} for rows in (row.a, row.b))
                p, q = at // side, at % side
                for k, x, y in zip(keys, a, b):
                    both = np.isin(p, list(left[k])) & np.isin(q, list(right[k]))
                    out = pd.DataFrame({"i": row.bi * side + p[both], "j": row.bj * side + q[both], "amount": x[p[both]] * v[both] * y[q[both]]})
                    yield out.assign(**dict(zip(by, k)))[[*by, "i", "j", "amount"]]

    keys = ", ".join(f"{k} {kinds[k]}" for k in by)
    whole = met.select("at", "v", "a", "b").mapInPandas(sums, f"{keys}, _all double" if by else "_all double").groupBy(*by).agg(F.sum("_all").alias("_all"))
    rows = met.select("bi", "bj", "at", "v", "a", "b").mapInPandas(emitted, f"{keys}, i long, j long, amount double" if by else "i long, j long, amount double")
    scaled = F.coalesce(F.try_divide(F.col("amount") * F.lit(float(total)), F.col("_all")), F.lit(0.0)).alias("amount")
    rows = rows.join(whole, by) if by else rows.crossJoin(whole)  # one row
    return rows.select(*by, "i", "j", scaled)
