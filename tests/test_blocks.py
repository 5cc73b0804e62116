"""Blocked products against plain matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgrid.operators import blocks


def tables(spark, n=23, scenarios=5):
    r = np.random.default_rng(4)
    m, w, u = r.random((n, n)), r.random((scenarios, n)), r.random((scenarios, n))
    m[r.random((n, n)) < 0.2] = np.nan  # pairs that aren't there
    pairs = [(i, j, float(m[i, j])) for i in range(n) for j in range(n) if not np.isnan(m[i, j])]
    cells = [(f"s{s}" if s else None, k, float(w[s, k]), float(u[s, k])) for s in range(scenarios) for k in range(n)]
    return m, w, u, spark.createDataFrame(pairs, "i long, j long, d double"), spark.createDataFrame(cells, "scenario string, idx long, w double, u double")


@pytest.mark.parametrize(("side", "group"), [(4, 2), (7, 64), (256, 1)])
def test_sums_and_products(spark, monkeypatch, side, group):
    monkeypatch.setattr(blocks.weight_blocks, "__defaults__", (side, group))
    m, w, u, pairs, cells = tables(spark)
    full = np.nan_to_num(m)
    known = cells.filter("scenario is not null")
    got = {r.scenario: (r.w, r.u) for r in blocks.quadratic_sums(pairs, "d", known, ["scenario"], ["w", "u"], side).collect()}
    assert set(got) == {f"s{s}" for s in range(1, 5)}
    for s in range(1, 5):
        assert got[f"s{s}"] == pytest.approx((w[s] @ full @ w[s], u[s] @ full @ u[s]))
    one = blocks.quadratic_sums(pairs, "d", known.filter("scenario = 's2'"), [], ["w"], side).first()
    assert one.w == pytest.approx(w[2] @ full @ w[2])
    rows = blocks.pair_products(pairs, "d", known, ["scenario"], "w", "u", 100.0, side).collect()
    assert len(rows) == 4 * pairs.count()
    scale = {f"s{s}": 100 / (w[s] @ full @ u[s]) for s in range(1, 5)}
    assert all(r.amount == pytest.approx(w[int(r.scenario[1])][r.i] * m[r.i, r.j] * u[int(r.scenario[1])][r.j] * scale[r.scenario]) for r in rows)


def test_blocks_are_few(spark):
    _, _, _, pairs, cells = tables(spark)
    assert blocks.matrix_blocks(pairs, "d", 8).count() == 9
    assert blocks.weight_blocks(cells.filter("scenario is not null"), ["scenario"], ["w"], 8, 64).count() == 3


def test_missing_cells_and_empty_tables(spark):
    pairs = spark.createDataFrame([(0, 0, 2.0), (0, 5, 3.0), (5, 0, None), (None, 1, 1.0)], "i long, j long, d double")
    cells = spark.createDataFrame([(1, 0, 10.0), (1, 9, 1.0), (2, 0, None), (2, 5, 4.0), (3, 5, 1.0), (3, None, 1.0)], "s long, idx long, w double")
    got = {r.s: r.w for r in blocks.quadratic_sums(pairs, "d", cells, ["s"], ["w"], 4).collect()}
    assert got[1] == 200.0 and got[2] == 0.0 and got.get(3, 0.0) == 0.0
    rows = {(r.s, r.i, r.j): r.amount for r in blocks.pair_products(pairs, "d", cells.withColumn("u", F.col("w")), ["s"], "w", "u", 7.0, 4).collect()}
    assert rows == {(1, 0, 0): 7.0, (2, 0, 0): 0.0, (2, 0, 5): 0.0}
    assert blocks.quadratic_sums(pairs.limit(0), "d", cells, ["s"], ["w"]).count() == 0
