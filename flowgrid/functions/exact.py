"""Straight lines from sums that don't depend on the order of rows.

Sums of floats differ in their last digits from run to run, as shuffles deliver partial sums in any order. Here values are first
placed between the least and the largest of their group and rounded to 1/10^12 of that half range, as whole numbers; whole numbers
and their products add up exactly as decimals, in any order and over any number of partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

#: Whole numbers stand for values in units of the half range over this.
UNIT = 10**12
_SUMS = ("x", "y", "xx", "xy", "yy")


def _placed(value: Column, low: Column, high: Column) -> Column:
    """The value as a whole number of units from the middle of its range; null for what isn't finite."""
    u = F.try_divide(value - (low + high) / 2, (high - low) / 2)
    return F.when(value.isNotNull() & (low == high), F.lit(0.0)).otherwise(F.round(u * F.lit(float(UNIT)))).try_cast("decimal(13,0)")


def _terms(tag: str) -> dict[str, Column]:
    x, y = F.col(f"_x_{tag}"), F.col(f"_y_{tag}")
    return {"x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}


def _line(tag: str) -> list[Column]:
    """slope, intercept and rmse of a line from its sums and ranges; the slope is null where x has one value."""
    ends = {k: F.col(f"_{k}_{tag}") for k in ("xl", "xh", "yl", "yh")}
    m = F.col(f"_m_{tag}").cast("double")
    s = {k: F.col(f"_s{k}_{tag}").cast("double") / F.lit(float(UNIT ** len(k))) for k in _SUMS}
    cxx, cxy, cyy = s["xx"] - F.try_divide(s["x"] * s["x"], m), s["xy"] - F.try_divide(s["x"] * s["y"], m), s["yy"] - F.try_divide(s["y"] * s["y"], m)
    hx, hy = (ends["xh"] - ends["xl"]) / 2, (ends["yh"] - ends["yl"]) / 2
    tilt = F.try_divide(cxy, cxx)
    slope = tilt * F.try_divide(hy, hx)
    mean_x, mean_y = (ends["xl"] + ends["xh"]) / 2 + hx * F.try_divide(s["x"], m), (ends["yl"] + ends["yh"]) / 2 + hy * F.try_divide(s["y"], m)
    rmse = hy * F.sqrt(F.greatest(F.try_divide(cyy - tilt * cxy, m), F.lit(0.0)))
    return [slope.alias(f"slope_{tag}"), (mean_y - slope * mean_x).alias(f"intercept_{tag}"), rmse.alias(f"rmse_{tag}")]


def _both(lines: dict[str, tuple[Column, Column]]) -> dict[str, Column]:
    """y and x of each line where both are known, as floats."""
    known = {t: (y.cast("double"), x.cast("double")) for t, (y, x) in lines.items()}
    return {f"_{k}_{t}": F.when(y.isNotNull() & x.isNotNull(), v) for t, (y, x) in known.items() for k, v in (("y", y), ("x", x))}


def _ends(lines: dict, over=lambda c: c) -> dict[str, Column]:
    return {f"_{k}{e}_{t}": over(f(f"_{k}_{t}")) for t in lines for k in "xy" for e, f in (("l", F.min), ("h", F.max))}


def _place_all(lines: dict) -> dict[str, Column]:
    return {f"_{k}_{t}": _placed(F.col(f"_{k}_{t}"), F.col(f"_{k}l_{t}"), F.col(f"_{k}h_{t}")) for t in lines for k in "xy"}


def _sums(lines: dict, over=lambda c: c) -> dict[str, Column]:
    out = {f"_m_{t}": over(F.count(f"_x_{t}")) for t in lines}
    return out | {f"_s{k}_{t}": over(F.sum(v)) for t in lines for k, v in _terms(t).items()}


def _with_ends(rows: DataFrame, by: list[str], ends: dict[str, Column]) -> DataFrame:
    """``rows`` with the ends of their group's values. Null keys are a group."""
    found = rows.groupBy(*by).agg(*[c.alias(k) for k, c in ends.items()])
    if not by:
        return rows.crossJoin(found)  # one row
    keyed = found.select(*[F.col(k).alias(f"_g_{k}") for k in by], *ends)
    return rows.join(keyed, reduce(Column.__and__, [rows[k].eqNullSafe(keyed[f"_g_{k}"]) for k in by])).drop(*[f"_g_{k}" for k in by])


def moments(points: DataFrame, by: list[str], terms: dict[str, Column]) -> DataFrame:
    """``by``, n, the mean of each term (m and its name) and the centred mean product of every two (both names), over rows where all are known.

    Names are single letters; groups without such rows are left out.
    """
    names = list(terms)
    rows = points.select(*by, *[c.cast("double").alias(f"_{k}_") for k, c in terms.items()]).dropna(subset=[f"_{k}_" for k in names])
    ends = {f"_{k}{e}_": f(f"_{k}_") for k in names for e, f in (("l", F.min), ("h", F.max))}
    rows = _with_ends(rows, by, ends).withColumns({f"_{k}_": _placed(F.col(f"_{k}_"), F.col(f"_{k}l_"), F.col(f"_{k}h_")) for k in names})
    pairs = [(p, q) for i, p in enumerate(names) for q in names[i:]]
    s = rows.groupBy(*by, *ends).agg(F.count("*").alias("n"), *[F.sum(f"_{k}_").alias(f"_s{k}") for k in names], *[F.sum(F.col(f"_{p}_") * F.col(f"_{q}_")).alias(f"_s{p}{q}") for p, q in pairs])
    half = {k: (F.col(f"_{k}h_") - F.col(f"_{k}l_")) / 2 for k in names}
    mean = {k: F.col(f"_s{k}").cast("double") / UNIT / F.col("n") for k in names}
    out = [((F.col(f"_{k}l_") + F.col(f"_{k}h_")) / 2 + half[k] * mean[k]).alias(f"m{k}") for k in names]
    out += [((F.col(f"_s{p}{q}").cast("double") / UNIT / UNIT / F.col("n") - mean[p] * mean[q]) * half[p] * half[q]).alias(p + q) for p, q in pairs]
    return s.select(*by, "n", *out)


def fit_lines(points: DataFrame, by: list[str], lines: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``by``, n (rows) and for each name in ``lines`` (y, x) slope_, intercept_ and rmse_ by least squares.

    Rows where y or x is null don't count for a line; one value of x gives a null slope and an error of 0. The same rows give the
    same bits in any order. Null keys are a group. Two aggregations, both with partial sums before the shuffle.
    """
    rows = points.select(*by, *[c.alias(k) for k, c in _both(lines).items()])
    rows = _with_ends(rows, by, _ends(lines))
    sums = rows.withColumns(_place_all(lines)).groupBy(*by, *_ends(lines)).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in _sums(lines).items()])
    return sums.select(*by, "n", *[c for t in lines for c in _line(t)])


def running_lines(points: DataFrame, group: WindowSpec, frame: WindowSpec, lines: dict[str, tuple[Column, Column]]) -> DataFrame:
    """All columns of ``points`` with n, slope_, intercept_ and rmse_ of the rows in each row's ``frame``, a part of its ``group``.

    A row's sums run over its frame: one sort for the group, no join of rows with rows.
    """
    rows = points.withColumns(_both(lines))
    rows = rows.withColumns(_ends(lines, lambda c: c.over(group)))
    rows = rows.withColumns(_place_all(lines))
    rows = rows.withColumns({"n": F.count("*").over(frame)} | _sums(lines, lambda c: c.over(frame)))
    return rows.select(*points.columns, "n", *[c for t in lines for c in _line(t)])
