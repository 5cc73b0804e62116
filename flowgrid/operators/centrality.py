"""Urban centrality: proximity of people to each other, concentration of people, and their product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgrid.operators import blocks


def inhabited(cells: DataFrame) -> DataFrame:
    return cells.filter("population > 0")


def proximity_index(pairs: DataFrame, cells: DataFrame, column: str, by: list[str] | None = None, potential: bool = False) -> DataFrame:
    """pi = 1 - v / vmax for each group: v is the mean distance between two people of inhabited inner cells, vmax that of
    equal masses on the edge cells. A ``potential`` is spread over all cells, and counts in all inner ones."""
    keys = by or []
    f = F.col(column).cast("double")
    cells = cells.withColumns({"f": f, "inner": F.expr("position = 'inside'" + " and population > 0" * (not potential)), "rim": F.expr("relation_to_line = 'edge'")})
    sums = cells.groupBy(*keys).agg(F.sum(F.when(F.col("inner") | F.lit(potential), F.col("f"))).alias("total"), F.count_if("rim").alias("rims"))
    weights = cells.select(*keys, "idx", F.when(F.col("inner"), F.col("f")).otherwise(F.lit(0.0)).alias("v"), F.col("rim").cast("double").alias("m"))
    v = blocks.quadratic_sums(pairs, "distance", weights, keys, ["v", "m"])
    out = v.join(sums, keys) if keys else v.crossJoin(sums)  # one row each
    v, vmax = F.try_divide(F.col("v"), F.col("total") * F.col("total")), F.try_divide(F.col("m"), F.col("rims") * F.col("rims"))
    return out.select(*keys, v.alias("v"), vmax.alias("vmax"), (1 - F.try_divide(v, vmax)).alias("pi"))


def pair_energy(pairs: DataFrame, cells: DataFrame, noise: float = 1e-7) -> DataFrame:
    """v = half the mean distance with shares under ``noise`` as 0, and the half mean distance of uniform edge cells."""
    total = cells.agg(F.sum(F.col("population").cast("double")).alias("total"), F.count_if(F.col("relation_to_line") == "edge").alias("rims"))
    c = cells.crossJoin(F.broadcast(total)).withColumn("f", F.col("population") / F.col("total")).withColumn("f", F.when(F.col("f") < noise, 0.0).otherwise(F.col("f")))  # one row
    rim = F.col("relation_to_line") == "edge"
    a = c.select(F.col("idx").alias("i"), F.col("f").alias("fi"), F.when(rim, 1 / F.col("rims")).otherwise(0.0).alias("ui"))
    b = c.select(F.col("idx").alias("j"), F.col("f").alias("fj"), F.when(rim, 1 / F.col("rims")).otherwise(0.0).alias("uj"))
    rows = pairs.join(a, "i").join(b, "j")
    return rows.agg((F.sum(F.expr("distance * fi * fj")) / 2).alias("v"), (F.sum(F.expr("distance * ui * uj")) / 2).alias("vmax"))


def lorenz_index(cells: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """n, f_star = int(n + 1 - sum / max) and lc = f_star / n of values shifted to 0 or more; no sort is needed."""
    keys = by or []
    x = F.col(column).cast("double")
    s = cells.groupBy(*keys).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.max(x).alias("hi"), F.min(x).alias("lo"))
    shift = F.least("lo", F.lit(0.0))
    f = F.floor(F.round(F.col("n") + 1 - F.try_divide(F.col("s") - shift * F.col("n"), F.col("hi") - shift), 9))
    return s.select(*keys, "n", f.alias("f_star"), (f / F.col("n")).alias("lc"))


def uci(pairs: DataFrame, cells: DataFrame, column: str, by: list[str] | None = None, potential: bool = False) -> DataFrame:
    """pi, lc and uci = pi * lc of each group, of people or of a ``potential``; concentration is that of all cells."""
    keys = by or []
    p, c = proximity_index(pairs, cells, column, by, potential), lorenz_index(cells, column, by)
    out = p.join(c, keys) if keys else p.crossJoin(c)  # one row each
    return out.select(*keys, "pi", "lc", (F.col("pi") * F.col("lc")).alias("uci"))


def lorenz_curve(cells: DataFrame, column: str, by: list[str]) -> DataFrame:
    """by columns, rank, x = rank / n, share: cumulative share of ascending values; ties by idx."""
    x = F.col(column).cast("double")
    w = Window.partitionBy(*by)
    up = w.orderBy(x, "idx")
    share = F.try_divide(F.sum(x).over(up.rowsBetween(Window.unboundedPreceding, 0)), F.sum(x).over(w))
    return cells.select(*by, F.row_number().over(up).alias("rank"), (F.row_number().over(up) / F.count("*").over(w)).alias("x"), share.alias("share"))


def centers(cells: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The n - f_star largest cells of each group; ties by idx."""
    f = lorenz_index(cells, column, by)
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(column), "idx")))
    return ranked.join(f, by).filter(F.col("rank") <= F.col("n") - F.col("f_star")).select(*by, "idx", column, "rank")


def densest_cell(cells: DataFrame) -> DataFrame:
    return cells.agg(F.max_by(F.struct("idx", "cx", "cy", "population"), F.struct("population", -F.col("idx"))).alias("c")).select("c.*")


def center_of_mass(cells: DataFrame, center: tuple[float, float]) -> DataFrame:
    """Mean over cells of population times offset from ``center``."""
    return cells.agg(F.avg(F.col("population") * (F.col("cx") - center[0])).alias("x"), F.avg(F.col("population") * (F.col("cy") - center[1])).alias("y"))


def inhabited_stats(cells: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """One row: mean population of inhabited and of all cells, cells above either, share of inhabited cells.

    ``flows`` (origin, destination, number_people) adds flow_share: pairs of cells with people over all ordered pairs. Null populations count as
    uninhabited cells; without cells means and shares are null.
    """
    p = F.col("population")
    lives = F.when(p > 0, p)
    means = cells.agg(F.avg(lives).alias("mean_inhabited"), F.avg(p).alias("mean_all"))
    out = cells.crossJoin(F.broadcast(means)).agg(  # one row
        F.first("mean_inhabited").alias("mean_inhabited"), F.first("mean_all").alias("mean_all"),
        F.count_if(p > F.col("mean_inhabited")).alias("above_inhabited"), F.count_if(p > F.col("mean_all")).alias("above_all"), F.try_divide(F.count_if(p > 0), F.count("*")).alias("inhabited_share"), F.count("*").alias("cells"),
    )
    if flows is None:
        return out.drop("cells")
    used = flows.filter("number_people > 0").agg(F.count_distinct("origin", "destination").alias("used"))
    return out.crossJoin(F.broadcast(used)).withColumn("flow_share", F.try_divide("used", F.col("cells") * F.col("cells"))).drop("cells", "used")  # one row
