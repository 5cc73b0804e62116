"""Vector fields of flows on the lattice of cells, their potential, rotor and harmonic part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vector_field(tij: DataFrame, pairs: DataFrame) -> DataFrame:
    """idx, out_x, out_y, in_x, in_y: directions weighted by people, summed by origin and by destination; 0 for none."""
    rows = tij.join(pairs.select(F.col("i").alias("origin"), F.col("j").alias("destination"), "dx", "dy"), ["origin", "destination"])
    rows = rows.withColumns({"x": F.col("number_people") * F.col("dx"), "y": F.col("number_people") * F.col("dy")})
    side = lambda key, tag: rows.groupBy(F.col(key).alias("idx")).agg(F.sum("x").alias(f"{tag}_x"), F.sum("y").alias(f"{tag}_y"))
    return side("origin", "out").join(side("destination", "in"), "idx", "full").fillna(0.0)


def lattice_potential(field: DataFrame, cells: DataFrame, edges: DataFrame, x: str = "out_x", y: str = "out_y") -> DataFrame:
    """idx, potential: step contributions dy * x + dx * y summed down the first column, then along each row.

    Every cell but the first has one incoming edge: from the cell before it in its row, or in the first column from the
    cell above. The two sums are windows over a column and over each row.
    """
    at = cells.select("idx", "i", "j").join(field.select("idx", x, y), "idx", "left").fillna(0.0, [x, y])
    step = edges.join(at.withColumnRenamed("idx", "a").drop("i", "j"), "a").select(F.col("b").alias("idx"), "way", (F.col("dy") * F.col(x) + F.col("dx") * F.col(y)).alias("c"))
    down = step.filter("way = 'i'").select("idx", F.col("c").alias("ci"))
    along = step.filter("way = 'j'").select("idx", F.col("c").alias("cj"))
    rows = at.join(down, "idx", "left").join(along, "idx", "left").fillna(0.0, ["ci", "cj"])
    rows = rows.withColumn("row", F.sum("cj").over(Window.partitionBy("i").orderBy("j")))
    # one number for each row: the lattice's height, not its area, meets in one task
    first = rows.filter("j = 0").select("i", F.sum("ci").over(Window.orderBy("i")).alias("column"))
    return rows.join(first, "i").select("idx", (F.col("column") + F.col("row")).alias("potential"))


def rotor(field: DataFrame, cells: DataFrame, edges: DataFrame, x: str = "out_x", y: str = "out_y") -> DataFrame:
    """idx, rotor: d(y)/dx - d(x)/dy on each cell's incoming edge, 0 without a step in that direction or an edge."""
    f = field.select("idx", x, y)
    e = edges.join(cells.select(F.col("idx").alias("b"), "j"), "b").filter("way = 'j' or j = 0")
    e = e.join(f.select(F.col("idx").alias("a"), F.col(x).alias("xa"), F.col(y).alias("ya")), "a").join(f.select(F.col("idx").alias("b"), F.col(x).alias("xb"), F.col(y).alias("yb")), "b")
    r = e.select(F.col("b").alias("idx"), ((F.col("yb") - F.col("ya")) * F.col("inv_dx") - (F.col("xb") - F.col("xa")) * F.col("inv_dy")).alias("rotor"))
    return cells.select("idx").join(r, "idx", "left").fillna(0.0, ["rotor"])


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "inv_dx", "inv_dy").union(edges.select("b", "a", "inv_dx", "inv_dy"))


def harmonic(potential: DataFrame, edges: DataFrame) -> DataFrame:
    """idx, harmonic: over all neighbours the squared inverse step times the difference of potential."""
    p = potential.select("idx", "potential")
    e = _both_ways(edges).join(p.select(F.col("idx").alias("a"), F.col("potential").alias("pa")), "a").join(p.select(F.col("idx").alias("b"), F.col("potential").alias("pb")), "b")
    weight = F.pow("inv_dx", F.lit(2.0)) + F.pow("inv_dy", F.lit(2.0))
    return e.groupBy(F.col("a").alias("idx")).agg(F.sum(weight * (F.col("pa") - F.col("pb"))).alias("harmonic"))


def smooth(values: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """idx, column: the mean of the neighbours' values, all at once; NaN and null are left out."""
    v = values.select(F.col("idx").alias("b"), F.when(~F.isnan(column), F.col(column)).alias("v"))
    return _both_ways(edges).join(v, "b").groupBy(F.col("a").alias("idx")).agg(F.avg("v").alias(column))


def potential_table(field: DataFrame, cells: DataFrame, edges: DataFrame) -> DataFrame:
    """idx, population, v_out, v_in, rotor_out, rotor_in, harmonic_out, harmonic_in."""
    out = cells.select("idx", "population")
    for tag in ("out", "in"):
        p = lattice_potential(field, cells, edges, f"{tag}_x", f"{tag}_y")
        out = out.join(p.select("idx", F.col("potential").alias(f"v_{tag}")), "idx")
        out = out.join(rotor(field, cells, edges, f"{tag}_x", f"{tag}_y").select("idx", F.col("rotor").alias(f"rotor_{tag}")), "idx")
        out = out.join(harmonic(p, edges).select("idx", F.col("harmonic").alias(f"harmonic_{tag}")), "idx")
    return out
