"""Time bins and slices: unloading curves, flux and speed on every road, macroscopic diagrams, transitions.

A day has 95 bins whose limits are the truncated values of 96 evenly spread instants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgrid.operators.trajectory import KM_PER_MILE

BINS, DAY = 95, 86400


def bin_of(second: Column) -> Column:
    """The bin that an integer second is in."""
    return F.floor(((second.cast("bigint") + 1) * BINS - 1) / F.lit(float(DAY))).cast("bigint")


def bin_start(k: Column) -> Column:
    return F.floor(k.cast("double") * DAY / F.lit(float(BINS))).cast("bigint")


def first_instant(second: Column) -> Column:
    """The first of the 96 instants that is not before ``second``."""
    return F.floor((F.ceil(second).cast("bigint") * BINS + (DAY - 1)) / F.lit(float(DAY))).cast("bigint")


def last_instant(second: Column) -> Column:
    return F.least(bin_of(F.floor(second)), F.lit(BINS).cast("bigint"))


def spine(spark) -> DataFrame:
    """The 95 bin numbers."""
    return spark.range(BINS).withColumnRenamed("id", "k")


def unload_curve(traj: DataFrame, run: list[str]) -> DataFrame:
    """run columns, k, n_rows, n_people: arrivals by bin, all 95 bins for every run; the last bin stays 0."""
    counts = traj.select(*run, "p", bin_of(F.col("last_time_simulated")).alias("k")).filter(F.col("k") < BINS - 1)
    counts = counts.groupBy(*run, "k").agg(F.count("*").alias("n_rows"), F.count_distinct("p").alias("n_people"))
    every = traj.select(*run).distinct().crossJoin(F.broadcast(spine(traj.sparkSession)))  # 95 rows
    return every.join(counts, [*run, "k"], "left").fillna(0, ["n_rows", "n_people"])


def fractions(unload: DataFrame, run: list[str]) -> DataFrame:
    """Adds time_hours and fraction: the share of a run's total that each bin has."""
    total = F.sum("n_rows").over(Window.partitionBy(*run))
    return unload.withColumn("time_hours", bin_start(F.col("k")) / F.lit(3600.0)).withColumn("fraction", F.try_divide(F.col("n_rows").cast("double"), total.cast("double")))


def arrival_histogram(people: DataFrame, dt: int = 25) -> DataFrame:
    """k, n: trips with a duration by bins of ``dt`` minutes of arrival, limits excluded."""
    wide = dt * 60
    rows = people.filter("time_departure <> last_time_simulated").filter(F.col("last_time_simulated") % wide != 0)
    return rows.groupBy(F.floor(F.col("last_time_simulated") / F.lit(float(wide))).alias("k")).agg(F.count("*").alias("n"))


def _spans(traj: DataFrame, start: str, end: str) -> DataFrame:
    """Adds _k0 and _k1, the first and last instant inside [start, end]; rows without one are left out."""
    k0, k1 = first_instant(F.col(start)), last_instant(F.col(end))
    return traj.withColumns({"_k0": k0, "_k1": k1}).filter("_k0 <= _k1")


def _at_instants(spans: DataFrame) -> DataFrame:
    return spans.withColumn("k", F.explode(F.sequence("_k0", "_k1"))).drop("_k0", "_k1")


def stab(traj: DataFrame, start: str = "time_departure", end: str = "time_leaving_road") -> DataFrame:
    """Every row once for each instant k inside its [start, end]; linear in what comes out."""
    return _at_instants(_spans(traj, start, end))


def edge_slices(traj: DataFrame, run: list[str] | None = None, start: str = "time_departure", parts: int | None = None) -> DataFrame:
    """run columns, route, k, flux, speed_kmh: people on each road at each instant and their mean speed.

    Rows go to the task of their road before they are repeated for their instants, so that each is shuffled once.
    ``parts``: over how many partitions the roads are dealt for it; else Spark decides.
    """
    by = [*(run or []), "route"]
    spans = _spans(traj, start, "time_leaving_road").select(*by, "p", "kmh", "_k0", "_k1")
    spans = spans.repartition(parts, "route") if parts else spans.repartition("route")
    return _at_instants(spans).groupBy(*by, "k").agg(F.count("p").alias("flux"), F.avg("kmh").alias("speed_kmh"))


def edge_slices_wide(slices: DataFrame, instants: list[int]) -> DataFrame:
    """One row for each road, with flux_k and speed_kmh_k for the given instants; 0 where nobody was."""
    wide = slices.groupBy("route").pivot("k", instants).agg(F.first("flux").alias("flux"), F.first("speed_kmh").alias("speed_kmh"))
    names = [F.col("route")] + [F.coalesce(F.col(f"{k}_{c}"), F.lit(0)).alias(f"{c}_{k}") for k in instants for c in ("flux", "speed_kmh")]
    return wide.select(*names)


def edges_with_slices(edges: DataFrame, slices: DataFrame) -> DataFrame:
    """All roads with their slices, quiet ones too; of roads with the same ends the one of least id stays."""
    one = edges.withColumn("_n", F.row_number().over(Window.partitionBy("u", "v").orderBy("uniqueid"))).filter("_n = 1").drop("_n")
    return one.join(slices, one.uniqueid == slices.route, "left").drop("route")


def gamma(traj: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Length travelled over capacity times length."""
    return traj.groupBy(*(run or [])).agg((F.sum("length") / F.sum(F.col("capacity") * F.col("length"))).alias("gamma"))


def road_time_table(edges: DataFrame, slices: DataFrame, instants: DataFrame) -> DataFrame:
    """Every road at every instant (column k): mean speed and people, free-flow speed and 0 where nobody was."""
    every = edges.select(F.col("uniqueid").alias("route"), "speed_mph").crossJoin(F.broadcast(instants))  # 96 rows at most
    out = every.join(slices, ["route", "k"], "left")
    return out.select("route", "k", F.coalesce("speed_kmh", F.col("speed_mph") * F.lit(KM_PER_MILE)).alias("speed_kmh"), F.coalesce("flux", F.lit(0)).alias("people"))


def mfd(slices: DataFrame) -> DataFrame:
    """k, people, flow (sum of speed times people): the macroscopic diagram."""
    return slices.groupBy("k").agg(F.sum("flux").alias("people"), F.sum(F.col("speed_kmh") * F.col("flux")).alias("flow"))


def traffic_classes(slices: DataFrame, edges: DataFrame, limits: tuple[float, float, float] = (0.25, 0.5, 0.9)) -> DataFrame:
    """Adds u, v, ratio (to the speed limit), the nested flags severe, moderate, free_flow, and traffic_class."""
    out = slices.join(edges.select(F.col("uniqueid").alias("route"), "u", "v", "speed_mph"), "route")
    ratio = F.round(F.try_divide(F.col("speed_kmh"), F.col("speed_mph") * F.lit(KM_PER_MILE)), 9)
    out = out.withColumn("ratio", ratio)
    flags = {n: F.coalesce(F.col("ratio") < q, F.lit(False)) for n, q in zip(("severe", "moderate", "free_flow"), limits)}
    named = F.when(flags["severe"], "severe").when(flags["moderate"], "moderate").when(flags["free_flow"], "free_flow").otherwise("none")
    return out.withColumns(flags | {"traffic_class": named})


def class_counts(classes: DataFrame) -> DataFrame:
    return classes.groupBy("k").agg(*[F.count_if(F.col(c)).alias(c) for c in ("severe", "moderate", "free_flow")], F.count("*").alias("roads"))


def trapped(traj: DataFrame) -> DataFrame:
    """route, k, n, users: who is on each road at each instant, by the time they entered it."""
    inside = stab(traj, "time_entering_road")
    return inside.groupBy("route", "k").agg(F.count_distinct("p").alias("n"), F.array_sort(F.collect_set("p")).alias("users"))


def transitions(traj: DataFrame, step: int = 1) -> DataFrame:
    """k, e, e2, n, share: people on road e at k and on e2 at k + step; share of those on e."""
    at = stab(traj, "time_entering_road").select("p", "k", "route").distinct()
    later = at.select("p", (F.col("k") - step).alias("k"), F.col("route").alias("e2"))
    n = at.withColumnRenamed("route", "e").join(later, ["p", "k"]).groupBy("k", "e", "e2").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("k", "e")))


def exited(traj: DataFrame, step: int = 1) -> DataFrame:
    """k, n: people present at k and at no road at k + step."""
    at = stab(traj, "time_entering_road").select("p", "k").distinct()
    later = at.select("p", (F.col("k") - step).alias("k"))
    return at.join(later, ["p", "k"], "left_anti").groupBy("k").agg(F.count("*").alias("n"))


def routes_used(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_edges, n_used, n_unused."""
    used = routes.select(F.col("route").alias("uniqueid")).distinct()
    flagged = edges.select("uniqueid").join(used.withColumn("hit", F.lit(1)), "uniqueid", "left")
    return flagged.agg(F.count("*").alias("n_edges"), F.count("hit").alias("n_used"), (F.count("*") - F.count("hit")).alias("n_unused"))


def present(traj: DataFrame) -> DataFrame:
    """k, n: people between departure and arrival at each instant."""
    people = traj.select("p", "time_departure", "last_time_simulated").distinct()
    out = people.withColumn("end", F.col("last_time_simulated") - 1)
    return stab(out, "time_departure", "end").groupBy("k").agg(F.count("*").alias("n"))
