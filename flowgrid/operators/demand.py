"""Demand: from flows between zones to persons with nodes and departures, and synthetic cities to draw it from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgrid.functions.storage import discard, materialize
from flowgrid.operators.tiling import haversine_km


def scale_od(od: DataFrame, rate: Column, by: list[str] | None = None) -> DataFrame:
    """n scaled so that about ``rate`` people a second set out in the hour (whole numbers, cut off), for each group."""
    total = od.groupBy(*(by or [])).agg(F.sum("n").alias("_s"))
    rows = od.join(F.broadcast(total), by) if by else od.crossJoin(F.broadcast(total))  # one row a group
    return rows.withColumn("n", F.expr("n * 3600").cast("bigint") * rate.cast("bigint")).withColumn("n", F.expr("n div _s")).drop("_s")


def own_rate(od: DataFrame, by: list[str]) -> DataFrame:
    """Each group scaled by its own whole number of people a second: about unchanged."""
    total = od.groupBy(*by).agg(F.floor(F.sum("n") / F.lit(3600.0)).alias("_r"))
    return scale_od(od.join(F.broadcast(total), by), F.col("_r"), by).drop("_r")  # one row a group


#: Persons that a task writes out, and those of one flow that come from one row.
TASK_PERSONS, BLOCK_PERSONS = 500_000, 10_000


def expand_persons(od: DataFrame, start_hour: Column, by: list[str] | None = None) -> DataFrame:
    """One row for each person: by columns, person (numbered through in order of group, origin, destination), origin,
    destination, pos, departure (seconds, evenly spread over the hour).

    Numbers come from sums over flows, in two levels, so persons are never sorted. Flows are stored, since they are read three times;
    they are cut into blocks that are dealt to tasks by the number of persons, so a large flow is no task's alone.
    """
    keys = by or []
    od = materialize(od.select(*keys, "origin", "destination", "n", start_hour.alias("_h")), "flows")
    total = od.agg(F.sum(F.greatest("n", F.lit(0)))).first()[0] or 0
    per_origin = od.groupBy(*keys, "origin").agg(F.sum("n").alias("m"))
    before = per_origin.withColumn("_b", F.coalesce(F.sum("m").over(Window.orderBy(*keys, "origin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    inner = Window.partitionBy(*keys, "origin").orderBy("destination").rowsBetween(Window.unboundedPreceding, -1)
    rows = od.withColumn("_i", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(before, [*keys, "origin"]).filter("n > 0")
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(BLOCK_PERSONS).cast("bigint"))))
    rows = rows.repartition(int(total) // TASK_PERSONS + 1)
    rows = rows.withColumn("pos", F.explode(F.sequence("_k", F.least(F.col("_k") + BLOCK_PERSONS, F.col("n")) - 1)))
    return rows.select(*keys, (F.col("_b") + F.col("_i") + F.col("pos")).alias("person"), "origin", "destination", "pos", (F.col("_h") * 3600 + F.col("pos") * 3600 / F.col("n")).alias("departure"))


def _pick(members: Column, seed: int) -> Column:
    """A member by a fixed mix of origin, destination and place."""
    mix = F.col("origin") * 7919 + F.col("destination") * 104729 + F.col("pos") * 1299709 + F.lit(seed)
    return F.get(members, F.pmod(mix, F.size(members).cast("bigint")).cast("int"))


def assign_nodes(persons: DataFrame, members: DataFrame, seed: int = 11) -> DataFrame:
    """Adds origin_node and destination_node, null where the zone has no node. ``members``: cell, node; a city's nodes."""
    lists = members.groupBy("cell").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    out = persons.join(lists.select(F.col("cell").alias("origin"), F.col("nodes").alias("_o")), "origin", "left").join(lists.select(F.col("cell").alias("destination"), F.col("nodes").alias("_d")), "destination", "left")
    return out.withColumns({"origin_node": _pick(F.col("_o"), seed), "destination_node": _pick(F.col("_d"), seed * 31)}).drop("_o", "_d")


def kept_lost(assigned: DataFrame) -> DataFrame:
    """One row: persons with both nodes, persons without, and their share (null if there is no person)."""
    ok = F.col("origin_node").isNotNull() & F.col("destination_node").isNotNull()
    return assigned.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("lost"), F.try_divide(F.count_if(~ok), F.count("*")).alias("loss"))


def day_demand(hours: DataFrame, control: int, rate: int) -> DataFrame:
    """Persons of a whole day from hourly flows (hour, origin, destination, n): the control hour at ``rate``, others as they are."""
    hours = materialize(hours, "hours")  # read for each total and for the flows
    rest = own_rate(hours.filter(F.col("hour") != control), ["hour"])
    both = scale_od(hours.filter(F.col("hour") == control), F.lit(rate), ["hour"]).unionByName(rest)
    return expand_persons(both, F.col("hour"), ["hour"])


def draw_centers(cells: DataFrame, scenarios: DataFrame, seed: int, bins: int = 30) -> DataFrame:
    """scenario, center, idx, cx, cy: for each (scenario, center) row a populated cell with roads.

    The distance from the densest cell is exponential with the mean distance as scale; the cell is one of the nearest
    distance bin, chosen by a seeded hash. Cells are one city's, so they are the side that may be broadcast.
    """
    live = cells.filter("population > 0 and with_roads")
    top = live.agg(F.max_by(F.struct("cx", "cy"), F.struct("population", -F.col("idx"))).alias("t")).select(F.col("t.cx").alias("tx"), F.col("t.cy").alias("ty"))
    live = live.crossJoin(F.broadcast(top)).withColumn("r", haversine_km("tx", "ty", "cx", "cy")).select("idx", "cx", "cy", "r")  # one row
    ends = live.agg(F.avg("r").alias("scale"), (F.max("r") / bins).alias("wide"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "scenario", "center"), F.lit(999983)) + 0.5) / F.lit(999983.0)
    draws = scenarios.crossJoin(F.broadcast(ends)).withColumn("at", F.floor(-F.col("scale") * F.ln(u) / F.col("wide")))  # one row
    near = draws.crossJoin(F.broadcast(live)).withColumn("gap", F.abs(F.floor(F.col("r") / F.col("wide")) - F.col("at")))
    order = F.struct("gap", F.xxhash64(F.lit(seed), "scenario", "center", "idx"))
    return near.groupBy("scenario", "center").agg(F.min_by(F.struct("idx", "cx", "cy"), order).alias("c")).select("scenario", "center", "c.*")


def spread(centers: DataFrame, seed: int, isotropic: bool = True, fixed: float | None = None) -> DataFrame:
    """Adds sx and sy (km): a fixed width, or one uniform in 2 to 15; isotropic ones are equal."""
    u = lambda axis: (F.pmod(F.xxhash64(F.lit(seed), F.lit(axis), "scenario", "center"), F.lit(1300)) / F.lit(100.0)) + 2
    sx = F.lit(float(fixed)) if fixed else u("x")
    return centers.withColumn("sx", sx).withColumn("sy", F.col("sx") if isotropic or fixed else u("y"))


def synth_population(cells: DataFrame, centers: DataFrame, kind: str, total: float) -> DataFrame:
    """scenario, idx and all cell columns with population: a sum of bumps around the scenario's centers, 0 off roads, sum ``total``.

    kind: 'exponential' or 'gaussian'. Every scenario has a few centers; cells are one city's.
    """
    x = haversine_km("gx", "gy", "cx", "gy")
    y = haversine_km("gx", "gy", "gx", "cy")
    bump = F.exp(-F.sqrt(x * x + y * y) / F.col("sx")) if kind == "exponential" else F.exp(-(x * x + y * y) / (F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")))
    c = centers.select("scenario", F.col("cx").alias("gx"), F.col("cy").alias("gy"), "sx", "sy")
    keep = [k for k in cells.columns if k != "population"]
    rows = c.crossJoin(F.broadcast(cells.drop("population"))).groupBy("scenario", *keep).agg(F.sum(bump).alias("b"))
    raw = F.when(F.col("with_roads"), F.col("b") / 2 + 1e-6).otherwise(0.0)
    return rows.withColumn("b", raw).withColumn("population", F.col("b") * total / F.sum("b").over(Window.partitionBy("scenario"))).drop("b")


def uci_coverage(scenarios: DataFrame, width: float = 0.1, most: int = 4) -> DataFrame:
    """The scenarios (scenario, uci) kept: at most ``most`` for each bucket of uci, with bucket and whether it is full."""
    b = scenarios.withColumn("bucket", F.floor(F.round(F.col("uci") / F.lit(width), 9)))
    w = Window.partitionBy("bucket")
    return b.withColumn("place", F.row_number().over(w.orderBy("scenario"))).withColumn("full", F.count("*").over(w) >= most).filter(F.col("place") <= most)


def scenario_search(block: Callable[[int], DataFrame], width: float = 0.1, most: int = 4) -> DataFrame:
    """``uci_coverage`` of the scenarios (scenario, uci) of one seed block after the other.

    A block comes in as long as some bucket that was reached isn't full and the block before it brought something; so the search ends
    after as many blocks as there are places in buckets at most. What is kept is stored after each one, so no block is made twice,
    and ``full`` tells the buckets that stayed open.
    """
    kept, n, k = None, 0, 0
    while True:
        new = block(k).select("scenario", "uci")
        rows = new if kept is None else kept.select("scenario", "uci").unionByName(new)
        old, kept = kept, materialize(uci_coverage(rows, width, most), "kept")
        if old is not None:
            discard(old)
        before, n, k = n, kept.count(), k + 1
        if n == before or kept.filter("not full").isEmpty():
            return kept


def departures(persons: DataFrame) -> DataFrame:
    """hour, n: persons by the hour they leave in; a null departure is an hour of its own."""
    return persons.groupBy(F.floor(F.col("departure") / F.lit(3600.0)).alias("hour")).agg(F.count("*").alias("n"))


def rate_grid(low: int, high: int, n: int, runs: DataFrame) -> DataFrame:
    """Every run (its columns) with n rates from ``low`` up in equal whole steps."""
    step = max(1, (high - low) // n)
    return runs.withColumn("r", F.explode(F.sequence(F.lit(low), F.lit(low + step * (n - 1)), F.lit(step))))
