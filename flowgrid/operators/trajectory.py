"""Trips, routes and the trajectory fact: who was on which road when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Miles to kilometres as trajectories and congestion classes use it, and as road cleaning does.
KM_PER_MILE, KM_PER_MILE_ROADS = 1.6, 1.60934


def parse_route(text: Column) -> Column:
    """``"[5,,7,]"`` to its edge ids in order; empty items are dropped."""
    parts = F.filter(F.split(F.translate(text, "[] ", ""), ","), lambda x: x != "")
    return F.transform(parts, lambda x: x.cast("bigint"))


def explode_routes(routes: DataFrame) -> DataFrame:
    """p, pos, route: one row for each road of each route, in route order."""
    return routes.select("p", F.posexplode(parse_route(F.col("route"))).alias("pos", "route"))


def control_group(df: DataFrame, start: float = 7, end: float = 8, column: str = "time_departure") -> DataFrame:
    """Trips that depart in [start, end) hours."""
    return df.filter((F.col(column) >= int(start * 3600)) & (F.col(column) < int(end * 3600)))


def arrived_in(df: DataFrame, start: float, end: float) -> DataFrame:
    """Trips that arrive in [start, end) seconds."""
    return df.filter((F.col("last_time_simulated") >= start) & (F.col("last_time_simulated") < end))


def drop_if_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def dedupe(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a declared order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def convert_units(df: DataFrame) -> DataFrame:
    """Adds speed_kmh, length_km, hours and mps from speed_mph, length, time_departure."""
    kmh = F.col("speed_mph") * F.lit(KM_PER_MILE)
    return df.withColumns({"speed_kmh": kmh, "speed_kmh_roads": F.col("speed_mph") * F.lit(KM_PER_MILE_ROADS), "length_km": F.col("length") / F.lit(1000.0), "mps": kmh / F.lit(3.6)})


def valid_trips(people: DataFrame, most_kmh: float = 150.0) -> DataFrame:
    """Trips with a duration and a mean speed (kmh) below the limit."""
    speed = F.try_divide(F.col("distance"), F.col("num_steps").cast("double")) * F.lit(3.6)
    return people.filter("num_steps <> 0").withColumn("kmh", speed).filter(F.col("kmh") < most_kmh)


def trajectory(routes: DataFrame, people: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each (person, road): routes with their trips, valid ones only, and the roads' attributes.

    Roads that aren't in ``edges`` are dropped. Roads are a table of fixed size (a city's network), so Spark may
    broadcast them if they are small; trips and routes meet on p. With ``parts`` roads come first and trips and routes
    are dealt over that many partitions, so routes are shuffled once for their trips and for the order of their roads.
    """
    trips, road = valid_trips(people), routes.route == edges.uniqueid
    if not parts:
        return routes.join(trips, "p").join(edges, road)
    return routes.join(edges, road).repartition(parts, "p").join(trips.repartition(parts, "p"), "p")


def road_times(traj: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds own (seconds on the road), time_leaving_road and time_entering_road, roads in route order.

    ``parts``: how many partitions the trips are dealt over for it; else Spark decides.
    """
    traj = traj.repartition(parts, "p") if parts else traj
    w = Window.partitionBy("p").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = traj.withColumn("own", F.col("length") / (F.col("distance") / F.col("num_steps")))
    out = out.withColumn("time_leaving_road", F.col("time_departure") + F.sum("own").over(w))
    return out.withColumn("time_entering_road", F.col("time_leaving_road") - F.col("own"))
