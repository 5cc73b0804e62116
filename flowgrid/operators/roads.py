"""Road cleaning: speeds, lanes and classes as raw map data has them, imputation, capacity, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrid.operators.trajectory import KM_PER_MILE_ROADS

# Road classes that are kept, in the order of importance.
TYPES = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "road")

# Lanes of a class where none are known.
LANES = {
    "motorway": 4, "motorway_link": 1, "trunk": 3, "trunk_link": 1, "primary": 3, "primary_link": 1,
    "secondary": 3, "secondary_link": 1, "tertiary": 2, "tertiary_link": 1, "unclassified": 2, "road": 1,
}

# Miles an hour of a class with 1, 2, 3 and 4 lanes, and with an unknown number.
SPEEDS = {
    "motorway": (50, 50, 65, 65, 57.5), "motorway_link": (50, 50, 65, 65, 57.5), "trunk": (45, 45, 45, 45, 45), "trunk_link": (45, 45, 45, 45, 45),
    "primary": (30, 30, 30, 30, 30), "primary_link": (30, 30, 30, 30, 30), "secondary": (25, 25, 25, 25, 25), "secondary_link": (25, 25, 25, 25, 25),
    "tertiary": (20, 20, 20, 20, 20), "tertiary_link": (20, 20, 20, 20, 20), "unclassified": (20, 20, 20, 20, 20), "road": (30, 30, 30, 30, 30),
}

# Vehicles an hour on each lane of a class with 1, 2, 3 and 4 lanes, and with an unknown number.
CAPACITIES = {
    "motorway": (1900, 2000, 2000, 2200, 2025), "motorway_link": (1900, 2000, 2000, 2200, 2025), "trunk": (1900, 2000, 2000, 2000, 1975), "trunk_link": (1900, 2000, 2000, 2000, 1975),
    "primary": (1000, 1000, 1000, 1000, 1000), "primary_link": (1000, 1000, 1000, 1000, 1000), "secondary": (900, 900, 900, 900, 900), "secondary_link": (900, 900, 900, 900, 900),
    "tertiary": (900, 900, 900, 900, 900), "tertiary_link": (900, 900, 900, 900, 900), "unclassified": (800, 800, 800, 800, 800), "road": (900, 900, 900, 900, 900),
}

# Vehicles an hour on each lane by class; classes that aren't here carry none.
US_CAPACITIES = {
    "motorway": 2000, "motorway_link": 1800, "trunk": 1800, "trunk_link": 1600, "primary": 1600, "primary_link": 1400, "secondary": 1400, "secondary_link": 1200,
    "tertiary": 1200, "tertiary_link": 1000, "unclassified": 800, "residential": 600, "living_street": 300, "service": 400, "track": 200, "road": 1000,
    "bus_guideway": 1000, "byway": 200, "busway": 1000,
}


def items(text: Column) -> Column:
    """The items of a value that may be one string, a list written as a string, or parts between semicolons."""
    parts = F.split(F.translate(text, "[]\"'", ""), r"\s*[,;|]\s*")
    return F.filter(parts, lambda x: F.trim(x) != "")


def first_of_list(text: Column) -> Column:
    """A string that looks like a list as an array; other strings as an array of one; null stays null."""
    return F.when(F.trim(text).startswith("["), items(text)).when(text.isNotNull(), F.array(text))


def _number(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"^\s*(\d+)", 1), F.lit("")).cast("double")


def parse_maxspeed(text: Column, default: float = 10.0) -> Column:
    """Mean of all numbers in the value; ``default`` if there is none; null if missing."""
    numbers = F.filter(F.transform(items(text), _number), lambda x: x.isNotNull())
    mean = F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(numbers), F.lit(0)).cast("double")
    return F.when(text.isNotNull(), F.coalesce(mean, F.lit(default)))


def parse_maxspeed_first(text: Column) -> Column:
    """The first item's whole number of mph, 0 if missing or no number."""
    return F.coalesce(_number(F.get(items(text), F.lit(0))).cast("bigint"), F.lit(0))


def speed_limit_kmh(text: Column, default_mph: float = 35.0) -> Column:
    mph = parse_maxspeed_first(text)
    return F.when(mph == 0, F.lit(default_mph)).otherwise(mph) * F.lit(KM_PER_MILE_ROADS)


def parse_lanes(text: Column) -> Column:
    """Lists: whole mean of the one-digit items; ``a-b`` and ``a;b``: the first piece."""
    many = F.transform(F.filter(items(text), lambda x: F.trim(x).rlike(r"^\d$")), lambda x: F.trim(x).cast("double"))
    mean = F.floor(F.aggregate(many, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(many), F.lit(0)).cast("double"))
    return F.when(F.trim(text).startswith("["), mean).otherwise(_number(F.get(F.split(text, "[-;]"), F.lit(0))).cast("bigint"))


def parse_lanes_first(text: Column) -> Column:
    """The number that the value begins with (list marks aside), else 0."""
    return F.coalesce(_number(F.translate(text, "[]\"'", "")).cast("bigint"), F.lit(0))


def collapse_highway(text: Column) -> Column:
    """Of several classes the first that has defaults, else the first."""
    known = F.filter(items(text), lambda x: x.isin(*TYPES))
    return F.coalesce(F.get(known, F.lit(0)), F.get(items(text), F.lit(0)))


def _lookup(spark, values: dict[str, float | tuple], name: str) -> DataFrame:
    """highway and the value, or with lanes from 1 to 4 (-1: unknown) as a further key; a table of fixed size."""
    if isinstance(next(iter(values.values())), tuple):
        rows, keys = [(k, n, float(x)) for k, v in values.items() for n, x in zip((1, 2, 3, 4, -1), v)], "highway string, of_lanes long"
    else:
        rows, keys = [(k, float(v)) for k, v in values.items()], "highway string"
    return F.broadcast(spark.createDataFrame(rows, f"{keys}, {name} double"))


def impute_lanes(roads: DataFrame, source: str = "constant") -> DataFrame:
    """Missing lanes by the class's constant, or by the class's median."""
    if source == "median":
        fill = roads.groupBy("highway").agg(F.percentile("lanes", 0.5).alias("fill"))
    else:
        fill = _lookup(roads.sparkSession, LANES, "fill")
    return roads.join(fill, "highway", "left").withColumn("lanes", F.coalesce("lanes", F.col("fill").cast("bigint"), F.lit(1))).drop("fill")


def allocate_lanes(roads: DataFrame, most: int = 4) -> DataFrame:
    """Two-way roads get half their lanes, 1 at least; lanes_capped is limited."""
    half = F.when(F.col("oneway"), F.col("lanes")).otherwise(F.floor(F.col("lanes") / F.lit(2.0)))
    return roads.withColumn("lanes", F.greatest(half, F.lit(1))).withColumn("lanes_capped", F.least("lanes", F.lit(most)))


def _by_lanes(roads: DataFrame, values: dict[str, tuple], name: str) -> DataFrame:
    known = F.when(F.col("lanes_capped").between(1, 4), F.col("lanes_capped")).otherwise(F.lit(-1)).cast("long")
    return roads.withColumn("of_lanes", known).join(_lookup(roads.sparkSession, values, name), ["highway", "of_lanes"], "left").drop("of_lanes")


def infer_speed(roads: DataFrame) -> DataFrame:
    """Adds speed_mph: the known limit (maxspeed), else that of the class with lanes_capped lanes; null for classes without one."""
    return _by_lanes(roads, SPEEDS, "fill").withColumn("speed_mph", F.coalesce("maxspeed", "fill")).drop("fill")


def infer_capacity(roads: DataFrame) -> DataFrame:
    """Adds capacity: what each lane of the class with lanes_capped lanes carries, times lanes; null for classes without one."""
    return _by_lanes(roads, CAPACITIES, "per_lane").withColumn("capacity", F.col("per_lane") * F.col("lanes")).drop("per_lane")


def capacity_us(roads: DataFrame) -> DataFrame:
    """Adds capacity: what each lane of the class carries, times lanes; 0 for classes that the table doesn't know."""
    out = roads.join(_lookup(roads.sparkSession, US_CAPACITIES, "per_lane"), "highway", "left")
    return out.withColumn("capacity", F.coalesce("per_lane", F.lit(0.0)) * F.col("lanes")).drop("per_lane")


def clean_edges(raw: DataFrame) -> DataFrame:
    """uniqueid, u, v, highway, lanes, speed_kmh, capacity of raw roads."""
    rows = raw.select("uniqueid", "u", "v", collapse_highway(F.col("highway")).alias("highway"), parse_lanes_first(F.col("lanes")).alias("lanes"), speed_limit_kmh(F.col("maxspeed")).alias("speed_kmh"))
    return capacity_us(rows)


def major_roads(edges: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """Only roads of the given classes; a null class goes."""
    return edges.filter(F.col("highway").isin(*types))


def nodes_of(nodes: DataFrame, edges: DataFrame, key: str = "index") -> DataFrame:
    """Nodes that some edge still touches."""
    ends = edges.select(F.col("u").alias(key)).union(edges.select("v")).distinct()
    return nodes.join(ends, key, "left_semi")


def densify_ids(edges: DataFrame) -> DataFrame:
    """Adds u_id and v_id: both ends numbered 0 to n - 1 in the order of the old ids.

    Numbers come from counts of ranges, not from one sorted task: ids are dealt into ranges, ranges are counted, and
    each id adds its place in its range to the ids before the range.
    """
    ends = edges.select(F.col("u").alias("old")).union(edges.select("v")).distinct()
    ranged = ends.withColumn("part", F.floor(F.col("old") / F.lit(4096.0)))
    from pyspark.sql import Window

    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("old")) - 1
    ids = ranged.withColumn("place", place).join(before, "part").select("old", (F.col("place") + F.col("before")).alias("id"))
    out = edges.join(ids.select(F.col("old").alias("u"), F.col("id").alias("u_id")), "u")
    return out.join(ids.select(F.col("old").alias("v"), F.col("id").alias("v_id")), "v")


def map_endpoints(edges: DataFrame, nodes: DataFrame, source: str = "index", target: str = "osmid") -> DataFrame:
    """u and v from one node column to another."""
    a = nodes.select(F.col(source).alias("u"), F.col(target).alias("u_new"))
    b = nodes.select(F.col(source).alias("v"), F.col(target).alias("v_new"))
    return edges.join(a, "u").join(b, "v").withColumn("u", F.col("u_new")).withColumn("v", F.col("v_new")).drop("u_new", "v_new")


def percentile_band(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose value lies between two percentiles (interpolated), both included."""
    limits = df.agg(F.percentile(column, low).alias("_lo"), F.percentile(column, high).alias("_hi"))
    return df.join(F.broadcast(limits), F.expr(f"{column} >= _lo and {column} <= _hi")).drop("_lo", "_hi")  # one row


def bbox(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    return df.filter(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3]))


def restrict_pairs(pairs: DataFrame, cells: DataFrame, i: str = "i", j: str = "j", key: str = "idx") -> DataFrame:
    """Pairs with both ends among the cells."""
    return pairs.join(cells.select(F.col(key).alias(i)), i, "left_semi").join(cells.select(F.col(key).alias(j)), j, "left_semi")


def subsample(tij: DataFrame, cells: list[int] | None = None) -> DataFrame:
    """kind, cell and all columns of the flows out of a cell (kind origin), into it (destination) and of both (cell), for each cell or the listed ones.

    A flow from a cell to itself is one row of each kind. Flows with a null end belong to their other end only.
    """
    kinds = F.array(
        F.struct(F.lit("origin").alias("kind"), F.col("origin").alias("cell")), F.struct(F.lit("destination").alias("kind"), F.col("destination").alias("cell")),
        F.struct(F.lit("cell").alias("kind"), F.col("origin").alias("cell")),
        F.struct(F.lit("cell").alias("kind"), F.when(~F.col("origin").eqNullSafe(F.col("destination")), F.col("destination")).alias("cell")),
    )
    rows = tij.select(F.explode(kinds).alias("of"), *tij.columns).select("of.kind", "of.cell", *tij.columns).filter("cell is not null")
    return rows if cells is None else rows.filter(F.col("cell").isin(*cells))
