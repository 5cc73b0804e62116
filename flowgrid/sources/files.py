"""Readers and writers of the file formats that trips, routes, networks, flows and results come in. No schema is guessed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.functions.storage import fresh_path

TRIPS = "p long, o_custkey long, time_departure long, distance double, num_steps long, last_time_simulated long"
ROUTES = "p long, distance double, route string"
EDGES = "uniqueid long, u long, v long, length double, speed_mph long, lanes long"
NODES = "index long, osmid long, x double, y double"
PAIRS = "i long, j long, dir_vector string, distance double"
FITS = "uci10 long, r long, t0 long, t double, n long, alpha_pl double, a_pl double, err_pl double, alpha_exp double, a_exp double, err_exp double"
CELLS = "features array<struct<properties: struct<idx: long, population: long>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"


def stored_and_read(df: DataFrame, write: Callable, read: Callable) -> DataFrame:
    """Write a table in a format to the shared folder and read it back."""
    path = fresh_path(df.sparkSession, write.__name__)
    write(df, path)
    return read(df.sparkSession, path)


def read_trips(spark: SparkSession, path: str, schema: str = TRIPS) -> DataFrame:
    """Trips from Parquet if the path says so, else from CSV with a header."""
    return spark.read.schema(schema).parquet(path) if path.endswith(".parquet") else spark.read.schema(schema).option("header", True).csv(path)


def write_trips(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """p, distance, route (still text): separated by colons, or Parquet."""
    return spark.read.schema(ROUTES).parquet(path) if path.endswith(".parquet") else spark.read.schema(ROUTES).options(header=True, sep=":").csv(path)


def write_routes(df: DataFrame, path: str) -> None:
    df.select("p", "distance", "route").write.options(header=True, sep=":").csv(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGES).option("header", True).csv(path)


def write_edges(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """index, osmid, x, y of a network's nodes."""
    return spark.read.schema(NODES).option("header", True).csv(path)


def write_nodes(df: DataFrame, path: str) -> None:
    df.select("index", "osmid", "x", "y").write.option("header", True).csv(path)


def read_network(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a network's folder: nodes.csv and edges.csv."""
    return read_nodes(spark, f"{folder}/nodes.csv"), read_edges(spark, f"{folder}/edges.csv")


def _numbers() -> list:
    part = F.split(F.trim("line"), r"\s+")
    return [F.get(part, F.lit(k)).try_cast("double").cast("bigint").alias(c) for k, c in enumerate(("origin", "destination", "number_people"))]


def _without_heads(skip: int):
    """Drops the first lines of each file. A task reads a block of a file in order, and the block that begins at 0 has the head."""

    def run(batches):
        import pyarrow as pa

        seen: dict[str, int] = {}
        for b in batches:
            starts = b.column("start").to_pylist()
            if 0 in starts:
                keep = []
                for file, start in zip(b.column("file").to_pylist(), starts):
                    if start == 0:
                        seen[file] = seen.get(file, 0) + 1
                    keep.append(start != 0 or seen[file] > skip)
                b = b.filter(pa.array(keep))
            yield b.select([c for c in b.schema.names if c not in ("file", "start")])

    return run


def _od_lines(spark: SparkSession, path: str, skip: int, **options: str) -> DataFrame:
    """line, name (of the file) and the folder's columns of every line behind each file's head that isn't empty.

    Spark cuts large files into blocks at line ends, so a file of any size is read by several tasks, a batch of lines at a time. The head
    has to fit the first block (``spark.sql.files.maxPartitionBytes``).
    """
    rows = spark.read.options(**options).text(path)
    more = [c for c in rows.columns if c != "value"]
    rows = rows.select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("name"), *more, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    kinds = dict(rows.dtypes)
    body = rows.mapInArrow(_without_heads(skip), ", ".join(f"{c} {kinds[c]}" for c in ("line", "name", *more)))
    return body.filter(F.trim("line") != "")


def read_od_text(spark: SparkSession, path: str, skip: int = 6) -> DataFrame:
    """origin, destination, number_people of every line after the first ``skip`` of each file; what isn't a number is null."""
    return _od_lines(spark, path, skip, recursiveFileLookup="true").select(*_numbers())


HEADER = 6


def _with_headers(lines: DataFrame, keys: list[str], files: int) -> DataFrame:
    """keys, slice, at, value: the lines dealt to ``files`` slices of each key by hash, HEADER lines before each slice's."""
    dealt = lines.withColumns({"slice": F.pmod(F.xxhash64("value"), F.lit(files)).cast("int"), "at": F.lit(0)})
    heads = dealt.select(*keys, "slice").distinct().withColumn("at", F.explode(F.sequence(F.lit(-HEADER), F.lit(-1))))
    heads = heads.withColumn("value", F.format_string("* header %d", F.col("at") + HEADER))
    both = dealt.select(*keys, "slice", "at", "value").unionByName(heads.select(*keys, "slice", "at", "value"))
    return both.repartition(*keys, "slice").sortWithinPartitions(*keys, "slice", "at").drop("at")


def write_od_text(df: DataFrame, path: str, files: int = 4) -> None:
    """Six header lines, then ``o d n``, in ``files`` files: one row a line, never a file in a row."""
    line = F.concat_ws(" ", "origin", "destination", F.concat(F.col("number_people").cast("string"), F.lit(".75")))
    _with_headers(df.select(line.alias("value")), [], files).write.partitionBy("slice").text(path)


def read_od_by_hour(spark: SparkSession, path: str, skip: int = 6) -> DataFrame:
    """hour, origin, destination, number_people: the hour comes from file names that end in D<hour>.fma, or from folders."""
    lines = _od_lines(spark, path, skip)
    hour = F.col("hour") if "hour" in lines.columns else F.regexp_extract("name", r"D(\d+)\.fma$", 1)
    return lines.select(hour.cast("bigint").alias("hour"), *_numbers())


def write_od_by_hour(df: DataFrame, path: str, files: int = 2) -> None:
    """A folder for each hour (the column hour, else the origin's number modulo 24) with up to ``files`` files of lines."""
    hour = F.col("hour") if "hour" in df.columns else F.col("origin") % 24
    lines = df.select(hour.alias("hour"), F.concat_ws(" ", "origin", "destination", "number_people").alias("value"))
    _with_headers(lines, ["hour"], files).write.partitionBy("hour", "slice").text(path)


def run_catalog(paths: DataFrame) -> DataFrame:
    """uci, r, start_hour, end_hour, people_file, route_file of a table of paths named R_<r>_UCI_<u>_0_<kind><a>to<b>."""
    name = r"R_([\d.]+)_UCI_([\d.]+)_0_(people|route)(\d+)to(\d+)"
    g = lambda k: F.regexp_extract("path", name, k)
    rows = paths.filter(F.col("path").rlike(name)).select("path", g(1).cast("bigint").alias("r"), g(2).cast("double").alias("uci"), g(3).alias("kind"), g(4).cast("bigint").alias("start_hour"), g(5).cast("bigint").alias("end_hour"))
    key = ["uci", "r", "start_hour", "end_hour"]
    people = rows.filter("kind = 'people'").select(*key, F.col("path").alias("people_file"))
    return people.join(rows.filter("kind = 'route'").select(*key, F.col("path").alias("route_file")), key)


def read_cell_pairs(spark: SparkSession, path: str) -> DataFrame:
    """i, j, x, y, distance: the direction comes as text such as ``[a b]``."""
    return spark.read.schema(PAIRS).option("header", True).csv(path).select("i", "j", *parse_vector(F.col("dir_vector")), "distance")


def write_cell_pairs(df: DataFrame, path: str) -> None:
    text = F.concat(F.lit("["), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit("]"))
    df.select("i", "j", text.alias("dir_vector"), "distance").write.option("header", True).csv(path)


def parse_vector(text):
    """x and y of ``[a b]`` or ``[a,b]``; what isn't a number is 0."""
    part = F.split(F.trim(F.regexp_replace(text, r"[\[\],\s]+", " ")), " ")
    return [F.coalesce(F.nanvl(F.get(part, F.lit(k)).try_cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for k, c in enumerate("xy")]


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """idx, population, minx, miny, maxx, maxy of GeoJSON features."""
    f = spark.read.schema(CELLS).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    ring = F.get(F.col("f.geometry.coordinates"), F.lit(0))
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return f.select("f.properties.idx", "f.properties.population", F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def write_cells(df: DataFrame, path: str) -> None:
    point = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(point("minx", "miny"), point("maxx", "miny"), point("maxx", "maxy"), point("minx", "maxy"), point("minx", "miny"))
    feature = F.struct(F.struct("idx", "population").alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    df.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.collect_list(feature).alias("features")).select("features").write.json(path)


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """cell, node of JSON maps from cell to its nodes."""
    m = spark.read.text(path).select(F.from_json("value", "map<string, array<bigint>>").alias("m"))
    return m.select(F.explode("m").alias("cell", "nodes")).select(F.col("cell").cast("bigint").alias("cell"), F.explode("nodes").alias("node"))


def write_membership(df: DataFrame, path: str) -> None:
    """One JSON map a line, each with some cells."""
    cells = df.groupBy("cell").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    cells.select(F.to_json(F.create_map(F.col("cell").cast("string"), "nodes")).alias("value")).write.text(path)


def compact(spark: SparkSession, source: str, target: str, schema: str, sep: str = ",") -> None:
    """CSV to Parquet."""
    spark.read.schema(schema).options(header=True, sep=sep).csv(source).write.option("compression", "snappy").parquet(target)


def write_run_output(df: DataFrame, path: str, run: tuple[str, str] = ("uci10", "r")) -> None:
    """A result by run: writing again replaces only the runs that are in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*run).parquet(path)


def write_demand(df: DataFrame, path: str) -> None:
    df.write.partitionBy("uci10", "r").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FITS).json(path)


def read_scenario_population(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all Grid_<uci>.parquet under a folder, with the index that each file's name gives."""
    uci = F.regexp_extract(F.col("_metadata.file_path"), r"Grid_([\d.]+)\.parquet", 1).cast("double")
    return spark.read.parquet(f"{path}/Grid_*.parquet").select("*", uci.alias("uci"))
