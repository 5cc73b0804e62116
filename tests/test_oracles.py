"""A part of the registered queries against DuckDB on the smallest tables; the rest run the same way at larger scale."""

import math

import duckdb
import pandas as pd
import pytest

from flowgrid.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "m01_parse_route", "p06_valid_trips", "p07_maxspeed", "p09_lanes", "p17_clean_edges", "p20_densify_ids", "w01_road_times", "a01_unload_curve", "j07_stabbing", "a04_edge_slices",
    "c01_classes", "j08_transitions", "f02_pl_vs_exp", "f03_jam", "f04_tau", "f07_gravity_fit", "a08_od_matrix", "a13_proximity_index", "a16_uci", "w04_potential", "c08_harmonic",
    "c02_components", "c11_relative_neighbours", "g02_locate", "j12_overlap", "j11_point_in_polygon", "a06_hist_distance", "d02_persons", "d04_day_demand", "d08_synth_population", "w08_thin",
]


def norm(df: pd.DataFrame) -> pd.DataFrame:
    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "~"
        return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    out = df[sorted(df.columns)].astype(object).map(cell)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, sf, duck, name):
    got, want = norm(catalogue.queries()[name](spark, sf).toPandas()), norm(duck.sql(catalogue.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want)


def test_every_sql_parses(duck):
    for name, sql in catalogue.oracle_sql().items():
        assert duck.sql(sql).columns, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())
