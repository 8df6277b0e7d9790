import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sawlog.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = ["p4_parse_auto", "p11_parse_ts", "w5_health_transitions", "j3_diff_snapshots", "k4_bulk_bodies", "o13_full_duration"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr)


def test_every_query_has_sql():
    entry.queries()
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
