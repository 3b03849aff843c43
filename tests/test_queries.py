"""A sample of the registered queries against their SQL on the driver's tables.

The driver compares all of them; ``ALL_QUERIES=1`` does so here as well.
"""

import glob
import os

import pytest

import __spark_entry__ as entries

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
SAMPLE = [
    "dedup_mean", "mask_multi", "impulse_filter", "interp_stats", "deriv2", "spectrum_band",
    "sweep_upper_inverted", "arity_check", "settings_resolve", "tag_summary", "catalog",
    "violations_spectrum",
]
NAMES = list(entries.queries()) if os.environ.get("ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got = entries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(columns).collect()]
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {quoted} FROM ({entries.oracle_sql()[name]})").fetchall()
    assert len(rows) == len(want) > 0
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry_and_registry(spark):
    assert entries.entry(spark).columns == ["series", "sweep_index", "k", "frequency", "amplitude"]
    assert set(entries.oracle_sql()) <= set(entries.queries())
