"""Every registered query against DuckDB on the small tables."""

import duckdb
import pytest

from opinara.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that find nothing in tables this small.
MAY_BE_EMPTY: set[str] = {"append_new", "report_filters", "polarity_overlap", "recent_scored", "index_gaps", "template_pairs"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, SF)
    got = frame.collect()
    assert got or name in MAY_BE_EMPTY
    if name not in catalogue.ORACLES:
        assert name == "cluster_names"  # compared with brute force in test_products
        return
    result = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    key = lambda rows: sorted(repr(r) for r in rows)
    order = sorted(columns)
    assert key([tuple(r[c] for c in order) for r in got]) == key([tuple(dict(zip(columns, r))[c] for c in order) for r in result.fetchall()])


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
