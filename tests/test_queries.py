import duckdb
import pytest

import __spark_entry__ as contract
from checks.compare import TABLES, normal
from checks.oracle import oracle_sql
from checks.queries import QUERIES

QUICK = [
    "load_spec",
    "bm25_topk",
    "map_at_k",
    "split_by_query",
    "pool_vectors",
    "early_stop",
    "no_duplicate_batches_rules",
    "no_duplicate_batches_rows",
    "prepare_training_rows",
]


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_every_query_of_the_library_has_sql():
    """The corpus operators are an optional part, tested on their own."""
    assert set(QUERIES) == set(oracle_sql())


def test_entry_has_rows(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 2 and all(r["truncate_dim"] == -1 for r in rows)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ours = normal(contract.queries()[name](spark, sf_dir).toPandas())
    theirs = normal(con.sql(contract.oracle_sql()[name]).df())
    assert ours.equals(theirs)
