"""Every registered query of the core on the smallest tables, against its SQL."""

from __future__ import annotations

import duckdb
import pytest

import compare
from helixframe import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in compare.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    got = compare.rows(df.columns, df.collect())
    if name in SQL:
        r = con.execute(SQL[name])
        cols = [d[0] for d in r.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == compare.rows(cols, r.fetchall())


def test_no_query_without_reason_lacks_sql():
    # alignment kernels, consensus building and training have no SQL; their own tests are elsewhere
    kernels = {"mask_library_chained", "mask_library_single_hit", "mask_library_fragments", "mask_library_regions", "candidate_substitutions", "consensus_build", "consensus_spaced", "consensus_two_pass"}
    assert set(QUERIES) - set(SQL) == kernels | {"train_group_logistic", "train_logistic", "train_rare_family", "train_gbt"}
