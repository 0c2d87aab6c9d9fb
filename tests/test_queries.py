"""Each query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from sparquill import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(frame):
    def plain(v):
        if isinstance(v, (list, np.ndarray)):
            return str([plain(x) for x in v])
        if v is None or str(v) in ("<NA>", "nan", "NaT"):
            return "null"
        if isinstance(v, (float, np.floating)):
            return f"{round(float(v), 5) + 0.0:.5f}"
        if isinstance(v, (int, np.integer)) and not isinstance(v, (bool, np.bool_)):
            return f"{float(v):.5f}"
        return str(v)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, sf_dir, oracle, name):
    got = rows(plans.queries()[name](spark, sf_dir).toPandas())
    assert got == rows(oracle.execute(plans.oracle_sql()[name]).df())


def test_every_query_has_sql_or_a_test():
    assert set(plans.queries()) - set(plans.oracle_sql()) <= {"snippets", "code_procedures", "code_calls", "code_statements", "message_codes", "message_parties", "forest_importance", "latent_neighbours", "matching_blocks", "graph_strong_components", "cross_validation", "fuzzy_keywords", "probed_neighbours"}
    assert not set(plans.oracle_sql()) - set(plans.queries())
