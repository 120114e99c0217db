"""Every query with SQL against DuckDB on the small tables; the others for their rows."""

import math
import os

import duckdb
import pytest

from corpuswright.plans import oracles, registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(oracles.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(map(tuple, got.toPandas().astype(object).where(lambda d: d.notna(), None).itertuples(index=False)), got.columns) == plain(
        (tuple(None if v is None else v for v in r) for r in want.fetchall()), want.columns
    )


def test_every_query_without_sql_is_known():
    assert set(registry.queries()) - set(oracles.oracle_sql()) == {"svc_train", "svc_search", "svr_train", "model_print", "html_tag_features", "html_word_features"}


@pytest.mark.parametrize("name", ["svc_train", "svc_search", "svr_train", "model_print", "html_tag_features", "html_word_features"])
def test_has_rows(spark, name):
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
