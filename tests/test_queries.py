"""Every core query with an oracle gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from chronoframe.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(x):
    if isinstance(x, float):
        return f"{x:.6f}"
    return bytes(x).hex() if isinstance(x, (bytes, bytearray)) else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = cursor.fetchall()
    assert sorted(tuple(_plain(r[c]) for c in order) for r in got) == sorted(tuple(_plain(r[names.index(c)]) for c in order) for r in want)


@pytest.mark.parametrize("name", ["d2_version_digest", "d3_image_digest", "d3_record_digest", "d4_historical_digest"])
def test_digest_of_small_leaves_equals_oracle(spark, name, monkeypatch):
    from chronoframe.operators import audit as A

    folder = "/root/testdata/sf0.01"
    monkeypatch.setattr(A, "LEAF", 1)
    got = [tuple(r) for r in registry.queries()[name](spark, folder).collect()]
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert sorted(got) == sorted(c.execute(registry.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_oracle_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
