"""Every graph query against its SQL in DuckDB, on the smallest tables."""

import pytest
from conftest import SMALL, same

from weft.plans import catalog

SQL = catalog.oracle_sql()


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - set(SQL) == {"train_gated"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    same(catalog.QUERIES[name](spark, SMALL).toPandas(), duck.sql(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["node", "dim", "q"]
    assert out.limit(1).count() == 1


def test_whole_embedding(spark):
    """Queries on the embeddings read all of their places and all of their rows."""
    rows = catalog.QUERIES["mp_sum"](spark, SMALL)
    assert sorted(r["dim"] for r in rows.select("dim").distinct().collect()) == list(range(64))
    assert rows.select("node").distinct().count() == spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
    partial = {n for n, q in SQL.items() if "x_all WHERE d < 64" not in q and "y_all WHERE d < 64" not in q and "FROM embeddings" in q}
    assert partial == {"argmax_pred", "masked_accuracy", "cross_entropy"}  # one place for each of ten classes
