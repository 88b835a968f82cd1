import pytest
from pyspark.sql import Row  # noqa: F401

TOKENIZERS = "/opt/tokenizers"


@pytest.fixture(scope="session")
def texts(spark):
    """Makes a documents table, with columns whose names operators use inside."""

    def make(rows, extra=False):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        if extra:
            for name in ("id", "fp", "key", "cell", "u", "v", "score", "spans", "hits", "y", "k", "keep_0", "rep"):
                docs = docs.selectExpr("*", f"'x' as {name}")
        return docs

    return make


@pytest.fixture(scope="session")
def oracle(small):
    """Rows of a SQL twin over the small tables."""
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "embeddings", "labels"):
        con.sql(f"create view {name} as select * from read_parquet('{small}/{name}.parquet')")
    return lambda sql: con.sql(sql).df()
