import duckdb
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(texts, **more):
        """Rows from texts, or from (doc_id, text) pairs, with clashing extra columns."""
        rows = []
        for i, t in enumerate(texts):
            key, text = t if isinstance(t, tuple) else (i, t)
            rows.append((key, text, more.get("lang", "en"), more.get("source", "s"), len(text or "")))
        df = spark.createDataFrame(rows, DOCS)
        for name in ("h", "at", "seq", "size", "shard", "bands", "ids", "component_id", "taken"):
            df = df.selectExpr("*", f"'extra' AS {name}")
        return df

    return make


@pytest.fixture
def duck():
    def run(sql, **tables):
        con = duckdb.connect()
        for name, frame in tables.items():
            con.register(name, frame)
        return con.sql(sql).df()

    return run
