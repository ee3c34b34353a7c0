import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table like documents from (id, text) pairs, with columns whose names the operators use themselves."""

    def make(pairs, lang="en", source="src0"):
        rows = [(k, t, lang, source, None if t is None else len(t)) for k, t in pairs]
        df = spark.createDataFrame(rows, SCHEMA)
        from pyspark.sql import functions as F

        return df.selectExpr("*", "doc_id as h", "'x' as k", "'y' as bands", "1 as __hash", "2 as __key", "'z' as row", "3 as v").withColumn("n", F.lit(4))

    return make


EXTRA = ["h", "k", "bands", "__hash", "__key", "row", "v", "n"]


def keep_extra(out, source):
    """Other columns are passed on with their values."""
    assert all(c in out.columns for c in EXTRA)
    if out.count():
        r = out.first()
        assert (r["k"], r["bands"], r["__hash"], r["__key"], r["row"], r["v"], r["n"]) == ("x", "y", 1, 2, "z", 3, 4)
