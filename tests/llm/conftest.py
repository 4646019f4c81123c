import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of (id, text) pairs, with a column whose name clashes with those inside operators."""

    def make(rows):
        full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).selectExpr("*", "1 AS h", "2 AS score", "3 AS n", "4 AS row")

    return make


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


EDGES = [(0, None), (1, ""), (2, "one"), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "word " * 20_000), (None, "no id here at all"), (5, "...!?"), (6, "été 漢字 \U0001f600")]
