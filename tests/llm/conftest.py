import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from {id: text} or [(id, text)]."""

    def make(texts, lang=None, extra=False):
        rows = list(texts.items()) if isinstance(texts, dict) else list(texts)
        df = spark.createDataFrame([(i, t, (lang or {}).get(i), "src", None if t is None else len(t)) for i, t in rows], SCHEMA)
        if extra:  # clashing names of what operators add
            for c in ("score", "h", "n", "place_id", "starts", "masks", "part", "component_id", "n_removed"):
                df = df.selectExpr("*", f"1 AS {c}")
        return df

    return make


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
