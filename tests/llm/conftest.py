import pytest


@pytest.fixture
def rows(spark):
    """Documents with nulls, empty and long texts, repeated rows and a column whose name clashes with working names."""

    def make(texts, **more):
        n = len(texts)
        ids = more.get("ids", list(range(n)))
        langs, sources = more.get("langs", ["en"] * n), more.get("sources", ["a"] * n)
        return spark.createDataFrame([(i, t, la, s, len(t) if t is not None else None, 1) for i, t, la, s in zip(ids, texts, langs, sources, strict=True)], "doc_id long, text string, lang string, source string, n_chars long, key string")

    return make


AWKWARD = [None, "", " \n\t ", "one", "x" * 50_000, "word " * 3000, "same text here", "same text here"]
