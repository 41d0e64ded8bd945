import pytest


def docs_frame(spark, texts, first=0):
    """documents rows of the given texts, with a column whose name clashes with the operators' own."""
    rows = [(first + k, t, "en", "src0", len(t or ""), -1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint")


AWKWARD = [None, "", " \n\t\n ", "a", "same line of words here, twice over\nsame line of words here, twice over", "x" * 5000, "é ß 漢字 😀 ﬁ ", "same", "same", "word " * 3000, "a\x0bb\x1cc\x85d\xa0e"]


@pytest.fixture
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, a null id, clashing columns."""
    frame = docs_frame(spark, AWKWARD)
    more = spark.createDataFrame([(None, "no id here", None, None, None, None), (7, "same", None, None, 4, 0), (7, "other text", None, None, 4, 0)], frame.schema)
    return frame.unionByName(more)


@pytest.fixture
def nothing(spark):
    return docs_frame(spark, ["x"]).where("false")
