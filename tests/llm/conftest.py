import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, fp int, doc string, `odd name` struct<a:int>, _hot string, _t1 long, _T2 int, _lost long, _HASH string, _n int, item long, h long, component_id string, k1 long"
LONG = "the quick brown fox jumps over the lazy dog " * 3000


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, "Alpha beta gamma.\n  Shared LINE \nEnd", "en"), (2, "Alpha beta gamma.\n  Shared LINE \nEnd", "en"), (2, "Alpha beta gamma.\n  Shared LINE \nEnd", "en"), (3, None, "en"), (4, "", None), (None, "shared line\nwithout id", "de"),
        (6, LONG, "en"), (7, " \n\t\n", "fr"), (8, "café 日本語 \U0001f642 ½<|endoftext|>x", None), (9, "\x1c a\x1c b  c\r\nshared line\n", "es"), (10, "a", "en"), (None, None, None),
    ]
    return spark.createDataFrame([(i, t, lang, "s", None, "clash", 1, "d", (1,), "x", 1, 2, 3, "y", 4, 5, 6, "z", 7) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
