import pytest

from risetide.llm.work import importable


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    importable(spark)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null texts and ids, empty and long texts, repeated rows, extra columns with clashing names."""
    long = "\n".join(f"Line number {i} of a very long text, with some words in it." for i in range(2000))
    texts = [None, "", " \n\t", "one", "Same words here today again.", "Same words here today again.", long, "é🎉 ß Σ",
             "token = \"0123456789abcdef01234567\" a@b.org", "x" * 30000]
    rows = [(i, t, i, None, "n", "f", 1, "t") for i, t in enumerate(texts)]
    rows += [(None, "Same words here today again.", 1, None, "n", "f", 1, "t"), rows[4]]
    schema = "doc_id long, text string, line int, h string, fp string, source string, n_lines int, ids string"
    return spark.createDataFrame(rows, schema)
