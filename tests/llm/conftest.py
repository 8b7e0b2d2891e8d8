import pytest

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): NULLs, empty and blank texts, a very long one, repeated rows."""
    return [(1, "The quick brown Fox jumps over the lazy dog. It's 12 o'clock!"), (2, None), (3, ""),
            (4, " \n\t "), (5, LONG), (6, "café ÜBER straße 中文 😀"), (7, "café ÜBER straße 中文 😀"),
            (7, "café ÜBER straße 中文 😀"), (None, "no id here"), (None, None), (8, "..."), (9, "x")]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The same rows with extra columns, some named like results."""
    return spark.createDataFrame(
        [(i, t, "en", f"src{n % 2}", "keep") for n, (i, t) in enumerate(edge_rows)],
        "doc_id bigint, text string, lang string, source string, shard string").coalesce(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
