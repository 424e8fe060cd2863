import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty, blank and very long texts, repeated rows and clashing extra columns."""
    long = " ".join(f"w{i % 977} thing{i}" for i in range(40_000))
    rows = [
        (1, "Same text here for all of us", "en", "a", 28), (2, "Same text here for all of us", "en", "a", 28), (2, "Same text here for all of us", "en", "a", 28),
        (3, None, "en", "b", None), (4, "", None, None, 0), (5, " \n\t ", "en", "b", 4), (None, "no id at all", "en", "c", 12),
        (None, None, None, None, None), (6, long, "en", "a", len(long)), (7, "日本語のテキスト😀 mit ß", "ja", None, 15), (8, "MIT License", "en", "z", 11),
    ]
    names = ("score", "fp", "rank", "h", "s", "row", "size", "target", "copies", "next", "own", "run", "text2")
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", *[f"concat('x', doc_id) as {n}" for n in names])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
