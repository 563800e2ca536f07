import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, kept boolean, lost_id long, component string, body string"


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls, empty and long texts, ties and repeated rows, as (doc_id, text, source)."""
    long = " ".join(f"w{i % 997} x{i}" for i in range(4000))
    return [
        (1, None, None), (2, "", "a"), (3, " \t\n", "b"), (4, "same words here and there again", "a"), (5, "same words here and there again", None), (6, "same  words here and there again", "b"),
        (6, "same  words here and there again", "b"), (7, long, "a"), (8, long + " end", "a"), (9, "short", "c"), (9, "other short", "c"), (None, "no id at all in this row", "a"),
        (10, "ünï cödé ▁ 😀 </s> [INST] tab\there\r\nline\n\nline", "b"), (11, "same words", "c"),
    ]


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    """The hard rows with extra columns whose names operators might use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "d", True, 2, "c", "b") for i, t, s in hard_rows], COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
