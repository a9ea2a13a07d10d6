import pytest

#: Names that operators use inside.
CLASHES = ("row", "key", "n", "word", "cls", "shingle", "bucket", "copies", "part", "place", "spans", "items", "threshold", "keep", "score", "grp", "label")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    long_text = " ".join(f"word{i} the of and" for i in range(6000))
    base = [(1, None), (2, ""), (3, " \t\n"), (4, long_text), (5, "a"), (5, "a"), (None, "some text without id"), (None, None), (7, "Ünïcode — “quotes” 中文字符 \u00a0 space \U0001f600"), (8, "tie text one two three four five six"), (9, "tie text one two three four five six"), (10, "!!! 123 ???")]
    return [(i, t, None if k % 5 == 0 else "en" if k % 2 else "fr", None if k % 3 == 0 else "src", None) for k, (i, t) in enumerate(base)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    df = spark.createDataFrame(rows(), SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, df["n_chars"].cast("string"))
    return df.persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").persist()
