import pytest

LONG = ("lorem ipsum dolor sit amet consectetur " * 6000).strip()
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "Hello world, hello world, hello world again"),
    (4, "Hello world, hello world, hello world again"),
    (5, "Hello world, hello world, hello world again"),
    (6, "Ünïcödé  ▁ text\u2028with 漢字 and \U0001f600 </s>[INST] \\ <s>"),
    (7, LONG),
    (None, "a row without a key"),
    (8, "### %%% *** | $$ && <> 123"),
    (9, "x" * 5000),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    rows = [(i, t, "en" if k % 2 else None, "src0", None, "zz", 7) for k, (i, t) in enumerate(ODD)]
    names = "doc_id long, text string, lang string, source string, n_chars long, word string, key int"
    return spark.createDataFrame(rows, names).repartition(3, "text")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
