import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


#: Nulls, empty and long texts, ties, repeated rows.
AWKWARD = [
    (1, None, "a"), (2, "", None), (3, "", "a"), (4, "one two  three\n\nfour", "b"), (5, "one two  three\n\nfour", "b"),
    (5, "one two  three\n\nfour", "b"), (6, "\t \n", ""), (7, "é ü ﬁ 🙂 x\r\ny", "b"), (8, "word " * 30_000, "b"), (None, "no id here", "a"),
    (9, "x" * 5_000, "c"), (10, "one two  three\n\nfive", "b"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with awkward rows, and extra columns with clashing names."""
    names = ["size", "k", "id", "h", "bucket", "group", "shard", "window", "text_crc32", "length", "__n", "rank", "n_lines", "deleted", "score", "n", "form", "found", "output"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in AWKWARD], schema)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
