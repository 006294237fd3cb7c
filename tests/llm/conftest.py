import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    """The smallest documents table and rows that texts seldom are: null, empty, blank, repeated, long, odd, null ids."""
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = spark.createDataFrame(
        [(900001, None), (900002, ""), (900003, " \n\t "), (900004, "one"), (900005, "Ünïcödé 文字 🙂 it's 12 o'clock"), (900006, "same text here now and then"),
         (900007, "same text here now and then"), (900008, "a" * 3000), (900009, "word " * 4000), (900010, "1234 5678"), (None, "a text without an id"),
         (None, None), (900004, "one")], "doc_id bigint, text string")
    return (base.select("doc_id", "text").unionByName(odd)
            .withColumns({"fp": F.lit("clash"), "key": F.lit(1), "id": F.lit("x"), "uid": F.lit(0), "score": F.lit(None).cast("double"),
                          "lang": F.when(F.col("doc_id") % 2 == 0, "en"), "n_tokens": F.lit(7)}).repartition(3).cache())


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")


def bag(frame, *columns):
    """Rows as a sorted list of their text forms."""
    return sorted(map(repr, (tuple(r) for r in frame.select(*columns).collect())))
