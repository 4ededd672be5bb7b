from __future__ import annotations

import pytest
from pyspark.sql import functions as F

#: Columns of documents; extra ones bear names that the operators use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, at int, id string, block long, key long, "
    "_text string, _spans string, _id long, _print long, target double, taken long, copies long, _row long"
)
LONG = "Über allen Gipfeln ist Ruh, in allen Wipfeln spürest du kaum einen Hauch. " * 4000


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Null, empty and long texts, copies, a repeated row, null id, source and language, odd characters."""
    said = [
        (1, "the cat sat on the mat and the dog sat on the log by the door", "en", "b", 5),
        (2, "the cat sat on the mat and the dog sat on the log by the door", "en", "b", 5),
        (3, "der Hund liegt auf der Matte und die Katze liegt daneben im Korb", "de", "a", 5),
        (3, "der Hund liegt auf der Matte und die Katze liegt daneben im Korb", "de", "a", 5),
        (4, "", "en", "a", 0), (5, None, None, None, None), (6, "   \n\t ", "de", "c", 6), (7, LONG, "de", "c", len(LONG)),
        (8, "12 34 !? ½ ▁ 中文字 🙂   a\x00b İÉé", None, "😀", 9), (None, "the cat and the dog", "en", "b", 2),
        (9, "a", "en", "", 1), (10, "<s>  </s> ▁▁x  y▁ z ", None, None, 3), (11, LONG + "Ende", "de", "a", 7),
    ]
    rows = [(*r, 1, 2, "x", 3, 4, "y", "z", 5, 6, 0.5, 7, 8, 9) for r in said]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)


@pytest.fixture(scope="session")
def mixed(spark, documents, odd_rows):
    """The small table with odd rows under ids of their own."""
    odd = odd_rows.withColumn("doc_id", F.col("doc_id") + 1000)
    return documents.unionByName(odd.select(documents.columns))
