import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", str(base / "local"))
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{base}/shared")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


PASSAGE = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeats and clashing extra columns."""
    long_text = " ".join(f"t{i % 5000}x{i}" for i in range(30000))
    rows = [
        (1, PASSAGE, "en", "a", 7),
        (2, PASSAGE, "en", "a", 7),
        (2, PASSAGE, "en", "a", 7),
        (3, None, None, None, None),
        (None, "Ein Text ohne Nummer " + PASSAGE, "de", None, 1),
        (None, None, "en", "b", 1),
        (4, "", "fr", "b", 1),
        (5, " \n\t ", "fr", "b", 1),
        (6, long_text, "en", "b", 1),
        (7, "one two", None, "c", 1),
        (8, "a b\na b\nc d\n" * 20, "es", "c", 1),
        (9, "ÉÀ ß 中文 😀 " * 30, "fr", "c", 1),
        (9, "another text with the same id " * 4, "xx", "c", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long").withColumnsRenamed({}).selectExpr("*", "n AS c1", "n AS fp", "text AS w", "n AS start", "n AS kept", "n AS h", "n AS key")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
