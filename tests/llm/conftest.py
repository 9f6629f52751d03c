import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, label int, id long, words string"


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators might use inside."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
    texts = [None, "", "   \n\t ", "one", "One two three four five six seven eight nine ten eleven", long, "É é ÀB naïve 日本語 \U0001f389 İ", "a" * 5_000, "x\x00y <|endoftext|> z", "b. b! b,b 'll it's"]
    rows = [(k, t, "en", "s" if k % 2 else None, None if t is None else len(t), "c", k % 2, k, "w") for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "one two three four five six seven eight nine ten eleven", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where(F.lit(False))
