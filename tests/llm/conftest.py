import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def read(path):
    import pyarrow.dataset as ds
    return ds.dataset(path).to_table().to_pylist()


@pytest.fixture(scope="session")
def small():
    """Rows of the smallest documents table."""
    return read("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank, very long, repeated and tied rows."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    texts = [None, "", " \t\n ", "one", "One", "two words", long, long + " end", "?!. 12", "\x0bA\x0cb c", "É é Straße", "a b c d", "A B C D"]
    rows = [(i, t, "en" if i % 3 else None, "s" + str(i % 4) if i % 5 else None, None) for i, t in enumerate(texts)]
    rows += [(None, "one", None, None, 3), (None, None, None, None, None), (7, "repeated row", "de", "s1", 12), (7, "repeated row", "de", "s1", 12)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns with the names that operators use."""
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("x") for c in ("score", "lang_pred", "value", "sha", "key", "size", "n", "shard", "tokens", "kept", "u", "h")})
