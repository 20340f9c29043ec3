"""Pair table sources and sinks.

Between stages pairs travel as parquet; CSV only at the edges. The CSV
sink writes a header and doubles quotes (``escape='"'``), and the reader
uses the same setting, so quotes, commas, backslashes and newlines in text
survive a round trip, and literal ``NA``/``null``/``nan`` stay text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PAIR_SCHEMA = T.StructType([T.StructField("text", T.StringType(), True),
                            T.StructField("transliteration", T.StringType(), True)])


def _fmt(path: str) -> str:
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "parquet"
    return {"txt": "text", "csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet"}.get(ext, "parquet")


def read_pairs(spark: SparkSession, path: str, schema: T.StructType = PAIR_SCHEMA) -> DataFrame:
    """Format from the file extension (``txt`` → text); explicit schema."""
    fmt = _fmt(path)
    if fmt == "csv":
        return (spark.read.schema(schema).option("header", True).option("escape", '"')
                .option("multiLine", True).option("nullValue", None).csv(path))
    if fmt == "json":
        return spark.read.schema(schema).json(path)
    if fmt == "text":
        return spark.read.text(path).withColumnRenamed("value", "text")
    return spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)


def write_pairs(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    fmt = _fmt(path)
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').option("quoteAll", False).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path
