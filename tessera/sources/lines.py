"""Ordered line scans with distributed line numbers.

``spark.read.text`` splits files into blocks read by independent tasks, so
"line i of the file" is not known to any single task. The files are scanned
once:

1. every physical line gets ``(file, block start)`` and its position in the
   block, and the rows are written as a staged table. For ``unicode_breaks``
   (the ``str.splitlines`` behaviour of the corpus reader) a physical line may
   hold several logical lines; the position is then a running count over the
   rows of the task, which reads a block in order;
2. the number of logical lines per block is an aggregate over two narrow
   columns of the staged table: one row per block, which a running sum per file
   turns into offsets;
3. the offsets are joined back and give the line number.

No window spans a file, and nothing depends on the number of blocks.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import py_strip
from tessera.session import stage_table

# The breaks str.splitlines() honours beyond those of the text reader.
EXTRA_BREAKS_RE = r"[\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
SPLIT_CONF = "spark.sql.files.maxPartitionBytes"


PART_CONF = "spark.sql.files.maxPartitionNum"
TASKS_A_SLOT = 16


def _bytes_below(spark: SparkSession, path: str) -> int:
    """Bytes of the files at ``path`` (a glob too), on any file system Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(fs.getContentSummary(found.getPath()).getLength() for found in fs.globStatus(p) or [])


@contextmanager
def split_bytes(spark: SparkSession, size: int | None, path: str | None = None):
    """Largest block of the scans that run inside, in bytes (None: as set). A
    small block is not a task of its own: a task takes many blocks of ``path``,
    up to the bytes a partition has otherwise, or a share of the slots."""
    before, parts = spark.conf.get(SPLIT_CONF), spark.conf.get(PART_CONF, None)
    if size is not None:
        if path is not None and parts is None:
            usual = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before))
            most = max(TASKS_A_SLOT * spark.sparkContext.defaultParallelism, -(-_bytes_below(spark, path) // usual))
            spark.conf.set(PART_CONF, str(most))
        spark.conf.set(SPLIT_CONF, str(size))
    try:
        yield
    finally:
        spark.conf.set(SPLIT_CONF, before)
        if parts is None:
            spark.conf.unset(PART_CONF)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("wholetext", "false").text(path)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("mid"),
                    F.col("value").alias("text")))


def _counted(batches):
    """Adds to every row the number of logical lines before it in its block;
    a block's rows follow one another."""
    last, carried = None, 0
    for batch in batches:
        if not len(batch):
            continue
        n = batch["n"].to_numpy().astype(np.int64)
        block, file = batch["block"].to_numpy(), batch["file"].dictionary_encode().indices.to_numpy()
        first = np.concatenate([[True], (block[1:] != block[:-1]) | (file[1:] != file[:-1])])
        before = np.cumsum(n) - n
        run = np.cumsum(first) - 1
        before = before - before[first][run]
        if (batch["file"][0].as_py(), int(block[0])) == last:
            before[run == 0] += carried
        last, carried = (batch["file"][len(n) - 1].as_py(), int(block[-1])), int(before[-1] + n[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], [*batch.schema.names, "before"])


def read_lines(spark: SparkSession, path: str, unicode_breaks: bool = False, with_block: bool = False,
               block_bytes: int | None = None) -> DataFrame:
    """``(file, line_no, text)`` with 0-based line numbers in file order;
    ``with_block`` adds ``block``, the start of the scan block in the file,
    which bounds windows over neighbouring lines."""
    scan = _scan(spark, path)
    if unicode_breaks:
        parts = F.split("text", EXTRA_BREAKS_RE, -1)
        scan = scan.select("file", "block", parts.alias("parts"), F.size(parts).cast("long").alias("n"))
        scan = scan.mapInArrow(_counted, T.StructType(scan.schema.fields + [T.StructField("before", T.LongType())]))
    with split_bytes(spark, block_bytes, path):
        rows = stage_table(scan, "lines")
    if unicode_breaks:
        sizes = rows.groupBy("file", "block").agg(F.sum("n").alias("n"))
        rows = rows.select("file", "block", "before", F.posexplode("parts").alias("sub", "text"))
        at = F.col("before") + F.col("sub")
    else:
        sizes = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
        at = F.col("mid") - F.col("first")
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    return rows.join(offsets, ["file", "block"]).select(
        "file", *(["block"] if with_block else []), (F.col("offset") + at).cast("long").alias("line_no"), "text")


def write_line_files(df: DataFrame, path: str, file_col: str, order: list[str], text: str = "text") -> None:
    """One text file per ``file_col`` value (folder ``file_col=value``), a line
    per row in the given order; a null is an empty line."""
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(slots, file_col).sortWithinPartitions(file_col, *order)
    rows.select(F.col(file_col), F.coalesce(F.col(text), F.lit("")).alias("value")).write.partitionBy(file_col).text(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(file, file_name, length)`` of all files below ``path`` whose name
    matches the glob ``pattern``, on any file system Spark reads: a metadata scan
    that opens no file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("file"), F.regexp_extract("path", "([^/]*)$", 1).alias("file_name"), "length")


def discover_langs(files: DataFrame) -> DataFrame:
    """Distinct language codes of listed files: the part of a name before its
    first ``_``."""
    return files.select(F.substring_index("file_name", "_", 1).alias("lang")).distinct()


def file_value(file_col: str):
    """The value of ``file_col`` that :func:`write_line_files` put in the path."""
    return F.regexp_extract("file", f"/{file_col}=([^/]+)/", 1)


def read_parallel(spark: SparkSession, path: str, block_bytes: int | None = None) -> DataFrame:
    """Parallel sentence file: stripped lines, row number = gold key."""
    return read_lines(spark, path, block_bytes=block_bytes).select("file", F.col("line_no").alias("idx"),
                                                                   py_strip("text").alias("text"))


def lines_of(df: DataFrame, text_col: str, keys: list[str], unicode_breaks: bool = True) -> DataFrame:
    """Lines of a text column of a table (a document per row) as
    ``keys + (line_no, text)``; numbering restarts per row."""
    from tessera.functions.text import split_lines
    return df.select(*keys, F.posexplode(split_lines(text_col, unicode_breaks)).alias("line_no", "text")) \
             .withColumn("line_no", F.col("line_no").cast("long"))

