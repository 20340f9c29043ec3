"""Partitioned stores: token cache, feature cache, per-layer embeddings,
prediction lists.

All are parquet folders. A store that is complete is reused (its input is not
computed again) unless ``overwrite`` is set; completeness is the ``_SUCCESS``
marker of the write, for layers every layer's folder, and for features a
manifest of the partitions that were finished.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import stage_table


def store_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished write lies at ``path``, on any file system Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))


def cached_tokens(spark: SparkSession, path: str, build: Callable[[], DataFrame], *,
                  overwrite: bool = False) -> DataFrame:
    """The token table at ``path``; ``build`` is called and its rows written
    only where no finished table lies there (or ``overwrite`` is set)."""
    if overwrite or not store_exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


FEATURE_KEYS = ["mode", "lang", "model", "max_len"]
FEATURE_KEYS_SQL = "mode string, lang string, model string, max_len int"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    if not store_exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], FEATURE_KEYS_SQL)
    return spark.read.schema(FEATURE_KEYS_SQL).json(f"{path}/manifest").distinct()


def cached_features(spark: SparkSession, path: str, wanted: DataFrame, build: Callable[[DataFrame], DataFrame], *,
                    overwrite: bool = False) -> DataFrame:
    """The features of the ``wanted`` partitions ``(mode, lang, model,
    max_len)``.

    Partitions that the manifest does not list are built: ``build`` gets their
    keys and gives rows with these columns, which are written to the
    partitions' folders (whole folders are replaced, so a write that died is
    simply done again) and then entered in the manifest, those without a row
    too. ``overwrite`` builds all that is wanted. A null language is a partition
    like any other."""
    wanted = wanted.select(*(F.col(c).cast(t) for c, t in (x.split() for x in FEATURE_KEYS_SQL.split(", ")))).distinct()
    known = _manifest(spark, path).select(*(F.col(c).alias(f"known_{c}") for c in FEATURE_KEYS))
    same = [F.col(c).eqNullSafe(F.col(f"known_{c}")) for c in FEATURE_KEYS]
    missing = wanted if overwrite else wanted.join(known, same, "left_anti")
    missing = stage_table(missing, "feature-keys")
    if not missing.isEmpty():
        rows = build(missing)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FEATURE_KEYS).parquet(f"{path}/data")
        missing.write.mode("append").json(f"{path}/manifest")
    data = spark.read.option("mergeSchema", "false").parquet(f"{path}/data")
    keys = wanted.select(*(F.col(c).alias(f"known_{c}") for c in FEATURE_KEYS))
    return data.join(keys, [F.col(c).cast("string").eqNullSafe(F.col(f"known_{c}").cast("string")) for c in FEATURE_KEYS], "left_semi")


def write_layers(df: DataFrame, path: str, layer_col: str = "layer") -> None:
    """Write vectors with one folder per layer."""
    df.write.mode("overwrite").partitionBy(layer_col).parquet(path)


def layers_complete(spark: SparkSession, path: str, layers: int, layer_col: str = "layer") -> bool:
    """True only if all of the layers 0 .. ``layers`` - 1 are stored."""
    if not store_exists(spark, path):
        return False
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return all(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, f"{layer_col}={i}")) for i in range(layers))


def read_layer(spark: SparkSession, path: str, total_layers: int, num_layers: int, index: int,
               layer_col: str = "layer") -> DataFrame:
    """The layer at ``index`` of the last ``num_layers`` of ``total_layers``:
    a partition filter, so only that layer's folder is read."""
    absolute = total_layers - num_layers + index
    return spark.read.parquet(path).filter(F.col(layer_col) == F.lit(absolute))


def write_predictions(df: DataFrame, path: str, lang_col: str = "lang") -> None:
    """Write predictions with one folder per language. A language is spread
    over as many files as its tasks wrote; none is gathered in one task."""
    df.write.mode("overwrite").partitionBy(lang_col).parquet(path)
