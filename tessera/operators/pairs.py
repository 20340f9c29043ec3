"""Transliteration pair table: generation, validity filter, line pairing and
count checks. All narrow except the explicit count aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.draws import uniform
from tessera.functions.romanize import romanize
from tessera.functions.text import py_strip, split_lines


def make_pairs(lines: DataFrame, text: str = "text", lang: str | None = "lang", rules=None) -> DataFrame:
    """Add ``transliteration`` = stripped romanization of ``text`` (the
    original text is kept as is). One narrow stage, no shuffle."""
    lc = F.col(lang) if lang else None
    return lines.withColumn("transliteration", romanize(F.col(text), lc, rules))


def doc_pairs(docs: DataFrame, text: str, lang: str | None, keys: list[str], rules=None,
              unicode_breaks: bool = True) -> DataFrame:
    """Pairs from whole documents: romanize each document once (rules are
    character-local and never contain a line break), then split original
    and romanized text into lines together; romanized lines are stripped."""
    lc = F.col(lang) if lang else None
    r = romanize(F.col(text), lc, rules, strip=False)
    z = F.arrays_zip(split_lines(F.col(text), unicode_breaks).alias("t"),
                     split_lines(r, unicode_breaks).alias("r"))
    cols = list(dict.fromkeys(keys + ([lang] if lang else [])))
    e = docs.select(*cols, F.posexplode(z).alias("line_no", "z"))
    return e.select(*cols, F.col("line_no").cast("long").alias("line_no"), F.col("z.t").alias("text"),
                    py_strip(F.coalesce("z.r", F.lit(""))).alias("transliteration"))


def valid_pairs(df: DataFrame, a: str = "text", b: str = "transliteration") -> DataFrame:
    """Drop a pair when either side is null or empty; whitespace-only text
    survives (length, not strip, decides)."""
    return df.filter(F.col(a).isNotNull() & (F.length(a) > 0)
                     & F.col(b).isNotNull() & (F.length(b) > 0))


def pair_by_line(texts: DataFrame, translits: DataFrame, keys: list[str]) -> DataFrame:
    """Pair sentences with externally produced transliterations by line
    position: full outer join on ``keys`` (file and line number), so lines
    present on one side only stay visible (``status``)."""
    j = texts.select(*keys, F.col("text")).join(
        translits.select(*keys, F.col("transliteration")), on=keys, how="full_outer")
    status = (F.when(F.col("text").isNull(), "missing_text")
              .when(F.col("transliteration").isNull(), "missing_transliteration")
              .otherwise("paired"))
    return j.withColumn("status", status)


def pair_line_counts(paired: DataFrame, by: list[str]) -> DataFrame:
    """Per file the two line counts and whether they agree (the original
    asserts equality)."""
    g = paired.groupBy(*by).agg(F.count("text").alias("n_text"),
                                F.count("transliteration").alias("n_transliteration"),
                                F.count(F.when(F.col("status") == "paired", 1)).alias("n_paired"))
    return g.withColumn("counts_equal", F.col("n_text") == F.col("n_transliteration"))


def pair_counts(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Sentence / transliteration / valid-pair counts per group."""
    valid = (F.col("text").isNotNull() & (F.length("text") > 0)
             & F.col("transliteration").isNotNull() & (F.length("transliteration") > 0))
    return pairs.groupBy(*by).agg(
        F.count("text").alias("n_text"),
        F.count(F.when(F.length("transliteration") > 0, 1)).alias("n_transliteration"),
        F.count(F.when(valid, 1)).alias("n_valid"))


def assign_split(df: DataFrame, key_cols: list[str], seed: int = 0,
                 train: float = 0.8, dev: float = 0.1) -> DataFrame:
    """Deterministic train/dev/test split from an md5 draw of the key."""
    u = uniform(F.lit(seed), *[F.col(c) for c in key_cols])
    return df.withColumn("split", F.when(u < train, "train").when(u < train + dev, "dev").otherwise("test"))


def split_counts(df: DataFrame, by: list[str], cap: int | None = None) -> DataFrame:
    """Example counts per group; ``n_samples`` = min(cap, count) as the
    training-sample cap does."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_examples"))
    if cap is not None:
        g = g.withColumn("n_samples", F.least(F.lit(cap).cast("long"), F.col("n_examples")))
    return g
