"""Per-language result reports from a long metric table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = "====================="


def metric_report(metrics: DataFrame, lang: str = "lang", metric: str = "metric",
                  value: str = "value") -> DataFrame:
    """One text block per language: separator, ``language=<lang>``, then the
    ``metric = value`` lines in alphabetical metric order."""
    line = F.struct(F.col(metric).alias("k"),
                    F.concat(F.col(metric), F.lit(" = "), F.col(value).cast("string")).alias("l"))
    g = metrics.groupBy(lang).agg(F.array_sort(F.collect_list(line)).alias("__ls"))
    body = F.array_join(F.transform("__ls", lambda x: x["l"]), "\n")
    return g.select(lang, F.concat(F.lit(SEPARATOR + "\nlanguage="), F.col(lang), F.lit("\n"), body)
                    .alias("report"))


def write_report(reports: DataFrame, path: str) -> None:
    """Text sink: one report block per line group (parquet is the default
    table sink; this is the human-readable edge)."""
    reports.select("report").coalesce(1).write.mode("overwrite").text(path)
