"""Deleting invisible characters and dropping blank texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions.text import not_blank, stripped


def strip_invisible(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, stripped(F.col(text)))


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Keep the texts that are not empty after a JavaScript trim; null counts as blank."""
    return df.filter(not_blank(F.col(text)))


def invisible_profile(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Invisible characters per ``by`` group: how many, and in how many of the texts."""
    removed = df.select(
        *by, (F.length(text) - F.length(stripped(F.col(text)))).alias("removed")
    )
    return removed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(F.col("removed") > 0).alias("texts_with_invisible"),
        F.coalesce(F.sum("removed"), F.lit(0)).alias("removed_chars"),
    )
