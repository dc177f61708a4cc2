"""Counting what was found, per text and per corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions.patterns import TYPES, VALIDATED
from veilspan.operators.detect import (
    checked_values,
    prepared,
    scan_columns,
    text_counts,
    with_matches,
)
from veilspan.operators.tables import computed


def pii_summary(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    types: Sequence[str] = TYPES,
    strip: bool = True,
) -> DataFrame:
    """``keys, type, count`` per text. Each row is one text, so nothing is shuffled."""
    return prepared(df, text, strip).select(*keys, F.inline(text_counts(text, tuple(types))))


def summarize_spans(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same summary from a span table that exists already."""
    return spans.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("count"))


def pii_report(
    df: DataFrame,
    by: Sequence[str],
    text: str = "text",
    types: Sequence[str] = TYPES,
    strip: bool = True,
) -> DataFrame:
    """Matches, distinct values and texts per ``by`` group and type.

    Counted per value first, which shrinks a hot group inside each task before the shuffle
    and spreads it over its values; the second step only adds up.
    """
    hit = "array<struct<type:string,value:string,first:boolean>>"
    nothing = F.array().cast(hit)

    def entry(kind: str, value, first):
        return F.struct(F.lit(kind).alias("type"), value.alias("value"), first.alias("first"))

    def of(kind: str, name: str):
        found = F.col(name)
        kept = checked_values(found, kind)
        several = F.transform(kept, lambda v, i: entry(kind, v, i == 0)).cast(hit)
        if kind in VALIDATED:
            return F.when(F.size(found) > 0, several).otherwise(nothing)
        one = F.array(entry(kind, F.get(found, F.lit(0)), F.lit(True))).cast(hit)
        return (
            F.when(F.size(found) == 1, one).when(F.size(found) > 1, several).otherwise(nothing)
        )

    # As in with_spans: the scans are compiled, and a lambda is left out where one value was found.
    found = with_matches(prepared(df, text, strip), text, types)
    parts = [of(kind, name) for kind, name in scan_columns(types).items()]
    every = F.concat(*parts) if parts else nothing
    hits = computed(found, _hits=every).select(*by, F.inline("_hits"))
    values = hits.groupBy(*by, "type", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("first").alias("texts")
    )
    return values.groupBy(*by, "type").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.sum("texts").alias("texts"),
    )


def summary_with_source(
    summary: DataFrame, entities: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Flag the summary rows whose type the named-entity detector found in that text."""
    found = entities.select(*keys, "type").distinct().withColumn("from_ai", F.lit(True))
    return summary.join(found, [*keys, "type"], "left").withColumn(
        "from_ai", F.coalesce("from_ai", F.lit(False))
    )
