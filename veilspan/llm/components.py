"""Connected components of a table of links, by hooking labels to smaller ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import cut_lineage, discard


def components(links: DataFrame) -> DataFrame:
    """id, label of every id in ``links`` (a, b): the smallest id that links lead to.

    Each round hooks every label onto the smallest label next to it; both tables are written, so
    that the join on a label which many ids have can be split. Labels that meet no other stay.
    """
    labels = cut_lineage(
        links.select(F.col("a").alias("id"))
        .union(links.select("b"))
        .distinct()
        .select("id", F.col("id").alias("label"))
    )
    while True:
        of_a = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
        of_b = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        hooks = cut_lineage(
            links.join(of_a, "a")
            .join(of_b, "b")
            .filter("la <> lb")
            .groupBy(F.greatest("la", "lb").alias("label"))
            .agg(F.min(F.least("la", "lb")).alias("to"))
        )
        if hooks.isEmpty():
            discard(hooks)
            return labels
        moved = cut_lineage(
            labels.join(hooks, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        )
        discard(labels, hooks)
        labels = moved
