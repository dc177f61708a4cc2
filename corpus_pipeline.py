"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage but the last takes and returns the columns of documents. ``n_chars`` follows the text
where a stage changes it. Stages with Python workers give them their rows in small batches, because
the workers of all stages are the same ones and keep the memory of the largest batch.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import jaccard, lines, packing, pii, toxicity
from veilspan.llm.common import cut_lineage, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold, unchanged."""
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("toxic_flag = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines. A document of which nothing but blank
    lines is left was a copy as a whole and goes; one that had no text before stays."""
    cut = lines.line_dedup(docs).filter("lines_removed = 0 OR lines_left > 0")
    return _with_length(cut, docs.columns, F.col("lines_removed") > 0, F.col("text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id; rows without an id
    stay."""
    small_batches(spark)
    found = jaccard.near_duplicates(docs, width=5, percent=80)
    copies = found.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the kind in place of each span of personal data."""
    small_batches(spark)
    found = pii.detect(docs)
    masked = F.col("pii.masked_text")
    return _with_length(found, docs.columns, ~masked.eqNullSafe(F.col("text")), masked)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their place in the packed sequences."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: A trained model takes part, which SQL cannot express.
ORACLE_SQL = None


def _with_length(df: DataFrame, columns: list[str], changed, text) -> DataFrame:
    new = {"text": text}
    if "n_chars" in columns:
        kind = df.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length(text).cast(kind)).otherwise(F.col("n_chars"))
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
