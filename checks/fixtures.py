"""Texts that exercise every detector, derived from the whole star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.sources.texts import read_texts

TASKS_PER_CORE = 8

ZWSP = "​"

# Runs unchanged in Spark SQL and in the checking engine.
PROMPTS = f"""
SELECT o_orderkey AS prompt_id, CAST(o_orderdate AS DATE) AS d,
 concat('Order for ', c_name, ' of ', n_name, ', mail ',
  CASE WHEN o_orderkey % 7 = 0 THEN lpad(CAST(c_custkey AS STRING), 10, '5')
       ELSE concat('u', CAST(c_custkey AS STRING)) END,
  CASE WHEN o_orderkey % 3 = 0 THEN '{ZWSP}' ELSE '' END,
  '@mail', CAST(c_custkey % 9 AS STRING), '.example.com, call (',
  lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), ') 555-', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'),
  ', ssn ', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0'),
  '-', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'),
  CASE WHEN o_orderkey % 11 = 0 THEN '-123-4567' ELSE '' END,
  ', card 4000-', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'), ' ',
  lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), '-', lpad(CAST(o_orderkey * 7 % 10000 AS STRING), 4, '0'),
  ', zip ', lpad(CAST(c_custkey % 100000 AS STRING), 5, '0'), '-', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'),
  ', ip 10.', CAST(c_custkey % 300 AS STRING), '.', CAST(o_orderkey % 256 AS STRING), '.', CAST(o_orderkey % 300 AS STRING),
  ', due ', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'),
  '/', CAST(year(o_orderdate) AS STRING), '.') AS text
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
"""

# A classifier's output without a classifier: word pieces, mixed tags, a low score, an orphan
# I-, an entity inside an e-mail, a one-letter entity and an O row.
NER_TOKENS = """
SELECT prompt_id, idx, entity, word, CAST(score AS DOUBLE) AS score FROM (
SELECT prompt_id, 1 AS idx, 'B-PER' AS entity, 'Customer' AS word, 0.99 AS score FROM {prompts}
UNION ALL SELECT prompt_id, 2, 'I-PERSON', concat('##', substring(text, 19, 10)), 0.95 FROM {prompts}
UNION ALL SELECT prompt_id, 3, 'B-LOC', 'NATION', 0.60 FROM {prompts}
UNION ALL SELECT prompt_id, 4, 'I-LOC', '##_1', 0.90 FROM {prompts} WHERE prompt_id % 2 = 0
UNION ALL SELECT prompt_id, 5, 'I-ORG', 'orphan', 0.90 FROM {prompts} WHERE prompt_id % 3 = 0
UNION ALL SELECT prompt_id, 6, 'B-ORG', 'example.com', 0.97 FROM {prompts} WHERE prompt_id % 5 = 0
UNION ALL SELECT prompt_id, 7, 'B-PER', 'O', 0.91 FROM {prompts} WHERE prompt_id % 4 = 0
UNION ALL SELECT prompt_id, 8, 'O', 'due', 0.99 FROM {prompts}
) AS tokens
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, keys=("doc_id",)) -> DataFrame:
    return read_texts(spark, f"{sf_dir}/documents.parquet", keys=list(keys), even_out=True)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation")}
    texts = spark.sql(PROMPTS, **named)
    # Detection is dear for its bytes: tasks of equal size in bytes, one or two a core, leave most
    # cores idle while the last ones run.
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return texts.repartition(tasks, "prompt_id")


def ner_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NER_TOKENS, prompts=prompts(spark, sf_dir))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, id, text`` of all documents, all pages and all prompts."""
    docs = documents(spark, sf_dir).select(
        F.lit("documents").alias("src"), F.col("doc_id").alias("id"), "text"
    )
    pages = read_texts(
        spark, f"{sf_dir}/pages.parquet", text="html", keys=["page_id"], even_out=True
    ).select(F.lit("pages").alias("src"), F.col("page_id").alias("id"), "text")
    made = prompts(spark, sf_dir).select(
        F.lit("prompts").alias("src"), F.col("prompt_id").alias("id"), "text"
    )
    return docs.unionByName(pages).unionByName(made)


def tagger():
    """A rule standing in for a classifier, for tests only."""
    import re

    names = re.compile(r"Customer#\d+|NATION_\d+|\b(?:for|of)\b")

    def tag(texts):
        return [
            [
                (
                    {"C": "B-PER", "N": "B-LOC"}.get(m.group()[0], "O"),
                    m.group(),
                    0.9,
                    i,
                )
                for i, m in enumerate(names.finditer(text))
            ]
            for text in texts
        ]

    return tag


def fussy_tagger():
    """The same rule, which fails on some texts."""
    tag = tagger()

    def fussy(texts):
        if any("NATION_1," in text for text in texts):
            raise ValueError("not this one")
        return tag(texts)

    return fussy
