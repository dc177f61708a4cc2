"""The queries of this subpackage, and the same results in SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import (
    align,
    bpe,
    exact,
    html,
    jaccard,
    licenses,
    lines,
    packing,
    pii,
    quality,
    search,
    topk,
    toxicity,
)
from veilspan.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html.main_texts(pages)
    text = F.col("main_text")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxic_score").alias("score"),
        F.col("toxic_flag").alias("predicted"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "lines_removed", "lines_left")


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
f AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY seq) AS upto FROM f),
d AS (SELECT doc_id, list(line ORDER BY seq) AS lines FROM f GROUP BY doc_id),
w AS (
  SELECT a.doc_id, a.seq AS s, b.seq AS e,
         md5(array_to_string(list_slice(d.lines, a.seq, b.seq), chr(10))) AS run
  FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq AND a.seq + 29
  JOIN d ON d.doc_id = a.doc_id
  WHERE b.upto - a.upto + a.words >= 30
    AND (b.upto - b.words - a.upto + a.words < 30 OR b.upto - a.upto < 30)),
o AS (
  SELECT doc_id, s, e, first_value((doc_id, s)) OVER (PARTITION BY run ORDER BY doc_id, s) AS o
  FROM w),
g AS (
  SELECT DISTINCT f.doc_id, f.pos FROM o JOIN f ON f.doc_id = o.doc_id AND f.seq BETWEEN s AND e
  WHERE (o.doc_id, o.s) <> o.o),
k AS (
  SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos)
           FILTER (WHERE g.pos IS NULL), '') AS left_text,
         count(g.pos) AS gone, count(f.pos) AS filled
  FROM l LEFT JOIN g USING (doc_id, pos) LEFT JOIN f USING (doc_id, pos) GROUP BY l.doc_id)
SELECT doc_id, CASE WHEN gone = 0 THEN text ELSE left_text END AS text,
       CAST(gone AS INT) AS lines_removed, CAST(filled - gone AS INT) AS lines_left
FROM k JOIN documents USING (doc_id)
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), ranks)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return found.select("doc_id", *[f"license.{c}" for c in kept])


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(spark, f"{sf_dir}/documents.parquet")
    return found.drop("locator")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(table(spark, sf_dir, "documents"), ranks)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, mask=False)
    kept = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    return found.select("doc_id", *[f"pii.{c}" for c in kept])


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS whole
  FROM documents),
g AS (
  SELECT whole, count(*) AS group_size,
         first(doc_id ORDER BY n DESC, doc_id) AS keep_id
  FROM t GROUP BY whole)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(whole) AS text_sha256
FROM t JOIN g USING (whole)
"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    model = public_tokenizers.path("piece_bpe_32k.model")
    return align.align(table(spark, sf_dir, "documents"), ranks, model)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fact = {c: F.col("quality")[c] for c in quality.FACTS}
    base = [rule.fails(F.col("text"), F.array(), fact) for rule in quality.BASE]
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id",
        *[fact[c].alias(c) for c in columns],
        (base[0] | base[1]).alias("base_failed"),
        F.col("quality.kept").alias("kept"),
    )


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (
  SELECT row, i, array_to_string(list_slice(words, i, i + 7), ' ') AS win
  FROM (SELECT row, words, unnest(generate_series(1, len(words) - 7)) AS i FROM d)),
r AS (SELECT row, i FROM w QUALIFY count(*) OVER (PARTITION BY row, win) > 1),
c AS (
  SELECT row, least(8, coalesce(lead(i) OVER (PARTITION BY row ORDER BY i) - i, 8)) AS n FROM r),
p AS (SELECT row, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY row),
f AS (
  SELECT doc_id, text, words, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN p USING (row)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 100 * n_symbols > 10 * n_words
    OR word_chars < 3 * n_words OR word_chars > 12 * n_words
    OR 100 * n_dup_lines > 40 * n_lines
    OR 100 * length(regexp_replace(text, '[^!?]', '', 'g')) > 50 * n_words
    OR 100 * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > 50 * word_chars
    OR 100 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{L}'))) > 20 * n_words
    OR 100 * len(list_filter(list_zip(words[2:], words[:-2]), lambda x: x[1] = x[2])) > 20 * n_words
  ) AS kept
FROM b
"""


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
q AS (
  SELECT row_number() OVER () AS item, item_id,
    list_distinct(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
  FROM benchmark),
i AS (SELECT item, item_id, unnest(terms) AS term FROM q),
p AS (
  SELECT row, term, count(*) AS tf
  FROM (SELECT row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p, s GROUP BY term, n_docs),
m AS (
  SELECT row, doc_id, 10 + (90 * CAST(len(terms) AS BIGINT) * n_docs) // n_terms AS m
  FROM d, s WHERE len(terms) > 0),
t AS (
  SELECT item, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN f USING (term) JOIN m USING (row) GROUP BY item, row),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INT) AS rank
  FROM t WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def registry() -> dict[str, Query]:
    return {
        "op1_html": op1_html,
        "op2_topk": op2_topk,
        "op3_toxicity": op3_toxicity,
        "op4_line_dedup": op4_line_dedup,
        "op5_bpe": op5_bpe,
        "op6_licenses": op6_licenses,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_packing": op9_packing,
        "op10_pii": op10_pii,
        "op11_alignment": op11_alignment,
        "op12_quality": op12_quality,
        "op13_search": op13_search,
    }


def oracle() -> dict[str, str]:
    return {
        "op2_topk": OP2_SQL,
        "op4_line_dedup": OP4_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op12_quality": OP12_SQL,
        "op13_search": OP13_SQL,
    }
