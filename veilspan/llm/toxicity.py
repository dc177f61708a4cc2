"""Toxicity by multiple-instance learning.

A document is a bag of sentences with at least one word. A sentence's probability comes from the
words in it; the document's is the noisy-or, 1 - prod(1 - p), of its ``TOP`` most probable ones, so
that many harmless sentences do not add up to an offence. Only document labels exist, so the
gradient of the noisy-or decides which sentences a positive label blames. The same sentence scores
then locate the offending sentences. Words are hashed, so no vocabulary is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import Words, ship, slices

#: Buckets of the hashed words.
BITS = 20
#: The model is fitted on at most so many different labelled texts: one of each of the ids that have
#: a document, those with the smallest hash first, and then further texts of these ids.
MAX_LABELLED = 6_000
#: A word takes part in the fit if so many of these documents hold it.
MIN_DOCS = 4
THRESHOLD = 0.3
#: Rows, and bytes of texts, that a worker scores at a time. A byte needs about 50 bytes of working arrays,
#: and a worker keeps what it once took from the system.
ROWS, BYTES = 512, 1 << 18
#: Sentences of a document that the noisy-or takes, the most probable ones. All are scored.
TOP = 16

#: Sentences end at these bytes: . ! ? and the line feed. A full stop between digits ends none.
_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?\n", dtype=np.uint8))
#: Words: ASCII letters and digits, and all bytes of other characters.
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def _sentences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its sentence, numbered through all texts, and of each sentence its first byte.
    Only sentences with a word count."""
    data = words.data
    ends = np.flatnonzero(_ENDS[data])
    inner = ends[(ends > 0) & (ends < len(data) - 1)]
    number = (data[inner] == 46) & _DIGIT[data[inner - 1]] & _DIGIT[data[inner + 1]]
    starts = np.concatenate([[0], np.setdiff1d(ends, inner[number]) + 1])
    at = np.searchsorted(starts, words.start, side="right") - 1
    held, sentence = np.unique(at, return_inverse=True)
    return sentence, starts[held]


def _top(logits: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the logits are among the ``TOP`` largest of their group; groups are ascending."""
    order = np.lexsort((-logits, group))
    sizes = np.bincount(group) if len(group) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros(len(group), dtype=bool)
    out[order] = rank < TOP
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by bucket
    bias: float

    def sentence_logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        sentence, starts = _sentences(words)
        bucket = (words.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
        sums = np.bincount(sentence, weights=self.weights[bucket], minlength=len(starts))
        return sums + self.bias, starts

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Of each text its score, and its sentences: their probabilities and first bytes."""
        out, parts = np.zeros(len(texts)), []
        for a, b in slices(texts, BYTES):
            words = Words(texts[a:b], _WORD)
            logits, starts = self.sentence_logits(words)
            first = np.searchsorted(starts, words.offset)
            # log(1 - p) of each sentence; the noisy-or of a text is 1 - exp(their sum)
            taken = _top(logits, np.repeat(np.arange(b - a), np.diff(first)))
            sums = np.concatenate([[0.0], np.cumsum(np.where(taken, -np.logaddexp(0.0, logits), 0.0))])
            total = sums[first[1:]] - sums[first[:-1]]
            out[a:b] = -np.expm1(total)
            p = 1.0 / (1.0 + np.exp(-logits))
            for i in range(b - a):
                own = slice(first[i], first[i + 1])
                parts.append((p[own], starts[own] - words.offset[i]))
        return np.clip(out, 0.0, 1.0), parts


def bag(texts: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """Of each text how many sentences it has, and of each word its sentence and its bucket, as
    32-bit integers."""
    for a, b in slices(texts, BYTES):
        words = Words(texts[a:b], _WORD)
        sentence, starts = _sentences(words)
        first = np.searchsorted(starts, words.offset)
        bucket = (words.hashes() >> np.uint64(64 - BITS)).astype(np.int32)
        for i in range(b - a):
            own = slice(words.first[i], words.first[i + 1])
            inside = (sentence[own] - first[i]).astype(np.int32)
            yield int(first[i + 1] - first[i]), inside.tobytes(), bucket[own].tobytes()


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = 250, penalty: float = 2e-4) -> Model:
    """``fit_bags`` on texts."""
    return fit_bags(list(bag(texts)), labels, rounds, penalty)


def fit_bags(
    bags: list[tuple[int, bytes, bytes]], labels: np.ndarray, rounds: int = 250, penalty: float = 2e-4
) -> Model:
    """Weights by proximal Adam on the noisy-or likelihood, with an L1 penalty.

    Without labelled rows, or with one label only, every sentence has that label's rate.
    """
    weights = np.zeros(1 << BITS)
    n = len(bags)
    positive = float(np.sum(labels))
    if n == 0 or positive in (0.0, float(n)):
        rate = (positive + 0.5) / (n + 1.0)
        return Model(weights, float(np.log(rate / (1.0 - rate))) if n else -3.0)
    counts = np.array([b[0] for b in bags], dtype=np.int64)
    first = np.cumsum(counts) - counts
    bucket = np.concatenate([np.frombuffer(b[2], dtype=np.int32) for b in bags])
    own = [np.frombuffer(b[1], dtype=np.int32) + at for b, at in zip(bags, first, strict=True)]
    sentence = np.concatenate(own).astype(np.int32)
    sentences, doc_of = int(counts.sum()), np.repeat(np.arange(n), counts)

    # Words that stand more often in positive documents than chance allows, or less often.
    pairs = np.unique(doc_of[sentence].astype(np.int64) << BITS | bucket)
    holds, held = pairs & ((1 << BITS) - 1), pairs >> BITS
    among = np.bincount(holds, minlength=1 << BITS).astype(float)
    toxic = np.bincount(holds, weights=labels[held].astype(float), minlength=1 << BITS)
    rate = positive / n
    z = (toxic - among * rate) / np.sqrt(among * rate * (1 - rate) + 1e-9)
    chosen = np.flatnonzero((among >= MIN_DOCS) & (np.abs(z) > 3.0))
    place = np.full(1 << BITS, -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))
    at = place[bucket]
    word, where = at[at >= 0], sentence[at >= 0]
    # Sentences without a chosen word differ by their document only: counted, not listed.
    listed, where = np.unique(where, return_inverse=True)
    listed_doc = doc_of[listed]
    # No more of them than the noisy-or can take are listed with the others.
    bare = np.minimum(np.bincount(doc_of, minlength=n) - np.bincount(listed_doc, minlength=n), TOP)
    listed_doc = np.concatenate([listed_doc, np.repeat(np.arange(n), bare)])
    order = np.argsort(listed_doc, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    listed_doc, where = listed_doc[order], place[where]

    w, bias = np.zeros(len(chosen)), -6.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    y = labels.astype(float)
    for step in range(1, rounds + 1):
        logits = np.bincount(where, weights=w[word], minlength=len(listed_doc)) + bias
        taken = _top(logits, listed_doc)
        p = np.where(taken, 1.0 / (1.0 + np.exp(-logits)), 0.0)
        none = np.where(taken, -np.logaddexp(0.0, logits), 0.0)
        some = np.maximum(-np.expm1(np.bincount(listed_doc, weights=none, minlength=n)), 1e-9)
        # d loss / d logit = p * (1 - y / P), for every sentence that the noisy-or takes
        by_sentence = p * ((1.0 - y / some) / n)[listed_doc]
        grad = np.concatenate(
            [
                np.bincount(word, weights=by_sentence[where], minlength=len(chosen)),
                [by_sentence.sum()],
            ]
        )
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        shrink = 0.1 * penalty / (np.sqrt(v[:-1] / (1 - 0.99**step)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(shrink, 0.05), 0.0)
        bias = min(bias - move[-1], -1.0)
    weights[chosen] = w
    return Model(weights, float(bias))


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are never learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most: int = MAX_LABELLED,
) -> Model:
    """Fit on the labelled rows that are not held out, ``most`` different ones at the most. Words are
    hashed in the tasks; no text comes to the driver.

    Rows without an id or a label do not take part; an id with several labels counts as positive
    if one of them is.
    """
    known = (
        labels.select(F.col(id_col).alias("id_"), F.col(label_col).alias("y_"))
        .filter(F.col("id_").isNotNull() & F.col("y_").isNotNull() & ~held_out(F.col("id_")))
        .groupBy("id_")
        .agg(F.max("y_").alias("y_"))
    )
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id_"), text.alias("t_")).withColumn("h_", F.xxhash64("t_"))
    # One row for each id before the join, so that an id of very many rows is one row of it.
    one = rows.groupBy("id_").agg(F.min("h_").alias("h_"), F.max("h_").alias("last_")).join(known, "id_")
    found = one.orderBy(F.xxhash64("id_"), "id_").limit(most).collect()
    labelled = {r["id_"]: r["y_"] for r in found}
    chosen = [(r["id_"], r["h_"]) for r in found]
    several = [(r["id_"], r["h_"]) for r in found if r["last_"] != r["h_"]]
    kind = docs.schema[id_col].dataType.simpleString()
    if several and len(chosen) < most:
        firsts = F.broadcast(spark.createDataFrame(several, f"id_ {kind}, lead_ long"))
        others = rows.join(firsts, "id_").filter("h_ <> lead_").select("id_", "h_").distinct()
        others = others.orderBy(F.xxhash64("id_", "h_"), "id_", "h_").limit(most - len(chosen))
        chosen += [(r["id_"], r["h_"]) for r in others.collect()]
    if not chosen:
        return fit_bags([], np.array([], dtype=bool))

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple] = set()
        for batch in batches:
            fresh = []
            for key in zip(batch["id_"], batch["h_"], batch["t_"], strict=True):
                if key[:2] not in seen:
                    seen.add(key[:2])
                    fresh.append(key)
            made = bag([t.encode() for _, _, t in fresh])
            yield pd.DataFrame(
                [(i, h, *b) for (i, h, _), b in zip(fresh, made, strict=True)],
                columns=["id_", "h_", "n", "sentence", "bucket"],
            )

    wanted = F.broadcast(spark.createDataFrame(chosen, f"id_ {kind}, h_ long"))
    schema = f"id_ {kind}, h_ long, n int, sentence binary, bucket binary"
    hashed = rows.join(wanted, ["id_", "h_"]).select("id_", "h_", "t_").mapInPandas(bags, schema)
    got = hashed.dropDuplicates(["id_", "h_"]).collect()
    got.sort(key=lambda r: (r["id_"], r["h_"]))
    made = [(r["n"], bytes(r["sentence"]), bytes(r["bucket"])) for r in got]
    return fit_bags(made, np.array([labelled[r["id_"]] > 0 for r in got], dtype=bool))


def _portions(batches: Iterator[pd.Series]) -> Iterator[list[bytes]]:
    """The texts of the batches in order, at most ``ROWS`` of one batch at a time."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield [t.encode() for t in batch.iloc[at : at + ROWS]]


def score(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with toxic_score, toxic_flag and toxic_spans added.

    The spans are the offending sentences (probability at least half the threshold): start and
    length in UTF-8 bytes, up to the next sentence with a word, and the probability. Texts without
    words, null and empty ones among them, score 0. Rows are kept as they are given, repeated or without an id; columns with the new
    names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("toxic_score", "toxic_flag", "toxic_spans")
    sent = spark.sparkContext.broadcast(
        (np.flatnonzero(model.weights).astype(np.int32), model.weights[model.weights != 0], model.bias)
    )

    @F.pandas_udf("struct<score:double,spans:array<struct<start:int,length:int,p:double>>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        buckets, values, bias = sent.value
        weights = np.zeros(1 << BITS)
        weights[buckets] = values
        own = Model(weights, bias)
        for texts in _portions(batches):
            scores, parts = own.scores(texts)
            spans = []
            for text, (p, starts) in zip(texts, parts, strict=True):
                ends = np.append(starts[1:], len(text))
                bad = np.flatnonzero(p >= threshold / 2) if len(p) else []
                spans.append(
                    [
                        {"start": int(starts[i]), "length": int(ends[i] - starts[i]), "p": float(p[i])}
                        for i in bad
                    ]
                )
            yield pd.DataFrame({"score": scores, "spans": spans})

    result = scored(F.coalesce(F.col(text_col), F.lit("")))
    scored_docs = docs.withColumn("__scored", result)
    return scored_docs.select(
        *docs.columns,
        F.col("__scored.score").alias("toxic_score"),
        (F.col("__scored.score") >= threshold).cast("int").alias("toxic_flag"),
        F.col("__scored.spans").alias("toxic_spans"),
    )
