"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import veilspan as v
from checks.fixtures import corpus, documents, fussy_tagger, ner_tokens, prompts, table, tagger
from veilspan.functions.patterns import NER_ENABLED
from veilspan.functions.tokens import entity_of, label_of
from veilspan.operators.detect import no_spans
from veilspan.operators.entities import TOKENS, entities_of, entity_spans, ner_type, tag_entities
from veilspan.operators.scrub import found_entries, found_spans
from veilspan.operators.spans import merge_span_tables
from veilspan.operators.summary import summarize_spans
from veilspan.operators.tables import DENSE, cut_lineage, discard, new_path
from veilspan.operators.vault import vault_entries
from veilspan.sources.texts import stream_texts
from veilspan.streaming.streams import scrub_token_stream

KEYS = ["src", "id"]
SECRET = "k"


# --- Sources and sinks ---


def read_texts(spark: SparkSession, sf: str) -> DataFrame:
    return v.read_texts(spark, f"{sf}/documents.parquet", keys=["doc_id", "source"])


def drop_blank(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("id") % 7
    mixed = corpus(spark, sf).withColumn(
        "text",
        F.when(kind == 0, "")
        .when(kind == 1, "   ")
        .when(kind == 2, " 　﻿")
        .when(kind == 3, F.lit(None))
        .otherwise(F.col("text")),
    )
    return v.drop_blank(mixed)


def write_scrubbed(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "scrubbed")
    v.write_scrubbed(
        v.scrub_labels(documents(spark, sf, ("doc_id", "lang"))), path, partition_by=["lang"]
    )
    return spark.read.parquet(path)


def save_vault(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "vault")
    vault = build_vault(spark, sf)
    v.save_vault(vault.filter(F.col("entity") != "email"), path)
    v.save_vault(vault, path)
    v.save_vault(vault, path)
    return v.load_vault(spark, path)


def load_vault(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "vault")
    v.save_vault(build_vault(spark, sf), path, "overwrite")
    return v.load_vault(spark, path, require_mapping=True, session="default")


# --- Normalisation ---


def strip_invisible(spark: SparkSession, sf: str) -> DataFrame:
    return v.strip_invisible(corpus(spark, sf))


def invisible_profile(spark: SparkSession, sf: str) -> DataFrame:
    return v.invisible_profile(corpus(spark, sf), ["src"])


# --- Detection ---


def detector(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return v.detect_spans(corpus(spark, sf), KEYS, types=[kind])

    return run


def candidate_spans(spark: SparkSession, sf: str) -> DataFrame:
    return v.candidate_spans(corpus(spark, sf), KEYS)


def valid_cards(spark: SparkSession, sf: str) -> DataFrame:
    return v.valid_cards(v.candidate_spans(corpus(spark, sf), KEYS, types=["creditCard"]))


def valid_ipv4(spark: SparkSession, sf: str) -> DataFrame:
    return v.valid_ipv4(v.candidate_spans(corpus(spark, sf), KEYS, types=["ipAddress"]))


def detect_spans(spark: SparkSession, sf: str) -> DataFrame:
    return v.detect_spans(corpus(spark, sf), KEYS)


def has_pii(spark: SparkSession, sf: str) -> DataFrame:
    return v.has_pii(corpus(spark, sf)).select(*KEYS)


def pii_summary(spark: SparkSession, sf: str) -> DataFrame:
    return v.pii_summary(corpus(spark, sf), KEYS)


def pii_report(spark: SparkSession, sf: str) -> DataFrame:
    return v.pii_report(corpus(spark, sf), ["src"])


def pii_report_by_label(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    texts = documents(spark, sf, ("doc_id", "source", "lang")).join(labels, "doc_id", "left")
    texts = texts.withColumn("quality", F.coalesce("quality", F.lit(-1)))
    return v.pii_report(texts, ["source", "lang", "quality"])


# --- Span algebra ---


def detect_spans_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Cut into pieces from 2,048 characters on, so that many texts are."""
    return v.detect_spans_cut(corpus(spark, sf), KEYS, size=2048)


def span_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return v.span_overlaps(v.detect(corpus(spark, sf)), KEYS)


def span_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return v.span_pairs(v.detect(corpus(spark, sf)), KEYS)


def merge_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    """Extra spans that overlap each other: every date and phone number, and for each a longer
    stretch that comes first where its start is even."""
    found = v.detect(corpus(spark, sf), types=["phone", "date"])
    spans = F.col("spans")
    wider = F.transform(
        spans,
        lambda s: F.struct(
            F.lit("misc").alias("type"),
            F.substring("text", s["start"] + 1, s["end"] - s["start"] + 20).alias("value"),
            s["start"].alias("start"),
            F.least(s["end"] + 20, F.length("text")).alias("end"),
        ),
    )
    even = F.filter(wider, lambda s: s["start"] % 2 == 0)
    odd = F.filter(wider, lambda s: s["start"] % 2 == 1)
    both = found.select(*KEYS, F.concat(even, spans, odd).alias("extra"), no_spans().alias("base"))
    return v.merge_spans(both, "base", "extra", "kept").select(*KEYS, F.inline("kept"))


def sort_spans(spark: SparkSession, sf: str) -> DataFrame:
    ordered = v.sort_spans(v.detect(corpus(spark, sf)))
    return ordered.select(*KEYS, F.posexplode("spans").alias("pos", "s")).select(
        *KEYS, "pos", "s.*"
    )


def cover_spans(spark: SparkSession, sf: str) -> DataFrame:
    return v.cover_spans(v.detect(corpus(spark, sf))).select(*KEYS, F.inline("spans"))


def merge_spans(spark: SparkSession, sf: str) -> DataFrame:
    base = v.detect_spans(prompts(spark, sf), ["prompt_id"])
    return merge_span_tables(base, filter_entities(spark, sf), ["prompt_id"])


def _with_extra(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with the token array of their row, turned into spans without another shuffle."""
    gathered = (
        ner_tokens(spark, sf)
        .groupBy("prompt_id")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "entity", "word", "score"))).alias("t"))
        .select(
            "prompt_id",
            F.transform(
                "t",
                lambda x: F.struct(x["entity"], x["word"], x["score"], x["idx"]),
            )
            .cast(TOKENS)
            .alias("tokens"),
        )
    )
    texts = v.strip_invisible(prompts(spark, sf)).join(gathered, "prompt_id", "left")
    return entity_spans(texts)


def merge_span_arrays(spark: SparkSession, sf: str) -> DataFrame:
    found = v.detect(_with_extra(spark, sf), strip=False)
    return v.merge_spans(found).select("prompt_id", F.inline("spans"))


# --- Redaction ---


def redact(spark: SparkSession, sf: str) -> DataFrame:
    return v.redact(v.detect(corpus(spark, sf))).select(*KEYS, "text")


def redact_splice(spark: SparkSession, sf: str) -> DataFrame:
    return v.redact(v.detect(corpus(spark, sf)), overlap="splice").select(*KEYS, "text")


def label_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Types that the detectors found, and event types, which are no labels."""
    found = v.detect_spans(corpus(spark, sf), []).select("type")
    other = table(spark, sf, "events").select(F.col("event_type").alias("type"))
    kinds = found.unionByName(other).groupBy("type").agg(F.count("*").alias("n"))
    return kinds.select("type", label_of(F.col("type")).alias("label"), "n")


def to_entity(spark: SparkSession, sf: str) -> DataFrame:
    kinds = detect_spans(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return kinds.select("type", entity_of(F.col("type")).alias("entity"), "n")


def scrub_labels(spark: SparkSession, sf: str) -> DataFrame:
    return v.scrub_labels(corpus(spark, sf))


def scrub_with_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return v.label_mapping(v.scrub_with_mapping(corpus(spark, sf)), KEYS)


def scrub_tokens(spark: SparkSession, sf: str) -> DataFrame:
    vault = build_vault(spark, sf)
    return v.scrub_tokens(corpus(spark, sf), secret=SECRET, vault=vault)


def build_vault(spark: SparkSession, sf: str) -> DataFrame:
    return v.build_vault(vault_entries(corpus(spark, sf)), SECRET)


def vault_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """With two hex digits instead of eight, so that there is something to find."""
    short = F.concat(F.left("token", F.length("token") - 6), F.lit("]"))
    return v.vault_collisions(build_vault(spark, sf).withColumn("token", short))


# --- Restore ---


def _scrubbed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A scrubbed table and its vault, written as one job leaves them for the next. The vault and
    the texts come from one table of spans."""
    texts = corpus(spark, sf)
    found = found_spans(texts)
    entries = found_entries(found)
    vault = v.build_vault(entries, SECRET, unique=True)
    scrubbed = v.scrub_tokens(texts, secret=SECRET, vault=vault, found=found, entries=entries)
    written = cut_lineage(scrubbed, DENSE)
    discard(found, entries)
    return written, vault


def _scrubbed_with_repairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The same after an earlier vault took every plain hash for another value."""
    texts = corpus(spark, sf)
    found = found_spans(texts)
    entries = found_entries(found)
    earlier = v.build_vault(entries, SECRET, unique=True)
    earlier = earlier.withColumn("value", F.concat("value", F.lit("?")))
    vault = earlier.unionByName(v.build_vault(entries, SECRET, earlier, unique=True))
    scrubbed = v.scrub_tokens(texts, secret=SECRET, vault=vault, found=found, entries=entries)
    written = cut_lineage(scrubbed, DENSE)
    discard(found, entries)
    return written, vault


def scrub_tokens_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return _scrubbed_with_repairs(spark, sf)[0]


def restore_tokens_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return v.restore_tokens(*_scrubbed_with_repairs(spark, sf))


def has_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return v.has_tokens(_scrubbed(spark, sf)[0]).select(*KEYS)


def extract_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return v.extract_tokens(_scrubbed(spark, sf)[0], KEYS)


def restore_tokens(spark: SparkSession, sf: str) -> DataFrame:
    scrubbed, vault = _scrubbed(spark, sf)
    return v.restore_tokens(scrubbed, vault)


def restore_tokens_partial(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens the vault does not know stay; every hot token and text is split."""
    scrubbed, vault = _scrubbed(spark, sf)
    return v.restore_tokens(scrubbed, vault.filter(F.col("entity") != "date"), hot_rows=100)


def restore_labels(spark: SparkSession, sf: str) -> DataFrame:
    return v.restore_labels(v.scrub_with_mapping(corpus(spark, sf))).drop("mapping")


def unresolved_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Dates are missing from the vault, ZIP codes stand in it with two values."""
    scrubbed, vault = _scrubbed(spark, sf)
    twice = vault.filter(F.col("entity") == "zip").withColumn("value", F.reverse("value"))
    twice = twice.withColumn("value", F.concat("value", F.lit("?")))
    broken = vault.filter(F.col("entity") != "date").unionByName(twice)
    return v.unresolved_tokens(scrubbed, broken, KEYS, hot_rows=500)


def round_trip_check(spark: SparkSession, sf: str) -> DataFrame:
    scrubbed, vault = _scrubbed(spark, sf)
    original = corpus(spark, sf)
    restored = cut_lineage(v.restore_tokens(scrubbed, vault), DENSE)
    discard(scrubbed)
    failed = v.round_trip_check(original, restored, KEYS)
    totals = original.groupBy("src").agg(F.count(F.lit(1)).alias("texts"))
    failures = failed.groupBy("src").agg(F.count(F.lit(1)).alias("failed"))
    return totals.join(failures, "src", "left").select(
        "src", "texts", F.coalesce("failed", F.lit(0)).cast("bigint").alias("failed")
    )


# --- Named entities ---


def ner_tokens_query(spark: SparkSession, sf: str) -> DataFrame:
    return v.ner_tokens(prompts(spark, sf), ["prompt_id"], tagger).drop("idx")


def drop_outside(spark: SparkSession, sf: str) -> DataFrame:
    return v.drop_outside(ner_tokens(spark, sf))


def ner_type_query(spark: SparkSession, sf: str) -> DataFrame:
    tags = ner_tokens(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return tags.select("entity", ner_type(F.col("entity")).alias("type"), "n")


def aggregate_entities(spark: SparkSession, sf: str) -> DataFrame:
    return v.aggregate_entities(ner_tokens(spark, sf), ["prompt_id"])


def entities_in_row(spark: SparkSession, sf: str) -> DataFrame:
    rows = ner_tokens(spark, sf).groupBy("prompt_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "entity", "word", "score"))).alias("tokens")
    )
    return rows.select("prompt_id", F.inline(entities_of(F.col("tokens"))))


def locate_entities(spark: SparkSession, sf: str) -> DataFrame:
    texts = v.strip_invisible(prompts(spark, sf))
    return v.locate_entities(aggregate_entities(spark, sf), texts, ["prompt_id"])


def filter_entities(spark: SparkSession, sf: str) -> DataFrame:
    return v.filter_entities(locate_entities(spark, sf), NER_ENABLED)


def min_score(spark: SparkSession, sf: str) -> DataFrame:
    return v.min_score(aggregate_entities(spark, sf), 0.8)


def summary_with_source(spark: SparkSession, sf: str) -> DataFrame:
    summary = summarize_spans(merge_spans(spark, sf), ["prompt_id"])
    return v.summary_with_source(summary, filter_entities(spark, sf), ["prompt_id"])


def scrub_with_ner(spark: SparkSession, sf: str) -> DataFrame:
    done = v.scrub_with_ner(prompts(spark, sf), tagger, secret=SECRET)
    return done.select("prompt_id", "text")


def scrub_with_ner_vault(spark: SparkSession, sf: str) -> DataFrame:
    """The tagger runs once for the vault and the texts."""
    path = new_path(spark, "vault")
    done = v.scrub_with_ner_to_vault(prompts(spark, sf), tagger, path, secret=SECRET)
    return done.select("prompt_id", "text")


def ner_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that the tagger fails on, here those of one nation."""
    tagged = tag_entities(prompts(spark, sf), fussy_tagger)
    return v.ner_errors(tagged, ["prompt_id"])


# --- Streams ---


def _document_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The pattern finds a table of one file as well as a folder of files. As a plain path a stream
    takes folders only, and a filter on file names would pass over all files in such a folder."""
    schema = table(spark, sf, "documents").schema
    return stream_texts(spark, f"{sf}/documents.parque[t]", schema, keys=["doc_id"])


def scrub_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = new_path(spark, "out")
    stream = v.scrub_stream(_document_stream(spark, sf)).writeStream.format("parquet")
    stream.option("checkpointLocation", new_path(spark, "offsets")).trigger(
        availableNow=True
    ).start(out).awaitTermination()
    return spark.read.parquet(out)


def _token_stream(spark: SparkSession, sf: str) -> tuple[str, str]:
    out, vault = new_path(spark, "out"), new_path(spark, "vault")
    stream = scrub_token_stream(
        _document_stream(spark, sf), out, vault, new_path(spark, "offsets"), secret=SECRET
    )
    stream.trigger(availableNow=True).start().awaitTermination()
    return out, vault


def scrub_token_stream_query(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = _token_stream(spark, sf)
    return spark.read.parquet(out).select("doc_id", "text")


def vault_stream(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "vault")
    for _ in range(2):  # the second run sees the same texts again
        stream = v.vault_stream(
            _document_stream(spark, sf), path, new_path(spark, "offsets"), secret=SECRET
        )
        stream.trigger(availableNow=True).start().awaitTermination()
    return v.load_vault(spark, path)


def restore_stream(spark: SparkSession, sf: str) -> DataFrame:
    scrubbed, vault = _token_stream(spark, sf)
    out = new_path(spark, "out")
    replies = spark.readStream.schema("doc_id bigint, text string").parquet(scrubbed)
    stream = v.restore_stream(
        replies.select("doc_id", "text"), out, vault, new_path(spark, "offsets")
    )
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("doc_id", "text")


def restore_waiting_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Every mapping is made and arrives after the replies: those of dates too late, the others
    while the replies wait. The stream is stopped and started again before the mappings come, and
    before one row far ahead on each side moves the watermarks."""
    scrubbed, vault = _token_stream(spark, sf)
    replies, mappings, out, offsets = (
        new_path(spark, name) for name in ("replies", "mappings", "out", "offsets")
    )
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    hours = F.when(F.col("entity") == "date", F.expr("INTERVAL 2 hours")).otherwise(
        F.expr("INTERVAL 30 minutes")
    )

    def mark(path: str, names: list[str], at: Column) -> None:
        row = spark.range(1).select(*[F.lit("none").alias(n) for n in names], at)
        row.write.mode("append").parquet(path)

    def run() -> None:
        restored = v.restore_waiting_stream(
            spark.readStream.schema("doc_id bigint, text string, at timestamp").parquet(replies),
            spark.readStream.schema(
                "session string, token string, value string, made timestamp"
            ).parquet(mappings),
            ["doc_id"],
            wait="1 hour",
        )
        stream = restored.writeStream.format("parquet").option("path", out)
        stream.option("checkpointLocation", offsets).trigger(
            availableNow=True
        ).start().awaitTermination()

    names = ["session", "token", "value"]
    spark.read.parquet(scrubbed).select("doc_id", "text", start.alias("at")).write.parquet(replies)
    mark(mappings, names, start.alias("made"))
    run()
    v.load_vault(spark, vault).select(*names, (start + hours).alias("made")).write.mode(
        "append"
    ).parquet(mappings)
    run()
    ahead = start + F.expr("INTERVAL 1 day")
    mark(replies, ["text"], ahead.alias("at"))
    mark(mappings, names, ahead.alias("made"))
    run()
    return spark.read.schema("doc_id bigint, text string").parquet(out)


def summary_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = new_path(spark, "out")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream = v.summary_stream(_document_stream(spark, sf)).writeStream.outputMode("complete")
    stream.option("checkpointLocation", new_path(spark, "offsets")).foreachBatch(keep).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.parquet(out)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    detectors = {
        "detect_email": "email",
        "detect_phone": "phone",
        "detect_ssn": "ssn",
        "detect_credit_card": "creditCard",
        "detect_zip4": "zipCode",
        "detect_ipv4": "ipAddress",
        "detect_date": "date",
    }
    found = [
        read_texts, drop_blank, write_scrubbed, save_vault, load_vault,
        strip_invisible, invisible_profile,
        candidate_spans, valid_cards, valid_ipv4, detect_spans, has_pii, pii_summary, pii_report,
        pii_report_by_label,
        detect_spans_cut, span_overlaps, span_pairs, merge_overlapping, sort_spans, cover_spans, merge_spans, merge_span_arrays,
        redact, redact_splice, label_lookup, to_entity, scrub_labels, scrub_with_mapping,
        scrub_tokens, scrub_tokens_repaired, build_vault, vault_collisions,
        has_tokens, extract_tokens, restore_tokens, restore_tokens_partial, restore_tokens_repaired,
        restore_labels,
        unresolved_tokens, round_trip_check,
        drop_outside, aggregate_entities, entities_in_row, locate_entities, filter_entities,
        min_score, summary_with_source, scrub_with_ner, scrub_with_ner_vault, ner_errors,
        scrub_stream, vault_stream, restore_stream, restore_waiting_stream, summary_stream,
    ]
    return (
        {name: detector(kind) for name, kind in detectors.items()}
        | {f.__name__: f for f in found}
        | {
            "ner_tokens": ner_tokens_query,
            "ner_type": ner_type_query,
            "scrub_token_stream": scrub_token_stream_query,
        }
    )
