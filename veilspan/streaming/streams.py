"""The same jobs on streams.

Labels need nothing but the text, so they are a stateless projection. Tokens and restores go
through the vault in ``foreachBatch``, where each micro-batch is an ordinary table, written before
it is used. A batch that is replayed after a failure finds its values in the vault and adds nothing,
and files written for a batch land in a folder named after it, replaced as a whole on a replay.

The vault stream keeps every value it has seen as state, so that only new ones meet the vault.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from veilspan.functions.arrays import let
from veilspan.functions.patterns import NER_ENABLED, TOKEN, TYPES
from veilspan.functions.tokens import as_session
from veilspan.operators.detect import detect_spans, split_around
from veilspan.operators.entities import Tagger
from veilspan.operators.redact import scrub_labels
from veilspan.operators.restore import restore_tokens, token_test
from veilspan.operators.tables import cut_lineage
from veilspan.operators.vault import vault_entries
from veilspan.plans.scrub import scrub_to_vault, scrub_with_ner_to_vault, with_entities
from veilspan.sources.vaults import add_entries, load_vault

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BATCH = "batch_id"


def _per_batch(df: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]):
    def run(batch: DataFrame, batch_id: int) -> None:
        # Scanned several times below; a source need not give the same rows twice.
        work(cut_lineage(batch), batch_id)

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def scrub_stream(
    df: DataFrame, text: str = "text", types: Sequence[str] = TYPES, overlap: str = "cover"
) -> DataFrame:
    """Label mode: a streaming DataFrame, append mode, no state."""
    return scrub_labels(df, text, types, overlap=overlap)


def keep_state_on_disk(spark: SparkSession) -> None:
    """State that grows without end belongs in RocksDB; a provider that is set stays."""
    if spark.conf.get(_STORE, None) is None or "HDFSBacked" in spark.conf.get(_STORE):
        spark.conf.set(_STORE, _ROCKS)


def vault_stream(
    df: DataFrame,
    vault_path: str,
    checkpoint: str,
    session: str | Column = "default",
    secret: str = "",
    text: str = "text",
    types: Sequence[str] = TYPES,
    tagger: Callable[[], Tagger] | None = None,
    entity_types: Sequence[str] = NER_ENABLED,
    overlap: str = "cover",
) -> DataStreamWriter:
    """Keep the vault up to date with every value that arrives, named entities too with a tagger.

    Distinct values are kept as state without expiry, by session, entity and value. A batch of
    values that were seen before ends there: it reads no file of the vault. New values meet the
    buckets of their sessions.
    """
    keep_state_on_disk(df.sparkSession)
    if tagger is None:
        entries = vault_entries(df, session, text, types, overlap=overlap)
    else:
        work = with_entities(df, tagger, text, entity_types)
        entries = vault_entries(work, session, text, types, "extra", overlap, strip=False)

    def work_on(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            add_entries(batch.sparkSession, batch, vault_path, secret)

    return _per_batch(entries, checkpoint, work_on)


def scrub_token_stream(
    df: DataFrame,
    out_path: str,
    vault_path: str,
    checkpoint: str,
    session: str | Column = "default",
    secret: str = "",
    text: str = "text",
    types: Sequence[str] = TYPES,
    tagger: Callable[[], Tagger] | None = None,
    entity_types: Sequence[str] = NER_ENABLED,
    extra: str | None = None,
    overlap: str = "cover",
) -> DataStreamWriter:
    """Token mode: the vault first, then the batch with the vault's tokens, from the spans that
    were found once. With a tagger the rows carry ``ner_error``; ``extra`` names a column with
    further spans instead."""
    if tagger is not None and extra is not None:
        raise ValueError("give a tagger or a column of spans, not both")

    def work(batch: DataFrame, batch_id: int) -> None:
        if tagger is None:
            done = scrub_to_vault(batch, vault_path, session, secret, text, types, extra, overlap)
        else:
            done = scrub_with_ner_to_vault(
                batch, tagger, vault_path, session, secret, text, entity_types, overlap=overlap
            )
        _write_batch(done, out_path, batch_id)

    return _per_batch(df, checkpoint, work)


def restore_stream(
    df: DataFrame,
    out_path: str,
    vault_path: str,
    checkpoint: str,
    session: str | Column = "default",
    text: str = "text",
    require_mapping: bool = True,
) -> DataStreamWriter:
    """Restore each reply with the vault as it is when the reply arrives; only the buckets of the
    replies' sessions are read. Without a mapping for them the stream stops with ``NoMapping``,
    unless ``require_mapping`` is False."""

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if isinstance(session, Column):
            among = batch.select(as_session(session).alias("session"))
            vault = load_vault(spark, vault_path, require_mapping, among=among)
        else:
            vault = load_vault(spark, vault_path, require_mapping, session)
        _write_batch(restore_tokens(batch, vault, session, text), out_path, batch_id)

    return _per_batch(df, checkpoint, work)


def restore_waiting_stream(
    replies: DataFrame,
    mappings: DataFrame,
    keys: Sequence[str],
    at: str = "at",
    made: str = "made",
    wait: str = "10 minutes",
    lateness: str = "1 minute",
    session: str | Column = "default",
    text: str = "text",
    spread: int = 4,
) -> DataFrame:
    """Restore replies whose mapping may arrive after them: ``keys, at, text`` in append mode.

    ``mappings`` streams rows of the vault (session, token, value) with the time ``made``. A reply
    gets every mapping that was made until ``wait`` after its own time ``at``, however long
    before; it comes out when the watermarks of both streams, ``lateness`` behind the latest rows,
    have passed that time. Tokens without a mapping by then stay, and so do tokens with several
    values. Replies with equal keys, time and text count as one; a row without a time never comes
    out.

    It is a left join of two streams on the token. Replies leave its state when their time is over;
    mappings stay in it (RocksDB), as they do in the vault. ``spread`` copies of each mapping split
    a token that very many replies hold.
    """
    keep_state_on_disk(replies.sparkSession)
    col = F.col(text)
    who = [*keys, at, "_digest"]
    texts = replies.withWatermark(at, lateness).select(
        *keys,
        at,
        as_session(session).alias("_session"),
        col.alias("_text"),
        F.sha2(col, 256).alias("_digest"),
        F.posexplode_outer(F.regexp_extract_all(col, F.lit(TOKEN), F.lit(0))).alias("_ord", "_token"),
    )
    # The text goes with its first token only.
    rows = texts.withColumn(
        "_text", F.when(F.coalesce("_ord", F.lit(0)) == 0, F.col("_text"))
    ).withColumn("_salt", F.pmod(F.xxhash64(*keys, "_digest"), F.lit(spread)).cast("int"))
    # Out of a generator, so that the join's filters do not go below the watermark: rows of other
    # sessions move it too.
    known = mappings.withWatermark(made, lateness).select(
        F.col(made).alias("_made"),
        F.inline(
            F.transform(
                F.sequence(F.lit(0), F.lit(spread - 1)),
                lambda part: F.struct(
                    F.col("session").alias("_of"),
                    F.col("token").alias("_key"),
                    F.col("value").alias("_value"),
                    part.alias("_part"),
                ),
            )
        ),
    )
    in_time = F.col("_made") <= F.col(at) + F.expr(f"INTERVAL {wait}")
    same = (
        (F.col("_session") == F.col("_of"))
        & (F.col("_token") == F.col("_key"))
        & (F.col("_salt") == F.col("_part"))
    )
    joined = rows.join(known, same & in_time, "left_outer").select(
        *who, "_text", "_ord", "_value"
    )
    gathered = joined.groupBy(*who).agg(
        F.max("_text").alias(text),
        F.sort_array(F.collect_set(F.struct("_ord", "_value"))).alias("_found"),
    )
    return gathered.select(*keys, at, _filled(col, F.col("_found")).alias(text))


def _filled(text: Column, found: Column) -> Column:
    """The text with its tokens replaced; ``found`` has the values of each token, in order."""

    def one(e: Column, i: Column) -> Column:
        twice = F.get(found, i + 1)["_ord"].eqNullSafe(e["_ord"])
        return F.struct(
            (~F.get(found, i - 1)["_ord"].eqNullSafe(e["_ord"])).alias("first"),
            F.when(~twice, e["_value"]).alias("value"),
        )

    values = F.filter(F.transform(found, one), lambda e: e["first"])

    def fill(values: Column) -> Column:
        parts = F.transform(
            split_around(text, TOKEN),
            lambda part, i: F.when(
                i % 2 == 1, F.coalesce(F.get(values, F.shiftright(i, 1))["value"], part)
            ).otherwise(part),
        )
        return F.array_join(parts, "")

    return F.when(token_test(text), let(values, fill)).otherwise(text)


def summary_stream(
    df: DataFrame, text: str = "text", types: Sequence[str] = TYPES
) -> DataFrame:
    """Running count per type; the state is one row per type. Use update or complete mode."""
    spans = detect_spans(df, [], text, types)
    return spans.groupBy("type").agg(F.count(F.lit(1)).alias("count"))
