"""Finding tokens in texts and putting the originals back by joining the vault."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.arrays import let
from veilspan.functions.patterns import TOKEN
from veilspan.functions.text import stripped
from veilspan.functions.tokens import as_session
from veilspan.operators.detect import place, split_around
from veilspan.operators.lookup import HOT_ROWS, attach_values, hot_keys, join_unique
from veilspan.operators.tables import DENSE, computed, cut_lineage, discard


def token_test(text: Column) -> Column:
    """The plain substring test decides for most texts, without a regex."""
    return F.coalesce(text.contains("[REDACTED") & text.rlike(TOKEN), F.lit(False))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def has_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text holds a token."""
    return df.filter(token_test(F.col(text)))


def extract_tokens(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """``keys, ord, token, start, end`` for every token occurrence."""
    col = F.col(text)

    def found(parts: Column) -> Column:
        return place(
            parts,
            lambda token, start, end, ord: F.struct(
                ord.alias("ord"), token.alias("token"), start.alias("start"), end.alias("end")
            ),
        )

    return has_tokens(df, text).select(*keys, F.inline(let(split_around(col, TOKEN), found)))


def restore_tokens(
    df: DataFrame,
    vault: DataFrame,
    session: str | Column = "default",
    text: str = "text",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Replace each token the vault knows by its value; other tokens stay, and so do tokens
    with several values. Restored values are not scanned again.

    Texts without tokens pass through where they are; the others are written once, with a number.
    Their tokens meet the vault, and the texts the values.
    """
    col = F.col(text)
    columns = df.columns
    plain = df.filter(~token_test(col))
    row = "_row"
    while row in columns:
        row = f"_{row}"
    # Files hold no void columns; those are null in every row.
    void = {name: F.lit(None) for name, kind in df.dtypes if kind == "void"}
    hits = cut_lineage(
        has_tokens(df, text)
        .withColumns({"_session": as_session(session), row: F.monotonically_increasing_id()})
        .drop(*void),
        DENSE,
    )
    table = vault.select("session", F.col("token").alias("key"), "value")
    valued = attach_values(hits, _tokens(col), table, "_session", "_values", hot_rows, row)
    valued = valued.withColumns(void) if void else valued

    # Odd parts are the tokens, in the order of their values.
    values = F.col("_values")
    filled = F.array_join(
        F.transform(
            split_around(col, TOKEN),
            lambda part, i: F.when(
                i % 2 == 1, F.coalesce(F.get(values, F.shiftright(i, 1)), part)
            ).otherwise(part),
        ),
        "",
    )
    return plain.unionByName(computed(valued, **{text: filled}).select(*columns))


def unresolved_tokens(
    df: DataFrame,
    vault: DataFrame,
    keys: Sequence[str],
    session: str | Column = "default",
    text: str = "text",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``keys, session, token, occurrences, reason`` of the tokens a restore would leave.

    ``reason`` is ``unknown``, or ``ambiguous`` for a token with several values. The texts are
    read once; each distinct token meets the vault once, and only the unresolved ones are
    joined back and counted.
    """
    on = ["session", "token"]
    rows = has_tokens(df, text).select(
        *keys,
        as_session(session).alias("session"),
        F.explode(_tokens(F.col(text))).alias("token"),
    )
    uses = cut_lineage(rows, DENSE)
    distinct = cut_lineage(uses.groupBy(*on).agg(F.count(F.lit(1)).alias("uses")), DENSE)
    values = vault.select(*on, "value")
    known = (
        distinct.join(values, on, "left")
        .groupBy(*on, "uses")
        .agg(F.min("value").alias("value"), F.max("value").alias("other"))
    )
    bad = cut_lineage(
        known.filter(F.col("value").isNull() | (F.col("value") != F.col("other"))).select(
            *on,
            "uses",
            F.when(F.col("value").isNull(), "unknown").otherwise("ambiguous").alias("reason"),
        ),
        DENSE,
    )
    discard(distinct)
    most = bad.agg(F.max("uses")).first()[0] or 0
    hot = hot_keys(bad, on, "uses", hot_rows) if most > hot_rows else None
    left = join_unique(uses, bad.drop("uses"), on, "inner", hot, F.hash(*keys))
    return (
        left.groupBy(*keys, *on, "reason")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .select(*keys, *on, "occurrences", "reason")
    )


def round_trip_check(
    original: DataFrame, restored: DataFrame, keys: Sequence[str], text: str = "text"
) -> DataFrame:
    """Keys whose restored texts differ from the stripped originals, each once.

    Both sides are counted by key and digest, so null keys and null texts compare as equal, a
    lost row is reported, and a key that repeats must have the same texts as often. Only digests
    are shuffled, not the texts.
    """
    one = original.select(*keys, _digest(stripped(F.col(text))).alias("_digest"), F.lit(1).alias("_n"))
    other = restored.select(*keys, _digest(F.col(text)).alias("_digest"), F.lit(-1).alias("_n"))
    counted = one.union(other).groupBy(*keys, "_digest").agg(F.sum("_n").alias("_n"))
    return counted.filter("_n <> 0").select(*keys).distinct()


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))
