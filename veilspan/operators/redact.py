"""Replacing spans by labels or restorable tokens, and putting labels back.

``overlap='cover'`` (the default) replaces united spans, so that no character of a detected
span survives. ``overlap='splice'`` replaces every span right to left at its own offsets,
which damages the text, and may leak part of it, where spans overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.arrays import blocks, let, piece, ranks, running
from veilspan.functions.patterns import TYPES
from veilspan.functions.tokens import as_session, entity_of, label_of, token_of
from veilspan.operators.detect import no_spans, prepared, with_spans
from veilspan.operators.spans import covered, merged, sorted_spans
from veilspan.operators.tables import computed


def _replayed(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """The splice from right to left at the original offsets, as a table of pieces.

    Left of the span in hand the text is still the original, so the splice puts its replacement
    before ``gap + rest`` less as many characters as the span is long, ``gap`` reaching to the
    next span's start. Read from left to right, a span leaves a debt of characters that the
    following pieces pay. A span turns the debt ``p`` into ``max(p - paid, least)``; such functions
    compose, so all debts are one running total.
    """

    def item(s: Column, stop: Column) -> Column:
        return F.struct(
            by(s).alias("put"),
            s["start"].alias("start"),
            stop.alias("stop"),
            (s["end"] - s["start"]).alias("length"),
        )

    def debt(x: Column) -> Column:
        gap = x["stop"] - x["start"]
        return F.struct(
            (F.length(x["put"]) - x["length"] + gap).cast("bigint").alias("paid"),
            F.greatest(x["length"] - gap, F.lit(0)).cast("bigint").alias("least"),
        )

    def then(x: Column, y: Column) -> Column:
        return F.struct(
            (x["paid"] + y["paid"]).alias("paid"),
            F.greatest(x["least"] - y["paid"], y["least"]).alias("least"),
        )

    def write(items: Column, debts: Column, cut: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            owed = F.greatest(-F.get(debts, i)["paid"], F.get(debts, i)["least"])
            at_most = F.least(owed, F.length(text).cast("bigint")).cast("int")

            def pay(p: Column) -> Column:
                skip = F.greatest(p - F.length(x["put"]), F.lit(0)) + x["length"]
                skip = F.least(skip, x["stop"] - x["start"])
                return F.concat(
                    F.substring(x["put"], p + 1, F.length(x["put"])),
                    piece(cut, x["start"] + skip, x["stop"]),
                )

            return let(at_most, pay)

        lead = piece(cut, F.lit(0), items[0]["start"])
        return F.concat(lead, F.array_join(F.transform(items, one), ""))

    def replay(ordered: Column) -> Column:
        items = F.transform(
            ordered,
            lambda s, i: item(s, F.coalesce(F.get(ordered, i + 1)["start"], F.length(text))),
        )
        none = F.struct(
            F.lit(0).cast("bigint").alias("paid"), F.lit(-(1 << 60)).cast("bigint").alias("least")
        )
        return let(
            items,
            lambda items: let(
                running(F.transform(items, debt), then, none),
                lambda debts: let(blocks(text), lambda cut: write(items, debts, cut)),
            ),
        )

    ordered = F.reverse(sorted_spans(spans, descending=True))
    return F.when(F.size(spans) > 0, let(ordered, replay)).otherwise(text)


def _spliced(text: Column, spans: Column, by: Callable[[Column], Column], overlap: str) -> Column:
    if overlap == "splice":
        return _replayed(text, spans, by)

    # Covering spans are in text order and disjoint.
    def join(cut: Column) -> Column:
        kept = F.transform(
            spans,
            lambda s, i: F.concat(
                piece(cut, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), s["start"]), by(s)
            ),
        )
        tail = piece(cut, F.element_at(spans, -1)["end"], F.length(text))
        return F.concat(F.array_join(kept, ""), tail)

    return F.when(F.size(spans) > 0, let(blocks(text), join)).otherwise(text)


def redactable(
    df: DataFrame,
    text: str = "text",
    types: Sequence[str] = TYPES,
    extra: str | None = None,
    overlap: str = "cover",
    strip: bool = True,
    spans: str = "spans",
) -> DataFrame:
    """Stripped text plus the spans to be replaced, in the order the mapping uses."""
    if overlap not in ("cover", "splice"):
        raise ValueError(f"overlap must be 'cover' or 'splice', not {overlap!r}")
    work = with_spans(prepared(df, text, strip), text, types, spans, marks=not strip)
    if extra is not None:
        work = work.withColumn(spans, _merged(spans, extra))
    return computed(work, **{spans: _covered(text, spans) if overlap == "cover" else F.col(spans)})


@lru_cache
def _merged(spans: str, extra: str) -> Column:
    return merged(F.col(spans), F.coalesce(F.col(extra), no_spans()))


@lru_cache
def _covered(text: str, spans: str) -> Column:
    return F.when(
        F.size(spans) > 1, let(blocks(F.col(text)), lambda cut: covered(F.col(spans), cut))
    ).otherwise(F.col(spans))


@lru_cache
def _hashed(text: str, spans: str, overlap: str, session: str | Column, secret: str) -> Column:
    who = as_session(session)
    return _spliced(
        F.col(text),
        F.col(spans),
        lambda s: token_of(who, entity_of(s["type"]), s["value"], secret),
        overlap,
    )


@lru_cache
def _labelled(text: str, spans: str, overlap: str) -> Column:
    return _spliced(F.col(text), F.col(spans), lambda s: label_of(s["type"]), overlap)


def redact(
    df: DataFrame,
    mode: str = "label",
    overlap: str = "cover",
    text: str = "text",
    spans: str = "spans",
    out: str | None = None,
    session: str | Column = "default",
    secret: str = "",
) -> DataFrame:
    """Replace the given spans of the given text; ``mode`` is ``'label'`` or ``'token'``."""
    if mode not in ("label", "token"):
        raise ValueError(f"mode must be 'label' or 'token', not {mode!r}")
    col = F.col(text)

    def by(s: Column) -> Column:
        if mode == "label":
            return label_of(s["type"])
        return token_of(as_session(session), entity_of(s["type"]), s["value"], secret)

    if overlap == "cover":
        result = let(
            let(blocks(col), lambda cut: covered(F.col(spans), cut)),
            lambda c: _spliced(col, c, by, overlap),
        )
    else:
        result = _spliced(col, F.col(spans), by, overlap)
    return computed(df, **{out or text: result})


def scrub_labels(
    df: DataFrame,
    text: str = "text",
    types: Sequence[str] = TYPES,
    extra: str | None = None,
    overlap: str = "cover",
    strip: bool = True,
    out: str | None = None,
) -> DataFrame:
    """Strip, detect and replace by labels in one narrow stage."""
    work = redactable(df, text, types, extra, overlap, strip, "_spans")
    done = _labelled(text, "_spans", overlap)
    return computed(work, **{out or text: done}).drop("_spans")


@lru_cache
def _mapping_entries(spans: str, by_start: bool) -> Column:
    """``array<struct<label, value>>``: each label with its first value."""
    rank = ranks(TYPES)
    keyed = F.sort_array(
        F.transform(
            spans,
            lambda s, i: F.struct(
                F.lit(0).alias("rank")
                if by_start
                else F.coalesce(F.try_element_at(rank, s["type"]), F.lit(len(TYPES))).alias("rank"),
                s["start"].alias("start"),
                i.alias("ord"),
                label_of(s["type"]).alias("label"),
                s["value"].alias("value"),
            ),
        )
    )

    def first_of_each(ordered: Column) -> Column:
        firsts = let(
            F.transform(ordered, lambda k: k["label"]),
            lambda labels: F.filter(
                ordered, lambda k, i: F.array_position(labels, k["label"]) == i + 1
            ),
        )
        return F.transform(
            firsts, lambda k: F.struct(k["label"].alias("label"), k["value"].alias("value"))
        )

    return let(keyed, first_of_each)


def scrub_with_mapping(
    df: DataFrame,
    text: str = "text",
    types: Sequence[str] = TYPES,
    extra: str | None = None,
    overlap: str = "cover",
    strip: bool = True,
    mapping: str = "mapping",
) -> DataFrame:
    """Scrub to labels and add the map label -> first value of that label in the text.

    Entries come in registry order, or in text order when extra spans were merged.
    """
    work = redactable(df, text, types, extra, overlap, strip, "_spans")
    entries = _mapping_entries("_spans", by_start=extra is not None)
    columns = {
        text: _labelled(text, "_spans", overlap),
        mapping: F.map_from_entries(entries),
    }
    return computed(work, **columns).drop("_spans")


def label_mapping(df: DataFrame, keys: Sequence[str], mapping: str = "mapping") -> DataFrame:
    """The mapping as rows ``keys, ord, label, value``."""
    return df.select(
        *keys,
        F.posexplode(F.map_entries(mapping)).alias("ord", "entry"),
    ).select(*keys, "ord", F.col("entry.key").alias("label"), F.col("entry.value").alias("value"))


def restore_labels(df: DataFrame, mapping: str = "mapping", text: str = "text") -> DataFrame:
    """Literal replacement of each label, in map order.

    A value that contains a later label is replaced again, and every occurrence of a label gets
    the same value, so this only approximates the original.
    """
    return df.withColumn(
        text,
        F.aggregate(
            F.map_entries(mapping),
            F.col(text),
            lambda t, e: F.replace(t, e["key"], e["value"]),
        ),
    )
