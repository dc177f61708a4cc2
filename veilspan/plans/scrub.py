"""Whole jobs: update the vault and scrub, with or without named entities."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from veilspan.functions.patterns import NER_ENABLED, TYPES
from veilspan.operators.entities import Tagger, entity_spans, tag_entities
from veilspan.operators.scrub import found_entries, found_spans, scrub_found, scrub_tokens
from veilspan.sources.vaults import add_entries


def scrub_to_vault(
    df: DataFrame,
    path: str,
    session: str | Column = "default",
    secret: str = "",
    text: str = "text",
    types: Sequence[str] = TYPES,
    extra: str | None = None,
    overlap: str = "cover",
    strip: bool = True,
) -> DataFrame:
    """Add the values of ``df`` to the vault at ``path``, then scrub ``df`` with its tokens.

    The spans are found once, in a table that both steps read. Of the vault only the buckets of
    the texts' sessions are read.
    """
    found = found_spans(df, session, text, types, extra, overlap, strip)
    entries = found_entries(found)
    vault = add_entries(df.sparkSession, entries, path, secret)
    return scrub_found(found, entries, vault, secret, text, overlap)


def with_entities(
    df: DataFrame,
    tagger: Callable[[], Tagger] | None,
    text: str = "text",
    types: Sequence[str] = NER_ENABLED,
    least: float | None = None,
) -> DataFrame:
    """Stripped texts with the spans of their named entities in ``extra`` and the tagger's
    error in ``ner_error``. All of it happens inside the row."""
    tagged = tag_entities(df, tagger, text)
    return entity_spans(tagged, "tokens", text, types, least).drop("tokens")


def scrub_with_ner(
    df: DataFrame,
    tagger: Callable[[], Tagger] | None,
    session: str | Column = "default",
    secret: str = "",
    vault: DataFrame | None = None,
    text: str = "text",
    entity_types: Sequence[str] = NER_ENABLED,
    least: float | None = None,
    overlap: str = "cover",
) -> DataFrame:
    """Patterns and named entities merged, then tokens. Without a tagger, patterns only.

    With a tagger the result carries ``ner_error``: a text it failed on was scrubbed by the
    patterns alone. ``vault`` must hold the values (see ``scrub_with_ner_to_vault``). With a vault
    the tagger runs once; without one the result is a plan that runs it at every action.
    """
    if tagger is None:
        return scrub_tokens(df, session, secret, vault, text, overlap=overlap)
    work = with_entities(df, tagger, text, entity_types, least)
    return scrub_tokens(
        work, session, secret, vault, text, extra="extra", overlap=overlap, strip=False
    ).drop("extra")


def scrub_with_ner_to_vault(
    df: DataFrame,
    tagger: Callable[[], Tagger] | None,
    path: str,
    session: str | Column = "default",
    secret: str = "",
    text: str = "text",
    entity_types: Sequence[str] = NER_ENABLED,
    least: float | None = None,
    overlap: str = "cover",
) -> DataFrame:
    """Tag once, add all values, those of the named entities too, to the vault at ``path``, and
    scrub with its tokens. The result carries ``ner_error`` as in ``scrub_with_ner``."""
    if tagger is None:
        return scrub_to_vault(df, path, session, secret, text, overlap=overlap)
    work = with_entities(df, tagger, text, entity_types, least)
    return scrub_to_vault(
        work, path, session, secret, text, extra="extra", overlap=overlap, strip=False
    ).drop("extra")
