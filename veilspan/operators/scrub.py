"""Replacing spans by restorable tokens, with or without a vault."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.arrays import let
from veilspan.functions.patterns import TYPES
from veilspan.functions.tokens import as_session, entity_of, token_of
from veilspan.operators.lookup import HOT_ROWS, attach_values
from veilspan.operators.redact import _hashed, _spliced, redactable
from veilspan.operators.tables import DENSE, computed, cut_lineage, discard
from veilspan.operators.vault import VALUE_KEY, vault_entries

_WORK = ("_spans", "_session", "_row")
#: Up to so many values the vault is filtered by them before it is shuffled.
FEW = 100_000
#: If less than one in so many values has a token that is not its hash, their uses are chosen first.
SIFT = 4
#: Values of up to so many bytes are sent as they are, longer ones as a hash.
SHORT = 48


class IncompleteVault(ValueError):
    """The vault lacks a value that is to be replaced, or has two tokens for it."""


def _key(entity: Column, value: Column) -> Column:
    """Entity and value; a hash of 64 bytes stands for a longer value, which no shorter one equals."""
    short = F.octet_length(value) <= SHORT
    return F.concat_ws("|", entity, F.when(short, value).otherwise(F.sha2(value, 256)))


def found_spans(
    df: DataFrame,
    session: str | Column = "default",
    text: str = "text",
    types: Sequence[str] = TYPES,
    extra: str | None = None,
    overlap: str = "cover",
    strip: bool = True,
) -> DataFrame:
    """The rows of ``df``, stripped, with the spans that are to be replaced (``_spans``), the
    session of those that have some (``_session``) and a number (``_row``), written once.

    Everything that follows reads this table: the vault, the texts to replace and those to leave.
    So the detectors, a classifier behind ``extra`` and the source itself run once, and what they
    gave then holds for all of it, even if they would answer differently the next time.
    """
    work = redactable(df, text, types, extra, overlap, strip, "_spans")
    some = F.coalesce(F.size("_spans"), F.lit(0)) > 0
    who = F.when(some, as_session(session))
    return cut_lineage(
        work.withColumns({"_session": who, "_row": F.monotonically_increasing_id()}), DENSE
    )


def found_entries(found: DataFrame) -> DataFrame:
    """Distinct ``session, entity, value`` of a ``found_spans`` table, written once."""
    return cut_lineage(vault_entries(found, found=found), DENSE)


def scrub_tokens(
    df: DataFrame,
    session: str | Column = "default",
    secret: str = "",
    vault: DataFrame | None = None,
    text: str = "text",
    types: Sequence[str] = TYPES,
    extra: str | None = None,
    overlap: str = "cover",
    strip: bool = True,
    hot_rows: int = HOT_ROWS,
    found: DataFrame | None = None,
    entries: DataFrame | None = None,
) -> DataFrame:
    """Replace every span by its token.

    With a ``vault`` the tokens are the vault's. It must hold every value that is replaced
    (``build_vault``, ``scrub_to_vault``): a value it lacks raises ``IncompleteVault``, because
    its hash may be the token of somebody else's value. So does a value with two tokens. The
    texts are written once with their spans, the spans' distinct values meet the vault, and only
    tokens that are not the plain hash are joined back. No value and no token enters a plan.
    ``found`` is the ``found_spans`` table of ``df``, if the vault was made from one already, and
    ``entries`` its ``found_entries``.

    Without a vault the tokens are plain hashes. They keep equal values equal, but nothing can
    be restored from them safely: values whose hashes collide share a token.
    """
    if vault is None:
        if found is not None:
            raise ValueError("a table of found spans needs the vault that was made from it")
        work = redactable(df, text, types, extra, overlap, strip, "_spans")
        make = _hashed if isinstance(session, str) else _hashed.__wrapped__
        done = make(text, "_spans", overlap, session, secret)
        return computed(work, **{text: done}).drop("_spans")
    if entries is not None and found is None:
        raise ValueError("entries belong to a table of found spans")
    if found is None:
        found = found_spans(df, session, text, types, extra, overlap, strip)
    if entries is not None:
        return scrub_found(found, entries, vault, secret, text, overlap, hot_rows)
    entries = found_entries(found)
    done = scrub_found(found, entries, vault, secret, text, overlap, hot_rows)
    discard(entries)
    return done


def scrub_found(
    found: DataFrame,
    entries: DataFrame,
    vault: DataFrame,
    secret: str = "",
    text: str = "text",
    overlap: str = "cover",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``scrub_tokens`` of a ``found_spans`` table, whose ``found_entries`` are ``entries``."""
    # A large vault stays in place when the values are few enough to broadcast.
    near = vault
    values = entries.count()
    if values <= FEW:
        near = vault.join(entries, VALUE_KEY, "left_semi")
    known = (
        entries.join(near.select(*VALUE_KEY, "token"), VALUE_KEY, "left")
        .groupBy(*VALUE_KEY)
        .agg(F.min("token").alias("token"), F.max("token").alias("other"))
    )
    plain = token_of(F.col("session"), F.col("entity"), F.col("value"), secret)
    lacking, twice = F.col("token").isNull(), F.col("token") != F.col("other")
    odd = cut_lineage(
        known.filter(lacking | twice | (F.col("token") != plain)).select(
            "session",
            _key(F.col("entity"), F.col("value")).alias("key"),
            F.col("token").alias("value"),
            lacking.alias("lacking"),
            twice.alias("twice"),
        ),
        DENSE,
    )
    said = odd.agg(
        F.count_if("lacking").alias("lacking"), F.count_if("twice").alias("twice"), F.count("*").alias("all")
    ).first()
    if said["lacking"]:
        raise IncompleteVault("the vault lacks values of the texts; add them before scrubbing")
    if said["twice"]:
        raise IncompleteVault("the vault has two tokens for a value of the texts")
    if not said["all"]:
        discard(odd)
        hashed = _hashed.__wrapped__(text, "_spans", overlap, F.col("_session"), secret)
        return computed(found, **{text: hashed}).drop(*_WORK)

    # Texts without spans stay where they are; only those that hold a value with another token than
    # its hash meet those tokens.
    spans = F.col("_spans")
    some = F.coalesce(F.size(spans), F.lit(0)) > 0
    keyed = F.transform(spans, lambda s: _key(entity_of(s["type"]), s["value"]))
    with_tokens = attach_values(
        found.filter(some),
        keyed,
        odd.select("session", "key", "value"),
        "_session",
        "_tokens",
        hot_rows,
        sift=said["all"] < values / SIFT,
    )
    discard(odd)
    numbered = F.transform(
        spans,
        lambda s, i: F.struct(
            s["type"].alias("type"),
            s["value"].alias("value"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.coalesce(
                F.get(F.col("_tokens"), i),
                token_of(F.col("_session"), entity_of(s["type"]), s["value"], secret),
            ).alias("token"),
        ),
    )
    replaced = let(numbered, lambda n: _spliced(F.col(text), n, lambda s: s["token"], overlap))
    done = computed(with_tokens, **{text: replaced}).drop("_tokens")
    return found.filter(~some).unionByName(done).drop(*_WORK)
