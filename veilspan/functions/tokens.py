"""Labels, entity tags and restorable tokens for span types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.arrays import lookup
from veilspan.functions.patterns import ENTITIES, LABELS, TOKEN_HEX


def label_of(kind: Column) -> Column:
    return lookup(LABELS, kind, F.concat(F.lit("["), F.upper(kind), F.lit("]")))


def entity_of(kind: Column) -> Column:
    return lookup(ENTITIES, kind, F.lower(kind))


def as_session(session: str | Column) -> Column:
    """The session of a row. A null one would match nothing in the vault, so it is an error."""
    if not isinstance(session, Column):
        return F.lit(session)
    return F.coalesce(session, F.raise_error(F.lit("the session of a text must not be null")))


def token_of(
    session: Column,
    entity: Column,
    value: Column,
    secret: str = "",
    attempt: Column | None = None,
) -> Column:
    """``[REDACTED_<ENTITY>_<8 hex>]`` from a keyed hash; ``attempt`` > 0 gives another token.

    The tag must be ASCII letters or the token could not be found again in a text.
    """
    plain = F.concat_ws("|", F.lit(secret), session, entity, value)
    keyed = (
        plain
        if attempt is None
        else F.when(attempt == 0, plain).otherwise(F.concat_ws("|", plain, attempt.cast("string")))
    )
    tag = F.when(entity.rlike("^[a-z]+$"), F.upper(entity)).otherwise(
        F.raise_error(F.concat(F.lit("entity must match [a-z]+: "), entity))
    )
    return F.concat(
        F.lit("[REDACTED_"), tag, F.lit("_"), F.left(F.sha2(keyed, 256), F.lit(TOKEN_HEX)), F.lit("]")
    )
