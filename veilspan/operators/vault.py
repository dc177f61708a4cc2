"""The vault: which token stands for which value, unique within a session.

Eight hex digits per entity collide by chance from about 77,000 values on. The first value in
order keeps the plain hash; each other one is hashed again with an attempt counter until its
token is free. Values already in a vault always keep their token.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.patterns import TYPES
from veilspan.functions.tokens import as_session, entity_of, token_of
from veilspan.operators.redact import redactable
from veilspan.operators.tables import DENSE, cut_lineage, discard

VAULT_SCHEMA = (
    "session string, entity string, value string, token string, attempt int, version int"
)
VAULT_VERSION = 1
VALUE_KEY = ["session", "entity", "value"]
TOKEN_KEY = ["session", "token"]
_MAX_ROUNDS = 100


def vault_entries(
    df: DataFrame,
    session: str | Column = "default",
    text: str = "text",
    types: Sequence[str] = TYPES,
    extra: str | None = None,
    overlap: str = "cover",
    strip: bool = True,
    found: DataFrame | None = None,
) -> DataFrame:
    """Distinct ``session, entity, value`` of everything a scrub of ``df`` would replace.

    The distinct runs inside each task before it shuffles, so a value that fills a third of
    all texts still costs one row per task. With ``found``, the ``found_spans`` table of ``df``,
    its spans and sessions are taken, and no text is scanned again.
    """
    if found is not None:
        spans = found.select(F.col("_session").alias("session"), F.inline("_spans"))
        return span_entries(spans, F.col("session"))
    work = redactable(df, text, types, extra, overlap, strip, "_spans")
    return span_entries(
        work.select(as_session(session).alias("session"), F.inline("_spans")), F.col("session")
    )


def span_entries(spans: DataFrame, session: str | Column = "default") -> DataFrame:
    """The same from a span table; ``session`` is a name or an expression over the table."""
    return spans.select(
        as_session(session).alias("session"), entity_of(F.col("type")).alias("entity"), F.col("value")
    ).distinct()


def missing_entries(entries: DataFrame, vault: DataFrame) -> DataFrame:
    """Entries the vault does not hold. The usually larger vault is only filtered, so it stays
    in place when the entries are small enough to broadcast."""
    known = vault.select(*VALUE_KEY).join(entries.select(*VALUE_KEY), VALUE_KEY, "left_semi")
    return entries.join(known, VALUE_KEY, "left_anti")


def build_vault(
    entries: DataFrame,
    secret: str = "",
    existing: DataFrame | None = None,
    unique: bool = False,
) -> DataFrame:
    """Vault rows for the entries that ``existing`` does not hold yet.

    ``unique`` says that ``entries`` is a table without copies (``found_entries``), which need not
    be looked for again. One pass over the entries; further rounds touch only the colliding values, a share that
    shrinks with every round while the session's token space is not nearly full.
    """
    fresh = entries.select(*VALUE_KEY)
    fresh = fresh if unique else fresh.distinct()
    # Tables that nothing reads any more once the next round is written.
    spent: list[DataFrame] = []
    if existing is not None:
        if not unique:
            fresh = cut_lineage(fresh, DENSE)
            spent.append(fresh)
        fresh = missing_entries(fresh, existing)
    pending = fresh.withColumn("attempt", F.lit(0))
    held = [] if existing is None else [existing.select(*TOKEN_KEY)]
    settled: list[DataFrame] = []
    for _ in range(_MAX_ROUNDS):
        ranked = cut_lineage(_ranked(pending, held, secret), DENSE)
        discard(*spent)
        spent = []
        done = ranked.filter(~F.col("clash")).drop("clash")
        clashing = ranked.filter("clash")
        if clashing.isEmpty():
            result = done
            for part in settled:
                result = result.unionByName(part)
            return result
        if done.isEmpty():
            spent.append(ranked)
        else:
            settled.append(done)
            held.append(done.select(*TOKEN_KEY))
        pending = clashing.select(*VALUE_KEY, (F.col("attempt") + 1).alias("attempt"))
    raise RuntimeError(
        "the token space of a session is full; spread the texts over several sessions"
    )


def _ranked(pending: DataFrame, held: Sequence[DataFrame], secret: str) -> DataFrame:
    """Give each pending value its next token and mark those whose token is not free."""
    token = token_of(
        F.col("session"), F.col("entity"), F.col("value"), secret, F.col("attempt")
    )
    rows = pending.withColumn("token", token).withColumn("version", F.lit(VAULT_VERSION))
    order = Window.partitionBy(*TOKEN_KEY).orderBy("value", "entity")
    rows = rows.withColumn("rank", F.row_number().over(order))
    taken = None
    for tokens in held:
        used = tokens.join(rows.select(*TOKEN_KEY), TOKEN_KEY, "left_semi")
        taken = used if taken is None else taken.unionByName(used)
    if taken is None:
        clash = F.col("rank") > 1
    else:
        rows = rows.join(taken.distinct().withColumn("taken", F.lit(True)), TOKEN_KEY, "left")
        clash = (F.col("rank") > 1) | F.coalesce("taken", F.lit(False))
    return rows.select(*VALUE_KEY, "token", "attempt", "version", clash.alias("clash"))


def vault_collisions(vault: DataFrame) -> DataFrame:
    """Tokens that stand for more than one value, with the number of values."""
    return (
        vault.select(*TOKEN_KEY, "value")
        .distinct()
        .groupBy(*TOKEN_KEY)
        .agg(F.count(F.lit(1)).alias("values"))
        .filter(F.col("values") > 1)
    )
