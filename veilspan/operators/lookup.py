"""Looking up a list of keys per row in a large table, whatever the skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.operators.tables import DENSE, cut_lineage, discard

# Rows of one key that a single task may join; hotter keys are split over several tasks.
HOT_ROWS = 1_000_000
#: Bits by which rows are chosen before they are sent.
SLOTS = 1 << 24


def hot_keys(counted: DataFrame, on: list[str], rows: str, hot_rows: int) -> DataFrame:
    """Keys of ``counted`` with more than ``hot_rows`` rows, and how many ways to split each.

    Over all keys the rows add up to the table, so there are at most (table / hot_rows) of them:
    that is what makes them safe to broadcast.
    """
    return counted.filter(F.col(rows) > hot_rows).select(
        *on, F.ceil(F.col(rows) / hot_rows).cast("int").alias("_salts")
    )


def join_unique(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    hot: DataFrame | None,
    spread_by: Column,
) -> DataFrame:
    """Join a ``right`` side that is unique on ``on``; the left rows of each hot key are dealt
    out over several tasks by ``spread_by``, and its one right row is copied to each of them."""
    if hot is None:
        return left.join(right, on, how)
    hot = F.broadcast(hot)
    ways = F.coalesce("_salts", F.lit(1))
    dealt = left.join(hot, on, "left").withColumn("_salt", F.pmod(spread_by, ways)).drop("_salts")
    copied = (
        right.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), ways - 1)))
        .drop("_salts")
    )
    return dealt.join(copied, [*on, "_salt"], how).drop("_salt")


def attach_values(
    df: DataFrame,
    keys: Column,
    table: DataFrame,
    session: str,
    out: str,
    hot_rows: int = HOT_ROWS,
    row: str = "_row",
    sift: bool = False,
) -> DataFrame:
    """Add ``out``, the values of ``keys`` (an array of strings) in the same order.

    ``table`` has the columns ``session, key, value``; a key that is missing from it, or that
    has more than one value there, yields null, and ``out`` may end before nulls. ``df`` is a
    written table with a number of its own in each ``row``.

    Rows whose number's bit is not set in a broadcast bitmap hold no key of the table and stay
    where they are; only the others are sent to their values. With ``sift``, for a table that holds
    few of the keys, their uses are chosen by such a bitmap too.
    """
    number = F.col(row).alias("_row")
    uses = df.select(number, F.col(session).alias("session"), F.posexplode(keys).alias("pos", "key"))
    if sift:
        uses = cut_lineage(with_bit(uses, table, ["session", "key"]).filter("_bit").drop("_bit"), DENSE)
    values = values_by_row(uses, table, out, hot_rows).withColumnRenamed("_row", row)
    if sift:
        discard(uses)
    marked = with_bit(df, values, [row])
    here = marked.filter("_bit").join(values, row, "left")
    there = marked.filter("NOT _bit").withColumn(out, F.lit(None).cast(values.schema[out].dataType))
    return here.unionByName(there).select(*df.columns, out)


def values_by_row(uses: DataFrame, table: DataFrame, out: str, hot_rows: int) -> DataFrame:
    """``_row, out`` of the rows that use a key of the table, written once.

    ``uses`` has the columns ``_row, session, pos, key`` and is read twice. Each distinct key meets
    the table once; the values then go to the uses, and to the rows. Numbers are sent, not texts,
    and the shuffles go as each table is written. A key with more than ``hot_rows`` uses is split by
    a salt. Only the names of those keys travel by broadcast, and of them there are at most
    (uses / hot_rows).
    """
    on = ["session", "key"]
    distinct = cut_lineage(uses.groupBy(*on).agg(F.count(F.lit(1)).alias("uses")), DENSE)
    most = distinct.agg(F.max("uses")).first()[0] or 0
    hot = hot_keys(distinct, on, "uses", hot_rows) if most > hot_rows else None
    found = (
        table.select(*on, "value")
        .join(distinct.select(*on), on, "left_semi")
        .groupBy(*on)
        .agg(F.min("value").alias("value"), F.max("value").alias("other"))
        .filter(F.col("value") == F.col("other"))
        .drop("other")
    )
    # Positions without a value are no rows here; they are filled up again.
    gaps = F.transform(
        "pairs",
        lambda p, i: F.concat(
            F.array_repeat(
                F.lit(None).cast("string"),
                p["pos"] - F.coalesce(F.get("pairs", i - 1)["pos"], F.lit(-1)) - 1,
            ),
            F.array(p["value"]),
        ),
    )
    values = cut_lineage(
        join_unique(uses, found, on, "inner", hot, F.hash("_row", "pos"))
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("pairs"))
        .select("_row", F.flatten(gaps).alias(out)),
        DENSE,
    )
    discard(distinct)
    return values


def with_bit(df: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Add ``_bit``, false only in rows whose columns ``on`` are not among those of ``rows``.

    By one bit for each hash; the broadcast is at most 2^18 words."""
    slot = F.pmod(F.xxhash64(*on), F.lit(SLOTS))
    word = F.shiftright(slot, 6).cast("int").alias("_bit_word")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = rows.select(word, bit.alias("_one")).groupBy("_bit_word").agg(F.bit_or("_one").alias("_bits"))
    is_set = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    marked = df.withColumn("_bit_word", word).join(F.broadcast(words), "_bit_word", "left")
    return marked.select(*df.columns, is_set.alias("_bit"))
