"""Line deduplication: repeated runs of lines by a suffix array over line ids.

Every line that stands more than once gets a rank; ranks keep the order of the lines' digests.
Prefix doubling then ranks the runs of 2, 4, 8, ... lines that begin at each line, from pairs of
ranks: after k rounds the rank of a line is the place of its suffix in the suffix array, told
apart by 2^k lines. Lines with the same pair of ranks, one for the first and one for the last 2^k
lines of m, share a prefix of m lines: they are one interval of the suffix array whose longest
common prefix is m or more. Of each interval the first line in document order stays, and the
runs at the others are later copies.

A copy counts from ``min_words`` words on. It is enough to look at runs that lose this property
when their first or last line goes: a longer repeated run is the union of such runs, each of
which is repeated as well. Blank lines carry no words; they take no part and always stay.
Only DataFrame functions are used, and no group of lines is gathered anywhere: whatever is shared
by many documents is counted within each task first, or joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import cut_lineage

#: Words of a run from which on a later copy of it is deleted.
MIN_WORDS = 30
WORD = r"[^\x20\x09-\x0D]+"

DOC = ["doc_", "hash_"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the same id and text are one document; other rows that repeat an id are not."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_"), F.xxhash64(text).alias("hash_"), text.alias("text_"))


def _filled(lines: Column) -> Column:
    """Index and text of the lines that are not blank."""
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    return F.filter(numbered, lambda x: x["line"].rlike(WORD))


def _ranked(groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Ranks in the order of the keys: sorted by range, numbered through the ranges."""
    return cut_lineage(
        groups.select(*keys).sort(*keys).withColumn(name, F.monotonically_increasing_id())
    )


def repeated_stretches(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """Lines that stand more than once, in stretches of neighbours with enough words:
    doc_, hash_, stretch, seq (among the lines that are not blank), words, r0 (rank)."""
    rows = _keyed(docs, id_col, text_col)
    exploded = rows.select(*DOC, F.posexplode(_filled(F.split("text_", "\n"))).alias("seq", "x"))
    lines = cut_lineage(
        exploded.select(
            *DOC,
            "seq",
            F.unhex(F.sha2(F.col("x.line"), 256)).alias("digest"),
            F.regexp_count(F.col("x.line"), F.lit(WORD)).alias("words"),
        )
    )
    often = lines.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranks = _ranked(often, ["digest"], "r0")
    by_doc = Window.partitionBy(*DOC)
    active = (
        lines.join(ranks, "digest")
        .select(*DOC, "seq", "words", "r0")
        .repartition(*DOC)
        .withColumn("copy", F.row_number().over(Window.partitionBy(*DOC, "seq").orderBy("r0")))
        .filter("copy = 1")
        .withColumn("stretch", F.col("seq") - F.row_number().over(by_doc.orderBy("seq")))
        .withColumn("in_all", F.sum("words").over(Window.partitionBy(*DOC, "stretch")))
        .filter(F.col("in_all") >= min_words)
    )
    return cut_lineage(active.select(*DOC, "stretch", "seq", "words", "r0"))


def doubled(lines: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Add r1, r2, ... for runs of 2, 4, ... lines, up to ``most`` lines or until no run of that
    length is repeated; null where a run is not repeated or leaves its stretch."""
    level, ordered = 0, Window.partitionBy(*DOC, "stretch").orderBy("seq")
    while 2 ** (level + 1) <= most:
        rank, name = f"r{level}", f"r{level + 1}"
        pairs = lines.withColumn("right", F.lead(rank, 2**level).over(ordered))
        often = (
            pairs.filter(F.col(rank).isNotNull() & F.col("right").isNotNull())
            .groupBy(F.col(rank).alias("left_"), F.col("right").alias("right_"))
            .agg(F.count(F.lit(1)).alias("n"))
            .filter("n > 1")
        )
        ranks = _ranked(often, ["left_", "right_"], name)
        if ranks.isEmpty():
            break
        same = (F.col(rank) == F.col("left_")) & (F.col("right") == F.col("right_"))
        lines = cut_lineage(pairs.join(ranks, same, "left").drop("left_", "right_", "right"))
        level += 1
    return lines, level


def _runs(lines: DataFrame, min_words: int) -> DataFrame:
    """Start, and first and last possible end, of the shortest runs with enough words."""
    ordered = Window.partitionBy(*DOC, "stretch").orderBy("seq")
    near = Window.partitionBy(*DOC, "stretch").orderBy("before").rangeBetween(0, min_words - 1)
    whole = Window.partitionBy(*DOC, "stretch")
    return (
        lines.withColumn("upto", F.sum("words").over(ordered))
        .withColumn("before", F.col("upto") - F.col("words"))
        .withColumn("end_", F.max("seq").over(near))
        .withColumn("reached", F.max("upto").over(near) - F.col("before"))
        .withColumn("end_", F.when(F.col("reached") >= min_words, F.col("end_")))
        .withColumn("last_", F.max("seq").over(whole))
        .withColumn("next_", F.lead("end_").over(ordered))
        .filter("end_ IS NOT NULL")
        .withColumn("until_", F.greatest("end_", F.coalesce("next_", F.col("last_") + 1) - 1))
    )


def repeated_runs(
    docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Later copies: doc_, hash_, start, end (of lines that are not blank, both inside), and
    ``first``, the document and line where the same run stands first."""
    lines = repeated_stretches(docs, min_words, id_col, text_col)
    # Each line has a word, so no run of the shortest ones is longer than min_words lines.
    longest = _runs(lines, min_words).agg(F.max(F.col("until_") - F.col("seq") + 1)).first()[0]
    lines, level = doubled(lines, longest or 1)
    ordered = Window.partitionBy(*DOC, "stretch").orderBy("seq")
    for k in range(level + 1):
        ahead = F.collect_list(F.coalesce(f"r{k}", F.lit(-1))).over(ordered.rowsBetween(0, 2**k - 1))
        lines = lines.withColumn(f"a{k}", ahead)
    runs = _runs(lines, min_words).withColumn("end", F.explode(F.sequence("end_", "until_")))
    lines_in = F.col("end") - F.col("seq") + 1
    left, right = F.lit(-1), F.lit(-1)
    for k in range(level + 1):
        fits = (lines_in >= 2**k) & (lines_in < 2 ** (k + 1))
        left = F.when(fits, F.coalesce(f"r{k}", F.lit(-1))).otherwise(left)
        at = F.get(f"a{k}", (lines_in - 2**k).cast("int"))
        right = F.when(fits, F.coalesce(at, F.lit(-1))).otherwise(right)
    keys = ["m", "left", "right"]
    intervals = (
        runs.select(*DOC, "seq", "end", lines_in.alias("m"), left.alias("left"), right.alias("right"))
        .filter("left >= 0 AND right >= 0")
    )
    # A null id comes last in document order.
    place = F.struct(F.col("doc_").isNull().alias("no_id"), *DOC, "seq")
    first = cut_lineage(
        intervals.groupBy(*keys)
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    later = intervals.join(first, keys).filter(place != F.col("first"))
    return later.select(*DOC, F.col("seq").alias("start"), "end", "first")


def line_dedup(
    docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the later copies of repeated line runs cut out of the text, and with
    lines_removed, lines_left (both without blank lines) added.

    Columns of ``docs`` with these names are replaced. Documents count in the order of their ids (null last), then of their texts' hashes. Null and
    empty texts come back as they are. Rows that repeat an id and a text share what is removed
    from it. A run may overlap its own first copy, as in a line repeated at once.
    """
    docs = docs.drop("lines_removed", "lines_left")
    runs = repeated_runs(docs, min_words, id_col, text_col)
    gone = runs.groupBy(*DOC).agg(
        F.array_distinct(F.flatten(F.collect_set(F.sequence("start", "end")))).alias("__gone")
    ).select(F.col("doc_").alias("__gone_doc"), F.col("hash_").alias("__gone_hash"), "__gone")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("__hash", F.xxhash64(text))
    same = keyed[id_col].eqNullSafe(F.col("__gone_doc")) & (F.col("__hash") == F.col("__gone_hash"))
    lines = F.split(text, "\n")
    at = F.transform(_filled(lines), lambda x: x["at"])
    removed = F.transform("__gone", lambda i: F.get(at, i))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    cut = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    filled = F.size(F.filter(lines, lambda x: x.rlike(WORD)))
    n_gone = F.coalesce(F.size("__gone"), F.lit(0))
    new_text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(cut).alias(text_col)
    return keyed.join(gone, same, "left").select(
        *[new_text if c == text_col else F.col(c) for c in docs.columns],
        n_gone.alias("lines_removed"),
        (filled - n_gone).alias("lines_left"),
    )
