"""Span algebra inside one row: ordering, merging and covering.

A row holds the spans of one text, so its size is bounded by that text. Everything here is
sort-based; no step compares all pairs of spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.arrays import blocks, let, piece, ranks, running
from veilspan.functions.patterns import LABELS
from veilspan.operators.detect import SPANS, no_spans


def overlaps(a: Column, b: Column) -> Column:
    """Whether two non-empty half-open spans share a character."""
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def sorted_spans(spans: Column, descending: bool = False) -> Column:
    """Stable order by start. Start and place are one number, which sorts faster than a struct."""
    start = F.transform(spans, lambda s: (-s["start"] if descending else s["start"]).cast("bigint"))
    keys = F.sort_array(F.transform(start, lambda at, i: at * F.lit(1 << 32) + i))
    return let(
        spans,
        lambda spans: F.transform(
            keys, lambda k: F.get(spans, k.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
        ),
    )


def _reach(spans: Column) -> Column:
    """Exclusive running maximum of the ends."""
    return running(F.transform(spans, lambda s: s["end"]), F.greatest)


def _by_place(spans: Column) -> Column:
    """``array<struct<start, end, ord, span>>`` by start, empty spans before others, then by order.

    In this order a span shares a character with exactly those later ones that start before its
    end.
    """
    return F.sort_array(
        F.transform(
            spans,
            lambda s, i: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), i.alias("ord"), s.alias("span")
            ),
        )
    )


def _stops(ordered: Column) -> Column:
    """For each item of ``_by_place`` the number of items that start before its end: it overlaps
    the items from itself up to there. One sweep over the sorted end points."""

    def events(pos: str, opens: int) -> Column:
        return F.transform(
            ordered,
            lambda s, i: F.struct(s[pos].alias("pos"), F.lit(opens).alias("opens"), i.alias("i")),
        )

    def counted(sweep: Column, before: Column) -> Column:
        ends = F.filter(
            F.transform(
                sweep,
                lambda e, j: F.struct(
                    e["i"].alias("i"), F.get(before, j).alias("n"), e["opens"].alias("opens")
                ),
            ),
            lambda e: e["opens"] == 0,
        )
        return F.transform(F.sort_array(ends), lambda e: F.greatest(e["n"], e["i"] + 1))

    return let(
        F.sort_array(F.concat(events("start", 1), events("end", 0))),
        lambda sweep: let(
            running(F.transform(sweep, lambda e: e["opens"]), lambda x, y: x + y),
            lambda before: counted(sweep, before),
        ),
    )


def overlapping_pairs(spans: Column) -> Column:
    """``array<struct<span, other>>``: every two spans that share a character, once, the one that
    starts first as ``span``. The work grows with the spans and the pairs found."""

    def paired(ordered: Column, stops: Column) -> Column:
        return F.flatten(
            F.transform(
                ordered,
                lambda s, i: F.transform(
                    F.slice(ordered, i + 2, F.get(stops, i) - i - 1),
                    lambda o: F.struct(s["span"].alias("span"), o["span"].alias("other")),
                ),
            )
        )

    def pairs(ordered: Column) -> Column:
        # Each clear of the one before it: then clear of all before it.
        meet = F.exists(
            F.transform(ordered, lambda s, i: s["start"] < F.get(ordered, i - 1)["end"]),
            lambda meets: F.coalesce(meets, F.lit(False)),
        )
        found = let(_stops(ordered), lambda stops: paired(ordered, stops))
        return F.when(meet, found).otherwise(F.slice(found, F.lit(1), F.lit(0)))

    return let(_by_place(spans), pairs)


def overlapped(spans: Column) -> Column:
    """The spans, in their order, that share a character with a span of another type.

    One sweep: at a span's end the furthest reach of all spans that started before is known, with
    its type, and the furthest reach of the other types.
    """

    def event(s: Column, i: Column, opens: int) -> Column:
        none = F.lit(-1)
        return F.struct(
            (s["start"] if opens else s["end"]).alias("pos"),
            F.lit(opens).alias("opens"),
            i.alias("ord"),
            s.alias("span"),
            F.struct(
                (s["end"] if opens else none).alias("far"),
                (s["type"] if opens else F.lit("")).alias("type"),
                none.alias("other"),
            ).alias("reach"),
        )

    def further(x: Column, y: Column) -> Column:
        same = x["type"].eqNullSafe(y["type"])
        ahead = x["far"] >= y["far"]
        return F.struct(
            F.greatest(x["far"], y["far"]).alias("far"),
            F.when(ahead, x["type"]).otherwise(y["type"]).alias("type"),
            F.when(same, F.greatest(x["other"], y["other"]))
            .when(ahead, F.greatest(y["far"], x["other"]))
            .otherwise(F.greatest(x["far"], y["other"]))
            .alias("other"),
        )

    def hits(sweep: Column, reach: Column) -> Column:
        def hit(e: Column, i: Column) -> Column:
            best = F.get(reach, i)
            far = F.when(best["type"].eqNullSafe(e["span"]["type"]), best["other"])
            return (e["opens"] == 0) & (far.otherwise(best["far"]) > e["span"]["start"])

        found = F.transform(
            F.filter(sweep, hit),
            lambda e: F.struct(e["ord"].alias("ord"), e["span"].alias("span")),
        )
        return F.transform(F.sort_array(found), lambda e: e["span"])

    nothing = F.struct(F.lit(-1).alias("far"), F.lit("").alias("type"), F.lit(-1).alias("other"))
    events = F.concat(
        F.transform(spans, lambda s, i: event(s, i, 1)),
        F.transform(spans, lambda s, i: event(s, i, 0)),
    )
    swept = let(
        F.sort_array(events),
        lambda sweep: let(
            running(F.transform(sweep, lambda e: e["reach"]), further, nothing),
            lambda reach: hits(sweep, reach),
        ),
    )
    return F.when(F.size(spans) > 1, swept).otherwise(no_spans())


def _greedy(extra: Column) -> Column:
    """Extra spans, each kept unless it overlaps one that comes earlier in the array and is kept.

    Two spans overlap exactly when the ranks they take up do (``_stops``). The ranks taken lie in
    about sqrt(n) chunks, so a step looks into the chunks of its span up to the first hit. A range
    is one number, ``lo * 2^32 + hi``: every step copies the state, and numbers are cheap to copy.
    """
    low = (1 << 32) - 1

    def fold(ordered: Column, stops: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(ordered))).cast("int")

        def chunked(width: Column) -> Column:
            claims = F.sort_array(
                F.transform(
                    ordered,
                    lambda s, i: F.struct(
                        s["ord"].alias("ord"),
                        i.alias("lo"),
                        F.get(stops, i).alias("hi"),
                        F.floor(i / width).cast("int").alias("first"),
                        F.floor((F.get(stops, i) - 1) / width).cast("int").alias("last"),
                    ),
                )
            )

            def step(chunks: Column, c: Column) -> Column:
                hit = F.exists(
                    F.slice(chunks, c["first"] + 1, c["last"] - c["first"] + 1),
                    lambda chunk: F.exists(
                        chunk,
                        lambda k: (F.shiftright(k, 32) < c["hi"])
                        & (c["lo"] < k.bitwiseAND(F.lit(low))),
                    ),
                )
                claim = c["lo"].cast("bigint") * F.lit(1 << 32) + c["hi"]
                return F.when(hit, chunks).otherwise(
                    F.transform(
                        chunks,
                        lambda chunk, j: F.when(
                            j.between(c["first"], c["last"]), F.array_append(chunk, claim)
                        ).otherwise(chunk),
                    )
                )

            empty = F.transform(
                F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / width).cast("int")),
                lambda _: F.array().cast("array<bigint>"),
            )
            ranges = F.array_distinct(F.flatten(F.aggregate(claims, empty, step)))
            return F.transform(ranges, lambda k: F.shiftright(k, 32).cast("int"))

        kept = let(width, chunked)
        return F.transform(kept, lambda lo: F.get(ordered, lo)["span"])

    def pick(ordered: Column) -> Column:
        disjoint = let(
            _reach(ordered),
            lambda reach: F.forall(
                F.zip_with(
                    ordered,
                    F.slice(reach, F.lit(1), F.size(ordered)),
                    lambda s, r: s["start"] >= r,
                ),
                lambda ok: ok,
            ),
        )
        return F.when(disjoint, extra).otherwise(
            let(_stops(ordered), lambda stops: fold(ordered, stops))
        )

    return let(_by_place(extra), pick)


def merged(base: Column, extra: Column) -> Column:
    """``base`` plus each extra span that overlaps nothing kept so far, sorted by start.

    An extra overlaps the base when some base span that starts before the extra's end reaches
    past its start. With base spans placed at their start and extras at their end, that is a
    running maximum in one sorted sequence.
    """

    def free(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["reach"]), F.greatest)
        kept = let(
            reach,
            lambda r: F.filter(
                events, lambda e, i: (e["kind"] == 0) & (F.get(r, i) <= e["span"]["start"])
            ),
        )
        in_order = F.sort_array(
            F.transform(kept, lambda e: F.struct(e["ord"].alias("ord"), e["span"].alias("span")))
        )
        return F.transform(in_order, lambda e: e["span"])

    def event(s: Column, i: Column, kind: int) -> Column:
        return F.struct(
            (s["start"] if kind else s["end"]).alias("pos"),
            F.lit(kind).alias("kind"),
            (s["end"] if kind else F.lit(0)).alias("reach"),
            i.alias("ord"),
            s.alias("span"),
        )

    events = F.sort_array(
        F.concat(
            F.transform(base, lambda s, i: event(s, i, 1)),
            F.transform(extra, lambda s, i: event(s, i, 0)),
        )
    )
    some = let(let(events, free), lambda f: sorted_spans(F.concat(base, let(f, _greedy))))
    return F.when(F.coalesce(F.size(extra), F.lit(0)) <= 0, sorted_spans(base)).otherwise(some)


def covered(spans: Column, cut: Column) -> Column:
    """Overlapping spans united into one; ``cut`` is the text as ``blocks``.

    The type is that of the longest member, ties by registry order. A span opens a new group
    when it starts at or after the end of everything before it.
    """
    rank = ranks(LABELS)

    def best(members: Column) -> Column:
        return F.array_min(
            F.transform(
                members,
                lambda m: F.struct(
                    (m["start"] - m["end"]).alias("length"),
                    F.coalesce(F.try_element_at(rank, m["type"]), F.lit(len(LABELS))).alias("rank"),
                    m["type"].alias("type"),
                ),
            )
        )["type"]

    def unite(ordered: Column, reach: Column) -> Column:
        heads = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i)["start"] >= F.get(reach, i)),
        )

        def group(heads: Column) -> Column:
            def one(head: Column, j: Column) -> Column:
                stop = F.coalesce(F.get(heads, j + 1), F.size(ordered))
                first = F.get(ordered, head)
                joined = F.struct(
                    best(F.slice(ordered, head + 1, stop - head)).alias("type"),
                    piece(cut, first["start"], F.get(reach, stop)).alias("value"),
                    first["start"].alias("start"),
                    F.get(reach, stop).alias("end"),
                )
                return F.when(stop - head == 1, first).otherwise(joined)

            return F.transform(heads, one)

        return let(heads, group)

    # By start, so spans that are clear of the one before them are clear of all before them.
    def cover(ordered: Column) -> Column:
        some = F.exists(
            F.transform(ordered, lambda s, i: s["start"] < F.get(ordered, i - 1)["end"]),
            lambda meets: F.coalesce(meets, F.lit(False)),
        )
        united = let(_reach(ordered), lambda reach: unite(ordered, reach))
        return F.when(some, united).otherwise(ordered)

    return F.when(F.size(spans) > 0, let(sorted_spans(spans), cover)).otherwise(spans)


def sort_spans(df: DataFrame, spans: str = "spans", descending: bool = False) -> DataFrame:
    return df.withColumn(spans, sorted_spans(F.col(spans), descending))


def merge_spans(
    df: DataFrame, spans: str = "spans", extra: str = "extra", out: str = "spans"
) -> DataFrame:
    """Merge two span arrays of the same row; the first one has precedence."""
    return df.withColumn(out, merged(F.col(spans), F.col(extra)))


def merge_span_tables(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """The same merge for two span tables; ``extra`` carries its order in ``ord``.

    Both sides go through one shuffle on the keys. A group holds the spans of one text.
    """
    span = F.struct("type", "value", "start", "end")
    rows = base.select(
        *keys, F.lit(True).alias("is_base"), F.col("start").alias("ord"), span.alias("span")
    ).unionByName(
        extra.select(*keys, F.lit(False).alias("is_base"), F.col("ord"), span.alias("span"))
    )
    item = F.struct("ord", "span")
    grouped = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("is_base"), item))).alias("base"),
        F.sort_array(F.collect_list(F.when(~F.col("is_base"), item))).alias("extra"),
    )
    plain = [
        F.transform(c, lambda x: x["span"]).cast(SPANS).alias(c) for c in ("base", "extra")
    ]
    return grouped.select(*keys, *plain).select(
        *keys, F.inline(merged(F.col("base"), F.col("extra")))
    )


def cover_spans(df: DataFrame, spans: str = "spans", text: str = "text") -> DataFrame:
    return df.withColumn(
        spans, let(blocks(F.col(text)), lambda cut: covered(F.col(spans), cut))
    )


def span_overlaps(df: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """``keys, type, value, start, end`` of the spans that overlap a span of another type."""
    return df.select(*keys, F.inline(overlapped(F.col(spans))))


def span_pairs(df: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """One row for every two overlapping spans of a text: ``keys, type, start, end`` of the one
    that starts first (ties: ends first, then stands first) and ``other_type, other_start,
    other_end``."""
    return df.select(*keys, F.inline(overlapping_pairs(F.col(spans)))).select(
        *keys,
        *[F.col("span")[c].alias(c) for c in ("type", "start", "end")],
        *[F.col("other")[c].alias(f"other_{c}") for c in ("type", "start", "end")],
    )
