"""Pattern detectors: from a text column to spans.

Every detector scans the text on its own, so spans of different types may overlap. Offsets
count code points, half open. All of it is one narrow stage over the text table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.arrays import let, running
from veilspan.functions.checks import is_card, is_ipv4
from veilspan.functions.patterns import CUT_AFTER, DIGIT_GATE, LED, TYPES, VALIDATED, java_pattern
from veilspan.functions.text import stripped
from veilspan.operators.tables import computed

SPANS = "array<struct<type:string,value:string,start:int,end:int>>"
_MARK = "\u2060"
_CHECKS = {"creditCard": is_card, "ipAddress": is_ipv4}


def no_spans() -> Column:
    return F.array().cast(SPANS)


def _matches(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(kind)), F.lit(2 if kind in LED else 0))


def gates(text: Column, kinds: Sequence[str]) -> dict[str, Column]:
    """Of each detector a cheap test that the texts it finds something in pass."""
    unknown = set(kinds) - set(TYPES)
    if unknown:
        raise ValueError(f"unknown detectors: {sorted(unknown)}")
    digits = text.rlike(DIGIT_GATE)
    return {k: text.contains("@") if k == "email" else digits for k in TYPES if k in kinds}


def gated(text: Column, kinds: Sequence[str], per_kind, nothing: Column) -> Column:
    """Concatenate ``per_kind(kind)`` arrays, scanning only where a cheap test allows it."""
    parts, tests = [], gates(text, kinds)
    if "email" in kinds:
        parts.append(F.when(tests["email"], per_kind("email")).otherwise(nothing))
    digits = [k for k in TYPES if k in kinds and k != "email"]
    if digits:
        found = F.concat(*[per_kind(k) for k in digits])
        parts.append(F.when(tests[digits[0]], found).otherwise(nothing))
    return F.when(text.isNull(), nothing).otherwise(F.concat(*parts))


def marked_parts(text: Column, pattern: str, led: bool = False) -> Column:
    """``split_around`` of a text that does not hold the mark."""
    put = f"$1{_MARK}$2{_MARK}" if led else f"{_MARK}$0{_MARK}"
    return F.split(F.regexp_replace(text, pattern, put), _MARK, -1)


def split_around(text: Column, pattern: str, led: bool = False) -> Column:
    """``[gap, match, gap, match, ..., gap]`` in one scan.

    The matches are set between marks and the text is cut there: splitting on one plain
    character needs no regex. Stripped texts never hold the mark; for one that does, matches
    and gaps are found by scans of their own. With ``led`` the pattern's group 2 is the match,
    and group 1 before it belongs to the gap.
    """
    marked = marked_parts(text, pattern, led)
    gaps = F.split(text, pattern, -1)
    if led:
        lead = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        gaps = F.zip_with(gaps, lead, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit(""))))
    twice = F.flatten(
        F.zip_with(
            gaps,
            F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if led else 0)),
            lambda gap, match: F.when(match.isNull(), F.array(gap)).otherwise(F.array(gap, match)),
        )
    )
    return F.when(text.contains(_MARK), twice).otherwise(marked)


def place(parts: Column, span: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """``span(value, start, end, ord)`` for each match in ``split_around``'s result."""
    first = F.length(parts[0])
    single = F.array(span(parts[1], first, first + F.length(parts[1]), F.lit(0)))
    several = let(
        running(F.transform(parts, F.length), lambda a, b: a + b),
        lambda before: F.transform(
            F.sequence(F.lit(0), F.shiftright(F.size(parts) - 3, 1)),
            lambda j: span(
                F.get(parts, 2 * j + 1), F.get(before, 2 * j + 1), F.get(before, 2 * j + 2), j
            ),
        ),
    )
    return F.when(F.size(parts) == 3, single).otherwise(several)


def match_values(text: Column, kind: str) -> Column:
    """Values of one detector in text order, after its check."""
    return checked_values(_matches(text, kind), kind)


def checked_values(found: Column, kind: str) -> Column:
    return F.filter(found, _CHECKS[kind]) if kind in VALIDATED else found


def scan_columns(kinds: Sequence[str]) -> dict[str, str]:
    return {kind: f"_veilspan_{kind}" for kind in TYPES if kind in kinds}


@lru_cache
def _scans(text: str, kinds: tuple[str, ...], marks: bool) -> dict[str, Column]:
    """Columns do not change, and building them takes many calls into the JVM, which every
    micro-batch would repeat."""
    col, cut = F.col(text), split_around if marks else marked_parts
    names = scan_columns(kinds)
    return {
        names[kind]: F.when(gate, cut(col, java_pattern(kind), kind in LED))
        for kind, gate in gates(col, kinds).items()
    }


@lru_cache
def _placed_scans(kinds: tuple[str, ...], checked: bool) -> Column:
    def located(kind: str, name: str) -> Column:
        parts, check = F.col(name), _CHECKS.get(kind) if checked else None

        def span(value: Column, start: Column, end: Column) -> Column:
            return F.struct(
                F.lit(kind).alias("type"),
                value.alias("value"),
                start.alias("start"),
                end.alias("end"),
            )

        value, first = F.get(parts, F.lit(1)), F.length(F.get(parts, F.lit(0)))
        one = F.array(span(value, first, first + F.length(value))).cast(SPANS)
        several = place(parts, lambda value, start, end, _: span(value, start, end)).cast(SPANS)
        if check:
            one = F.when(check(value), one).otherwise(no_spans())
            several = F.filter(several, lambda s: check(s["value"]))
        some = F.coalesce(F.size(parts), F.lit(0))
        return F.when(some == 3, one).when(some > 3, several).otherwise(no_spans())

    found = [located(kind, name) for kind, name in scan_columns(kinds).items()]
    return F.concat(*found) if found else no_spans()


def with_spans(
    df: DataFrame,
    text: str,
    kinds: Sequence[str] = TYPES,
    out: str = "spans",
    checked: bool = True,
    marks: bool = True,
) -> DataFrame:
    """Add the spans of the given detectors in registry order, then position.

    A match starts after all gaps and matches before it. A match that fails its check still
    uses up its characters. The scans are columns of their own, and a detector's only match is
    placed without a lambda: Spark compiles both, but interprets whatever stands inside or around
    a lambda. ``marks`` tells that a text may hold the mark, which stripped ones do not.
    """
    kinds = tuple(kinds)
    scanned = df.withColumns(_scans(text, kinds, marks))
    return scanned.withColumn(out, _placed_scans(kinds, checked)).drop(
        *scan_columns(kinds).values()
    )


def with_matches(df: DataFrame, text: str, kinds: Sequence[str] = TYPES) -> DataFrame:
    """Add the matches of each detector, before its check, as columns (``scan_columns``)."""
    col, names = F.col(text), scan_columns(kinds)
    return df.withColumns(
        {names[k]: F.when(gate, _matches(col, k)) for k, gate in gates(col, kinds).items()}
    )


def _rows_of(df: DataFrame, keys: Sequence[str], spans: str) -> DataFrame:
    """The spans as rows. From a projection's column a filter on its size would be inferred, which
    is pushed below the scans and repeats them."""
    return computed(df, **{spans: F.col(spans)}).select(*keys, F.inline(spans))


@lru_cache
def text_counts(text: str, kinds: tuple[str, ...] = TYPES) -> Column:
    """``array<struct<type, count>>`` of the detectors that found something; no positions."""
    col = F.col(text)
    nothing = F.array().cast("array<struct<type:string,count:bigint>>")

    def one(kind: str) -> Column:
        return F.array(
            F.struct(
                F.lit(kind).alias("type"),
                F.size(match_values(col, kind)).cast("bigint").alias("count"),
            )
        )

    return F.filter(gated(col, kinds, one, nothing), lambda c: c["count"] > 0)


def holds_pii(text: Column, kinds: Sequence[str] = TYPES) -> Column:
    """Whether any detector matches, stopping at the first that does."""

    def one(kind: str) -> Column:
        if kind in VALIDATED:
            return F.size(match_values(text, kind)) > 0
        return text.rlike(java_pattern(kind))

    tests = []
    if "email" in kinds:
        tests.append(text.contains("@") & one("email"))
    digits = [k for k in TYPES if k in kinds and k != "email"]
    if digits:
        any_digit = one(digits[0])
        for kind in digits[1:]:
            any_digit = any_digit | one(kind)
        tests.append(text.rlike(DIGIT_GATE) & any_digit)
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return F.coalesce(result, F.lit(False))


def prepared(df: DataFrame, text: str, strip: bool) -> DataFrame:
    return df.withColumn(text, stripped(F.col(text))) if strip else df


def detect(
    df: DataFrame,
    text: str = "text",
    types: Sequence[str] = TYPES,
    out: str = "spans",
    strip: bool = True,
) -> DataFrame:
    """Add the span array. With ``strip`` the text column becomes the stripped text, which is
    what the offsets refer to."""
    found = with_spans(prepared(df, text, strip), text, types, "_found", marks=not strip)
    return computed(found, **{out: F.col("_found")}).drop("_found")


def detect_spans(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    types: Sequence[str] = TYPES,
    strip: bool = True,
) -> DataFrame:
    """Span table ``keys, type, value, start, end``, one row per match."""
    found = with_spans(prepared(df, text, strip), text, types, "_found", marks=not strip)
    return _rows_of(found, keys, "_found")


def detect_spans_cut(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    types: Sequence[str] = TYPES,
    strip: bool = True,
    size: int = 1 << 20,
) -> DataFrame:
    """``detect_spans`` for tables with very long texts, with the same rows.

    Texts of more than ``size`` characters are cut where no match can be, at the first such place
    after every ``size`` characters, and the pieces go to many tasks; what comes before a cut
    cannot change what is found behind it. Shorter texts stay where they are. A stretch without
    such a place, one word without blanks for instance, stays in one piece.
    """
    work = prepared(df, text, strip).select(*keys, F.col(text).alias("_text"))
    is_long = F.length("_text") > size

    def spans_in(part: DataFrame, keys: list[str]) -> DataFrame:
        return _rows_of(with_spans(part, "_text", types, "_found", marks=not strip), keys, "_found")

    short = spans_in(work.filter(~is_long), [*keys])
    cuts = F.regexp_extract_all(
        F.col("_text"), F.lit(rf"(?s).{{{size}}}.*?{CUT_AFTER}|(?s).+"), F.lit(0)
    )

    def placed(pieces: Column) -> Column:
        return let(
            running(F.transform(pieces, F.length), lambda a, b: a + b),
            lambda before: F.transform(
                pieces, lambda p, i: F.struct(F.get(before, i).alias("_at"), p.alias("_text"))
            ),
        )

    pieces = work.filter(is_long).select(*keys, F.inline(let(cuts, placed)))
    spread = pieces.repartition(*keys, "_at")
    found = spans_in(spread, [*keys, "_at"])
    return short.unionByName(
        found.select(
            *keys,
            "type",
            "value",
            (F.col("start") + F.col("_at")).alias("start"),
            (F.col("end") + F.col("_at")).alias("end"),
        )
    )


def candidate_spans(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    types: Sequence[str] = VALIDATED,
    strip: bool = True,
) -> DataFrame:
    """Span table before the card and address checks."""
    found = with_spans(
        prepared(df, text, strip), text, types, "_found", checked=False, marks=not strip
    )
    return _rows_of(found, keys, "_found")


def valid_cards(spans: DataFrame, value: str = "value") -> DataFrame:
    return spans.filter(is_card(F.col(value)))


def valid_ipv4(spans: DataFrame, value: str = "value") -> DataFrame:
    return spans.filter(is_ipv4(F.col(value)))


def has_pii(
    df: DataFrame, text: str = "text", types: Sequence[str] = TYPES, strip: bool = True
) -> DataFrame:
    """The rows whose text holds any match; the text itself is returned unchanged."""
    source = stripped(F.col(text)) if strip else F.col(text)
    return df.filter(let(source, lambda t: holds_pii(t, types)))
