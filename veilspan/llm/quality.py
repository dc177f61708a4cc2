"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A text is rejected when any rule fails it, so the order of the rules never changes the verdict, only
its price. What each rule costs and whom it rejects is estimated on a sample; then the rule with the
most rejections per cost among the rows that are still left comes first, and so on. A rule behind
another one is evaluated only for the rows that passed it.

Everything happens inside the row: words and lines stay where the text is, nothing is shuffled.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.arrays import let
from veilspan.llm.common import cut_lineage
from veilspan.operators.tables import computed

#: White space is a blank and these; a word is anything else.
WHITE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A whole word without a letter.
LETTERLESS = r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"
#: Words of a window.
WINDOW = 8
#: Rows that the costs are estimated on. Only the order of the rules depends on them.
SAMPLE = 2_000
#: A rule takes so many seconds at least: less cannot be told from noise.
LEAST_SECONDS = 0.002

#: Columns that are made on the way and not returned.
WORKING = ("quality_words", "quality_facts", "quality_windows", "quality_lines", "quality_failed")
#: Facts that a rule may read: all of them are columns before the cascade starts.
FACTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails(text, words, fact)`` is true for a text to reject; ``fact[name]`` is a column of
    ``FACTS``. A null text comes as an empty one, and a null answer lets the text pass."""

    name: str
    fails: Callable[[Column, Column, dict[str, Column]], Column]


@dataclass(frozen=True)
class Estimate:
    """Seconds a rule took for the sample, and how many of its rows it rejects on its own."""

    rule: Rule
    seconds: float
    rejects: int


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _matching(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _adjacent(words: Column) -> Column:
    """Words that equal the one before them."""
    return F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))


#: Words are few, or too many of them belong to repeated windows.
BASE = (
    Rule("few_words", lambda text, words, f: f["n_words"] < 20),
    Rule("repeated_words", lambda text, words, f: 100 * f["n_repeat_words"] > 30 * f["n_words"]),
)
#: The shares are per cent of words, lines or letters.
RULES = (
    *BASE,
    Rule("symbols", lambda text, words, f: 100 * f["n_symbols"] > 10 * f["n_words"]),
    Rule(
        "word_length",
        lambda text, words, f: (f["word_chars"] < 3 * f["n_words"])
        | (f["word_chars"] > 12 * f["n_words"]),
    ),
    Rule("repeated_lines", lambda text, words, f: 100 * f["n_dup_lines"] > 40 * f["n_lines"]),
    Rule("exclamations", lambda text, words, f: 100 * _removed(text, "!?") > 50 * f["n_words"]),
    Rule(
        "capitals",
        lambda text, words, f: 100 * _matching(text, r"\p{Lu}") > 50 * f["word_chars"],
    ),
    Rule(
        "letterless_words",
        lambda text, words, f: 100 * F.regexp_count(text, F.lit(LETTERLESS)) > 20 * f["n_words"],
    ),
    Rule("stutter", lambda text, words, f: 100 * _adjacent(words) > 20 * f["n_words"]),
)


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of a text; no windows where none can be repeated."""

    def combined(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW),
            lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WINDOW)]),
        )

    none = F.array().cast("array<bigint>")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, let(hashed, combined)).otherwise(none)


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside windows that the text holds twice or more, the first of them included.

    Only texts in which a hash comes up twice are looked at. There the windows are sorted by it
    and a second hash, so that equal ones are neighbours, and what the repeated ones cover is
    added up in text order.
    """
    windows = F.sort_array(
        F.transform(
            hashes,
            lambda h, i: F.struct(
                h.alias("h"),
                F.xxhash64(F.slice(words, i + 1, F.lit(WINDOW))).alias("g"),
                i.alias("i"),
            ),
        )
    )

    def repeated(ordered: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            y = F.get(ordered, j)
            return F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False))

        return F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1))

    at = F.sort_array(F.transform(let(windows, repeated), lambda x: x["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda acc, i: F.struct(
            (i + WINDOW).alias("end"),
            (acc["total"] + WINDOW - F.greatest(F.lit(0), acc["end"] - i)).alias("total"),
        ),
    )["total"]
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(0)


def with_facts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``quality_words`` (the array) and the struct ``quality_facts`` of ``FACTS``.

    Each array is a column of its own on the way, so that it is made once and that what counts
    its different elements is compiled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words, windows, lines = F.col("quality_words"), F.col("quality_windows"), F.col("quality_lines")
    filled = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    split = computed(
        docs,
        quality_words=F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        quality_lines=filled,
    )
    hashed = computed(split, quality_windows=_window_hashes(words))
    facts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate(text, WHITE, "")),
        "n_symbols": _removed(text, SYMBOLS),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(words, windows),
    }
    found = F.struct(*[facts[c].cast("long").alias(c) for c in FACTS])
    return computed(hashed, quality_facts=found).drop(*WORKING[2:])


def _failing(rule: Rule, text_col: str) -> Column:
    fact = {c: F.col("quality_facts")[c] for c in FACTS}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.coalesce(rule.fails(text, F.col("quality_words"), fact), F.lit(False))


def estimate(sample: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> list[Estimate]:
    """What each rule costs and rejects on ``sample``, a written table that ``with_facts`` made.

    The better of two runs counts, less what the scan takes without a rule.
    """

    def run(failing: Column) -> tuple[float, int]:
        took = []
        for _ in range(2):
            start = time.perf_counter()
            n = sample.agg(F.count_if(failing).alias("n")).first()["n"]
            took.append(time.perf_counter() - start)
        return min(took), n

    read = F.size("quality_words") + F.length(F.col(text_col)) < 0
    base, _ = run(read)
    out = []
    for rule in rules:
        seconds, n = run(_failing(rule, text_col))
        out.append(Estimate(rule, max(seconds - base, LEAST_SECONDS), n))
    return out


def in_order(
    sample: DataFrame, estimates: Sequence[Estimate], text_col: str = "text"
) -> list[Rule]:
    """The rules by rejections per cost among the rows that the rules before them leave; rules
    that reject none of those come last, the cheapest first. Ties keep the given order."""
    rules = [e.rule for e in estimates]
    mask = sum(
        (F.when(_failing(r, text_col), 1 << i).otherwise(0).cast("long") for i, r in enumerate(rules)),
        F.lit(0).cast("long"),
    )
    # At most as many rows as the sample has.
    masks = sample.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n")).collect()
    left = {r["mask"]: r["n"] for r in masks}
    waiting, out = list(range(len(rules))), []
    while waiting:
        gain = {i: sum(n for m, n in left.items() if m >> i & 1) for i in waiting}
        best = max(waiting, key=lambda i: (gain[i] / estimates[i].seconds, -estimates[i].seconds, -i))
        waiting.remove(best)
        out.append(rules[best])
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return out


def plan(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", rows: int = SAMPLE
) -> list[Rule]:
    """The order for ``docs``, from a random sample of about ``rows`` of them."""
    if len(rules) > 62:
        raise ValueError("at most 62 rules")
    n = docs.count()
    if n == 0:
        return list(rules)
    some = docs.select(text_col).sample(fraction=min(1.0, rows / n), seed=11)
    sample = cut_lineage(with_facts(some, text_col))
    return in_order(sample, estimate(sample, rules, text_col), text_col)


def judge(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    text_col: str = "text",
    rows: int = SAMPLE,
    ordered: bool = False,
) -> DataFrame:
    """``docs`` with the struct ``quality``: the ``FACTS``, ``kept`` and ``failed``.

    ``failed`` is the rule that rejected the text, null if none did; of several it is the first in
    the order of the cascade, which is estimated from a sample of about ``rows`` rows, or with
    ``ordered`` the order in which the rules are given. ``kept`` does not depend on the order.

    A null text counts as empty: no words, no lines, all facts 0. Repeated rows and null ids are
    judged one by one. An empty table gives no rows. A column ``quality`` of the input is replaced,
    and columns with the names in ``WORKING`` are dropped.
    """
    cascade = list(rules) if ordered else plan(docs, rules, text_col, rows)
    clean = docs.drop("quality", *WORKING)
    measured = with_facts(clean, text_col)
    failed = F.lit(None).cast("string")
    for rule in reversed(cascade):
        failed = F.when(_failing(rule, text_col), F.lit(rule.name)).otherwise(failed)
    judged = computed(measured, quality_failed=failed)
    fact = F.col("quality_facts")
    quality = F.struct(
        *[fact[c].alias(c) for c in FACTS],
        F.col("quality_failed").isNull().alias("kept"),
        F.col("quality_failed").alias("failed"),
    )
    return judged.select(*clean.columns, quality.alias("quality"))
