import re
from collections import Counter

import pytest

from veilspan.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def facts(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


CLEAN = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
RUN = "one two three four five six seven eight"
TEXTS = [
    None,
    "",
    " \n\t ",
    CLEAN,
    CLEAN,
    f"{CLEAN} {RUN} then {RUN}",
    f"{RUN} nine ten {RUN} nine ten {RUN}",
    "a " * 8,
    "a " * 9,
    "a " * 1000,
    f"{RUN} {CLEAN}\n" * 3,
    "same line\n" * 5 + " same line\n" + CLEAN,
    "# * $ % & | < >" * 4,
    "é😀 x \x1c y",
    CLEAN.upper(),
    CLEAN.replace(" ", "!! "),
    CLEAN.replace(" ", " | "),
    CLEAN.replace(" ", " 12 34 "),
    "\r\n".join([CLEAN, CLEAN, ""]),
    " ".join(w for x in CLEAN.split() for w in (x, x)),
    "x" * 200_000,
    " ".join(f"w{i % 4001}" for i in range(20_000)),
]


def frame_of(spark, rows):
    schema = "doc_id long, text string, quality string, quality_words int, quality_facts int"
    return spark.createDataFrame([(i, t, "q", 1, 2) for i, t in rows], schema)


@pytest.fixture(scope="module")
def judged(spark):
    rows = [*enumerate(TEXTS), (None, CLEAN), (3, "short")]
    return rows, quality.judge(frame_of(spark, rows)).collect()


def test_facts_by_brute_force(judged):
    rows, found = judged
    mine = sorted(repr((r.doc_id, *[r.quality[c] for c in quality.FACTS])) for r in found)
    assert mine == sorted(repr((i, *[facts(t)[c] for c in quality.FACTS])) for i, t in rows)


def test_verdicts(judged):
    _, found = judged
    failed = {r.doc_id: r.quality.failed for r in found if r.doc_id is not None and r.text != "short"}
    assert {i for i, f in failed.items() if f is None} == {3, 4, 5}
    assert all((r.quality.failed is None) == r.quality.kept for r in found)
    assert failed[0] == failed[1] == "few_words"


def test_each_rule_on_its_own(spark):
    by_name = {r.name: r for r in quality.RULES}
    hits = {
        "few_words": 7,
        "repeated_words": 9,
        "symbols": 16,
        "word_length": 20,
        "repeated_lines": 11,
        "exclamations": 15,
        "capitals": 14,
        "letterless_words": 17,
        "stutter": 19,
    }
    assert set(hits) == set(by_name)
    for name, at in hits.items():
        one = quality.judge(frame_of(spark, [(at, TEXTS[at]), (3, CLEAN)]), [by_name[name]], ordered=True)
        assert {r.doc_id: r.quality.failed for r in one.collect()} == {at: name, 3: None}, name


def test_order_by_rejections_per_cost(spark):
    rules = {r.name: r for r in quality.RULES}
    texts = [(i, CLEAN) for i in range(4)] + [(9, CLEAN.replace(" ", " | "))] * 3 + [(8, "short text")] * 2
    sample = quality.cut_lineage(quality.with_facts(frame_of(spark, texts)))

    def order(*estimates):
        given = [quality.Estimate(rules[name], seconds, 0) for name, seconds in estimates]
        return [r.name for r in quality.in_order(sample, given)]

    # 3 texts fail "symbols" and "letterless_words", 2 others "few_words".
    assert order(("few_words", 1.0), ("symbols", 1.0), ("letterless_words", 0.5)) == ["letterless_words", "few_words", "symbols"]
    assert order(("few_words", 1.0), ("symbols", 4.0), ("letterless_words", 9.0)) == ["few_words", "symbols", "letterless_words"]
    estimates = quality.estimate(sample, quality.RULES)
    assert {e.rule.name: e.rejects for e in estimates if e.rejects} == {"few_words": 2, "symbols": 3, "letterless_words": 3}
    assert all(e.seconds >= quality.LEAST_SECONDS for e in estimates)


def test_the_order_never_changes_the_verdict(spark):
    frame = frame_of(spark, list(enumerate(TEXTS)))
    verdicts = [
        sorted((r.doc_id, r.quality.kept) for r in quality.judge(frame, rules, ordered=True).collect())
        for rules in (quality.RULES, quality.RULES[::-1])
    ]
    assert verdicts[0] == verdicts[1]


def test_empty_table_and_no_python(spark):
    assert quality.judge(frame_of(spark, [])).collect() == []
    plan = quality.judge(frame_of(spark, [(1, CLEAN)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan
