import random
import re

import numpy as np
import pytest

from veilspan.llm import jaccard
from veilspan.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, groups=6, copies=14):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    rows, i = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(5, 90))]
        for _ in range(copies):
            other = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 18)):
                other[rng.randrange(len(other))] = rng.choice(words).upper()
            rows.append((i, rng.choice([" ", "\n", "  "]).join(other)))
            i += 1
    return rows


def run(spark, rows, width, percent):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, entry string")
    found = jaccard.near_duplicates(frame, width, percent).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in found}


@pytest.mark.parametrize("frequent", [2, 1000])
def test_against_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = corpus(frequent)
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for percent in (80, 85):
        for _ in range(400):
            n = int(rng.integers(1, 120))
            x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            keep = x[rng.random(len(x)) < rng.uniform(0.85, 1)]
            y = np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)]))
            frequent = np.unique(rng.permutation(np.concatenate([x, y]))[: int(rng.integers(0, 2 * n + 1))])
            if jaccard.similar(x, y, percent) and not np.array_equal(x, y):
                a, _ = jaccard.signatures(x, frequent, percent)
                b, _ = jaccard.signatures(y, frequent, percent)
                assert len(np.intersect1d(a, b)), (len(x), len(y), len(frequent))


def test_a_similar_set_has_a_first_entry_of_the_smaller_one():
    rng = np.random.default_rng(2)
    met = 0
    for percent in (80, 85, 95):
        for _ in range(1500):
            x = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 160))).astype(np.uint64))
            keep = x[rng.random(len(x)) < rng.uniform(0.78, 1)]
            y = np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, int(rng.integers(0, 1 + len(x) // 6))).astype(np.uint64)]))
            x, y = sorted((x, y), key=len)
            both = np.unique(np.concatenate([x, y]))
            frequent = np.sort(rng.permutation(both)[: int(rng.integers(0, len(both) + 1))])
            if jaccard.similar(x, y, percent) and not np.array_equal(x, y):
                met += 1
                first, later, _ = jaccard.index_entries(x, frequent, percent)
                every, _ = jaccard.signatures(y, frequent, percent)
                assert len(np.intersect1d(first, every)), (percent, len(x), len(y), len(frequent))
                assert not len(np.intersect1d(first, later))
                if len(x) == len(y):
                    assert len(np.intersect1d(jaccard.index_entries(y, frequent, percent)[0], jaccard.signatures(x, frequent, percent)[0]))
    assert met > 500


def test_rows_of_any_kind(spark):
    text = "a b c d e f g h"
    rows = [(5, text), (3, text.upper()), (None, text), (6, None), (7, ""), (8, " \n"), (9, "a b"), (2, "A\tb"), (4, "a"), (3, text)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.near_duplicates(frame, 4, 85).collect()
    got = sorted(map(repr, [tuple(r) for r in found]))
    want = [(5, 5, 3), (3, 5, 3), (3, 5, 3), (None, 5, None), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 1, 2), (2, 1, 2), (4, 1, 4)]
    assert got == sorted(map(repr, want))
    assert jaccard.near_duplicates(frame.limit(0)).count() == 0


def test_members_that_the_leader_does_not_join_are_compared(spark, monkeypatch):
    """A chain: each text is similar to the next only."""
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[2 * k : 2 * k + 40])) for k in range(11)]
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (20, 5), (5, 6), (6, 4), (30, 31)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.label for r in found} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 4: 4, 5: 4, 6: 4, 20: 4, 30: 30, 31: 30}


def test_only_texts_that_may_be_wanted_are_sent_to_a_join(spark, monkeypatch):
    plans = []
    cut = jaccard.cut_lineage

    def seen(df):
        if df.columns == ["id_", "text_"]:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(jaccard, "cut_lineage", seen)
    base = " ".join(f"w{k}" for k in range(80))
    rows = [(i, " ".join(f"t{i}x{k}" for k in range(30))) for i in range(300)]
    rows += [(1000, base), (1001, base + " more"), (None, base + " again"), (1001, base + " more"), (1002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.near_duplicates(docs, 4, 85).filter("doc_id >= 1000").distinct()
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(1000, 1000), (1001, 1000), (1002, 1002)}
    assert plans and all("rightHint=(strategy=broadcast)" in p and "bit" in p for p in plans)


def test_texts_of_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)] + [(None, "none"), (7, "again")], "id_ long, text_ string")
    ids = spark.createDataFrame([(7,), (7,), (499,), (-1,)], "id_ long")
    for slots in (64, 1 << 24):
        monkeypatch.setattr(jaccard, "SLOTS", slots)
        got = jaccard._texts_of(docs, ids)
        assert sorted(map(tuple, got.collect())) == [(7, "again"), (7, "text 7"), (499, "text 499")]
