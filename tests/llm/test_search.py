import math
import re
from collections import Counter

import numpy as np
import pytest

from veilspan.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in set(terms(text)):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, i, -s))
    return sorted(out, key=repr)


def run(spark, docs, items, k=10, parts=3):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, item string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    found = search.search(d.repartition(parts), b, k).collect()
    return sorted((tuple(r) for r in found), key=repr)


def made(seed, n_docs, n_items, vocabulary=300):
    rng = np.random.default_rng(seed)
    chance = 1 / np.arange(1, vocabulary + 1)
    chance /= chance.sum()

    def text(n):
        return " ".join(f"T{x}" for x in rng.choice(vocabulary, n, p=chance))

    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(n_docs)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # many copies
    items = [(i, text(12)) for i in range(n_items)] + [(500, docs[3][1] or "t1"), (501, docs[7][1] or "t2")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    docs, items = made(seed, 700, 30)
    assert run(spark, docs, items) == brute(docs, items)


def test_small_trees_and_groups_of_items(spark, monkeypatch):
    docs, items = made(5, 300, 20)
    monkeypatch.setattr(search, "ITEMS", 4)
    monkeypatch.setattr(search, "TERMS", 30)
    assert run(spark, docs, items, k=3, parts=2) == brute(docs, items, 3)


def test_rows_of_any_kind(spark):
    docs = [
        (1, None), (2, ""), (3, "!!! ..."), (4, "Alpha beta"), (4, "Alpha beta"), (4, "beta gamma ÉTÉ"),
        (None, "alpha alpha"), (None, None), (5, "alpha " * 20_000), (6, "x" * 100_000), (7, "a\x00b_c@d[e`f{g\x7fh"),
        (8, "été 漢字"), (9, "alpha_beta"), (-3, "alpha beta"),
    ]
    items = [
        (1, "alpha"), (1, "BETA gamma"), (2, None), (3, ""), (4, "nowhere"), (None, "Alpha été"),
        (5, "a b c d e f g h"), (6, "x" * 100_000), (7, "ALPHA alpha Alpha"),
    ]
    for k in (2, 10):
        assert run(spark, docs, items, k) == brute(docs, items, k)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "alpha")]) == []
    assert run(spark, [(1, "alpha")], []) == []
    assert run(spark, [(1, None)], [(1, "alpha")]) == []


def numbered(texts, items):
    """Vectors, weights and the tree over texts, without Spark."""
    rows = [(i, np.unique(next(search._hashed([t.encode()]))[2])) for i, t in enumerate(items)]
    group = search._gather(rows)
    places, tfs, sizes = [], [], []
    for text in texts:
        hashes = next(search._hashed([text.encode()]))[2]
        at, counts = np.unique(np.searchsorted(group.terms, hashes[np.isin(hashes, group.terms)]), return_counts=True)
        places.append(at)
        tfs.append(counts)
        sizes.append(len(hashes))
    df = Counter(int(x) for p in places for x in p)
    weights = search.weigh(group, df, len(texts), sum(sizes))
    paths = [np.argsort(weights.rank[p]) for p in places]
    ranked = [weights.rank[p][o] for p, o in zip(places, paths)]
    tree = search.Tree(ranked, [t[o] for t, o in zip(tfs, paths)], weights.m(np.array(sizes)), len(weights.weight))
    return tree, weights


def test_the_tree_shares_paths_and_its_bounds_hold():
    docs, items = made(9, 400, 20)
    texts = [t or "t1" for _, t in docs]
    tree, weights = numbered(texts, [t for _, t in items])
    assert sorted(tree.order.tolist()) == list(range(len(texts)))
    for node, children in enumerate(tree.children):
        lo, hi = tree.lo[node], tree.hi[node]
        assert tree.least[node] == tree.m[lo:hi].min()
        for place, tf in [(p, t) for r in range(lo, hi) for p, t in zip(tree.ranked[r], tree.tfs[r])]:
            assert tree.top[node][place] >= tf
        if children:
            assert [tree.lo[children[0]], tree.hi[children[-1]]] == [lo, hi]
            assert all(tree.hi[a] == tree.lo[b] for a, b in zip(children, children[1:]))
    copies = [r for r in range(len(texts)) if texts[tree.order[r]] == texts[7]]
    assert copies == list(range(copies[0], copies[0] + len(copies)))


def test_branch_and_bound_leaves_documents_out():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 2000, 40)) for _ in range(4000)]
    items = [" ".join(texts[i].split()[:20]) for i in range(0, 4000, 400)]
    tree, weights = numbered(texts, items)
    best = search.Best(len(items), 3)
    scored = search.walk(tree, np.arange(len(texts)), np.zeros(len(texts), bool), weights, best)
    assert scored < 0.65 * len(texts) * len(items)
    assert [int(best.id[i, 0]) for i in range(len(items))] == list(range(0, 4000, 400))
