import numpy as np
import pytest

from veilspan.llm import topk


def brute(rows, queries, k):
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in queries:
        for own, query in usable:
            if own == q:
                scored = [(-int(np.dot(query, v)), i) for i, v in usable if i != q and len(v) == len(query)]
                out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def run(spark, rows, keep, k=4, **more):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v_ string, dims int")
    found = topk.search(frame, frame.filter(keep), k, **more).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)


def test_against_brute_force_with_many_ties_and_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 6) / 16).tolist()) for i in range(230)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]
    assert run(spark, rows, "vec_id % 10 = 0", block=50) == brute(rows, [i for i, _ in rows if i % 10 == 0], 4)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stopping_early_never_changes_the_answer(seed):
    rng = np.random.default_rng(seed)
    vectors = np.floor(1024 * rng.normal(0, 0.12, (3000, 32))).astype(np.int64)
    index = topk.Index(vectors, np.arange(3000))
    shares = []
    for q in range(0, 3000, 300):
        scores, ids, share = index.top(vectors[q] * (3 if q % 600 else 1), 10, q)
        exact = vectors @ (vectors[q] * (3 if q % 600 else 1))
        exact[q] = -(10**15)
        best = np.lexsort((np.arange(3000), -exact))[:10]
        assert ids.tolist() == best.tolist() and scores.tolist() == exact[best].tolist()
        shares.append(share)
    assert min(shares) < 1.0


def test_rows_of_any_kind(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (1, None), (2, []), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (6, [0.25, 0.5]), (None, [1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (8, [-0.5, -0.25]), (10, [0.5, 0.25]), (11, [0.0, 0.0])]
    assert run(spark, rows, "vec_id % 5 = 0") == brute(rows, [0, 5, 10], 4)
    assert run(spark, [], "vec_id % 5 = 0") == []
    assert run(spark, rows[:1], "vec_id = 0") == []
