import random

import numpy as np
import pytest

from veilspan.llm import toxicity

BAD = ["idiot", "moron", "scum"]


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(300)]
    texts, labels = [], []
    for _ in range(n):
        sentences = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 15))) for _ in range(rng.randint(1, 12))]
        toxic = rng.random() < 0.3
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += f" {rng.choice(BAD)} {rng.choice(words)}"
        texts.append(". ".join(sentences) + ".")
        labels.append(toxic != (rng.random() < 0.03))
    return texts, np.array(labels)


def test_held_out_documents_and_offending_sentences():
    texts, labels = corpus(900, 1)
    model = toxicity.fit([t.encode() for t in texts], labels)
    texts, labels = corpus(400, 2)
    truth = np.array([any(b in t for b in BAD) for t in texts])
    scores, parts = model.scores([t.encode() for t in texts])
    assert ((scores >= 0.3) == truth).mean() > 0.97
    for text, is_toxic, (p, starts) in zip(texts, truth, parts):
        if is_toxic:
            worst = int(np.argmax(p))
            end = starts[worst + 1] if worst + 1 < len(starts) else len(text)
            assert any(b in text[starts[worst] : end] for b in BAD)


def test_the_score_is_the_noisy_or_of_its_sentences():
    texts, labels = corpus(300, 3)
    model = toxicity.fit([t.encode() for t in texts], labels)
    scores, parts = model.scores([t.encode() for t in texts])
    for s, (p, _) in zip(scores, parts):
        assert s == pytest.approx(1 - np.prod(1 - p), abs=1e-9)


def test_the_gradient_lowers_the_loss():
    texts, labels = corpus(300, 4)
    data = [t.encode() for t in texts]

    def loss(model):
        s = np.clip(model.scores(data)[0], 1e-9, 1 - 1e-9)
        return -np.mean(np.where(labels, np.log(s), np.log(1 - s)))

    assert loss(toxicity.fit(data, labels, rounds=200)) < loss(toxicity.fit(data, labels, rounds=2)) * 0.7


def test_rows_of_any_kind(spark):
    texts, labels = corpus(300, 5)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)]
    rows += [(None, "you idiot.", 2, "x"), (900, None, 2, "x"), (901, "", 2, "x"), (902, "ok " * 50_000, 2, "x"), (3, texts[3], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic_score int, spans string")
    known = [(i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (5, None), (7, 0), (7, 1)]
    model = toxicity.train(docs, spark.createDataFrame(known, "doc_id long, toxic int"))
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.toxic_score <= 1 for r in found)
    by = {r.doc_id: r for r in found}
    assert by[None].toxic_flag == 1 and by[None].toxic_spans[0].start == 0
    assert by[900].toxic_score == by[901].toxic_score and by[900].toxic_flag == by[902].toxic_flag == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_labels_of_one_kind_and_none(spark):
    assert 0 < toxicity.fit([], np.array([], dtype=bool)).scores([b"a b"])[0][0] < 0.3
    assert toxicity.fit([b"a", b"b"], np.array([True, True])).scores([b"a"])[0][0] > 0.3
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int")).bias < 0


def test_held_out_rows_are_not_learned_from(spark):
    ids = [r.id for r in spark.range(200).filter(toxicity.held_out(toxicity.F.col("id"))).collect()]
    docs = spark.createDataFrame([(i, "bad words") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).bias == toxicity.fit([], np.array([], dtype=bool)).bias


def test_the_bound_counts_labelled_documents(spark, monkeypatch):
    texts, labels = corpus(300, 6)
    ids = [r.id for r in spark.range(3000).filter(~toxicity.held_out(toxicity.F.col("id"))).collect()]
    sizes, fit = [], toxicity.fit_bags
    monkeypatch.setattr(toxicity, "fit_bags", lambda bags, y, *a: sizes.append(len(bags)) or fit(bags, y, *a))
    # ids without a document do not use up the bound
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    known = spark.createDataFrame([(i, int(labels[k % 300])) for k, i in enumerate(ids)], "doc_id long, toxic int")
    assert toxicity.train(docs, known, most=200).bias != -3.0 and sizes == [200]
    # nor do an id's many rows go beyond it, and each other id keeps its text
    many = docs.union(spark.createDataFrame([(ids[0], f"row {k}") for k in range(400)] * 2, docs.schema))
    toxicity.train(many, known, most=350)
    toxicity.train(many, known, most=2000)
    assert sizes == [200, 350, 700]


def test_long_clean_texts_are_clean():
    texts, labels = corpus(900, 7)
    model = toxicity.fit([t.encode() for t in texts], labels)
    clean = next(t for t, y in zip(texts, labels) if not y and len(t) > 200 and not any(b in t for b in BAD))
    table = "\n".join(f"{k} 3.14 2.71 {k}.50" for k in range(3000))
    odd = ["." * 10_000, "\n" * 5_000, "?!" * 4_000, table, f"{clean} " * 10_000, "", " "]
    scores, parts = model.scores([t.encode() for t in odd])
    assert scores.max() < 0.3 and not any(len(p) for p, _ in parts[:3])
    assert len(parts[3][0]) == 3000
    long = f"{clean} " * 2_000 + "you idiot scum moron. " + f"{clean} " * 2_000
    assert model.scores([long.encode()])[0][0] >= 0.3


def test_top_sentences_of_each_group():
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 9, 400))
    logits = rng.normal(size=400)
    taken = toxicity._top(logits, group)
    for g in range(9):
        own = np.sort(logits[group == g])[::-1][: toxicity.TOP]
        assert sorted(logits[taken & (group == g)], reverse=True) == list(own)


def test_a_worker_scores_few_texts_at_a_time():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from veilspan.llm.toxicity import BITS, Model, _portions

    weights = np.zeros(1 << BITS)
    texts = [f"some plain words {i} . " * 30 for i in range(2_000)]
    portions = list(_portions(iter([pd.Series(texts), pd.Series([], dtype=object), pd.Series(["é"])])))
    assert [t.decode() for p in portions for t in p] == [*texts, "é"]
    assert max(map(len, portions)) <= 512
    tracemalloc.start()
    scores, parts = Model(weights, -3.0).scores(portions[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) == len(parts) == 512 and peak < 32_000_000
