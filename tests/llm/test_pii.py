import hashlib
import random
import re

import numpy as np

from veilspan.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return found


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(4)
    letters = "0123456789.@+- ()ab\né,4111111111111111"
    for _ in range(8000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 70)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "@" * 300_000, "a@b" * 100_000):
        pii.base_spans(text)


def test_viterbi_is_the_best_of_all_chains():
    rng = np.random.default_rng(2)
    size = len(pii.LABELS)
    field = pii.Field(rng.normal(size=(1 << pii.BITS, size)), rng.normal(size=(size, size)), rng.normal(size=size))
    rows = [rng.integers(0, 1 << pii.BITS, (n, 3)) for n in (1, 2, 3, 3, 1)]
    for row, got in zip(rows, field.decode(rows)):
        emit = field.weights[row].sum(axis=1)

        def score(chain):
            s = field.first[chain[0]] + sum(emit[t, c] for t, c in enumerate(chain))
            return s + sum(field.pairs[a, b] for a, b in zip(chain, chain[1:]))

        chains = np.stack(np.meshgrid(*[range(size)] * len(row), indexing="ij"), -1).reshape(-1, len(row))
        assert score(got) >= max(map(score, chains)) - 1e-9


def test_the_field_learns_its_table_and_finds_what_patterns_miss():
    field = pii.default_field()
    right = total = 0
    for text, gold in pii.labelled():
        base, more = pii.find([text], field)[0]
        total += len(gold)
        right += len(set(gold) & set(base + more))
    assert right / total > 0.85
    text = 'the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" of, call (555) 010-2030 now'
    found = {(k, text[a:b]) for k, a, b in pii.find([text], field)[0][1]}
    assert ("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff") in found
    clean = "In 1984 there were 12 of them, on page 7 of the book.\nNo more than 3.5 percent."
    assert pii.find([clean], field)[0] == ([], [])


def test_rows_of_any_kind(spark):
    mail = "write to ana@example.com or 10.0.0.1"
    rows = [(1, mail), (1, mail), (None, mail), (2, None), (3, ""), (4, "x " * 100_000 + mail), (5, mail + " " + mail)]
    docs = spark.createDataFrame([(i, t, "p", 4) for i, t in rows], "doc_id long, text string, spans string, n_email int")
    found = pii.detect(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        base = plain(r.text or "")
        assert (r.pii.n_email, r.pii.n_ip) == tuple(sum(k == kind for k, _, _ in base) for kind in ("email", "ip"))
        assert r.pii.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(r.pii.spans.split(",")) or not base
        assert (r.pii.masked_text is None) == (r.text is None) and "@" not in (r.pii.masked_text or "")
        assert r.spans == "p" and r.n_email == 4
    assert pii.detect(docs.limit(0)).count() == 0


def test_masking_unites_overlapping_spans():
    assert pii.masked("abcdefgh", [("ip", 1, 4), ("card", 2, 6)]) == "a[IP]gh"
