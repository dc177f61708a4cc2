import random
import re

import pytest

from veilspan.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(text):
    words = WORD.findall(text.translate(LOWER))
    places = []
    for phrase, label in licenses.BASE:
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    at = [p for p, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_against_brute_force():
    rng = random.Random(1)
    parts = ["under", "the", "MIT", "license", "Apache", "License,", "Version", "2.0", "CC", "BY-NC", "by", "nc", "é", "_", "-", "x y", "\n"]
    texts = [rng.choice(["", " ", "("]).join(rng.choice(parts) + rng.choice([" ", " ", "-", ""]) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["under the mit license under the mit license", "cc by nc by nc cc_by/nc"]
    for text, row in zip(texts, licenses.scan_texts(texts)):
        assert row[:5] == brute(text), text
        assert set(filter(None, row[4].split(","))) <= set(filter(None, row[5].split(",")))
        assert 0 <= row[6] <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2"),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc,cc-by-nc-sa-4"),
        ("licensed under the GNU Lesser General Public License v2.1 or later", "lgpl-2.1"),
        ("SPDX-License-Identifier: Apache-2.0", "apache-2"),
        ("the BSD 3-Clause License", "bsd-3"),
        ("Mozilla Public License 2.0 and the zlib license", "mpl-2,zlib"),
        ("a driving licence is needed, mit etwas Geduld", ""),
    ],
)
def test_rules(text, labels):
    assert licenses.scan_texts([text])[0][5] == labels


def test_contained_detections_are_suppressed():
    row = licenses.scan_texts(["This is released under the terms of the GNU General Public License, version 3."])[0]
    (only,) = row[7]
    assert only["label"] == "gpl-3" and (only["start"], only["end"]) == (2, 14)
    assert len(licenses.rules()) >= 200
    order = [r.priority for r in licenses.rules()]
    assert order == sorted(order, reverse=True)


def test_rows_of_any_kind(spark):
    text = "Released under the MIT License."
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "word " * 100_000 + text), (5, (text + "\n") * 3000)]
    docs = spark.createDataFrame([(i, t, "l", 1) for i, t in rows], "doc_id long, text string, labels string, n_words int")
    found = licenses.scan(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        got = r.license
        assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels) == brute(r.text or "")
    assert licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MPL 2.0.", "mpl-2"),
        ("distributed under BSD 3-Clause", "bsd-3"),
        ("available under Apache 2.0", "apache-2"),
        ("published under Creative Commons Attribution 4.0", "cc-by-4"),
        ("released under the EUPL 1.2", "eupl-1.2"),
        ("Provided under WTFPL 2", "wtfpl-2"),
    ],
)
def test_notices_without_the_word_licence(text, labels):
    row = licenses.scan_texts([text])[0]
    assert row[5] == labels and row[6] == 0.95


def spelled(pattern, rng):
    """A text that a rule's pattern matches, at random."""
    def pick(m):
        optional, ways = m[2] == "?", m[1].split("|")
        return "" if optional and rng.random() < 0.5 else rng.choice(ways)

    out = pattern.removesuffix("(?= )")
    while "(?:" in out:
        out = re.sub(r"\(\?:([^()]*)\)(\??)", pick, out)
    out = out.replace("[cs]", rng.choice("cs"))
    return re.sub(r"(.)\?", lambda m: m[1] if rng.random() < 0.5 else "", out)


def test_literals_never_keep_a_rule_from_a_text_it_matches():
    rng = random.Random(3)
    for rule in licenses.rules():
        for _ in range(30):
            words = f" some words{spelled(rule.pattern.pattern, rng)} and more "
            assert rule.pattern.search(words), words
            assert rule in licenses.candidates(words), words
            found = words.split(" ")[1:-1]
            starts = [1 + sum(len(w) + 1 for w in found[:i]) for i in range(len(found))]
            every = licenses.detections(words, starts, list(licenses.rules()))
            assert every and licenses.scan_texts([words])[0][7] == [d._asdict() for d in every]
