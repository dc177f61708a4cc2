"""Random texts against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import veilspan as v
from tests import plain
from veilspan.functions.arrays import blocks, piece, running
from veilspan.functions.patterns import ENTITIES, LABELS
from veilspan.operators.spans import merged
from veilspan.operators.vault import vault_entries

PIECES = [
    "a@b.co", "x.y@mail.example.com", "555-123-4567", "(555) 123-4567", "+1-5551234567",
    "123-45-6789", "4111-1111-1111-1111", "4000 1234 5678 9017", "12345-6789", "1.2.3.4",
    "300.1.2.3", "01/02/2024", "1-2-99", "word", "é", "😀", "--", "..", "@", "_", "7", " ", "　",
    "...a.b", "%x", "-----q@r.st",
]


def random_texts(n, seed, longest=25):
    rng = random.Random(seed)
    return [
        "".join(
            rng.choice(PIECES) + rng.choice(["", " ", "-", ".", "x", ", "])
            for _ in range(rng.randint(0, longest))
        )
        for _ in range(n)
    ]


@pytest.fixture(scope="module")
def sample():
    return random_texts(3000, 1) + random_texts(40, 2, 1500)


def test_spans(texts, sample):
    rows = v.detect(texts(sample, 8)).collect()
    assert len(rows) == len(sample)
    for row in rows:
        got = [(s.type, s.value, s.start, s.end) for s in row.spans]
        assert got == plain.detect(sample[row.id - 1])


def test_counts_and_presence(texts, sample):
    df = texts(sample, 8)
    counts = {(r.id, r.type): r["count"] for r in v.pii_summary(df, ["id"]).collect()}
    expected = {}
    for i, text in enumerate(sample, 1):
        for span in plain.detect(text):
            expected[i, span[0]] = expected.get((i, span[0]), 0) + 1
    assert counts == expected
    assert {r.id for r in v.has_pii(df).collect()} == {i for i, _ in expected}


def test_report(texts, sample):
    df = texts(sample, 8).withColumn("g", F.col("id") % 3)
    found = {}
    for i, text in enumerate(sample, 1):
        for kind, value, _, _ in plain.detect(text):
            found.setdefault((i % 3, kind), []).append((value, i))
    expected = {
        k: (len(x), len({a for a, _ in x}), len({b for _, b in x})) for k, x in found.items()
    }
    got = {
        (r.g, r.type): (r["count"], r.distinct_values, r.texts)
        for r in v.pii_report(df, ["g"]).collect()
    }
    assert got == expected


def test_labels(texts, sample):
    for row in v.scrub_labels(texts(sample, 8)).collect():
        text = sample[row.id - 1]
        spans = plain.cover(text, plain.detect(text))
        assert row.text == plain.redact(text, spans, lambda s: LABELS[s[0]])


def test_splice(texts, sample):
    for row in v.scrub_labels(texts(sample[:2000], 8), overlap="splice").collect():
        text = sample[row.id - 1]
        assert row.text == plain.redact(text, plain.detect(text), lambda s: LABELS[s[0]])


def test_round_trip_and_nothing_survives(texts, sample):
    df = texts(sample, 8)
    vault = v.build_vault(vault_entries(df), "s")
    scrubbed = v.scrub_tokens(df, secret="s", vault=vault).cache()
    token_of = {(r.entity, r.value): r.token for r in vault.collect()}
    for row in scrubbed.collect():
        text = sample[row.id - 1]
        spans = plain.cover(text, plain.detect(text))
        assert row.text == plain.redact(text, spans, lambda s: token_of[ENTITIES[s[0]], s[1]])
    for hot_rows in (1_000_000, 2):
        restored = v.restore_tokens(scrubbed, vault, hot_rows=hot_rows)
        assert {r.id: r.text for r in restored.collect()} == dict(enumerate(sample, 1))
    assert v.round_trip_check(df, restored, ["id"]).isEmpty()


def test_merge(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        def spans(n, kind):
            out = []
            for _ in range(n):
                start = rng.randint(0, 40)
                out.append((kind, str(start), start, start + rng.randint(1, 8)))
            return out

        rows.append((i, spans(rng.randint(0, 5), "email"), spans(rng.randint(0, 5), "person")))
    kind = "array<struct<type:string,value:string,start:int,end:int>>"
    df = spark.createDataFrame(rows, f"id int, base {kind}, extra {kind}")
    got = df.select("id", merged(F.col("base"), F.col("extra")).alias("m")).collect()
    for row in got:
        _, base, extra = rows[row.id]
        assert [tuple(s) for s in row.m] == plain.merge(base, extra)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 512, 513, 5000])
def test_running_totals(spark, n):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: i % 7).alias("a"))
    df = df.select(F.slice("a", F.lit(1), F.lit(n)).alias("a"))
    got = df.select(running(F.col("a"), lambda a, b: a + b).alias("r")).first().r
    want = [0]
    for i in range(n):
        want.append(want[-1] + i % 7)
    assert got == want


def test_pieces_of_long_texts(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("aé😀\n ") for _ in range(9000))
    cuts = [(0, 9000), (0, 0), (2047, 2049), (2048, 4096), (2048, 4097), (100, 8999), (8999, 9000)]
    cuts += [tuple(sorted((rng.randint(0, 9000), rng.randint(0, 9000)))) for _ in range(200)]
    df = spark.createDataFrame([(text, a, b) for a, b in cuts], "text string, a int, b int")
    for row in df.select("a", "b", piece(blocks(F.col("text")), F.col("a"), F.col("b")).alias("p")).collect():
        assert row.p == text[row.a : row.b]


def test_long_runs_without_an_address_stay_fast(spark):
    import time

    for marks in range(1, 9):
        run = ("a" + "." * marks) * (200_000 // (marks + 1))
        df = spark.createDataFrame([(run + "@",), ("@ " + run,), ("." * 200_000 + "@ @",)], "text string")
        start = time.time()
        assert v.detect_spans(df, []).isEmpty()
        assert time.time() - start < 20
