"""Texts with very many spans, very long texts, and replies that wait for their mapping."""

import random
import time

import pytest
from pyspark.sql import functions as F

import veilspan as v
from tests import plain
from veilspan.operators.detect import SPANS, no_spans

KINDS = ["email", "phone", "ssn", "person", "org"]


def tuples(spans):
    return [tuple(s) for s in spans]


def scattered(rng, size, length, wide):
    found = []
    for _ in range(size):
        start = rng.randrange(length)
        end = start + rng.randrange(0 if rng.random() < 0.1 else 1, wide)
        found.append((rng.choice(KINDS), "x", start, end))
    return found


@pytest.fixture(scope="module")
def crowds():
    """Span lists from sparse to dense, with ties, empty spans and several chunks."""
    rng = random.Random(7)
    shapes = [(0, 5, 3), (1, 5, 3), (8, 10, 6), (40, 30, 12), (300, 200, 30), (700, 5000, 9)]
    return [scattered(rng, *shape) for shape in shapes for _ in range(6)]


def frame(spark, crowds):
    return spark.createDataFrame(list(enumerate(crowds)), f"id int, spans {SPANS}").repartition(3)


def test_precedence_among_extras(spark, crowds):
    df = frame(spark, crowds).withColumn("base", no_spans())
    got = v.merge_spans(df, "base", "spans", "kept").collect()
    for row in got:
        want = plain.merge([], crowds[row.id])
        assert sorted(tuples(row.kept)) == sorted(want)


def test_overlaps_and_pairs(spark, crowds):
    df = frame(spark, crowds)
    hits, pairs = {}, {}
    for row in v.span_overlaps(df, ["id"]).collect():
        hits.setdefault(row.id, []).append(tuple(row)[1:])
    for row in v.span_pairs(df, ["id"]).collect():
        pairs.setdefault(row.id, []).append(tuple(row)[1:])
    for i, spans in enumerate(crowds):
        want = [s for s in spans if any(o[0] != s[0] and plain.hit(s, o) for o in spans)]
        assert hits.get(i, []) == want
        placed = sorted(range(len(spans)), key=lambda j: (spans[j][2], spans[j][3], j))
        both = [
            (spans[a][0], *spans[a][2:], spans[b][0], *spans[b][2:])
            for at, a in enumerate(placed)
            for b in placed[at + 1 :]
            if plain.hit(spans[a], spans[b])
        ]
        assert sorted(pairs.get(i, [])) == sorted(both)


def test_splice_equals_the_copying_loop(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        text = "".join(rng.choice("abc é𝒳") for _ in range(rng.randrange(1, 400)))
        spans = []
        for _ in range(rng.choice([0, 1, 2, 5, 40, 300])):
            start = rng.randrange(len(text))
            end = min(len(text), start + rng.choice([1, 2, 9, 60, 400]))
            spans.append((rng.choice(KINDS), text[start:end], start, end))
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, f"id int, text string, spans {SPANS}")
    got = dict(v.redact(df, overlap="splice").select("id", "text").collect())
    for i, text, spans in rows:
        assert got[i] == plain.redact(text, spans, lambda s: plain_label(s[0]))


def plain_label(kind):
    from veilspan.functions.patterns import LABELS

    return LABELS[kind]


@pytest.mark.parametrize("work", ["pairs", "overlaps", "merge", "splice"])
def test_one_text_with_very_many_spans(spark, work):
    """100,000 spans, 50,000 of them in one unbroken chain, take seconds, not their square."""
    count = 50_000 if work == "merge" else 100_000
    step, width = (3, 5) if work == "merge" else (6, 4)
    spans = F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda i: F.struct(
            F.when(i % 2 == 0, "org").otherwise("person").alias("type"),
            F.lit("x").alias("value"),
            (i * step).cast("int").alias("start"),
            (i * step + width).cast("int").alias("end"),
        ),
    ).cast(SPANS)
    df = spark.range(1).select("id", F.repeat(F.lit("abcdef"), count).alias("text"), spans.alias("spans"))
    begun = time.time()
    if work == "pairs":
        assert v.span_pairs(df, ["id"]).count() == 0
    elif work == "overlaps":
        assert v.span_overlaps(df, ["id"]).count() == 0
    elif work == "merge":
        # The last one comes first: every second span of the chain stays.
        chain = df.withColumn("spans", F.reverse("spans")).withColumn("base", no_spans())
        kept = v.merge_spans(chain, "base", "spans", "kept")
        assert kept.select(F.size("kept")).first()[0] == count // 2
    else:
        done = v.redact(df, overlap="splice").select(F.length("text")).first()[0]
        assert done == (len("[ORG]ef") + len("[NAME]ef")) * count // 2
    assert time.time() - begun < 60


def dirty(rng, size):
    bits = [
        "a.b+c@d-e.example.org", "x@y.co", "555-123-4567", "(555) 123 4567", "+1.555.123.4567",
        "4111 1111 1111 1111", "4111-1111-1111-1112", "12345-6789", "123-45-6789", "10.0.0.1",
        "999.1.1.1.1", "1/2/2024", "word", "é", "𝒳", "_", "@", ".", ",", "\n", "​", "7", "(", "…",
    ]
    return "".join(rng.choice(bits) + rng.choice(["", " ", " ", "\t", ", ", "\u00a0"]) for _ in range(size))


@pytest.mark.parametrize("size", [1, 2, 7, 50])
def test_cut_texts_give_the_same_spans(spark, size):
    rng = random.Random(size)
    rows = [(i, dirty(rng, rng.randrange(60))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "a" * 3000 + "@b.co"), (203, "x@y.co" * 50), (200, "1.2.3.4 a")]
    df = spark.createDataFrame(rows, "id int, text string")
    whole = sorted(map(tuple, v.detect_spans(df, ["id"]).collect()))
    cut = sorted(map(tuple, v.detect_spans_cut(df, ["id"], size=size).collect()))
    assert cut == whole


def feed(spark, path, rows, schema):
    """One file for each list, read one at a time."""
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)


def test_replies_wait_for_their_mapping(spark, tmp_path):
    from datetime import datetime, timedelta

    def at(minutes):
        return datetime(2024, 1, 1) + timedelta(minutes=minutes)

    def token(n):
        return f"[REDACTED_EMAIL_{n:08x}]"

    replies = [
        [
            (1, f"to {token(1)}, {token(2)} and {token(1)}", at(0)),
            (2, f"{token(3)}{token(4)}", at(0)),
            (3, "nothing here", at(1)),
            (4, None, at(1)),
            (5, f"{token(5)}", at(2)),
            (None, f"x {token(2)}", at(2)),
            (6, f"{token(6)}", at(3)),
            (6, f"{token(6)}", at(3)),
        ],
        [(7, f"{token(2)}", at(4))],
        [(99, "", at(500))],
    ]
    mappings = [
        [("default", token(1), "a@x.co", at(-9000)), ("default", token(5), "p@x.co", at(-1))],
        [
            ("default", token(2), "b@x.co", at(8)),  # after the replies, while they wait
            ("default", token(3), "c@x.co", at(11)),  # too late
            ("default", token(4), token(1), at(9)),  # a value that is not scanned again
            ("default", token(5), "q@x.co", at(3)),  # a second value
            ("other", token(6), "z@x.co", at(3)),  # of another session
        ],
        [("another", None, None, at(500))],
    ]
    left = feed(spark, str(tmp_path / "r"), replies, "id int, text string, at timestamp")
    right = feed(
        spark, str(tmp_path / "m"), mappings, "session string, token string, value string, made timestamp"
    )
    out = str(tmp_path / "out")
    done = v.restore_waiting_stream(left, right, ["id"])
    writer = done.writeStream.format("parquet").option("path", out)
    writer = writer.option("checkpointLocation", str(tmp_path / "c"))
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(done.schema).parquet(out).collect()
    got = {(r.id, r.text) for r in rows}
    assert len(rows) == 8  # the repeated reply 6 once, reply 99 still waits
    assert got == {
        (1, "to a@x.co, b@x.co and a@x.co"),
        (2, f"{token(3)}{token(1)}"),
        (3, "nothing here"),
        (4, None),
        (5, token(5)),
        (None, "x b@x.co"),
        (6, token(6)),
        (7, "b@x.co"),
    }
