"""Vectors derived by reading, one row per rule that is easy to get wrong."""

import random

import pytest
from pyspark.sql import functions as F

import veilspan as v
from tests.plain import COMPILED
from veilspan.functions.checks import is_card, is_ipv4
from veilspan.functions.patterns import TYPES, java_pattern

ZWSP = "​"
NBSP = " "

VECTORS = [
    ("é12345-6789 x", [("zipCode", 1, 11)]),
    ("5551234567@example.com", [("email", 0, 22), ("phone", 0, 10)]),
    ("aaa.1.2.3.4.b@example.com tail", [("email", 0, 25), ("ipAddress", 4, 11)]),
    ("123-45-6789-123-4567", [("phone", 8, 20), ("ssn", 0, 11)]),
    ("4111111111111111", [("phone", 6, 16)]),
    ("😀 a@b.co 4111-1111-1111-1111", [("email", 2, 8), ("creditCard", 9, 28)]),
    ("999.1.1.1.1", []),
    ("+1 555-123-4567 (555) 123-4567", [("phone", 3, 15), ("phone", 16, 30)]),
    ("2024-01-15 01/15/2024", [("date", 11, 21)]),
    (f"a{ZWSP}b@c\U000e0041.com­ x", [("email", 0, 8)]),
    (f"555{NBSP}123{NBSP}4567", [("phone", 0, 12)]),
    ("4111 1111-1111 1112", []),
    ("mail a@b.co or c@d.co", [("email", 5, 11), ("email", 15, 21)]),
    ("⁠ a@b.co", [("email", 1, 7)]),
    ("a@b.com.x@y.com", [("email", 0, 7), ("email", 7, 15)]),
    ("no personal data here", []),
    ("", []),
]


def test_detection(texts):
    df = texts([t for t, _ in VECTORS] + [None])
    found = {i: [] for i in range(1, len(VECTORS) + 2)}
    rows = v.detect(df).select("id", F.posexplode("spans").alias("n", "s")).collect()
    for row in sorted(rows, key=lambda r: (r.id, r.n)):
        found[row.id].append((row.s.type, row.s.start, row.s.end))
    for i, (text, expected) in enumerate(VECTORS, 1):
        assert found[i] == expected, text
    assert found[len(VECTORS) + 1] == []


def test_unstripped_detection_sees_no_email_through_an_invisible_character(texts):
    df = texts([VECTORS[9][0], "x⁠ a@b.co ⁠1.2.3.4"])
    rows = v.detect_spans(df, ["id"], strip=False).collect()
    assert sorted((r.id, r.type, r.start, r.end) for r in rows) == [
        (2, "email", 3, 9),
        (2, "ipAddress", 11, 18),
    ]


def test_values_are_slices_of_the_stripped_text(texts):
    df = texts([t for t, _ in VECTORS])
    for row in v.detect(df).collect():
        for s in row.spans:
            assert row.text[s.start : s.end] == s.value


@pytest.mark.parametrize(
    "overlap, expected",
    [
        ("cover", ["[EMAIL]", "[EMAIL] tail", "[PHONE]"]),
        ("splice", ["[PHONE]", "[EMAIL]il", "[SSN]ONE]"]),
    ],
)
def test_overlapping_spans(texts, overlap, expected):
    df = texts([VECTORS[1][0], VECTORS[2][0], VECTORS[3][0]])
    rows = v.scrub_labels(df, overlap=overlap).orderBy("id").collect()
    assert [r.text for r in rows] == expected


def test_splice_of_tokens_damages_text_where_cover_does_not(texts):
    df = texts([VECTORS[1][0]])
    assert v.scrub_tokens(df, overlap="splice").first().text.endswith("]EMAIL_" + v.scrub_tokens(df).first().text[-9:-1] + "]")


def test_label_mapping_and_lossy_restore(texts):
    done = v.scrub_with_mapping(texts(["mail a@b.co or c@d.co, 1.2.3.4"]))
    row = done.first()
    assert row.text == "mail [EMAIL] or [EMAIL], [IP]"
    assert list(row.mapping.items()) == [("[EMAIL]", "a@b.co"), ("[IP]", "1.2.3.4")]
    assert v.restore_labels(done).first().text == "mail a@b.co or a@b.co, 1.2.3.4"


def test_label_restore_cascades_in_map_order(spark):
    df = spark.sql("SELECT '[EMAIL] [IP]' AS text, map('[EMAIL]', 'x[IP]', '[IP]', 'y') AS mapping")
    assert v.restore_labels(df).first().text == "xy y"


def test_mapping_follows_registry_order_without_extras_and_text_order_with(spark):
    df = spark.sql(
        "SELECT 1 AS id, '1.2.3.4 for Ann a@b.co' AS text, "
        "array(named_struct('type','person','value','Ann','start',12,'end',15)) AS extra"
    )
    plain = v.scrub_with_mapping(df).first().mapping
    merged = v.scrub_with_mapping(df, extra="extra").first().mapping
    assert list(plain) == ["[EMAIL]", "[IP]"]
    assert list(merged) == ["[IP]", "[NAME]", "[EMAIL]"]


def test_unknown_type_labels(spark):
    df = spark.sql(
        "SELECT 'abc def' AS text, array(named_struct('type','badge','value','abc','start',0,'end',3)) AS spans"
    )
    assert v.redact(df).first().text == "[BADGE] def"
    assert v.redact(df, mode="token").first().text.startswith("[REDACTED_BADGE_")


def test_entities_that_could_not_be_restored_are_rejected(spark):
    df = spark.sql(
        "SELECT 'abc def' AS text, array(named_struct('type','b_1','value','abc','start',0,'end',3)) AS spans"
    )
    with pytest.raises(Exception, match="entity must match"):
        v.redact(df, mode="token").collect()


def test_checks(spark):
    cards = spark.createDataFrame(
        [("4111-1111-1111-1111", True), ("4111 1111-1111 1112", False), ("4111", False)], "v string, ok boolean"
    )
    assert all(r.ok == r.got for r in cards.withColumn("got", is_card(F.col("v"))).collect())
    ips = spark.createDataFrame(
        [("1.2.3.4", True), ("001.002.003.255", True), ("1.2.3.256", False), ("1.2.3", False)], "v string, ok boolean"
    )
    assert all(r.ok == r.got for r in ips.withColumn("got", is_ipv4(F.col("v"))).collect())


def test_blank_and_invisible(texts):
    df = texts(["", "  \t", "　 ﻿", None, "a", "​", " b "])
    assert sorted(r.id for r in v.drop_blank(df).collect()) == [5, 6, 7]
    profile = v.invisible_profile(df.withColumn("g", F.lit("x")), ["g"]).first()
    assert (profile.texts, profile.texts_with_invisible, profile.removed_chars) == (7, 2, 2)


def test_all_invisible_characters_go_and_their_neighbours_stay(texts):
    gone = [*range(0x200B, 0x200E), 0x2060, 0xFEFF, 0xAD, 0x34F, 0x61C, 0x115F, 0x1160]
    gone += [0x17B4, 0x17B5, 0x180E, 0x3164, 0xFFA0, *range(0xE0020, 0xE0080)]
    stay = [0x200A, 0x200E, 0x2061, 0xAC, 0xAE, 0x34E, 0x350, 0xE0001, 0xE001F, 0xE0080, 0xFE0F]
    df = texts(["".join(map(chr, gone + stay))])
    assert v.strip_invisible(df).first().text == "".join(map(chr, stay))


def test_summary_counts_raw_matches(texts):
    rows = v.pii_summary(texts([VECTORS[3][0], "a@b.co c@d.co"]), ["id"]).collect()
    assert sorted(map(tuple, rows)) == [(1, "phone", 1), (1, "ssn", 1), (2, "email", 2)]


def test_detectors_test_cheap_characters_before_they_look_behind():
    """A look-behind at every position was most of a scan's time."""
    for kind in ("ssn", "creditCard", "zipCode", "ipAddress", "date"):
        assert java_pattern(kind).index(r"\d(?=") < java_pattern(kind).index("(?<!")


@pytest.mark.parametrize("kind", [k for k in TYPES if k != "email"])
def test_reordered_patterns_find_what_the_plain_ones_find(spark, kind):
    pieces = ["12", "345", "6789", "-", "/", ".", " ", "(", ")", "+1", "x", "_", "é", " "]
    rng = random.Random(kind)
    rows = ["".join(rng.choices(pieces, k=rng.randint(4, 40))) for _ in range(3000)]
    made = {
        "phone": "(555) 123-4567", "ssn": "123-45-6789", "creditCard": "4111-1111 1111-1111",
        "zipCode": "12345-6789", "ipAddress": "10.0.0.1", "date": "1/2/2024",
    }[kind]
    rows += [a + made + b for a in ["", *pieces] for b in ["", *pieces]]
    plain = COMPILED[kind]
    frame = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    found = v.candidate_spans(frame, ["id"], types=[kind], strip=False).collect()
    expected = {
        (i, m.start(), m.end()) for i, text in enumerate(rows) for m in plain.finditer(text)
    }
    assert {(r["id"], r["start"], r["end"]) for r in found} == expected and expected
