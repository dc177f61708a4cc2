import random

import pytest
from pyspark.sql import functions as F

import veilspan as v
from veilspan.operators.entities import _places, entities_of, entity_spans

TOKENS = "id int, idx int, entity string, word string, score double"
BIO = [
    ("B-PER", "John", 0.9), ("I-PER", "Smith", 0.7), ("I-ORG", "X", 0.9), ("I-ORG", "Y", 0.9),
    ("B-ORG", "Ac", 0.9), ("I-ORG", "##me", 0.8), ("PER", "q", 0.9), ("I-PER", "z", 0.9),
    ("O", "in", 0.9), ("B-LOC", "Paris", 0.99),
]
EXPECTED = [("person", "John Smith", 0.7), ("org", "Acme", 0.8), ("location", "Paris", 0.99)]


def token_table(spark, rows=BIO):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], TOKENS)


def test_grouping(spark):
    got = v.aggregate_entities(token_table(spark), ["id"]).orderBy("ord").collect()
    assert [(r.type, r.value, r.score) for r in got] == EXPECTED


def test_grouping_inside_a_row_agrees_on_random_tags(spark):
    rng = random.Random(2)
    tags = ["B-PER", "I-PER", "I-PERSON", "B-ORG", "I-ORG", "PER", "O", "I-FOO", "B-FOO"]
    rows = [
        (doc, i, rng.choice(tags), rng.choice(["a", "##b", "c", "##"]), rng.random())
        for doc in range(300)
        for i in range(rng.randint(1, 12))
    ]
    table = spark.createDataFrame(rows, TOKENS)
    window = {}
    for r in v.aggregate_entities(table, ["id"]).orderBy("id", "ord").collect():
        window.setdefault(r.id, []).append((r.type, r.value, r.score))
    arrays = table.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "entity", "word", "score"))).alias("t")
    )
    got = arrays.select("id", entities_of(F.col("t")).alias("e")).collect()
    for row in got:
        assert [tuple(e) for e in row.e] == window.get(row.id, [])
        assert [tuple(e) for e in row.e] == bio([r[2:] for r in rows if r[0] == row.id])


def bio(tokens):
    names = {"PER": "person", "PERSON": "person", "ORG": "org"}
    out, current = [], None
    for tag, word, score in tokens:
        if tag == "O":
            continue
        base = tag[2:] if tag[:2] in ("B-", "I-") else tag
        kind = names.get(base, base.lower())
        bare = word.removeprefix("##")
        if tag.startswith("B-"):
            if current:
                out.append(tuple(current))
            current = [kind, bare, score]
        elif tag.startswith("I-") and current and current[0] == kind:
            current[1] += bare if word.startswith("##") else " " + bare
            current[2] = min(current[2], score)
        else:
            if current:
                out.append(tuple(current))
            current = None
    return out + ([tuple(current)] if current else [])


def test_places_against_a_full_search():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 30)))
        values = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 4))) for _ in range(8)]
        taken, expected = [], []
        for value in values:
            word, at, place = value.strip(), 0, None
            while word:
                i = text.find(word, at)
                if i < 0:
                    break
                if not any(i < e and i + len(word) > s for s, e in taken):
                    place = i
                    taken.append((i, i + len(word)))
                    break
                at = i + len(word)
            expected.append(place)
        assert _places(text, values) == expected


def test_locating_and_filtering(spark, texts):
    df = texts(["Ann met Ann at Q. 😀 Bo", "nobody"])
    entities = spark.createDataFrame(
        [(1, 0, "person", "Ann", 0.9), (1, 1, "person", "Ann", 0.9), (1, 2, "person", "Ann", 0.9),
         (1, 3, "org", "Q", 0.9), (1, 4, "foo", "met", 0.9), (1, 5, "person", " Bo ", 0.3), (2, 0, "org", "X", 1.0)],
        "id int, ord int, type string, value string, score double",
    )
    placed = v.locate_entities(entities, df, ["id"])
    rows = [(r.ord, r.start, r.end) for r in placed.orderBy("ord").collect()]
    assert rows == [(0, 0, 3), (1, 8, 11), (3, 15, 16), (4, 4, 7), (5, 20, 22)]
    assert sorted(r.ord for r in v.filter_entities(placed).collect()) == [0, 1, 5]
    assert v.min_score(entities).count() == 7
    assert v.min_score(entities, 0.5).count() == 6


def test_row_and_table_forms_agree(spark, texts):
    df = texts(["John Smith of Acme in Paris"])
    tokens = token_table(spark).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "entity", "word", "score"))).alias("t")
    )
    row = df.join(
        tokens.select("id", F.transform("t", lambda x: F.struct(x["entity"], x["word"], x["score"], x["idx"])).cast(
            "array<struct<entity:string,word:string,score:double,idx:int>>").alias("tokens")),
        "id",
    )
    spans = [tuple(s) for s in entity_spans(row).first().extra]
    table = v.filter_entities(v.locate_entities(v.aggregate_entities(token_table(spark), ["id"]), df, ["id"]))
    assert spans == [(r.type, r.value, r.start, r.end) for r in table.orderBy("ord").collect()]


def names():
    def tag(batch):
        if any("boom" in t for t in batch):
            raise ValueError("cannot tag")
        return [
            [("B-PER" if w.istitle() else "O", w, 0.9, i) for i, w in enumerate(t.split())] for t in batch
        ]

    return tag


def test_tagger_failures_are_counted_and_others_still_tagged(texts):
    tagged = v.tag_entities(texts(["Ann goes", "Bob boom", None, "  ", "Eve"], 1), names)
    rows = {r.id: r for r in tagged.collect()}
    assert [t.word for t in rows[1].tokens] == ["Ann"]
    assert [t.word for t in rows[5].tokens] == ["Eve"]
    assert rows[2].tokens == [] and rows[3].tokens == [] and rows[4].tokens == []
    assert [(r.id, r.ner_error) for r in v.ner_errors(tagged, ["id"]).collect()] == [
        (2, "ValueError: cannot tag")
    ]


def test_scrub_with_entities(texts):
    df = texts(["Ann wrote to a@b.co", "Bob boom 1.2.3.4"])
    rows = {r.id: r for r in v.scrub_with_ner(df, names).collect()}
    assert rows[1].text.startswith("[REDACTED_NAME_") and "a@b.co" not in rows[1].text
    assert rows[2].text.startswith("Bob boom [REDACTED_IP_") and rows[2].ner_error
    plain = v.scrub_with_ner(df, None)
    assert plain.columns == ["id", "text"] and "Ann" in plain.filter("id = 1").first().text


def test_entity_inside_an_email_is_dropped_but_flags_its_type(spark, texts):
    base = v.detect_spans(texts(["u@example.com and example.com"]), ["id"])
    extra = spark.createDataFrame(
        [(1, 0, "org", "example.com", 2, 13)], "id int, ord int, type string, value string, start int, end int"
    )
    from veilspan.operators.spans import merge_span_tables
    from veilspan.operators.summary import summarize_spans

    merged = merge_span_tables(base, extra, ["id"])
    summary = v.summary_with_source(summarize_spans(merged, ["id"]), extra, ["id"])
    assert [tuple(r) for r in summary.collect()] == [(1, "email", 1, False)]
    far = extra.withColumn("start", F.lit(18)).withColumn("end", F.lit(29))
    merged = merge_span_tables(base, far.unionByName(extra), ["id"])
    summary = v.summary_with_source(summarize_spans(merged, ["id"]), far, ["id"])
    assert sorted(map(tuple, summary.collect())) == [(1, "email", 1, False), (1, "org", 1, True)]


@pytest.mark.parametrize("value, kept", [("x", False), ("xy", True), ("😀", True)])
def test_length_counts_utf16_units(spark, value, kept):
    df = spark.createDataFrame([("person", value)], "type string, value string")
    assert v.filter_entities(df).count() == int(kept)
