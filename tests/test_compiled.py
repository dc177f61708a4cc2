"""The scans run in compiled projections, and what Spark interprets stands apart from them."""

import pytest
from pyspark.sql import functions as F

import veilspan as v
from veilspan.functions.patterns import java_pattern


@pytest.mark.parametrize(
    "job",
    [
        lambda t: v.detect_spans(t, ["id"]),
        lambda t: v.cover_spans(v.detect(t)),
        lambda t: v.span_pairs(v.detect(t), ["id"]),
        lambda t: v.redact(v.detect(t), overlap="splice"),
        lambda t: v.label_mapping(v.scrub_with_mapping(t), ["id"]),
        lambda t: v.pii_report(t, ["id"]),
    ],
)
def test_scans_are_compiled(texts, job):
    lines = job(texts(["a@b.co 123-45-6789"]))._jdf.queryExecution().toString().splitlines()
    physical = lines[lines.index("== Physical Plan ==") :]
    scans = [line for line in physical if java_pattern("ssn") in line]
    assert len(scans) == 1 and "Project" in scans[0].split("[")[0]
    assert "lambda" not in scans[0]


def test_one_several_and_failing_matches(texts):
    rows = [
        "1.2.3.4", "1.2.3.400", "1.2.3.4 5.6.7.8 1.2.3.999", None, "",
        "4111-1111-1111-1111", "4111-1111-1111-1112", "é a@b.co, c@d.co 01/02/2020",
    ]
    found = v.detect_spans(texts(rows), ["id"]).select("id", "type", "start", "end")
    report = v.pii_report(texts(rows).withColumn("k", F.lit(1)), ["k"])
    assert sorted(map(tuple, found.filter("type <> 'phone'").collect())) == [
        (1, "ipAddress", 0, 7), (3, "ipAddress", 0, 7), (3, "ipAddress", 8, 15),
        (6, "creditCard", 0, 19), (8, "date", 17, 27), (8, "email", 2, 8), (8, "email", 10, 16),
    ]
    kept = report.filter("type IN ('ipAddress', 'creditCard', 'email')").collect()
    assert {r["type"]: (r["count"], r["distinct_values"], r["texts"]) for r in kept} == {
        "ipAddress": (3, 2, 2), "creditCard": (1, 1, 1), "email": (2, 2, 1),
    }


def test_marks_in_unstripped_texts(texts):
    found = v.detect(texts(["a⁠b 123-45-6789⁠"]), strip=False)
    spans = found.select(F.inline("spans")).collect()
    assert [(r["type"], r["start"], r["end"]) for r in spans] == [("ssn", 4, 15)]
