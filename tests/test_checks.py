"""The checks against plain Python, the form of the patterns, and how the prompts are dealt out."""

import random
import re

import pytest
from pyspark.sql import functions as F

from checks.fixtures import TASKS_PER_CORE, prompts
from veilspan.functions.checks import is_card, is_ipv4
from veilspan.functions.patterns import DIGIT_GATE, TYPES, java_pattern


def luhn(value):
    digits = [int(c) for c in value if not re.match(r"[-\s﻿]", c)][::-1]
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
    return 13 <= len(digits) <= 19 and total % 10 == 0


def test_cards(spark):
    deal = random.Random(3)
    values = ["", "-", "4111-1111-1111-1111", "9" * 19, "0" * 13, "4111 1111　1111﻿1111"]
    for size in range(11, 22):
        values += ["".join(deal.choices("0123456789", k=size)) for _ in range(60)]
    values += ["-".join(v[i : i + 4] for i in range(0, len(v), 4)) for v in values[6:]]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.ok for r in rows.select("v", is_card(F.col("v")).alias("ok")).collect()}
    assert got == {v: luhn(v) for v in values}
    assert sum(got.values()) > 50


def test_values_that_are_no_numbers_fail_the_checks(spark):
    rows = spark.createDataFrame([("a@b.example.com",), ("1.2.3.x",), (None,)], "v string")
    got = rows.select(is_card(F.col("v")).alias("c"), is_ipv4(F.col("v")).alias("i")).collect()
    assert [tuple(r) for r in got] == [(False, False), (False, False), (None, None)]


def test_addresses(spark):
    parts = ["0", "00", "007", "1", "99", "100", "199", "249", "250", "255", "256", "300", "999"]
    values = [f"{a}.{b}.1.{a}" for a in parts for b in parts] + ["1.2.3", "1.2.3.4.5", "1.2.3.4\n"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.ok for r in rows.select("v", is_ipv4(F.col("v")).alias("ok")).collect()}

    def right(v):
        return bool(re.fullmatch(r"\d+(\.\d+){3}", v)) and all(int(p) < 256 for p in v.split("."))

    assert got == {v: right(v) for v in values}


@pytest.mark.parametrize("pattern", [*map(java_pattern, TYPES), DIGIT_GATE])
def test_patterns_hold_no_slow_classes(pattern):
    assert not re.search(r"[a-zA-Z0-9]-[a-zA-Z0-9]|\\d(?!\(\?=)", pattern)


def test_prompts_go_to_several_tasks_a_core(spark):
    cores = spark.sparkContext.defaultParallelism
    made = prompts(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() == TASKS_PER_CORE * cores
