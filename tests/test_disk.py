"""What is sent and what is left on disk: texts are sent once at most, and spent tables go."""

import os

import pytest
from pyspark.sql import functions as F

import veilspan as v
from checks import queries
from veilspan.operators import restore, tables, vault as vaults
from veilspan.operators.lookup import attach_values
from veilspan.operators.restore import round_trip_check
from veilspan.operators.tables import cut_lineage
from veilspan.operators.vault import vault_entries

SF = "/root/testdata/sf0.001"
ROWS = [f"write to u{i}@x.co, call 555-123-{i:04d}" for i in range(300)] + ["none", None]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def fresh_folder(tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "work_folder", lambda spark: str(tmp_path))
    return tmp_path


def sent(df):
    """Shuffles of a plan that deal rows out by a key, but for the words of bitmaps."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return sum("Exchange hashpartitioning" in line and "_bit_word" not in line for line in lines)


def repaired(df):
    """A vault in which no value has its plain hash."""
    entries = vault_entries(df)
    earlier = v.build_vault(entries, "k").withColumn("value", F.concat("value", F.lit("?")))
    return v.build_vault(entries, "k", earlier)


def test_repaired_texts_are_sent_once(texts, no_broadcast):
    df = texts(ROWS)
    vault = repaired(df)
    scrubbed = v.scrub_tokens(df, secret="k", vault=vault)
    assert sent(scrubbed) == 2, "the texts, and the tokens of their rows"
    assert dict(v.restore_tokens(cut_lineage(scrubbed), vault).collect()) == dict(enumerate(ROWS, 1))


def test_few_repaired_texts_leave_the_others_where_they_are(spark, texts, no_broadcast):
    df = texts(ROWS)
    vault = v.build_vault(vault_entries(df), "k")
    odd = F.col("value").isin("u7@x.co", "u8@x.co")
    vault = vault.withColumn("token", F.when(odd, F.translate("token", "0123456789", "abcdefabcd")).otherwise(F.col("token")))
    scrubbed = v.scrub_tokens(df, secret="k", vault=vault)
    assert dict(v.restore_tokens(scrubbed, vault).collect()) == dict(enumerate(ROWS, 1))
    scrubbed._jdf.queryExecution().toRdd().count()
    plan = scrubbed._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    rows = []

    def walk(node):
        if node.getClass().getSimpleName() == "ShuffleQueryStageExec":
            rows.append(node.shuffle().metrics().apply("shuffleRecordsWritten").value())
            return
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    assert rows and sum(rows) <= 10, rows


def test_restored_texts_are_sent_once(texts, no_broadcast):
    df = texts(ROWS)
    vault = v.build_vault(vault_entries(df), "k")
    scrubbed = cut_lineage(v.scrub_tokens(df, secret="k", vault=vault))
    for hot_rows in (10, 1_000_000):
        restored = v.restore_tokens(scrubbed, vault.filter("entity <> 'phone'"), hot_rows=hot_rows)
        assert sent(restored) == 2, "the texts, and the values of their rows"
        assert restored.filter("text LIKE '%u7@x.co%[REDACTED_PHONE_%'").count() == 1


@pytest.mark.parametrize("repairs", [False, True])
def test_a_scrub_leaves_its_texts_and_vault_only(spark, fresh_folder, repairs):
    make = queries._scrubbed_with_repairs if repairs else queries._scrubbed
    scrubbed, vault = make(spark, SF)
    left = [set(spark.read.parquet(str(fresh_folder / name)).columns) for name in os.listdir(fresh_folder)]
    assert not any("_spans" in names for names in left)
    assert not any(names == {"session", "entity", "value"} for names in left)
    assert vault.count() and scrubbed.count()


def test_a_round_trip_sends_digests_as_bytes(spark, texts):
    df = texts(ROWS)
    plan = round_trip_check(df, df, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex(sha2(" in plan


def test_uses_of_tokens_are_written_before_they_are_dealt(spark, texts, monkeypatch):
    df = texts(ROWS)
    vault = v.build_vault(vault_entries(df), "k")
    scrubbed = cut_lineage(v.scrub_tokens(df, secret="k", vault=vault))
    first = []

    def seen(table, *args):
        first.append(sent(table))
        return cut_lineage(table, *args)

    monkeypatch.setattr(restore, "cut_lineage", seen)
    left = v.unresolved_tokens(scrubbed.union(scrubbed), vault.filter("entity <> 'email'"), ["id"])
    assert first[0] == 0, "one pass over the texts, no grouping by their keys"
    assert sorted({(r.occurrences, r.reason) for r in left.collect()}) == [(2, "unknown")]
    assert left.count() == 300


def test_values_come_in_order_with_gaps_and_long_keys(spark):
    long = "x" * 500
    rows = [(0, "s", ["a", "b", "c", "a"]), (1, "s", ["n", "n"]), (2, "t", ["a"]), (3, "s", ["n", long, "n", "c"])]
    df = cut_lineage(spark.createDataFrame(rows, "_row long, who string, keys array<string>"))
    table = [("s", "a", "1"), ("s", "c", "3"), ("s", "c", "3"), ("s", "b", "x"), ("s", "b", "y"), ("s", long, "9")]
    table = spark.createDataFrame(table, "session string, key string, value string")
    for hot_rows in (1, 1_000_000):
        got = attach_values(df, F.col("keys"), table, "who", "out", hot_rows).collect()
        assert {r._row: r.out for r in got} == {0: ["1", None, "3", "1"], 1: None, 2: None, 3: [None, "9", None, "3"]}


def test_long_values_are_told_apart(spark, texts, monkeypatch):
    real = vaults.token_of

    def short(*args):
        token = real(*args)
        return F.concat(F.left(token, F.length(token) - 7), F.lit("000000]"))

    monkeypatch.setattr(vaults, "token_of", short)
    rows = [f"{'long.name' * 9}{i}@x.co and u{i}@x.co" for i in range(60)]
    df = texts(rows)
    vault = v.build_vault(vault_entries(df))
    scrubbed = v.scrub_tokens(df, vault=vault)
    assert dict(v.restore_tokens(scrubbed, vault).collect()) == dict(enumerate(rows, 1))


def test_restore_keeps_columns_that_files_do_not_hold(spark, texts):
    df = texts(["a@b.co", "none"]).withColumns({"_row": F.lit("mine"), "nothing": F.lit(None)})
    vault = v.build_vault(vault_entries(df))
    restored = v.restore_tokens(v.scrub_tokens(df.select("id", "text"), vault=vault).withColumns({"_row": F.lit("mine"), "nothing": F.lit(None)}), vault)
    assert sorted(map(tuple, restored.collect())) == [(1, "a@b.co", "mine", None), (2, "none", "mine", None)]
