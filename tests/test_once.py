"""Spans are found once, and the vault is read and written by buckets."""

import os

import pytest
from pyspark.sql import functions as F

import veilspan as v
from veilspan.functions.patterns import java_pattern
from veilspan.operators.scrub import found_entries, found_spans, scrub_found
from veilspan.operators.vault import VAULT_SCHEMA, vault_entries
from veilspan.sources import vaults
from veilspan.sources.vaults import BUCKETS, add_entries
from veilspan.streaming.streams import scrub_token_stream

NAMES = [f"Name{chr(97 + i)}" for i in range(8)]
ROWS = [(i, f"{n} wrote to u{i % 3}@x.co", f"s{i % 2}") for i, n in enumerate(NAMES)] + [(8, None, "s0"), (9, " ", "s1"), (10, "nothing", "s0")]


def failing(folder, fails):
    """A tagger that fails on calls as ``fails(number of calls so far)`` says; calls leave files."""

    def build():
        def tag(texts):
            import re
            import tempfile

            count = len(os.listdir(folder))
            tempfile.mkstemp(dir=folder)
            if fails(count):
                raise TimeoutError("no answer")
            return [[("B-PER", m.group(), 0.9, i) for i, m in enumerate(re.finditer(r"Name[a-h]", t))] for t in texts]

        return tag

    return build


@pytest.fixture
def calls(tmp_path):
    path = tmp_path / "calls"
    path.mkdir()
    return str(path)


@pytest.mark.parametrize("fails", [lambda n: n == 0, lambda n: n < 3, lambda n: n >= 9, lambda n: n % 2 == 0], ids=["first", "early", "late", "every other"])
def test_a_tagger_that_fails_now_and_then_loses_and_leaks_nothing(spark, tmp_path, calls, fails):
    df = spark.createDataFrame(ROWS, "id int, text string, who string").coalesce(1)
    path = str(tmp_path / "vault")
    done = v.scrub_with_ner_to_vault(df, failing(calls, fails), path, F.col("who"), "k")
    ran = len(os.listdir(calls))
    rows = {r.id: r for r in done.collect()}
    assert done.count() == len(ROWS) == len(rows)
    assert len(os.listdir(calls)) == ran, "an action must not run the tagger again"
    assert ran <= 1 + 9, "once for the batch, and once for each of its texts when that failed"
    for i, text, _ in ROWS[:8]:
        named = "Name" in rows[i].text
        assert named == (rows[i].ner_error is not None), "a name may stay only beside an error"
        assert "@x.co" not in rows[i].text
    assert [rows[i].text for i in (8, 9, 10)] == [None, " ", "nothing"]
    vault = v.load_vault(spark, path)
    back = v.restore_tokens(done.select("id", "text", "who"), vault, F.col("who"))
    assert {r.id: r.text for r in back.collect()} == {i: t for i, t, _ in ROWS}


def test_with_a_given_vault_the_tagger_runs_once(spark, tmp_path, calls):
    df = spark.createDataFrame(ROWS, "id int, text string, who string").coalesce(1)
    path = str(tmp_path / "vault")
    v.scrub_with_ner_to_vault(df, failing(calls, lambda n: False), path, secret="k").count()
    before = len(os.listdir(calls))
    done = v.scrub_with_ner(df, failing(calls, lambda n: False), secret="k", vault=v.load_vault(spark, path))
    assert done.count() == len(ROWS) and done.filter("text LIKE '%Name%'").isEmpty()
    assert len(os.listdir(calls)) == before + 1


def test_patterns_run_once_and_leave_the_later_plans(spark, texts):
    df = texts([f"u{i}@x.co 123-45-678{i}" for i in range(9)] + [None, "none"])
    found = found_spans(df)
    entries = found_entries(found)
    vault = v.build_vault(entries)
    done = scrub_found(found, entries, vault)
    for frame in (found, entries, vault, done):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert java_pattern("ssn") not in plan
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, v.scrub_tokens(df, vault=vault).collect()))
    assert done.count() == 11


def entries_of(spark, sessions, values=3):
    rows = [(f"s{s}", "email", f"u{i}@x.co") for s in sessions for i in range(values)]
    return spark.createDataFrame(rows, "session string, entity string, value string")


def selected_files(spark, df):
    """How many files the scans of a plan read, by their metrics after a run."""
    df._jdf.queryExecution().toRdd().count()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains("numFiles"):
            total += metrics.apply("numFiles").value()
    return total


def test_a_load_for_some_sessions_reads_their_files_only(spark, tmp_path):
    path = str(tmp_path / "vault")
    add_entries(spark, entries_of(spark, range(400)), path, "k")
    files = v.load_vault(spark, path).inputFiles()
    assert 150 < len(files) <= BUCKETS
    some = entries_of(spark, range(4))
    part = v.load_vault(spark, path, among=some)
    assert selected_files(spark, part) <= 4
    assert selected_files(spark, v.load_vault(spark, path, session="s7")) == 1
    assert selected_files(spark, v.load_vault(spark, path)) == len(files)
    assert part.join(some, ["session", "entity", "value"], "left_semi").count() == 12
    assert v.load_vault(spark, path).count() == 1200
    assert "bucket" not in part.columns


def test_appends_leave_a_bounded_number_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vaults, "MOST_FILES", 3)
    path = str(tmp_path / "vault")
    for n in range(10):
        add_entries(spark, entries_of(spark, [1, 2], values=n + 1), path, "k")
        assert len(v.load_vault(spark, path).inputFiles()) <= 2 * 3
    vault = v.load_vault(spark, path)
    assert vault.count() == 20 and vault.select("token").distinct().count() == 20


def test_a_crash_in_compaction_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "vault")
    for n in (2, 4):
        add_entries(spark, entries_of(spark, [1], values=n), path, "k")
    whole = sorted(map(tuple, v.load_vault(spark, path).collect()))
    # The new file is there and the old ones are not deleted yet.
    v.load_vault(spark, path).withColumn("bucket", vaults.bucket_of(F.col("session"))).coalesce(1).write.partitionBy("bucket").mode("append").parquet(path)
    assert sorted(set(map(tuple, v.load_vault(spark, path).collect()))) == whole
    add_entries(spark, entries_of(spark, [1], values=4), path, "k")
    df = spark.createDataFrame([("u1@x.co u3@x.co",)], "text string")
    scrubbed = v.scrub_tokens(df, "s1", "k", v.load_vault(spark, path))
    assert v.restore_tokens(scrubbed, v.load_vault(spark, path), "s1").first().text == "u1@x.co u3@x.co"
    assert v.compact_vault(spark, path) == 1
    assert sorted(map(tuple, v.load_vault(spark, path).collect())) == whole
    assert v.compact_vault(spark, path) == 0


def test_a_hot_session_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vaults, "FILE_ROWS", 100)
    path = str(tmp_path / "vault")
    # Tasks with next to nothing to write would be put together.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        add_entries(spark, entries_of(spark, [1], values=1000), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(v.load_vault(spark, path).inputFiles()) > 1
    assert v.load_vault(spark, path).count() == 1000


def test_a_vault_without_buckets_moves_into_them(spark, tmp_path):
    path = str(tmp_path / "vault")
    old = v.build_vault(entries_of(spark, range(3)), "k")
    old.write.parquet(path)
    assert v.load_vault(spark, path, session="s1").count() == 3
    assert v.load_vault(spark, path, among=entries_of(spark, [1])).filter("session = 's1'").count() == 3
    add_entries(spark, entries_of(spark, range(4)), path, "k")
    assert v.load_vault(spark, path).count() == 12
    assert all("/bucket=" in f for f in v.load_vault(spark, path).inputFiles())


def test_overwriting_replaces_every_bucket(spark, tmp_path):
    path = str(tmp_path / "vault")
    v.save_vault(v.build_vault(entries_of(spark, range(5))), path)
    v.save_vault(v.load_vault(spark, path).filter("session = 's2'"), path, "overwrite")
    assert {r.session for r in v.load_vault(spark, path).collect()} == {"s2"}
    v.save_vault(spark.createDataFrame([], VAULT_SCHEMA), path, "overwrite")
    assert v.load_vault(spark, path).isEmpty()
    with pytest.raises(v.NoMapping):
        v.load_vault(spark, path, require_mapping=True)


SCHEMA = "id int, text string, who string"


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(path)


def test_known_values_read_no_vault_file(spark, tmp_path, monkeypatch):
    inbox, path = str(tmp_path / "in"), str(tmp_path / "vault")
    rows = [(i, f"mail u{i % 4}@x.co", f"s{i % 2}") for i in range(12)]
    for _ in range(3):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
    reads = []
    real = vaults.load_vault
    monkeypatch.setattr(vaults, "load_vault", lambda *a, **k: reads.append(1) or real(*a, **k))
    writer = v.vault_stream(stream(spark, inbox), path, str(tmp_path / "c"), F.col("who"), "k")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    assert len(reads) == 2, "before and after the only batch with new values"
    batch = v.build_vault(vault_entries(spark.read.parquet(inbox), F.col("who")), "k")
    assert sorted(map(tuple, v.load_vault(spark, path).collect())) == sorted(map(tuple, batch.collect()))


def test_token_stream_with_entities_and_sessions(spark, tmp_path, calls):
    inbox, path, out = (str(tmp_path / n) for n in ("in", "vault", "out"))
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(inbox)
    tagger = failing(calls, lambda n: False)
    writer = scrub_token_stream(stream(spark, inbox), out, path, str(tmp_path / "c1"), F.col("who"), "k", tagger=tagger)
    writer.trigger(availableNow=True).start().awaitTermination()
    scrubbed = spark.read.parquet(out)
    assert scrubbed.filter("text LIKE '%Name%' OR text LIKE '%@%'").isEmpty()
    assert scrubbed.count() == len(ROWS) and scrubbed.filter("ner_error IS NOT NULL").isEmpty()
    replies = spark.readStream.schema(SCHEMA).parquet(out).select("id", "text", "who")
    back = str(tmp_path / "back")
    v.restore_stream(replies, back, path, str(tmp_path / "c2"), F.col("who")).trigger(availableNow=True).start().awaitTermination()
    assert {r.id: r.text for r in spark.read.parquet(back).collect()} == {i: t for i, t, _ in ROWS}
