"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

import veilspan as v
from veilspan.functions.patterns import java_pattern
from veilspan.operators.tables import cut_lineage, work_folder
from veilspan.operators.vault import vault_entries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.range(100).select(
        "id", F.concat(F.lit("mail a@b.co "), "id").alias("text"), F.lit("en").alias("lang"), F.lit(1).alias("unused")
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(
    "job",
    [
        lambda t: v.detect_spans(t, ["id"]),
        lambda t: v.pii_summary(t, ["id"]),
        lambda t: v.scrub_labels(t.select("id", "text")),
        lambda t: v.scrub_with_mapping(t.select("id", "text")),
        lambda t: v.scrub_tokens(t.select("id", "text")),
        lambda t: v.has_pii(t.select("id", "text")),
        lambda t: v.cover_spans(v.detect(t.select("id", "text"))),
    ],
)
def test_one_narrow_stage_reading_two_columns(table, job):
    text = plan(job(table))
    assert "Exchange" not in text and "Join" not in text and "Python" not in text
    assert "unused" not in text and "lang" not in text


@pytest.mark.parametrize(
    "job",
    [
        lambda t: v.detect(t).filter(F.size("spans") > 0),
        lambda t: v.scrub_labels(t).filter(F.col("text") != ""),
        lambda t: v.scrub_tokens(t).filter(F.col("text").contains("[REDACTED")),
        lambda t: vault_entries(t),
    ],
)
def test_later_filters_do_not_repeat_the_scan(table, job):
    text = job(table.select("id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count(f", {java_pattern('ssn')}, ⁠$0⁠, 1)") == 1


def test_filters_on_keys_reach_the_files(table):
    text = plan(v.detect_spans(table, ["id", "lang"]).filter("id = 3 AND lang = 'en'"))
    assert "EqualTo(id,3)" in text and "EqualTo(lang,en)" in text


def test_report_aggregates_before_it_shuffles(table):
    text = plan(v.pii_report(table, ["lang"]))
    assert "Expand" not in text and "partial_count" in text
    assert text.count("Exchange") == 2


def test_restore_joins_without_a_cross_join(spark, table):
    texts = table.select("id", "text")
    vault = v.build_vault(vault_entries(texts))
    scrubbed = cut_lineage(v.scrub_tokens(texts, vault=vault))
    for hot_rows in (10, 1_000_000):
        text = plan(v.restore_tokens(scrubbed, vault, hot_rows=hot_rows))
        assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text
        assert "Union" in text


def test_results_do_not_depend_on_partitions(table):
    texts = table.select("id", "text")
    one = dict(v.scrub_tokens(texts.repartition(1)).collect())
    assert one == dict(v.scrub_tokens(texts.repartition(7)).collect())


def test_work_folder_comes_from_the_session(spark):
    assert work_folder(spark) == spark.conf.get("spark.checkpoint.dir")
