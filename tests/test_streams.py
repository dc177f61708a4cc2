import pytest
from pyspark.sql import functions as F

import veilspan as v
from checks import queries
from veilspan.operators.vault import vault_entries
from veilspan.sources.texts import stream_texts
from veilspan.sources.vaults import add_entries
from veilspan.streaming.streams import scrub_token_stream

SCHEMA = "id int, text string"


@pytest.fixture
def inbox(spark, tmp_path):
    """Two files, so that two micro-batches arrive."""
    path = str(tmp_path / "in")
    rows = [(i, f"mail u{i % 5}@x.co​ ip 10.0.0.{i}") for i in range(40)]
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return stream_texts(spark, path, SCHEMA, keys=["id"], options={"maxFilesPerTrigger": "1"})


def finish(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_label_stream_equals_batch(spark, inbox, tmp_path):
    out = str(tmp_path / "out")
    writer = v.scrub_stream(stream(spark, inbox)).writeStream.format("parquet")
    writer.option("checkpointLocation", str(tmp_path / "c")).option("path", out)
    finish(writer)
    batch = v.scrub_labels(spark.read.parquet(inbox))
    assert dict(spark.read.parquet(out).collect()) == dict(batch.collect())


def test_token_stream_equals_batch_and_restores(spark, inbox, tmp_path):
    out, vault, back = (str(tmp_path / n) for n in ("out", "vault", "back"))
    finish(scrub_token_stream(stream(spark, inbox), out, vault, str(tmp_path / "c1"), secret="s"))
    scrubbed = spark.read.parquet(out)
    assert scrubbed.select("batch_id").distinct().count() == 2
    batch = v.scrub_tokens(spark.read.parquet(inbox), secret="s")
    assert dict(scrubbed.select("id", "text").collect()) == dict(batch.collect())
    replies = spark.readStream.schema(SCHEMA).parquet(out).select("id", "text")
    finish(v.restore_stream(replies, back, vault, str(tmp_path / "c2"), require_mapping=True))
    restored = spark.read.parquet(back).select("id", "text")
    assert v.round_trip_check(spark.read.parquet(inbox), restored, ["id"]).isEmpty()


def test_replayed_batches_leave_the_vault_unchanged(spark, inbox, tmp_path):
    path = str(tmp_path / "vault")
    finish(v.vault_stream(stream(spark, inbox), path, str(tmp_path / "c1"), secret="s"))
    first = sorted(map(tuple, v.load_vault(spark, path).collect()))
    finish(v.vault_stream(stream(spark, inbox), path, str(tmp_path / "c2"), secret="s"))
    add_entries(spark, vault_entries(spark.read.parquet(inbox)), path, "s")
    assert sorted(map(tuple, v.load_vault(spark, path).collect())) == first
    assert len(first) == 45
    batch = v.build_vault(vault_entries(spark.read.parquet(inbox)), "s")
    assert sorted(map(tuple, batch.collect())) == first


def test_restore_needs_a_mapping_when_asked(spark, inbox, tmp_path):
    writer = v.restore_stream(
        stream(spark, inbox), str(tmp_path / "o"), str(tmp_path / "none"), str(tmp_path / "c"), require_mapping=True
    )
    with pytest.raises(Exception, match="no mapping"):
        finish(writer)


def test_running_summary(spark, inbox, tmp_path):
    seen = []

    def keep(batch, _):
        seen.append({r.type: r["count"] for r in batch.collect()})

    writer = v.summary_stream(stream(spark, inbox)).writeStream.outputMode("complete")
    finish(writer.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")))
    assert seen[-1] == {"email": 40, "ipAddress": 40}
    assert seen[0] == {"email": 20, "ipAddress": 20}


def test_files(spark, tmp_path):
    rows = [(1, "a@b.co", "x"), (2, None, "y")]
    df = spark.createDataFrame(rows, "id int, body string, lang string")
    for fmt in ("parquet", "orc", "json"):
        path = str(tmp_path / fmt)
        df.write.format(fmt).save(path)
        got = v.read_texts(spark, path, fmt, "body", ["id"], schema="id int, body string, lang string")
        assert sorted(map(tuple, got.collect())) == [(1, "a@b.co"), (2, None)]
        assert got.columns == ["id", "text"]
    lines = str(tmp_path / "lines")
    df.select("body").filter("body is not null").write.text(lines)
    assert v.read_texts(spark, lines, "text").first().text == "a@b.co"
    out = str(tmp_path / "out")
    v.write_scrubbed(v.scrub_labels(df, "body"), out, partition_by=["lang"])
    back = spark.read.parquet(out)
    assert {(r.id, r.body, r.lang) for r in back.collect()} == {(1, "[EMAIL]", "x"), (2, None, "y")}
    with pytest.raises(Exception, match="already exists"):
        v.write_scrubbed(df, out)
    assert spark.read.parquet(out).filter(F.col("body").isNull()).count() == 1


def test_document_streams_read_a_table_of_many_files(spark, sf_dir, tmp_path):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).coalesce(1).cache()
    found = {}
    for name, files in (("one", 1), ("many", 3)):
        folder = tmp_path / name
        if files == 1:
            folder.mkdir()
            documents.toPandas().to_parquet(folder / "documents.parquet")
        else:
            documents.repartition(files).write.parquet(str(folder / "documents.parquet"))
        found[name] = {tuple(r) for r in queries.scrub_stream(spark, str(folder)).collect()}
        counts = {tuple(r) for r in queries.summary_stream(spark, str(folder)).collect()}
        spans = v.detect_spans(documents, [])
        assert counts == {tuple(r) for r in spans.groupBy("type").count().collect()}
    assert found["one"] == found["many"] and len(found["one"]) == 60
