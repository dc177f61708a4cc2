import pytest

import corpus_pipeline
from veilspan.llm import common

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], COLUMNS)


PASSAGE = " ".join(f"p{k}" for k in range(60))
BASE = " ".join(f"w{k}" for k in range(80))
ROWS = [
    (1, f"first text of all\n{PASSAGE}"), (2, f"second one here\n{PASSAGE}\nand its end"), (3, BASE), (4, BASE.replace("w40", "q")),
    (5, "write to ana@example.com"), (6, None), (7, ""), (None, "no id at all"), (8, "clean text without anything"), (8, "clean text without anything"),
    (9, "word " * 5000),
]


@pytest.fixture(scope="module")
def kept(spark):
    return {}


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "pii", "packing"]


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    rows = [(i, f"{'you idiot' if i % 4 == 0 else 'dear friend'} number {i}.") for i in range(200)]
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs_of(spark, rows)
    left = stage("toxicity")(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [i for i, _ in rows if i % 4]


def test_repeated_passages_are_cut(spark):
    docs = docs_of(spark, ROWS)
    left = stage("line_dedup")(spark, docs, "")
    by = {r.doc_id: r for r in left.collect()}
    assert left.columns == docs.columns and left.count() == len(ROWS)
    assert by[1].text == ROWS[0][1] and by[2].text == "second one here\nand its end" and by[2].n_chars == len(by[2].text)
    assert by[6].text is None and by[8].text == "clean text without anything"


def test_one_of_each_near_duplicate_group_stays(spark):
    docs = docs_of(spark, ROWS)
    left = stage("jaccard_join")(spark, docs, "")
    ids = sorted([r.doc_id for r in left.collect()], key=repr)
    assert left.columns == docs.columns and ids == sorted([1, 3, 5, 6, 7, None, 8, 8, 9], key=repr)


def test_personal_data_is_masked(spark):
    docs = docs_of(spark, ROWS)
    by = {r.doc_id: r for r in stage("pii")(spark, docs, "").collect()}
    assert by[5].text == "write to [EMAIL]" and by[5].n_chars == 16 and by[6].text is None
    assert by[9].text == ROWS[-1][1]


def test_all_stages_over_a_table_and_an_empty_one(spark, sf_dir, tmp_path):
    found = corpus_pipeline.run(spark, sf_dir)
    ids = {r.doc_id for r in found.select("doc_id").distinct().collect()}
    n = common.table(spark, sf_dir, "documents").count()
    assert 0.7 * n < len(ids) < n
    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["jaccard_join", "pii", "packing"])
def test_python_workers_get_few_texts_at_once(spark, name):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 10_000)
    try:
        stage(name)(spark, docs_of(spark, ROWS[:4]), "")
        rows = spark.range(2_000, numPartitions=1)
        sizes = rows.mapInPandas(lambda batches: (b.iloc[:1].assign(id=len(b)) for b in batches), "id long").collect()
        assert sum(r.id for r in sizes) == 2_000 and max(r.id for r in sizes) <= common.ROWS
        spark.conf.set(key, 100)
        common.small_batches(spark)
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, before)
