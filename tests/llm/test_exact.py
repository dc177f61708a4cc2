import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspan.llm import exact


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for whole, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        digest = hashlib.sha256(whole.encode()).hexdigest()
        out += [(i, keep, len(members), i == keep, digest) for i, _ in members]
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["a", "b", "ab", "é", " ", "\n", "\t"]
    made = [(i, "".join(rng.choice(words) for _ in range(rng.randint(0, 5)))) for i in range(150)]
    return [*made, (200, None), (201, ""), (202, " \n"), (None, "ab"), (7, made[7][1]), (203, "x" * 50_000), (204, "x " * 50_000)]


def table(spark, rows, path, files=3):
    frame = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, digest string, length_ int")
    frame.repartition(files).write.parquet(path)
    return path


def answers(df):
    return sorted(map(repr, [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()]))


def test_against_brute_force_over_several_batches(spark, rows, tmp_path):
    path = table(spark, rows, f"{tmp_path}/documents.parquet")
    assert answers(exact.exact_duplicates(spark, path, files_per_batch=1)) == brute(rows)


def test_bytes_decide_when_digests_clash(spark, rows, tmp_path):
    path = table(spark, rows, f"{tmp_path}/documents.parquet")
    weak = exact.exact_duplicates(spark, path, digest=lambda text: F.substring(F.sha2(text, 256), 1, 1))
    assert answers(weak) == brute(rows)


def test_empty_table_and_kept_settings(spark, tmp_path):
    path = table(spark, [], f"{tmp_path}/documents.parquet", 1)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    assert exact.exact_duplicates(spark, path).count() == 0
    assert spark.conf.get(key, None) == before


def test_the_locator_is_the_file_of_the_row_that_stays(spark, tmp_path):
    path = table(spark, [(1, "a"), (2, "a b"), (3, "ab")], f"{tmp_path}/documents.parquet", 1)
    found = {r.doc_id: r for r in exact.exact_duplicates(spark, path).collect()}
    assert found[3].keep_id == 2 and found[3].locator.startswith("file:")
