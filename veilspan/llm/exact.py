"""Exact deduplication as a stream with keyed state on disk.

The documents arrive in micro-batches. The state of a running aggregation, kept by RocksDB and
saved to the shared folder, never expires. For every digest of a normalised text it holds the
number of rows so far and the best of them: its length, stable identifier and content locator (the
file it came from). A digest that comes again is a hit. Hits are not trusted: the whole normalised
texts of every hit group are compared, and a group whose bytes differ is dealt out by its texts.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import cut_lineage, new_path

BLANKS = r"[\x20\x09-\x0D]+"
#: The state lives on disk. Without preallocation a small partition of it takes kilobytes there.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _best(rows_length: str, doc_id: str, locator: Column) -> Column:
    """The row that stays compares as the least: most code points, then smallest identifier
    (null last), then the locator."""
    return F.struct(
        (-F.col(rows_length)).alias("less"),
        F.col(doc_id).isNull().alias("no_id"),
        F.col(doc_id).alias("keep_id"),
        locator.alias("locator"),
    )


def running_state(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    files_per_batch: int = 64,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """Stream the files of ``path`` through the keyed state; its last entry for each digest:
    digest, best (struct with keep_id and locator), group_size.

    All files that are there are read and the stream ends; each micro-batch takes
    ``files_per_batch`` of them. Started again with the same checkpoint it would go on with files
    that are new. A micro-batch that is run again after a failure writes its folder anew.
    """
    schema = spark.read.parquet(path).schema
    # As a pattern the path may be a folder of files or one file.
    source = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{path[:-1]}[{path[-1]}]")
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = source.select(
        F.col(id_col).alias("id_"),
        F.length(text).alias("length_"),
        digest(normalised(text)).alias("digest"),
        F.input_file_name().alias("file_"),
    )
    state = rows.groupBy("digest").agg(
        F.min(_best("length_", "id_", F.col("file_"))).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    out, checkpoint = new_path(spark, "dedup-out"), new_path(spark, "dedup-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    updates = spark.read.schema(state.schema).parquet(f"{out}/batch=*")
    # The count of a digest grows with every update, so its last entry is the largest.
    last = F.max_by(F.col("best"), F.col("group_size")).alias("best")
    return updates.groupBy("digest").agg(last, F.max("group_size").alias("group_size"))


def exact_duplicates(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    files_per_batch: int = 64,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """Per row of the table at ``path``: its id, keep_id, group_size, kept, text_sha256, locator.

    Texts are equal when they are identical without white space; a null text counts as empty, so
    null, empty and blank texts form one group. Of equal texts the row with the most code points
    stays, then the smallest id, null ids last. Rows that repeat an id with equal texts share its
    decision. An empty table gives no rows. Other columns are not read.
    """
    groups = cut_lineage(
        running_state(spark, path, id_col, text_col, files_per_batch, digest)
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = spark.read.parquet(path).select(
        F.col(id_col).alias("id_"),
        F.length(text).alias("length_"),
        normalised(text).alias("whole_"),
        F.input_file_name().alias("file_"),
    )
    rows = rows.withColumn("digest", digest(F.col("whole_")))
    sha = [] if digest is sha256 else [sha256(F.col("whole_")).alias("text_sha256")]

    # Full bytes of all hits: least and greatest text of a group are merged within each task.
    hits = groups.filter("group_size > 1").select("digest")
    compared = (
        rows.join(hits, "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min("whole_").alias("least"), F.max("whole_").alias("greatest"))
    )
    differing = cut_lineage(compared.filter("least <> greatest").select("digest"))

    own = [F.col("id_"), F.col("digest")]
    plain = rows.select(*own, *sha).join(differing, "digest", "left_anti")
    same = plain.join(groups, "digest").select(
        *own, F.col("best.keep_id"), "group_size", F.col("best.locator"),
        F.col("text_sha256" if sha else "digest").alias("text_sha256"),
    )
    # Digests that stand for several texts: the texts themselves are the key.
    clashing = rows.join(differing, "digest", "left_semi")
    by_text = clashing.groupBy("digest", "whole_").agg(
        F.min(_best("length_", "id_", F.col("file_"))).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    apart = clashing.select(*own, "whole_").join(by_text, ["digest", "whole_"]).select(
        *own, F.col("best.keep_id"), "group_size", F.col("best.locator"),
        sha256(F.col("whole_")).alias("text_sha256"),
    )
    found = same.unionByName(apart)
    return found.select(
        F.col("id_").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id_").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "locator",
    )
