"""The vault as Parquet folders, one for each bucket of sessions.

Whatever meets the vault knows its sessions: an append the sessions of its values, a restore those
of its texts. So the rows lie in ``bucket=<n>`` by a hash of the session, and only the folders of
the sessions in question are listed in a plan. A session with very many rows is written by several
tasks. Folders with many small files are compacted after an append.

The vault has one writer at a time and any number of readers. Compaction writes the new file before
it deletes the old ones: a crash in between leaves rows twice, never none, and the next compaction
drops the repeated ones. A reader that listed the old files may have to read again.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators.tables import cut_lineage
from veilspan.operators.vault import VAULT_SCHEMA, build_vault, missing_entries

BUCKET = "bucket"
#: Fixed by the stored vaults: another number would look for sessions in the wrong folders.
BUCKETS = 256
#: Rows that one task writes for one bucket.
FILE_ROWS = 1_000_000
#: Files of a bucket beyond which an append compacts it.
MOST_FILES = 8

_COLUMNS = [c.split()[0] for c in VAULT_SCHEMA.split(", ")]
_STORED = f"{VAULT_SCHEMA}, {BUCKET} int"


class NoMapping(ValueError):
    """There is no vault yet, or it is empty."""


def bucket_of(session: Column) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(BUCKETS)).cast("int")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_STORED).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STORED)


def load_vault(
    spark: SparkSession,
    path: str,
    require_mapping: bool = False,
    session: str | None = None,
    among: DataFrame | None = None,
) -> DataFrame:
    """The vault at ``path``, of one session if given. A missing one is empty, or an error with
    ``require_mapping``.

    ``among`` is a table with a column ``session``: only the buckets of its sessions are read. At
    most ``BUCKETS`` numbers come to the driver for that.
    """
    vault = _stored(spark, path)
    # A vault that was written before there were buckets has none: all of it is read.
    unplaced = F.col(BUCKET).isNull()
    if session is not None:
        here = F.col(BUCKET) == bucket_of(F.lit(session))
        vault = vault.filter(here | unplaced).filter(F.col("session") == session)
    if among is not None:
        wanted = [r[0] for r in among.select(bucket_of(F.col("session"))).distinct().collect()]
        vault = vault.filter(F.col(BUCKET).isin(wanted) | unplaced)
    vault = vault.select(*_COLUMNS)
    if require_mapping and vault.isEmpty():
        raise NoMapping("no mapping: scrub a text first")
    return vault


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """One file for each bucket, several for one with more than ``FILE_ROWS`` rows."""
    placed = rows.select(*_COLUMNS, bucket_of(F.col("session")).alias(BUCKET))
    most = placed.groupBy(BUCKET).count().agg(F.max("count")).first()[0] or 0
    ways = F.pmod(F.xxhash64("token"), F.lit(-(-most // FILE_ROWS) or 1))
    dealt = placed.repartition(F.col(BUCKET), ways)
    out = dealt.write.partitionBy(BUCKET).option("partitionOverwriteMode", "static")
    out.mode(mode).parquet(path)


def _files(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by folder; those of a vault without buckets under ''."""
    found: dict[str, list[str]] = defaultdict(list)
    for file in _stored(spark, path).inputFiles():
        folder = file.rsplit("/", 2)[-2]
        found[folder if folder.startswith(f"{BUCKET}=") else ""].append(file)
    return found


def compact_vault(spark: SparkSession, path: str, most: int = 1) -> int:
    """Rewrite the buckets of more than ``most`` files, without repeated rows. Returns how many."""
    crowded = {k: files for k, files in _files(spark, path).items() if k and len(files) > most}
    if not crowded:
        return 0
    old = spark.read.schema(_STORED).option("basePath", path).parquet(*[f"{path}/{k}" for k in crowded])
    _write(cut_lineage(old.select(*_COLUMNS).distinct()), path, "append")
    for files in crowded.values():
        for file in files:
            place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, False)
    spark.catalog.refreshByPath(path)
    return len(crowded)


def _append(rows: DataFrame, path: str) -> None:
    spark = rows.sparkSession
    if _files(spark, path).get(""):
        # Folders beside plain files cannot be read together: everything moves into folders.
        whole = load_vault(spark, path).unionByName(rows.select(*_COLUMNS))
        _write(cut_lineage(whole), path, "overwrite")
        return
    _write(rows, path, "append")
    compact_vault(spark, path, MOST_FILES)


def save_vault(vault: DataFrame, path: str, mode: str = "append") -> None:
    """Append the values the stored vault does not hold yet, or replace it.

    Appending the same rows twice changes nothing, so a job may be repeated after a failure.
    """
    spark = vault.sparkSession
    # The rows may come from the very files that are about to change.
    rows = cut_lineage(vault.select(*_COLUMNS))
    if mode == "overwrite":
        _write(rows, path, "overwrite")
    elif mode == "append":
        new = cut_lineage(missing_entries(rows, load_vault(spark, path, among=rows)).select(*_COLUMNS))
        if not new.isEmpty():
            _append(new, path)
    else:
        raise ValueError(f"mode must be 'append' or 'overwrite', not {mode!r}")


def add_entries(spark: SparkSession, entries: DataFrame, path: str, secret: str = "") -> DataFrame:
    """Give the entries that the vault lacks a token, append them, and return the buckets of the
    entries' sessions. The stored rows are read to compare and once more with what is new."""
    fresh = cut_lineage(build_vault(entries, secret, load_vault(spark, path, among=entries)))
    if not fresh.isEmpty():
        _append(fresh, path)
    return load_vault(spark, path, among=entries)
