"""Reading texts from any Spark source and writing the results back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_texts(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    text: str = "text",
    keys: Sequence[str] = (),
    schema: StructType | str | None = None,
    options: dict[str, str] | None = None,
    even_out: bool = False,
) -> DataFrame:
    """``keys`` and the text (as ``text``) of a source; other columns are never read.

    ``fmt`` is any batch format of the session: parquet, orc, json, csv, text, ... Plain text
    files give one row per line, or per file with ``wholetext``; their column is ``value``.
    ``even_out`` deals the rows of a source with few partitions out over the cores.
    """
    reader = spark.read.format(fmt).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    df = _texts(reader.load(path), fmt, text, keys)
    return spread(df) if even_out else df


def spread(df: DataFrame) -> DataFrame:
    """Rows of a source with fewer partitions than cores, dealt out by size.

    The partitions are those that the scan would run as tasks, so a large file that can be split
    stays as it is, and a large corpus is never shuffled for this.
    """
    if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.hint("rebalance")


def stream_texts(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    fmt: str = "parquet",
    text: str = "text",
    keys: Sequence[str] = (),
    options: dict[str, str] | None = None,
) -> DataFrame:
    """The same from a folder that new files arrive in."""
    reader = spark.readStream.format(fmt).options(**(options or {})).schema(schema)
    return _texts(reader.load(path), fmt, text, keys)


def _texts(df: DataFrame, fmt: str, text: str, keys: Sequence[str]) -> DataFrame:
    source = "value" if fmt == "text" and text == "text" else text
    return df.select(*keys, F.col(source).alias("text"))


def write_scrubbed(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
