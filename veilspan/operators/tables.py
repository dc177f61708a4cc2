"""Keeping costly results: computed columns, and tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables of texts, values and tokens take two thirds of the disk that they take by default.
DENSE = "zstd"


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns that are costly to compute.

    They pass through a generator. A filter on an ordinary computed column is pushed below it
    and computes it a second time there. They are computed before it: Spark compiles a projection,
    but interprets a generator's expressions if one of them holds a lambda.
    """
    kept = [c for c in df.columns if c not in columns]
    values = F.struct(*[column.alias(name) for name, column in columns.items()])
    order = df.columns + [name for name in columns if name not in df.columns]
    work = df.select(*kept, values.alias("_computed"))
    return work.select(*kept, F.inline(F.array("_computed"))).select(*order)


def work_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="veilspan-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str = "table") -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write the rows once and go on from there, so that a lost executor costs a re-read.

    Unlike a cached frame the files survive executors, and they give later joins a known size.
    Nothing reads the shuffles behind the written table again; they go when it is there.
    ``codec`` is the compression of the files, the session's by default.
    """
    spark = df.sparkSession
    path = new_path(spark)
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut_lineage`` gave, when whatever reads them is written."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path.getFileSystem(conf).delete(path, True)
