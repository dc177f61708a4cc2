"""Helpers of this subpackage: tables, code for the Python workers, words of whole texts in numpy."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from veilspan.operators.tables import cut_lineage, discard, new_path

__all__ = ["cut_lineage", "discard", "new_path", "table", "ship", "small_batches", "slices", "Words", "mix"]

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()
_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whole texts that a Python worker holds at once, some times over. Spark's 10,000 are a whole task.
ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="llm-py-"), "llm_packages.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in _PACKAGE.rglob("*.py"):
            out.write(file, file.relative_to(_PACKAGE.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def small_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """From now on the session's Python workers get at most ``rows`` rows at once. Nothing else
    changes; a smaller setting stays."""
    now = int(spark.conf.get(_PER_BATCH))
    if not 0 < now <= rows:
        spark.conf.set(_PER_BATCH, rows)


def slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each, so that numpy's working arrays stay small."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


_RANDOM = np.random.default_rng(20240229)
#: A random 64-bit number for each byte, and an odd base with its inverse powers by squaring.
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: where they start and end, and a 64-bit hash of each.

    ``is_word`` tells for each of the 256 bytes whether it belongs to a word; A-Z count as a-z.
    Texts are UTF-8 and joined by line feeds, which must not be word bytes.
    """

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, dtype=np.uint8)
        upper = (data >= 65) & (data <= 90)
        data = np.where(upper, data + 32, data).astype(np.uint8)
        inside = is_word[data]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        self.data, self.start, self.end = data, edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        #: of each text: its first byte, and its words as the range first[i] to first[i + 1]
        self.offset = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.start, self.offset)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * _powers(_BASE, n), out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * _powers(_INVERSE, n)[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64))
