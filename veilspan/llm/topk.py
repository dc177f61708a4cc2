"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are integers, in blocks of rows. A block's index has a posting segment for each dimension
and quantised impact: the rows whose component lies in that level. For a query the segments are
processed by descending size of impact (the query's component times the level's middle), and every
segment adds to its rows' accumulators. A row's unseen components are bounded by what their
dimensions may still give. Processing stops only when no row outside the possible members can
reach the k-th best lower bound; the possible members are then rescored exactly. Each block's best
are merged by score, ties to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import cut_lineage, ship

#: Rows of a block, and queries that meet it at once.
BLOCK, QUERIES = 16_384, 256
#: Width of a quantised level.
LEVEL = 16
#: Share of the segments that is processed between two tests of the bounds.
STEPS = (0.8, 0.9, 1.0)


class Index:
    """Posting segments of one block."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        levels = vectors // LEVEL
        self.dims, self.levels, self.rows = [], [], []
        for d in range(vectors.shape[1]):
            order = np.argsort(levels[:, d], kind="stable")
            cuts = np.flatnonzero(np.diff(levels[order, d])) + 1
            for rows in np.split(order, cuts):
                if len(rows):
                    self.dims.append(d)
                    self.levels.append(int(levels[rows[0], d]))
                    self.rows.append(rows.astype(np.int32))
        self.dims, self.levels = np.array(self.dims, np.int64), np.array(self.levels, np.int64)
        self.sizes = np.array([len(r) for r in self.rows], np.int64)

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Scores and ids of the k best rows but ``own``, and the share of postings processed."""
        n = len(self.ids)
        q = query[self.dims]
        low = self.levels * LEVEL
        least = np.minimum(q * low, q * (low + LEVEL - 1))
        most = np.maximum(q * low, q * (low + LEVEL - 1))
        order = np.argsort(-np.abs(least + most), kind="stable")
        lower, seen = np.zeros(n), 0
        spread = np.zeros(n)
        members = np.arange(n)
        for step in STEPS:
            upto = int(np.ceil(step * len(order)))
            part = order[seen:upto]
            if len(part):
                rows = np.concatenate([self.rows[s] for s in part])
                times = self.sizes[part]
                lower += np.bincount(rows, weights=np.repeat(least[part], times), minlength=n)
                spread += np.bincount(rows, weights=np.repeat((most - least)[part], times), minlength=n)
                seen = upto
            rest = order[seen:]
            # An unseen component is in one of its dimension's remaining segments.
            rest_low, rest_high = np.zeros(len(query)), np.full(len(query), -np.inf)
            np.minimum.at(rest_low, self.dims[rest], least[rest])
            np.maximum.at(rest_high, self.dims[rest], most[rest])
            if len(rest):
                low_sum, high_sum = self._unseen(rest, rest_low, rest_high, n)
            else:
                low_sum, high_sum = 0.0, 0.0
            bottom = lower + low_sum
            top = lower + spread + high_sum
            bottom[self.ids == own] = -np.inf
            if n > k:
                kth = np.partition(bottom, n - k)[n - k]
                members = np.flatnonzero(top >= kth)
            if len(members) <= max(4 * k, n // 20):
                break
        members = members[self.ids[members] != own]
        scores = self.vectors[members] @ query
        best = np.lexsort((self.ids[members], -scores))[:k]
        return scores[best], self.ids[members][best], float(self.sizes[order[:seen]].sum()) / max(1, self.sizes.sum())

    def _unseen(self, rest, rest_low, rest_high, n) -> tuple[np.ndarray, np.ndarray]:
        rows = np.concatenate([self.rows[s] for s in rest])
        dims = np.repeat(self.dims[rest], self.sizes[rest])
        return (
            np.bincount(rows, weights=rest_low[dims], minlength=n),
            np.bincount(rows, weights=rest_high[dims], minlength=n),
        )


def quantised(vector: Column) -> Column:
    """floor(1024 * x) of every component, as 32-bit integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 1024).cast("long"))


def usable(vector: Column) -> Column:
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    )
    return F.coalesce(~bad, F.lit(False))


def _blocked(rows: DataFrame, block: Column, key: str) -> DataFrame:
    """One row for each block and vector length: its ids, and its vectors end to end."""
    listed = rows.groupBy(block.alias(key), F.size("v_").alias("dims")).agg(
        F.collect_list(F.struct("id_", "v_")).alias("x")
    )
    return listed.select(
        key, "dims", F.col("x.id_").alias("ids"), F.flatten(F.col("x.v_")).alias("values")
    )


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """The k best rows of ``vectors`` for each row of ``queries``: query_id, rank, id, score.

    A query does not find rows with its own id. Vectors that are null or empty, or hold null or
    non-finite components, take no part, nor do rows without an id; vectors of another length than the
    query's have no score with it. Rows that repeat an id count once each. Components must stay
    below 2^24 after scaling. Both sides are cut into blocks of bounded size, and each block of
    queries is sent to each block of rows; what a block answers is at most k rows for a query.
    """
    spark = vectors.sparkSession
    ship(spark)

    def clean(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_col).cast("long").alias("id_"), F.col(vector_col).alias("raw_"))
        filled = F.coalesce(F.size("raw_") > 0, F.lit(False)) & usable(F.col("raw_"))
        own = own.filter(F.col("id_").isNotNull() & filled)
        return own.select("id_", quantised(F.col("raw_")).alias("v_"))

    rows, asked = cut_lineage(clean(vectors)), cut_lineage(clean(queries))
    n_rows = -(-rows.count() // block) or 1
    n_asked = -(-asked.count() // QUERIES) or 1
    held = _blocked(rows, F.pmod(F.xxhash64("id_"), F.lit(n_rows)), "block")
    sent = _blocked(asked, F.pmod(F.xxhash64("id_"), F.lit(n_asked)), "part")
    sent = sent.withColumnsRenamed({"ids": "query_ids", "values": "query_values"}).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long")))
    )
    together = held.join(sent, ["block", "dims"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        row = group.iloc[0]  # a group is one row: a block and a part of the queries
        dims, ids = int(row["dims"]), np.asarray(row["ids"], dtype=np.int64)
        index = Index(np.asarray(row["values"], dtype=np.int64).reshape(len(ids), dims), ids)
        asked = np.asarray(row["query_values"], dtype=np.int64).reshape(-1, dims)
        out = []
        for own, query in zip(row["query_ids"], asked, strict=True):
            scores, found, _ = index.top(query, k, own)
            out.append(pd.DataFrame({"query_id": own, "id_": found, "score": scores}))
        return pd.concat(out, ignore_index=True)

    best = together.groupBy("block", "part", "dims").applyInPandas(
        answer, "query_id long, id_ long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id_")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id_").alias(id_col), "score")
