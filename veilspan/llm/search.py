"""Ranked lexical search by branch and bound over a trie of documents (an FP-tree).

Every document becomes the vector of the query terms it holds, the most frequent term first, so
that documents share paths. A task puts blocks of documents in the order of their paths. A node of
the trie is a range of that order with a common prefix; it knows the largest tf of every term below
it and the smallest length figure m. From these follows a bound on the score of every document
below the node, for each item. The tree is walked depth first, the best bounds first; an item goes
on into a subtree only while the bound reaches the worst of the k scores it has. What is left at a
leaf is scored exactly.

Statistics (N, L and each term's df) cover all documents. Terms are told apart by 64-bit hashes of
their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import Words, cut_lineage, ship, slices

#: Items that go over the documents together, and their terms with repeats, at most; an item with
#: more terms goes alone. Only such a group is on the driver at a time, and it travels by broadcast.
ITEMS, TERMS = 1_024, 32_768
#: Documents of one tree; fewer where the terms are many, so that a tree's maxima stay within CELLS.
BLOCK, CELLS = 4_096, 1 << 24
#: A node with so many documents is a leaf.
LEAF = 16

_LAST = np.iinfo(np.int64).max

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x41:0x5B] = _WORD_BYTE[0x61:0x7B] = _WORD_BYTE[0x80:] = True


def _texts(column) -> list[bytes]:
    return ["".encode() if t is None else t.encode("utf-8", "surrogatepass") for t in column]


def _hashed(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of the texts: the first text's number, where each one's terms begin among the
    hashes, and the hashes."""
    for a, b in slices(texts):
        words = Words(texts[a:b], _WORD_BYTE)
        yield a, words.first, words.hashes()


@dataclass
class Items:
    """Some items: ``terms`` are their distinct term hashes, sorted. The terms of item i are
    ``of[start[i]:start[i + 1]]``, as places in ``terms``."""

    keys: list
    terms: np.ndarray
    of: np.ndarray
    start: np.ndarray


def _gather(rows: list[tuple[object, np.ndarray]]) -> Items:
    sizes = [len(h) for _, h in rows]
    joined = np.concatenate([h for _, h in rows])
    terms, of = np.unique(joined, return_inverse=True)
    return Items([k for k, _ in rows], terms, of, np.concatenate([[0], np.cumsum(sizes)]))


def item_groups(items: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    """Groups of items that have a term, within ``ITEMS`` and ``TERMS``."""
    rows: list[tuple[object, np.ndarray]] = []
    size = 0
    for row in items.select(F.col(item_col).alias("k"), F.col(text_col).alias("t")).toLocalIterator():
        for _, _, hashes in _hashed(_texts([row["t"]])):
            found = np.unique(hashes)
            if not len(found):
                continue
            if rows and (len(rows) >= ITEMS or size + len(found) > TERMS):
                yield _gather(rows)
                rows, size = [], 0
            rows.append((row["k"], found))
            size += len(found)
    if rows:
        yield _gather(rows)


def vectors(docs: DataFrame, terms: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Per document: ``id_``, ``n`` (its terms with repeats), and of the query terms that it holds
    ``terms_`` (places in ``terms``) and ``tfs``."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = sent.value
        for batch in batches:
            parts = []
            for _, first, hashes in _hashed(_texts(batch["text_"])):
                sizes = np.diff(first)
                at = np.searchsorted(wanted, hashes)
                at[at == len(wanted)] = 0
                hit = wanted[at] == hashes
                owner = np.repeat(np.arange(len(sizes)), sizes)[hit]
                cells, tfs = np.unique(owner * len(wanted) + at[hit], return_counts=True)
                cuts = np.searchsorted(cells // len(wanted), np.arange(1, len(sizes)))
                places = np.split((cells % len(wanted)).astype(np.int32), cuts)
                parts.append((sizes, places, np.split(tfs.astype(np.int32), cuts)))
            if parts:
                yield pd.DataFrame(
                    {
                        "id_": batch["id_"],
                        "n": np.concatenate([p[0] for p in parts]),
                        "terms_": [x for p in parts for x in p[1]],
                        "tfs": [x for p in parts for x in p[2]],
                    }
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"))
    return rows.mapInPandas(count, f"id_ {kind}, n long, terms_ array<int>, tfs array<int>")


@dataclass
class Weights:
    """What a task needs besides the documents. Terms are numbered by frequency: ``rank`` gives
    the number of a place in ``Items.terms``, ``weight`` is by number, ``of`` holds numbers."""

    rank: np.ndarray
    weight: np.ndarray
    of: np.ndarray
    start: np.ndarray
    n_docs: int
    n_terms: int

    def m(self, n: np.ndarray) -> np.ndarray:
        exact = [10 + (90 * int(x) * self.n_docs) // self.n_terms for x in n]
        return np.array(exact, dtype=np.int64)


def weigh(items: Items, df: dict[int, int], n_docs: int, n_terms: int) -> Weights:
    counts = np.array([df.get(i, 0) for i in range(len(items.terms))], dtype=np.int64)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    weight = [
        math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(counts[i]) + 1))) for i in order
    ]
    of = rank[items.of]
    return Weights(rank, np.array(weight, dtype=np.int64), of, items.start, n_docs, n_terms)


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of the score before its weight: grows with tf and shrinks with m."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """The FP-tree of some documents, given as places and tfs per document and their m.

    ``order`` lists the documents in path order. Node i covers ``order[lo[i]:hi[i]]``; its
    children are ``children[i]``, none at a leaf. ``top[i]`` holds the largest tf of each term
    below it, ``least[i]`` the smallest m.
    """

    def __init__(self, ranked: list[np.ndarray], tfs: list[np.ndarray], m: np.ndarray, n_terms: int):
        # Big-endian numbers compare as bytes in the order of the paths.
        paths = [r.astype(">u4").tobytes() for r in ranked]
        self.order = np.array(sorted(range(len(paths)), key=paths.__getitem__), dtype=np.int64)
        self.ranked = [ranked[i] for i in self.order]
        self.tfs = [tfs[i] for i in self.order]
        self.m = m[self.order]
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.children: list[list[int]] = []
        top: list[np.ndarray] = []
        least: list[int] = []
        self._grow(0, len(paths), 0)
        for node in range(len(self.lo)):
            if self.children[node]:
                top.append(None)
            else:
                cells = np.zeros(n_terms, dtype=np.int32)
                places = np.concatenate(self.ranked[self.lo[node] : self.hi[node]])
                np.maximum.at(cells, places, np.concatenate(self.tfs[self.lo[node] : self.hi[node]]))
                top.append(cells)
            least.append(int(self.m[self.lo[node] : self.hi[node]].min()))
        for node in range(len(self.lo) - 1, -1, -1):  # children come after their parent
            if self.children[node]:
                top[node] = reduce(np.maximum, [top[c] for c in self.children[node]])
        self.top, self.least = np.array(top), np.array(least, dtype=np.int64)

    def _node(self, lo: int, hi: int) -> int:
        self.lo.append(lo)
        self.hi.append(hi)
        self.children.append([])
        return len(self.lo) - 1

    def _grow(self, lo: int, hi: int, depth: int) -> None:
        todo = [(self._node(lo, hi), depth)]
        while todo:
            node, depth = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= LEAF:
                continue
            # Down the shared path to where it forks. Sorted, so the ends tell the whole range.
            a, b = self.ranked[lo], self.ranked[hi - 1]
            most = min(len(a), len(b))
            while depth < most and a[depth] == b[depth]:
                depth += 1
            if depth == len(a) == len(b):
                continue  # equal paths: a leaf of any size
            step = [int(r[depth]) if depth < len(r) else -1 for r in self.ranked[lo:hi]]
            cuts = [lo, *(lo + 1 + np.flatnonzero(np.diff(step))).tolist(), hi]
            # Neighbouring branches that fit into one leaf together share it.
            start, last = cuts[0], cuts[0]
            ranges = []
            for cut in cuts[1:]:
                if cut - start > LEAF and last > start:
                    ranges.append((start, last))
                    start = last
                last = cut
            ranges.append((start, last))
            for x, y in ranges:
                child = self._node(x, y)
                self.children[node].append(child)
                todo.append((child, depth))


class Best:
    """The k best (score, id) of every item so far; equal scores by the smaller id."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.score = np.zeros((n_items, k), dtype=np.int64)
        self.id = np.full((n_items, k), _LAST, dtype=np.int64)
        self.null = np.ones((n_items, k), dtype=bool)

    def worst(self) -> np.ndarray:
        """A score below this cannot enter. Equal ones can, by their id."""
        return np.maximum(self.score[:, -1], 1)

    def offer(self, item: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score = np.concatenate([self.score[item], score])
        ids = np.concatenate([self.id[item], ids])
        null = np.concatenate([self.null[item], null])
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score[item], self.id[item], self.null[item] = score[order], ids[order], null[order]


def walk(tree: Tree, ids: np.ndarray, null: np.ndarray, weights: Weights, best: Best) -> int:
    """Depth first through the tree, for all items at once. Returns how many pairs of an item and
    a document were scored."""
    scored = 0
    ids, null = ids[tree.order], null[tree.order]
    start, of, w = weights.start, weights.of, weights.weight

    def columns(active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of the active items in a row, and where each item's begin."""
        if len(active) == len(start) - 1:
            return of, start[:-1]
        sizes = start[active + 1] - start[active]
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return of[np.repeat(start[active] - begin, sizes) + np.arange(sizes.sum())], begin

    def bounds(nodes: list[int], active: np.ndarray) -> np.ndarray:
        terms, begin = columns(active)
        share = saturated(tree.top[nodes], tree.least[nodes][:, None]) * w
        return np.add.reduceat(share[:, terms], begin, axis=1)

    def score(node: int, active: np.ndarray) -> None:
        nonlocal scored
        terms, begin = columns(active)
        for lo in range(tree.lo[node], tree.hi[node], LEAF):
            hi = min(lo + LEAF, tree.hi[node])
            share = np.zeros((hi - lo, len(w)), dtype=np.int64)
            for row in range(lo, hi):
                places = tree.ranked[row]
                share[row - lo, places] = saturated(tree.tfs[row], tree.m[row]) * w[places]
            total = np.add.reduceat(share[:, terms], begin, axis=1)
            scored += total.size
            worst = best.worst()[active]
            for at in np.flatnonzero((total >= worst).any(axis=0)):
                good = total[:, at] >= worst[at]
                best.offer(int(active[at]), total[good, at], ids[lo:hi][good], null[lo:hi][good])

    everyone = np.arange(len(start) - 1)
    stack = [(0, bounds([0], everyone)[0], everyone)]
    while stack:
        node, bound, active = stack.pop()
        left = bound >= best.worst()[active]  # the scores may have grown since it was pushed
        active = active[left]
        if not len(active):
            continue
        if not tree.children[node]:
            score(node, active)
            continue
        below = bounds(tree.children[node], active)
        for at in np.argsort(below.max(axis=1)):  # the best one is popped first
            keep = below[at] >= best.worst()[active]
            if keep.any():
                stack.append((tree.children[node][at], below[at][keep], active[keep]))
    return scored


def _ranked(found: DataFrame, weights: Weights, k: int, kind: str) -> DataFrame:
    """``found`` are vectors; per task and item the k best: item number, score, doc_id."""
    sent = found.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        know = sent.value
        n_items = len(know.start) - 1
        best = Best(n_items, k)
        size = max(LEAF, min(BLOCK, CELLS // max(1, len(know.weight))))
        for batch in batches:
            for lo in range(0, len(batch), size):
                part = batch.iloc[lo : lo + size]
                ranked, tfs = [], []
                for places, tf in zip(part["terms_"], part["tfs"], strict=True):
                    number = know.rank[np.asarray(places, dtype=np.int64)]
                    path = np.argsort(number)
                    ranked.append(number[path])
                    tfs.append(np.asarray(tf, dtype=np.int64)[path])
                tree = Tree(ranked, tfs, know.m(part["n"].to_numpy()), len(know.weight))
                null = part["id_"].isna().to_numpy()
                ids = np.where(null, _LAST, part["id_"].fillna(0).to_numpy().astype(np.int64))
                walk(tree, ids, null, know, best)
        item, place = np.nonzero(best.score > 0)
        ids = pd.array(best.id[item, place], dtype="Int64")
        ids[best.null[item, place]] = pd.NA
        yield pd.DataFrame({"item": item, "score": best.score[item, place], "doc_id": ids})

    # Only documents with a query term can score.
    rows = found.filter("size(terms_) > 0").select(F.col("id_").cast("long"), "n", "terms_", "tfs")
    return rows.mapInPandas(run, "item long, score long, doc_id long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """The ``k`` best documents with a score above 0 of every item: item, rank, doc_id, score.

    Document ids are integers. Equal scores rank by the smaller id, null ids last. Null and empty
    texts have no terms: such documents count nowhere, such items give no rows; neither do items
    without a document that holds a term of theirs. Repeated rows are documents and items of their
    own: a document given twice takes two ranks, an item given twice gives its rows twice. Without
    documents or items there are no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = items.schema[item_col].dataType
    schema = f"{item_col} {kind.simpleString()}, rank int, doc_id long, score long"
    done: list[DataFrame] = []
    for group in item_groups(items, item_col, text_col):
        found = cut_lineage(vectors(docs, group.terms, id_col, text_col))
        size = found.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not size["docs"]:
            break
        # As many rows as the group has terms, at most.
        df = found.select(F.explode("terms_").alias("t")).groupBy("t").count().collect()
        weights = weigh(group, {r["t"]: r["count"] for r in df}, size["docs"], size["terms"])
        best = _ranked(found, weights, k, kind.simpleString())
        first = Window.partitionBy("item").orderBy(
            F.desc("score"), F.col("doc_id").asc_nulls_last()
        )
        top = best.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        keys = spark.createDataFrame(list(enumerate(group.keys)), f"item long, key {kind.simpleString()}")
        done.append(
            cut_lineage(
                top.join(F.broadcast(keys), "item").select(
                    F.col("key").alias(item_col), "rank", "doc_id", "score"
                )
            )
        )
    if not done:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, done)
