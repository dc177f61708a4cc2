"""Aligning two tokenizers: groups of their tokens that end together, and links between them.

A text is encoded by both. Where tokens end is added up per side, an end-to-index dictionary is
made of each, and the ends that both dictionaries have, in order, slice the two id lists into
groups. The last tokens of a group's two sides end together: that is its link. Every token has a
byte at least, so no two tokens of one side end together, and a group has exactly one link.

How often an id pair is linked is counted over all documents. The counts go back to the links of
every document: those of the most frequent pairs, a bounded number, by broadcast, all others by a
join.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.bpe import encoding
from veilspan.llm.common import cut_lineage, ship, slices

#: Id pairs whose counts travel by broadcast, the most frequent ones: 16 bytes each.
HOT = 1 << 17
#: A link is one number: the first side's id times this, plus the second side's.
SHIFT = 32
#: A task forgets the words it has met when they and their ids take about so many bytes.
REMEMBER = 160 << 20

_CUT = re.compile(r"(?<=\S) ")


class Aligned(NamedTuple):
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    groups: str = ""
    links: bytes = b""


class Side:
    """Of every id of one tokenizer: how many bytes it has, and how it is shown."""

    def __init__(self, sizes: list[int]):
        self.sizes = sizes
        self.shown = [str(i) for i in range(len(sizes))]

    def ends(self, ids: list[int]) -> dict[int, int]:
        """Where each token ends, in bytes, to how many tokens end there or before."""
        sizes, at, end = self.sizes, {}, 0
        for i, token in enumerate(ids, 1):
            end += sizes[token]
            at[end] = i
        return at


def align_ids(a: list[int], b: list[int], a_side: Side, b_side: Side) -> tuple:
    """An ``Aligned`` of two id lists: the ends that both sides' dictionaries have, in order, slice
    the lists, and the last tokens of two slices are linked."""
    at_a, at_b = a_side.ends(a), b_side.ends(b)
    shown_a, shown_b = a_side.shown, b_side.shown
    i = j = 0
    groups, links = [], []
    for end in sorted(at_a.keys() & at_b.keys()):
        x, y = at_a[end], at_b[end]
        left = shown_a[a[i]] if x - i == 1 else ",".join([shown_a[t] for t in a[i:x]])
        right = shown_b[b[j]] if y - j == 1 else ",".join([shown_b[t] for t in b[j:y]])
        groups.append(f"{left}|{right}")
        links.append((a[x - 1] << SHIFT) + b[y - 1])
        i, j = x, y
    return len(a), len(b), len(links), ";".join(groups), array("q", links).tobytes()


class Aligner:
    """Alignments of whole texts.

    Neither side has a token across a blank that follows another character: there a pre-token
    begins, and no piece of the model holds a blank behind anything but blanks. So texts are cut
    there into words, each new word is aligned once, and that is remembered for a while.
    """

    def __init__(self, ranks_path: str, model_path: str):
        self.a = encoding(ranks_path)
        self.a_side = Side(
            [len(self.a.decode_single_token_bytes(i)) for i in range(self.a.n_vocab)]
        )
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.whole = any("▁" in x.lstrip("▁") for x in names)
        self.b_bytes = [
            bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode()
            for i, x in enumerate(names)
        ]
        self.b_side = Side(list(map(len, self.b_bytes)))
        self.known: dict[str, tuple | None] = {}
        self.held = 0

    def learn(self, words: set[str]) -> None:
        """Align the words, each behind a blank; None where the second side does not give it back.
        The first side has an id for every byte and always does."""
        if self.held > REMEMBER:
            self.known.clear()
            self.held = 0
        new = [w for w in words if w not in self.known]
        pieces, first = self.b_bytes, self.a.encode_ordinary
        for word, b in zip(new, self.b.encode(new), strict=True):
            found, whole = None, " " + word
            if b"".join([pieces[i] for i in b]) == whole.encode():
                found = align_ids(first(whole), b, self.a_side, self.b_side)
                self.held += 8 * found[2] + len(found[3])
            self.known[word] = found
            self.held += 300 + len(word)

    def align(self, texts: Iterable[str | None]) -> Iterator[Aligned]:
        """Of whole texts; without tokens where one has none or a side does not give it back."""
        known = self.known
        texts = [t or "" for t in texts]
        for lo, hi in slices(texts):
            cut = [texts[i : i + 1] if self.whole else _CUT.split(texts[i]) for i in range(lo, hi)]
            self.learn({w for words in cut for w in words})
            for text, words in zip(texts[lo:hi], cut, strict=True):
                if not text:
                    yield Aligned()
                    continue
                found = [known[w] for w in words]
                if None in found:  # its words may still make up for each other
                    self.learn({text})
                    found = [known[text] or Aligned()]
                n_a, n_b, n_groups, groups, links = zip(*found, strict=True)
                yield Aligned(sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(links))


def _digest(groups: bytes) -> bytes:
    return hashlib.sha256(groups).hexdigest().encode()


@lru_cache(2)
def _aligner(ranks_path: str, model_path: str) -> Aligner:
    return Aligner(ranks_path, model_path)


def aligned(
    docs: DataFrame, ranks_path: str, model_path: str, id_col: str, text_col: str, keep_groups: bool
) -> DataFrame:
    """Per row: its id, ``row_`` (unique once this is written), the counts, ``groups`` (or their
    digest), and the different links with how often each one occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(ranks_path, model_path)
        for batch in batches:
            counts, groups, links = [], [], []
            for found in aligner.align(batch.column("text_").to_pylist()):
                counts.append(found[:3])
                whole = found.groups.encode()
                groups.append(whole if keep_groups or not found.n_a else _digest(whole))
                pairs = np.frombuffer(found.links, dtype=np.int64)
                links.append(np.unique(pairs, return_counts=True))
            cuts = np.concatenate([[0], np.cumsum([len(p) for p, _ in links])]).astype(np.int32)

            def listed(side: int, kind: type) -> pa.ListArray:
                flat = np.concatenate([np.empty(0, kind), *[c[side] for c in links]])
                return pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.astype(kind)))

            yield pa.RecordBatch.from_pydict(
                {
                    "id_": batch.column("id_"),
                    "row_": batch.column("row_"),
                    "n_a": pa.array([c[0] for c in counts], pa.int64()),
                    "n_b": pa.array([c[1] for c in counts], pa.int64()),
                    "n_groups": pa.array([c[2] for c in counts], pa.int64()),
                    "groups": pa.array([g.decode() for g in groups], pa.string()),
                    "pairs": listed(0, np.int64),
                    "uses": listed(1, np.int32),
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id_"),
        F.monotonically_increasing_id().alias("row_"),
        F.col(text_col).cast("string").alias("text_"),
    )
    return rows.mapInArrow(
        run,
        f"id_ {kind}, row_ long, n_a long, n_b long, n_groups long, groups string, "
        "pairs array<long>, uses array<int>",
    )


def align(
    docs: DataFrame,
    ranks_path: str,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_groups: bool = False,
    hot: int = HOT,
) -> DataFrame:
    """Per row of ``docs``: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The first side is a blank and the text by the byte-level ranks at ``ranks_path``, the second
    the text by the sentencepiece model at ``model_path``, which puts the blank before it. Strings
    of special tokens are ordinary text on both sides. ``n_best`` counts the links whose id pair is
    linked as often as the most frequent pair of its second id, ``count_sum`` adds up the counts of
    their pairs. With ``keep_groups`` the column ``groups`` holds the groups themselves.

    Null and empty texts, and those that a side does not give back byte by byte, have no tokens:
    zeros and ''. Repeated rows and null ids are rows like others. An empty table gives no rows.
    Other columns are not read. ``hot`` bounds what is broadcast and never changes the result.
    """
    ship(docs.sparkSession)
    done = cut_lineage(aligned(docs, ranks_path, model_path, id_col, text_col, keep_groups))
    links = done.select("row_", "uses", F.posexplode("pairs").alias("i", "pair")).select(
        "row_", "pair", F.get("uses", F.col("i")).alias("uses")
    )
    counted = cut_lineage(links.groupBy("pair").agg(F.sum("uses").alias("count")))
    second = F.col("pair") % F.lit(1 << SHIFT)
    # One row for each id of the second side.
    best = counted.groupBy(second.alias("b")).agg(F.max("count").alias("most"))
    counts = counted.join(F.broadcast(best), second == F.col("b")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("is_best")
    )
    frequent = cut_lineage(counts.orderBy(F.desc("count"), "pair").limit(hot))
    marked = links.join(F.broadcast(frequent), "pair")
    summed = [
        F.sum(F.col("uses") * F.col("count")).alias("count_sum"),
        F.sum(F.when(F.col("is_best"), F.col("uses")).otherwise(0)).alias("n_best"),
    ]
    parts = [marked.groupBy("row_").agg(*summed)]
    if counted.count() > hot:
        rare = links.join(F.broadcast(frequent.select("pair")), "pair", "left_anti")
        parts.append(rare.join(counts, "pair").groupBy("row_").agg(*summed))
    sums = reduce(DataFrame.unionByName, parts).groupBy("row_").agg(
        F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best")
    )
    groups = F.col("groups")
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(groups, 256)) if keep_groups else groups
    return done.join(sums, "row_", "left").select(
        F.col("id_").alias(id_col),
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        digest.alias("groups_sha256"),
        *(["groups"] if keep_groups else []),
    )
