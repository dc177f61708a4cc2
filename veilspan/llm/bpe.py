"""Byte-level BPE over whole texts by overlapping chunks.

A text is dealt out in chunks that overlap. Every chunk is split into pre-tokens on its own. Where
two neighbours have a boundary in common inside their overlap they have resynchronised: from there
on both see the same pre-tokens, because the pattern only looks ahead. The text is cut there, and
each piece is encoded by the rank file. A neighbour that has no boundary in common (a run longer
than the overlap) is joined to the piece before it, so the ids never depend on the chunks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import ship

#: Characters that a chunk owns, and how many more of its successor's it sees.
CHUNK, OVERLAP = 32_768, 256
#: A match this close to a chunk's end may go on behind it.
LOOK_AHEAD = 3
#: Words whose ids a task remembers before it starts afresh.
REMEMBER = 400_000

SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(2)
def encoding(ranks_path: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@lru_cache(1)
def _pattern():
    return regex.compile(public_tokenizers.PATTERN)


class Encoder(dict):
    """Ids of a piece as little-endian unsigned 32-bit integers.

    A blank behind another character always starts a pre-token, so a piece can be encoded word by
    word, and the words remembered. A word that begins with white space could belong to a longer
    run of it; a piece with such a word is encoded in one go.
    """

    def __init__(self, ranks_path: str):
        self.encoding = encoding(ranks_path)

    def plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes | None:
        if len(self) >= REMEMBER:
            self.clear()
        whole = not word or word[0].isspace() or len(word) > 64
        ids = None if whole else self.plain(" " + word)
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        head, *words = text.split(" ")
        try:
            return self.plain(head) + b"".join([self[w] for w in words])
        except TypeError:
            return self.plain(text)


def boundaries(text: str) -> np.ndarray:
    """Where the pre-tokens of a text begin that may be cut off there: what ends in white space
    would be split in another way without its successor, and a match near the end may go on."""
    starts = [m.start() for m in _pattern().finditer(text)]
    last = len(text) - LOOK_AHEAD
    kept = [at for at in starts if 0 < at <= last and not text[at - 1].isspace()]
    return np.array(kept, dtype=np.int64)


def seams(chunk: str, size: int, overlap: int) -> tuple[bytes, bytes]:
    """Sure boundaries in the overlap with the chunk before, and in that with the one behind."""
    sure = boundaries(chunk)
    return sure[sure < overlap].tobytes(), (sure[sure >= size] - size).tobytes()


def stitch(text: str, heads: list[bytes], tails: list[bytes], size: int, overlap: int) -> list[int]:
    """Where the text can be cut: 0, and the first common boundary of every two neighbours."""
    cuts = [0]
    right = np.frombuffer(tails[0], dtype=np.int64) if tails else np.empty(0, np.int64)
    for k in range(1, len(heads)):
        common = np.intersect1d(right, np.frombuffer(heads[k], dtype=np.int64), assume_unique=True)
        if len(common):
            cuts.append(k * size + int(common[0]))
            right = np.frombuffer(tails[k], dtype=np.int64)
        else:
            piece = text[cuts[-1] : (k + 1) * size + overlap]
            starts = boundaries(piece) + cuts[-1] - (k + 1) * size
            right = starts[starts >= 0]
    return cuts


def digests(ids: bytes, encoder: Encoder) -> tuple[int, str, str]:
    decoded = encoder.encoding.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode_decode(
    docs: DataFrame,
    ranks_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = CHUNK,
    overlap: int = OVERLAP,
    keep_ids: bool = False,
) -> DataFrame:
    """Per row of ``docs``: its id, the number of ids, and digests of the ids and of the bytes
    they decode to; with ``keep_ids`` also the ids (``ids``, little-endian unsigned 32 bit).

    A null text counts as empty and gives no ids. Rows are never merged: repeated rows and null
    document ids come back as often as they are given. Other columns of ``docs`` are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {SCHEMA}" + ", ids binary" * keep_ids
    columns = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    length = F.length("text_")

    def result(keys: list, texts: list[list[str]]) -> pd.DataFrame:
        encoder, out = _encoder(ranks_path), []
        for key, pieces in zip(keys, texts, strict=True):
            ids = b"".join([encoder.encode(piece) for piece in pieces])
            out.append((key, *digests(ids, encoder), *[ids] * keep_ids))
        frame = pd.DataFrame(out, columns=columns)
        return frame.astype({id_col: "Int64"}) if kind in ("bigint", "int") else frame

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield result(_keys(batch[id_col]), [[text] for text in batch["text_"]])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [seams(text, size, overlap) for text in batch["text_"]]
            yield batch.assign(head=[x[0] for x in found], tail=[x[1] for x in found])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        first = group["chunk"] == 0
        keys = _keys(group[id_col][first])
        chunks = group.drop_duplicates("chunk").sort_values("chunk")
        text = "".join([c[:size] for c in chunks["text_"]])
        cuts = stitch(text, list(chunks["head"]), list(chunks["tail"]), size, overlap)
        pieces = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]
        return result(keys, [pieces] * len(keys))

    number = F.explode(F.sequence(F.lit(0), ((length - 1) / size).cast("int")))
    chunks = (
        rows.filter(length > size)
        .select(id_col, "text_", F.xxhash64("text_").alias("hash_"), number.alias("chunk"))
        .withColumn("text_", F.expr(f"substring(text_, chunk * {size} + 1, {size + overlap})"))
        .repartition(F.col("hash_"), F.col("chunk"))
    )
    split_schema = f"{id_col} {kind}, text_ string, hash_ long, chunk int, head binary, tail binary"
    long = (
        chunks.mapInPandas(split, split_schema)
        .groupBy(id_col, "hash_")
        .applyInPandas(join, schema)
    )
    return rows.filter(length <= size).mapInPandas(short, schema).unionByName(long)


@lru_cache(1)
def _encoder(ranks_path: str) -> Encoder:
    return Encoder(ranks_path)


def _keys(column: pd.Series) -> list:
    """Ids as Python objects: a column with nulls arrives as floats."""
    return [None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in column]
