"""Best-fit packing of tokenised documents into sequences, by a hierarchy of residuals.

Every task packs the pieces of its own documents best-fit. Bins that are nearly full, or that no
other bin anywhere fits into, are emitted. The others go on as items of their own: fewer tasks get
the underfull bins of several and pack them best-fit again, round after round, until one task or
no possible merge is left. A bin carries its pieces along; there are at most ``capacity`` of them,
since a piece has a token at least.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.bpe import Encoder, _encoder, _keys
from veilspan.llm.common import cut_lineage, ship

CAPACITY = 2048
#: A bin with so little room left is emitted at once.
NEARLY = 8
#: So many tasks' underfull bins meet in one, and so many bins a task gets at least.
FAN_IN, LEAST = 4, 20_000

_PIECE = np.dtype([(c, "<i8") for c in ("doc_id", "no_id", "piece", "start", "length", "crc")])
BINS = "load int, pieces binary"


@lru_cache(2)
def added_tokens(ranks_path: str) -> dict[str, bytes]:
    """Contents of the added tokens of the JSON beside a rank file, and their ids; none without it.

    They stand for themselves wherever they occur. Flags by which they would match in another way
    raise, because nothing here follows them.
    """
    beside = os.path.splitext(ranks_path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as file:
        made = json.load(file)
    for token in made["added_tokens"]:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"added token {token['content']!r} with flags: {beside}")
    return {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in made["added_tokens"]}


@lru_cache(2)
def _added_pattern(ranks_path: str) -> re.Pattern | None:
    longest = sorted(added_tokens(ranks_path), key=len, reverse=True)
    return re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None


def ids_of(text: str, encoder: Encoder, ranks_path: str) -> bytes:
    """The ids of a text: one for each added token, those of its ranks for what is between them."""
    pattern = _added_pattern(ranks_path)
    if pattern is None:
        return encoder.encode(text)
    between, *rest = pattern.split(text)
    if not rest:
        return encoder.encode(text)
    added = added_tokens(ranks_path)
    out = [encoder.encode(between)]
    for token, between in zip(rest[::2], rest[1::2], strict=True):
        out += [added[token], encoder.encode(between)]
    return b"".join(out)


def pieces(ids: bytes, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int]]:
    """Piece, start, length and checksum of each piece of a document's ids and the closing 0."""
    ids += b"\0\0\0\0"
    n = len(ids) // 4
    start, length = 0, n % capacity or capacity
    piece = 0
    while start < n:
        yield piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start, length, piece = start + length, capacity, piece + 1


def best_fit(loads: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Items by bin: the longest first, each where the least room is left."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with room r is open
    for item in sorted(range(len(loads)), key=lambda i: -loads[i]):
        load = loads[item]
        fits = rooms >> load
        if fits:
            room = load + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        left = room - load
        by_room[left].append(at)
        rooms |= 1 << left
    return bins


def _merged(loads: list[int], blobs: list[bytes], capacity: int) -> pd.DataFrame:
    bins = best_fit(loads, capacity)
    return pd.DataFrame(
        {
            "load": [sum([loads[i] for i in b]) for b in bins],
            "pieces": [b"".join([blobs[i] for i in b]) for b in bins],
        }
    )


def pack(
    docs: DataFrame,
    ranks_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """Per piece of a document: its id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its text, by the ranks at ``ranks_path`` and the added tokens of
    the JSON file of the same name beside it, and the id 0. A null or empty text is the id 0 alone. A document longer than ``capacity`` is cut from its end into
    full pieces. Repeated rows and null ids are documents like others. An empty table gives no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder: Encoder = _encoder(ranks_path)
        loads, blobs = [], []
        for batch in batches:
            for key, text in zip(_keys(batch["id_"]), batch["text_"], strict=True):
                for piece, start, length, crc in pieces(ids_of(text, encoder, ranks_path), capacity):
                    row = np.array(
                        [(key or 0, key is None, piece, start, length, crc)], dtype=_PIECE
                    )
                    loads.append(length)
                    blobs.append(row.tobytes())
        yield _merged(loads, blobs, capacity)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads, blobs = [], []
        for batch in batches:
            loads += batch["load"].tolist()
            blobs += batch["pieces"].tolist()
        yield _merged(loads, blobs, capacity)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [np.frombuffer(x, dtype=_PIECE) for x in batch["pieces"]]
            if not parts:
                continue
            counts = [len(x) for x in parts]
            rows = np.concatenate(parts)
            ends = np.concatenate([np.cumsum(x["length"]) for x in parts])
            keys = pd.array(rows["doc_id"], dtype="Int64")
            keys[rows["no_id"] == 1] = pd.NA
            yield pd.DataFrame(
                {
                    id_col: keys,
                    "piece": rows["piece"].astype(np.int32),
                    "start": rows["start"],
                    "length": rows["length"],
                    "ids_crc32": rows["crc"],
                    "sequence_id": np.repeat(batch["sequence_id"].to_numpy(), counts),
                    "offset": ends - rows["length"],
                }
            )

    rows = docs.select(
        F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_")
    )
    bins = cut_lineage(rows.mapInPandas(first, BINS))
    done: list[DataFrame] = []
    tasks = None
    while True:
        # At most ``capacity`` rows: how many bins there are of each load.
        counts = {r["load"]: r["n"] for r in bins.groupBy("load").agg(F.count("*").alias("n")).collect()}
        most = capacity - max(NEARLY, min(counts, default=capacity))
        under = sum(n for load, n in counts.items() if load <= most)
        if sum(n for load, n in counts.items() if load <= capacity // 2) == 0 or under < 2 or tasks == 1:
            done.append(bins)
            break
        fewer = -(-under // LEAST)
        if tasks is not None:
            fewer = max(-(-tasks // FAN_IN), -(-under // (8 * LEAST)))
            if fewer >= tasks:
                done.append(bins)
                break
        tasks = fewer
        done.append(bins.filter(F.col("load") > most))
        left = bins.filter(F.col("load") <= most).repartition(tasks)
        bins = cut_lineage(left.mapInPandas(again, BINS))
    all_bins = reduce(DataFrame.unionByName, done)
    numbered = all_bins.select("pieces", F.monotonically_increasing_id().alias("sequence_id"))
    schema = (
        f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long"
    )
    return numbered.mapInPandas(unpack, schema)
