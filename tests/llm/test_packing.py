import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilspan.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def ids_of(texts):
    return [e.ids + [0] for e in tokenizer().encode_batch(texts, add_special_tokens=False)]


def check(rows, found, capacity):
    own = defaultdict(list)
    for r in found:
        own[r.doc_id].append(r)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append(r)
    for (i, _), ids in zip(rows, ids_of([t or "" for _, t in rows])):
        parts = sorted(own[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert sum(r.length for r in parts) == len(ids)
        assert all(r.length == capacity for r in parts[1:]) and len(parts) == -(-len(ids) // capacity)
        for r in parts:
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    for members in bins.values():
        members.sort(key=lambda r: r.offset)
        at = 0
        for r in members:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bins)


def test_pieces_and_sequences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = packing.pack(docs.repartition(5), RANKS).collect()
    n = check(rows, found, 2048)
    tokens = sum(r.length for r in found)
    assert n <= -(-tokens // 2048) * 1.02 + 2


def test_underfull_bins_of_many_tasks_are_merged(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEAST", 2)
    rng = random.Random(1)
    rows = [(i, "a " * rng.randint(0, 40)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    found = packing.pack(docs, RANKS, capacity=64).collect()
    n = check(rows, found, 64)
    assert n <= sum(r.length for r in found) / 64 * 1.1 + 3


def test_best_fit_prefers_the_fullest_bin():
    assert packing.best_fit([5, 4, 3, 2], 7) == [[0, 3], [1, 2]]
    assert packing.best_fit([], 7) == []


def test_rows_of_any_kind(spark):
    rows = [(1, None), (1, ""), (None, "x y"), (None, None), (2, "word " * 3000), (2, "word " * 3000)]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, load int, piece int")
    found = packing.pack(docs, RANKS).collect()
    ids = {t: len(x) for t, x in zip(("", "x y", "word " * 3000), ids_of(["", "x y", "word " * 3000]))}
    assert sum(r.length for r in found) == 3 * ids[""] + ids["x y"] + 2 * ids["word " * 3000]
    assert sum(r.doc_id is None for r in found) == 2
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found)
    assert packing.pack(docs.limit(0), RANKS).count() == 0


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|> x", "x  <|endoftext|>", "<|endoftext|>", "a <|endoftext|><|endoftext|>\n b's <|endoftext|", "<|endoftext|>" * 5000, "no such <|endofText|>"])
def test_added_tokens_are_one_id_as_in_the_tokenizer_by_default(spark, text):
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [*made.encode(text, add_special_tokens=False).ids, 0]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = sorted(packing.pack(docs, RANKS).collect(), key=lambda r: r.piece)
    assert sum(r.length for r in found) == len(ids)
    for r in found:
        part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
