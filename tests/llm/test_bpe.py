import hashlib
import random

import numpy as np
import public_tokenizers

from veilspan.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["the", " ", "  ", "\n", " \n ", "\t", "don't", "'", "'s", "'re", "ll", "é", "日本語", "12", "!?", " ", "aaaa", "\r\n", "😀"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def plain(text):
    return np.array(bpe.encoding(RANKS).encode_ordinary(text), dtype="<u4").tobytes()


def chunked(text, size, overlap):
    chunks = [text[k : k + size + overlap] for k in range(0, max(1, len(text)), size)]
    pairs = [bpe.seams(c, size, overlap) for c in chunks]
    cuts = bpe.stitch(text, [p[0] for p in pairs], [p[1] for p in pairs], size, overlap)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def test_chunks_give_the_ids_of_the_whole_text():
    for text in texts(400, 1) + ["a" * 500, " " * 300 + "x", "'" * 90, "", "x'r" * 40]:
        for size, overlap in ((16, 8), (23, 5), (40, 30)):
            pieces = chunked(text, size, overlap)
            assert "".join(pieces) == text
            assert b"".join(map(plain, pieces)) == plain(text)


def test_remembered_words_give_the_same_ids():
    encoder = bpe.Encoder(RANKS)
    for text in texts(600, 2):
        assert encoder.encode(text) == plain(text)


def test_rows_of_any_kind(spark):
    long = " ".join(texts(300, 3))
    rows = [(1, long), (1, long), (2, None), (3, ""), (None, "word " * 3), (None, long + "!"), (4, "a b")]
    docs = spark.createDataFrame([(i, t, 7, b"x") for i, t in rows], "doc_id long, text string, ids int, chunk binary")
    found = bpe.encode_decode(docs, RANKS, size=1000, overlap=50, keep_ids=True).collect()
    got = sorted(map(repr, [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in found]))
    want = []
    for i, t in rows:
        ids = plain(t or "")
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert got == sorted(map(repr, want))
    assert bpe.encode_decode(docs.limit(0), RANKS).count() == 0
