"""Personal data in whole texts: fixed patterns, and a linear-chain conditional random field.

The patterns give the base spans. The field reads the tokens around digits and @ signs, by
features of their shapes, is trained from a small labelled table (``labelled()``), and is decoded
by Viterbi in numpy batches. It adds spans that the patterns miss (numbers written another way,
keys and tokens). A span of it must hold a digit or an @, and one that touches a base span is
dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import ship

Span = tuple[str, int, int]

#: Kinds of the base, in the order of the results, and the one that only the field finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")

# The base's fixed values. Possessive runs and the look-behind give the same matches in one pass.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[Span]:
    """Each @ has one possible start: that of the run of local characters before it."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append(("email", start, done))
        else:
            done = at + 1
        at = text.find("@", done)
    return found


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    doubled = sum([v * 2 - 9 * (v > 4) for v in values[1::2]])
    return (sum(values[0::2]) + doubled) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans by kind, then start."""
    found = emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


# --- the field ---

_TOKEN = re.compile(r"[^\W_]+|[^\s]")
#: Tokens around one with a digit or an @ that the field reads.
CONTEXT = 5
_WINDOW = re.compile(r"[0-9@]")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
BITS = 12


def segments(text: str) -> list[list[tuple[int, int]]]:
    """Stretches of a line's tokens, each near a token with a digit or an @, as (start, end)."""
    marks = [m.start() for m in _WINDOW.finditer(text)]
    out: list[list[tuple[int, int]]] = []
    done = 0  # everything before was looked at
    i = 0
    while i < len(marks):
        # Tokens are short as a rule, so a stretch of characters around the mark holds the context.
        low = max(done, marks[i] - 64)
        while low > done and not text[low - 1].isspace():
            low -= 1
        high = marks[i]
        while True:
            high = min(len(text), high + 64)
            while high < len(text) and not text[high].isspace():
                high += 1
            while i < len(marks) and marks[i] < high:
                last = marks[i]
                i += 1
            if high - last >= 64 or high == len(text):
                break
        tokens = [m.span() for m in _TOKEN.finditer(text, low, high)]
        hot = [k for k, (a, b) in enumerate(tokens) if _WINDOW.search(text, a, b)]
        near: list[int] = []
        for k in hot:
            near.extend(range(max(k - CONTEXT, near[-1] + 1 if near else 0), min(k + CONTEXT + 1, len(tokens))))
        segment: list[tuple[int, int]] = []
        for last_k, k in zip([None, *near], near, strict=False):
            gap = last_k is not None and k == last_k + 1
            if segment and not (gap and "\n" not in text[segment[-1][1] : tokens[k][0]]):
                out.append(segment)
                segment = []
            segment.append(tokens[k])
        if segment:
            out.append(segment)
        done = high
    return out


@lru_cache(200_000)
def _shape(token: str) -> tuple[str, ...]:
    size = len(token)
    if token.isdigit():
        return f"d{min(size, 20)}", "digits"
    if token.isalpha():
        return f"w{min(size, 6)}", "=" + token.lower()[:12]
    if size == 1:
        return "p" + token, "mark"
    hexed = all(c in "0123456789abcdefABCDEF" for c in token)
    return ("hex" if hexed else "mixed") + str(min(size // 8, 4)), "alnum"


def features(text: str, tokens: list[tuple[int, int]]) -> np.ndarray:
    """Hashed features of each token: its shape, its neighbours' and whether blanks part them."""
    shapes = [("<", "<"), ("<", "<")]
    shapes += [_shape(text[a:b]) for a, b in tokens]
    shapes += [(">", ">"), (">", ">")]
    rows = []
    for k, (a, b) in enumerate(tokens):
        (p2, _), (p1, q1), (s, t), (n1, r1), (n2, _) = shapes[k : k + 5]
        left = k > 0 and tokens[k - 1][1] == a
        right = k + 1 < len(tokens) and tokens[k + 1][0] == b
        named = (
            f"0{s}", f"1{t}", f"2{p1}", f"3{q1}", f"4{n1}", f"5{r1}", f"6{p1}|{s}|{left}",
            f"7{s}|{n1}|{right}", f"8{p2}|{p1}|{s}", f"9{s}|{n1}|{n2}", f"a{left}{right}{t}",
        )
        rows.append([_bucket(x) for x in named])
    return np.array(rows, dtype=np.int64)


@lru_cache(200_000)
def _bucket(name: str) -> int:
    return crc32(name.encode()) & ((1 << BITS) - 1)


def labelled() -> list[tuple[str, list[Span]]]:
    """The small labelled table: sentences with the places of what they hold.

    A sentence is written with [kind value]; the numbers come from a rule, so that no real
    person's are in it.
    """
    rng = np.random.default_rng(7)

    def number(n: int) -> str:
        return "".join(str(d) for d in rng.integers(0, 10, n))

    def text(n: int, letters: str = "0123456789abcdef") -> str:
        return "".join(letters[i] for i in rng.integers(0, len(letters), n))

    def values() -> dict[str, str]:
        word = ["ana", "marc", "lee", "info", "sales", "x"][rng.integers(6)]
        host = ["example.com", "mail.example.org", "a.example.net"][rng.integers(3)]
        return {
            "E": f"[email {word}.{number(2)}@{host}]",
            "I": "[ip " + ".".join(str(x) for x in rng.integers(1, 255, 4)) + "]",
            "C": f"[card {number(4)} {number(4)} {number(4)} {number(4)}]", "D": f"[card {number(16)}]",
            "P": f"[phone +{number(1)} ({number(3)}) {number(3)}-{number(4)}]",
            "Q": f"[phone ({number(3)}) {number(3)}-{number(4)}]",
            "R": f"[phone {number(3)}-{number(3)}-{number(4)}]",
            "S": f"[secret {text(40)}]", "K": f"[secret {text(24, 'abcdefghijklmnopqrstuvwxyz0123456789')}]",
            "Y": str(1900 + rng.integers(150)), "N": number(1 + rng.integers(5)), "M": number(2),
        }

    patterns = (
        "write to E today", "E", "mail E or call P.", "from I to I", "host I is down",
        "paid with C last week", "card D expired", "the D of the", "call P now", "tel Q", "phone: Q or R",
        "reach me at R please", 'token = "S" of', "token = \"S\"### and", "api_key: K", "password = K;",
        "secret K", 'key="S"', "in Y there were N of them", "page N of N", "version N.N.M", "N.M percent",
        "on Y-M-M we met", "M:M in the morning", "chapter N, verse N", "cost N,N dollars", "room N",
        "the N and the N", "since Y", "N", "number N in (Y)", "N-N", "a@ b", "@ home in Y", "+N more",
        "the&&& P%%% a", "the*** E%%% a", "of### D$$$ la", "I!! THE!!", "und S der",
    )
    out = []
    for pattern in patterns * 8:
        given = values()
        marked = re.sub(r"\b[A-Z]\b", lambda m: given.get(m[0], m[0]), pattern)
        plain, spans, done = "", [], 0
        for m in re.finditer(r"\[(\w+) ([^\]]*)\]", marked):
            plain += marked[done : m.start()]
            spans.append((m[1], len(plain), len(plain) + len(m[2])))
            plain += m[2]
            done = m.end()
        out.append((plain + marked[done:], spans))
    return out


def _padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows)), *rows[0].shape[1:]), fill, dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """Weights of features by label, of label pairs, and of first labels."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray, first: np.ndarray):
        self.weights, self.pairs, self.first = weights, pairs, first

    def decode(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each segment by Viterbi, in batches of about the same length."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            while part:  # a batch of very long segments is cut by its cells
                n = max(1, min(len(part), 200_000 // len(rows[part[-1]])))
                self._decode(rows, part[-n:], out)
                part = part[:-n]
        return out

    def _decode(self, rows: list[np.ndarray], part: list[int], out: list[np.ndarray]) -> None:
        lengths = np.array([len(rows[i]) for i in part])
        padded = _padded([rows[i] for i in part], 0)
        size = padded.shape[1]
        score = self.weights[padded[:, 0]].sum(axis=1) + self.first
        back = np.zeros((len(part), size, len(LABELS)), dtype=np.int8)
        for t in range(1, size):
            reach = score[:, :, None] + self.pairs
            back[:, t] = reach.argmax(axis=1)
            new = reach.max(axis=1) + self.weights[padded[:, t]].sum(axis=1)
            score = np.where((t < lengths)[:, None], new, score)
        label = score.argmax(axis=1)
        path = np.zeros((len(part), size), dtype=np.int64)
        for t in range(size - 1, -1, -1):
            path[:, t] = label
            label = np.where(t < lengths, back[np.arange(len(part)), t, label], label)
        for i, p, n in zip(part, path, lengths, strict=True):
            out[i] = p[:n]


def train(table: list[tuple[str, list[Span]]], rounds: int = 80) -> Field:
    """Fit by Adam on the likelihood of the label chains, with a small L2 penalty."""
    rows, golds = [], []
    for text, spans in table:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        gold = np.zeros(len(tokens), dtype=np.int64)
        for kind, a, b in spans:
            inside = [k for k, (x, y) in enumerate(tokens) if a <= x and y <= b]
            gold[inside] = LABELS.index(f"I-{kind}")
            gold[inside[:1]] = LABELS.index(f"B-{kind}")
        rows.append(features(text, tokens))
        golds.append(gold)
    n_labels, n = len(LABELS), len(rows)
    lengths = np.array([len(r) for r in rows])
    x, y = _padded(rows, 0), _padded(golds, 0)
    live = np.arange(x.shape[1]) < lengths[:, None]
    params = [np.zeros((1 << BITS, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    eye = np.eye(n_labels)
    gold1 = eye[y] * live[..., None]
    gold2 = np.einsum("bti,btj->ij", gold1[:, :-1], gold1[:, 1:])
    for step in range(1, rounds + 1):
        weights, pairs, first = params
        emit = weights[x].sum(axis=2)
        size = x.shape[1]
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0] + first
        for t in range(1, size):
            new = _total(ahead[:, t - 1, :, None] + pairs, 1) + emit[:, t]
            ahead[:, t] = np.where(live[:, t, None], new, ahead[:, t - 1])
        for t in range(size - 2, -1, -1):
            new = _total(pairs + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(live[:, t + 1, None], new, 0.0)
        z = _total(ahead[:, -1], 1)
        p1 = np.exp(ahead + behind - z[:, None, None]) * live[..., None]
        p2 = np.zeros((n_labels, n_labels))
        for t in range(1, size):
            both = ahead[:, t - 1, :, None] + pairs + (emit[:, t] + behind[:, t])[:, None, :]
            p2 += (np.exp(both - z[:, None, None]) * live[:, t, None, None]).sum(axis=0)
        off = p1 - gold1
        grad_w = np.zeros_like(weights)
        flat = off.reshape(-1, n_labels)
        for f in range(x.shape[2]):
            np.add.at(grad_w, x[..., f].ravel(), flat)
        grads = [grad_w / n + 1e-4 * weights, (p2 - gold2) / n + 1e-4 * pairs, off[:, 0].sum(axis=0) / n]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] - 0.1 * (m[i] / (1 - 0.9**step)) / (
                np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8
            )
    return Field(*params)


@lru_cache(1)
def default_field() -> Field:
    return train(labelled())


def _spans_of(labels: np.ndarray, tokens: list[tuple[int, int]]) -> list[Span]:
    out: list[Span] = []
    before = "O"
    for label, (a, b) in zip(labels, tokens, strict=True):
        name = LABELS[label]
        if name != "O":
            kind = name[2:]
            if name[0] == "I" and before != "O" and before[2:] == kind:
                out[-1] = (kind, out[-1][1], b)
            else:
                out.append((kind, a, b))
        before = name
    return out


def find(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Of each text its base spans, and the spans that the field adds; by kind, then start."""
    base = [base_spans(t) for t in texts]
    owner, tokens, rows = [], [], []
    for i, text in enumerate(texts):
        for segment in segments(text):
            owner.append(i)
            tokens.append(segment)
            rows.append(features(text, segment))
    added: list[list[Span]] = [[] for _ in texts]
    for i, segment, labels in zip(owner, tokens, field.decode(rows), strict=True):
        if labels.any():
            own = _spans_of(labels, segment)
            added[i].extend(s for s in own if _WINDOW.search(texts[i], s[1], s[2]))
    out = []
    for own, more in zip(base, added, strict=True):
        if more and own:
            ends = sorted((a, b) for _, a, b in own)
            starts = np.array([a for a, _ in ends])
            upto = np.maximum.accumulate([b for _, b in ends])
            before = [int(np.searchsorted(starts, b)) for _, _, b in more]
            more = [s for s, k in zip(more, before, strict=True) if k == 0 or upto[k - 1] <= s[1]]
        out.append((own, sorted(more, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones united, replaced by its first kind."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


SCHEMA = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "masked_text string"
)


def detect(
    docs: DataFrame, text_col: str = "text", field: Field | None = None, mask: bool = True
) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans (all) and,
    with ``mask``, masked_text, as one struct column ``pii``.

    Null and empty texts have no spans; the masked text of a null is null. Rows come back as they
    are, repeated or without ids, and a column ``pii`` is replaced; the field is trained once on the driver and broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(field or default_field())

    @F.pandas_udf(f"struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            texts = batch.tolist()
            for start in range(0, len(texts), 500):
                part = [t or "" for t in texts[start : start + 500]]
                for text, given, (base, more) in zip(
                    part, texts[start : start + 500], find(part, sent.value), strict=True
                ):
                    counts = [sum([k == kind for k, _, _ in base]) for kind in BASE]
                    every = sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))
                    digest = hashlib.sha256(joined(base).encode()).hexdigest()
                    new = masked(text, every) if mask and given is not None else None
                    out.append((*counts, digest, joined(every), new))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.withColumn("pii", found(F.col(text_col)))
