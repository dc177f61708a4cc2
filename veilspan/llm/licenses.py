"""License scans by ordered signature rules.

A text is reduced to its words in lower case and put to hundreds of rules, a pattern over the words
each. A rule only runs if the literals that its pattern needs are there; there is no other gate, so
the literals of most rules rule out most texts. Overlapping detections are resolved by the rules' order: those of higher
priority first, then longer ones; a detection inside an accepted one is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import ship

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True

#: Phrases of the base and their labels: fixed values.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Label, how the name is written, and the versions that are told apart. Fixed values.
FAMILIES = (
    ("mit", "mit|expat", ()),
    ("apache", "apache(?: software)?", ("1 0", "1 1", "2 0", "2")),
    ("gpl", "gnu general public|gnu gpl|gpl", ("1", "2", "3")),
    ("lgpl", "gnu (?:lesser|library) general public|gnu lgpl|lgpl", ("2", "2 1", "3")),
    ("agpl", "(?:gnu )?affero general public|gnu agpl|agpl", ("1", "3")),
    ("gfdl", "gnu free documentation|gfdl", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla public|mpl", ("1 0", "1 1", "2 0")),
    ("bsd", "bsd|berkeley software distribution", ("2 clause", "3 clause", "4 clause", "0 clause")),
    ("cc-by", "cc by|creative commons attribution", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc by sa|creative commons attribution share ?alike", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc by nd|creative commons attribution no ?deriv(?:ative)?s", ("2 0", "3 0", "4 0")),
    ("cc-by-nc", "cc by nc|creative commons attribution non ?commercial", ("2 0", "2 5", "3 0", "4 0")),
    (
        "cc-by-nc-sa",
        "cc by nc sa|creative commons attribution non ?commercial share ?alike",
        ("2 0", "2 5", "3 0", "4 0"),
    ),
    (
        "cc-by-nc-nd",
        "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s",
        ("2 0", "3 0", "4 0"),
    ),
    ("cc0", "cc0|creative commons zero", ("1 0",)),
    ("isc", "isc|internet systems consortium", ()),
    ("unlicense", "un", ()),
    ("zlib", "zlib(?: libpng)?", ()),
    ("boost", "boost software|bsl", ("1 0",)),
    ("artistic", "(?:perl )?artistic", ("1 0", "2 0")),
    ("epl", "eclipse public|epl", ("1 0", "2 0")),
    ("cpl", "common public|cpl", ("1 0",)),
    ("cddl", "common development and distribution|cddl", ("1 0", "1 1")),
    ("eupl", "european union public|eupl", ("1 0", "1 1", "1 2")),
    ("ofl", "sil open font|open font|ofl", ("1 0", "1 1")),
    ("afl", "academic free|afl", ("2 1", "3 0")),
    ("osl", "open software|osl", ("2 1", "3 0")),
    ("ms-pl", "microsoft public|ms pl", ()),
    ("ms-rl", "microsoft reciprocal|ms rl", ()),
    ("python", "python software foundation|psf", ("2",)),
    ("php", "php", ("3 0", "3 01")),
    ("postgresql", "postgresql", ()),
    ("openssl", "openssl", ()),
    ("ncsa", "university of illinois ncsa open source|ncsa", ()),
    ("x11", "x11", ()),
    ("odbl", "open (?:data commons open )?database|odbl", ("1 0",)),
    ("wtfpl", "do what the fuck you want to public|wtfpl", ("2",)),
    ("zpl", "zope public|zpl", ("2 0", "2 1")),
    ("w3c", "w3c software", ()),
)
#: Word bytes in lower case, and blanks for all others.
_PLAIN = bytes(32 if not _WORD[c] else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Rule(NamedTuple):
    label: str
    keywords: tuple[str, ...]  # without all of them the pattern cannot match
    needs: str  # nor without this
    pattern: re.Pattern
    priority: int
    relevance: float


class Detection(NamedTuple):
    start: int
    end: int  # words from start up to, but not with, end
    label: str
    priority: int
    relevance: float


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """Rules by priority: identifiers, statements, names with a version, names alone."""
    made: list[tuple] = []
    spoken = "(?:released|licensed|distributed|available|published|provided|made available)"
    for label, written, versions in FAMILIES:
        # The longest literal run of each way to write the name, at least one of which must occur.
        keys = tuple(
            max(re.split(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\??|.\?", f" {way}"), key=len).rstrip()
            for way in _ways(written)
        )
        name, own = f"(?:{written})", label.replace("-", " ")
        licence = " ?licen[cs]e" if label == "unlicense" else "(?: public)? licen[cs]e"
        later = "(?: or(?: at your option)? (?:any )?later(?: version)?)?"
        for version in (*versions, ""):
            full = f"{label}-{version.removesuffix(' clause').removesuffix(' 0').replace(' ', '.')}"
            full = full if version else label
            word = "" if label == "bsd" else "(?: version| v)?"
            tail = f"(?: licen[cs]e)?{word} ?{version}{later}" if version else licence
            spdx = f"spdx license identifier {own}" + f" {version}" * bool(version)
            said = f"{spoken} under (?:the )?(?:terms of )?(?:the )?{name}{tail}"
            alone = f"{name}{tail}" + "(?: licen[cs]e)?" * bool(version)
            needs = version or "licen"
            made.append((full, (" spdx license identifier",), needs, spdx, 4 + bool(version), 1.0))
            made.append((full, keys, needs, said, 2 + bool(version), 0.95))
            made.append((full, keys, needs, alone, int(bool(version)), 0.8 if version else 0.6))
    return tuple(
        Rule(label, keys, needs, re.compile(f" {pattern}(?= )"), priority, relevance)
        for label, keys, needs, pattern, priority, relevance in sorted(made, key=lambda r: -r[4])
    )


def _ways(written: str) -> list[str]:
    """The alternatives of a pattern that are not inside a group."""
    ways, depth = [""], 0
    for c in written:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            ways.append("")
        else:
            ways[-1] += c
    return ways


@lru_cache(1)
def _by_literals() -> tuple[tuple[tuple[str, ...], tuple[tuple[str, tuple[Rule, ...]], ...]], ...]:
    """Rules by their keywords, and then by what else they need."""
    groups: dict[tuple[str, ...], dict[str, list[Rule]]] = {}
    for rule in rules():
        groups.setdefault(rule.keywords, {}).setdefault(rule.needs, []).append(rule)
    return tuple((keys, tuple((n, tuple(r)) for n, r in own.items())) for keys, own in groups.items())


def candidates(words: str) -> list[Rule]:
    """The rules whose literals are all in the blank-joined words; no other one can match."""
    return [
        rule
        for keys, own in _by_literals()
        if any(key in words for key in keys)
        for needs, some in own
        if needs in words
        for rule in some
    ]


def base_places(words: str) -> list[tuple[int, str]]:
    """Offsets in the blank-joined words where a base phrase stands, with its label."""
    found = []
    for phrase, label in BASE:
        at = words.find(f" {phrase} ")
        while at >= 0:
            found.append((at + 1, label))
            at = words.find(f" {phrase} ", at + 1)
    return found


def detections(words: str, starts: list[int], put: list[Rule]) -> list[Detection]:
    """What stays of the matches of the rules ``put`` to the words after suppression, by place."""
    found = []
    for rule in put:
        for m in rule.pattern.finditer(words):
            first = bisect_right(starts, m.start() + 1) - 1
            last = bisect_right(starts, m.end() - 1) - 1
            found.append(Detection(first, last + 1, rule.label, rule.priority, rule.relevance))
    found.sort(key=lambda d: (-d.priority, d.start - d.end, d.start, d.label))
    # reach[i]: the farthest end of accepted detections by start, as a tree of prefix maxima.
    begins = sorted({d.start for d in found})
    reach = [0] * (len(begins) + 1)
    kept: list[Detection] = []
    for d in found:
        own = at = bisect_right(begins, d.start)
        farthest = 0
        while at:
            farthest = max(farthest, reach[at])
            at &= at - 1
        if farthest >= d.end:
            continue
        kept.append(d)
        while own < len(reach):
            reach[own] = max(reach[own], d.end)
            own += own & -own
    return sorted(kept, key=lambda d: (d.start, d.end))


SCHEMA = (
    "n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,"
    "labels:string,score:double,"
    "detections:array<struct<start:int,end:int,label:string,priority:int,relevance:double>>"
)


def scan_texts(texts: list[str]) -> list[tuple]:
    """Of each text the values of ``SCHEMA``."""
    out = []
    for text in texts:
        found = text.encode().translate(_PLAIN).split()
        words = f" {b' '.join(found).decode()} "
        places, put = base_places(words), candidates(words)
        if not places and not put:
            out.append((len(found), 0, None, None, "", "", 0.0, []))
            continue
        starts = (np.cumsum([1, *[len(w.decode()) + 1 for w in found]])[:-1]).tolist()
        places = [(bisect_right(starts, at) - 1, label) for at, label in places]
        kept = detections(words, starts, put)
        base = {label for _, label in places}
        score = max([d.relevance for d in kept] + [0.9] * bool(places), default=0.0)
        at = [p for p, _ in places]
        out.append((
            len(found), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {d.label for d in kept})), score, [d._asdict() for d in kept],
        ))
    return out


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``license``: n_words, n_base, first_word, last_word (of the
    base phrases), base_labels, labels, score, and the detections with their word intervals.

    Null and empty texts have no words, no labels and score 0. Rows come back as they are; a
    column ``license`` is replaced.
    """
    ship(docs.sparkSession)

    @F.pandas_udf(f"struct<{SCHEMA}>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split(":")[0] for c in SCHEMA.split(",")[:7]] + ["detections"]
        for batch in batches:
            frame = pd.DataFrame(scan_texts([t or "" for t in batch]), columns=names)
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn("license", found(F.col(text_col)))
