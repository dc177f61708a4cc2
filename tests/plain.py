"""The detectors, merging and covering by brute force, for comparison on small inputs."""

import re

from veilspan.functions.patterns import LABELS, PATTERNS

JS_SPACE = (
    "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
)
COMPILED = {k: re.compile(p.replace(r"\s", JS_SPACE), re.ASCII) for k, p in PATTERNS.items()}
RANK = {k: i for i, k in enumerate(LABELS)}


def luhn(value):
    digits = [int(c) for c in re.sub(f"[-{JS_SPACE}]", "", value)][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def detect(text):
    found = []
    for kind, pattern in COMPILED.items():
        for m in pattern.finditer(text):
            if kind == "creditCard" and not luhn(m.group()):
                continue
            if kind == "ipAddress" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            found.append((kind, m.group(), m.start(), m.end()))
    return found


def hit(a, b):
    return a[2] < b[3] and a[3] > b[2]


def merge(base, extra):
    kept = list(base)
    for e in extra:
        if not any(hit(e, k) for k in kept):
            kept.append(e)
    return sorted(kept, key=lambda s: s[2])


def cover(text, spans):
    groups = []
    for s in sorted(spans, key=lambda s: (s[2], s[3])):
        if groups and s[2] < max(m[3] for m in groups[-1]):
            groups[-1].append(s)
        else:
            groups.append([s])
    out = []
    for g in groups:
        start, end = min(m[2] for m in g), max(m[3] for m in g)
        best = min(g, key=lambda m: (m[2] - m[3], RANK.get(m[0], len(RANK)), m[0]))
        out.append((best[0], text[start:end], start, end))
    return out


def redact(text, spans, label):
    for s in sorted(spans, key=lambda s: -s[2]):
        text = text[: s[2]] + label(s) + text[s[3] :]
    return text
