"""The detectors, labels and formats, and their form in Java's regex dialect."""

import re
from functools import lru_cache

# --- Fixed values -----------------------------------------------------------------------

# Detector types in registry order, with the pattern each one scans for.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(\+1[-.]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "creditCard": r"\b(?:\d{4}[-\s]){3}\d{4}\b",
    "zipCode": r"\b\d{5}-\d{4}\b",
    "ipAddress": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "date": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
}

# Label that replaces a span of each type; any other type becomes its upper case in brackets.
LABELS = {
    "email": "[EMAIL]",
    "phone": "[PHONE]",
    "ssn": "[SSN]",
    "creditCard": "[CARD]",
    "zipCode": "[ZIP]",
    "ipAddress": "[IP]",
    "date": "[DATE]",
    "person": "[NAME]",
    "org": "[ORG]",
    "location": "[LOCATION]",
    "misc": "[MISC]",
}

# Entity tag of each type inside a token; any other type becomes its lower case.
ENTITIES = {
    "email": "email",
    "phone": "phone",
    "ssn": "ssn",
    "creditCard": "card",
    "zipCode": "zip",
    "ipAddress": "ip",
    "date": "date",
    "person": "name",
    "org": "org",
    "location": "location",
    "misc": "misc",
}

# Span type of each named-entity tag; any other tag becomes its lower case.
NER_TYPES = {
    "PER": "person",
    "PERSON": "person",
    "ORG": "org",
    "ORGANIZATION": "org",
    "LOC": "location",
    "LOCATION": "location",
    "MISC": "misc",
}

# Types kept from the named-entity detector unless the caller says otherwise.
NER_ENABLED = ("person", "org", "location", "misc")

# Restorable token, with or without an entity tag.
TOKEN = r"\[REDACTED(?:_[A-Z]+)?_[a-f0-9]{8}\]"
TOKEN_HEX = 8

# Invisible characters that are deleted before scanning (members of a character class).
INVISIBLE = (
    r"\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}"
    r"\x{17B4}\x{17B5}\x{180E}\x{3164}\x{FFA0}\x{E0020}-\x{E007F}"
)

# What `\s` and a JavaScript trim mean (members of a character class).
_ASCII_SPACE = r"\t\n\x0B\f\r "
SPACE = _ASCII_SPACE + (
    r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
    r"\x{3000}\x{FEFF}"
)

# --- Forms for Spark (Java regex) -------------------------------------------------------

TYPES = tuple(PATTERNS)
VALIDATED = ("creditCard", "ipAddress")

# `\b` is ASCII in the detectors but follows Unicode letters on Java 17, so boundaries are
# spelled out. Every detector ends on a word character, and all but e-mail start on one.
_WORD = "[A-Za-z0-9_]"
_END = f"(?!{_WORD})"
_BOUNDARY = r"\b"

# An e-mail may only start at a word boundary. All boundaries inside one run of address
# characters succeed or fail together, so each run is tried once: from its beginning, where the
# punctuation that opens it (group 1) is left out of the value (group 2), or from where the
# previous match stopped inside it.
_LOCAL = "[A-Za-z0-9._%+-]"
_PUNCT = "[.%+-]"
_EMAIL_START = rf"(?:(?<!{_LOCAL})({_PUNCT}*+)(?={_WORD})|\G(?<={_WORD})(?={_PUNCT}))"

# Detectors whose value is group 2 and whose group 1 belongs to the gap before it.
LED = ("email",)

# How each other pattern begins, and the same in an order that turns most positions away by their
# first characters: those are tested before the look-behind, which costs more than they do.
_FIRST = f"(?<!{_WORD}\\d)"
_BEGINS = {
    "phone": (
        r"(\+1[-.]?)?\(?\d{3}\)?",
        r"(?=[(+0-9])(?:\d|\(\d|\+1[-.]?\(?\d)\d\d\)?",
    ),
    "ssn": (r"\b\d{3}-", rf"\d(?=\d\d-){_FIRST}\d\d-"),
    "creditCard": (r"\b(?:\d{4}[-\s]){3}", rf"\d(?=\d{{3}}[-\s]){_FIRST}\d{{3}}[-\s](?:\d{{4}}[-\s]){{2}}"),
    "zipCode": (r"\b\d{5}-", rf"\d(?=\d{{4}}-){_FIRST}\d{{4}}-"),
    "ipAddress": (r"\b(?:\d{1,3}\.){3}", rf"\d(?=\d{{0,2}}\.\d){_FIRST}\d{{0,2}}\.(?:\d{{1,3}}\.){{2}}"),
    "date": (r"\b\d{1,2}[/-]", rf"\d(?=\d?[/-]\d){_FIRST}\d?[/-]"),
}


def _quick(pattern: str) -> str:
    """The same pattern in the form that Java tests fastest: single ASCII characters in a class are
    one lookup in a table, ranges and ``\\d`` are calls one after the other."""

    def listed(cls: re.Match) -> str:
        single = re.sub(
            r"([A-Za-z0-9])-([A-Za-z0-9])",
            lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))),
            cls[0],
        )
        if SPACE not in single:
            return single
        ascii_part = single.replace(SPACE, _ASCII_SPACE)
        return rf"(?:{ascii_part}|(?![\x00-\x7F])[{SPACE.removeprefix(_ASCII_SPACE)}])"

    pattern = re.sub(r"\\d\{(\d)\}", lambda m: r"\d" * int(m[1]), pattern)
    pattern = re.sub(r"\[[^\]]*\]", listed, pattern)
    return re.sub(r"\\d(?!\(\?=)", "[0123456789]", pattern)


@lru_cache
def java_pattern(kind: str) -> str:
    """The detector's pattern with ASCII boundaries and JavaScript white space."""
    body = PATTERNS[kind].removesuffix(r"\b")
    if kind in LED:
        body = body.removeprefix(_BOUNDARY).replace("+@", "++@")
        return _quick(f"{_EMAIL_START}({body}{_END})")
    slow, fast = _BEGINS[kind]
    return _quick((fast + body.removeprefix(slow)).replace(r"\s", SPACE) + _END)


# A text without any of these shapes cannot match a digit detector: three digits next to
# three digits (phone, card, ZIP+4), a dashed or slashed date or number (ssn, date), or
# dotted numbers (IP). One cheap scan then spares the six detector scans.
DIGIT_GATE = _quick(
    rf"\d(?:\d\d\)?[-.{SPACE}]?\d{{3}}|[/-]\d{{1,2}}[/-]\d\d|\.\d{{1,3}}\.\d{{1,3}}\.\d)"
)

# A text may be cut after any of these: no match holds such a character, and none looks behind or
# ahead past it. White space stands in a match only before a digit.
CUT_AFTER = rf"(?:[^A-Za-z0-9._%+@()/\-{SPACE}]|[{SPACE}](?!\d))"

# The look-ahead turns most characters away before the long class is tried.
INVISIBLE_CHAR = rf"(?![\x00-\x{{00AC}}])[{INVISIBLE}]"
NOT_BLANK = f"[^{SPACE}]"
