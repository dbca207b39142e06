"""Secret scans: fixed patterns, and an assignment-aware lexer.

The lexer reads source and configuration syntax (``name = "x"``, ``"name": "x"``,
``name: x``, ``export NAME=x``, ``name := 'a' + 'b'``) into pairs of name and literal.
Names on a right-hand side stand for the literal that they were given last, and
concatenated literals count together. A literal is scored by how sensitive its target
names are and by how random it looks.

A name's value is a node that refers to the nodes it is joined from, so a value that is used
many times over is stored once, and a text costs time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame

from orrery.llm.common import per_text

SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long"
KINDS = "assign", "access", "hex", "literal"

_ASSIGN = re.compile(
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs of 24 or more

_TARGET = re.compile(r"(?<![\w.$-])[\"']?([A-Za-z_][\w.-]*+)[\"']?[ \t]*+(:=|=>|=(?!=)|:(?!:))[ \t]*+(?=[\"'`A-Za-z0-9_$<{+/-])")
_PIECE = re.compile(
    r"[ \t]*+(?:\"(?P<d>(?:[^\"\\\n]|\\.)*+)\"|'(?P<s>(?:[^'\\\n]|\\.)*+)'|`(?P<b>[^`\n]*+)`|(?P<name>[A-Za-z_][\w.]*+)(?![\w+/=-])|(?P<bare>[A-Za-z0-9+/_.=-]++))"
)
_PLUS = re.compile(r"[ \t]*[+.][ \t]*(?=[\"'`A-Za-z_])")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Parts of names that make an assignment sensitive, and their weight.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0,
    "credential": 2.5, "credentials": 2.5, "private": 1.5, "access": 1.0, "auth": 1.5, "key": 1.0, "api": 1.0,
    "signing": 1.5, "encryption": 1.5, "bearer": 2.5, "client": 0.5, "salt": 1.5, "pin": 1.0,
}
#: Words of literals that stand in for a secret, beside the sensitive ones.
PLACEHOLDERS = {
    "change", "changeme", "me", "example", "placeholder", "redacted", "undefined", "required", "your", "here", "dummy", "xxxx", "none", "null", "true",
    "false", "todo", "string", "optional", "my", "the", "value", "enter", "insert", "text", "type",
}
FILLERS = PLACEHOLDERS | {*SENSITIVE}
THRESHOLD = 4.5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of kind, end) of the fixed patterns."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def sensitivity(name: str) -> float:
    parts = [x.lower() for x in _SPLIT.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    return sum(SENSITIVE.get(x, 0.0) for x in {*parts, *joined})


class Value:
    """A literal, or values joined: what is needed of its text, where its literals stand, and its best target's weight.

    Characters are counted by themselves within ASCII and in 128 bins beyond it, so that a
    node's size does not depend on its text. Counts are floats, as joins may double them.
    """

    __slots__ = "counts", "classes", "space", "filler", "quoted", "span", "parts", "weight"

    def __init__(self, text: str = "", span: tuple[int, int] | None = None, quoted: bool = False, parts: tuple = ()):
        self.span, self.parts, self.weight = span, parts, 0.0
        if parts:
            self.counts = {}
            for part in parts:
                for c, n in part.counts.items():
                    self.counts[c] = min(1e200, self.counts.get(c, 0.0) + n)
            self.classes = frozenset().union(*(x.classes for x in parts))
            self.space, self.quoted = any(x.space for x in parts), any(x.quoted for x in parts)
            self.filler = all(x.filler for x in parts)
            return
        self.counts = {}
        for c, n in Counter(text).items():
            c = c if c < "\x80" else chr(128 + ord(c) % 128)
            self.counts[c] = self.counts.get(c, 0.0) + n
        checks = (("digit", str.isdigit), ("lower", str.islower), ("upper", str.isupper), ("mark", lambda c: not c.isalnum()))
        self.classes = frozenset(name for name, f in checks if any(map(f, self.counts if text.isascii() else set(text))))
        self.space, self.quoted = any(map(str.isspace, set(text))), quoted
        # Words that stand for a secret, and nothing else, such as "your-password-here".
        words = [x.lower() for x in _SPLIT.findall(text)]
        self.filler = all(x in FILLERS for x in words) and "digit" not in self.classes and text.isascii()

    def randomness(self) -> float:
        """0 for what cannot be a secret, up to about 6: bits a character, and how many classes it mixes."""
        size = sum(self.counts.values())
        if size < 6 or self.space or self.filler or len(self.counts) < 4:
            return 0.0
        bits = -sum(n / size * math.log2(n / size) for n in self.counts.values())
        return bits / 2 + (len(self.classes) - 1)

    def is_secret(self, weight: float) -> bool:
        """Literals of one class of characters need a strong name, quotes and eight characters."""
        random = self.randomness()
        if len(self.classes) == 1:
            return weight >= 3 and self.quoted and random > 0 and sum(self.counts.values()) >= 8
        return weight >= 1.5 and random > 0 and weight + random >= THRESHOLD


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose best target name makes them secrets."""
    if ":" not in text and "=" not in text:
        return []
    known: dict[str, Value] = {}
    values: list[Value] = []

    def made(*args, **named) -> Value:
        values.append(Value(*args, **named))
        return values[-1]

    bare = 0  # no assignment starts within an unquoted literal
    for m in _TARGET.finditer(text):
        if m.start() < bare:
            continue
        at, pieces = m.end(), []
        while p := _PIECE.match(text, at):
            kind = p.lastgroup
            if kind == "name":
                if p["name"] in known:
                    pieces.append(known[p["name"]])
                elif not pieces and m[2] in (":", "=", ":=") and not _PLUS.match(text, p.end()):
                    pieces.append(made(p["name"], p.span("name")))
            else:
                pieces.append(made(p[kind], p.span(kind), kind != "bare"))
            at = p.end()
            bare = at if kind == "bare" else bare
            if not (plus := _PLUS.match(text, at)):
                break
            at = plus.end()
        if not pieces:
            continue
        value = known[m[1]] = pieces[0] if len(pieces) == 1 else made(parts=tuple(pieces))
        weight = sensitivity(m[1])
        if weight > value.weight and value.is_secret(weight):
            value.weight = weight
    # Parts are older than what is joined from them, so one pass from the youngest reaches all.
    for value in reversed(values):
        if value.weight:
            for part in value.parts:
                part.weight = max(part.weight, value.weight)
    return sorted({x.span for x in values if x.weight and x.span})


def scan(text: str | None) -> tuple:
    text = text or ""
    base = sorted(base_spans(text))
    # A literal that no fixed span covers wholly is a span of its own.
    starts, reach = [s for s, _, _ in base], [*accumulate((e for _, _, e in base), max, initial=-1)]
    extra = [(s, 3, e) for s, e in lexed_spans(text) if reach[bisect_right(starts, s)] < e]
    join = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return *counts, hashlib.sha256(join(base).encode()).hexdigest(), join(base + extra), len(extra)


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): counts, and all spans as text.

    A null or empty text has no spans; an empty table gives no rows. Repeated rows give
    repeated results. Texts, names and literals of any length are read whole. Of several
    names of one literal the most sensitive one counts.
    """
    return per_text(docs, SCHEMA, lambda: lambda texts: [*map(scan, texts)])


def query(docs: DataFrame) -> DataFrame:
    return secret_scan(docs)
