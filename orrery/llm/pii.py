"""Personal data: fixed patterns, and a linear-chain conditional random field.

The field labels white-space tokens as email, ip, card, phone or other from their shapes
(how many digits, letters, dots and so on a token and its neighbours have). It is trained
on the driver, by gradient ascent on the likelihood of the small labelled table in
``pii_table``, and decoded by Viterbi over all lines of a batch side by side. Its spans are
checked (check digits, number of digits) and added where no fixed pattern has matched.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from orrery.llm import pii_table
from orrery.llm.common import per_text

SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
KINDS = "email", "ip", "card", "phone", "crf_email", "crf_ip", "crf_card", "crf_phone"
OTHER = 4  # label of tokens that are none of the four

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Starting inside a run of digits never helps where starting at its head has failed.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from their only @ in linear time."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_LETTERS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))
        done = max(done, 0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns that pass their checks."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                    out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


# --- word shapes -----------------------------------------------------------------

#: Classes of characters, each counted in its own byte of a 64-bit sum.
_CLASSES = "letter", "digit", "@", ".", "-", "bracket", "+", "mark"
#: Least counts of each bin, by class, and then of the digits that a token begins and ends with.
_BINS = (0, 1), (0, 1, 3, 4, 5, 10, 14, 20), (0, 1), (0, 1, 2, 3, 4), (0, 1, 2), (0, 1), (0, 1), (0, 1), (0, 1, 3, 4, 5), (0, 1, 3, 4)
_RADIX = [len(b) for b in _BINS]
CODES = int(np.prod(_RADIX))


def _class_of(c: str) -> int:
    if c in "0123456789":
        return 1
    if c in "@.-+":
        return _CLASSES.index(c)
    return 5 if c in "()[]" else 0 if c.isalpha() else 7


_CLASS = np.array([_class_of(chr(i)) for i in range(128)] + [0])
_LUT = np.uint64(1) << (8 * _CLASS).astype(np.uint64)
#: White space, and marks that stand between tokens as it does (as in JSON, CSV or markup).
_SPACE = np.zeros(129, bool)
_SPACE[[9, 10, 11, 12, 13, 32, *map(ord, "\"',;:{}<>|=")]] = True


def tokens(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and shape codes of the tokens of code points."""
    small = np.minimum(points, 128)
    gap = _SPACE[small]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, ends, starts
    packed = np.where(gap, np.uint64(0), _LUT[small])
    sums = np.add.reduceat(packed, starts)
    counts = [((sums >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64) for k in range(len(_CLASSES))]
    for i in np.flatnonzero(ends - starts > 255):  # too long for sums of bytes
        exact = np.bincount(_CLASS[small[starts[i] : ends[i]]], minlength=len(_CLASSES))
        for k in range(len(_CLASSES)):
            counts[k][i] = exact[k]
    other = np.concatenate([[-1], np.flatnonzero(_CLASS[small] != 1), [len(points)]])
    counts.append(np.minimum(other[np.searchsorted(other, starts)], ends) - starts)
    counts.append(ends - 1 - np.maximum(other[np.searchsorted(other, ends - 1, side="right") - 1], starts - 1))
    code = np.zeros(len(starts), np.int64)
    for bins, count in zip(_BINS, counts, strict=True):
        code = code * len(bins) + np.searchsorted(bins, count, side="right") - 1
    return starts, ends, code


def features() -> np.ndarray:
    """For each code the indicators that it switches on: one per class."""
    digits = np.stack(np.unravel_index(np.arange(CODES), _RADIX), axis=1)
    return digits + np.cumsum([0, *_RADIX[:-1]])


# --- the field ---------------------------------------------------------------------


@dataclass
class Field:
    """Scores of labels by the token's code, by its neighbours' codes, and of label pairs."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    pair: np.ndarray

    def emissions(self, code: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = self.own[code]
        out[1:] += np.where(first[1:, None], 0, self.before[code[:-1]])
        out[:-1] += np.where(last[:-1, None], 0, self.after[code[1:]])
        return out

    def viterbi(self, code: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best labels of tokens in lines, all lines side by side."""
        n = len(code)
        first = np.ones(n, bool)
        first[1:] = line[1:] != line[:-1]
        last = np.append(first[1:], True)
        score = self.emissions(code, first, last)
        heads = np.flatnonzero(first)
        sizes = np.diff(np.append(heads, n))
        order = np.argsort(-sizes, kind="stable")
        heads, sizes = heads[order], sizes[order]
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        best = score[heads].copy()
        back = np.zeros((n, score.shape[1]), np.int8)
        for t in range(1, len(active)):
            k = active[t]
            at = heads[:k] + t
            through = best[:k, :, None] + self.pair
            back[at] = through.argmax(axis=1)
            best[:k] = through.max(axis=1) + score[at]
        labels = np.empty(n, np.int8)
        now = best.argmax(axis=1)
        for t in range(len(active) - 1, -1, -1):
            k = active[t]
            ending = sizes[:k] == t + 1
            now[:k] = np.where(ending, best[:k].argmax(axis=1), now[:k])
            at = heads[:k] + t
            labels[at] = now[:k]
            now[:k] = back[at, now[:k]]
        return labels


def labelled_table() -> list[tuple[str, list[int]]]:
    """The lines of the table, and a label for each of their tokens."""
    out = []
    for text, spans in pii_table.table():
        starts, ends, _ = tokens(np.array([*map(ord, text)], np.uint32))
        label = lambda s, e: next((k for a, b, k in spans if a < e and s < b), OTHER)  # noqa: E731, B023
        out.append((text, [label(s, e) for s, e in zip(starts, ends, strict=True)]))
    return out


def train(table: list[tuple[str, list[int]]], steps: int = 120, rate: float = 0.15, decay: float = 1e-2) -> Field:
    """Maximum likelihood by Adam, with forward-backward over all lines at once."""
    codes = [tokens(np.array([*map(ord, text)], np.uint32))[2] for text, _ in table]
    longest, n = max(map(len, codes)), len(codes)
    pad = CODES  # a code without features
    code = np.full((n, longest + 2), pad)
    gold = np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest), bool)
    for i, (c, (_, labels)) in enumerate(zip(codes, table, strict=True)):
        code[i, 1 : len(c) + 1], gold[i, : len(c)], mask[i, : len(c)] = c, labels, True
    on = np.concatenate([features(), np.full((1, len(_RADIX)), sum(_RADIX))])
    width, labels = sum(_RADIX) + 1, OTHER + 1
    theta = np.zeros((3 * width + labels, labels))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    # Few codes occur, so scores and gradients go by code and only then by feature.
    used, code = np.unique(code, return_inverse=True)
    code = code.reshape(n, longest + 2)
    views = [(code[:, 1:-1], on[used]), (code[:, :-2], on[used] + width), (code[:, 2:], on[used] + 2 * width)]
    one = np.eye(labels)
    for step in range(1, steps + 1):
        theta[[width - 1, 2 * width - 1, 3 * width - 1]] = 0
        score, pair = sum(theta[index].sum(axis=1)[at] for at, index in views), theta[3 * width :]
        alpha, beta = np.zeros((n, longest, labels)), np.zeros((n, longest, labels))
        alpha[:, 0] = score[:, 0]
        lse = lambda x, axis: (top := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis=axis))
        for t in range(1, longest):
            a = lse(alpha[:, t - 1, :, None] + pair, 1) + score[:, t]
            alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b = lse(pair + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], b, beta[:, t + 1])
        total = lse(alpha[:, -1], 1)
        single = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        delta = one[gold] * mask[:, :, None] - single
        grad = np.zeros_like(theta)
        for at, index in views:
            by_code = np.zeros((len(used), labels))
            np.add.at(by_code, at, delta)
            np.add.at(grad, index, by_code[:, None, :])
        both = mask[:, 1:]
        joint = alpha[:, :-1, :, None] + pair + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        seen = one[gold[:, :-1]][:, :, :, None] * one[gold[:, 1:]][:, :, None, :]
        grad[3 * width :] = ((seen - np.exp(np.minimum(joint, 0))) * both[:, :, None, None]).sum(axis=(0, 1))
        grad = grad / n - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    theta[[width - 1, 2 * width - 1, 3 * width - 1]] = 0
    own, before, after = (theta[on[:CODES] + k * width].sum(axis=1).astype(np.float32) for k in range(3))
    return Field(own, before, after, theta[3 * width :].astype(np.float32))


# --- applying it -------------------------------------------------------------------


#: The most tokens of 15 digits with a separator between each two.
PHONE_TOKENS = 29


def phone(body: str) -> bool:
    return 7 <= len(digits_of(body)) <= 15 and all(c in "0123456789 +-.()[]/" for c in body) and any(c in "-()[]+" for c in body)


def checked(text: str, kind: int, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans within a run of equally labelled tokens that hold up."""
    trim = lambda a, b: (a, a + len(text[a:b].rstrip(".,;:!?|\"'")))
    if kind == 2:
        out, i = [], 0
        while i < len(parts):
            for j in range(i + 1, min(len(parts), i + 5) + 1):
                a, b = trim(parts[i][0], parts[j - 1][1])
                d = digits_of(text[a:b])
                if 14 <= len(d) <= 19 and luhn(d) and all(c in "0123456789 -" for c in text[a:b]):
                    out.append((a, b))
                    i = j
                    break
            else:
                i += 1
        return out
    if kind == 3:
        out, i = [], 0
        while i < len(parts):
            end = None
            for j in range(i, min(len(parts), i + PHONE_TOKENS)):
                a, b = trim(parts[i][0], parts[j][1])
                # What stands as a number starts anew where another one can.
                if len(digits_of(text[a:b])) > 15 or end is not None and (text[parts[j][0]] in "+([" or phone(text[slice(*trim(*parts[j]))])):
                    break
                if phone(text[a:b]):
                    end, span = j, (a, b)
            if end is not None:
                out.append(span)
            i = i + 1 if end is None else end + 1
        return out
    spans = [trim(a, b) for a, b in parts]
    if kind == 1:
        return [(a, b) for a, b in spans if _IP.fullmatch(text[a:b]) and all(int(x) <= 255 for x in text[a:b].split("."))]
    return [(a, b) for a, b in spans if re.fullmatch(r"[\w.%+-]+(?:@|\[at\]|\(at\))[\w-]+(?:\.[\w-]+)+", text[a:b])]


def decode(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the field finds in each text."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    starts, ends, code = tokens(points)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(starts):
        return found
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    line = np.searchsorted(np.flatnonzero(points == 10), starts)
    labels = field.viterbi(code, line)
    hits = np.flatnonzero(labels != OTHER)
    if not len(hits):
        return found
    cuts = np.flatnonzero((np.diff(hits) > 1) | (np.diff(labels[hits]) != 0) | (np.diff(line[hits]) != 0)) + 1
    for run in np.split(hits, cuts):
        owner = int(np.searchsorted(offsets, starts[run[0]], side="right")) - 1
        base = int(offsets[owner])
        kind = int(labels[run[0]])
        parts = [(int(starts[i]) - base, int(ends[i]) - base) for i in run]
        found[owner] += [(a, kind + 4, b) for a, b in checked(texts[owner], kind, parts)]
    return found


def scan(texts: list[str | None], field: Field) -> list[tuple]:
    texts = [t or "" for t in texts]
    out = []
    for text, added in zip(texts, decode(texts, field), strict=True):
        base = base_spans(text)
        # Of the fixed spans that start before an added one ends, none may reach into it.
        starts, reach = [a for a, _, _ in base], [*accumulate((b for _, _, b in base), max, initial=-1)]
        extra = [x for x in added if reach[bisect_left(starts, x[2])] <= x[0]]
        join = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
        out.append((*counts, hashlib.sha256(join(base).encode()).hexdigest(), join(base + extra), len(extra)))
    return out


def personal_data(spark: SparkSession, docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): counts of the fixed patterns, and all spans.

    A null or empty text has no spans; an empty table gives no rows. Texts, lines and tokens
    are decoded whole, whatever their length, and lines independently of each other. Repeated
    rows give repeated results. Of labellings that tie, the one with the first kinds counts.
    """
    model = spark.sparkContext.broadcast(astuple(field or train(labelled_table())))

    def make():
        learned = Field(*model.value)

        def find(texts: list[str | None]) -> list[tuple]:
            rows, held, size = [], [], 0
            for text in texts:
                held.append(text)
                size += len(text or "")
                if size > 500_000:
                    rows += scan(held, learned)
                    held, size = [], 0
            return rows + (scan(held, learned) if held else [])

        return find

    return per_text(docs, SCHEMA, make)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return personal_data(spark, docs)
