"""Language identification by cross-parsing entropy.

For each learned language a suffix automaton holds every substring of a bounded amount
of labelled text. A text is parsed against it into longest matches: a phrase runs as
far as the automaton can follow and the next one starts where it stopped. Phrases
times the bits that name one (log2 of the language's own learned length and of the
alphabet, for what was never learned), per character, estimate the cross entropy; the
language with the least wins.

Texts are reduced to letters and single spaces. Long ones are parsed in blocks, all blocks
of a batch side by side, each as if a phrase began with it; then the block is entered again
in the state in which the one before has left off, up to where both parses agree, and the
count is set right. The phrases are thus those of the whole text, wherever blocks end.
"""

from __future__ import annotations

import random
import re
import sys
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.llm.common import per_text, slices

SCHEMA = "lang_pred string, score double, phrases long, letters long"
#: Labelled documents per language and characters learned of them, and languages, at most.
DOCS_PER_LANG, CHARS_PER_LANG, LANGS = 96, 24_000, 400
BLOCK = 1024
HELD_OUT = 2
#: Numbers that are neither letters nor decimal digits, such as halves and squares.
_NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_GAPS = re.compile(rf"[\W\d_{_NUMERALS}]+")


def reduce(text: str) -> str:
    """Lower-case letters, with one space for each run of anything else."""
    return _GAPS.sub(" ", text.lower())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of ``codes``; state 0 is the start."""
    next_: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(next_)
        next_.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in next_[p]:
            next_[p][c] = cur
            p = link[p]
        if p >= 0:
            q = next_[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(next_)
                next_.append(dict(next_[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and next_[p].get(c) == q:
                    next_[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return next_


def table(codes: list[int], width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """An automaton's transitions in one array, those of the start by code, and the state where texts begin.

    A state is a place in the array; its transition by code c stands c places on, as the state
    itself and the next one in the two halves of a number. Rows lie displaced between each
    other, so the size follows the transitions and not the alphabet. Where a state has none,
    the phrase ends and c starts the next one; the state where texts begin has none at all.
    """
    states = suffix_automaton(codes)
    # At a load of a third, a place drawn at random soon fits; long rows go first, into the empty array.
    room = 3 * sum(map(len, states)) + 4 * width
    taken, used, draw = bytearray(room + width), set(), random.Random(len(states))
    place = [0] * len(states)
    for s in sorted(range(len(states)), key=lambda s: -len(states[s])):
        at = draw.randrange(room)
        while at in used or any(taken[at + c] for c in states[s]):
            at = draw.randrange(room)
        used.add(at)
        place[s] = at
        for c in states[s]:
            taken[at + c] = 1
    packed = np.full(room + width, -1, np.int64)
    for s, row in enumerate(states):
        for c, to in row.items():
            packed[place[s] + c] = place[s] << 32 | place[to]
    begin = next(x for x in range(room) if x not in used)
    start = np.full(width, begin, np.int64)
    for c, to in states[0].items():
        start[c] = place[to]
    return packed, start, begin


def spread(texts: list[str], chars: int) -> str:
    """At most ``chars`` characters of the texts: all of the short ones, equally much of the others."""
    texts = [t for t in texts if t.strip()]
    shares, left = [0] * len(texts), chars - max(0, len(texts) - 1)
    for nth, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        shares[i] = max(0, min(len(texts[i]), left // (len(texts) - nth)))
        left -= shares[i]
    return " ".join(t[:n] for t, n in zip(texts, shares, strict=True))[:chars]


def learn(samples: dict[str, list[str]], chars: int = CHARS_PER_LANG) -> dict:
    """A model from labelled texts: all their letters, and per language a transition table.

    Each language learns as much as it has, up to ``chars``, whatever the others have.
    """
    texts = {k: spread([*map(reduce, v)], chars) for k, v in sorted(samples.items())}
    texts = {k: v for k, v in texts.items() if v.strip()}
    letters = sorted({c for v in texts.values() for c in v if c != " "})
    code = {c: i + 2 for i, c in enumerate(letters)} | {" ": 0}
    width = len(letters) + 2  # code 1 stands for letters that were never learned
    tables = {k: table([code[c] for c in v], width) for k, v in texts.items()}
    return {"letters": letters, "width": width, "tables": tables, "sizes": {k: len(v) for k, v in texts.items()}}


class Parser:
    """All languages' tables one behind the other, so that a step serves them all."""

    def __init__(self, model: dict):
        self.langs = sorted(model["tables"])
        tables = [model["tables"][k] for k in self.langs]
        offsets = np.cumsum([0, *(len(t[0]) for t in tables)])
        shift = [int(x) * ((1 << 32) + 1) for x in offsets]
        self.packed = np.concatenate([np.zeros(0, np.int64), *(np.where(t[0] < 0, -1, t[0] + x) for t, x in zip(tables, shift, strict=False))])
        self.start = np.stack([t[1] + x for t, x in zip(tables, offsets, strict=False)], axis=1) if tables else np.zeros((0, 0), np.int64)
        self.begin = np.array([t[2] + x for t, x in zip(tables, offsets, strict=False)], np.int64)
        # A phrase is a place in the learned text or a character alone, so that a short text is not cheap.
        self.bits = np.log2([model["sizes"][k] + model["width"] for k in self.langs])
        # Anything but letters is a gap; letters that were never learned share a code.
        self.lut = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), np.int32, 0x110000)
        for i, c in enumerate(model["letters"]):
            self.lut[ord(c)] = i + 2

    def phrases(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases of each text by language; ``codes`` holds all texts, ``ends`` where each ends."""
        lengths = np.diff(ends, prepend=0)
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(ends)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = (ends - lengths)[owner] + nth * BLOCK
        sizes = np.minimum(BLOCK, ends[owner] - starts)
        out = np.zeros((len(ends), len(self.langs)), np.int64)
        if not len(owner) or not self.langs:
            return out
        order = np.argsort(-sizes, kind="stable")
        active = np.searchsorted(-sizes[order], -np.arange(sizes[order[0]]), side="left")  # blocks longer than each step
        heads = starts[order]
        now = np.tile(self.begin, (len(owner), 1))
        seen = np.zeros(now.shape, np.int32)
        for t, n in enumerate(active):
            symbols = codes[heads[:n] + t]
            found = self.packed[now[:n] + symbols[:, None]]
            goes = (found >> 32) == now[:n]
            now[:n] = np.where(goes, found & 0xFFFFFFFF, self.start[symbols])
            seen[:n] += ~goes
        state, count = np.empty_like(now), np.empty_like(seen)
        state[order], count[order] = now, seen
        # Blocks, by language, that were entered in another state than the one before leaves.
        entered = np.tile(self.begin, (len(owner), 1))
        block, lang = np.nonzero((nth > 0)[:, None] & np.ones(len(self.langs), bool))
        while True:
            wrong = entered[block, lang] != state[block - 1, lang]
            block, lang = block[wrong], lang[wrong]
            if not len(block):
                break
            self._enter(codes, starts, sizes, block, lang, entered, state, count)
            later = block + 1 < len(owner)
            block, lang = block[later] + 1, lang[later]
            block, lang = block[nth[block] > 0], lang[nth[block] > 0]
        np.add.at(out, owner, count)
        return out

    def _enter(self, codes, starts, sizes, block, lang, entered, state, count):
        """Parse blocks from the states that the ones before leave; sets entered, state and count right."""
        into = state[block - 1, lang]
        old, new, live = entered[block, lang], into.copy(), np.arange(len(block))
        entered[block, lang] = into
        change, at = np.zeros(len(block), np.int32), 0
        while len(live):
            ended = sizes[block[live]] == at
            state[block[live[ended]], lang[live[ended]]] = new[live[ended]]
            live = live[~ended & (old[live] != new[live])]
            symbols = codes[starts[block[live]] + at]
            for now, sign in ((old, -1), (new, 1)):
                found = self.packed[now[live] + symbols]
                goes = (found >> 32) == now[live]
                now[live] = np.where(goes, found & 0xFFFFFFFF, self.start[symbols, lang[live]])
                change[live] += sign * ~goes
            at += 1
        count[block, lang] += change

    def reduced(self, points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, one gap for each run of anything but letters as in ``reduce``, and where texts end."""
        ends = np.cumsum([0, *map(len, points)])
        codes = self.lut[np.concatenate(points)] if len(points) else np.zeros(0, np.int32)
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0
        heads = ends[:-1][np.diff(ends) > 0]
        keep[heads] = True
        return codes[keep], np.concatenate([[0], np.cumsum(keep)])[ends[1:]]

    def predict(self, texts: list[str | None]) -> list[tuple]:
        """(language or und, score, phrases of the winner, reduced length) of each text."""
        points = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
        every, ends = self.reduced(points)
        lengths = np.diff(ends, prepend=0)
        letters = np.concatenate([[0], np.cumsum(every > 0)])
        has = letters[ends] > letters[ends - lengths]
        found = self.phrases(every, ends)
        out = []
        for i, ok in enumerate(has):
            if not ok or not self.langs:
                out.append(("und", 0.0, 0, int(lengths[i])))
                continue
            rate = found[i] * self.bits / lengths[i]
            best = int(np.argmin(rate))
            others = np.delete(rate, best)
            # 1 minus the share of the runner-up's entropy that the winner needs.
            score = 1.0 - rate[best] / others.min() if len(others) else 1.0
            out.append((self.langs[best], float(min(1.0, max(0.0, score))), int(found[i, best]), int(lengths[i])))
        return out


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def labelled_sample(docs: DataFrame, per_lang: int = DOCS_PER_LANG) -> dict[str, list[str]]:
    """At most ``per_lang`` labelled texts of each language outside the held-out fold.

    They are the first by a hash of the id. The ranking sees no texts, and each task sends on
    no more than ``per_lang`` rows of a language; the chosen ids, at most ``per_lang`` times
    ``LANGS``, are then looked up where the texts are read.
    """
    usable = docs.filter((fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    common = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).select("lang")
    usable = usable.join(F.broadcast(common), "lang", "left_semi")  # at most LANGS rows
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_lang).drop("n")
    ids = chosen.collect()  # at most ``per_lang`` times ``LANGS``
    if not ids:
        return {}
    known = docs.sparkSession.createDataFrame(ids, chosen.schema).distinct()
    rows = usable.join(F.broadcast(known), ["doc_id", "lang"], "left_semi").select("lang", "doc_id", F.substring("text", 1, 4 * CHARS_PER_LANG).alias("text"))
    found: dict[str, set[tuple]] = {}
    for r in rows.collect():
        found.setdefault(r["lang"], set()).add((r["doc_id"], r["text"]))
    return {k: [t for _, t in sorted(v)] for k, v in found.items()}


def predict_language(spark: SparkSession, docs: DataFrame, per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text, lang``) with the predicted language.

    The automata come from a sample bounded by ``DOCS_PER_LANG`` and ``CHARS_PER_LANG``;
    every text is parsed whole. ``und``: null, no letter, or nothing could be learned (as
    from an empty table). Ties go to the language that sorts first. Repeated rows are learned
    from once and predicted one by one. Rows with a null id are never learned from, count as
    not held out, and are predicted like others. Of more than ``LANGS``
    languages the most frequent ones are learned (of equals those that sort first), so a dirty
    column of labels costs no more than a clean one.
    """
    model = spark.sparkContext.broadcast(learn(labelled_sample(docs, per_lang)))

    def make():
        return Parser(model.value).predict

    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    return per_text(docs.select("doc_id", held, "text"), SCHEMA, make, "held_out")


def keep_identified(spark: SparkSession, docs: DataFrame, per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """The rows of ``docs``, in the same columns, whose language is not ``und``."""
    model = spark.sparkContext.broadcast(learn(labelled_sample(docs, per_lang)))
    text = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parser = Parser(model.value)
        for batch in batches:
            for part in slices(batch, text):
                rows = parser.predict(part.column(text).to_pylist())
                yield part.filter(pa.array([r[0] != "und" for r in rows]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return predict_language(spark, docs).select("doc_id", "held_out", "lang_pred", "score", "phrases", "letters")
