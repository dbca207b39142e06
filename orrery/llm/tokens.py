"""Token counts by a compiled finite-state transducer.

A byte-pair encoding whose words end in a marker is compiled into a deterministic
transducer over the bytes of a word: each transition carries the number of tokens by
which the encoding of the prefix grows (or shrinks). This works as the encoding of a
prefix is that of a shorter prefix plus one last token, and as a token may follow
another exactly if the two, joined and encoded anew, come apart in the same place. A
state therefore holds the part of the prefix that a later token may still reach into,
with the last token and the count at each place in it. States are made when a text
first leads to them, and two prefixes that agree in all this share one.

Chunks are maps of states. White space returns the transducer to its start, so a chunk of
text that holds some is a constant map but for its first word, and is kept as head, count
and tail. A chunk of letters without white space maps each state that may precede it to the
state behind it and a count: it is walked from the start state, whose path is kept, and from
any other state only up to where the two paths meet, which soon happens. Maps of both kinds
compose, associatively, and the count of a long text or word is a scan over its chunks in
rounds of neighbouring pairs. A text's chunks are scanned in the task that holds the text.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from orrery.llm.common import per_text, worker_cache

SCHEMA = "n_bytes long, n_tokens long, over_limit boolean"
CHUNK_BYTES = 1 << 16
#: Longer words are cut into chunks of so many letters.
CHUNK_LETTERS = 1024
LIMIT = 2048
#: A worker forgets words and states beyond these, and keeps no words of more bytes, to bound its memory.
WORDS_KEPT, STATES_KEPT, WORD_BYTES_KEPT = 600_000, 400_000, 64


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Transducer:
    """Token counts of words under ``merges`` (pairs by rank) and an end marker."""

    def __init__(self, merges: list[tuple[str, str]], marker: str = "</w>"):
        self.marker = marker
        self.rank = {pair: i for i, pair in enumerate(map(tuple, merges))}
        letters = byte_letters()
        self.tokens = {*letters, *(c + marker for c in letters), *(a + b for a, b in self.rank)}
        bodies = {t for t in self.tokens if not t.endswith(marker)}
        ends = {t.removesuffix(marker) for t in self.tokens if t.endswith(marker) and t != marker}
        self.inner, self.last = bodies, ends
        self.prefixes = {t[:i] for t in (*bodies, *ends) for i in range(1, len(t))}
        self.longest = max(map(len, (*bodies, *ends)))
        self.made = {a + b: (a, b) for a, b in self.rank}
        if len(self.made) != len(self.rank):
            raise ValueError("two merges make the same token")
        self.joins: dict[tuple[str, str], bool] = {}
        self.spines: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.reset()

    def reset(self) -> None:
        #: State 0 is the start. A state is (reach, last tokens, counts), the two latter by place.
        self.states: list[tuple] = [("", (None,), (0,))]
        self.number = {self.states[0]: 0}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.finals: dict[tuple[int, str], int] = {}

    def encode(self, symbols: list[str]) -> list[str]:
        """Plain merging, lowest rank first, leftmost first: tells which tokens stand alone."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            pair, out, i = (symbols[best], symbols[best + 1]), [], 0
            while i < len(symbols):
                if tuple(symbols[i : i + 2]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The symbols that stand at one edge of a token while it is built, with the rank that ends each."""
        if (found := self.spines.get((token, side))) is None:
            found, end = [], 1 << 60
            while True:
                found.append((token, end))
                if token not in self.made:
                    break
                pair = self.made[token]
                token, end = pair[side], self.rank[pair]
            self.spines[found[0][0], side] = found
        return found

    def joinable(self, left: str | None, right: str, final: bool) -> bool:
        """May ``right`` stand after ``left``? ``final``: right ends the word.

        It may unless some merge across the border comes up while both its symbols are
        there. Of equal merges the leftmost goes first, so one that would use up the
        left symbol wins and one that would use up the right symbol loses.
        """
        whole = right + self.marker if final else right
        if not self._stands(whole, final):
            return False
        if left is None:
            return True
        if (found := self.joins.get((left, whole))) is None:
            found = self.joins[left, whole] = not any(
                (rank := self.rank.get((x, y))) is not None and rank < x_ends and rank <= y_ends
                for x, x_ends in self._spine(left, 1)
                for y, y_ends in self._spine(whole, 0)
            )
        return found

    def _stands(self, whole: str, final: bool) -> bool:
        if (found := self.joins.get(("", whole))) is None:
            symbols = list(whole.removesuffix(self.marker) if final else whole)
            if final:
                symbols[-1] += self.marker
            found = self.joins["", whole] = self.encode(symbols) == [whole]
        return found

    def _last(self, state: tuple, letter: str, final: bool) -> tuple[str, int]:
        """The last token after ``letter``, and the count then, relative to the state's."""
        reach, lasts, counts = state
        text = reach + letter
        have = self.last if final else self.inner
        for size in range(min(len(text), self.longest), 0, -1):
            token = text[-size:]
            place = len(text) - size
            if token in have and self.joinable(lasts[place], token, final):
                return token, counts[place] + 1
        raise AssertionError("a single letter always stands")

    def step(self, number: int, letter: str) -> tuple[int, int]:
        """Next state and emitted count; the transition is made if it is new."""
        if (found := self.steps.get((number, letter))) is None:
            state = self.states[number]
            token, count = self._last(state, letter, False)
            text, lasts, counts = state[0] + letter, (*state[1], token), (*state[2], count)
            cut = next(i for i in range(len(text) + 1) if i == len(text) or text[i:] in self.prefixes)
            # Only places where a longer token may have begun can matter later.
            live = [i == len(text) or text[i:] in self.prefixes for i in range(cut, len(text) + 1)]
            after = (
                text[cut:],
                tuple(x if on else "" for x, on in zip(lasts[cut:], live, strict=True)),
                tuple(c - count if on else 0 for c, on in zip(counts[cut:], live, strict=True)),
            )
            if (to := self.number.get(after)) is None:
                to = self.number[after] = len(self.states)
                self.states.append(after)
            found = self.steps[number, letter] = to, count
        return found

    def word(self, letters: str) -> int:
        """Number of tokens of a word in byte letters."""
        if len(self.states) > STATES_KEPT:
            self.reset()
        state = total = 0
        steps = self.steps
        if len(letters) > CHUNK_LETTERS + 1:
            body = letters[:-1]
            state, total = scan([LetterMap(self, body[i : i + CHUNK_LETTERS]) for i in range(0, len(body), CHUNK_LETTERS)], JoinedMap)(0)
            letters = letters[-1]
        for letter in letters[:-1]:
            state, emitted = steps.get((state, letter)) or self.step(state, letter)
            total += emitted
        final = state, letters[-1]
        if (emitted := self.finals.get(final)) is None:
            emitted = self.finals[final] = self._last(self.states[state], letters[-1], True)[1]
        return total + emitted


def scan(maps: list, compose):
    """All maps composed, in rounds over neighbouring pairs."""
    while len(maps) > 1:
        odd = maps[len(maps) & ~1 :]
        maps = [compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)] + odd
    return maps[0]


class LetterMap:
    """What letters of one word do to the transducer: from each state before them to the state behind, and the count."""

    def __init__(self, transducer: Transducer, letters: str):
        self.transducer, self.letters = transducer, letters
        self.path, self.sums = [0], [0]
        for letter in letters:
            state, emitted = transducer.step(self.path[-1], letter)
            self.path.append(state)
            self.sums.append(self.sums[-1] + emitted)
        self.known = {0: (self.path[-1], self.sums[-1])}

    def __call__(self, state: int) -> tuple[int, int]:
        if (found := self.known.get(state)) is None:
            at, now, total = 0, state, 0
            while at < len(self.letters) and now != self.path[at]:
                now, emitted = self.transducer.step(now, self.letters[at])
                total += emitted
                at += 1
            found = self.known[state] = (self.path[-1], total + self.sums[-1] - self.sums[at]) if now == self.path[at] else (now, total)
        return found


class JoinedMap:
    """Two neighbouring maps as one; its entries are worked out when a state turns up."""

    def __init__(self, first, second):
        self.first, self.second, self.known = first, second, {}
        self(0)

    def __call__(self, state: int) -> tuple[int, int]:
        if (found := self.known.get(state)) is None:
            between, before = self.first(state)
            after, behind = self.second(between)
            found = self.known[state] = after, before + behind
        return found


@dataclass(frozen=True)
class StateMap:
    """What a chunk does to the count: unknown ``head`` and ``tail`` words about a known middle.

    ``tail`` is None where the chunk holds no white space; all of it is then ``head``.
    """

    head: bytes
    count: int = 0
    tail: bytes | None = None


class Counter(dict):
    """Counts of texts; a dictionary from white-space-free pieces to their counts."""

    def __init__(self, model: dict):
        import regex

        super().__init__()
        self.transducer = Transducer(model["merges"])
        self.letters = byte_letters()
        self.special = regex.compile("|".join(map(regex.escape, model["special"]))) if model["special"] else None
        self.pieces = regex.compile(model["pattern"])

    def __missing__(self, piece: bytes) -> int:
        text = piece.decode("utf-8", "replace")
        count = 0
        parts = [text]
        if self.special and self.special.search(text):
            count += len(self.special.findall(text))
            parts = self.special.split(text)
        for part in parts:
            if part.isascii():  # each visible ASCII byte is its own letter
                low = part.lower()
            else:
                low = "".join([c.lower() for c in unicodedata.normalize("NFC", part)])
            for word in self.pieces.findall(low):
                plain = word.isascii() and word.isprintable()
                count += self.transducer.word(word if plain else "".join([self.letters[b] for b in word.encode()]))
        if len(piece) <= WORD_BYTES_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[piece] = count
        return count

    def chunk(self, data: bytes) -> StateMap:
        words = data.split()
        if not words or len(words) == 1 and len(words[0]) == len(data):
            return StateMap(data) if words or not data else StateMap(b"", 0, b"")
        head = words.pop(0) if not data[:1].isspace() else b""
        tail = words.pop() if words and not data[-1:].isspace() else b""
        return StateMap(head, sum(map(self.__getitem__, words)), tail)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of two neighbouring chunks; associative."""
        if a.tail is None:
            return StateMap(a.head + b.head, b.count, b.tail)
        if b.tail is None:
            return StateMap(a.head, a.count, a.tail + b.head)
        between = a.tail + b.head
        return StateMap(a.head, a.count + (self[between] if between else 0) + b.count, b.tail)

    def count(self, data: bytes, chunk_bytes: int = CHUNK_BYTES) -> int:
        if not data:
            return 0
        whole = scan([self.chunk(data[i : i + chunk_bytes]) for i in range(0, len(data), chunk_bytes)], self.compose)
        return whole.count + sum(self[x] for x in (whole.head, whole.tail) if x)


def compile_model(path: str) -> dict:
    """What workers need of a tokenizer file: merges, special strings and the word pattern.

    Only byte-level vocabularies with an end marker, lower case, and words between
    white space are understood; others are refused.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
        raise ValueError("expected a byte-level vocabulary with the end marker </w>")
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    # White space is spelt out, as libraries differ in what \s holds.
    pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"merges": merges, "special": [x["content"] for x in spec["added_tokens"]], "pattern": pattern}


def token_counts(spark: SparkSession, docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): UTF-8 bytes, tokens, and whether over ``limit``.

    The vocabulary (about 50,000 merges) is read on the driver and broadcast. A null or
    empty text has no tokens. Texts of any length are counted whole. Repeated rows are
    counted one by one, texts that tie in tokens are nothing special, and an empty table
    gives no rows. Other columns of ``docs`` are not looked at, whatever their names.
    """
    model = spark.sparkContext.broadcast(compile_model(path))

    def make():
        cache = worker_cache()
        if ("tokens", path) not in cache:
            cache["tokens", path] = Counter(model.value)
        counter = cache["tokens", path]

        def find(texts: list[str | None]) -> list[tuple]:
            data = [(t or "").encode("utf-8", "replace") for t in texts]
            return [(len(x), n, n > limit) for x, n in zip(data, map(counter.count, data), strict=True)]

        return find

    return per_text(docs, SCHEMA, make)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return token_counts(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
