"""Removal of repeated substrings by a sparse suffix array with deep-shallow sorting.

A byte goes if a string of ``length`` bytes that covers it also starts in a document
with a smaller id.

* Each window of ``length`` bytes is represented by its minimal hashed gram of ``GRAM``
  bytes, its anchor: equal windows have equal anchors, and neighbouring windows mostly
  share one, so a text has an anchor every twentieth byte or so.
* Anchors meet by hash, with a few bits of what stands before and behind them: a repeated
  window agrees on the longer side of its anchor, too, so chance meetings of short grams
  drop out. Only anchors that at least two documents hold go on. What a deal already finds
  repeated among its own rows it sends on once, so a passage that a third of all documents
  share reaches a bucket once per deal.
* The stretches of text around surviving anchors meet again, and the suffixes that start
  in them are sorted on their bytes: multikey quicksort by eight bytes at a time to a
  shallow depth, then a blind trie for each group that still agrees. Neighbours that
  agree over all ``length`` bytes are the repeats, and the smallest id among them stays.

Texts are dealt out once, in memory-sized deals; that exchange serves all three passes over
them, and what buckets answer goes back to the deals in bundles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import n_bytes, numbered_copies

LENGTH, GRAM, SHALLOW = 50, 16, 24
#: Anchors that one bucket sorts, and bytes of text that one deal holds, on average.
BUCKET_ANCHORS, DEAL_BYTES = 500_000, 16 << 20
_BUFFER = 1 << 17
_POS = np.uint64(_BUFFER - 1)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]
LAST_ID = (1 << 63) - 1
#: Equal rows beyond so many are collapsed before they are dealt.
CROWD = 1000


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number (zeros beyond the end)."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    x = (x[:-4] << np.uint64(32)) | x[4:]
    return x[: len(data)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    w = words8(data)
    x = w * _C[0]
    x[:-8] += w[8:] * _C[1]
    x ^= x >> np.uint64(29)
    x *= _C[2]
    x ^= x >> np.uint64(32)
    return x


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window start, anchor's place, anchor's hash) of each window within one text.

    ``data`` holds texts of at most _BUFFER bytes in all, ``starts`` where each begins
    and, last, where they end. The leftmost of equal minima is the anchor.
    """
    hashes = gram_hashes(data)
    packed = (hashes & ~_POS) | np.arange(len(data), dtype=np.uint64)
    width, low, reach = length - GRAM + 1, packed, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    sizes = np.diff(starts)
    windows = np.maximum(sizes - length + 1, 0)
    first = np.repeat(starts[:-1] - (np.cumsum(windows) - windows), windows)
    at = first + np.arange(len(first))
    place = (low[at] & _POS).astype(np.int64)
    return at, place, hashes


def pieces(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, int]]:
    """Texts in buffers: (their numbers, bytes, starts, offset within the text).

    A text beyond a buffer comes in parts that overlap by ``length - 1``, alone.
    """
    held, size = [], 0
    flush = lambda: (held, np.frombuffer(b"".join(texts[i] for i in held), np.uint8), np.cumsum([0, *(len(texts[i]) for i in held)]), 0)
    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > _BUFFER:
            step = _BUFFER - length + 1
            for off in range(0, len(text) - length + 1, step):
                part = np.frombuffer(text[off : off + _BUFFER], np.uint8)
                yield [i], part, np.array([0, len(part)]), off
            continue
        if size + len(text) > _BUFFER:
            yield flush()
            held, size = [], 0
        held.append(i)
        size += len(text)
    if held:
        yield flush()


PACKED_SCHEMA = "deal long, id long, none boolean, many long, row long, packed binary"


def pack(deals: int):
    """Texts as compressed UTF-8, which is what the one exchange of texts moves, and their deal."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [press((t or "").encode("utf-8", "replace")) for t in batch["text"]]
            yield pd.DataFrame({"deal": batch["row"] % deals, "id": batch["id"], "none": batch["none"], "many": batch["many"], "row": batch["row"], "packed": packed})

    return run


def _by_deal(rows: np.ndarray, deals: int) -> Iterator[tuple[int, np.ndarray]]:
    """Deals with the places of their rows; ``rows`` come sorted and stay so."""
    deal = rows % deals
    order = np.argsort(deal, kind="stable")
    cuts = np.flatnonzero(np.diff(deal[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        yield int(deal[at[0]]), at


def _utf8(batch: pd.DataFrame) -> list[bytes]:
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress
    return [plain(x) for x in batch["packed"]]


def _tags(hashes: np.ndarray) -> np.ndarray:
    """48 bits that name an anchor; a chance meeting only costs a comparison."""
    return hashes >> np.uint64(16)


def contexts(hashes: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Eight bits of the grams before and behind each anchor, as two bytes; 0 where the text holds none.

    Of the bytes of a window beside its anchor, one side has half at least. Where that is less
    than a gram, nothing is told apart.
    """
    if 2 * GRAM - 1 > length - GRAM:
        return np.full(len(place), 0x0101, np.uint16)
    bits = lambda at: ((hashes[at] >> np.uint64(56)) % np.uint64(255) + np.uint64(1)).astype(np.uint16)
    left = np.where(place - GRAM >= begin, bits(np.maximum(place - GRAM, 0)), np.uint16(0))
    right = np.where(place + 2 * GRAM <= end, bits(np.minimum(place + GRAM, len(hashes) - 1)), np.uint16(0))
    return left << np.uint16(8) | right


def meet(tag: np.ndarray, context: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which anchors another row holds, too, with the same gram before or the same behind."""
    out = np.zeros(len(tag), bool)
    for side in (context >> np.uint16(8), context & np.uint16(255)):
        valid = np.flatnonzero(side)
        key = tag[valid] << np.uint64(8) | side[valid].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key, at = key[order], valid[order]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        which = np.cumsum(head) - 1
        differ = np.zeros(int(head.sum()), bool)
        differ[which[row[at] != row[at[head]][which]]] = True
        out[at[differ[which]]] = True
    return out


_LOW = np.uint64(0xFFFFFFFF)
ANCHOR_SCHEMA = "bucket long, deal long, low binary, high binary, context binary, rows binary"


def find_anchors(buckets: int, length: int):
    """Pass one: a deal's distinct anchors, in bundles for buckets; rows go by their rank within the deal."""

    def run(held: pd.DataFrame) -> pd.DataFrame:
        texts, keys = _utf8(held), held["row"].to_numpy()
        known = np.unique(keys)
        tags, sides, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for numbers, data, starts, _ in pieces(texts, length):
            _, place, hashes = anchors(data, starts, length)
            place = np.unique(place)
            owner = np.searchsorted(starts, place, side="right") - 1
            tags.append(_tags(hashes[place]))
            sides.append(contexts(hashes, place, starts[owner], starts[owner + 1], length))
            rows.append(np.searchsorted(known, keys[np.array(numbers)])[owner])
        tag, side, row = map(np.concatenate, (tags, sides, rows))
        order = np.lexsort((row, side, tag))
        tag, side, row = tag[order], side[order], row[order]
        head = np.ones(len(tag), bool)
        head[1:] = (tag[1:] != tag[:-1]) | (side[1:] != side[:-1])
        tag, side, row = tag[head], side[head], row[head]
        to = tag % np.uint64(buckets)
        order = np.lexsort((row, to))
        tag, side, row, to = tag[order], side[order], row[order].astype(np.uint32), to[order]
        edges = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)] if len(to) else [0]
        out, deal = [], int(held["deal"].iat[0])
        for a, b in zip(edges, edges[1:], strict=False):
            low, high = (tag[a:b] & _LOW).astype(np.uint32), (tag[a:b] >> np.uint64(32)).astype(np.uint16)
            out.append((int(to[a]), deal, *(x.tobytes() for x in (low, high, side[a:b], row[a:b]))))
        return pd.DataFrame(out, columns=["bucket", "deal", "low", "high", "context", "rows"])

    return run


def _joined(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


TAG_SCHEMA = "deal long, rows binary, low binary"


def repeated_anchors():
    """Of a bucket's anchors those that another row holds, too, by deal.

    32 bits of a tag go back, which are enough to tell the few anchors of a text apart.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("deal")
        low = _joined(group["low"], np.uint32)
        tag = (_joined(group["high"], np.uint16).astype(np.uint64) << np.uint64(32)) | low
        rank = _joined(group["rows"], np.uint32)
        sizes = group["rows"].map(len).to_numpy() // 4
        deal = np.repeat(np.arange(len(group)), sizes)  # a deal sends a bucket one bundle
        chosen = meet(tag, _joined(group["context"], np.uint16), deal << 32 | rank)
        edges = np.searchsorted(deal[chosen], np.arange(len(group) + 1))
        rank, low = rank[chosen], low[chosen]
        out = [(d, rank[a:b].tobytes(), low[a:b].tobytes()) for d, a, b in zip(group["deal"], edges, edges[1:], strict=False) if a < b]
        return pd.DataFrame(out, columns=["deal", "rows", "low"])

    return run


#: ``done``: spans are settled, and packed holds them; else packed holds stretches of text, compressed.
STRETCH_SCHEMA = "bucket long, done boolean, rows binary, ids binary, starts binary, sizes binary, packed binary"


def find_stretches(buckets: int, length: int):
    """Pass two: for each repeated anchor the text that its windows span.

    Of rows that agree in a stretch only those with the smallest id have it judged; for
    the others it is gone. Each deal sends a bucket one bundle.
    """

    def run(held: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        smallest: dict[bytes, int] = {}
        found: list[tuple[int, int, int, bytes, int]] = []
        told_of = (_joined(told["rows"], np.uint32).astype(np.uint64) << np.uint64(32)) | _joined(told["low"], np.uint32)
        texts, keys, ids = _utf8(held), held["row"].to_numpy(), held["id"].to_numpy()
        known = np.unique(keys)
        raws: list[bytes] = []
        columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        for numbers, data, starts, off in pieces(texts, length):
            at, place, hashes = anchors(data, starts, length)
            # An anchor's windows follow each other; a text's border ends them, too.
            owner = np.searchsorted(starts, at, side="right") - 1
            edge = np.flatnonzero((np.diff(place) != 0) | (np.diff(owner) != 0)) + 1
            heads = np.concatenate([[0], edge])
            lo, hi = at[heads], at[np.concatenate([edge, [len(place)]]) - 1]
            place, owner = place[heads], owner[heads]
            number = np.array(numbers)[owner]
            side = contexts(hashes, place, starts[owner], starts[owner + 1], length)
            for column, x in zip(columns, (_tags(hashes[place]), side, number, lo, hi, lo - starts[owner] + off, np.full(len(lo), len(raws))), strict=True):
                column.append(x)
            raws.append(data.tobytes())
        if raws:
            tag, side, number, lo, hi, begin, piece = map(np.concatenate, columns)
            rank = np.searchsorted(known, keys[number])
            chosen = meet(tag, side, rank) | np.isin((rank.astype(np.uint64) << np.uint64(32)) | (tag & _LOW), told_of)
            number = number[chosen]
            cells = (keys[number], ids[number], begin[chosen], lo[chosen], hi[chosen], piece[chosen], tag[chosen] % np.uint64(buckets))
            for key, id_, start, p, q, nth, bucket in zip(*(x.tolist() for x in cells), strict=True):
                stretch = raws[nth][p : q + length]
                least = smallest.get(stretch)
                if least is None or id_ < least:
                    smallest[stretch] = id_
                found.append((key, id_, start, stretch, bucket))
        gone: dict[int, list[int]] = {}
        open_: dict[int, list[tuple]] = {}
        for entry in found:
            key, id_, start, stretch, bucket = entry
            if id_ == smallest[stretch]:
                open_.setdefault(bucket, []).append(entry)
            else:
                gone.setdefault(key, []).extend((start, start + len(stretch)))
        found.clear()
        out = []
        for bucket, entries in open_.items():
            rows, ids, starts, texts, _ = zip(*entries, strict=True)
            bundle = [np.array(x, kind).tobytes() for x, kind in ((rows, np.int64), (ids, np.int64), (starts, np.uint32), ([*map(len, texts)], np.uint16))]
            out.append((bucket, False, *bundle, press(b"".join(texts))))
        by_bucket: dict[int, list] = {}
        for key, flat in gone.items():
            by_bucket.setdefault(key % buckets, []).append((key, merged(flat)))
        for bucket, spans in by_bucket.items():
            rows = np.array([k for k, _ in spans], np.int64).tobytes()
            sizes = np.array([len(x) for _, x in spans], np.uint32).tobytes()
            out.append((bucket, True, rows, b"", b"", sizes, press(np.concatenate([x for _, x in spans]).tobytes())))
        return pd.DataFrame(out, columns=["bucket", "done", "rows", "ids", "starts", "sizes", "packed"])

    return run


def shallow_groups(data: np.ndarray, starts: np.ndarray, depth: int) -> list[np.ndarray]:
    """Multikey quicksort by eight bytes: groups of ``starts`` that agree over ``depth`` bytes, in order.

    Suffixes that part from all others before ``depth`` are in place and drop out.
    """
    word = words8(data)
    group = np.zeros(len(starts), np.int64)
    for d in range(0, depth, 8):
        key = word[np.minimum(starts + d, len(data) - 1)]
        order = np.lexsort((key, group))
        starts, group, key = starts[order], group[order], key[order]
        head = np.ones(len(starts), bool)
        head[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        alone = head.copy()
        alone[:-1] &= head[1:]
        group = np.cumsum(head)[~alone]
        starts = starts[~alone]
    cuts = np.flatnonzero(np.diff(group)) + 1
    return np.split(starts, cuts) if len(starts) else []


class BlindTrie:
    """Strings of one length in order, with what was stored under each.

    Inner nodes hold only the place of the first byte in which their strings differ; a
    search compares those bytes alone and checks the string it ends at once.
    """

    def __init__(self):
        self.root = None
        self.leaves: list[tuple[bytes, list]] = []

    def add(self, text: bytes, value) -> list:
        """Store a value under ``text``; what is stored there."""
        if self.root is None:
            self.root = self._leaf(text, value)
            return self.leaves[-1][1]
        node = self.root
        while type(node) is tuple:
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other, values = self.leaves[node - 1]
        if other == text:
            values.append(value)
            return values
        differ = int.from_bytes(other, "big") ^ int.from_bytes(text, "big")
        place = len(text) - 1 - (differ.bit_length() - 1) // 8
        parent, node = None, self.root
        while type(node) is tuple and node[0] < place:
            parent, node = node, node[1][text[node[0]]]
        leaf = self._leaf(text, value)
        if type(node) is tuple and node[0] == place:
            node[1][text[place]] = leaf
        else:
            fresh = (place, {other[place]: node, text[place]: leaf})
            if parent is None:
                self.root = fresh
            else:
                parent[1][text[parent[0]]] = fresh
        return self.leaves[-1][1]

    def _leaf(self, text: bytes, value) -> int:
        self.leaves.append((text, [value]))
        return len(self.leaves)

    def ordered(self) -> Iterator[tuple[bytes, list]]:
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield self.leaves[node - 1]


def sorted_repeats(texts: list[bytes], length: int, shallow: int = SHALLOW) -> Iterator[list[tuple[int, int]]]:
    """(text, offset) of suffixes that agree in their first ``length`` bytes, in the order of those."""
    raw = b"".join(texts)
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    sizes = np.diff(ends, prepend=0)
    windows = sizes - length + 1
    begin = ends - sizes
    starts = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    groups = shallow_groups(data, starts, shallow)
    if not groups:
        return
    members = np.concatenate(groups)
    owner = np.searchsorted(ends, members, side="right")
    offset = members - begin[owner]
    for group, own, off in zip(
        groups, *(np.split(x, np.cumsum([*map(len, groups)])[:-1]) for x in (owner, offset)), strict=True
    ):
        if len(group) == 2:  # a trie of two leaves
            s, t = group.tolist()
            if raw[s : s + length] == raw[t : t + length]:
                yield list(zip(own.tolist(), off.tolist(), strict=True))
            continue
        trie, known = BlindTrie(), {}
        for s, value in zip(group.tolist(), zip(own.tolist(), off.tolist(), strict=True), strict=True):
            text = raw[s : s + length]
            if (same := known.get(text)) is None:  # what is known need not go down the trie again
                known[text] = trie.add(text, value)
            else:
                same.append(value)
        for _, same in trie.ordered():
            if len(same) > 1:
                yield same


SPAN_SCHEMA = "deal long, rows binary, sizes binary, spans binary"


def judge(length: int, deals: int):
    """A bucket's stretches: spans to remove, by deal."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        plain = zstandard.ZstdDecompressor().decompress
        spans: dict[int, list[int]] = {}
        texts: dict[bytes, int] = {}
        smallest: list[int] = []
        entries: list[tuple[int, int, int, int]] = []
        for bundle in group.itertuples(index=False):
            rows, raw = np.frombuffer(bundle.rows, np.int64).tolist(), plain(bundle.packed)
            if bundle.done:
                parts = np.split(np.frombuffer(raw, np.int64), np.cumsum(np.frombuffer(bundle.sizes, np.uint32))[:-1])
                for row, flat in zip(rows, parts, strict=True):
                    spans.setdefault(row, []).extend(flat.tolist())
                continue
            ids, starts = np.frombuffer(bundle.ids, np.int64).tolist(), np.frombuffer(bundle.starts, np.uint32).tolist()
            at = 0
            for row, id_, start, size in zip(rows, ids, starts, np.frombuffer(bundle.sizes, np.uint16).tolist(), strict=True):
                number = texts.setdefault(raw[at : at + size], len(texts))
                at += size
                if number == len(smallest):
                    smallest.append(id_)
                elif id_ < smallest[number]:
                    smallest[number] = id_
                entries.append((number, row, id_, start))
        every = list(texts)
        cut: dict[int, list[int]] = {}
        for same in sorted_repeats(every, length) if every else ():
            least = min(smallest[t] for t, _ in same)
            for t, offset in same:
                if smallest[t] > least:
                    cut.setdefault(t, []).append(offset)
        for number, row, id_, start in entries:
            if id_ > smallest[number]:
                spans.setdefault(row, []).extend((start, start + len(every[number])))
            else:
                for offset in cut.get(number, ()):
                    spans.setdefault(row, []).extend((start + offset, start + offset + length))
        done = {row: merged(flat) for row, flat in spans.items()}
        rows, out = np.array(sorted(done), np.int64), []
        for deal, at in _by_deal(rows, deals):
            flats = [done[r] for r in rows[at].tolist()]
            sizes = np.array([*map(len, flats)], np.uint32)
            out.append((deal, rows[at].tobytes(), sizes.tobytes(), np.concatenate(flats).astype(np.uint32).tobytes()))
        return pd.DataFrame(out, columns=["deal", "rows", "sizes", "spans"])

    return run


def merged(flat) -> np.ndarray:
    """Disjoint, ordered spans of which no two touch, from start, end, start, end, ..."""
    pairs = np.asarray(flat, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    head = np.ones(len(pairs), bool)
    head[1:] = pairs[1:, 0] > reach[:-1]
    tails = np.append(np.flatnonzero(head)[1:] - 1, len(pairs) - 1)
    return np.stack([pairs[head, 0], reach[tails]], axis=1).ravel()


RESULT_SCHEMA = "id long, none boolean, many long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary"


def _finish(keep_text: bool):
    def run(held: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        spans: dict[int, list] = {}
        for x in told.itertuples(index=False):
            parts = np.split(np.frombuffer(x.spans, np.uint32), np.cumsum(np.frombuffer(x.sizes, np.uint32))[:-1])
            for row, flat in zip(np.frombuffer(x.rows, np.int64).tolist(), parts, strict=True):
                spans.setdefault(row, []).append(flat)
        out = []
        for data, row in zip(_utf8(held), held["row"].tolist(), strict=True):
            flat = merged(np.concatenate(spans[row])) if row in spans else np.zeros(0, np.int64)
            edges = [0, *flat.tolist(), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if len(flat) else data
            digest = hashlib.sha256(kept).hexdigest()
            out.append((len(data), len(data) - len(kept), len(flat) // 2, digest, flat, kept if keep_text else None))
        frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
        for nth, name in enumerate(("id", "none", "many")):
            frame.insert(nth, name, held[name].to_numpy())
        return frame

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): what is removed and what is left.

    ``spans`` lists starts and ends of removed runs, ``kept`` the remaining bytes. A null
    text counts as empty. Rows with the same id are one document to each other: neither
    removes from the other; equal rows have equal results. Null ids come after all others and
    are one document, too. Texts may be of any length. An empty table gives no rows.
    ``length`` is at least GRAM.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    total = docs.agg(F.sum(n_bytes(F.col("text")))).first()[0] or 0
    buckets = 1 + total // ((length - GRAM + 2) // 2) // BUCKET_ANCHORS
    deals = 1 + total // DEAL_BYTES
    # No nulls go to Python, as pandas would turn ids that stand beside them into floats.
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.col("doc_id").isNull().alias("none"), F.lit(1).cast("long").alias("many"),
        F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"),
    )
    most = keyed.groupBy("row").count().agg(F.max("count")).first()[0] or 0
    if most > CROWD:
        keyed = keyed.groupBy("row", "id", "none").agg(F.sum("many").alias("many"), F.first("text").alias("text"))
        keyed = keyed.select("id", "none", "many", "row", "text")
    dealt = keyed.mapInPandas(pack(deals), PACKED_SCHEMA).repartition("deal")
    bundles = dealt.groupBy("deal").applyInPandas(find_anchors(buckets, length), ANCHOR_SCHEMA)
    tags = bundles.groupBy("bucket").applyInPandas(repeated_anchors(), TAG_SCHEMA)
    beside = lambda told: dealt.groupBy("deal").cogroup(told.groupBy("deal"))
    stretches = beside(tags).applyInPandas(find_stretches(buckets, length), STRETCH_SCHEMA)
    spans = stretches.groupBy("bucket").applyInPandas(judge(length, deals), SPAN_SCHEMA)
    out = beside(spans).applyInPandas(_finish(keep_text), RESULT_SCHEMA)
    out = numbered_copies(out, "many", "__nth", most, "id")
    return out.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), *[c for c in out.columns if c not in ("id", "none", "many", "__nth")])


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
