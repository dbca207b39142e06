"""Near-duplicates by SimHash fingerprints that meet at the words of a covering code.

A fingerprint has a bit for each bit of XXH64 over the text's shingles of three words,
set where more than half of the shingles set it. Equal fingerprints become one node.

The anchors are the words of the perfect Hamming code over the low 63 bits, each with
either value of the last bit: every point lies within one bit (the covering radius) of
exactly one of them. Both sides of a link are replicated, so each has to go only half of
the threshold beyond the covering radius: a point midway between two linked fingerprints
is within half the threshold of both, and the anchor that covers it within that and one
more. For two bits these are 33 or 34 anchors a fingerprint, however many there are, and
an anchor never holds more than the 2,081 points around it: no group can grow with the
input. (Going the full threshold beyond the radius finds the same links with 684 replicas;
``reach`` sets it.) Each anchor compares what it holds and passes on as few links as
connect it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import cut, per_text
from orrery.llm.neardup import components, spanning

WIDTH, BITS, SEED = 3, 2, 42
#: Length and covering radius of the code.
LENGTH, RADIUS = 63, 1
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def words_in_pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased in ASCII, some at a time."""
    at = 0
    while at < len(data):
        end = _SPACE.search(data, at + PIECE)
        end = end.start() if end else len(data)
        yield data[at:end].lower().split()  # of bytes: only A-Z change, only ASCII white space parts
        at = end


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint as a signed number; 0 without words."""
    from xxhash import xxh64_intdigest

    total, count, kept = np.zeros(64, np.int64), 0, []

    def add(words: list[bytes]) -> None:
        nonlocal total, count
        line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends[: -width]]
        hashes = [xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
        count += len(hashes)

    for words in words_in_pieces((text or "").encode("utf-8", "replace")):
        kept += words
        if len(kept) >= width:
            add(kept)
            kept = kept[len(kept) - width + 1 :]
    if not count and kept:
        width = len(kept)
        add(kept)
    return int(np.packbits(2 * total > count, bitorder="little").view("<i8")[0])


def patterns(reach: int) -> list[list[int]]:
    """For each syndrome, the flips of at most ``reach`` bits that lead to an anchor (as signed numbers)."""
    out: list[list[int]] = [[] for _ in range(LENGTH + 1)]
    for weight in range(reach + 1):
        for places in combinations(range(LENGTH), weight):
            flips, syndrome = 0, 0
            for p in places:
                flips |= 1 << p
                syndrome ^= p + 1
            out[syndrome].append(flips)
            if weight < reach:
                out[syndrome].append(flips - (1 << 63))
    return out


def anchors(point: Column, reach: int) -> Column:
    """The anchors within ``reach`` bits of a fingerprint, as an array."""
    syndrome = F.lit(0)
    for j in range(LENGTH.bit_length()):
        places = sum(1 << p for p in range(LENGTH) if (p + 1) >> j & 1)
        syndrome = syndrome + F.pmod(F.bit_count(point.bitwiseAND(F.lit(places).cast("long"))), F.lit(2)) * (1 << j)
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in patterns(reach)])
    return F.transform(F.get(table, syndrome), lambda flips: flips.bitwiseXOR(point))


def _joined(bits: int):
    """As few links as connect what each anchor holds."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            held = batch.column(0)
            flat, ends = held.flatten().to_numpy(), held.offsets.to_numpy() - held.offsets[0].as_py()
            found = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                here = np.sort(flat[a:b])
                x, y = np.nonzero(np.triu(np.bitwise_count((here[:, None] ^ here).view(np.uint64)) <= bits, 1))
                if len(x):
                    found += spanning(here, np.stack([x, y], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def links(points: DataFrame, bits: int = BITS, reach: int | None = None) -> DataFrame:
    """Links ``a, b`` of at most ``bits`` bits that connect the distinct fingerprints ``points (node)``."""
    reach = RADIUS + (bits + 1) // 2 if reach is None else reach
    placed = points.select("node", F.explode(anchors(F.col("node"), reach)).alias("anchor"))
    met = placed.groupBy("anchor").agg(F.collect_list("node").alias("held")).filter(F.size("held") > 1)
    return met.select("held").mapInArrow(_joined(bits), "a long, b long")


def fingerprints(docs: DataFrame, width: int = WIDTH, *beside: str) -> DataFrame:
    """``doc_id``, the columns ``beside`` and the fingerprint as ``node`` of every row."""
    return per_text(docs, "node long", lambda: lambda texts: [(fingerprint(t, width),) for t in texts], *beside)


def simhash_groups(docs: DataFrame, width: int = WIDTH, bits: int = BITS, reach: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): fingerprint and component.

    Null, empty and blank texts have fingerprint zero, which links like any other. A text of
    fewer than ``width`` words is one shingle; texts of any length are taken whole, cut into
    words a piece at a time. Ties (a bit set in exactly half of the shingles) give 0. A null
    id has a fingerprint, but a null component, and links nothing. Rows that share an id but
    not a fingerprint are nodes of their own, which both bear that id; repeated rows have
    equal results. Other columns of ``docs`` are not looked at. An empty table gives no rows.
    """
    every = cut(fingerprints(docs, width))
    nodes = cut(every.filter("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep")))
    labels = components(links(nodes.select("node"), bits, reach))
    least = labels.join(nodes, "node")
    least = least.groupBy("label").agg(F.min("rep").alias("least"))
    found = labels.join(least, "label").select("node", "least")
    found = nodes.join(found, "node", "left").select("node", F.coalesce("least", "rep").alias("found"))
    out = every.join(found, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("found"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    return simhash_groups(docs)
