"""Quality rules: counts over words and lines, and compression bands.

The bands compare the zstandard ratio (compressed over plain UTF-8 bytes) of the whole
document, and of its fixed chunks, with limits for the length of what was compressed:
below the lower limit the text repeats itself, above the upper one it is noise. Every
text and every chunk is judged, a last, shorter chunk by the limits for its own length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import per_text

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)


@dataclass(frozen=True)
class Bands:
    """``limits``: (least bytes, lowest ratio, highest ratio), by rising length.

    The limits come from the ratios of prose that is labelled good (10,000 texts in four
    languages): by length, its least ratio less a fifth or more and its highest plus a tenth
    or more. Such prose lies at 0.75 to 1.13 for 64 bytes, 0.47 to 0.58 for 1 KiB and 0.40 to
    0.45 for 8 KiB. Below 16 bytes the frame of the format outweighs the text, and nothing is
    rejected. ``bad_share`` is the part of a text's bytes that may lie in bad chunks: a table,
    a listing or a key within good prose stays below it, and junk that is glued on does not.
    """

    limits: tuple[tuple[int, float, float], ...] = (
        (16, 0.90, 1.75),
        (32, 0.75, 1.45),
        (64, 0.50, 1.30),
        (128, 0.45, 1.02),
        (256, 0.42, 0.85),
        (512, 0.40, 0.75),
        (1024, 0.36, 0.68),
        (2048, 0.34, 0.63),
        (4096, 0.30, 0.60),
        (8192, 0.26, 0.58),
        (32768, 0.20, 0.58),
    )
    chunk_bytes: int = 2048
    bad_share: float = 0.25
    level: int = 3

    def ok(self, size: int, ratio: float) -> bool:
        fitting = [x for x in self.limits if x[0] <= size]
        return not fitting or fitting[-1][1] <= ratio <= fitting[-1][2]


def repeated_words(words: list, window: int = 8) -> int:
    """Words inside windows of ``window`` words that the text holds twice or more.

    Windows are compared exactly: ids of windows of 1, 2, 4, ... words are numbered anew
    from pairs of ids, so no two different windows share a number.
    """
    n = len(words)
    if n <= window:
        return 0
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    width = 1
    counts = None
    while width < window:
        step = min(width, window - width)
        pair = ids[: len(ids) - step] * (n + 1) + ids[step:]
        _, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        width += step
        if len(counts) == len(ids):
            return 0
    starts = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def measure(text: str | None, bands: Bands, compressor) -> tuple:
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    text = text or ""
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    seen: set = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeats = repeated_words(words)
    failed = n < 20 or 100 * repeats > 30 * n
    ratio = len(compressor.compress(data)) / len(data) if data else 0.0
    chunks = [data[i : i + bands.chunk_bytes] for i in range(0, len(data), bands.chunk_bytes)]
    bad = [len(x) for x in chunks if not bands.ok(len(x), len(compressor.compress(x)) / len(x))]
    ok = bands.ok(len(data), ratio) and sum(bad) <= bands.bad_share * len(data)
    return n, chars, symbols, dup, repeats, failed, ok and not failed, ratio, len(chunks), len(bad)


def quality(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): counts, ratios and the verdict.

    A null or empty text has no words, so it fails the base rules; an empty table gives no
    rows. Rows are judged one by one; repeated rows give repeated results. Texts of any
    length are compressed whole, and no chunk of them is left out.
    """
    bands = bands or Bands()

    def make():
        import zstandard

        compressor = zstandard.ZstdCompressor(level=bands.level)
        return lambda texts: [measure(t, bands, compressor) for t in texts]

    return per_text(docs, SCHEMA, make)


def query(docs: DataFrame) -> DataFrame:
    return quality(docs).select("*", F.lit(3).alias("zstd_level"))
