"""Helpers shared by the text operators: vectorised words over Arrow batches, word hashes, staging.

Texts reach Python as Arrow batches and are cut into slices of at most ``SLICE_BYTES`` (or one text), so that the temporaries
of a task stay bounded whatever a batch holds. A slice is one byte buffer with the offset of every text in it. A text above that size is a
slice of its own: the wide temporaries (hashes of bytes) go over it in runs of words or lines of the same size, and what grows with it
are a few bytes for each byte and some numbers for each word, about ten times its size in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: The two kinds of word, as sets of bytes (bytes of 0x80 and above belong to non-ASCII characters), and A-Z.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
INK_BYTES = np.ones(256, bool)
INK_BYTES[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INK_PATTERN = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER_ASCII, LOWER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass
class Slice:
    """Some texts of a batch: rows ``first`` to ``first + n``, their lower-cased bytes and the offsets of each text in them."""

    first: int
    n: int
    raw: np.ndarray
    low: np.ndarray
    offsets: np.ndarray


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """A null text counts as an empty one."""
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        raw = data[offsets[start] : offsets[stop]]
        yield Slice(start, stop - start, raw, LOWER[raw], offsets[start : stop + 1] - offsets[start])
        start = stop


def word_spans(s: Slice, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of the first word at or after it (one more at the end)."""
    inside = np.zeros(len(s.low) + 2, bool)
    inside[1:-1] = kind[s.low]
    edge = np.zeros(len(s.low) + 1, bool)
    edge[s.offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, s.offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:n]


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of every word, from prefix sums of a polynomial; a long text goes in runs of words, which are hashed alike."""
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        origin = int(starts[first])
        stop = max(first + 1, int(np.searchsorted(ends, origin + SLICE_BYTES, "right")))
        a, b = starts[first:stop] - origin, ends[first:stop] - origin
        piece = low[origin : origin + int(b[-1])]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _power(_BASE, "up", len(piece)), out=sums[1:])
        down = _power(_INVERSE, "down", len(piece) + 1)
        out[first:stop] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        first = stop
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, in the order of their first words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = mix(h + words[j : j + n])
    return h


def inside_one_text(first_word: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """For every run of ``k`` words of a slice, whether it lies in a single text."""
    n = max(0, n_words - k + 1)
    text = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    return text[:n] == text[k - 1 : k - 1 + n] if n else np.zeros(0, bool)


def split_words(text: Column, pattern: str = INK_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER_ASCII, LOWER_ASCII)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def with_row_number(df: DataFrame, name: str) -> DataFrame:
    """A number for each row; only for staged tables, whose rows never change again."""
    return df.withColumn(name, F.monotonically_increasing_id())


def empty_batch(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([], schema=schema)
