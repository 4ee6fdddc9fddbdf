"""Search of many terms in many texts: pieces of the texts that may be terms, found by a filter of fixed size.

1. A term is known by hashes of its beginnings, up to ``HEAD`` bytes, and by one of all its bytes. They are set in a filter of
   ``FILTER_BITS`` bits, summed up by Spark; nothing else goes to all tasks, whatever the number of terms.
2. A task asks the filter at every byte of its texts for the shortest beginning, where that passes for the next one, and then for each length
   that some term has. What passes leaves as a row (text row, piece), once for each text row; no text travels.
3. The pieces join the terms as strings, so what the filter lets through by chance meets nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD = 8
FILTER_BITS = 1 << 24
#: Starts of pieces that are looked at together, so that temporaries stay bounded for a text of any length.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1024), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:n]


def _heads(data: np.ndarray, n: int) -> np.ndarray:
    """The ``HEAD`` bytes from each of the first ``n`` places as a number, the first byte lowest; zeros beyond the end."""
    padded = np.zeros(n + HEAD - 1, np.uint64)
    seen = min(len(data), len(padded))
    padded[:seen] = data[:seen]
    out = padded[:n].copy()
    for j in range(1, HEAD):
        out |= padded[j : j + n] << np.uint64(8 * j)
    return out


def _head_hash(heads: np.ndarray, size: int) -> np.ndarray:
    return _mix((heads & np.uint64((1 << (8 * size)) - 1)) + np.uint64(size))


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, "up", len(data)), out=out[1:])
    return out


def _piece_hash(sums: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return _mix((sums[at + size] - sums[at]) * _power(_INVERSE, "down", len(sums))[at] + np.uint64(size))


def _passes(h: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    bits = h & np.uint64(FILTER_BITS - 1)
    return (sieve[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) == 1


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the offset of each, one more at the end; a null text is an empty one."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _strings(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The pieces of ``data`` as strings."""
    offsets = np.zeros(len(at) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    picked = data[np.repeat(at - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(picked.tobytes())]).cast(pa.string())


def _chunk_pieces(data: np.ndarray, offsets: np.ndarray, first: int, sizes: Sequence[int], sieve: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """(text, place, size, hash) of the pieces that start in one chunk, by size."""
    n = min(CHUNK_BYTES, len(data) - first)
    near = data[first : first + n + sizes[-1]]
    heads, sums = _heads(near, n), _sums(near)
    at, known = np.flatnonzero((near[:n] & 0xC0) != 0x80), 0
    for size in sizes:
        for known in range(max(known + 1, min(sizes[0], HEAD)), min(size, HEAD) + 1):
            at = at[_passes(_head_hash(heads[at], known), sieve)]
        text = np.searchsorted(offsets, at + first, "right") - 1
        # A piece ends within its text, before the first byte of a character.
        left = offsets[text + 1] - first - at - size
        whole = (left == 0) | ((left > 0) & ((near[np.minimum(at + size, len(near) - 1)] & 0xC0) != 0x80))
        h = _piece_hash(sums, at[whole], size)
        held = _passes(h, sieve)
        if held.any():
            yield text[whole][held], at[whole][held] + first, size, h[held]


def _pieces(texts: pa.Array, owner: np.ndarray | None, sizes: Sequence[int], sieve: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Row number and piece of what passes, each piece once for a row; ``owner``: the row of each text."""
    data, offsets = _text_bytes(texts)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for first in range(0, len(data) if sizes else 0, CHUNK_BYTES):
        for text, at, size, h in _chunk_pieces(data, offsets, first, sizes, sieve):
            found.append(_once(text if owner is None else owner[text], np.full(len(at), size), h, at))
    if not found:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    rows, size, _, at = _once(*(np.concatenate(part) for part in zip(*found)))
    return rows, _strings(data, at, size)


def _once(rows: np.ndarray, size: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((h, size, rows))
    rows, size, h, at = rows[order], size[order], h[order], at[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (size[1:] != size[:-1]) | (h[1:] != h[:-1])
    return rows[new], size[new], h[new], at[new]


def _term_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, hash) of every term: of its beginnings and of all of it."""
    for batch in batches:
        sizes, hashes = [], []
        for term in batch.column(0).cast(pa.binary()).to_pylist():
            data = np.frombuffer(term, np.uint8)
            found = [_head_hash(_heads(data, 1), size) for size in range(1, min(len(data), HEAD) + 1)]
            found.append(_piece_hash(_sums(data), np.zeros(1, np.int64), len(data)))
            sizes += [len(data)] * len(found)
            hashes += [h.view(np.int64)[0] for h in found]
        yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64())], ["size", "h"])


def _sieve(terms: DataFrame, term: str) -> tuple[list[int], np.ndarray]:
    """The sizes that terms have, and the filter: at most FILTER_BITS / 64 words come to the driver."""
    hashes = terms.filter(F.octet_length(term) > 0).select(F.col(term).alias("term")).distinct().mapInArrow(_term_hashes, "size int, h long")
    bit = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = hashes.groupBy(F.shiftright(bit, 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("v"),
        F.collect_set("size").alias("sizes")).toPandas()
    sieve = np.zeros(FILTER_BITS // 64, np.int64)
    sieve[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64)
    return sorted({int(size) for sizes in rows["sizes"] for size in sizes}), sieve.view(np.uint64)


def term_pieces(texts: DataFrame, ident: Sequence[str], text: str, terms: DataFrame, term: str, name: str = "_term") -> DataFrame:
    """The ``ident`` columns and ``name``: every non-empty term that a text row contains, once, and a few pieces that are no terms.

    ``text`` is a string or a list of strings, which are searched one by one. A term is contained as ``contains`` says, byte by byte.
    """
    sizes, words = _sieve(terms, term)
    sieve = texts.sparkSession.sparkContext.broadcast(words)
    listed = isinstance(texts.schema[text].dataType, T.ArrayType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(ident))
            owner = pc.list_parent_indices(column).to_numpy(zero_copy_only=False) if listed else None
            rows, pieces = _pieces(column.flatten() if listed else column, owner, sizes, sieve.value)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows)) for c in batch.columns[: len(ident)]], pieces], [*ident, name])

    schema = T.StructType([*texts.select(*ident).schema.fields, T.StructField(name, T.StringType())])
    return texts.select(*ident, F.col(text).alias("_searched")).mapInArrow(run, schema)
