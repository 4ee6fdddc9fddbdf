"""Integer vectors of the embedding operators: every component becomes floor(256 * c), a vector travels as bytes.

A vector's bytes are the width of its numbers (2, 4 or 8) and the numbers, as narrow as its largest one allows, so equal vectors
have equal bytes and a vector of unit length takes half the room of its floats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

SCALE = 256


def encode(values: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The bytes of vectors that lie behind each other in ``values``."""
    ends = np.cumsum(lengths)
    out = []
    for a, b in zip((ends - lengths).tolist(), ends.tolist()):
        x = values[a:b]
        most = int(np.abs(x).max()) if b > a else 0
        kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
        out.append(bytes([int(kind[2])]) + x.astype(kind).tobytes())
    return out


def decode(vectors: list[bytes], width: int | None = None) -> np.ndarray:
    """A matrix of longs; a vector shorter than the longest one (or ``width``) has zeros beyond its end."""
    if not vectors:
        return np.zeros((0, width or 0), np.int64)
    size, kind = len(vectors[0]), vectors[0][0]
    if all(len(v) == size and v[0] == kind for v in vectors):
        flat = np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), size)[:, 1:]
        x = np.ascontiguousarray(flat).view(f"<i{kind}").astype(np.int64) if size > 1 else np.zeros((len(vectors), 0), np.int64)
        return x if width is None or x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
    x = np.zeros((len(vectors), max(width or 0, *((len(v) - 1) // v[0] for v in vectors))), np.int64)
    for row, v in zip(x, vectors):
        row[: (len(v) - 1) // v[0]] = np.frombuffer(v, f"<i{v[0]}", offset=1)
    return x


def integer_vectors(rows: DataFrame, keep: list[Column], column: str, limit: int) -> DataFrame:
    """The columns ``keep`` and ``x``; rows whose vector is null, or holds a null, a non-finite or a too large component, go.

    Too large: floor(256 * c) of ``limit`` or more in size, which the sums and products of the caller could not hold.
    """
    source = rows.select(*keep, rows[column].cast("array<double>").alias("vector"))
    names = source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            scaled = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
            bad = np.zeros(len(scaled) + 1, np.int64)
            np.cumsum(~(np.abs(scaled) < limit), out=bad[1:])  # NaN, which a null has become too, is not below it
            ends = np.cumsum(lengths)
            ok = (bad[ends] == bad[ends - lengths]) & lists.is_valid().to_numpy(zero_copy_only=False)
            values = scaled[np.repeat(ok, lengths)].astype(np.int64)
            kept = pa.array(ok)
            columns = [c.filter(kept) for c in batch.columns[: len(names)]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(encode(values, lengths[ok]), pa.binary())], [*names, "x"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}x binary")
