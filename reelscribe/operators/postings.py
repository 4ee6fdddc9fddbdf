"""Sorted distinct ids of every key, moved as bytes: a task lists the ids it holds of a key as gaps, about a byte for each, before any shuffle.

Ids are cut into blocks of ``span``. Lists meet by key and block, so that no task holds all ids of a hot key; what a block's
ids follow in their key is a sum over the numbers of the earlier blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and ids that a task packs at once, ids of a block, and bytes of lists that are read at once. They bound memory; results are the same with any.
RUN_IDS = 1 << 22
SPAN = 1 << 20
SLICE_BYTES = 1 << 20


def to_bytes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 as bytes of seven bits, lowest first; the last byte of a number is below 128. Also the length of each."""
    length, rest = np.ones(len(numbers), np.uint8), numbers >> 7
    while rest.any():
        length += rest > 0
        rest >>= 7
    at, rest = np.cumsum(length, dtype=np.int64), numbers
    out = np.empty(int(at[-1]) if len(at) else 0, np.uint8)
    at -= length
    while len(rest):
        more = rest > 127
        out[at] = (rest & 127) | (more * 128)
        at, rest = at[more] + 1, rest[more] >> 7
    return out, length


def from_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``to_bytes``, and where the last byte of each lies."""
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    numbers, length = (data[first] & 127).astype(np.int64), last - first
    for k in range(1, int(length.max(initial=0)) + 1):
        longer = np.flatnonzero(length >= k)
        numbers[longer] |= (data[first[longer] + k] & 127).astype(np.int64) << (7 * k)
    return numbers, last


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """In order. Sorting is several times faster here than the hashing of ``np.unique``."""
    numbers = np.sort(numbers)
    return numbers[np.concatenate([[True], numbers[1:] != numbers[:-1]])] if len(numbers) else numbers


def _packed_run(batches: list[pa.RecordBatch], span: int) -> pa.RecordBatch:
    """(key, block, ids) of some rows (key, list of ids, ...). The ids of a block are places in it, those of the n-th list after n spans.

    ``batches`` is emptied, so that the rows are gone before the arrays of their ids are made.
    """
    table = pa.Table.from_batches(batches)
    batches.clear()
    keys = table.column(0).dictionary_encode("encode").combine_chunks()
    code, width = keys.indices.to_numpy(zero_copy_only=False), (table.num_columns - 1) * span
    owners, picks, blocks, places, n = [], [], [], [], 0
    for kind, column in enumerate(table.columns[1:]):
        lists = column.combine_chunks()
        held = pc.list_flatten(lists)
        owners.append(code[pc.list_parent_indices(lists).filter(pc.is_valid(held)).to_numpy()])
        ids = held.drop_null().dictionary_encode()
        picks.append(ids.indices.to_numpy(zero_copy_only=False) + n)
        block, place = np.divmod(ids.dictionary.to_numpy(zero_copy_only=False), span)
        blocks.append(block)
        places.append(place + kind * span)
        n += len(block)
    if n == 0:
        return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.binary())], ["key", "block", "ids"])
    del table, column, lists, held, ids
    # The distinct ids are few beside the pairs, which are numbers (key, rank of the id) from here on.
    block, place = np.concatenate(blocks), np.concatenate(places)
    order = np.lexsort((place, block))
    block, place, rank = block[order], place[order], np.empty(n, np.int64)
    rank[order] = np.arange(n)
    pairs = _distinct(np.concatenate([o.astype(np.int64) * n + rank[p] for o, p in zip(owners, picks)]))
    del owners, picks
    owner = (pairs // n).astype(np.int32)
    pairs %= n
    block, gaps = block[pairs], place[pairs]
    opens = np.ones(len(pairs), bool)
    opens[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
    heads = np.flatnonzero(opens)
    owner, block, firsts = owner[heads], block[heads], gaps[heads]
    gaps = np.diff(gaps, prepend=0)
    gaps[heads] = firsts
    data, length = to_bytes(gaps)
    ends = np.append((np.cumsum(length, dtype=np.int64) - length)[heads], len(data)).astype(np.int32)
    lists = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(owner)), pa.array(block), lists], ["key", "block", "ids"])


def _slices(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes, or one row."""
    start = 0
    while start < len(ends) - 1:
        stop = max(int(np.searchsorted(ends, ends[start] + limit, "right")) - 1, start + 1)
        yield start, stop
        start = stop


def _merged(batches: Iterator[pa.RecordBatch], kinds: int, span: int, limit: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (key, block, ids, kind, before) in order of key and block, as whole lists: (keys, blocks, kinds, sums of before, numbers of ids, all ids).

    The last key and block of a slice of rows wait for the next one with their places so far, at most ``span`` of a kind.
    """
    width, none = kinds * span, np.zeros(0, np.int64)

    def lists(keys: pa.Array, block: np.ndarray, before: np.ndarray, values: np.ndarray):
        sizes = np.bincount(values // span, minlength=len(before))
        some = np.flatnonzero(sizes)
        return keys.take(pa.array(some // kinds)), block[some // kinds], some % kinds, before[some], sizes[some], np.repeat(block[some // kinds] * span, sizes[some]) + values % span

    head: tuple | None = None  # the key and block that wait
    waiting, rest = np.zeros(kinds, np.int64), none
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys, ids = batch.column(0).cast(pa.string()), batch.column(2)
        code = keys.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        block, kind, ahead = (batch.column(i).to_numpy() for i in (1, 3, 4))
        changes = np.ones(len(block), bool)
        changes[1:] = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
        changes[0] = head != (keys[0].as_py(), int(block[0]))
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy())]).astype(np.int64)
        for start, stop in _slices(ends, limit):
            numbers, last = from_bytes(np.frombuffer(b"".join(ids.slice(start, stop - start).to_pylist()), np.uint8))
            begins = np.searchsorted(last, ends[start : stop + 1] - ends[start])
            counts, summed = np.diff(begins), np.concatenate([[0], np.cumsum(numbers)])
            group = np.cumsum(changes[start:stop])  # group 0 is what waits
            before = np.zeros((int(group[-1]) + 1) * kinds, np.int64)
            before[:kinds] = waiting
            np.add.at(before, group * kinds + kind[start:stop], ahead[start:stop])
            values = _distinct(np.concatenate([rest, summed[1:] + np.repeat(group * width - summed[begins[:-1]], counts)]))
            heads = np.flatnonzero(changes[start:stop]) + start
            if len(heads):
                cut, skip = int(np.searchsorted(values, group[-1] * width)), int(head is None)  # nothing waits at the very first
                names, blocks = keys.take(pa.array(heads[:-1])), block[heads[:-1]]
                if not skip:
                    names, blocks = pa.concat_arrays([pa.array([head[0]], pa.string()), names]), np.append(head[1], blocks)
                if len(names):
                    yield lists(names, blocks, before[skip * kinds : -kinds], values[:cut] - skip * width)
                values, head = values[cut:], (keys[int(heads[-1])].as_py(), int(block[heads[-1]]))
            waiting, rest = before[-kinds:], values % width
    if head is not None:
        yield lists(pa.array([head[0]], pa.string()), np.array([head[1]]), waiting, rest)


def sorted_lists(cited: DataFrame, key: str, lists: list[str], span: int = SPAN, run_ids: int = RUN_IDS, limit: int = SLICE_BYTES) -> DataFrame:
    """(key, kind, before, ids): the distinct ids that a (string) key has in the n-th of ``lists``, kind n, in order; a row for each block, ``before`` ids are in earlier ones."""
    n_lists = len(lists)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows + sum(len(pc.list_flatten(c)) for c in batch.columns[1:])
            if size >= run_ids:
                yield _packed_run(held, span)
                size = 0
        if held:
            yield _packed_run(held, span)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, blocks, kinds, _, sizes, _ in _merged(batches, n_lists, span, limit):
            yield pa.RecordBatch.from_arrays([keys, pa.array(blocks, pa.int64()), pa.array(kinds, pa.int32()), pa.array(sizes, pa.int64())], ["key", "block", "kind", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, kinds, before, sizes, ids in _merged(batches, n_lists, span, limit):
            places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.array(kinds, pa.int32()), pa.array(before, pa.int64()), pa.ListArray.from_arrays(pa.array(places), pa.array(ids, pa.int64()))], ["key", "kind", "before", "ids"])

    rows = cited.select(F.col(key).alias("key"), *[F.col(c).cast("array<bigint>").alias(c) for c in lists])
    # Both passes read this one shuffle.
    met = rows.mapInArrow(pack, "key string, block long, ids binary").repartition("key", "block").select("key", "block", "ids", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("before"))
    sizes = met.sortWithinPartitions("key", "block").mapInArrow(count, "key string, block long, kind int, n long")
    earlier = Window.partitionBy("key", "kind").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    follows = sizes.withColumn("before", F.sum("n").over(earlier)).filter("before > 0").select("key", "block", F.lit(b"").alias("ids"), "kind", "before")
    # What a block follows travels as a row beside its lists: a join might be split for skew, a block must not be.
    both = met.unionByName(follows).repartition("key", "block").sortWithinPartitions("key", "block")
    return both.mapInArrow(spell, "key string, kind int, before long, ids array<long>")
