"""Operator 7, SimHash near-dedup: fingerprints that differ in at most ``RADIUS`` bits link their documents.

1. Each text becomes a 64-bit fingerprint of its word shingles (bits set in over half of the shingle hashes).
2. Copies meet by an aggregate: from here on only distinct fingerprints travel.
3. Fingerprints are cut into ``PARTS`` parts; two that differ in at most three bits agree in at least two parts of five, so they
   meet in one of the ten buckets of pairs of parts. No link is lost. A bucket above ``BLOCK`` rows is cut into blocks and every
   pair of blocks becomes a task of its own of at most twice that size.
4. Buckets are compared bit-sliced: a tile of rows is stored as 64 bit planes, carry-save counters add up the differing bits of
   many distances at once, and rows are abandoned once every distance of theirs exceeds the radius. A pair of tiles that is
   already one group is skipped, and only the edges that join two groups leave the task, so a group of n near copies gives
   fewer than n edges for a task instead of all its pairs.
5. Edges are contracted to components by rounds of star joins, staged in the shared checkpoint folder.

Edge cases: a null or empty text, or one of blanks only, has fingerprint zero and links like any other; texts below the shingle
length are one shingle. Rows with a null id take part, the component id is the smallest id that is not null (null when there is
none). Repeated rows and equal texts share a fingerprint and thus a component. Texts of any length count whole, a slice of about a megabyte or one text at a time. An empty table gives an empty result. Only id and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscribe.llm.common import INK_BYTES, text_slices, with_row_number, word_spans
from reelscribe.session import stage_table

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Bits of each part; two fingerprints within the radius agree in at least two of the five.
PARTS = (13, 13, 13, 13, 12)
TILE, BLOCK = 512, 8192
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# Fingerprints


def _fingerprints(texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    for s in text_slices(texts):
        starts, ends, first = word_spans(s, INK_BYTES)
        for row in range(s.n):
            a, b = first[row], first[row + 1]
            if a == b:
                continue
            # Words joined by single spaces: the bytes of the shingle from word i are one stretch of this buffer.
            lengths = ends[a:b] - starts[a:b]
            low = s.low[s.offsets[row] : s.offsets[row + 1]]
            keep = np.zeros(len(low) + 1, bool)
            keep[:-1] = INK_BYTES[low]
            keep[ends[a:b] - s.offsets[row]] = True
            padded = np.append(low, np.uint8(0x20))
            padded[ends[a:b] - s.offsets[row]] = 0x20
            joined = padded[keep].tobytes()
            at = np.zeros(b - a + 1, np.int64)
            np.cumsum(lengths + 1, out=at[1:])
            n = max(1, b - a - SHINGLE + 1)
            begin, stop = at[:n].tolist(), (at[min(SHINGLE, b - a) :][:n] - 1).tolist()
            digest = xxhash.xxh64_intdigest
            h = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(begin, stop)), np.uint64, n)
            bits = np.zeros(64, np.int64)
            for piece in range(0, n, 1 << 15):
                bits += np.unpackbits(h[piece : piece + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[s.first + row] = np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """(doc_id, the keys, fingerprint): the fingerprint as a signed long, one row per document."""
    names = ["doc_id", *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_fingerprints(batch.column(len(names))).view(np.int64))], [*names, "fingerprint"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    return docs.select(*names, "text").mapInArrow(run, f"{kinds}, fingerprint long")


# Bit-sliced comparison


def _planes(rows: np.ndarray) -> np.ndarray:
    """64 bit planes of a tile: plane b holds bit b of every row, 64 rows to a word."""
    bits = np.unpackbits(rows.view(np.uint8).reshape(len(rows), 8), axis=1, bitorder="little")
    padded = np.zeros((64, TILE), np.uint8)
    padded[:, : len(rows)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _within(queries: np.ndarray, planes: np.ndarray, beyond: np.ndarray, radius: int) -> np.ndarray:
    """Matrix of queries by lanes: whether the distance is at most the radius. ``beyond``: lanes that are not asked for."""
    width = max(1, radius.bit_length())
    alive = np.arange(len(queries))
    over = beyond.copy()
    # Counters start so that they overflow at the first difference beyond the radius.
    start = (1 << width) - (radius + 1)
    counters = [np.full_like(over, ALL if start >> k & 1 else 0) for k in range(width)]
    result = np.zeros((len(queries), planes.shape[1] * 64), bool)
    ones = np.where(np.unpackbits(queries.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool), ALL, np.uint64(0))
    for b in range(64):
        carry = planes[b][None, :] ^ ones[:, b : b + 1]
        for k in range(width):
            both = counters[k] & carry
            counters[k] ^= carry
            carry = both
        over |= carry
        if b % 8 == 7:
            live = (over != ALL).any(axis=1)
            if not live.any():
                return result
            if not live.all():
                alive, over, ones = alive[live], over[live], ones[live]
                counters = [c[live] for c in counters]
    result[alive] = ~np.unpackbits(over.view(np.uint8).reshape(len(over), -1), axis=1, bitorder="little").astype(bool)
    return result


class _Groups:
    """Groups of the rows of one task, joined by edges."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        r = self.root[i]
        while True:
            up = self.root[r]
            if (up == r).all():
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The edges, as pairs of rows, that joined two groups."""
        found, root = [], self.root
        ra, rb = self.find(a), self.find(b)
        _, one = np.unique(ra * len(root) + rb, return_index=True)
        one = one[ra[one] != rb[one]]
        for i, j, x, y in zip(*(v[one].tolist() for v in (a, b, ra, rb))):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((i, j))
        if found:
            self.root = self.find(np.arange(len(root)))
        return found


def link_rows(rows: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that connect what the links between rows of one bucket connect; ``rows`` are sorted by bucket.

    Rows of two buckets that share a tile are compared as well: such a link is as true as any other.
    """
    edges: list[tuple[int, int]] = []
    groups = _Groups(len(rows))
    planes: dict[int, np.ndarray] = {}
    n_tiles = -(-len(rows) // TILE)
    lanes = np.arange(TILE)
    for t in range(n_tiles):
        a, b = t * TILE, min(len(rows), (t + 1) * TILE)
        for u in range(t, n_tiles):
            c, d = u * TILE, min(len(rows), (u + 1) * TILE)
            if u > t and bucket[c] != bucket[b - 1]:
                break
            first = a if u == t else a + int(np.searchsorted(bucket[a:b], bucket[b - 1]))
            ra, rc = groups.find(np.arange(first, b)), groups.find(np.arange(c, d))
            if (ra == ra[0]).all() and (rc == ra[0]).all():
                continue
            if u not in planes:
                planes[u] = _planes(rows[c:d])
            open_lanes = (lanes[None, :] < d - c) & (lanes[None, :] + c > np.arange(first, b)[:, None])
            beyond = np.packbits(~open_lanes, axis=1, bitorder="little").view(np.uint64)
            match = _within(np.ascontiguousarray(rows[first:b]), planes[u], beyond, radius)
            if match.any():
                i, j = np.nonzero(match)
                edges += groups.join(i + first, j + c)
        planes.pop(t, None)
    return edges


def compare_buckets(buckets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges that connect what the links within the buckets connect. ``buckets``: (bucket, f), sorted in partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_bucket, held_row = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def done(bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            pairs = np.array(link_rows(rows, bucket, radius), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rows[pairs[:, k]].view(np.int64)) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            bucket = np.concatenate([held_bucket, batch.column(0).to_numpy(zero_copy_only=False)])
            row = np.concatenate([held_row, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            if not len(row):
                continue
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield done(bucket[:cut], row[:cut])
            held_bucket, held_row = bucket[cut:], row[cut:]
        if len(held_row):
            yield done(held_bucket, held_row)

    return buckets.mapInArrow(run, "a long, b long")


def bucketed(distinct: DataFrame) -> DataFrame:
    """(bucket, f): every fingerprint in the buckets of its pairs of parts that hold another one, crowded ones in pairs of blocks."""
    f = F.col("f")
    part, shift = [], 0
    for bits in PARTS:
        part.append(F.shiftrightunsigned(f, shift).bitwiseAND(F.lit((1 << bits) - 1)))
        shift += bits
    keys = [F.lit(n << 26) + part[p] * (1 << 13) + part[q] for n, (p, q) in enumerate(combinations(range(len(PARTS)), 2))]
    rows = distinct.select(f, F.explode(F.array(*keys)).alias("key"))
    crowd = rows.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("mine"))))
    placed = rows.join(crowd, "key").withColumn("mine", mine).select("key", "f", "mine", other.alias("other"))
    pair = F.shiftleft(F.least("mine", "other").cast("long"), 30) + F.shiftleft(F.greatest("mine", "other").cast("long"), 46)
    tasks = placed.select((F.col("key") + pair).alias("bucket"), "f")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(parts, "bucket").sortWithinPartitions("bucket", "f")


# Components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge with the smallest node of its component. Rounds of large and small stars."""
    star = stage_table(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = star.union(star.select("b", "a")).toDF("u", "v")
        centre = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(centre, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = stage_table(small.union(lowest).distinct())
        now = star.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first()
        if now == seen:
            return star.toDF("node", "root")
        seen = now


def component_roots(distinct: DataFrame, radius: int) -> DataFrame:
    """The staged rows of distinct fingerprints ``f`` with the root of their component."""
    if radius > len(PARTS) - 2:
        raise ValueError("the buckets are complete up to a radius of three")
    roots = components(compare_buckets(bucketed(distinct.select("f")), radius))
    return distinct.join(roots, F.col("f") == F.col("node"), "left").select(*distinct.columns, F.coalesce("root", "f").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document; the fingerprint as a signed long."""
    prints = stage_table(fingerprints(docs))
    distinct = stage_table(prints.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("least_id")))
    placed = component_roots(distinct, radius)
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = placed.join(named, "root").select("f", "component_id")
    return prints.join(by_print, F.col("fingerprint") == F.col("f")).select("doc_id", "fingerprint", "component_id")


def dedup_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group, that with the smallest id (null ids last, then by fingerprint and row); columns as given."""
    staged = with_row_number(stage_table(docs.select(F.struct("*").alias("doc"))), "row_no")
    prints = stage_table(fingerprints(staged.select(F.col("doc.doc_id").alias("doc_id"), "row_no", F.col("doc.text").alias("text")), "row_no"))
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.col("fingerprint").alias("print"), "row_no")
    distinct = stage_table(prints.groupBy(F.col("fingerprint").alias("f")).agg(F.min(row).alias("least")))
    kept = component_roots(distinct, radius).groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row_no").alias("kept_no"))
    return staged.join(kept, F.col("row_no") == F.col("kept_no"), "left_semi").select("doc.*")
