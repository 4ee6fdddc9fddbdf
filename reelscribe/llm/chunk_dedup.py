"""Operator 10, substring dedup by content-defined chunks.

1. A gear hash rolls over the bytes of each line; a chunk ends where the hash is the smallest (the last of equal ones) of some
   ``WINDOW`` hashes in a row, at the line's end, and at ``MAX_CHUNK`` bytes. Which hash that is depends on the bytes near it alone, so
   words put in before a passage move its chunks along and change none but the first ones, and every window of a passage has a cut.
2. Chunks meet by a 96-bit digest, in one shuffle: a window gives each digest its smallest document, and chunks of other documents are
   repeats. Digests that are frequent in a sample of the documents (``HOT_SHARE`` of its chunks or more, so there are at most one
   over that share of them) are spread by a salt; their smallest documents come from a second reading of the same shuffle, one
   row for each digest. The sample decides on the spreading only, never on a result.
3. Neighbouring repeats of a document form spans, also over blank lines; those of at least ``MIN_WORDS`` words are reported and can be cut out.
A passage within a line loses at most ``REACH + PERIOD - 1`` bytes and a window at its start and a window at its end: 119 bytes in
all, and 20 of 51 words always remain where words and blanks take four bytes or more on average (runs that repeat within
``PERIOD`` bytes have no cuts and may lose up to ``MAX_CHUNK``). Shorter shared lines (line dedup's work) stay.

Edge cases: a null or empty text has no chunks. A null id is the first holder only where no row with an id holds the passage: then
that of the text with the smallest hash stays, and ``first_doc_ids`` has no entry for it. Equal texts (by a 64-bit hash) with a null id are
one document. Repeated rows of an id are one document and do not repeat each other, nor does a passage within one
document. Texts may be very long: a slice of about a megabyte is cut at a time. An empty table gives no rows. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscribe.llm.common import INK_BYTES, SLICE_BYTES, Slice, mix, text_slices
from reelscribe.session import stage_table

WINDOW, MAX_CHUNK, MIN_WORDS = 48, 512, 20
REACH, PERIOD = 16, 8
#: Documents that are sampled, the share of a sample's chunks that makes a digest hot, and parts that such a digest is spread over.
SAMPLE, HOT_SHARE, SALTS = 1 / 64, 1 / 4096, 64
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)


def chunk_bounds(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every chunk of a slice. Line ends belong to no chunk. A long text goes in runs of whole lines."""
    n = len(s.raw)
    if s.n > 1 or n <= 2 * SLICE_BYTES:
        return _bounds(s)
    line_ends = np.flatnonzero(s.raw == 0x0A) + 1
    wanted = np.searchsorted(line_ends, np.arange(SLICE_BYTES, n, SLICE_BYTES))
    cuts = np.unique(np.concatenate([[0], line_ends[wanted[wanted < len(line_ends)]], [n]]))
    parts = [_bounds(Slice(s.first, 1, s.raw[a:b], s.low[a:b], np.array([0, b - a]))) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return tuple(np.concatenate([part[k] + a for part, a in zip(parts, cuts.tolist())]) for k in (0, 1))


def _bounds(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    n = len(s.raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = GEAR[s.raw]
    for j in (1, 2, 4, 8):  # after these, h is the rolling hash h = 2 h + gear(byte) of 16 bits: it knows 16 bytes
        moved = h.copy()
        moved[j:] += h[:-j] << np.uint16(j)
        h = moved
    line_end = s.raw == 0x0A
    middle = (s.raw & 0xC0) == 0x80  # a cut stands before a byte that begins a character
    # Starts of lines; the hash is used only where all of its bytes, and those of the hashes it is compared with, lie in the line.
    new_line = np.zeros(n + 1, bool)
    new_line[s.offsets] = True
    new_line[1:][line_end] = True
    starts = np.flatnonzero(new_line[:n])
    since = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    fit = (since >= REACH + PERIOD - 1) & ~line_end
    fit[:-1] &= ~middle[1:]
    for j in range(1, PERIOD + 1):  # a run of one byte or of a few would be cut at every turn
        fit[j:] &= h[j:] != h[:-j]
    low = np.where(fit, h, np.int64(65536)) << 32 | (n - np.arange(n))
    width = 1
    while width < min(WINDOW, n):  # the smallest of the hashes from each byte on
        step = min(width, WINDOW - width, n - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    # Windows that lie in one line: those whose last byte is as far from the line's start as their length says.
    low = low[(since[: len(low)] >= REACH + PERIOD - 1) & (since[width - 1 :] - since[: len(low)] == width - 1)] if width == WINDOW else low[:0]
    cut = np.zeros(n + 1, bool)
    cut[n - (low[low < 65536 << 32] & 0xFFFFFFFF) + 1] = True
    cut |= new_line
    cut[:n] |= line_end
    cut[n] = True
    at = np.flatnonzero(cut)
    a, b = at[:-1], at[1:]
    longest = int((b - a).max()) if len(a) else 0
    if longest > MAX_CHUNK:
        times = (b - a + MAX_CHUNK - 1) // MAX_CHUNK
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        a2 = np.repeat(a, times) + step * MAX_CHUNK
        for _ in range(3):
            a2 -= middle[a2]
        b2 = np.append(a2[1:], 0)
        last = np.cumsum(times) - 1
        b2[last] = b
        a, b = a2, b2
    real = ~line_end[a] & (b > a)
    return a[real], b[real]


def chunks(docs: DataFrame, hot: frozenset[int] = frozenset()) -> DataFrame:
    """(doc_id, text_hash, d1, tail, spot, salt): every chunk of every text.

    The digest is d1 and the upper half of ``tail``, whose lower half numbers the chunks of a text. ``spot``: start, length and words
    (offsets in bytes). Several numbers in one keep the rows of the shuffle narrow. ``salt`` is 0 but for chunks whose d1 is hot.
    """
    spread = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_slices(batch.column(2)):
                a, b = chunk_bounds(s)
                data, digest = s.raw.tobytes(), xxhash.xxh3_128_digest
                d = np.frombuffer(b"".join([digest(data[i:j]) for i, j in zip(a.tolist(), b.tolist())]), np.int64).reshape(-1, 2)
                ink = np.zeros(len(s.raw) + 1, bool)
                ink[1:] = INK_BYTES[s.raw]
                ink[s.offsets[:-1][s.offsets[:-1] < len(s.raw)]] = False
                sums = np.zeros(len(s.raw) + 1, np.int32)
                np.cumsum(ink[1:] & ~ink[:-1], out=sums[1:])
                owner = np.searchsorted(s.offsets, a, "right") - 1
                rows = pa.array(owner + s.first)
                number = np.arange(len(a)) - np.searchsorted(owner, owner)
                spot = (a - s.offsets[owner]) << 24 | (b - a) << 12 | (sums[b] - sums[a])
                hashes = batch.column(1).take(rows)
                salt = np.where(np.isin(d[:, 0], spread), 1 + ((hashes.to_numpy() ^ number) & 0x7FFFFFFF) % SALTS, 0) if len(spread) else np.zeros(len(a), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), hashes, pa.array(d[:, 0].copy()), pa.array(d[:, 1] & ~np.int64(0xFFFFFFFF) | number), pa.array(spot), pa.array(salt.astype(np.int32))],
                    ["doc_id", "text_hash", "d1", "tail", "spot", "salt"],
                )

    kind = docs.select("doc_id").schema.fields[0].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, text_hash long, d1 long, tail long, spot long, salt int")


def hot_digests(docs: DataFrame) -> frozenset[int]:
    """First halves of the digests that make up HOT_SHARE of the chunks of a sample: at most 1 / HOT_SHARE numbers."""
    counts = stage_table(chunks(docs.where(F.rand(7) < SAMPLE)).groupBy("d1").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r.d1 for r in counts.where((F.col("n") > 1) & (F.col("n") >= total * HOT_SHARE)).select("d1").collect())


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, span_start, span_end, n_words, n_chunks, first_doc_ids): passages whose chunks an earlier document holds.

    Offsets are bytes of the UTF-8 text. ``first_doc_ids``: the smallest holders of the span's chunks, sorted and distinct.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = chunks(docs, hot_digests(docs)).repartition(parts, "d1", "salt").withColumn("d2", F.shiftright("tail", 32).cast("int"))
    nameless = F.when(F.col("doc_id").isNull(), F.col("text_hash"))
    own = Window.partitionBy("d1", "salt", "d2")
    # One row for each hot digest, and one for all others, which meets nothing. Both readings take all columns and no filter (and keys
    # that cannot be null, of which Spark makes one), as Spark would move either below the shuffle and then shuffle twice.
    hot = F.col("salt") > 0
    spread = met.groupBy(*[F.coalesce(F.when(hot, F.col(c)), F.lit(0)).alias(f"hot_{c}") for c in ("d1", "d2")]).agg(
        F.min("doc_id").alias("hot_first"), F.min(nameless).alias("hot_text"), F.min("spot").alias("hot_spot"))
    held = met.withColumns({"own_first": F.min("doc_id").over(own), "own_text": F.min(nameless).over(own)})
    held = held.join(F.broadcast(spread), hot & (F.col("d1") == F.col("hot_d1")) & (F.col("d2") == F.col("hot_d2")) & (F.col("hot_spot") >= 0), "left")
    first, first_text = (F.when(hot, F.col(f"hot_{c}")).otherwise(F.col(f"own_{c}")) for c in ("first", "text"))
    repeated = F.when(F.col("doc_id").isNotNull(), F.col("doc_id") != first).otherwise(first.isNotNull() | (F.col("text_hash") != first_text))
    # Distinct before the window: rows of one id and text count once, and many copies do not meet in one task.
    number = F.col("tail").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("number")
    one = held.where(repeated).select("doc_id", first.alias("first"), "text_hash", number, "spot").distinct()
    one = one.select(
        "doc_id", "first", "text_hash", "number", F.shiftright("spot", 24).cast("int").alias("start"),
        F.shiftright("spot", 12).bitwiseAND(4095).cast("int").alias("length"), F.col("spot").bitwiseAND(4095).cast("int").alias("words"),
    )
    order = Window.partitionBy("doc_id", "text_hash").orderBy("number")
    # Between chunks of consecutive numbers lie line ends at most, however many.
    opened = one.withColumn("opens", F.when(F.col("number") - F.lag("number").over(order) <= 1, 0).otherwise(1))
    spans = opened.withColumn("span", F.sum("opens").over(order)).groupBy("doc_id", "text_hash", "span").agg(
        F.min("start").alias("span_start"), F.max(F.col("start") + F.col("length")).alias("span_end"), F.sum("words").alias("n_words"),
        F.count("*").alias("n_chunks"), F.sort_array(F.collect_set("first")).alias("first_doc_ids"),
    )
    return spans.where(F.col("n_words") >= min_words).drop("span")


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without the bytes of the spans (in order, not overlapping)."""
    data = F.encode(text, "UTF-8")
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["end"]))
    starts = F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.octet_length(text)))
    return F.array_join(F.transform(ends, lambda e, i: F.decode(F.substring(data, e + 1, F.get(starts, i) - e), "UTF-8")), "")


def dedup_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without their repeated passages, ``n_chars`` counted anew; columns as given. A text may become empty."""
    spans = repeats(docs.select("doc_id", "text"), min_words).groupBy(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash")).agg(
        F.sort_array(F.collect_set(F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end")))).alias("spans")
    )
    mine = docs.select(F.struct("*").alias("doc"), F.xxhash64("text").alias("own_hash"))
    joined = mine.join(spans, F.col("doc.doc_id").eqNullSafe(F.col("cut_id")) & (F.col("own_hash") == F.col("cut_hash")), "left")
    text = F.when(F.col("spans").isNull(), F.col("doc.text")).otherwise(cut_spans(F.col("doc.text"), F.col("spans")))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return joined.select(*((changed[c] if c in changed else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
