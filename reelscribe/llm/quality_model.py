"""Operator 6, quality classifier: histogram gradient-boosted trees over document statistics.

The labelled sample is bounded: at most ``SAMPLE_ROWS`` documents of the training folds, those with the smallest hash of their id.
Only their statistics (``STATISTICS`` numbers each) reach the driver, where the trees are fitted; the flattened arrays go to every
task and score all documents, whole texts, in Arrow batches.

Folds: crc32 of the id as text, modulo ``FOLDS``; remainder ``HELD_OUT`` is never learned from, nor is a null id (it counts as
held out). Labels that are null, contradict each other for one id or have no document teach nothing. Edge cases: a null or empty
text has statistics of zero and is scored; repeated rows are scored alike, and documents with equal statistics tie; without any label every
score is 0.5. Texts of any length count whole, a slice of about a megabyte or one text at a time. Labels, language, source and id are no inputs. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscribe.llm.boosting import Trees, fit_trees
from reelscribe.llm.common import INK_BYTES, text_slices, word_hashes, word_spans

SAMPLE_ROWS, FOLDS, HELD_OUT, THRESHOLD = 12_000, 5, 0, 0.3
STATISTICS = 24
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
MARK = np.isin(np.arange(256), list(b".,;:!?\"'()-"))
END = np.isin(np.arange(256), list(b".!?"))
DIGIT = np.isin(np.arange(256), list(b"0123456789"))
UPPER = np.isin(np.arange(256), list(range(0x41, 0x5B)))
CLASSES = (SYMBOL, MARK, END, DIGIT, UPPER, np.arange(256) >= 0x80, np.arange(256) == 0x7C, np.arange(256) == 0x0A, np.isin(np.arange(256), list(b"{}[]<>/\\=_@")))


def _repeats(hashes: np.ndarray) -> tuple[float, float]:
    """Share of the values that occurred before, and share of the commonest one."""
    if not len(hashes):
        return 0.0, 0.0
    _, n = np.unique(hashes, return_counts=True)
    return 1 - len(n) / len(hashes), n.max() / len(hashes)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` numbers for each text, from the whole text."""
    out = np.zeros((len(texts), STATISTICS))
    for s in text_slices(texts):
        starts, ends, first = word_spans(s, INK_BYTES)
        hashes = word_hashes(s.low, starts, ends)
        size = np.diff(s.offsets)
        some = np.maximum(size, 1)
        rows = out[s.first : s.first + s.n]
        n_words = np.diff(first)
        for k, members in enumerate(CLASSES):
            sums = np.zeros(len(s.raw) + 1, np.int64)
            np.cumsum(members[s.raw], out=sums[1:])
            rows[:, k] = np.diff(sums[s.offsets]) / some
        k = len(CLASSES)
        rows[:, k] = np.log1p(size)
        rows[:, k + 1] = np.log1p(n_words)
        word_sums = np.append(0, np.cumsum(ends - starts))
        word_squares = np.append(0, np.cumsum((ends - starts) ** 2))
        per = np.maximum(n_words, 1)
        rows[:, k + 2] = np.diff(word_sums[first]) / per
        rows[:, k + 3] = np.sqrt(np.maximum(0, np.diff(word_squares[first]) / per - rows[:, k + 2] ** 2))
        closed = np.append(0, np.cumsum(END[s.raw[ends - 1]])) if len(ends) else np.zeros(1, np.int64)
        odd = np.append(0, np.cumsum(SYMBOL[s.raw[ends - 1]])) if len(ends) else np.zeros(1, np.int64)
        rows[:, k + 4] = np.diff(closed[first]) / per
        rows[:, k + 5] = np.diff(odd[first]) / per
        same = np.append(0, np.cumsum(np.append(False, hashes[1:] == hashes[:-1]))) if len(hashes) else np.zeros(1, np.int64)
        rows[:, k + 6] = np.diff(same[first]) / per
        for i in range(s.n):
            h = hashes[first[i] : first[i + 1]]
            rows[i, k + 7], rows[i, k + 8] = _repeats(h)
            pairs = h[1:] * np.uint64(3) + h[:-1]
            rows[i, k + 9], rows[i, k + 10] = _repeats(pairs)
            lines = s.low[s.offsets[i] : s.offsets[i + 1]].tobytes().split(b"\n")
            rows[i, k + 11] = 1 - len(set(lines)) / len(lines)
            rows[i, k + 12] = sum(x.rstrip().endswith((b".", b"!", b"?", b'"')) for x in lines) / len(lines)
            rows[i, k + 13] = np.log1p(max(map(len, lines)))
            rows[i, k + 14] = sum(len(x) < 40 for x in lines) / len(lines)
    return out


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def held_out(doc_id: Column, folds: int, out: int) -> Column:
    """Whether a document is never learned from."""
    return F.coalesce(fold_of(doc_id, folds) == out, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, out: int, rows: int) -> DataFrame:
    """(chosen_id, y, text) of at most ``rows`` labelled documents of the training folds, chosen by the hash of their id."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"), folds, out)).groupBy("doc_id")
    known = known.agg(F.min(label).alias("y"), F.max(label).alias("other")).where("y = other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("chosen_id"), F.col("y").cast("int"))
    # At most ``rows`` ids: the bound of the sample is the bound of the broadcast.
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id")).select("chosen_id", "y", "text")


def sample_rows(sample: DataFrame, measure, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The measures of the sample and its labels, on the driver: one row for each id (the smallest of repeated ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.FixedSizeListArray.from_arrays(pa.array(measure(batch).ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], ["chosen_id", "y", "x"])

    kind = sample.select("chosen_id").schema.fields[0].dataType.simpleString()
    got = sample.mapInArrow(run, f"chosen_id {kind}, y int, x array<double>").groupBy("chosen_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toArrow()
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(-1, width)
    order = np.lexsort(np.column_stack([x, got.column("y")]).T)  # the same order whatever task came first
    return x[order], np.array(got.column("y"), np.float64)[order]


def score_documents(docs: DataFrame, score) -> DataFrame:
    """(doc_id, score): ``score`` maps an Arrow array of texts to numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)), pa.float64())], ["doc_id", "score"])

    kind = docs.select("doc_id").schema.fields[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, rows)
    return fit_trees(*sample_rows(sample, lambda batch: statistics(batch.column(2)), STATISTICS))


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    trees = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))
    scored = score_documents(docs, lambda texts: trees.value.probability(statistics(texts)))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
