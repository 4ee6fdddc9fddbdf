"""Operator 5, language identification with bit-sliced Bloom filters of n-grams.

Slot s of the table holds one bit per language: whether the filter of that language has slot s set. The bits of the ``HASHES``
slots of an n-gram, and-ed together, are all languages that hold it, found in one look-up. Per-language counts of a text's n-grams
are corrected for the false positives of each filter (its fill to the power of ``HASHES``), and the largest share decides.

All training documents count: n-grams are counted per language by Spark, and an n-gram enters the filters of the languages in which
it is at least ``SHARE`` as frequent as where it is most frequent and makes up ``LEAST`` of the language's n-grams: rarer ones, mostly slips of
single documents, would fill the filters; a share, so that the rule is the same for a large and a small language or corpus. The table has ``SLOTS`` slots for every 64 languages, whatever
the corpus; that is all that comes to the driver and goes to the tasks.

Folds: crc32 of the id as text, modulo ``FOLDS``; remainder ``HELD_OUT`` and null ids are never learned from, nor are null
languages. Edge cases: a text that is null or has no letter is ``und`` with score 0; a text with letters but no known n-gram gets the language with
most training documents and score 0; ties go to the first language in alphabetical order. Without training rows everything is
``und``. Texts of any length count whole, a slice of some megabytes or one text at a time. Repeated rows are alike; an empty table gives no rows. Only id, text and language are read, the last one for learning only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelscribe.llm.common import Slice, mix, text_slices
from reelscribe.llm.quality_model import held_out

FOLDS, HELD_OUT = 3, 1
GRAM, HASHES, SLOTS, SHARE, LEAST = 4, 3, 1 << 20, 0.25, 1e-6
LETTER = np.isin(np.arange(256), list(range(0x61, 0x7B))) | (np.arange(256) >= 0x80)


def _grams(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a slice (four bytes each, whatever is no letter as a blank) and the text of each. Texts stand between blanks."""
    owner = np.repeat(np.arange(s.n), np.diff(s.offsets) + 1)  # each text with a blank before it, which also ends the one before
    plain = np.full(len(s.low) + s.n + 3, 0x20, np.uint32)
    letters = LETTER[s.low]
    plain[np.arange(len(s.low)) + np.repeat(np.arange(s.n), np.diff(s.offsets)) + 1] = np.where(letters, s.low, np.uint8(0x20))
    n = len(owner)
    gram = plain[:n].copy()
    for j in range(1, GRAM):
        gram |= plain[j : j + n] << np.uint32(8 * j)
    some = np.append(0, np.cumsum(plain != 0x20))
    last = np.append(owner, [s.n] * GRAM)[GRAM - 1 : GRAM - 1 + n]
    heads = np.zeros(n + GRAM, bool)
    heads[s.offsets[:-1] + np.arange(s.n)] = True
    heads[n] = True  # the blank after the last text
    # Fewer than two letters' bytes say little and are in every language.
    real = ((owner == last) | (owner + 1 == last) & heads[GRAM - 1 : GRAM - 1 + n]) & (some[GRAM : GRAM + n] - some[:n] >= 2)
    return gram[real], owner[real]


def _slots(gram: np.ndarray) -> list[np.ndarray]:
    h = mix(gram.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return [((h >> np.uint64(20 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, codes = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            for s in text_slices(batch.column(1), 1 << 22):
                gram, owner = _grams(s)
                key, n = np.unique(gram.astype(np.int64) | codes[s.first + owner].astype(np.int64) << 32, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[key >> 32], pa.string()), pa.array(key & 0xFFFFFFFF), pa.array(n)], ["lang", "gram", "n"])

    train = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    return train.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray, int]:
    """The languages, the table (slot, word of 64 languages) and the number of the commonest language."""
    train = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(sizes)
    table = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), np.uint64)
    if not languages:
        return languages, table, 0
    numbered = docs.sparkSession.createDataFrame(list(enumerate(languages)), "number int, lang string")
    counts = _counts(docs).join(F.broadcast(numbered), "lang").select("number", "gram", "n")
    of_gram = Window.partitionBy("gram")
    totals = counts.groupBy("number").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "number").withColumn("share", F.col("n") / F.col("total"))
    held = shares.withColumn("most", F.max("share").over(of_gram)).where((F.col("share") >= SHARE * F.col("most")) & (F.col("share") >= LEAST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.array(batch.column(0)).astype(np.int64)
            bits = np.uint64(1) << (number % 64).astype(np.uint64)
            for slot in _slots(np.array(batch.column(1))):
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((number // 64).astype(np.int32)), pa.array(bits.view(np.int64))], ["slot", "word", "bits"])

    rows = held.select("number", "gram").mapInArrow(run, "slot long, word int, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table[np.array(rows.column("slot")), np.array(rows.column("word"))] = np.array(rows.column("bits")).view(np.uint64)
    return languages, table, max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i))


def _has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def predict(texts: pa.Array, languages: list[str], table: np.ndarray, commonest: int) -> tuple[list[str], np.ndarray]:
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not languages:
        return names, scores
    fill = [float(((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** HASHES for i in range(len(languages))]
    for s in text_slices(texts):
        gram, owner = _grams(s)
        slots = _slots(gram)
        first = np.searchsorted(owner, np.arange(s.n + 1))
        total = np.diff(first)
        share = np.zeros((s.n, len(languages)))
        for word in range(table.shape[1]):
            column = np.ascontiguousarray(table[:, word])
            mask = column[slots[0]]
            for slot in slots[1:]:
                mask &= column[slot]
            for i in range(64 * word, min(len(languages), 64 * word + 64)):
                hits = np.diff(np.append(0, np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1)))[first].astype(np.int64))
                share[:, i] = np.maximum(0, (hits / np.maximum(total, 1) - fill[i]) / max(1e-9, 1 - fill[i]))
        ascii_letters = np.diff(np.append(0, np.cumsum((s.low >= 0x61) & (s.low <= 0x7A)))[s.offsets]) > 0
        for row in range(s.n):
            if not ascii_letters[row] and not _has_letter(texts[s.first + row].as_py()):
                continue
            best = int(share[row].argmax())
            known = share[row, best] > 0
            names[s.first + row] = languages[best if known else commonest]
            scores[s.first + row] = share[row, best] / share[row].sum() if known else 0.0
    return names, scores


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch.column(1), *model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    kind = docs.select("doc_id").schema.fields[0].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")
