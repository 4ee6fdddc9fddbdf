"""Operator 4, toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities and strength of a lexicon, hits near a second-person word, capitals, punctuation, obfuscated words.
The lexicon is learned as hashes of words and of word beginnings, weighted by how much likelier they are in toxic documents, next
to a short fixed list. The labelled sample is bounded as in the quality classifier (``SAMPLE_ROWS`` documents); its tokens are counted by Spark
and at most ``LEXICON_ROWS`` of them come to the driver. Documents of the sample are measured with a lexicon learned from the other
parts of it (``PARTS``), so the trees see a lexicon as fresh as the one they meet later; the calibration is fitted on scores of
trees that have not seen the document.

Folds: crc32 of the id as text, modulo ``FOLDS``; remainder ``HELD_OUT`` and null ids are never learned from. Edge cases as in the
quality classifier: null and empty texts are scored, repeated rows alike, equal scores are equal, without labels every score is 0.5, an empty
table gives no rows. Texts of any length count whole, a slice of about a megabyte or one text at a time. Labels, language, source and id are no inputs; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscribe.llm.boosting import fit_isotonic, fit_trees
from reelscribe.llm.common import WORD_BYTES, Slice, text_slices, word_hashes, word_spans
from reelscribe.llm.quality_model import held_out, labelled_sample, sample_rows, score_documents
from reelscribe.session import stage_table

SAMPLE_ROWS, LEXICON_ROWS, PARTS = 12_000, 20_000, 3
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Byte lengths of word beginnings; whole words come besides.
BEGINNINGS = (4, 5, 6, 7)
MIN_TOXIC, NEAR, WEIGHT_CAP, STRONG = 3, 5, 6.0, 2.0
#: Plain insults and second-person words.
INSULTS = "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown dumb imbecile".split()
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie tú ti tus usted ustedes vosotros os".split()
#: Digits that stand for letters.
DISGUISE = dict(zip(b"0134578", b"oieastb"))
FEATURES = 16
LETTER = np.isin(np.arange(256), list(range(0x61, 0x7B))) | (np.arange(256) >= 0x80)
DIGIT = np.isin(np.arange(256), list(range(0x30, 0x3A)))
PLAIN = np.array([DISGUISE.get(b, b) for b in range(256)], np.uint8)


def _hashes_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    s = Slice(0, 1, data, data, np.array([0, len(data)]))
    return np.unique(word_hashes(data, *word_spans(s, WORD_BYTES)[:2]))


def _tokens(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words and of their beginnings (zero where a word is not longer than that)."""
    out = [word_hashes(low, starts, ends)]
    for length in BEGINNINGS:
        longer = ends - starts > length
        h = np.zeros(len(starts), np.uint64)
        h[longer] = word_hashes(low, starts[longer], starts[longer] + length) ^ np.uint64(length)
        out.append(h)
    return out


def _look_up(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], 0.0)


def features(texts: pa.Array, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of ``FEATURES`` numbers for each text, from the whole text."""
    insults, persons = _hashes_of(INSULTS), _hashes_of(SECOND_PERSON)
    out = np.zeros((len(texts), FEATURES))
    for s in text_slices(texts):
        starts, ends, first = word_spans(s, WORD_BYTES)
        rows, size, n_words = out[s.first : s.first + s.n], np.maximum(np.diff(s.offsets), 1), np.diff(first)
        per = np.maximum(n_words, 1)

        def per_byte(members: np.ndarray) -> np.ndarray:
            return np.diff(np.append(0, np.cumsum(members))[s.offsets]) / size

        def total(values: np.ndarray) -> np.ndarray:
            return np.diff(np.append(0, np.cumsum(values))[first])

        rows[:, 0] = np.log1p(n_words)
        upper = (s.raw >= 0x41) & (s.raw <= 0x5A)
        rows[:, 1] = per_byte(upper)
        rows[:, 2] = per_byte(s.raw == 0x21)
        rows[:, 3] = per_byte(s.raw == 0x3F)
        rows[:, 4] = per_byte(np.isin(s.raw, np.frombuffer(b"*#@$%&", np.uint8)))
        if not len(starts):
            continue
        tokens = _tokens(s.low, starts, ends)
        weight = np.zeros(len(starts))
        for h in tokens:
            weight = np.maximum(weight, _look_up(*lexicon, h))
        listed = np.isin(tokens[0], insults)
        # Words that mix letters and digits, read with letters in place of the digits.
        letters = np.append(0, np.cumsum(LETTER[s.low]))
        digits = np.append(0, np.cumsum(DIGIT[s.low]))
        mixed = (letters[ends] > letters[starts]) & (digits[ends] > digits[starts])
        disguised = np.zeros(len(starts), bool)
        if mixed.any():
            plain = word_hashes(PLAIN[s.low], starts[mixed], ends[mixed])
            disguised[mixed] = np.isin(plain, insults) | (_look_up(*lexicon, plain) > STRONG)
        capitals = np.append(0, np.cumsum(upper))
        shouted = (capitals[ends] - capitals[starts] == ends - starts) & (ends - starts > 2)
        hit = (weight > STRONG) | listed | disguised
        person = np.append(0, np.cumsum(np.isin(tokens[0], persons)))
        at = np.flatnonzero(hit)
        owner = np.searchsorted(first, at, "right") - 1
        close = person[np.minimum(at + NEAR + 1, first[owner + 1])] - person[np.maximum(at - NEAR, first[owner])]
        near = np.zeros(len(starts), bool)
        near[at] = close > 0
        rows[:, 6] = total(hit) / per
        rows[:, 7] = np.log1p(total(hit))
        rows[:, 8] = total(listed) / per
        rows[:, 9] = total(near) / per
        rows[:, 10] = total(np.isin(tokens[0], persons)) / per
        rows[:, 11] = total(mixed) / per
        rows[:, 12] = total(disguised)
        rows[:, 13] = total(shouted) / per
        some = n_words > 0
        rows[some, 5] = np.add.reduceat(weight, first[:-1][some]) / per[some]  # text by text, so that equal texts have equal sums
        rows[some, 14] = np.maximum.reduceat(weight, first[:-1][some])
        rows[:, 15] = np.log1p(total(listed))
    return out


def token_counts(sample: DataFrame) -> DataFrame:
    """(token, part, toxic, other): documents of each part of the sample that hold a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, part = np.array(batch.column(1)), np.array(batch.column(3))
            for s in text_slices(batch.column(2)):
                starts, ends, first = word_spans(s, WORD_BYTES)
                owner = np.repeat(np.arange(s.n), np.diff(first)) + s.first
                h = np.concatenate(_tokens(s.low, starts, ends)).view(np.int64)
                pairs = np.unique(np.stack([h, np.tile(owner, 1 + len(BEGINNINGS))]), axis=1)
                pairs = pairs[:, pairs[0] != 0]
                kind = part[pairs[1]] * 2 + y[pairs[1]]
                both, n = np.unique(np.stack([pairs[0], kind]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[0]), pa.array((both[1] // 2).astype(np.int32)), pa.array(np.where(both[1] % 2, n, 0)), pa.array(np.where(both[1] % 2, 0, n))], ["token", "part", "toxic", "other"]
                )

    counted = sample.select("chosen_id", "y", "text", "part").mapInArrow(run, "token long, part int, toxic long, other long")
    return counted.groupBy("token", "part").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn_lexica(sample: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """One lexicon without each part of the sample, and one of all of it: sorted hashes and their weights."""
    sizes = np.zeros((PARTS, 2))
    for r in sample.groupBy("part", "y").count().collect():
        sizes[r["part"], int(r["y"] > 0)] += r["count"]
    per_part = [F.sum(F.when(F.col("part") == p, F.col(c)).otherwise(0)).alias(f"{c}{p}") for c in ("toxic", "other") for p in range(PARTS)]
    all_toxic, all_other = sizes[:, 1].sum(), sizes[:, 0].sum()
    counts = token_counts(sample).groupBy("token").agg(*per_part, F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    likelier = counts.where((F.col("toxic") >= MIN_TOXIC) & (F.col("toxic") * F.lit(float(all_other)) > 4 * F.col("other") * F.lit(float(all_toxic))))
    top = likelier.orderBy(F.desc("toxic"), "token").limit(LEXICON_ROWS).toPandas().sort_values("token", key=lambda c: c.to_numpy(np.int64).view(np.uint64))
    keys = top["token"].to_numpy(np.int64).view(np.uint64)
    out = []
    for without in (*range(PARTS), None):
        use = [p for p in range(PARTS) if p != without]
        toxic, other = (top[[f"{c}{p}" for p in use]].to_numpy(np.float64).sum(1) for c in ("toxic", "other"))
        n_toxic, n_other = max(1.0, sizes[use, 1].sum()), max(1.0, sizes[use, 0].sum())
        weight = np.clip(np.log((toxic + 0.1) / n_toxic) - np.log((other + 0.5) / n_other), 0, WEIGHT_CAP)
        weight[toxic < 2] = 0
        out.append((keys, weight))
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS):
    """The lexicon, the trees and the calibration."""
    chosen = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, rows)
    sample = stage_table(chosen.select("chosen_id", "y", "text", F.pmod(F.xxhash64(F.lit(5), "chosen_id"), F.lit(PARTS)).cast("int").alias("part")))
    lexica = learn_lexica(sample)
    shared = docs.sparkSession.sparkContext.broadcast(lexica)

    def measure(batch: pa.RecordBatch) -> np.ndarray:
        part = np.array(batch.column(3))
        out = np.zeros((batch.num_rows, FEATURES + 1))
        for p in range(PARTS):
            mine = np.flatnonzero(part == p)
            out[mine, :FEATURES] = features(batch.column(2).take(pa.array(mine)), shared.value[p])
        out[:, FEATURES] = part
        return out

    x, y = sample_rows(sample, measure, FEATURES + 1)
    part, x = x[:, FEATURES], x[:, :FEATURES]
    unseen = np.zeros(len(x))
    for p in range(PARTS):
        unseen[part == p] = fit_trees(x[part != p], y[part != p]).probability(x[part == p])
    return lexica[-1], fit_trees(x, y), fit_isotonic(unseen, y)


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))

    def score(texts: pa.Array) -> np.ndarray:
        lexicon, trees, calibration = model.value
        return calibration(trees.probability(features(texts, lexicon)))

    scored = score_documents(docs, score)
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
