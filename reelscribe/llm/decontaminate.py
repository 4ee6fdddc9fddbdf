"""Operator 3, benchmark decontamination by winnowing.

1. Texts and benchmark items become hashes of ``GRAM`` words; of every ``WINDOW - GRAM + 1`` hashes in a row the smallest is kept
   (the last of equal ones). Any ``WINDOW`` words that a text shares with an item contain the same run of hashes on both sides and
   so the same kept one: no shared window is lost.
2. A filter of fixed size (``FILTER_BITS``) over the items' hashes, summed up by Spark, is the only thing sent to all tasks; it
   lets few hashes of the texts pass and none of the items' be lost.
3. What passes is joined with the items' fingerprints and extended: all windows around a hit are compared word by word.
Items below ``WINDOW`` words are a window of their own and are sought by the hash of all their words, by the same filter and join.

Edge cases: a null text has no words; an item without words never occurs. Null item ids are one item, written as an empty string;
repeated items count once. Rows with a null id and repeated rows are judged like any other. Texts of any length are read whole, a slice of about a megabyte or one text at a time. Empty tables give no hits or no rows.
Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscribe.llm.common import WORD_BYTES, gram_hashes, inside_one_text, text_slices, with_row_number, word_hashes, word_spans
from reelscribe.session import stage_table

GRAM, WINDOW = 5, 10
RUN = WINDOW - GRAM + 1
FILTER_BITS = 1 << 24
CANDIDATE = pa.struct([("n", pa.int32()), ("h", pa.int64()), ("pos", pa.int32()), ("at", pa.int32()), ("words", pa.list_(pa.string()))])
CANDIDATE_DDL = "array<struct<n:int,h:bigint,pos:int,at:int,words:array<string>>>"


def _winnow(grams: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Positions of the kept hashes; ``valid``: whether a run of hashes that starts here lies in one text."""
    n = len(grams) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, RUN):
        other = grams[j : j + n]
        less = other <= best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at[valid[:n]])


def _passes(h: np.ndarray, sieve: np.ndarray | None) -> np.ndarray:
    if sieve is None:
        return np.ones(len(h), bool)
    out = np.ones(len(h), bool)
    for bits in (h, h >> np.uint64(32)):
        bits = bits & np.uint64(FILTER_BITS - 1)
        out &= (sieve[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) == 1
    return out


def _candidates(texts: pa.Array, sieve: np.ndarray | None, short: tuple[int, ...] | None) -> tuple[np.ndarray, list[list[dict]]]:
    """Number of words of every text, and its fingerprints that pass. ``short`` None: texts are items, short ones whole."""
    counts, found = np.zeros(len(texts), np.int64), [[] for _ in range(len(texts))]
    for s in text_slices(texts):
        starts, ends, first = word_spans(s, WORD_BYTES)
        per_text = np.diff(first)
        counts[s.first : s.first + s.n] = per_text
        if not len(starts):
            continue
        words = word_hashes(s.low, starts, ends)
        owner = np.repeat(np.arange(s.n), per_text)
        grams = gram_hashes(words, GRAM)
        kept = _winnow(grams, inside_one_text(first, WINDOW, len(words)))
        todo = [(WINDOW, grams[kept], kept)]
        for n in range(1, WINDOW) if short is None else short:
            at = np.flatnonzero(inside_one_text(first, n, len(words)))
            if short is None:
                at = at[per_text[owner[at]] == n]
            todo.append((n, gram_hashes(words, n)[at], at))
        for n, h, at in todo:
            ok = _passes(h, sieve)
            for value, pos in zip(h[ok].view(np.int64).tolist(), at[ok].tolist()):
                text = owner[pos]
                a, b = first[text], first[text + 1]
                lo, hi = (max(a, pos + GRAM - WINDOW), min(b, pos + WINDOW)) if n == WINDOW else (pos, pos + n)
                context = [s.low[starts[w] : ends[w]].tobytes().decode() for w in range(lo, hi)]
                found[s.first + text].append({"n": n, "h": value, "pos": pos - a, "at": lo - a, "words": context})
    return counts, found


def _fingerprints(df: DataFrame, key: list[str], sieve=None, short: tuple[int, ...] | None = None) -> DataFrame:
    """The key columns, ``n_words`` and ``found``, one row for each row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = _candidates(batch.column(len(key)), None if sieve is None else sieve.value, short)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.array(counts), pa.array(found, pa.list_(CANDIDATE))], [*key, "n_words", "found"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*key).schema.fields)
    return df.select(*key, "text").mapInArrow(run, f"{fields}, n_words long, found {CANDIDATE_DDL}")


def _sieve(items: DataFrame) -> np.ndarray:
    """Bits of all fingerprints: at most FILTER_BITS / 64 words come to the driver, whatever the size of the benchmark."""
    bits = items.select(F.explode(F.array(F.col("h"), F.shiftright("h", 32))).alias("b")).select(F.col("b").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("b"))
    words = bits.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    sieve = np.zeros(FILTER_BITS // 64, np.int64)
    rows = words.toPandas()
    sieve[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64)
    return sieve.view(np.uint64)


def _union_length(spans):
    """Words covered by (start, end) spans in order of their starts."""
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).alias("n")),
    )
    return step["n"]


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, spans (of hit words), n_hit and items (ids as sorted strings)."""
    spark = docs.sparkSession
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    items = stage_table(_fingerprints(named, ["item"]).select("item", F.explode("found").alias("i")).select("item", "i.*").distinct())
    short = tuple(sorted(r.n for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect()))  # at most WINDOW - 1 numbers
    sieve = spark.sparkContext.broadcast(_sieve(items))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    prints = with_row_number(stage_table(_fingerprints(keyed, ["doc_id", "text_hash"], sieve, short)), "row_no")

    mine = prints.select("row_no", F.explode("found").alias("d")).select("row_no", "d.*")
    theirs = items.select("item", "n", "h", F.col("pos").alias("item_pos"), F.col("at").alias("item_at"), F.col("words").alias("item_words"))
    met = mine.join(theirs, ["n", "h"])
    shift = F.col("pos") - F.col("item_pos")

    def equal(s):
        # slice() is null beyond the words that the context holds only by its length, so lengths are compared first.
        a, b = s - F.col("at"), s - shift - F.col("item_at")
        held = (a >= 0) & (b >= 0) & (a + F.col("n") <= F.size("words")) & (b + F.col("n") <= F.size("item_words"))
        return F.when(held, F.slice("words", F.greatest(a, F.lit(0)) + 1, F.col("n")) == F.slice("item_words", F.greatest(b, F.lit(0)) + 1, F.col("n"))).otherwise(False)

    begin = F.when(F.col("n") == WINDOW, F.sequence(F.col("pos") - (WINDOW - GRAM), F.col("pos"))).otherwise(F.array(F.col("pos")))
    hits = met.select("row_no", "item", "n", F.explode(F.filter(begin, equal)).alias("start"))
    by_doc = hits.groupBy("row_no").agg(
        F.sort_array(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("n")).alias("end")))).alias("spans"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    return prints.select("row_no", "doc_id", "text_hash", "n_words").join(by_doc, "row_no", "left").select(
        "doc_id", "text_hash", "n_words", "spans", F.coalesce(_union_length(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of an item; columns as given."""
    bad = find_contamination(docs.select("doc_id", "text"), benchmark).where("n_hit > 0").select(F.col("doc_id").alias("bad_id"), "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(F.col("bad_id")) & (F.xxhash64(docs["text"]) == F.col("text_hash"))
    return docs.join(bad, same, "left_anti")
