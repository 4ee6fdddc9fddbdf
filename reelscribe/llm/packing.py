"""Operator 9, best-fit packing: documents fill bins of ``CAPACITY`` words, and none shares a bin with one of its own kind.

A bin holds at most one document of a source and at most one of a cluster of duplicates. Documents are cut at the capacity; full
pieces are bins of their own, and only the rests are packed. A document is known by its id, source, text hash and, among rows that
share these, the number of its copy, so the packing does not depend on how the table lies in files. Rests are dealt by a hash of these into shards of about
``SHARD_ROWS`` rows, so a hot source or a large cluster spreads over all shards, and each shard is packed by best-fit decreasing:
open bins are kept in order of their residual and carry bitmaps of sources and clusters; the search starts at the first bin that
is large enough and goes on to its successors until a bin is compatible. That is the tightest compatible one; if there is
none, a bin is opened. The conflicts hold over all shards, as a bin never spans two.

Edge cases: a document without words (null, empty, blank) needs no room: its row has no bin. A null source conflicts with
nothing, nor does a null cluster. Rows with null ids and repeated rows are packed like any other (repeated rows have one cluster
and so never share a bin). Equal sizes go in the order of id (nulls first), source, text hash and copy. Texts are only counted, however long, a
slice of about a megabyte or one text at a time. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscribe.llm.common import INK_BYTES, text_slices, word_spans
from reelscribe.session import stage_table

CAPACITY, SHARD_ROWS = 2048, 4096


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, cluster, n_words): a cluster is a text, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for s in text_slices(batch.column(3)):
                n[s.first : s.first + s.n] = np.diff(word_spans(s, INK_BYTES)[2])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n)], ["doc_id", "source", "cluster", "n_words"])

    keyed = docs.select("doc_id", "source", F.xxhash64("text").alias("cluster"), "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields[:3])
    return keyed.mapInArrow(run, f"{kinds}, n_words long")


def numbered_copies(counted: DataFrame, run: int = 4096) -> DataFrame:
    """The rows with ``copy``, a number among equal rows. Equal rows are counted and dealt out again in runs, so many copies are no task's work alone."""
    equal = counted.groupBy(*counted.columns).agg(F.count("*").alias("n"))
    runs = equal.select(*counted.columns, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(run).cast("long"))).alias("at"))
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartition(parts, "doc_id", "cluster", "at")
    return dealt.select(*counted.columns, F.explode(F.sequence("at", F.least(F.col("at") + run, F.col("n")) - 1)).alias("copy"))


def _bits(values: list) -> list[int]:
    """One bit for every value that occurs twice or more, none for others and for null: only repeated values can conflict."""
    counts = pd.Series(values, dtype=object).value_counts()
    bit = {v: 1 << i for i, v in enumerate(counts.index[counts > 1])}
    return [0 if v is None else bit.get(v, 0) for v in values]


def pack(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin of every item, in the order given."""
    source_bit, cluster_bit = _bits(sources), _bits(clusters)
    open_bins: list[tuple[int, int]] = []
    source_map: list[int] = []
    cluster_map: list[int] = []
    out = []
    for size, s, c in zip(sizes, source_bit, cluster_bit):
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (source_map[open_bins[at][1]] & s or cluster_map[open_bins[at][1]] & c):
            at += 1
        if at < len(open_bins):
            room, number = open_bins.pop(at)
            source_map[number] |= s
            cluster_map[number] |= c
        else:
            room, number = capacity, len(source_map)
            source_map.append(s)
            cluster_map.append(c)
        if room > size:
            insort(open_bins, (room - size, number))
        out.append(number)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each piece: doc_id, source, piece, first_word, n_words, bin_id and bin_words (words in the bin)."""
    counted = stage_table(numbered_copies(word_counts(docs)))
    pieces = F.expr(f"cast(n_words div {capacity} as int)")
    rest = F.col("n_words") % capacity
    name = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lower(F.hex("cluster")), F.lower(F.hex(F.xxhash64("source"))), "copy")

    whole = counted.where(pieces > 0).select("*", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece")).select(
        "doc_id", "source", "piece", (F.col("piece").cast("long") * capacity).alias("first_word"), F.lit(capacity).cast("long").alias("n_words"),
        F.concat_ws("-", F.lit("whole"), name, "piece").alias("bin_id"), F.lit(capacity).cast("long").alias("bin_words"),
    )
    blank = counted.where("n_words = 0").select(
        "doc_id", "source", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_words"),
    )
    rests = counted.where(rest > 0).select("doc_id", "source", "cluster", "copy", pieces.alias("piece"), (pieces.cast("long") * capacity).alias("first_word"), rest.alias("n_words"))
    shards = max(1, -(-rests.count() // shard_rows))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "doc_id", "source", "cluster", "copy"], ascending=[False, True, True, True, True], kind="stable", na_position="first")
        null = rows["source"].isna()
        number = pack(rows["n_words"].tolist(), rows["source"].astype(object).where(~null, None).tolist(), rows["cluster"].tolist(), capacity)
        rows["bin_words"] = rows["n_words"].groupby(np.array(number)).transform("sum")
        rows["bin_id"] = [f"shared-{key[0]}-{n}" for n in number]
        return rows[["doc_id", "source", "piece", "first_word", "n_words", "bin_id", "bin_words"]]

    packed = rests.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster", "copy"), F.lit(shards))).groupBy("shard").applyInPandas(fill, whole.schema)
    return whole.union(packed).union(blank)
