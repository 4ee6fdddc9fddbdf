"""Operator 12, sharding by jump consistent hashing: the document's id and the number of shards decide, no table of a ring is kept.

The id becomes a 64-bit key; from it a row of growing numbers is drawn, and the last one below the number of shards is the shard.
One more shard draws one number more, so a document either stays or goes to the new shard: the fewest moves that keep the shards even.

Slots number the rows of a shard without gaps, in order of id (null ids first), checksum and size. Rows are dealt over the tasks by ranges
of that order with the row's number last, so a shard, a hot id or a group of repeated rows spreads over many tasks; a task's
first slot is the sum of the counts before it. Nothing but these counts, one for each task and shard, is summed up.

Edge cases: a null id is a key of its own (that of 0). A null text counts as an empty one: size 1, checksum 0. Repeated rows go to one shard and
have slots of their own; equal rows may swap slots, which no row shows. Texts are only measured, however long. An empty table gives no rows.
Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from reelscribe.llm.common import mix, with_row_number
from reelscribe.session import stage_table

SHARDS = 8
#: Fixed value: the multiplier of the generator that jump consistent hashing draws from.
STEP = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every key (unsigned 64-bit)."""
    state, at, ahead = keys.copy(), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        at[todo] = ahead[todo]
        state[todo] = state[todo] * np.uint64(STEP) + np.uint64(1)
        drawn = (state[todo] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[todo] = ((at[todo] + 1) * (float(1 << 31) / drawn)).astype(np.int64)
        todo = todo[ahead[todo] < shards]
    return at


def key_of(docs: DataFrame) -> Column:
    """The id as a long; ids of other kinds by their hash."""
    whole = isinstance(docs.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType))
    return F.coalesce(F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.lit(0).cast("long"))


def with_shards(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``shard`` and ``grown_shard`` in place of their last column, the key."""
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = mix(batch.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            placed = [pa.array(jump(keys, n).astype(np.int32)) for n in (shards, shards + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *placed], [*names, "shard", "grown_shard"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}shard int, grown_shard int")


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size")
    checksum = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    measured = docs.select("doc_id", size, checksum, key_of(docs).alias("key"))
    placed = with_row_number(stage_table(with_shards(measured, shards)), "row_no")
    order = ["shard", "doc_id", "text_crc32", "size", "row_no"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    lined = with_row_number(stage_table(ranged.drop("row_no").withColumn("run", F.spark_partition_id())), "line_no")
    # Lines of a run and shard are consecutive numbers.
    runs = lined.groupBy("run", "shard").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")
    starts = runs.select("run", "shard", (before - F.col("first_line")).alias("shift"))
    return lined.join(starts, ["run", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("line_no") + F.col("shift")).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, column: str = "shard") -> None:
    """The documents as Parquet, a folder for each shard; each task writes its own rows, nothing is shuffled."""
    name = column
    while name in docs.columns:
        name += "_"
    keyed = docs.select(F.struct("*").alias("doc"), key_of(docs).alias("key"))
    with_shards(keyed, shards).select("doc.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
