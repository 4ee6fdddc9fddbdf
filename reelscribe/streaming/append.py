"""Increments from a file stream, appended once each, with ids that go on from batch to batch.

Every micro-batch is one call of the batch operators inside ``foreachBatch``. The target is a folder of
Parquet with one sub-folder per stream and batch, written with overwrite, so a batch that runs again after
a lost driver replaces its own rows and no other stream's. Keys that the stream has seen are state of the stream,
kept by Spark with its checkpoint: a late or repeated row is dropped without reading what is already written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from reelscribe.operators import incremental as inc
from reelscribe.operators import timeline as tl

MARK = "stream string, batch long, first_number long, next_number long"


@dataclass(frozen=True)
class Ids:
    """Ids of appended rows (I2): ``prefix`` and consecutive numbers from ``first``, in the order of ``line`` within a batch."""

    line: tl.Timeline
    part_order: str
    first: int = 1
    prefix: str = "T"
    name: str = "segment_id"


def read_increments(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def marks(spark: SparkSession, target: str) -> DataFrame:
    """One row per batch: the numbers it has been given. An underscore keeps the folder out of the table."""
    spark.createDataFrame([], MARK).write.mode("ignore").json(f"{target}/_numbers/none")
    return spark.read.schema(MARK).option("recursiveFileLookup", "true").json(f"{target}/_numbers")


def first_number(spark: SparkSession, target: str, stream: str, batch_id: int, first: int) -> int:
    """The high-water mark that the batch starts from: that of its stream's earlier batches, or of the streams before it.

    A batch's own mark is never read, so a batch that runs again starts from the same number.
    """
    known = marks(spark, target)
    own = known.filter((F.col("stream") == stream) & (F.col("batch") < batch_id))
    earlier = own.agg(F.max("next_number")).first()[0]
    if earlier is None:
        earlier = known.filter(F.col("stream") != stream).agg(F.max("next_number")).first()[0]
    return first if earlier is None else earlier


def append_increment_stream(increments: DataFrame, target: str, checkpoint: str, keys: Sequence[str],
                            transform: Callable[[DataFrame], DataFrame] | None = None, order: Sequence[str] | None = None,
                            ids: Ids | None = None) -> StreamingQuery:
    """Start the stream; it stops when all files present have been read.

    Rows with an equal key (nulls are equal) are repeats: the one that comes first is appended, in the same batch any of them. Where such rows differ, ``order``
    says which one of a batch stays; keys are then compared with those of the stream's own folders instead of the state.
    Rows of other streams of the target are always compared, within the batch's range of the first key, so files that hold no such key are
    skipped by their statistics. Streams with ``ids`` must follow each other, as they share one sequence of numbers; the number
    that a batch ends with is written beside its rows, before Spark counts the batch as done.
    """
    schema = increments.schema
    known = T.StructType([*[schema[k] for k in keys], T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())])
    # An empty folder, so that the first batch finds a table to compare with.
    increments.sparkSession.createDataFrame([], schema).write.mode("ignore").parquet(f"{target}/stream=none/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The id that Spark keeps in the checkpoint: batch numbers start anew with a new checkpoint, ids do not.
        stream = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
        seen = spark.read.schema(known).parquet(target)
        other = F.col("stream") != stream
        seen = seen.filter(other if order is None else other | (F.col("batch") != batch_id))
        rows = batch
        if order is not None:
            rows = rows.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("_row")).select("_row.*")
        if not seen.isEmpty():
            low, high = batch.agg(F.min(keys[0]), F.max(keys[0])).first()
            near = F.col(keys[0]).isNull() if low is None else F.col(keys[0]).isNull() | F.col(keys[0]).between(low, high)
            rows = tl.join_parts(rows, seen.filter(near).select(*keys), keys, "left_anti")
        rows = transform(rows) if transform else rows
        place = f"{target}/stream={stream}/batch={batch_id}"
        if ids is None:
            rows.write.mode("overwrite").parquet(place)
            return
        first = first_number(spark, target, stream, batch_id, ids.first)
        inc.append_increment(rows, ids.line, ids.part_order, first, ids.prefix, ids.name).write.mode("overwrite").parquet(place)
        commit_numbers(spark, target, stream, batch_id, first, first + spark.read.parquet(place).count())

    kept = increments if order is not None else increments.dropDuplicates(list(keys))
    return kept.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def commit_numbers(spark: SparkSession, target: str, stream: str, batch_id: int, first: int, following: int) -> None:
    spark.createDataFrame([(stream, batch_id, first, following)], MARK).coalesce(1).write.mode("overwrite").json(f"{target}/_numbers/{stream}/{batch_id}")
