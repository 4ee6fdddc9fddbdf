"""Bulk export: caption files, text layers, manifests, the reader dataset.

A rendered part is a sequence of bounded chunks (``part_id``, ``chunk``, ``body``); joining the bodies
of a part in chunk order with the separator gives the whole file. No row holds an unbounded part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscribe.functions import values as vx
from reelscribe.operators import timeline as tl

CUES_PER_CHUNK = 4096


def _chunked(cues: DataFrame, separator: str, rows: int, position: str = "seq") -> DataFrame:
    chunk = F.floor(F.col(position) / rows).cast("long")
    return (cues.groupBy("part_id", chunk.alias("chunk"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, "cue"))),
                                          lambda s: s["cue"]), separator).alias("body")))


def render_srt(segments: DataFrame, text: str = "text_clean", rows: int = CUES_PER_CHUNK) -> DataFrame:
    """K2: numbered cues; numbers restart per part. ``seq`` must be the position in the part from 0.

    A row without times makes no cue: an untimed part is an empty file.
    """
    stamp = F.concat(vx.ms_to_timecode(F.col("start_ms"), ","), F.lit(" --> "), vx.ms_to_timecode(F.col("end_ms"), ","))
    cue = F.when(stamp.isNotNull(), F.concat_ws("\n", (F.col("seq") + 1).cast("string"), stamp, F.col(text)))
    return _chunked(segments.select("part_id", "seq", cue.alias("cue")), "\n\n", rows)


def render_vtt(segments: DataFrame, text: str = "text_clean", rows: int = CUES_PER_CHUNK) -> DataFrame:
    """K3: WEBVTT; the header opens chunk 0. A row without times makes no cue: an untimed part is its header only."""
    stamp = F.concat(vx.ms_to_timecode(F.col("start_ms")), F.lit(" --> "), vx.ms_to_timecode(F.col("end_ms")))
    cue = F.when(stamp.isNotNull(), F.concat_ws("\n", "segment_id", stamp, F.col(text)))
    body = _chunked(segments.select("part_id", "seq", cue.alias("cue")), "\n\n", rows)
    return body.withColumn("body", F.when(F.col("chunk") == 0, F.concat_ws("\n\n", F.lit("WEBVTT"), F.nullif(F.col("body"), F.lit("")))).otherwise(F.col("body")))


def render_txt(segments: DataFrame, text: str = "text_clean", rows: int = CUES_PER_CHUNK) -> DataFrame:
    """K4: ``[start - end] text`` lines."""
    cue = F.format_string("[%s - %s] %s", vx.ms_to_timecode(F.col("start_ms")), vx.ms_to_timecode(F.col("end_ms")), F.col(text))
    return _chunked(segments.select("part_id", "seq", cue.alias("cue")), "\n", rows)


def render_untimed(documents: DataFrame, text: str = "text_clean") -> DataFrame:
    """K4 for untimed rows."""
    return documents.select("part_id", F.lit(0).cast("long").alias("chunk"),
                            F.concat(F.lit("[UNTIMED] "), F.col(text)).alias("body"))


def _layout(df: DataFrame, order: Sequence[str], buckets: int | None) -> tuple[DataFrame, str]:
    """Rows placed for writing and the folder column: one folder per part, or ``buckets`` folders of parts.

    Folders per part suit some thousands of parts; a corpus of many millions wants buckets.
    """
    if buckets is None:
        placed, folder = df.withColumn("part", F.col("part_id")), "part"
    else:
        placed, folder = df.withColumn("bucket", F.pmod(F.xxhash64("part_id"), F.lit(buckets))), "bucket"
    return placed.repartitionByRange(folder, "part_id", *order).sortWithinPartitions(folder, "part_id", *order), folder


def write_chunks(chunks: DataFrame, path: str, separator: str = "\n\n", buckets: int | None = None) -> None:
    """Write rendered chunks: text files per part in chunk order, or a bucketed Parquet table of chunks."""
    placed, folder = _layout(chunks, ["chunk"], buckets)
    if buckets is None:
        placed.select(folder, F.col("body").alias("value")).write.mode("overwrite").partitionBy(folder).option("lineSep", separator).text(path)
    else:
        placed.write.mode("overwrite").partitionBy(folder).parquet(path)


def write_segments_jsonl(segments: DataFrame, path: str, columns: Sequence[str], buckets: int | None = None) -> None:
    """K1: one JSON line per segment in row order, in folders per part or in ``buckets`` folders."""
    lines = segments.select("part_id", "seq", vx.canonical_json(columns).alias("value"))
    placed, folder = _layout(lines, ["seq"], buckets)
    placed.select(folder, "value").write.mode("overwrite").partitionBy(folder).text(path)


def export_text_layers(paragraphs: DataFrame, rows: int = CUES_PER_CHUNK) -> DataFrame:
    """K5: raw, cleaned and corrected paragraph text in chunks, ``[start–end] title`` before each."""
    layers = paragraphs.select("part_id", "group_no", "start_ms", "end_ms", "title", F.explode(F.array(
        *[F.struct(F.lit(name).alias("layer"), F.col(column).alias("text"))
          for name, column in (("raw", "text_raw"), ("cleaned", "text_clean"), ("corrected", "text_corrected"))])
    ).alias("_l"))

    def seconds(ms: Column) -> Column:
        return F.format_string("%d.%03d", F.floor(ms / 1000).cast("long"), ms % 1000)

    cue = F.format_string("[%s–%s] %s\n%s", seconds(F.col("start_ms")), seconds(F.col("end_ms")), F.col("title"), F.col("_l.text"))
    rows_ = layers.select("part_id", F.col("_l.layer").alias("layer"), (F.col("group_no") - 1).alias("seq"), cue.alias("cue"))
    chunk = F.floor(F.col("seq") / rows).cast("long")
    return rows_.groupBy("part_id", "layer", chunk.alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "cue"))), lambda s: s["cue"]), "\n\n").alias("body"))


def build_content_manifest(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """K6: row count and content digest per group.

    The digest covers the multiset of row hashes: the eight 32-bit words of each SHA-256 are summed
    exactly and the sums hashed with the count. Sums combine before the shuffle, so a group of any size
    is a handful of numbers per task and never a list of hashes.
    """
    hashed = df.select(*group, vx.row_fingerprint(columns).alias("_h"))
    words = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"_w{i}") for i in range(8)]
    sums = hashed.groupBy(*group).agg(F.count(F.lit(1)).alias("row_count"), *words)
    return sums.select(*group, "row_count", F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), *[f"_w{i}" for i in range(8)]), 256).alias("digest"))


def assemble_reader_dataset(jobs: DataFrame, children: dict[str, tuple[DataFrame, tl.Timeline]], key: str = "job_id",
                            rows: int = CUES_PER_CHUNK) -> DataFrame:
    """K7: reader pages: per job and page, a list of child structs for every child table.

    Children are cut into pages of ``rows`` by position along their timeline, so a job with very many
    children becomes many bounded pages. Jobs without children keep page 0. All tables travel as one: a row is tagged with
    its table and carries that table's struct, so numbering and paging are one shuffle each, however many tables there are. A timeline has its
    integer block column, and at most one number and one string to break ties.
    """
    both = None
    for name, (child, line) in children.items():
        fields = [*line.order, *[c for c in child.columns if c != key and c not in line.order]]
        ties = {"_number": F.lit(None).cast("long"), "_string": F.lit(None).cast("string")}
        for c in line.order:
            if c != line.block_on:
                ties["_string" if isinstance(child.schema[c].dataType, T.StringType) else "_number"] = F.col(c)
        tagged = child.select(key, F.lit(name).alias("_table"), F.col(line.block_on).cast("long").alias("_place"), line.block.alias("_run"),
                              *[c.alias(n) for n, c in ties.items()], F.struct(*fields).alias(name))
        both = tagged if both is None else both.unionByName(tagged, allowMissingColumns=True)
    line = tl.Timeline((key, "_table"), ("_place", "_number", "_string"), "_run", 1)
    numbered = tl.scan(both, line, row_number="_n")
    page = F.floor((F.col("_n") - 1) / rows).cast("long").alias("page")
    # collect_list leaves out nulls, so each list holds the rows of its own table.
    pages = numbered.groupBy(key, page).agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_table") == n, F.struct("_n", F.col(n).alias("row"))))), lambda s: s["row"]).alias(n) for n in children])
    return tl.join_parts(jobs, pages, [key], "left").withColumn("page", F.coalesce("page", F.lit(0).cast("long")))
