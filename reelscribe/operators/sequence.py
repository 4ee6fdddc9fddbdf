"""Sequence operators over one timeline: ids, duplicates, overlaps, gaps, coverage, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelscribe.functions import text as tx
from reelscribe.functions import values as vx
from reelscribe.operators import timeline as tl


def assign_stable_ids(df: DataFrame, line: tl.Timeline, part_order: str, prefix: str = "T", first: int = 1,
                      name: str = "segment_id", width: int = 6) -> DataFrame:
    """Ids over all parts in ``part_order`` (an integer column fixed per part), then in row order.

    Counts are combined per (part, block), then per part, then per range of parts; only that last,
    tiny level is one ordered list.
    """
    rows, part, keys = tl.keyed(df, line)
    blocks = rows.groupBy(part_order, *keys).agg(F.count(F.lit(1)).alias("_n"))
    parts = blocks.groupBy(part_order, *part).agg(F.sum("_n").alias("_n"))
    ordered = tl.Timeline((), (part_order, *part), part_order, tl.ROWS_PER_BLOCK)
    offsets = tl.scan(parts, ordered, sum_before={"_part_base": "_n"}).select(*part, "_part_base")
    chain = Window.partitionBy(*part).orderBy(tl.BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    base = (blocks.withColumn("_block_base", F.coalesce(F.sum("_n").over(chain), F.lit(0)))
            .join(offsets, part)
            .select(*keys, (F.col("_part_base") + F.col("_block_base")).alias("_base")))
    local = Window.partitionBy(*keys).orderBy(*line.order)
    numbered = rows.withColumn("_k", F.row_number().over(local)).join(base, keys)
    return numbered.select(*df.columns, vx.numbered(prefix, F.col("_base") + F.col("_k") + (first - 1), width).alias(name))


def collapse_adjacent_duplicates(df: DataFrame, line: tl.Timeline, text: str = "text_clean", start: str = "start_ms",
                                 end: str = "end_ms", gap: int = 500) -> DataFrame:
    """Drop a row equal in text to the last kept row and starting at most ``gap`` after its end.

    The scan and the fold see a digest of the text; ``df`` meets the kept rows by its place in the order at the end.
    """
    place = list(dict.fromkeys([*line.part, *line.order]))
    narrow = df.select(*dict.fromkeys([*place, line.block_on, start, end]), F.sha2(text, 256).alias("_digest"))
    prior = tl.scan(narrow, line, previous={"_prior": "_digest"})
    other = F.col("_prior").isNull() | (F.col("_prior") != F.col("_digest"))
    threshold = F.when(other, F.lit(int(tl.ALWAYS))).otherwise(F.col(start) - gap)
    kept = tl.carried_groups(prior, line, threshold, F.col(end), "_kept").filter("_kept").select(*place)
    return tl.join_parts(df, kept, place, "left_semi")


def report_overlaps(df: DataFrame, line: tl.Timeline, ident: str, start: str, end: str) -> DataFrame:
    """Rows starting before the end of the row just before them."""
    out = tl.scan(df, line, previous={"first_id": ident, "_end": end}).filter(F.col(start) < F.col("_end"))
    return out.select(*line.part, "first_id", F.col(ident).alias("second_id"), (F.col("_end") - F.col(start)).alias("overlap"))


def report_adjacent_duplicates(df: DataFrame, line: tl.Timeline, ident: str, text: str = "text_clean") -> DataFrame:
    """Non-empty text equal to the row just before."""
    out = tl.scan(df, line, previous={"first_id": ident, "_text": text})
    return out.filter((F.col(text) != "") & (F.col(text) == F.col("_text"))).select(
        *line.part, "first_id", F.col(ident).alias("second_id"))


def gap_list(df: DataFrame, line: tl.Timeline, start: str, end: str, durations: DataFrame, minimum: int) -> DataFrame:
    """Uncovered stretches of at least ``minimum`` from 0 to the part's ``duration``; ordered by start."""
    reach = tl.scan(df, line, max_before={"_reach": end}).withColumn("_reach", F.greatest(F.lit(0), F.coalesce("_reach", F.lit(0))))
    inner = reach.select(*line.part, F.col("_reach").alias("gap_start"), F.col(start).alias("gap_end"))
    tail = tl.join_parts(durations, df.groupBy(*line.part).agg(F.max(end).alias("_last")), line.part, "left").select(
        *line.part, F.greatest(F.coalesce("_last", F.lit(0)), F.lit(0)).alias("gap_start"), F.col("duration").alias("gap_end"))
    return inner.unionByName(tail).filter(F.col("gap_end") - F.col("gap_start") >= minimum)


def max_gap(df: DataFrame, line: tl.Timeline, start: str, end: str, durations: DataFrame) -> DataFrame:
    """Longest uncovered stretch per part, at least 0 inside and including the tail."""
    reach = tl.scan(df, line, max_before={"_reach": end})
    inner = reach.groupBy(*line.part).agg(
        F.max(F.greatest(F.lit(0), F.col(start) - F.greatest(F.lit(0), F.coalesce("_reach", F.lit(0))))).alias("_inner"),
        F.max(end).alias("_last"))
    return tl.join_parts(durations, inner, line.part, "left").select(
        *line.part, F.greatest(F.coalesce("_inner", F.lit(0)),
                               F.col("duration") - F.greatest(F.lit(0), F.coalesce("_last", F.lit(0)))).alias("max_gap"))


def neighbour_gap_stats(df: DataFrame, line: tl.Timeline, start: str, end: str) -> DataFrame:
    """Widest gap to the next row and number of rows starting before the row before them."""
    near = tl.scan(df, line, previous={"_end": end, "_start": start})
    return near.groupBy(*line.part).agg(
        F.coalesce(F.max(F.greatest(F.lit(0), F.col(start) - F.col("_end"))), F.lit(0)).alias("max_gap"),
        F.count(F.when(F.col(start) < F.col("_start"), 1)).alias("reverse_count"))


def periodic_samples(ranges: DataFrame, start: str, end: str, interval: int, tail_back: int, tail_min: int) -> DataFrame:
    """``start, start + interval, … < end`` plus a tail sample when the last one is far from the end."""
    s, e = F.col(start), F.col(end)
    tail = F.greatest(s, e - tail_back)
    regular = F.when(e > s, F.sequence(s, F.greatest(s, e - 1), F.lit(interval).cast("long"))).otherwise(F.array(tail))
    last = F.element_at("_t", -1)
    far = tail - last > max(tail_min, interval // 3)
    return ranges.withColumn("_t", regular).withColumn(
        "t", F.explode(F.when(far, F.concat("_t", F.array(tail))).otherwise(F.col("_t")))).drop("_t")


def cue_moments(segments: DataFrame, cues: list[str], offsets: list[int], start: Column, end: Column,
                at: str = "start_ms", text: str = "text_clean") -> DataFrame:
    """One moment per cue-bearing row and offset, clamped to the range (end exclusive by 10 ms)."""
    folded = tx.casefold(F.col(text))
    listed = F.array(*[F.struct(F.lit(c).alias("c"), tx.casefold(F.lit(c)).alias("f")) for c in cues])
    hits = F.transform(F.filter(listed, lambda c: F.contains(folded, c["f"])), lambda c: c["c"])
    rows = segments.withColumn("cue_terms", hits).filter(F.size("cue_terms") > 0)
    rows = rows.withColumn("cue_offset", F.explode(F.array(*[F.lit(o).cast("long") for o in sorted(set(offsets))])))
    t = F.least(end - 10, F.greatest(start, F.col(at) + F.col("cue_offset")))
    kind = F.when(F.col("cue_offset") < 0, "before").when(F.col("cue_offset") > 0, "after").otherwise("at")
    return rows.withColumn("t", t).withColumn("offset_type", kind).filter((start <= F.col("t")) & (F.col("t") < end))


def bucket_calendar(ranges: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Consecutive buckets of ``width`` over each range, the last one cut at the end."""
    count = F.ceil((F.col(end) - F.col(start)) / width).cast("long")
    rows = ranges.filter(F.col(end) > F.col(start)).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    left = F.col(start) + F.col("bucket") * width
    return rows.withColumn("bucket_start", left).withColumn("bucket_end", F.least(F.col(end), left + width))


def fixed_chunks(ranges: DataFrame, start: str, end: str, width: int, tolerance: int = 1) -> DataFrame:
    """Chunks of at most ``width``; a remainder of at most ``tolerance`` opens no chunk."""
    count = F.ceil((F.col(end) - F.col(start) - tolerance) / width).cast("long")
    rows = ranges.filter(count > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(1).cast("long"), count)))
    left = F.col(start) + (F.col("chunk_no") - 1) * width
    return rows.withColumn("chunk_start", left).withColumn("chunk_end", F.least(F.col(end), left + width))


def _in_buckets(frames: DataFrame, ranges: DataFrame, on: str, at: str, width: int) -> DataFrame:
    last = F.ceil((F.col("range_end") - F.col("range_start")) / width).cast("long") - 1
    inside = tl.join_parts(frames, ranges, [on]).filter((F.col(at) >= F.col("range_start")) & (F.col(at) <= F.col("range_end")))
    return inside.withColumn("bucket", F.least(F.floor((F.col(at) - F.col("range_start")) / width).cast("long"), last))


def evidence_buckets(frames: DataFrame, ranges: DataFrame, on: str, at: str, width: int) -> DataFrame:
    """Per bucket of the range how many frames fall into it; the last bucket is closed on the right.

    ``bucket_frames`` numbers the frames; those of a bucket are ``frame_count`` numbers from ``first_position`` on.
    """
    calendar = bucket_calendar(ranges, "range_start", "range_end", width)
    counted = _in_buckets(frames, ranges, on, at, width).groupBy(on, "bucket").agg(F.count(F.lit(1)).alias("frame_count"))
    listed = calendar.select(on, "bucket").withColumn("frame_count", F.lit(0).cast("long"))
    both = listed.unionByName(counted).groupBy(on, "bucket").agg(F.sum("frame_count").alias("frame_count"))
    line = tl.Timeline((on,), ("bucket",), "bucket", tl.ROWS_PER_BLOCK)
    placed = tl.scan(both, line, sum_before={"_before": "frame_count"})
    return tl.join_parts(calendar, placed, [on, "bucket"]).select(
        on, "bucket", "bucket_start", "bucket_end", "frame_count", (F.col("frame_count") > 0).alias("has_evidence"),
        F.when(F.col("frame_count") > 0, F.col("_before") + 1).alias("first_position"))


def bucket_frames(frames: DataFrame, line: tl.Timeline, ranges: DataFrame, at: str, ident: str, width: int) -> DataFrame:
    """(part, bucket, position, frame): the frames inside the ranges, numbered along ``line``, with their buckets."""
    on = line.part[0]
    placed = _in_buckets(frames, ranges, on, at, width)
    return tl.scan(placed, line, row_number="position").select(on, "bucket", "position", ident)


def max_evidence_gap(frames: DataFrame, line: tl.Timeline, ranges: DataFrame, at: str) -> DataFrame:
    """Longest stretch without a frame, both range ends included."""
    near = tl.scan(frames, line, previous={"_prior": at})
    gaps = near.groupBy(*line.part).agg(F.max(F.col(at) - F.col("_prior")).alias("_g"), F.min(at).alias("_a"), F.max(at).alias("_z"))
    return tl.join_parts(ranges, gaps, line.part, "left").select(
        *line.part, F.coalesce(F.greatest(F.col("_g"), F.col("_a") - F.col("range_start"), F.col("range_end") - F.col("_z")),
                               F.col("range_end") - F.col("range_start")).alias("max_gap"))


def low_density_buckets(segments: DataFrame, durations: DataFrame, part: str, start: str, end: str, weight: Column,
                        width: int, minimum: int) -> DataFrame:
    """A3: buckets whose overlapping rows carry less than ``minimum``; a row counts in full in each bucket."""
    calendar = bucket_calendar(durations.withColumn("_zero", F.lit(0).cast("long")), "_zero", "duration", width)
    first = F.floor(F.col(start) / width).cast("long")
    after = F.greatest(F.ceil(F.col(end) / width).cast("long"), first)  # an empty or inverted row adds and takes away at one place
    # A row adds its weight at its first bucket and takes it away after its last one, however long it is; sums of these combine in the tasks.
    marks = segments.filter((F.col(end) > 0) & F.col(start).isNotNull()).select(part, F.explode(F.array(F.struct(first.alias("bucket"), weight.alias("w")), F.struct(after.alias("bucket"), (-weight).alias("w")))).alias("_m"))
    steps = marks.groupBy(part, F.col("_m.bucket").alias("bucket")).agg(F.sum("_m.w").alias("_w"), F.lit(False).alias("_asked"))
    asked = calendar.select(part, "bucket", F.lit(0).cast(steps.schema["_w"].dataType).alias("_w"), F.lit(True).alias("_asked"))
    line = tl.Timeline((part,), ("bucket", "_asked"), "bucket", tl.ROWS_PER_BLOCK)
    totals = tl.scan(steps.unionByName(asked), line, sum_upto={"total": "_w"}).filter("_asked")
    return totals.select(part, "bucket", "total").filter(F.col("total") < minimum)
