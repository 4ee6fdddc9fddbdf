"""Range rules over segments, requests and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_time_range(segments: DataFrame, start: int | None, end: int | None, start_col: str = "start_ms", end_col: str = "end_ms") -> DataFrame:
    """Closed on both ends, times unchanged; untimed rows (null times) stay."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col(end_col) >= start)
    if end is not None:
        keep = keep & (F.col(start_col) <= end)
    return segments.filter(F.col(start_col).isNull() | keep)


def clip_to_range(segments: DataFrame, start: int, end: int, start_col: str = "start_ms", end_col: str = "end_ms", slack: int = 1) -> tuple[DataFrame, DataFrame]:
    """P10: (clipped rows with raw bounds kept, rejected rows)."""
    a, b = F.col(start_col), F.col(end_col)
    bad = (a < start - slack) | (b < a)
    kept = segments.filter(~bad & (a < end))
    raw = kept.withColumn("raw_start", a).withColumn("raw_end", b)
    out = raw.withColumns({start_col: F.greatest(F.col("raw_start"), F.lit(start)), end_col: F.least(F.col("raw_end"), F.lit(end))})
    clipped = (F.col(start_col) != F.col("raw_start")) | (F.col(end_col) != F.col("raw_end"))
    return out.withColumn("range_boundary_clipped", clipped), segments.filter(bad)


def shift_to_absolute_time(segments: DataFrame, offset: int, source_ref: str = "source_ref") -> DataFrame:
    """Add the offset; the local id and the offset stay in ``source_ref``."""
    return segments.withColumns({
        "start_ms": F.col("start_ms") + offset, "end_ms": F.col("end_ms") + offset,
        source_ref: F.map_concat(source_ref, F.create_map(F.lit("local_segment_id"), F.col("segment_id"), F.lit("offset_ms"), F.lit(str(offset))))})


def range_problem(start: Column, end: Column, duration: Column, tolerance: int = 500) -> Column:
    """Why a requested range is invalid, or null; an unknown duration passes."""
    return (F.when(end.isNotNull() & (end <= start), "end_not_after_start")
            .when(duration.isNotNull() & (start >= duration + tolerance), "start_beyond_duration")
            .when(duration.isNotNull() & end.isNotNull() & (end > duration + tolerance), "end_beyond_duration"))


def estimate_download_bytes(items: DataFrame, formats: DataFrame, key: str, gate: int = 500 * 1024 * 1024) -> DataFrame:
    """Size estimate per item and whether it passes the gate; null when nothing is known.

    items: key, start_s, end_s (null = whole), duration_s, filesize, tbr. formats: key, height, tbr, vcodec, acodec.
    """
    usable = formats.filter((F.col("height").isNull() | (F.col("height") <= 1080)) & (F.col("tbr") >= 0))
    video = F.coalesce("vcodec", F.lit("none")) != "none"
    audio = ~video & (F.coalesce("acodec", F.lit("none")) != "none")
    rates = usable.groupBy(key).agg(F.max(F.when(video, F.col("tbr"))).alias("_v"), F.max(F.when(audio, F.col("tbr"))).alias("_a"))
    rows = items.join(rates, key, "left")
    seconds = F.when(F.col("end_s").isNotNull(), F.col("end_s") - F.col("start_s")).otherwise(F.col("duration_s"))
    by_rate = seconds * (F.col("_v") + F.coalesce("_a", F.lit(160.0))) * 1000 / 8 * 1.10
    share = F.least(F.lit(1.0), F.try_divide(seconds, F.nullif(F.col("duration_s"), F.lit(0.0))))
    by_size = F.when(F.coalesce("filesize", F.lit(0)) > 0, F.col("filesize") * share * 1.10)
    by_total = F.when(F.col("items_tbr") > 0, seconds * F.col("items_tbr") * 1000 / 8 * 1.10)
    estimate = F.when(seconds > 0, F.coalesce(by_rate, by_size, by_total)).cast("long")
    return rows.select(key, estimate.alias("estimated_bytes"), (estimate > gate).alias("over_gate"))


def normalize_duration(runs: DataFrame, requests: DataFrame, segments: DataFrame, key: str, same: int = 1, near: int = 250) -> DataFrame:
    """Keep, replace or reject the stored duration of each cached run.

    runs: key, stored_ms, elapsed_ms. requests: key, requested_ms. segments: key, end_ms.
    """
    last = segments.groupBy(key).agg(F.max("end_ms").alias("_last"))
    rows = runs.join(requests, key).join(last, key, "left")
    apart = F.abs(F.col("stored_ms") - F.col("requested_ms"))
    status = (F.when(apart <= same, "kept").when(apart > near, "rejected_duration_differs")
              .when(F.col("_last") > F.col("requested_ms") + same, "rejected_segment_outside").otherwise("replaced"))
    duration = F.when(status == "replaced", F.col("requested_ms")).when(status == "kept", F.col("stored_ms"))
    return rows.select(key, status.alias("status"), duration.alias("duration_ms"),
                       F.round(F.try_divide(F.col("elapsed_ms").cast("double"), duration.cast("double")), 6).alias("real_time_factor"))
