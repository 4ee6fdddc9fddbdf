"""Key moments of a video: merging, ranking, budgets, bins, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelscribe.functions import values as vx
from reelscribe.operators import timeline as tl

# Cue fragments that mark a formula.
FORMULA_FRAGMENTS = ("公式", "式子", "矩阵", "向量", "求和", "梯度", "概率", "期望", "定义", "推导")


def merge_moments(moments: DataFrame, line: tl.Timeline, at: str, ident: str, tolerance: int) -> DataFrame:
    """Join moments to the cluster whose anchor (first moment) is at most ``tolerance`` earlier.

    ``moments`` carries ``reasons`` and ``cue_terms`` arrays and ``scene_score``; ``line`` orders by time,
    then source order.
    """
    numbered = tl.carried_groups(moments, line, F.col(at) - tolerance, F.col(at), "_anchor", "cluster")
    order = F.struct(*[F.col(c) for c in line.order])

    def union(column: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column))))

    return numbered.groupBy(*line.part, "cluster").agg(
        F.min_by(ident, order).alias("anchor_id"), F.min_by(at, order).alias("t"),
        F.count(F.lit(1)).alias("merged"), union("reasons").alias("reasons"), union("cue_terms").alias("cue_terms"),
        F.max("scene_score").alias("scene_score"))


def priority(reasons: Column, cue_terms: Column, fragments: tuple[str, ...] = FORMULA_FRAGMENTS) -> Column:
    """4 formula cue, 3 cue, 2 scene change, 1 other."""
    formula = F.exists(cue_terms, lambda t: t.rlike("|".join(fragments)))
    return (F.when(formula, 4).when(F.array_contains(reasons, "subtitle_cue"), 3)
            .when(F.array_contains(reasons, "scene_change"), 2).otherwise(1))


def rank_and_cap(moments: DataFrame, part: str, order: list[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """Best ``limit`` rows per part, and how many each part drops. The limit is the frame budget.

    ``row_number <= limit`` is cut per task before the shuffle (window group limit).
    """
    ranked = moments.withColumn("rank", F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    counts = moments.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    dropped = counts.select(part, F.greatest(F.lit(0), F.col("_n") - limit).alias("dropped"))
    return ranked.filter(F.col("rank") <= limit), dropped


def stratified_top_n(frames: DataFrame, ranges: DataFrame, part: str, at: str, order: list[Column], maximum: int,
                     width: int) -> DataFrame:
    """All frames when at most ``maximum``; else ``max(1, maximum // buckets)`` per ``width`` bucket."""
    counts = frames.groupBy(part).agg(F.count(F.lit(1)).alias("_count"))
    buckets = F.greatest(F.lit(1), F.ceil((F.col("range_end") - F.col("range_start")) / width)).cast("long")
    sized = ranges.join(counts, part).withColumn("_buckets", buckets).withColumn(
        "_budget", F.greatest(F.lit(1), F.floor(F.lit(maximum) / F.col("_buckets"))).cast("long"))
    inside = frames.join(sized, part)
    bucket = F.floor((F.col(at) - F.col("range_start")) / width).cast("long")
    bucket = F.when(F.col(at) == F.col("range_end"), F.col("_buckets") - 1).otherwise(bucket)
    in_range = (F.col(at) >= F.col("range_start")) & (F.col(at) <= F.col("range_end"))
    small = F.col("_count") <= maximum
    ranked = inside.filter(small | in_range).withColumn("bucket", bucket).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(part, "bucket").orderBy(*order)))
    kept = ranked.filter(F.col("_rank") <= maximum).filter(small | (F.col("_rank") <= F.col("_budget")))
    return kept.select(*frames.columns, "bucket")


def pick_per_bin(frames: DataFrame, packets: DataFrame, on: str, packet: str, at: str, bins: int = 6,
                 fallback: bool = False, ident: str = "frame_id", bin_size: int | None = None) -> DataFrame:
    """One frame per equal bin of each packet: cue first, then scene change, then score, then earliest.

    Frames carry ``has_cue``, ``is_scene`` and ``scene_score``; packets ``primary_start``/``primary_end``.
    With ``fallback``, a packet without a frame takes the frame of the job nearest to its centre.
    """
    from reelscribe.operators.intervals import point_in_interval

    size = bin_size or 300_000
    inside = point_in_interval(frames, packets, [on], at, "primary_start", "primary_end", size)
    span = F.col("primary_end") - F.col("primary_start")
    which = F.floor((F.col(at) - F.col("primary_start")) * bins / span).cast("long")
    best = F.struct("has_cue", "is_scene", F.coalesce("scene_score", F.lit(0.0)).alias("s"),
                    (-F.col(at)).alias("t"), (-F.col("ord")).alias("o"))
    chosen = inside.groupBy(on, packet, which.alias("bin")).agg(F.max_by(F.struct(ident, at), best).alias("_f"))
    out = chosen.select(on, packet, "bin", F.col(f"_f.{ident}").alias(ident), F.col(f"_f.{at}").alias(at))
    if not fallback:
        return out
    return out.unionByName(_nearest_frame(frames, packets.join(out, [on, packet], "left_anti"), on, packet, at, ident))


def _nearest_frame(frames: DataFrame, empty: DataFrame, on: str, packet: str, at: str, ident: str) -> DataFrame:
    """Nearest frame to each packet centre: merge both on one timeline and look to both sides."""
    centre = empty.select(on, packet, (F.col("primary_start") + F.col("primary_end")).alias("_t2"))
    marks = frames.select(on, (F.col(at) * 2).alias("_t2"), F.lit(0).alias("_kind"), "ord",
                          F.struct((F.col(at) * 2).alias("t2"), "ord", F.col(ident).alias("id"), F.col(at).alias("t")).alias("_f"))
    asks = centre.withColumn("_kind", F.lit(1)).withColumn("ord", F.xxhash64(packet)).withColumn("_f", F.lit(None).cast(marks.schema["_f"].dataType))
    both = marks.unionByName(asks, allowMissingColumns=True)
    line = tl.Timeline((on,), ("_t2", "_kind", "ord"), "_t2", 7_200_000)
    # Latest time before (its first row wins ties) and the first row at the next time after.
    prior = tl.scan(both, line, max_upto={"_before_t": F.col("_f.t2")})
    first_at = marks.groupBy(on, "_t2").agg(F.min("_f").alias("_first"))
    after_line = tl.Timeline((on,), ("_n2", "_kind", "_nord"), "_n2", 7_200_000)
    flipped = both.withColumn("_n2", -F.col("_t2")).withColumn("_nord", -F.col("ord"))
    after = tl.scan(flipped, after_line, max_upto={"_after": -F.col("_f.t2")}).filter("_kind = 1").select(
        on, packet, (-F.col("_after")).alias("_after_t"))
    asked = prior.filter("_kind = 1").select(on, packet, "_t2", "_before_t").join(after, [on, packet])
    sides = asked.select(on, packet, "_t2", F.explode(F.array("_before_t", "_after_t")).alias("_at")).filter("_at IS NOT NULL")
    hits = sides.join(first_at.withColumnRenamed("_t2", "_at"), [on, "_at"])
    near = hits.groupBy(on, packet).agg(F.min_by("_first", F.struct(F.abs(F.col("_at") - F.col("_t2")).alias("d"), F.col("_first.ord").alias("o"))).alias("_b"))
    return near.select(on, packet, F.lit(None).cast("long").alias("bin"), F.col("_b.id").alias(ident), F.col("_b.t").alias(at))


def alias_adjacent_duplicates(frames: DataFrame, line: tl.Timeline, ident: str, at: str, max_apart: int) -> DataFrame:
    """A frame with the same hash as the one before, close in time and without a cue on either, is its alias."""
    near = tl.scan(frames, line, previous={"_hi": "hash_hi", "_lo": "hash_lo", "_at": at, "_cue": "has_cue"})
    link = ((F.col("_hi") == F.col("hash_hi")) & (F.col("_lo") == F.col("hash_lo"))
            & (F.col(at) - F.col("_at") <= max_apart) & ~F.col("_cue") & ~F.col("has_cue"))
    linked = near.withColumn("is_alias", F.coalesce(link, F.lit(False)))
    order = F.struct(*[F.col(c) for c in line.order], F.col(ident).alias("_canonical"))
    out = tl.scan(linked, line, max_upto={"_c": F.when(~F.col("is_alias"), order)})
    return out.select(*frames.columns, F.col("_c._canonical").alias("canonical_id"), (~F.col("is_alias")).alias("active"))


def paginate(frames: DataFrame, line: tl.Timeline, ident: str, size: int = 12) -> DataFrame:
    """Pages of at most ``size`` frames in order, with sheet ids per part."""
    numbered = tl.scan(frames, line, row_number="_n")
    page = F.floor((F.col("_n") - 1) / size).cast("long") + 1
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(ident).alias("id")))), lambda s: s["id"])
    return numbered.groupBy(*line.part, page.alias("page")).agg(listed.alias("frame_ids"), F.count(F.lit(1)).alias("frame_count")
                                                                ).withColumn("sheet_id", vx.numbered("CS", F.col("page"), 3))
