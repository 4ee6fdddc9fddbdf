"""Interval and point joins through bins of doubling widths.

Every interval has a level: the smallest one whose bins (``bin_size`` times two to the level) are as long as it is, so it touches two
bins of its level, however long it is. Two intervals meet on the higher of their levels; a side is expanded to the levels that
the other side has at or above its own, which a subquery lists (a few numbers). The exact predicate runs
after. A pair is kept only in the bin where the later of the two starts lies, so no distinct is
needed. Most rows expand to one or two where ``bin_size`` is near the common interval. AQE splits a bin that holds too many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(value: Column, width: Column) -> Column:
    return F.floor(value / width).cast("long")


def _level(span: tuple[Column, Column], bin_size: int) -> Column:
    length = span[1] - span[0]
    return F.when(length <= bin_size, 0).otherwise(F.ceil(F.log2(length / bin_size))).cast("int")


def _expanded(rows: DataFrame, side: str, span: tuple[Column, Column], levels: Column, bin_size: int) -> DataFrame:
    """The rows once for each bin (``_level``, ``_bin``) in which they may meet a row of one of the ``levels``."""
    own = f"_{side}_level"
    listed = rows.withColumn("_levels", levels)
    rows = listed.withColumn("_level", F.explode(F.array_distinct(F.transform("_levels", lambda x: F.greatest(F.col(own), x))))).drop("_levels")
    width = F.lit(bin_size).cast("long") * F.expr("shiftleft(1L, _level)")
    first = _bin(span[0], width)
    return rows.withColumn(f"_{side}_first", first).withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, _bin(span[1], width)))))


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[Column, Column],
                 right_span: tuple[Column, Column], predicate: Column, bin_size: int, left_short: bool = False) -> DataFrame:
    """All pairs with equal ``on`` columns whose closed spans meet and for which ``predicate`` holds.

    Other column names must differ between the sides; the spans are integer expressions. ``left_short``: no interval of the left side is
    longer than a bin, as where it holds points; it is then not read for its levels.
    """
    l, r = (rows.withColumn(f"_{side}_level", _level(span, bin_size)) for rows, side, span in ((left, "l", left_span), (right, "r", right_span)))
    lowest = F.array(F.lit(0))
    of_right = F.coalesce(r.select(F.collect_set("_r_level")).scalar(), lowest)
    of_left = lowest if left_short else F.coalesce(l.select(F.collect_set("_l_level")).scalar(), lowest)
    pairs = _expanded(l, "l", left_span, of_right, bin_size).join(_expanded(r, "r", right_span, of_left, bin_size), [*on, "_level", "_bin"])
    met = (F.col("_level") == F.greatest("_l_level", "_r_level")) & (F.col("_bin") == F.greatest("_l_first", "_r_first"))
    return pairs.filter(met).filter(predicate).drop("_bin", "_level", "_l_level", "_r_level", "_l_first", "_r_first")


def near_point(points: DataFrame, segments: DataFrame, on: Sequence[str], at: str, start: str, end: str,
               radius: int) -> DataFrame:
    """Segments with ``end >= at - radius`` and ``start <= at + radius``."""
    low, high = F.col(at) - radius, F.col(at) + radius
    return overlap_join(points, segments, on, (low, high), (F.col(start), F.col(end)),
                        (F.col(end) >= low) & (F.col(start) <= high), max(2 * radius, 1), left_short=True)


def point_in_interval(points: DataFrame, spans: DataFrame, on: Sequence[str], at: str, start: str, end: str,
                      bin_size: int, closed: bool = False) -> DataFrame:
    """``start <= at < end`` (``<= end`` when ``closed``)."""
    inside = (F.col(start) <= F.col(at)) & ((F.col(at) <= F.col(end)) if closed else (F.col(at) < F.col(end)))
    return overlap_join(points, spans, on, (F.col(at), F.col(at)), (F.col(start), F.col(end)), inside, bin_size, left_short=True)


def first_interval_at(points: DataFrame, spans: DataFrame, on: Sequence[str], point_id: str, at: str, start: str,
                      end: str, span_id: str, bin_size: int) -> DataFrame:
    """J3, first match: the earliest closed span that holds the point."""
    hits = point_in_interval(points, spans, on, at, start, end, bin_size, closed=True)
    return hits.groupBy(*on, point_id).agg(F.min_by(span_id, F.struct(start, span_id)).alias(span_id))


def assign_by_max_overlap(items: DataFrame, sections: DataFrame, on: Sequence[str], item_id: str,
                          item_span: tuple[str, str], section_span: tuple[str, str], section_ord: str,
                          carry: Sequence[str], bin_size: int) -> DataFrame:
    """The section with the longest strict overlap per item, ties to the lowest ``section_ord``.

    Items without a section stay, with null ``carry`` columns.
    """
    (a, b), (c, d) = item_span, section_span
    strict = (F.col(d) > F.col(a)) & (F.col(c) < F.col(b))
    pairs = overlap_join(items, sections, on, (F.col(a), F.col(b)), (F.col(c), F.col(d)), strict, bin_size)
    length = F.least(F.col(d), F.col(b)) - F.greatest(F.col(c), F.col(a))
    best = pairs.groupBy(*on, item_id).agg(
        F.max_by(F.struct(*carry), F.struct(length.alias("n"), (-F.col(section_ord)).alias("o"))).alias("_best"))
    return items.join(best, [*on, item_id], "left").select(*items.columns, *[F.col(f"_best.{x}").alias(x) for x in carry])


def map_to_media(points: DataFrame, media: DataFrame, on: Sequence[str], at: str, bin_size: int) -> DataFrame:
    """Media part and local time of an absolute time; the last part (null end) is open-ended.

    Closed parts are met in their bins. An open part has no last bin: it meets the points of its own keys, however late.
    """
    closed = point_in_interval(points, media.filter("timeline_end IS NOT NULL"), on, at, "timeline_start", "timeline_end", bin_size)
    late = points.join(media.filter("timeline_end IS NULL"), list(on)).filter(F.col("timeline_start") <= F.col(at))
    return closed.unionByName(late).withColumn("local_time", F.col(at) - F.col("timeline_start"))
