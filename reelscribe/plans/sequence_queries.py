"""Queries over timelines (W1-W9, W21-W23), interval joins (J2-J4, J16, J20) and time reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscribe.functions import text as tx
from reelscribe.operators import intervals as iv
from reelscribe.operators import moments as mo
from reelscribe.operators import reports as rp
from reelscribe.operators import sequence as sq
from reelscribe.operators import timeline as tl
from reelscribe.plans import views as v
from reelscribe.plans.registry import query
from reelscribe.session import stage_table


@query("w1_assign_stable_ids", f"WITH {v.SEG_SQL} SELECT part_id, seq, segment_id FROM seg")
def w1(spark, sf):
    return v.segments(spark, sf).select("part_id", "seq", "segment_id")


def echoed(spark, sf):
    """Each turn twice (the copy right after it), copies of every third turn further away: short texts repeat."""
    s = v.segments(spark, sf).withColumn("text_clean", tx.clean_text(F.col("text_raw")))
    copies = s.withColumn("_c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    shift = F.when(F.col("_c") == 0, 0).when(F.col("_c") == 1, F.col("seq") * 300).otherwise(F.col("seq") * 700)
    return copies.select("part_id", (F.col("seq") * 3 + F.col("_c")).alias("seq"), F.concat("segment_id", F.lit("-"), F.col("_c").cast("string")).alias("segment_id"),
                         (F.col("end_ms") - 1000 + shift).alias("start_ms"), (F.col("end_ms") - 900 + shift).alias("end_ms"), "text_clean")


ECHO_SQL = v.SEG_SQL + f""",
echo AS (
  SELECT part_id, seq * 3 + c AS seq, segment_id || '-' || CAST(c AS VARCHAR) AS segment_id,
         end_ms - 1000 + seq * (CASE c WHEN 0 THEN 0 WHEN 1 THEN 300 ELSE 700 END) AS start_ms, end_ms - 900 + seq * (CASE c WHEN 0 THEN 0 WHEN 1 THEN 300 ELSE 700 END) AS end_ms,
         {v.sql_clean('text_raw')} AS text_clean
  FROM seg, (SELECT unnest([0, 1, 2]) AS c))"""
ECHO_LINE = tl.by_position(["part_id"])


@query("w2_collapse_adjacent_duplicates", f"""
WITH RECURSIVE {ECHO_SQL},
walk AS (
  SELECT part_id, seq, segment_id, text_clean AS kept_text, end_ms AS kept_end, true AS kept FROM echo WHERE seq = 0
  UNION ALL
  SELECT e.part_id, e.seq, e.segment_id,
         CASE WHEN e.text_clean = w.kept_text AND e.start_ms <= w.kept_end + 500 THEN w.kept_text ELSE e.text_clean END,
         CASE WHEN e.text_clean = w.kept_text AND e.start_ms <= w.kept_end + 500 THEN w.kept_end ELSE e.end_ms END,
         NOT (e.text_clean = w.kept_text AND e.start_ms <= w.kept_end + 500)
  FROM walk w JOIN echo e ON e.part_id = w.part_id AND e.seq = w.seq + 1)
SELECT segment_id FROM walk WHERE kept""")
def w2(spark, sf):
    # Texts are compared by digest, so that is what is staged.
    rows = stage_table(echoed(spark, sf).withColumn("text_clean", F.sha2("text_clean", 256)))
    return sq.collapse_adjacent_duplicates(rows, ECHO_LINE).select("segment_id")


@query("w3_report_overlaps", f"""
WITH {v.LOC_SQL}, p AS (SELECT *, lag(end_ms) OVER w AS pe, lag(event_id) OVER w AS first_id FROM loc WINDOW w AS (PARTITION BY part_id ORDER BY start_ms, event_id))
SELECT part_id, first_id, event_id AS second_id, pe - start_ms AS overlap FROM p WHERE start_ms < pe""")
def w3(spark, sf):
    rows, line = tl.split_hot_blocks(v.local_intervals(spark, sf), v.LOC_LINE)
    return sq.report_overlaps(rows, line, "event_id", "start_ms", "end_ms")


@query("w4_report_adjacent_duplicates", f"""
WITH {ECHO_SQL}, p AS (SELECT *, lag(text_clean) OVER w AS pt, lag(segment_id) OVER w AS first_id FROM echo WINDOW w AS (PARTITION BY part_id ORDER BY seq))
SELECT part_id, first_id, segment_id AS second_id FROM p WHERE text_clean <> '' AND text_clean = pt""")
def w4(spark, sf):
    return sq.report_adjacent_duplicates(echoed(spark, sf), ECHO_LINE, "segment_id")


UNION_SQL = """
pm AS (SELECT *, max(b) OVER (PARTITION BY part_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cl),
isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY part_id ORDER BY a, event_id) AS island FROM pm),
un AS (SELECT part_id, CAST(sum(z - a) AS BIGINT) AS covered FROM (SELECT part_id, island, min(a) AS a, max(b) AS z FROM isl GROUP BY 1, 2) GROUP BY part_id)"""


@query("w5_interval_union_length", f"""
WITH {v.LOC_SQL}, cl AS (SELECT part_id, event_id, greatest(start_ms, 0) AS a, least(end_ms, 2000000000) AS b FROM loc WHERE least(end_ms, 2000000000) >= greatest(start_ms, 0)),
{UNION_SQL} SELECT part_id, covered FROM un""")
def w5(spark, sf):
    rows, line = tl.split_hot_blocks(v.local_intervals(spark, sf), v.LOC_LINE)
    return tl.interval_union_length(rows, line, "start_ms", "end_ms", F.lit(0), F.lit(2_000_000_000))


_REACH_SQL = """
r AS (SELECT part_id, start_ms, greatest(0, coalesce(max(end_ms) OVER (PARTITION BY part_id ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reach FROM loc),
g AS (SELECT part_id, reach AS gap_start, start_ms AS gap_end FROM r UNION ALL
      SELECT part_id, max(range_end) AS gap_start, max(range_end) + 3600000 FROM rng GROUP BY part_id)"""


def _durations(spark, sf):
    return v.job_ranges(spark, sf).select("part_id", (F.col("range_end") + 3_600_000).alias("duration"))


@query("w6_gap_list", f"WITH {v.RANGE_SQL}, {_REACH_SQL} SELECT part_id, gap_start, gap_end FROM g WHERE gap_end - gap_start >= 7200000")
def w6(spark, sf):
    rows, line = tl.split_hot_blocks(v.local_intervals(spark, sf), v.LOC_LINE)
    return sq.gap_list(rows, line, "start_ms", "end_ms", _durations(spark, sf), 7_200_000)


@query("w6_max_gap", f"WITH {v.RANGE_SQL}, {_REACH_SQL} SELECT part_id, CAST(max(greatest(0, gap_end - gap_start)) AS BIGINT) AS max_gap FROM g GROUP BY part_id")
def w6_max(spark, sf):
    rows, line = tl.split_hot_blocks(v.local_intervals(spark, sf), v.LOC_LINE)
    return sq.max_gap(rows, line, "start_ms", "end_ms", _durations(spark, sf))


@query("w7_neighbour_gap_stats", f"""
WITH {v.LOC_SQL}, p AS (SELECT *, lag(end_ms) OVER w AS pe, lag(start_ms) OVER w AS ps FROM loc WINDOW w AS (PARTITION BY part_id ORDER BY event_id))
SELECT part_id, CAST(coalesce(max(greatest(0, start_ms - pe)), 0) AS BIGINT) AS max_gap, count(*) FILTER (WHERE start_ms < ps) AS reverse_count FROM p GROUP BY part_id""")
def w7(spark, sf):
    line = tl.by_position(["part_id"], "event_id", 4096)
    return sq.neighbour_gap_stats(v.local_intervals(spark, sf), line, "start_ms", "end_ms")


@query("w8_periodic_samples", f"""
WITH {v.RANGE_SQL}, s AS (SELECT part_id, range_start AS a, range_end AS z, unnest(generate_series(range_start, range_end - 1, 90000000)) AS t FROM rng),
tail AS (SELECT part_id, greatest(max(a), max(z) - 50) AS t, max(t) AS last FROM s GROUP BY part_id)
SELECT part_id, t FROM s UNION ALL SELECT part_id, t FROM tail WHERE t - last > 30000000""")
def w8(spark, sf):
    return sq.periodic_samples(v.job_ranges(spark, sf), "range_start", "range_end", 90_000_000, 50, 1000).select("part_id", "t")


_CUES = ["tion", "THE", "schen"]


@query("w9_cue_moments", f"""
WITH {v.SEG_SQL}, h AS (SELECT part_id, segment_id, start_ms, list_filter(['tion', 'THE', 'schen'], lambda c: contains({v.sql_casefold('text_raw')}, lower(c))) AS cue_terms FROM seg),
o AS (SELECT *, unnest([-1000, 0, 1000]) AS off FROM h WHERE len(cue_terms) > 0),
t AS (SELECT *, least(100000 - 10, greatest(500, start_ms + off)) AS t FROM o)
SELECT segment_id, array_to_string(cue_terms, '|') AS cue_terms, off AS cue_offset, CASE WHEN off < 0 THEN 'before' WHEN off > 0 THEN 'after' ELSE 'at' END AS offset_type, t
FROM t WHERE t >= 500 AND t < 100000""")
def w9(spark, sf):
    s = v.segments(spark, sf).withColumn("text_clean", F.col("text_raw"))
    out = sq.cue_moments(s, _CUES, [-1000, 0, 1000], F.lit(500), F.lit(100_000))
    return out.select("segment_id", v.listed(F.col("cue_terms")).alias("cue_terms"), "cue_offset", "offset_type", "t")


_BUCKET_SQL = v.RANGE_SQL + """, inb AS (SELECT part_id, event_id, start_ms, least((start_ms - range_start) // 86400000, CAST(ceil((range_end - range_start) / 86400000) AS BIGINT) - 1) AS bucket
  FROM loc JOIN rng USING (part_id) WHERE start_ms >= range_start AND start_ms <= range_end)"""


@query("w21_minute_evidence_buckets", f"""
WITH {_BUCKET_SQL}, c AS (SELECT part_id, range_start, range_end, unnest(generate_series(0, CAST(ceil((range_end - range_start) / 86400000) AS BIGINT) - 1)) AS bucket FROM rng),
f AS (SELECT part_id, bucket, count(*) AS n FROM inb GROUP BY 1, 2)
SELECT part_id, bucket, range_start + bucket * 86400000 AS bucket_start, least(range_end, range_start + bucket * 86400000 + 86400000) AS bucket_end,
       coalesce(n, 0) AS frame_count, coalesce(n, 0) > 0 AS has_evidence, CASE WHEN n > 0 THEN CAST(sum(coalesce(n, 0)) OVER (PARTITION BY part_id ORDER BY bucket) - n + 1 AS BIGINT) END AS first_position FROM c LEFT JOIN f USING (part_id, bucket)""")
def w21(spark, sf):
    return sq.evidence_buckets(v.local_intervals(spark, sf), v.job_ranges(spark, sf), "part_id", "start_ms", 86_400_000)


@query("w21_bucket_frames", f"WITH {_BUCKET_SQL} SELECT part_id, bucket, row_number() OVER (PARTITION BY part_id ORDER BY start_ms, event_id) AS position, event_id FROM inb")
def w21_frames(spark, sf):
    rows, line = tl.split_hot_blocks(v.local_intervals(spark, sf).select("part_id", "event_id", "start_ms"), v.LOC_LINE)
    return sq.bucket_frames(rows, line, v.job_ranges(spark, sf), "start_ms", "event_id", 86_400_000)


@query("w21_max_evidence_gap", f"""
WITH {v.RANGE_SQL}, b AS (SELECT part_id, start_ms AS t FROM loc UNION ALL SELECT part_id, range_start FROM rng UNION ALL SELECT part_id, range_end FROM rng),
d AS (SELECT part_id, t - lag(t) OVER (PARTITION BY part_id ORDER BY t) AS g FROM b) SELECT part_id, max(g) AS max_gap FROM d GROUP BY part_id""")
def w21_gap(spark, sf):
    rows, line = tl.split_hot_blocks(v.local_intervals(spark, sf), v.LOC_LINE)
    return sq.max_evidence_gap(rows, line, v.job_ranges(spark, sf), "start_ms")


@query("w22_fixed_chunk_plan", f"""
WITH {v.RANGE_SQL}, c AS (SELECT part_id, range_start, range_end, unnest(generate_series(1, CAST(ceil((range_end - range_start - 1) / 240000000) AS BIGINT))) AS chunk_no FROM rng)
SELECT part_id, chunk_no, range_start + (chunk_no - 1) * 240000000 AS chunk_start, least(range_end, range_start + chunk_no * 240000000) AS chunk_end,
 CAST(ceil((least(range_end, range_start + chunk_no * 240000000) - range_start - (chunk_no - 1) * 240000000) * 24.0 / 3200) AS BIGINT) + 2048 <= 1500000 AS within_budget FROM c""")
def w22(spark, sf):
    out = sq.fixed_chunks(v.job_ranges(spark, sf), "range_start", "range_end", 240_000_000)
    tokens = F.ceil((F.col("chunk_end") - F.col("chunk_start")) * 24.0 / 3200).cast("long") + 2048
    return out.select("part_id", "chunk_no", "chunk_start", "chunk_end", (tokens <= 1_500_000).alias("within_budget"))


@query("w23_paginate", f"""
WITH {v.MOM_SQL}, n AS (SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY t, source_rank, event_id) AS n FROM mom)
SELECT job_id, printf('CS%03d', (n - 1) // 12 + 1) AS sheet_id, string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY n) AS frame_ids, count(*) AS frame_count FROM n GROUP BY job_id, (n - 1) // 12""")
def w23(spark, sf):
    rows, line = tl.split_hot_blocks(v.moments(spark, sf), v.MOM_LINE)
    out = mo.paginate(rows, line, "event_id")
    return out.select("job_id", "sheet_id", v.listed(F.col("frame_ids")).alias("frame_ids"), "frame_count")


# ---- interval joins ------------------------------------------------------------------------------

def points(spark, sf):
    """Cue events as points."""
    m = v.moments(spark, sf).filter("has_cue")
    return m.select(F.col("job_id").alias("part_id"), F.col("event_id").alias("point_id"), "t")


POINT_SQL = v.MOM_SQL + ", pt AS (SELECT job_id AS part_id, event_id AS point_id, t FROM mom WHERE has_cue)"
_RADIUS = 3_600_000


@query("j2_segments_near_point", f"""
WITH {POINT_SQL}, {v.LOC_SQL} SELECT point_id, event_id FROM pt JOIN loc USING (part_id) WHERE end_ms >= t - {_RADIUS} AND start_ms <= t + {_RADIUS}""")
def j2(spark, sf):
    return iv.near_point(points(spark, sf), v.local_intervals(spark, sf), ["part_id"], "t", "start_ms", "end_ms", _RADIUS).select("point_id", "event_id")


@query("j3_point_in_interval", f"WITH {POINT_SQL}, {v.LOC_SQL} SELECT point_id, event_id FROM pt JOIN loc USING (part_id) WHERE start_ms <= t AND t < end_ms")
def j3(spark, sf):
    return iv.point_in_interval(points(spark, sf), v.local_intervals(spark, sf), ["part_id"], "t", "start_ms", "end_ms", 3_600_000).select("point_id", "event_id")


@query("j3_first_interval_at", f"""
WITH {POINT_SQL}, {v.LOC_SQL} SELECT part_id, point_id, arg_min(event_id, (start_ms, event_id)) AS event_id FROM pt JOIN loc USING (part_id) WHERE start_ms <= t AND t <= end_ms GROUP BY 1, 2""")
def j3_first(spark, sf):
    return iv.first_interval_at(points(spark, sf), v.local_intervals(spark, sf), ["part_id"], "point_id", "t", "start_ms", "end_ms", "event_id", 3_600_000)


@query("j4_assign_by_max_overlap", f"""
WITH {v.LOC_SQL}, it AS (SELECT part_id, event_id AS item_id, start_ms AS a, end_ms AS b FROM loc WHERE event_type = 'click'),
se AS (SELECT part_id, event_id AS section_no, start_ms AS c, end_ms + 7200000 AS d FROM loc WHERE event_type = 'view'),
o AS (SELECT part_id, item_id, section_no, row_number() OVER (PARTITION BY part_id, item_id ORDER BY least(b, d) - greatest(a, c) DESC, section_no) AS rn FROM it JOIN se USING (part_id) WHERE d > a AND c < b)
SELECT it.item_id, o.section_no FROM it LEFT JOIN o ON o.part_id = it.part_id AND o.item_id = it.item_id AND rn = 1""")
def j4(spark, sf):
    loc = v.local_intervals(spark, sf)
    items = loc.filter("event_type = 'click'").select("part_id", F.col("event_id").alias("item_id"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    sections = loc.filter("event_type = 'view'").select("part_id", F.col("event_id").alias("section_no"), F.col("start_ms").alias("c"), (F.col("end_ms") + 7_200_000).alias("d"))
    out = iv.assign_by_max_overlap(items, sections, ["part_id"], "item_id", ("a", "b"), ("c", "d"), "section_no", ["section_no"], 7_200_000)
    return out.select("item_id", "section_no")


@query("j20_map_absolute_to_media", f"""
WITH {POINT_SQL}, {v.RANGE_SQL}, m AS (
 SELECT part_id, 1 AS media_no, CAST(0 AS BIGINT) AS s, CAST(1200000000 AS BIGINT) AS e FROM rng UNION ALL SELECT part_id, 2, 1200000000, NULL FROM rng)
SELECT point_id, media_no, t - s AS local_time FROM pt JOIN m USING (part_id) WHERE s <= t AND (e IS NULL OR t < e)""")
def j20(spark, sf):
    media = v.job_ranges(spark, sf).select("part_id", F.explode(F.array(
        F.struct(F.lit(1).alias("media_no"), F.lit(0).cast("long").alias("timeline_start"), F.lit(1_200_000_000).cast("long").alias("timeline_end")),
        F.struct(F.lit(2).alias("media_no"), F.lit(1_200_000_000).cast("long").alias("timeline_start"), F.lit(None).cast("long").alias("timeline_end")))).alias("m")
        ).select("part_id", "m.*")
    return iv.map_to_media(points(spark, sf), media, ["part_id"], "t", 300_000_000).select("point_id", "media_no", "local_time")


# ---- reports on time -----------------------------------------------------------------------------

_ISSUE_SQL = f"""
near AS (SELECT *, lag(end_ms) OVER w AS pe, lag(text_clean) OVER w AS pc FROM (SELECT *, {v.sql_clean('text_raw')} AS text_clean FROM src) WINDOW w AS (PARTITION BY part_id ORDER BY seq)),
iss AS (SELECT part_id, count(*) AS segment_count, max(end_ms) AS last_end, CAST(sum(length(regexp_replace(text_raw, '{v.SQL_WS}+', '', 'g'))) AS BIGINT) AS character_count,
  count(*) FILTER (WHERE regexp_replace(text_raw, '^{v.SQL_WS}+', '') = '') AS empty_count, count(*) FILTER (WHERE start_ms < 0 OR end_ms < start_ms) AS invalid_count,
  count(*) FILTER (WHERE start_ms < pe) AS overlap_count, count(*) FILTER (WHERE text_clean <> '' AND text_clean = pc) AS duplicate_count,
  count(*) FILTER (WHERE length(text_raw) > 180 OR end_ms - start_ms > 20000) AS long_count, count(*) FILTER (WHERE regexp_matches(text_raw, '{tx.GARBLED}')) AS garbled_count
  FROM near GROUP BY part_id)"""
_QUALITY_SQL = """
q AS (SELECT part_id, segment_count, duration, coalesce(covered, 0) AS covered, round(coalesce(covered, 0)::DOUBLE / nullif(duration, 0)::DOUBLE, 6) AS coverage_ratio, character_count,
  round(character_count * 60000.0::DOUBLE / nullif(duration, 0)::DOUBLE, 3) AS characters_per_minute, empty_count, invalid_count, overlap_count, duplicate_count, long_count, garbled_count,
  array_to_string(list_filter([CASE WHEN empty_count > 0 THEN 'empty_segments' END, CASE WHEN invalid_count > 0 THEN 'invalid_times' END, CASE WHEN overlap_count > 0 THEN 'overlapping_segments' END,
    CASE WHEN duplicate_count > 0 THEN 'duplicate_segments' END, CASE WHEN long_count > 0 THEN 'very_long_segments' END, CASE WHEN garbled_count > 0 THEN 'suspicious_garbled_text' END,
    CASE WHEN duration >= 1800000 AND (coalesce(covered, 0)::DOUBLE / duration < 0.2 OR coalesce(character_count * 60000.0 / nullif(duration, 0), 0) < 20) THEN 'long_video_subtitles_abnormally_sparse' END], lambda x: x IS NOT NULL), '|') AS warnings
  FROM iss JOIN dur USING (part_id) LEFT JOIN un USING (part_id))"""


def with_clean(df):
    return df.withColumn("text_clean", tx.clean_text(F.col("text_raw")))


@query("a1_transcript_quality_report", f"""
WITH {v.SEG_SQL}, src AS (SELECT * FROM seg), {_ISSUE_SQL}, dur AS (SELECT part_id, greatest(last_end, 0) AS duration FROM iss),
cl AS (SELECT part_id, seq AS event_id, greatest(start_ms, 0) AS a, end_ms AS b FROM seg), {UNION_SQL}, {_QUALITY_SQL} SELECT * FROM q""")
def a1(spark, sf):
    out = rp.transcript_quality_report(with_clean(v.segments(spark, sf, ids=False)), v.SEG_LINE, v.SEG_TIME_LINE)
    return out.withColumn("warnings", v.listed(F.col("warnings")))


def event_segments(spark, sf, cues=()):
    """Every event as a segment with the text of a document (documents come round again): overlapping, gappy segments.

    A text is measured once, however many events have it; the events carry the numbers.
    """
    d = rp.with_text_measures(v.docs(spark, sf).select(F.col("doc_id").alias("_doc"), "text"), "text", cues).drop("text")
    doc = F.col("event_id") % v.read(spark, sf, "documents").agg(F.max("doc_id") + 1).scalar()
    return v.local_intervals(spark, sf).withColumn("_doc", doc).join(d, "_doc").drop("_doc").withColumn("seq", F.col("event_id"))


EVENT_SEG_SQL = v.RANGE_SQL + """,
src AS (SELECT part_id, event_id AS seq, event_id, start_ms, end_ms, text AS text_raw FROM loc JOIN documents ON doc_id = event_id % (SELECT max(doc_id) + 1 FROM documents))"""


@query("a2_asr_quality_report", f"""
WITH {EVENT_SEG_SQL}, {_ISSUE_SQL}, dur AS (SELECT part_id, range_end + 3600000 AS duration FROM rng),
cl AS (SELECT part_id, event_id, greatest(start_ms, 0) AS a, least(end_ms, duration) AS b FROM src JOIN dur USING (part_id) WHERE least(end_ms, duration) >= greatest(start_ms, 0)), {UNION_SQL}, {_QUALITY_SQL},
{_REACH_SQL.replace("FROM loc", "FROM src").replace("max(range_end) AS gap_start, max(range_end) + 3600000 FROM rng", "max(end_ms) AS gap_start, max(range_end) + 3600000 FROM rng JOIN src USING (part_id)")}, gl AS (SELECT part_id, count(*) FILTER (WHERE gap_end - gap_start >= 2000) AS gap_count, CAST(max(greatest(0, gap_end - gap_start)) AS BIGINT) AS max_gap FROM g GROUP BY part_id),
mt AS (SELECT part_id, unnest(generate_series(start_ms // 3600000, CAST(ceil(end_ms / 3600000) AS BIGINT) - 1)) AS m, length(replace(text_raw, ' ', '')) AS w FROM src WHERE end_ms > 0),
ms AS (SELECT part_id, m, sum(w) AS w FROM mt GROUP BY 1, 2),
mc AS (SELECT part_id, unnest(generate_series(0, CAST(ceil(duration / 3600000) AS BIGINT) - 1)) AS m FROM dur),
sp AS (SELECT part_id, count(*) FILTER (WHERE coalesce(w, 0) < 20) AS sparse_minutes FROM mc LEFT JOIN ms USING (part_id, m) GROUP BY part_id),
tc AS (SELECT part_id, len(regexp_extract_all(text_raw, '{tx.LATIN_TOKEN}')) AS l, len(list_distinct(regexp_extract_all(text_raw, '{tx.NUMBER_OR_SYMBOL}'))) AS s,
  (length(text_raw) - length(replace(text_raw, 'tion', ''))) // 4 + (length(text_raw) - length(replace(text_raw, 'que', ''))) // 3 AS c FROM src),
ta AS (SELECT part_id, count(*) FILTER (WHERE l > 0 OR s > 0 OR c > 0) AS candidate_count, count(*) FILTER (WHERE l > 0) AS mixed_language_count, count(*) FILTER (WHERE s >= 2) AS symbol_dense_count, CAST(sum(c) AS BIGINT) AS cue_total FROM tc GROUP BY part_id)
SELECT q.*, max_gap, gap_count, sparse_minutes, candidate_count, mixed_language_count, symbol_dense_count, cue_total, 100000 AS elapsed_ms, round(100000::DOUBLE / duration::DOUBLE, 6) AS real_time_factor
FROM q JOIN gl USING (part_id) JOIN sp USING (part_id) JOIN ta USING (part_id)""")
def a2(spark, sf):
    cues = ["tion", "que"]
    line = tl.by_position(["part_id"], "seq", 4096)
    runs = _durations(spark, sf).withColumn("elapsed_ms", F.lit(100_000))
    out = rp.asr_quality_report(event_segments(spark, sf, cues), line, v.LOC_LINE, runs, cues, minute=3_600_000)
    return out.withColumn("warnings", v.listed(F.col("warnings")))


@query("a3_low_density_minutes", f"""
WITH {EVENT_SEG_SQL}, dur AS (SELECT part_id, range_end + 3600000 AS duration FROM rng),
mt AS (SELECT part_id, unnest(generate_series(start_ms // 3600000, CAST(ceil(end_ms / 3600000) AS BIGINT) - 1)) AS bucket, length(replace(text_raw, ' ', '')) AS w FROM src WHERE end_ms > 0),
ms AS (SELECT part_id, bucket, CAST(sum(w) AS BIGINT) AS w FROM mt GROUP BY 1, 2),
mc AS (SELECT part_id, unnest(generate_series(0, CAST(ceil(duration / 3600000) AS BIGINT) - 1)) AS bucket FROM dur)
SELECT part_id, bucket, coalesce(w, 0) AS total FROM mc LEFT JOIN ms USING (part_id, bucket) WHERE coalesce(w, 0) < 200""")
def a3(spark, sf):
    d = v.docs(spark, sf).select(F.col("doc_id").alias("_doc"), F.length(F.replace("text", F.lit(" "), F.lit(""))).alias("weight"))
    doc = F.col("event_id") % v.read(spark, sf, "documents").agg(F.max("doc_id") + 1).scalar()
    rows = v.local_intervals(spark, sf).withColumn("_doc", doc).join(d, "_doc")
    return sq.low_density_buckets(rows, _durations(spark, sf), "part_id", "start_ms", "end_ms", F.col("weight"), 3_600_000, 200)


@query("a12_evidence_coverage", f"""
WITH {v.RANGE_SQL}, cl AS (SELECT part_id, event_id, greatest(start_ms - 900000, range_start) AS a, least(start_ms + 900000, range_end) AS b FROM loc JOIN rng USING (part_id)),
{UNION_SQL} SELECT part_id, range_start, range_end, coalesce(covered, 0) AS covered, round(coalesce(covered, 0)::DOUBLE / (range_end - range_start)::DOUBLE, 6) AS visual_ratio,
 round(coalesce(covered, 0)::DOUBLE / (range_end - range_start)::DOUBLE, 6) AS joint_ratio FROM rng LEFT JOIN un USING (part_id)""")
def a12(spark, sf):
    line = tl.by_time(["part_id"], "start_ms", "event_id", v.EVENT_BLOCK_US // 1000)
    return rp.evidence_coverage(v.local_intervals(spark, sf).select("part_id", "event_id", "start_ms"), line, v.job_ranges(spark, sf), "part_id", "start_ms", 900_000)


@query("a12_incremental_ratio", f"""
WITH {v.RANGE_SQL}, s AS (SELECT part_id, sum(end_ms - start_ms) AS s FROM loc GROUP BY part_id)
SELECT part_id, range_start, range_end, round(least(1.0, s::DOUBLE / (range_end - range_start)::DOUBLE), 6) AS teaching_ratio FROM rng JOIN s USING (part_id)""")
def a12_sum(spark, sf):
    return rp.evidence_sum_ratio(v.local_intervals(spark, sf), v.job_ranges(spark, sf), "part_id", "start_ms", "end_ms")
