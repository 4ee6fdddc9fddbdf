"""Queries over data-quality rules (V1-V8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscribe.functions import values as vx
from reelscribe.operators import paragraphs as pg
from reelscribe.operators import rules
from reelscribe.operators import timeline as tl
from reelscribe.plans import views as v
from reelscribe.plans.moment_queries import PACKET_SQL, packets
from reelscribe.plans.paragraph_queries import SESSION_SQL, paragraphs
from reelscribe.plans.registry import query


def _union(ident, source, **conditions):
    return " UNION ALL ".join(f"SELECT '{{t}}' AS \"table\", CAST({ident} AS VARCHAR) AS id, '{rule}' AS rule FROM {source} WHERE {cond}" for rule, cond in conditions.items())


@query("v1_rules_segments", f"""
WITH {v.SEG_SQL}, b AS (SELECT CASE WHEN part_no % 9 = 0 THEN 'X1' ELSE segment_id END AS segment_id, part_id, part_no, seq, start_ms - CASE WHEN part_no % 8 = 0 THEN 1 ELSE 0 END AS start_ms, end_ms - CASE WHEN seq = 2 THEN dur_ms + 1 ELSE 0 END AS end_ms,
  CASE WHEN part_no % 7 = 0 THEN 'radio' ELSE 'uploader' END AS source, CASE WHEN part_no % 6 = 0 AND seq = 0 THEN '' ELSE 'en' END AS language FROM seg)
{_union('segment_id', 'b', bad_id="NOT regexp_matches(segment_id, '^T[0-9]{6,}$')", negative_time='start_ms < 0 OR end_ms < 0', end_before_start='end_ms < start_ms', unknown_source="source = 'radio'", empty_language="language = ''").replace('{t}', 'segments')}
UNION ALL SELECT 'segments', segment_id, 'not_unique' FROM b GROUP BY part_id, segment_id HAVING count(*) > 1 UNION ALL SELECT 'segments', part_id, 'mixed_language' FROM b GROUP BY part_id HAVING min(language) <> max(language)""")
def v1(spark, sf):
    s, n = v.segments(spark, sf), F.col("part_no")
    b = s.withColumns({"segment_id": F.when(n % 9 == 0, "X1").otherwise(F.col("segment_id")), "start_ms": F.col("start_ms") - F.when(n % 8 == 0, 1).otherwise(0),
                       "end_ms": F.col("end_ms") - F.when(F.col("seq") == 2, F.col("dur_ms") + 1).otherwise(0), "source": F.when(n % 7 == 0, "radio").otherwise("uploader"),
                       "language": F.when((n % 6 == 0) & (F.col("seq") == 0), "").otherwise("en")})
    return rules.rules_segments(b)


@query("v2_rules_paragraphs", f"""
WITH RECURSIVE {SESSION_SQL}, p AS (SELECT *, CAST(part_id AS BIGINT) AS n FROM par)
{_union('paragraph_id', 'p', end_not_after_start='n % 5 = 0', too_long='n % 5 <> 0 AND end_ms - start_ms > 60000', repeated_sources='n % 4 = 0', empty_layer='n % 3 = 0').replace('{t}', 'paragraphs')}""")
def v2(spark, sf):
    n = F.col("part_id").cast("long")
    p = paragraphs(spark, sf).withColumns({"end_ms": F.when(n % 5 == 0, F.col("start_ms")).otherwise(F.col("end_ms")), "text_corrected": F.when(n % 3 == 0, " ").otherwise(F.col("text_clean")),
                                           "source_segment_ids": F.when(n % 4 == 0, F.concat("source_segment_ids", F.slice("source_segment_ids", 1, 1))).otherwise(F.col("source_segment_ids"))})
    return rules.rules_paragraphs(p, max_ms=60_000)


@query("v2_rules_sections", """
WITH s AS (SELECT l_orderkey AS section_id, min(l_linenumber) AS a, max(l_linenumber) AS z, count(*) FILTER (WHERE l_returnflag = 'A') AS p, count(*) FILTER (WHERE l_returnflag = 'N') AS e FROM lineitem GROUP BY 1) """
       + _union("section_id", "s", end_not_after_start="z <= a", no_paragraphs="p = 0", no_evidence="e = 0").replace("{t}", "sections"))
def v2_sections(spark, sf):
    l = v.read(spark, sf, "lineitem")
    s = l.groupBy(F.col("l_orderkey").alias("section_id")).agg(F.min("l_linenumber").alias("start_ms"), F.max("l_linenumber").alias("end_ms"),
                                                              F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_partkey"))).alias("paragraph_ids"), F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_partkey"))).alias("evidence_ids"))
    return rules.rules_sections(s)


@query("v3_rules_corrections", """
WITH c AS (SELECT doc_id, quality = 1 AS acc, doc_id % 5 = 0 AS odd, toxic = 1 AS noframe, doc_id % 7 = 0 AS low FROM labels) """
       + _union("printf('C%06d', doc_id)", "c", end_before_start="doc_id % 11 = 0", applied_not_accepted="odd", accepted_without_evidence="acc AND (noframe OR low)").replace("{t}", "corrections"))
def v3(spark, sf):
    lab, n = v.read(spark, sf, "labels"), F.col("doc_id")
    acc = F.col("quality") == 1
    one = F.array(F.lit("x"))
    c = lab.select(F.format_string("C%06d", n).alias("correction_id"), n.alias("start_ms"), (n - F.when(n % 11 == 0, 1).otherwise(0)).alias("end_ms"), F.when(acc, "accepted").otherwise("pending").alias("decision"),
                   (acc != (n % 5 == 0)).alias("applied"), one.alias("transcript_evidence"), F.when(F.col("toxic") == 1, F.array().cast("array<string>")).otherwise(one).alias("visual_evidence"), F.when(n % 7 == 0, "low").otherwise("high").alias("confidence"))
    return rules.rules_corrections(c)


@query("v3_rules_correction_audits", """
WITH c AS (SELECT doc_id, quality = 1 AS sup, toxic = 0 AS kept, doc_id % 2 = 0 AS acc FROM labels) """
       + _union("printf('C%06d', doc_id)", "c", accepted_unsupported="acc AND (NOT sup OR NOT kept)", meaning_changed_not_rejected="NOT kept").replace("{t}", "correction_audits"))
def v3_audits(spark, sf):
    lab, n = v.read(spark, sf, "labels"), F.col("doc_id")
    a = lab.select(F.format_string("C%06d", n).alias("correction_id"), F.when(F.col("quality") == 1, "supported").otherwise("unsupported").alias("assessment"), F.lit(True).alias("evidence_sufficient"),
                   (F.col("toxic") == 0).alias("meaning_preserved"), F.when(n % 2 == 0, "accepted").otherwise("pending").alias("audited_decision"))
    return rules.rules_correction_audits(a)


@query("v4_rules_evidence", """
WITH e AS (SELECT l_orderkey AS evidence_id, count(*) FILTER (WHERE l_returnflag = 'A') AS t, count(*) FILTER (WHERE l_returnflag = 'N') AS f, count(*) FILTER (WHERE l_returnflag = 'R') AS g, l_orderkey % 4 AS k FROM lineitem GROUP BY 1) """
       + _union("evidence_id", "e", end_before_start="evidence_id % 13 = 0", no_source="t = 0 AND f = 0", speech_without_transcript="k <> 1 AND t = 0", slide_without_frame="k > 0 AND f = 0", formula_without_formula="k = 3 AND g = 0").replace("{t}", "evidence"))
def v4(spark, sf):
    l, k = v.read(spark, sf, "lineitem"), F.col("evidence_id")
    ids = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_partkey")))
    e = l.groupBy(F.col("l_orderkey").alias("evidence_id")).agg(ids("A").alias("transcript_ids"), ids("N").alias("frame_ids"), ids("R").alias("formula_ids"))
    kind = F.when(k % 4 == 0, "speech").when(k % 4 == 1, "slide").when(k % 4 == 2, "speech+slide").otherwise("speech+slide+formula")
    return rules.rules_evidence(e.withColumns({"evidence_type": kind, "start_ms": F.lit(1), "end_ms": F.when(k % 13 == 0, 0).otherwise(2)}))


@query("v5_rules_formulas", """
WITH f AS (SELECT doc_id, quality = 1 AS ver, toxic = 1 AS unc, doc_id % 3 = 0 AS hi, doc_id % 4 = 0 AS nolatex, doc_id % 5 = 0 AS hidden, doc_id % 7 AS c FROM labels) """
       + _union("doc_id", "f", verified_without_latex="ver AND nolatex", no_description="doc_id % 17 = 0", high_without_symbols="hi AND (NOT ver OR unc OR hidden)", crop_sets_differ="c = 1", empty_crop_path="c = 2").replace("{t}", "formulas"))
def v5(spark, sf):
    lab, n = v.read(spark, sf, "labels"), F.col("doc_id")
    crop = F.when(n % 7 == 2, F.array(F.lit(""))).otherwise(F.array(F.lit("a")))
    f = lab.select(n.alias("formula_id"), F.when(F.col("quality") == 1, "verified").otherwise("needs_review").alias("verification_status"), F.when(n % 4 == 0, "").otherwise("x").alias("latex"),
                   F.when(n % 17 == 0, "").otherwise("seen").alias("visual_transcription"), F.when(n % 3 == 0, "high").otherwise("low").alias("confidence"),
                   F.when(F.col("toxic") == 1, F.array(F.lit("?"))).otherwise(F.array().cast("array<string>")).alias("uncertain_symbols"), F.create_map(F.lit("sum"), n % 5 != 0).alias("key_symbols"),
                   crop.alias("crop_paths"), F.when(n % 7 == 1, F.array(F.lit("b"))).otherwise(crop).alias("crop_regions"))
    return rules.rules_formulas(f)


@query("v6_rules_frames", """
WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS u FROM pages), f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN u WHEN 1 THEN 'a/../b' ELSE substr(u, 2) END AS path FROM p) """
       + _union("page_id", "f", absolute_path="starts_with(path, '/')", path_leaves_job="list_contains(string_split(path, '/'), '..')", no_reason="page_id % 6 = 0", score_out_of_range="page_id % 5 = 0",
                ratio_out_of_range="page_id % 7 = 0", bad_size="page_id % 8 = 0", negative_time="page_id % 9 = 0").replace("{t}", "frames"))
def v6(spark, sf):
    p, n = v.read(spark, sf, "pages"), F.col("page_id")
    u = F.regexp_replace("url", "^https?://[^/]*", "")
    f = p.select(n.alias("frame_id"), F.when(n % 4 == 0, u).when(n % 4 == 1, "a/../b").otherwise(F.substr(u, F.lit(2))).alias("path"), F.when(n % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("periodic"))).alias("reason"),
                 F.when(n % 5 == 0, 1.5).alias("scene_score"), F.when(n % 7 == 0, -0.1).otherwise(0.5).alias("black_ratio"), F.when(n % 8 == 0, 0).otherwise(10).alias("width"), F.lit(5).alias("height"),
                 F.when(n % 9 == 0, -1).otherwise(1).alias("timestamp_ms"))
    return rules.rules_frames(f)


@query("v6_rules_media", """
WITH m AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/', '') AS u FROM pages) """
       + _union("page_id", "m", end_not_after_start="page_id % 3 = 0", missing_path="page_id % 4 = 0 AND page_id % 2 = 0", path_leaves_job="page_id % 4 <> 0 AND page_id % 5 = 0").replace("{t}", "media"))
def v6_media(spark, sf):
    p, n = v.read(spark, sf, "pages"), F.col("page_id")
    u = F.regexp_replace("url", "^https?://[^/]*/", "")
    m = p.select(n.alias("media_id"), F.lit(5).alias("requested_start"), F.when(n % 3 == 0, 5).when(n % 3 == 1, 9).alias("requested_end"), F.when(n % 2 == 0, "job_local").otherwise("external_local").alias("storage"),
                 F.when(n % 4 == 0, "").when(n % 5 == 0, F.concat(F.lit("../"), u)).otherwise(u).alias("media_path"))
    return rules.rules_media(m)


@query("v7_rules_packets", f"""
WITH {PACKET_SQL}, q AS (SELECT *, CAST(job_id AS VARCHAR) || '/' || packet_id AS id, CASE WHEN packet_no % 5 = 0 THEN primary_end + 1 ELSE primary_end END AS pe, lag(CASE WHEN packet_no % 5 = 0 THEN primary_end + 1 ELSE primary_end END) OVER (PARTITION BY job_id ORDER BY packet_no) AS lp FROM pk)
{_union('id', 'q', primary_outside_packet='pe > context_end', hash_differs='packet_no % 6 = 0', gap_between_packets='primary_start <> lp', too_many_frames='packet_no % 8 = 7', id_is_frozen='packet_no <= 2 AND job_id % 10 = 0').replace('{t}', 'packets')}""")
def v7(spark, sf):
    n = F.col("packet_no")
    p = packets(spark, sf).withColumns({"primary_end": F.when(n % 5 == 0, F.col("primary_end") + 1).otherwise(F.col("primary_end")), "frame_count": n % 8})
    # Hashed with all their members; afterwards the members of every sixth packet are others.
    rows = v.local_intervals(spark, sf).withColumnRenamed("part_id", "job_id")
    p = pg.packet_summary(p, pg.packet_rows(p, rows, "job_id", "start_ms", "end_ms", v.EVENT_BLOCK_US // 1000), "job_id", "event_id")
    payload = ["job_id", "packet_id", "primary_start", "primary_end", "context_start", "context_end", "row_count", "member_digest"]
    p = p.withColumn("packet_hash", vx.row_fingerprint(payload)).withColumn("member_digest", F.when(n % 6 == 0, F.reverse("member_digest")).otherwise(F.col("member_digest")))
    frozen = packets(spark, sf).filter("packet_no <= 2 AND job_id % 10 = 0")
    return rules.rules_packets(p, tl.by_position(["job_id"], "packet_no"), payload, frozen)


@query("v8_rules_observations", """
WITH o AS (SELECT event_id, event_id % 9001 AS observation_id, user_id, event_type FROM events) SELECT 'observations' AS "table", CAST(observation_id AS VARCHAR) AS id, 'not_opened' AS rule FROM o WHERE event_id % 50 = 0
UNION ALL SELECT 'observations', CAST(observation_id AS VARCHAR), 'unknown_frame' FROM o WHERE event_type <> 'click' AND user_id % 10 = 0
UNION ALL SELECT 'observations', CAST(observation_id AS VARCHAR), 'registry_mismatch' FROM o WHERE event_type <> 'click' AND user_id % 10 <> 0 AND event_id % 40 = 0
UNION ALL SELECT 'observations', CAST(observation_id AS VARCHAR), 'not_unique' FROM o GROUP BY observation_id HAVING count(*) > 1
UNION ALL SELECT 'registry', CAST(u AS VARCHAR), 'not_observed' FROM (SELECT DISTINCT user_id AS u FROM events WHERE user_id % 10 <> 0 EXCEPT SELECT user_id FROM events WHERE event_type = 'view')
UNION ALL SELECT 'registry', CAST(u AS VARCHAR), 'not_a_final_frame' FROM (SELECT DISTINCT user_id AS u FROM events WHERE event_type = 'view' AND user_id % 10 = 0)
UNION ALL SELECT 'observations', 'all', 'duplicate_control_not_linked' FROM (SELECT count(*) FILTER (WHERE event_type = 'error' AND event_id < 0) AS n FROM events) WHERE n = 0""")
def v8(spark, sf):
    e, n = v.read(spark, sf, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "crop").when(F.col("event_type") == "view", "final_frame").when(F.col("event_type") == "error", "duplicate_control").otherwise("black_control")
    path = F.concat(F.lit("frames/"), F.col("user_id").cast("string"))
    obs = e.select((n % 9001).alias("observation_id"), F.col("user_id").alias("frame_id"), path.alias("image_path"), F.when(n % 40 == 0, "bad").otherwise("sha").alias("sha256"), kind.alias("image_kind"),
                   (n % 50 != 0).alias("opened"), F.lit(None).cast("string").alias("duplicate_of"))
    registry = e.filter("user_id % 10 <> 0").select(F.col("user_id").alias("frame_id"), path.alias("image_path"), F.lit("sha").alias("sha256"), F.lit(True).alias("is_final")).distinct()
    return rules.rules_observations(obs, registry)
