"""Queries over sources (S1-S8, J1, A17) and exports (K1-K4, K6). File contents are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscribe.functions import text as tx
from reelscribe.functions import values as vx
from reelscribe.operators import reports as rp
from reelscribe.operators import timeline as tl
from reelscribe.plans import views as v
from reelscribe.plans.registry import query
from reelscribe.sources import catalog as cat
from reelscribe.sources import subtitles as sub
from reelscribe.sources import writers as wr
from reelscribe import schemas

CHUNK = 4
_CHUNKED_SQL = f"SELECT part_id || '-' || CAST(seq // {CHUNK} AS VARCHAR) AS part_id, seq % {CHUNK} AS seq, start_ms, end_ms"
# Texts hold no blank lines of their own in a cue: runs of line ends become one.
_CUE_TEXT_SQL = "trim(regexp_replace(text_raw, '\\n+', chr(10), 'g'), chr(10))"


def _cue_segments(spark, sf):
    s = v.segments(spark, sf)
    return s.withColumn("text_raw", F.regexp_replace(F.regexp_replace("text_raw", "\n+", "\n"), "^\n|\n$", ""))


def _files(chunks, fmt, prefix="", suffix=""):
    name = F.concat_ws("-", "part_id", F.col("chunk").cast("string"))
    return chunks.select(name.alias("part_id"), F.lit(fmt).alias("format"), F.concat(F.lit(prefix), F.col("body"), F.lit(suffix)).alias("content"))


def srt_files(spark, sf):
    return _files(wr.render_srt(_cue_segments(spark, sf), "text_raw", CHUNK), "srt", "﻿", "\r\n")


def vtt_files(spark, sf):
    chunks = wr.render_vtt(_cue_segments(spark, sf), "text_raw", CHUNK)
    body = F.when(F.col("chunk") == 0, F.col("body")).otherwise(F.concat(F.lit("WEBVTT\nX: 1\n\nNOTE skipped\n\n"), F.col("body")))
    return _files(chunks.withColumn("body", body), "vtt", "", "\n")


def json_files(spark, sf):
    s = v.segments(spark, sf)
    item = F.struct("seq", F.struct((F.col("start_ms") / 1000).alias("from"), (F.col("end_ms") / 1000).alias("to"), F.col("text_raw").alias("content")).alias("cue"))
    grouped = s.groupBy("part_id", F.floor(F.col("seq") / CHUNK).cast("long").alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["cue"]).alias("body"))
    return _files(grouped.withColumn("body", F.to_json(F.struct(F.lit(0.4).alias("font_size"), "body"))), "json", "﻿")


@query("s1_read_subtitle_json", f"WITH {v.SEG_SQL} {_CHUNKED_SQL}, text_raw, NULL AS reject_reason FROM seg")
def s1(spark, sf):
    return sub.parse_subtitle_json(json_files(spark, sf))


@query("s2_read_srt", f"WITH {v.SEG_SQL} {_CHUNKED_SQL}, {_CUE_TEXT_SQL} AS text_raw, NULL AS reject_reason FROM seg")
def s2(spark, sf):
    return sub.parse_srt(srt_files(spark, sf))


@query("s3_read_vtt", f"WITH {v.SEG_SQL} SELECT part_id || '-' || CAST(seq // {CHUNK} AS VARCHAR) AS part_id, start_ms, end_ms, {_CUE_TEXT_SQL} AS text_raw, NULL AS reject_reason FROM seg")
def s3(spark, sf):
    return sub.parse_vtt(vtt_files(spark, sf)).drop("seq")


@query("s4_read_untimed_text", f"SELECT CAST(doc_id AS VARCHAR) AS part_id, false AS timed, CAST(NULL AS BIGINT) AS start_ms, CAST(NULL AS BIGINT) AS end_ms, text AS text_raw, {v.sql_clean('text')} AS text_clean FROM documents")
def s4(spark, sf):
    return sub.parse_untimed_text(v.docs(spark, sf).select(F.col("doc_id").cast("string").alias("part_id"), F.concat(F.lit("﻿"), "text").alias("content")))


@query("s5_route_by_format", f"""
WITH {v.SEG_SQL}, c AS (SELECT part_id || '-' || CAST(seq // {CHUNK} AS VARCHAR) AS part_id, start_ms, end_ms, text_raw AS raw, {_CUE_TEXT_SQL} AS cue FROM seg)
SELECT part_id, 'json' AS kind, start_ms, end_ms, raw AS text_raw, true AS timed, NULL AS reject_reason FROM c UNION ALL SELECT part_id, 'srt', start_ms, end_ms, cue, true, NULL FROM c UNION ALL SELECT part_id, 'vtt', start_ms, end_ms, cue, true, NULL FROM c
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'txt', NULL, NULL, text, false, NULL FROM documents UNION ALL SELECT CAST(page_id AS VARCHAR), 'html', NULL, NULL, NULL, NULL, 'unsupported_format' FROM pages""")
def s5(spark, sf):
    docs = v.docs(spark, sf).select(F.col("doc_id").cast("string").alias("part_id"), F.lit("txt").alias("format"), F.col("text").alias("content"))
    pages = v.read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("part_id"), F.lit("html").alias("format"), F.col("html").alias("content"))
    files = json_files(spark, sf).unionByName(srt_files(spark, sf)).unionByName(vtt_files(spark, sf)).unionByName(docs).unionByName(pages)
    tagged = files.withColumn("part_id", F.concat_ws("/", "format", "part_id"))
    out = sub.parse_by_format(tagged)
    return out.select(F.substring_index("part_id", "/", -1).alias("part_id"), F.substring_index("part_id", "/", 1).alias("kind"), "start_ms", "end_ms", "text_raw", "timed", "reject_reason")


def view_responses(spark, sf):
    """One archived catalogue response per order, its lines as video parts; some fail."""
    l = v.read(spark, sf, "lineitem")
    page = F.struct(F.col("l_partkey").alias("cid"), F.col("l_linenumber").cast("long").alias("page"), F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("part "), F.col("l_suppkey").cast("string"))).alias("part"),
                    F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity")).alias("duration"))
    grouped = l.groupBy("l_orderkey").agg(F.collect_list(page).alias("pages"))
    bv = F.concat(F.lit("BV"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0"))
    data = F.when(F.col("l_orderkey") % 11 != 0, F.struct(bv.alias("bvid"), F.col("l_orderkey").alias("aid"), F.lit(1_700_000_000).alias("pubdate"), "pages"))
    code = F.when(F.col("l_orderkey") % 11 == 0, -404).otherwise(0)
    return grouped.select(F.to_json(F.struct(code.alias("code"), F.lit("m").alias("message"), data.alias("data"))).alias("content"))


@query("s6_explode_parts", """
SELECT 'BV' || printf('%010d', l_orderkey) || '-p' || CAST(l_linenumber AS VARCHAR) AS part_id, CAST(l_linenumber AS BIGINT) AS page, l_partkey AS cid, CASE WHEN l_suppkey % 3 = 0 THEN 'P' || CAST(l_linenumber AS VARCHAR) ELSE 'part ' || CAST(l_suppkey AS VARCHAR) END AS title,
 CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END AS duration, 'BV' || printf('%010d', l_orderkey) AS bvid, l_orderkey AS aid, 1700000000 AS published_at, NULL AS reject_reason FROM lineitem WHERE l_orderkey % 11 <> 0
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'api_error' FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 11 = 0)""")
def s6(spark, sf):
    return cat.explode_parts(view_responses(spark, sf))


def player_responses(spark, sf):
    """One archived track list per part: suppliers of the part's lines as tracks, some without url, some from a foreign host."""
    l = v.read(spark, sf, "lineitem")
    k = F.col("l_suppkey") % 6
    url = F.when(k == 0, "").when(k == 1, "https://evil.example.com/x").otherwise(F.concat(F.lit("//i0.hdslb.com/bfs/"), F.col("l_suppkey").cast("string")))
    lan = F.when(F.col("l_returnflag") == "A", "ai-zh").when(F.col("l_returnflag") == "N", "zh-CN").otherwise("en")
    track = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("x"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))).alias("id_str"),
                     lan.alias("lan"), F.when(F.col("l_linenumber") == 3, "English (AI)").otherwise("human").alias("lan_doc"), url.alias("subtitle_url"),
                     F.when(F.col("l_linenumber") == 5, 1).otherwise(0).alias("ai_type"))
    grouped = l.groupBy(F.col("l_partkey").alias("p")).agg(F.collect_list(track).alias("subtitles"))
    body = F.struct(F.lit(0).alias("code"), F.struct((F.col("p") % 2 == 0).alias("need_login_subtitle"), F.struct("subtitles").alias("subtitle")).alias("data"))
    return grouped.select(F.concat(F.lit("part"), F.col("p").cast("string")).alias("part_id"), F.to_json(body).alias("content"))


_UPSTREAM_SQL = "CASE WHEN l_linenumber % 2 = 0 THEN 'x' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) ELSE CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) END"
CANDIDATE_SQL = f"""
cd AS (SELECT 'part' || CAST(l_partkey AS VARCHAR) AS part_id, 'part' || CAST(l_partkey AS VARCHAR) || '-s' || substr(sha256('{{"id":"' || {_UPSTREAM_SQL} || '","part":"part' || CAST(l_partkey AS VARCHAR) || '"}}'), 1, 16) AS candidate_id,
 CASE WHEN l_returnflag = 'A' OR l_linenumber IN (3, 5) THEN 'bilibili_ai' ELSE 'uploader' END AS source, CASE l_returnflag WHEN 'A' THEN 'ai-zh' WHEN 'N' THEN 'zh-CN' ELSE 'en' END AS language,
 CASE WHEN l_linenumber = 3 THEN 'English (AI)' ELSE 'human' END AS language_name, CASE WHEN l_suppkey % 6 = 1 THEN 'https://evil.example.com/x' ELSE 'https://i0.hdslb.com/bfs/' || CAST(l_suppkey AS VARCHAR) END AS subtitle_url,
 l_partkey % 2 = 0 AS need_login, CASE WHEN l_suppkey % 6 = 1 THEN 'untrusted_host' END AS reject_reason FROM lineitem WHERE l_suppkey % 6 <> 0)"""


@query("s7_explode_candidates", f"WITH {CANDIDATE_SQL} SELECT * FROM cd")
def s7(spark, sf):
    return cat.explode_candidates(player_responses(spark, sf))


_SELECT_SQL = CANDIDATE_SQL + """,
ok AS (SELECT *, CASE source WHEN 'uploader' THEN 0 ELSE 1 END AS sr, CASE lower(language) WHEN 'zh-cn' THEN 0 WHEN 'en' THEN 1 ELSE 2 END AS lr FROM cd WHERE reject_reason IS NULL AND source || CAST(length(part_id) % 2 AS VARCHAR) <> 'uploader1'),
b AS (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY sr, lr, candidate_id) AS rn, count(*) OVER (PARTITION BY part_id) AS n FROM ok),
sel AS (SELECT 'part' || CAST(p_partkey AS VARCHAR) AS part_id, p_partkey % 2 = 0 AS need_login, candidate_id AS selected_candidate_id, source AS selected_source, language AS selected_language, coalesce(n, 0) AS candidate_count,
 CASE source WHEN 'uploader' THEN 'uploader_subtitle_preferred' WHEN 'bilibili_ai' THEN 'bilibili_ai_used_no_uploader_subtitle' ELSE 'no_subtitles_available' END AS reason
 FROM part LEFT JOIN b ON b.part_id = 'part' || CAST(p_partkey AS VARCHAR) AND rn = 1)"""


def selection(spark, sf):
    parts = v.read(spark, sf, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("part_id"), (F.col("p_partkey") % 2 == 0).alias("need_login"))
    found = cat.explode_candidates(player_responses(spark, sf)).filter("reject_reason IS NULL")
    found = found.filter(~((F.col("source") == "uploader") & (F.length("part_id") % 2 == 1)))
    return cat.select_best_candidate(parts, found, ["zh-CN", "en"])


@query("j1_select_best_candidate", f"WITH {_SELECT_SQL} SELECT * FROM sel")
def j1(spark, sf):
    return selection(spark, sf)


@query("a17_availability_classes", f"WITH {_SELECT_SQL} SELECT CASE WHEN selected_source = 'uploader' THEN 'A' WHEN selected_source = 'bilibili_ai' THEN 'B' WHEN need_login THEN 'E' ELSE 'D' END AS class, count(*) AS parts FROM sel GROUP BY 1")
def a17(spark, sf):
    return selection(spark, sf).groupBy(cat.availability_class(F.col("selected_source"), F.col("need_login")).alias("class")).agg(F.count(F.lit(1)).alias("parts"))


@query("s8_read_records_jsonl", """
SELECT o_orderkey AS part_seq, CASE WHEN o_orderkey % 13 = 0 THEN 'unsupported_version' WHEN o_orderkey % 17 = 0 THEN 'unknown_field' WHEN o_orderkey % 19 = 0 THEN 'not_an_object' END AS reject_reason,
 CASE WHEN o_orderkey % 19 = 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 THEN NULL ELSE o_orderstatus END AS status FROM orders WHERE NOT (o_orderkey % 19 = 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0)
UNION ALL SELECT NULL, 'not_an_object', NULL FROM orders WHERE o_orderkey % 19 = 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0""")
def s8(spark, sf):
    o, k = v.read(spark, sf, "orders"), F.col("o_orderkey")
    version = F.when(k % 13 == 0, "2.1.0").otherwise("1.4.0")
    plain = F.to_json(F.struct(k.alias("part_seq"), F.col("o_orderstatus").alias("status"), version.alias("schema_version")))
    extra = F.to_json(F.struct(k.alias("part_seq"), F.col("o_orderstatus").alias("status"), version.alias("schema_version"), F.lit(1).alias("surprise")))
    line = F.when(k % 17 == 0, extra).when((k % 19 == 0) & (k % 13 != 0), F.lit("[broken")).otherwise(plain)
    return sub.parse_records(o.select(line.alias("value")), schemas.struct("part_seq bigint, status string"), "1")


@query("s8_wrong_types", """
SELECT o_orderkey AS order_no, CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE 'wrong_type' END AS reject_reason FROM orders""")
def s8_types(spark, sf):
    """A text for a number, a number for a text, a list with a text for numbers; every fourth line is right."""
    o, k = v.read(spark, sf, "orders"), F.col("o_orderkey")
    text = k.cast("string")
    line = (F.when(k % 4 == 0, F.concat(F.lit('{"part_seq":'), text, F.lit(',"status":null,"marks":[1,2]}')))
            .when(k % 4 == 1, F.concat(F.lit('{"part_seq":"'), text, F.lit('","status":"x","marks":[]}')))
            .when(k % 4 == 2, F.concat(F.lit('{"part_seq":'), text, F.lit(',"status":7,"marks":[]}')))
            .otherwise(F.concat(F.lit('{"part_seq":'), text, F.lit(',"status":"x","marks":["1"]}'))))
    number = F.regexp_extract("value", '"part_seq":"?([0-9]+)', 1).cast("long")
    return sub.parse_records(o.select(line.alias("value")), schemas.struct("part_seq bigint, status string, marks array<bigint>"), "1", keep=["value"]).select(number.alias("order_no"), "reject_reason")


@query("k1_write_segments_jsonl", f"""
WITH {v.SEG_SQL} SELECT '{{"end_ms":' || CAST(end_ms AS VARCHAR) || ',"part_id":"' || part_id || '","schema_version":"1.0.0","segment_id":"' || segment_id || '","speaker":"' || speaker || '","start_ms":' || CAST(start_ms AS VARCHAR) || ',"text_raw":' || CAST(to_json(text_raw) AS VARCHAR) || '}}' AS value FROM seg""")
def k1(spark, sf):
    return sub.records_table(v.segments(spark, sf), ["part_id", "segment_id", "speaker", "start_ms", "end_ms", "text_raw"])


def _clean(spark, sf):
    return v.segments(spark, sf).withColumn("text_clean", tx.clean_text(F.col("text_raw")))


def _render_sql(cue, separator, header=""):
    return f"""WITH {v.SEG_SQL}, c AS (SELECT *, {v.sql_clean('text_raw')} AS text_clean FROM seg)
SELECT part_id, seq // {CHUNK} AS chunk, {header}string_agg({cue}, {separator} ORDER BY seq) AS body FROM c GROUP BY part_id, seq // {CHUNK}"""


@query("k2_render_srt", _render_sql(f"CAST(seq + 1 AS VARCHAR) || chr(10) || {v.sql_timecode('start_ms', ',')} || ' --> ' || {v.sql_timecode('end_ms', ',')} || chr(10) || text_clean", "chr(10) || chr(10)"))
def k2(spark, sf):
    return wr.render_srt(_clean(spark, sf), rows=CHUNK)


@query("k3_render_vtt", _render_sql(f"segment_id || chr(10) || {v.sql_timecode('start_ms')} || ' --> ' || {v.sql_timecode('end_ms')} || chr(10) || text_clean", "chr(10) || chr(10)",
                                    f"CASE WHEN seq // {CHUNK} = 0 THEN 'WEBVTT' || chr(10) || chr(10) ELSE '' END || "))
def k3(spark, sf):
    return wr.render_vtt(_clean(spark, sf), rows=CHUNK)


def _untimed(spark, sf):
    """Every document as an untimed part of one row."""
    none = F.lit(None).cast("long")
    return v.docs(spark, sf).select(F.col("doc_id").cast("string").alias("part_id"), F.lit(0).cast("long").alias("seq"), none.alias("start_ms"), none.alias("end_ms"),
                                    F.lit("UNTIMED").alias("segment_id"), F.col("text").alias("text_raw"), F.col("text").alias("text_clean"))


@query("k2_untimed_srt", "SELECT CAST(doc_id AS VARCHAR) AS part_id, 0 AS chunk, '' AS body FROM documents")
def k2_untimed(spark, sf):
    return wr.render_srt(_untimed(spark, sf), rows=CHUNK)


@query("k3_untimed_vtt", "SELECT CAST(doc_id AS VARCHAR) AS part_id, 0 AS chunk, 'WEBVTT' AS body FROM documents")
def k3_untimed(spark, sf):
    return wr.render_vtt(_untimed(spark, sf), rows=CHUNK)


@query("a1_untimed_parts", f"""
SELECT CAST(doc_id AS VARCHAR) AS part_id, length(regexp_replace(text, '{v.SQL_WS}+', '', 'g')) AS character_count, NULL AS duration, NULL AS coverage_ratio, 0 AS long_count,
 CASE WHEN regexp_matches(text, '{tx.GARBLED}') THEN 1 ELSE 0 END AS garbled_count, 'untimed_transcript' || CASE WHEN regexp_matches(text, '{tx.GARBLED}') THEN '|suspicious_garbled_text' ELSE '' END AS warnings FROM documents""")
def a1_untimed(spark, sf):
    out = rp.transcript_quality_report(_untimed(spark, sf), tl.by_position(["part_id"]), tl.by_time(["part_id"], "start_ms", "seq", 3_600_000))
    return out.select("part_id", "character_count", "duration", "coverage_ratio", "long_count", "garbled_count", v.listed(F.col("warnings")).alias("warnings"))


@query("k4_render_txt", _render_sql(f"'[' || {v.sql_timecode('start_ms')} || ' - ' || {v.sql_timecode('end_ms')} || '] ' || text_clean", "chr(10)"))
def k4(spark, sf):
    return wr.render_txt(_clean(spark, sf), rows=CHUNK)


_WORDS_SQL = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query("k6_build_content_manifest", f"""
WITH h AS (SELECT o_orderstatus, sha256('{{"cents":' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) || ',"o_custkey":' || CAST(o_custkey AS VARCHAR) || ',"o_orderkey":' || CAST(o_orderkey AS VARCHAR)
  || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '","ordered_us":' || CAST(epoch_us(o_orderdate) AS VARCHAR) || '}}') AS h FROM orders)
SELECT o_orderstatus, count(*) AS row_count, sha256(CAST(count(*) AS VARCHAR) || ':' || {_WORDS_SQL}) AS digest FROM h GROUP BY 1""")
def k6(spark, sf):
    return wr.build_content_manifest(v.order_rows(spark, sf), ["o_orderstatus"], v.ORDER_COLUMNS)
