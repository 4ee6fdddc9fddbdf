"""Queries over text and value expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscribe.functions import text as tx
from reelscribe.functions import urls
from reelscribe.functions import values as vx
from reelscribe.operators import ranges as rg
from reelscribe.operators import reports as rp
from reelscribe.plans import views as v
from reelscribe.plans.registry import query


@query("p1_clean_text", f"SELECT doc_id, {v.sql_clean('text')} AS text_clean FROM documents")
def p1(spark, sf):
    return v.docs(spark, sf).select("doc_id", tx.clean_text(F.col("text")).alias("text_clean"))


def _sql_readable(text):
    out = f"replace(replace(translate({text}, ',;:', '，；：'), ' ', ''), chr(9), '')"
    for c in "，。！？；：":
        out = f"regexp_replace({out}, '{c}+', '{c}', 'g')"
    return f"regexp_replace({out}, '^{v.SQL_WS}+|{v.SQL_WS}+$', '', 'g')"


@query("p2_normalize_readable", f"SELECT doc_id, {_sql_readable('text')} AS readable FROM documents")
def p2(spark, sf):
    return v.docs(spark, sf).select("doc_id", tx.normalize_readable(F.col("text")).alias("readable"))


@query("p3_flag_garbled", f"SELECT doc_id, regexp_matches(text, '{tx.GARBLED}') AS garbled FROM documents")
def p3(spark, sf):
    return v.docs(spark, sf).select("doc_id", tx.is_garbled(F.col("text")).alias("garbled"))


_SECRETS = "\nAuthorization: Bearer x\nset-cookie: a=b\nsee https://u:p@Host.example:8080/a?token=1&q=2#f and api_key = 'zz'"
_INLINE_SQL = "'(?i)" + tx.INLINE_SECRET.replace("'", "''") + "'"
_URL_SQL = "'(?i)" + tx.URL_IN_TEXT.replace("'", "''") + "'"


def _sql_inline(text):
    return f"regexp_replace({text}, {_INLINE_SQL}, '\\1\\2\\3\\4\\5{tx.MASK}\\7', 'g')"


def _sql_pairs(query_text):
    keys = "|".join(tx.SENSITIVE_KEYS)
    sensitive = f"regexp_matches(replace(lower(split_part(p, '=', 1)), '-', '_'), '^({keys})$|(_token|_secret|_key)$')"
    return (f"array_to_string(list_transform(list_filter(string_split({query_text}, '&'), lambda p: p <> ''), lambda p: "
            f"split_part(p, '=', 1) || '=' || CASE WHEN {sensitive} THEN '%3Credacted%3E' ELSE regexp_replace(p, '^[^=]*=?', '') END), '&')")


def _sql_sanitize(url):
    shape = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:[?]([^#]*))?'"
    pairs = _sql_pairs(f"regexp_extract({url}, {shape}, 4)")
    return (f"lower(regexp_extract({url}, {shape}, 1)) || '://' || lower(regexp_replace(regexp_extract({url}, {shape}, 2), '^.*@', '')) || "
            f"regexp_extract({url}, {shape}, 3) || CASE WHEN {pairs} <> '' THEN '?' || {pairs} ELSE '' END")


@query("p4_redact_text", f"""
WITH a AS (SELECT doc_id, text || '{_SECRETS.replace("'", "''")}' AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?im){tx.AUTH_LINE}', '\\1{tx.MASK}', 'g'), '(?im){tx.COOKIE_LINE}', '\\1{tx.MASK}', 'g') AS t FROM a),
c AS (SELECT doc_id, t, string_split_regex(t, {_URL_SQL}) AS between_, regexp_extract_all(t, {_URL_SQL}) AS urls_ FROM b),
d AS (SELECT doc_id, array_to_string(list_transform(list_zip(between_, list_append(list_transform(urls_, lambda u: {_sql_sanitize('u')}), '')), lambda z: z[1] || z[2]), '') AS t FROM c)
SELECT doc_id, {_sql_inline('t')} AS redacted FROM d""")
def p4(spark, sf):
    rows = v.docs(spark, sf).select("doc_id", F.concat("text", F.lit(_SECRETS)).alias("t"))
    return rows.select("doc_id", tx.redact_text(F.col("t")).alias("redacted"))


_DIRTY_SQL = """regexp_replace(url, '^(https?://)([^#]*)(#.*)?$', '\\1user:pw@\\2') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'access_token=t' || CAST(page_id AS VARCHAR) || '&X-Api-Key=k&empty=#frag'"""


def _dirty_urls(spark, sf):
    base = F.regexp_replace("url", "^(https?://)([^#]*)(#.*)?$", "$1user:pw@$2")
    mark = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    url = F.concat(base, mark, F.lit("access_token=t"), F.col("page_id").cast("string"), F.lit("&X-Api-Key=k&empty=#frag"))
    return v.read(spark, sf, "pages").select("page_id", "url", url.alias("dirty"))


@query("p5_sanitize_url", f"WITH d AS (SELECT page_id, {_DIRTY_SQL} AS u FROM pages) SELECT page_id, {_sql_sanitize('u')} AS safe_url FROM d")
def p5(spark, sf):
    return _dirty_urls(spark, sf).select("page_id", urls.sanitize_url(F.col("dirty")).alias("safe_url"))


@query("p6_redact_nested", """
SELECT event_id, json_extract_string(props, '$.k') AS kept, '<redacted>' AS map_secret, '<redacted>' AS struct_secret,
       'user=' || CAST(user_id AS VARCHAR) || ' token=<redacted>' AS inner_text FROM events""")
def p6(spark, sf):
    e = v.read(spark, sf, "events")
    note = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(" token="), F.col("event_type"))
    props = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("Refresh-Token"), F.col("event_type")))
    nested = F.struct(props.alias("props"), F.struct(F.col("event_type").alias("api_key"), F.array(note).alias("notes")).alias("meta"))
    out = vx.redact_nested(e.select("event_id", nested.alias("payload")), ["payload"])
    return out.select("event_id", F.col("payload.props")["k"].alias("kept"), F.col("payload.props")["Refresh-Token"].alias("map_secret"),
                      F.col("payload.meta.api_key").alias("struct_secret"), F.col("payload.meta.notes")[0].alias("inner_text"))


@query("p7_timecodes", f"WITH {v.SEG_SQL} SELECT segment_id, {v.sql_timecode('start_ms', ',')} AS code, start_ms AS parsed, CAST(NULL AS BIGINT) AS bad FROM seg")
def p7(spark, sf):
    s = v.segments(spark, sf).withColumn("code", vx.ms_to_timecode(F.col("start_ms"), ","))
    bad = F.regexp_replace("code", "^([0-9]+):[0-9]{2}", "$1:60")
    return s.select("segment_id", "code", vx.timecode_to_ms(F.col("code")).alias("parsed"), vx.timecode_to_ms(bad).alias("bad"))


_CUES = ["tion", "que", "the", "en ", "sch"]
_CUE_ARRAY = "[" + ", ".join(f"'{c}'" for c in _CUES) + "]"


def _sql_matches(text, pattern):
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all({text}, '{pattern}'))), '|')"


@query("p8_term_candidates", f"""
SELECT doc_id, {_sql_matches('text', tx.LATIN_TOKEN)} AS latin, {_sql_matches('text', tx.NUMBER_OR_SYMBOL)} AS symbols,
       array_to_string(list_filter({_CUE_ARRAY}, lambda c: contains(text, c)), '|') AS cues, 'pending' AS decision
FROM documents
WHERE regexp_matches(text, '{tx.LATIN_TOKEN}') OR regexp_matches(text, '{tx.NUMBER_OR_SYMBOL}') OR len(list_filter({_CUE_ARRAY}, lambda c: contains(text, c))) > 0""")
def p8(spark, sf):
    out = rp.term_candidates(v.docs(spark, sf), "text", _CUES)
    return out.select("doc_id", v.listed(F.col("latin")).alias("latin"), v.listed(F.col("symbols")).alias("symbols"), v.listed(F.col("cues")).alias("cues"), "decision")


@query("p8_cue_totals", f"""
SELECT c AS cue, CAST(sum((length(text) - length(replace(text, c, ''))) // length(c)) AS BIGINT) AS total
FROM documents, (SELECT unnest({_CUE_ARRAY}) AS c) GROUP BY c""")
def p8_totals(spark, sf):
    return rp.cue_totals(v.docs(spark, sf), "text", _CUES)


@query("p9_filter_time_range", f"WITH {v.LOC_SQL} SELECT event_id, start_ms, end_ms FROM loc WHERE end_ms >= 600000000 AND start_ms <= 1200000000")
def p9(spark, sf):
    return rg.filter_time_range(v.local_intervals(spark, sf), 600_000_000, 1_200_000_000).select("event_id", "start_ms", "end_ms")


@query("p10_clip_to_range", f"""
WITH {v.LOC_SQL} SELECT event_id, start_ms AS raw_start, end_ms AS raw_end, greatest(start_ms, 600000000) AS start_ms, least(end_ms, 1200000000) AS end_ms,
 start_ms < 600000000 OR end_ms > 1200000000 AS range_boundary_clipped FROM loc
WHERE start_ms >= 600000000 - 3600000 AND end_ms >= start_ms AND start_ms < 1200000000""")
def p10(spark, sf):
    kept, _ = rg.clip_to_range(v.local_intervals(spark, sf), 600_000_000, 1_200_000_000, slack=3_600_000)
    return kept.select("event_id", "raw_start", "raw_end", "start_ms", "end_ms", "range_boundary_clipped")


@query("p10_rejected_rows", f"WITH {v.LOC_SQL} SELECT event_id, start_ms, end_ms FROM loc WHERE start_ms < 600000000 - 3600000 OR end_ms < start_ms")
def p10_rejected(spark, sf):
    _, bad = rg.clip_to_range(v.local_intervals(spark, sf), 600_000_000, 1_200_000_000, slack=3_600_000)
    return bad.select("event_id", "start_ms", "end_ms")


@query("p11_shift_to_absolute_time", f"WITH {v.SEG_SQL} SELECT segment_id, start_ms + 1498000 AS start_ms, end_ms + 1498000 AS end_ms, segment_id AS local_id, '1498000' AS offset_text FROM seg")
def p11(spark, sf):
    s = v.segments(spark, sf).withColumn("source_ref", F.create_map(F.lit("speaker"), F.col("speaker")))
    out = rg.shift_to_absolute_time(s, 1_498_000)
    return out.select("segment_id", "start_ms", "end_ms", F.col("source_ref")["local_segment_id"].alias("local_id"), F.col("source_ref")["offset_ms"].alias("offset_text"))


@query("p12_row_fingerprint", """
SELECT o_orderkey, sha256('{"o_custkey":' || CAST(o_custkey AS VARCHAR) || ',"o_note":null,"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || ',"o_orderstatus":"' || o_orderstatus || '"}') AS fingerprint FROM orders""")
def p12(spark, sf):
    o = v.read(spark, sf, "orders").withColumn("o_note", F.lit(None).cast("string"))
    return o.select("o_orderkey", vx.row_fingerprint(["o_orderkey", "o_custkey", "o_orderstatus", "o_note"]).alias("fingerprint"))


def _sql_term_key(text, dashes=False):
    out = v.sql_casefold(text)
    if dashes:
        out = f"replace({out}, '-', ' ')"
    return f"trim(regexp_replace({out}, '{v.SQL_WS}+', ' ', 'g'), ' ')"


@query("p13_normalize_term_key", f"SELECT doc_id, {_sql_term_key('text')} AS term_key, {_sql_term_key('text', True)} AS merge_key FROM documents")
def p13(spark, sf):
    return v.docs(spark, sf).select("doc_id", tx.term_key(F.col("text")).alias("term_key"), tx.term_key(F.col("text"), True).alias("merge_key"))


def sql_replace_word(text, original, suggested):
    """SQL twin of ``replace_term`` for word terms: guard characters stand in for look-around."""
    esc = f"regexp_replace({original}, '([^A-Za-z0-9 ])', '\\\\\\1', 'g')"
    step = f"regexp_replace({{}}, '(^|[^A-Za-z])(' || {esc} || ')([^A-Za-z]|$)', '\\1' || {suggested} || '\\3', 'g')"
    return step.format(step.format(text))


@query("p14_replace_term", f"""
SELECT doc_id, {sql_replace_word('text', "'the'", "'THE$1'")} AS replaced,
 CAST(len(regexp_extract_all(regexp_replace(text, '[^A-Za-z]', '  ', 'g'), '(?:^|[^A-Za-z])the(?:[^A-Za-z]|$)')) AS BIGINT) AS hits,
 replace(text, 'é', 'e\\') AS plain, CAST(length(text) - length(replace(text, 'é', '')) AS BIGINT) AS plain_hits FROM documents""")
def p14(spark, sf):
    t = F.col("text")
    return v.docs(spark, sf).select(
        "doc_id", tx.replace_term(t, F.lit("the"), F.lit("THE$1")).alias("replaced"), tx.count_term(t, F.lit("the")).alias("hits"),
        tx.replace_term(t, F.lit("é"), F.lit("e\\")).alias("plain"), tx.count_term(t, F.lit("é")).alias("plain_hits"))


@query("p15_canonicalize_video_url", """
WITH r AS (SELECT page_id, page_id % 6 AS k, url FROM pages)
SELECT page_id,
 CASE k WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'unsupported_host' WHEN 3 THEN 'invalid_page' WHEN 4 THEN NULL ELSE 'missing_video_id' END AS reject_reason,
 CASE k WHEN 0 THEN 'https://www.bilibili.com/video/BV' || printf('%010d', page_id) || '?p=' || CAST(page_id % 7 + 1 AS VARCHAR)
        WHEN 1 THEN 'https://www.bilibili.com/video/av' || CAST(page_id AS VARCHAR) WHEN 4 THEN 'https://b23.tv/x' || CAST(page_id AS VARCHAR) END AS normalized,
 CASE WHEN k = 0 THEN 'BV' || printf('%010d', page_id) END AS bvid, CASE WHEN k = 1 THEN page_id END AS aid,
 CASE WHEN k = 0 THEN CAST(page_id % 7 + 1 AS INTEGER) END AS page, k = 4 AS short_url
FROM r""")
def p15(spark, sf):
    p = v.read(spark, sf, "pages")
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 6
    bv = F.concat(F.lit("BV"), F.lpad(n, 10, "0"))
    ref = (F.when(k == 0, F.concat(F.lit("https://M.bilibili.com/video/"), bv, F.lit("/?spm=1&p="), (F.col("page_id") % 7 + 1).cast("string")))
           .when(k == 1, F.concat(F.lit(" AV"), n)).when(k == 2, F.col("url"))
           .when(k == 3, F.concat(F.lit("https://www.bilibili.com/video/"), bv, F.lit("?p=x")))
           .when(k == 4, F.concat(F.lit("http://b23.tv/x"), n)).otherwise(F.concat(F.lit("https://www.bilibili.com/read/"), n)))
    return p.select("page_id", urls.video_source(ref).alias("s")).select("page_id", "s.*")


@query("p16_derive_job_key", """
WITH r AS (SELECT event_id, user_id, event_id % 3 AS k, '{"end":' || CAST(event_id AS VARCHAR) || ',"start":0}' AS rj FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'bili-bv' || CAST(user_id AS VARCHAR) || CASE WHEN user_id % 2 = 0 THEN '-all-' ELSE '-p' || CAST(user_id AS VARCHAR) || '-' END || substr(sha256(rj), 1, 8)
 ELSE CASE k WHEN 1 THEN 'subtitle-' ELSE 'local-' END || substr(sha256('{"path":"BV' || CAST(user_id AS VARCHAR) || '"}'), 1, 16) || '-' || substr(sha256(rj), 1, 8) END AS job_key FROM r""")
def p16(spark, sf):
    e = v.read(spark, sf, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "bilibili").when(F.col("event_id") % 3 == 1, "subtitle").otherwise("file")
    ident = F.concat(F.lit("BV"), F.col("user_id").cast("string"))
    rng = F.concat(F.lit('{"end":'), F.col("event_id").cast("string"), F.lit(',"start":0}'))
    page = F.when(F.col("user_id") % 2 == 1, F.col("user_id"))
    return e.select("event_id", vx.job_key(kind, ident, page, rng).alias("job_key"))


@query("p16_short_link_key", """
SELECT page_id, 'bili-short-' || substr(sha256('"https://b23.example/' || CAST(page_id AS VARCHAR) || '"'), 1, 12) || '-all-' || substr(sha256('{"end":null,"start":0.0}'), 1, 8) AS job_key FROM pages""")
def p16_short(spark, sf):
    address = F.concat(F.lit("https://b23.example/"), F.col("page_id").cast("string"))
    key = vx.job_key(F.lit("bilibili"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit('{"end":null,"start":0.0}'), address)
    return v.read(spark, sf, "pages").select("page_id", key.alias("job_key"))


@query("p17_validate_requested_range", f"""
WITH {v.RANGE_SQL}, d AS (SELECT part_id, CASE WHEN part_id % 5 = 0 THEN NULL ELSE range_end END AS duration FROM rng)
SELECT event_id, CASE WHEN end_ms + 86400000 * 12 <= start_ms + 86400000 * 12 THEN 'end_not_after_start' WHEN duration IS NOT NULL AND start_ms + 86400000 * 12 >= duration + 500 THEN 'start_beyond_duration'
 WHEN duration IS NOT NULL AND end_ms + 86400000 * 12 > duration + 500 THEN 'end_beyond_duration' END AS problem FROM loc LEFT JOIN d USING (part_id)""")
def p17(spark, sf):
    shift = 86_400_000 * 12
    d = v.job_ranges(spark, sf).select("part_id", F.when(F.col("part_id") % 5 != 0, F.col("range_end")).alias("duration"))
    rows = v.local_intervals(spark, sf).join(d, "part_id", "left")
    return rows.select("event_id", rg.range_problem(F.col("start_ms") + shift, F.col("end_ms") + shift, F.col("duration")).alias("problem"))


@query("p18_estimate_download_bytes", """
WITH f AS (SELECT l_orderkey AS k, max(CASE WHEN l_returnflag <> 'N' THEN l_quantity * 40 END) AS vr, max(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_quantity * 4 END) AS ar
  FROM lineitem WHERE l_linenumber * 300 <= 1080 GROUP BY l_orderkey),
i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 60.0 + o_orderkey % 900 END AS secs, 1000.0 AS dur, CASE WHEN o_orderkey % 3 = 0 THEN 50000000 END AS size, CASE WHEN o_orderkey % 2 = 0 THEN 800.0 END AS tbr FROM orders),
e AS (SELECT i.k, coalesce(secs, dur) AS s, vr, ar, size, tbr, dur FROM i LEFT JOIN f USING (k)),
g AS (SELECT k, CAST(trunc(coalesce(s * (vr + coalesce(ar, 160.0)) * 1000 / 8 * 1.10, size * least(1.0, s / dur) * 1.10, s * tbr * 1000 / 8 * 1.10)) AS BIGINT) AS estimated_bytes FROM e)
SELECT k, estimated_bytes, estimated_bytes > 524288000 AS over_gate FROM g""")
def p18(spark, sf):
    o, l = v.read(spark, sf, "orders"), v.read(spark, sf, "lineitem")
    k = F.col("o_orderkey")
    items = o.select(k.alias("k"), F.lit(0.0).alias("start_s"), F.when(k % 4 != 0, F.lit(60.0) + k % 900).alias("end_s"), F.lit(1000.0).alias("duration_s"),
                     F.when(k % 3 == 0, F.lit(50_000_000)).alias("filesize"), F.when(k % 2 == 0, F.lit(800.0)).alias("items_tbr"))
    video = F.col("l_returnflag") != "N"
    formats = l.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 300).alias("height"),
                       F.when(video, F.col("l_quantity") * 40).otherwise(F.col("l_quantity") * 4).alias("tbr"),
                       F.when(video, "avc1").otherwise("none").alias("vcodec"), F.when(F.col("l_linestatus") == "O", "mp4a").otherwise("none").alias("acodec"))
    return rg.estimate_download_bytes(items, formats, "k")


@query("p19_normalize_duration", f"""
WITH {v.RANGE_SQL}, r AS (SELECT part_id AS run, range_end AS stored, range_end + (part_id % 7 - 3) * 60 AS req FROM rng),
s AS (SELECT run, stored, req, CASE WHEN abs(stored - req) <= 1 THEN 'kept' WHEN abs(stored - req) > 150 THEN 'rejected_duration_differs' WHEN stored > req + 1 THEN 'rejected_segment_outside' ELSE 'replaced' END AS status FROM r)
SELECT run, status, CASE status WHEN 'replaced' THEN req WHEN 'kept' THEN stored END AS duration_ms,
 round(100000.0 / CASE status WHEN 'replaced' THEN req WHEN 'kept' THEN stored END, 6) AS real_time_factor FROM s""")
def p19(spark, sf):
    r = v.job_ranges(spark, sf, "run")
    runs = r.select("run", F.col("range_end").alias("stored_ms"), F.lit(100_000).alias("elapsed_ms"))
    requests = r.select("run", (F.col("range_end") + (F.col("run") % 7 - 3) * 60).alias("requested_ms"))
    segs = v.local_intervals(spark, sf).select(F.col("part_id").alias("run"), "end_ms")
    return rg.normalize_duration(runs, requests, segs, "run", near=150)


@query("p20_time_link", f"WITH {v.SEG_SQL} SELECT segment_id, printf('https://www.bilibili.com/video/%s?p=%d&t=%d', part_id, seq + 1, start_ms // 1000) AS link, printf('%02d:%02d', start_ms // 60000, (start_ms // 1000) % 60) AS label FROM seg")
def p20(spark, sf):
    base = F.concat(F.lit("https://www.bilibili.com/video/"), F.col("part_id"))
    return v.segments(spark, sf).select("segment_id", vx.time_link(base, F.col("start_ms"), F.col("seq") + 1).alias("link"), vx.clock_label(F.col("start_ms")).alias("label"))
