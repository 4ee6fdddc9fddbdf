"""Queries over paragraphs (W14-W17, J10, J11, J17, J18, J19, J21, A4, A15, V4) and the exports built from them (K5, K7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscribe.functions import text as tx
from reelscribe.operators import corrections as co
from reelscribe.operators import evidence as ev
from reelscribe.operators import intervals as iv
from reelscribe.operators import paragraphs as pg
from reelscribe.operators import reports as rp
from reelscribe.operators import rules
from reelscribe.operators import timeline as tl
from reelscribe.plans import views as v
from reelscribe.plans.registry import query
from reelscribe.session import stage_table
from reelscribe.sources import writers as wr


def _boundaries(s):
    durations = s.groupBy("part_id").agg(F.max("end_ms").alias("duration"))
    marks = durations.withColumn("boundary", F.explode(F.sequence(F.lit(25_000).cast("long"), F.greatest(F.col("duration"), F.lit(0)) + 50_000, F.lit(25_000).cast("long"))))
    return marks.select("part_id", "boundary"), durations


@query("w14_group_by_boundaries", f"""
WITH RECURSIVE {v.SEG_SQL}, d AS (SELECT part_id, max(end_ms) AS duration FROM seg GROUP BY part_id),
walk AS (
  SELECT s.part_id, s.seq, CAST(1 AS BIGINT) AS group_no, CASE WHEN end_ms >= least(25000, duration) - 1 THEN 1 ELSE 0 END AS closed FROM seg s JOIN d USING (part_id) WHERE seq = 0
  UNION ALL
  SELECT s.part_id, s.seq, w.group_no + w.closed, CASE WHEN (w.group_no + w.closed) * 25000 <= greatest(duration, 25000) AND s.end_ms >= CASE WHEN duration < 25000 THEN duration ELSE (w.group_no + w.closed) * 25000 END - 1
     AND (duration >= 25000 OR w.group_no + w.closed = 1) THEN 1 ELSE 0 END
  FROM walk w JOIN seg s ON s.part_id = w.part_id AND s.seq = w.seq + 1 JOIN d ON d.part_id = s.part_id)
SELECT part_id, seq, group_no FROM walk""")
def w14(spark, sf):
    s = stage_table(v.segments(spark, sf, ids=False).select("part_id", "seq", "start_ms", "end_ms"))
    marks, durations = _boundaries(s)
    line = tl.by_position(["part_id"])
    return pg.group_by_boundaries(s, line, marks, durations).select("part_id", "seq", "group_no")


@query("w14_any_ends", f"""
WITH RECURSIVE {v.SEG_SQL}, e AS (SELECT part_id, seq, end_ms - (seq % 3) * 20000 AS e FROM seg), d AS (SELECT part_id, max(e) - 5000 AS duration, (max(e) - 5000) // 25000 AS nb FROM e GROUP BY part_id),
walk AS (
  SELECT part_id, CAST(-1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS closed FROM d
  UNION ALL
  SELECT w.part_id, e.seq, w.k + w.closed, CASE WHEN e.e >= CASE WHEN w.k + w.closed >= greatest(nb, 1) THEN duration + 1000 WHEN nb <= 0 THEN duration ELSE (w.k + w.closed + 1) * 25000 END - 1 THEN 1 ELSE 0 END
  FROM walk w JOIN e ON e.part_id = w.part_id AND e.seq = w.seq + 1 JOIN d ON d.part_id = w.part_id)
SELECT part_id, seq, k + 1 AS group_no FROM walk WHERE seq >= 0""")
def w14_any(spark, sf):
    """Ends that fall as well as rise, and rows that end beyond the duration."""
    s = v.segments(spark, sf, ids=False).select("part_id", "seq", (F.col("end_ms") - F.col("seq") % 3 * 20_000).alias("end_ms"))
    s = stage_table(s)
    durations = s.groupBy("part_id").agg((F.max("end_ms") - 5000).alias("duration"))
    marks, _ = _boundaries(s)
    return pg.group_by_boundaries(s, tl.by_position(["part_id"]), marks, durations).select("part_id", "seq", "group_no")


SESSION_LINE = tl.by_position(["part_id"])


def sessions(spark, sf):
    """Segments with their paragraph number. The fold stages places and times only; the texts join them once."""
    s = v.segments(spark, sf)
    narrow = s.select("part_id", "seq", "start_ms", "end_ms", F.col("text_raw").endswith(".").alias("closes"))
    groups = pg.sessionize_paragraphs(stage_table(narrow), SESSION_LINE, closes_after=F.col("closes")).select("part_id", "seq", "group_no")
    return s.withColumn("text_clean", tx.clean_text(F.col("text_raw"))).join(groups, ["part_id", "seq"])


SESSION_SQL = v.SEG_SQL + f""",
sess AS (
  SELECT part_id, part_no, seq, segment_id, text_raw, start_ms, end_ms, start_ms AS group_start, CAST(1 AS BIGINT) AS group_no FROM seg WHERE seq = 0
  UNION ALL
  SELECT part_id, part_no, seq, segment_id, text_raw, start_ms, end_ms, CASE WHEN opens THEN start_ms ELSE group_start END, group_no + CASE WHEN opens THEN 1 ELSE 0 END FROM (
    SELECT s.part_id, s.part_no, s.seq, s.segment_id, s.text_raw, s.start_ms, s.end_ms, w.group_start, w.group_no,
           s.end_ms - w.group_start > 70000 OR (w.end_ms - w.group_start >= 42000 AND ends_with(w.text_raw, '.')) AS opens
    FROM sess w JOIN seg s ON s.part_id = w.part_id AND s.seq = w.seq + 1)),
sc AS (SELECT *, {v.sql_clean('text_raw')} AS text_clean FROM sess),
par AS (SELECT part_id, part_no, group_no, printf('PAR%04d', group_no) AS paragraph_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text_raw, '' ORDER BY seq) AS text_raw,
   string_agg(text_clean, '' ORDER BY seq) AS text_clean, string_agg(segment_id, '|' ORDER BY seq) AS source_segment_ids, count(*) AS sources FROM sc GROUP BY part_id, part_no, group_no)"""


@query("w15_sessionize_paragraphs", f"WITH RECURSIVE {SESSION_SQL} SELECT part_id, seq, group_no FROM sess")
def w15(spark, sf):
    narrow = v.segments(spark, sf, ids=False).select("part_id", "seq", "start_ms", "end_ms", F.col("text_raw").endswith(".").alias("closes"))
    return pg.sessionize_paragraphs(stage_table(narrow), SESSION_LINE, closes_after=F.col("closes")).select("part_id", "seq", "group_no")


@query("w15_default_closing_rule", f"""
WITH RECURSIVE {v.SEG_SQL}, c AS (SELECT part_id, seq, start_ms, end_ms, regexp_matches(t, '{"|".join(pg.TRANSITIONS)}') OR regexp_matches(t, '({"|".join(pg.TERMINALS)})$') AS closes
  FROM (SELECT *, {v.sql_clean("replace(text_raw, '.', '。')")} AS t FROM seg)),
sess AS (
  SELECT part_id, seq, start_ms, end_ms, closes, start_ms AS group_start, CAST(1 AS BIGINT) AS group_no FROM c WHERE seq = 0
  UNION ALL
  SELECT part_id, seq, start_ms, end_ms, closes, CASE WHEN opens THEN start_ms ELSE group_start END, group_no + CASE WHEN opens THEN 1 ELSE 0 END FROM (
    SELECT s.*, w.group_start, w.group_no, s.end_ms - w.group_start > 70000 OR (w.end_ms - w.group_start >= 42000 AND w.closes) AS opens
    FROM sess w JOIN c s ON s.part_id = w.part_id AND s.seq = w.seq + 1))
SELECT part_id, seq, group_no FROM sess""")
def w15_default(spark, sf):
    """Full stops read as the sentence ends of the default rule."""
    s = v.segments(spark, sf, ids=False).withColumn("text_clean", tx.clean_text(F.replace("text_raw", F.lit("."), F.lit("。"))))
    return pg.sessionize_paragraphs(s, SESSION_LINE).select("part_id", "seq", "group_no")


def paragraphs(spark, sf, reused=False):
    p = pg.build_paragraphs(sessions(spark, sf), max_packet=5)
    return stage_table(p) if reused else p


_TITLE_SQL = "coalesce(nullif(regexp_replace(substr(text_clean, 1, 22), '[，。！？；：]+$', ''), ''), '新增课程段落')"


@query("w16_build_paragraphs", f"""
WITH RECURSIVE {SESSION_SQL} SELECT part_id, group_no, paragraph_id, start_ms, end_ms, {_TITLE_SQL} AS title, text_raw, text_clean, source_segment_ids, printf('P%04d', least(5, start_ms // 300000 + 1)) AS packet_id FROM par""")
def w16(spark, sf):
    return paragraphs(spark, sf).withColumn("source_segment_ids", v.listed(F.col("source_segment_ids")))


def _sql_readable(text):
    from reelscribe.plans.text_queries import _sql_readable as readable

    return readable(text)


@query("w17_build_paragraphs_from_plan", f"""
WITH {v.SEG_SQL}, g AS (SELECT part_id, seq // 3 AS paragraph_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text_raw, '' ORDER BY seq) AS text_raw, string_agg({v.sql_clean('text_raw')}, '' ORDER BY seq) AS joined_clean, string_agg(segment_id, '|' ORDER BY seq) AS source_segment_ids, min(part_no) AS n FROM seg GROUP BY 1, 2)
SELECT part_id, paragraph_no, start_ms, end_ms, text_raw, CASE WHEN n % 7 = 0 THEN 'checked ' || part_id ELSE {_sql_readable('joined_clean')} END AS text_clean, source_segment_ids FROM g""")
def w17(spark, sf):
    s = v.segments(spark, sf).withColumn("text_clean", tx.clean_text(F.col("text_raw")))
    plan = s.groupBy("part_id", "part_no", F.floor(F.col("seq") / 3).cast("long").alias("paragraph_no")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "segment_id"))), lambda x: x["segment_id"]).alias("segment_ids"))
    plan = plan.withColumn("clean_override", F.when(F.col("part_no") % 7 == 0, F.concat(F.lit("checked "), F.col("part_id"))).when(F.col("part_no") % 7 == 1, ""))
    plan = plan.withColumn("segment_ids", F.when(F.col("part_no") % 10 == 0, F.concat("segment_ids", F.array(F.lit("T999999999")))).otherwise(F.col("segment_ids")))
    known, _ = pg.build_paragraphs_from_plan(plan, s)
    return known.withColumn("source_segment_ids", v.listed(F.col("source_segment_ids")))


@query("w17_unknown_references", f"WITH {v.SEG_SQL} SELECT DISTINCT part_id, seq // 3 AS paragraph_no, 'X' || segment_id AS segment_id FROM seg WHERE part_no % 10 = 0")
def w17_unknown(spark, sf):
    """Every segment of each tenth part is listed a second time under an id that nobody knows."""
    s = v.segments(spark, sf).withColumn("text_clean", F.col("text_raw"))
    ids = F.when(F.col("part_no") % 10 == 0, F.array(F.col("segment_id"), F.concat(F.lit("X"), "segment_id"))).otherwise(F.array("segment_id"))
    plan = s.select("part_id", F.floor(F.col("seq") / 3).cast("long").alias("paragraph_no"), F.lit(None).cast("string").alias("clean_override"), ids.alias("segment_ids"))
    return pg.build_paragraphs_from_plan(plan, s)[1]


def _plan(s):
    return s.groupBy("part_id", F.floor(F.col("seq") / 3).cast("long").alias("paragraph_no")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "segment_id"))), lambda x: x["segment_id"]).alias("segment_ids"), F.lit(None).cast("string").alias("clean_override"))


def _plan_corrections(plan):
    """Two corrections of every planned paragraph, the second one accepted in every other."""
    item = lambda n, a, b, ok: F.struct(F.lit(n).alias("ord"), F.lit(a).alias("original_text"), F.lit(b).alias("suggested_text"), ok.alias("applied"))
    both = plan.select("part_id", "paragraph_no", F.explode(F.array(item(1, "th", "TH$1", F.lit(True)), item(2, "en ", "", F.col("paragraph_no") % 2 == 0))).alias("c"))
    return both.select("part_id", "paragraph_no", "c.*").withColumn("correction_id", F.concat_ws("-", F.lit("C"), "part_id", "paragraph_no", "ord"))


@query("w17_attachments", f"""
WITH {v.SEG_SQL}, g AS (SELECT part_id, seq // 3 AS paragraph_no, seq, part_id || '-' || CAST(seq // 2 AS VARCHAR) AS e FROM seg)
SELECT DISTINCT part_id, paragraph_no, 'evidence' AS kind, e AS ref_id FROM g UNION ALL SELECT DISTINCT part_id, paragraph_no, 'frame', 'F' || CAST(seq // 2 % 4 AS VARCHAR) FROM g
UNION ALL SELECT DISTINCT part_id, paragraph_no, 'correction', 'C-' || part_id || '-' || CAST(paragraph_no AS VARCHAR) || '-' || CAST(i AS VARCHAR) FROM g, (SELECT unnest([1, 2]) AS i)""")
def w17_attachments(spark, sf):
    """Evidence over every two turns, so that it crosses the paragraphs of three, with one frame each."""
    s = v.segments(spark, sf)
    plan = _plan(s)
    e = s.select("segment_id", F.concat_ws("-", "part_id", F.floor(F.col("seq") / 2).cast("string")).alias("evidence_id"), F.concat(F.lit("F"), (F.floor(F.col("seq") / 2) % 4).cast("string")).alias("frame_id"))
    return pg.attach_to_plan(plan, e, _plan_corrections(plan), e.select("evidence_id", "frame_id").distinct())


_FIX = "CASE WHEN contains({t}, {a}) THEN substr({t}, 1, strpos({t}, {a}) - 1) || {b} || substr({t}, strpos({t}, {a}) + length({a})) ELSE {t} END"


@query("w17_corrected_plan", f"""
WITH {v.SEG_SQL}, g AS (SELECT part_id, seq // 3 AS paragraph_no, {_sql_readable(f"string_agg({v.sql_clean('text_raw')}, '' ORDER BY seq)")} AS t FROM seg GROUP BY 1, 2), one AS (SELECT *, {_FIX.format(t="t", a="'th'", b="'TH$1'")} AS t1 FROM g)
SELECT part_id, paragraph_no, CASE WHEN paragraph_no % 2 = 0 THEN {_FIX.format(t="t1", a="'en '", b="''")} ELSE t1 END AS text_corrected,
 array_to_string(list_filter([CASE WHEN NOT contains(t, 'th') THEN 'C-' || part_id || '-' || CAST(paragraph_no AS VARCHAR) || '-1' END, CASE WHEN paragraph_no % 2 = 0 AND NOT contains(t1, 'en ') THEN 'C-' || part_id || '-' || CAST(paragraph_no AS VARCHAR) || '-2' END], lambda c: c IS NOT NULL), '|') AS not_applied FROM one""")
def w17_corrected(spark, sf):
    s = v.segments(spark, sf).withColumn("text_clean", tx.clean_text(F.col("text_raw")))
    plan = _plan(s)
    known, _ = pg.build_paragraphs_from_plan(plan, s)
    out = pg.correct_plan(known, _plan_corrections(plan))
    return out.select("part_id", "paragraph_no", "text_corrected", v.listed(F.col("not_applied")).alias("not_applied"))


@query("j10_check_exact_cover", """
WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, l_orderkey) AS order_no, coalesce(n, 0) AS times, CASE WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS problem FROM orders FULL JOIN c ON l_orderkey = o_orderkey WHERE coalesce(n, 0) <> 1""")
def j10(spark, sf):
    items = v.read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_no"))
    return ev.check_exact_cover(items, "order_no", v.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_no")))


@query("j11_check_contiguity", f"""
WITH {v.SEG_SQL}, m AS (SELECT *, CASE WHEN part_no % 4 = 0 THEN seq % 3 ELSE seq // 3 END AS g FROM seg),
a AS (SELECT part_id, g AS group_no, min(seq) AS first_pos, max(seq) AS last_pos, count(*) AS size, arg_min(start_ms, seq) AS start, arg_max(end_ms, seq) AS end_ FROM m GROUP BY 1, 2)
SELECT part_id, group_no, first_pos, last_pos, size, start, end_ AS "end", last_pos - first_pos + 1 = size AS contiguous, coalesce(first_pos > lag(last_pos) OVER (PARTITION BY part_id ORDER BY group_no), true) AS in_order FROM a""")
def j11(spark, sf):
    s = v.segments(spark, sf, ids=False)
    g = F.when(F.col("part_no") % 4 == 0, F.col("seq") % 3).otherwise(F.floor(F.col("seq") / 3).cast("long"))
    groups = pg.check_contiguity(s.withColumn("group_no", g), ["part_id", "group_no"], "seq", "start_ms", "end_ms")
    return pg.check_group_order(groups, "part_id", "group_no")


@query("j11_check_declared_values", f"""
WITH {v.SEG_SQL}, g AS (SELECT part_id, part_no, seq // 3 AS group_no FROM seg GROUP BY 1, 2, 3)
SELECT part_id, group_no, 'time_differs' AS problem FROM g WHERE (part_no + group_no) % 5 = 0 UNION ALL SELECT part_id, group_no, 'text_differs' FROM g WHERE (part_no + group_no) % 7 = 0""")
def j11_declared(spark, sf):
    """Groups of three with the times of every fifth and the text of every seventh changed."""
    s = v.segments(spark, sf, ids=False).withColumn("group_no", F.floor(F.col("seq") / 3).cast("long"))
    n = F.col("part_no") + F.col("group_no")
    declared = s.groupBy("part_id", "part_no", "group_no").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "text_raw"))), lambda x: x["text_raw"]), "").alias("text_raw"))
    declared = declared.withColumns({"start_ms": F.col("start_ms") + F.when(n % 5 == 0, 1).otherwise(0), "text_raw": F.when(n % 7 == 0, F.concat("text_raw", F.lit("!"))).otherwise(F.col("text_raw"))})
    return pg.check_declared_values(declared, s, ["part_id", "group_no"], "seq")


PAR_LINE = tl.by_position(["part_id"], "group_no", 4096)


def frames_of_parts(spark, sf):
    """Every event as a frame of the part with the number of its user, on the first two minutes, which all parts have; cue frames are formulas."""
    m = v.moments(spark, sf)
    return m.select(F.col("job_id").cast("string").alias("part_id"), F.col("event_id").alias("frame_id"), (F.col("t") % 120_000).alias("t"), "has_cue")


FRAMES_SQL = v.MOM_SQL + ", fr AS (SELECT CAST(job_id AS VARCHAR) AS part_id, event_id AS frame_id, t % 120000 AS t, has_cue FROM mom)"


def frame_hits(spark, sf, p):
    """(part_id, paragraph_id, frame_id, t, has_cue): the frames of every paragraph, by time; staged, as evidence and its members read them."""
    hits = iv.point_in_interval(frames_of_parts(spark, sf), p.select("part_id", "paragraph_id", "start_ms", "end_ms"), ["part_id"], "t", "start_ms", "end_ms", 60_000)
    return stage_table(hits.select("part_id", "paragraph_id", "frame_id", "t", "has_cue"))


FRAME_HIT_SQL = ", hit AS (SELECT p.part_id, p.group_no, p.paragraph_id, fr.frame_id, fr.t, fr.has_cue FROM par p JOIN fr ON fr.part_id = p.part_id AND t >= start_ms AND t < end_ms)"


def narrow_paragraphs(spark, sf):
    """Paragraphs with the ends of their texts that evidence and sections show, staged once; whole texts stay behind."""
    p = paragraphs(spark, sf)
    return stage_table(p.select("part_id", F.col("part_id").cast("long").alias("part_no"), "group_no", "paragraph_id", "start_ms", "end_ms", F.substring("text_clean", 1, 240).alias("claim"), "source_segment_ids"))


def evidence(p, hits):
    kinds = F.when(F.col("has_cue"), F.array(F.lit("frame"), F.lit("formula"))).otherwise(F.array(F.lit("frame")))
    links = hits.select("part_id", "paragraph_id", F.explode(kinds).alias("kind"))
    return ev.build_evidence(p.drop("source_segment_ids"), links, PAR_LINE, "part_no", first=100, claim=F.col("claim"))


EVIDENCE_SQL = SESSION_SQL + ", " + FRAMES_SQL + FRAME_HIT_SQL + """,
fc AS (SELECT part_id, paragraph_id, count(*) AS frame_count, count(*) FILTER (WHERE has_cue) AS formula_count FROM hit GROUP BY 1, 2),
evi AS (SELECT p.*, coalesce(frame_count, 0) AS frame_count, coalesce(formula_count, 0) AS formula_count, CASE WHEN frame_count > 0 AND formula_count > 0 THEN 'speech+slide+formula' WHEN frame_count > 0 THEN 'speech+slide' ELSE 'speech' END AS evidence_type,
  substr(text_clean, 1, 240) AS claim, printf('E%06d', row_number() OVER (ORDER BY part_no, group_no) + 99) AS evidence_id FROM par p LEFT JOIN fc USING (part_id, paragraph_id))"""


@query("j21_build_evidence", f"WITH RECURSIVE {EVIDENCE_SQL} SELECT evidence_id, part_id, paragraph_id, start_ms, end_ms, evidence_type, claim, frame_count, formula_count FROM evi")
def j21(spark, sf):
    p = narrow_paragraphs(spark, sf)
    out = evidence(p, frame_hits(spark, sf, p))
    return out.select("evidence_id", "part_id", "paragraph_id", "start_ms", "end_ms", "evidence_type", "claim", "frame_count", "formula_count")


def members_of_evidence(p, hits):
    spoken = p.select("part_id", "paragraph_id", F.posexplode("source_segment_ids").alias("place", "segment_id"))
    return ev.evidence_members(evidence(p, hits), {
        "segment": (spoken, "place", "segment_id", 4096), "frame": (hits, "t", "frame_id", 60_000), "formula": (hits.filter("has_cue"), "t", "frame_id", 60_000)})


EVIDENCE_MEMBER_SQL = EVIDENCE_SQL + """,
src AS (SELECT part_id, paragraph_id, segment_id, row_number() OVER (PARTITION BY part_id, group_no ORDER BY seq) AS position FROM sc JOIN (SELECT part_id, group_no, paragraph_id FROM par) USING (part_id, group_no)),
emem AS (
  SELECT evidence_id, 'segment' AS kind, position, segment_id AS ref_id FROM evi JOIN src USING (part_id, paragraph_id)
  UNION ALL SELECT evidence_id, 'frame', row_number() OVER (PARTITION BY evidence_id ORDER BY hit.t, frame_id), CAST(frame_id AS VARCHAR) FROM evi JOIN hit USING (part_id, paragraph_id)
  UNION ALL SELECT evidence_id, 'formula', row_number() OVER (PARTITION BY evidence_id ORDER BY hit.t, frame_id), CAST(frame_id AS VARCHAR) FROM evi JOIN hit USING (part_id, paragraph_id) WHERE has_cue)"""


@query("j21_evidence_members", f"WITH RECURSIVE {EVIDENCE_MEMBER_SQL} SELECT evidence_id, kind, position, ref_id FROM emem")
def j21_members(spark, sf):
    p = narrow_paragraphs(spark, sf)
    return members_of_evidence(p, frame_hits(spark, sf, p))


def section_inputs(spark, sf):
    """Two paragraphs to a section: (plan, paragraphs with their evidence, frames of paragraphs, formulas)."""
    narrow = narrow_paragraphs(spark, sf)
    hits = frame_hits(spark, sf, narrow)
    e = stage_table(evidence(narrow, hits))
    p = e.select("part_id", "group_no", "paragraph_id", "evidence_id", "start_ms", "end_ms", F.substring("claim", 1, 22).alias("summary"), F.when(F.col("frame_count") > 0, "medium").otherwise("high").alias("confidence"))
    plan = e.groupBy("part_id").agg(F.max("group_no").alias("n")).withColumn("section_no", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("n") / 2).cast("long"))))
    plan = plan.select("part_id", "section_no", F.concat(F.lit("section "), F.col("section_no").cast("string")).alias("title"),
                       (F.col("section_no") * 2 - 1).alias("first_no"), (F.col("section_no") * 2).alias("last_no"))
    formulas = frames_of_parts(spark, sf).filter("has_cue").select("part_id", F.col("frame_id").alias("formula_id"), "t")
    return plan, p, hits.drop("has_cue"), formulas


SECTION_SQL = EVIDENCE_SQL + """,
sec AS (SELECT part_id, (group_no - 1) // 2 + 1 AS section_no, printf('SEC%04d', (group_no - 1) // 2 + 1) AS section_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS paragraph_count, string_agg(substr(text_clean, 1, 22), ' ' ORDER BY group_no) AS summary,
   bool_or(frame_count > 0) AS med, arg_min(paragraph_id, group_no) AS highlight_paragraph, arg_min(evidence_id, group_no) AS highlight_evidence FROM evi GROUP BY 1, 2),
smem AS (
  SELECT part_id, printf('SEC%04d', (group_no - 1) // 2 + 1) AS section_id, 'paragraph' AS kind, (group_no - 1) % 2 + 1 AS position, paragraph_id AS ref_id FROM evi
  UNION ALL SELECT part_id, printf('SEC%04d', (group_no - 1) // 2 + 1), 'evidence', (group_no - 1) % 2 + 1, evidence_id FROM evi
  UNION ALL SELECT part_id, section_id, 'frame', row_number() OVER (PARTITION BY part_id, section_id ORDER BY t, frame_id), CAST(frame_id AS VARCHAR) FROM (SELECT DISTINCT part_id, printf('SEC%04d', (group_no - 1) // 2 + 1) AS section_id, t, frame_id FROM hit)
  UNION ALL SELECT sec.part_id, section_id, 'formula', row_number() OVER (PARTITION BY sec.part_id, section_id ORDER BY t, frame_id), CAST(frame_id AS VARCHAR) FROM sec JOIN fr ON fr.part_id = sec.part_id AND has_cue AND t >= start_ms AND t < end_ms)"""


@query("j17_build_sections_and_highlights", f"""
WITH RECURSIVE {SECTION_SQL}, c AS (SELECT part_id, section_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}_count" for k in ('evidence', 'frame', 'formula'))} FROM smem GROUP BY 1, 2)
SELECT s.part_id, section_id, 'section ' || CAST(section_no AS VARCHAR) AS title, start_ms, end_ms, paragraph_count, summary, CASE WHEN med THEN 'medium' ELSE 'high' END AS confidence, printf('H%04d', section_no) AS highlight_id, highlight_paragraph, highlight_evidence,
 evidence_count, frame_count, formula_count FROM sec s JOIN c USING (part_id, section_id)""")
def j17(spark, sf):
    plan, p, frames, formulas = section_inputs(spark, sf)
    sections = stage_table(ev.build_sections(plan, p))
    members = ev.section_members(plan, p, sections, frames, formulas, 60_000)
    return ev.with_member_counts(sections, members, ["part_id", "section_id"], ("evidence", "frame", "formula"))


@query("j17_section_members", f"WITH RECURSIVE {SECTION_SQL} SELECT part_id, section_id, kind, position, ref_id FROM smem")
def j17_members(spark, sf):
    plan, p, frames, formulas = section_inputs(spark, sf)
    return ev.section_members(plan, p, ev.build_sections(plan, p), frames, formulas, 60_000)


@query("v4_rules_of_evidence_members", f"""
WITH RECURSIVE {EVIDENCE_MEMBER_SQL}, b AS (SELECT evidence_id, group_no % 5 = 0 AS bare, CASE WHEN group_no % 3 = 0 THEN 'speech+slide+formula' ELSE evidence_type END AS kind, frame_count, formula_count FROM evi)
SELECT 'evidence' AS "table", evidence_id AS id, 'no_source' AS rule FROM b WHERE bare AND frame_count = 0 UNION ALL SELECT 'evidence', evidence_id, 'speech_without_transcript' FROM b WHERE bare
UNION ALL SELECT 'evidence', evidence_id, 'slide_without_frame' FROM b WHERE contains(kind, 'slide') AND frame_count = 0 UNION ALL SELECT 'evidence', evidence_id, 'formula_without_formula' FROM b WHERE contains(kind, 'formula') AND formula_count = 0""")
def v4_members(spark, sf):
    """Evidence with the counts of its child rows; every fifth paragraph lacks its segments, every third claims a formula."""
    p = narrow_paragraphs(spark, sf)
    hits = frame_hits(spark, sf, p)
    e = stage_table(evidence(p, hits).drop("frame_count", "formula_count"))
    bare = e.filter("group_no % 5 = 0").select("evidence_id")
    members = members_of_evidence(p, hits)
    members = members.filter("kind <> 'segment'").unionByName(members.filter("kind = 'segment'").join(bare, "evidence_id", "left_anti"))
    rows = ev.with_member_counts(e, members, ["evidence_id"], ("segment", "frame", "formula"))
    return rules.rules_evidence(rows.withColumn("evidence_type", F.when(F.col("group_no") % 3 == 0, "speech+slide+formula").otherwise(F.col("evidence_type"))))


def paragraph_corrections(spark, sf, p):
    """Word pairs of the benchmark that paragraphs hold, each once per paragraph: part_id, group_no, paragraph_id, original, term_no, decision."""
    texts = p.select("part_id", "group_no", "paragraph_id", F.lower("text_clean").alias("_text"))
    hits = co.match_terms(texts, ["part_id", "group_no", "paragraph_id"], "_text", v.terms(spark, sf), "original")
    return hits.groupBy("part_id", "group_no", "paragraph_id", "original").agg(F.min("term_no").alias("term_no"), F.min_by("decision", "term_no").alias("decision"))


PAR_FIX_SQL = """pcor AS (SELECT part_id, group_no, paragraph_id, original, min(term_no) AS term_no, arg_min(decision, term_no) AS decision FROM par JOIN tm ON contains(lower(text_clean), original) GROUP BY 1, 2, 3, 4)"""


@query("a4_paragraph_quality_report", f"""
WITH RECURSIVE {EVIDENCE_SQL}, {v.TERM_SQL}, {PAR_FIX_SQL},
n AS (SELECT *, lag(end_ms) OVER w AS pe, lag(start_ms) OVER w AS ps, end_ms - start_ms AS len, EXISTS (SELECT 1 FROM pcor WHERE pcor.part_id = evi.part_id AND pcor.paragraph_id = evi.paragraph_id) AS fixed, part_no % 4 = 0 AND group_no % 3 = 0 AS bare FROM evi WINDOW w AS (PARTITION BY part_id ORDER BY group_no)),
pl AS (SELECT part_id, segment_id FROM sc WHERE NOT (part_no % 4 = 0 AND group_no % 3 = 0) UNION ALL SELECT part_id, segment_id FROM sc WHERE part_no % 5 = 0 AND seq % 2 = 0),
cv AS (SELECT part_id, count(*) AS source_segment_count, count(*) FILTER (WHERE coalesce(k, 0) = 0) AS missing_segment_count, CAST(sum(greatest(coalesce(k, 0) - 1, 0)) AS BIGINT) AS duplicate_segment_count FROM seg LEFT JOIN (SELECT part_id, segment_id, count(*) AS k FROM pl GROUP BY 1, 2) USING (part_id, segment_id) GROUP BY part_id)
SELECT part_id, count(*) AS paragraph_count, CAST(sum(len) AS BIGINT) AS total_ms, min(len) AS shortest_ms, max(len) AS longest_ms, round(sum(len)::DOUBLE / count(*)::DOUBLE, 3) AS mean_ms, round(sum(length(text_clean))::DOUBLE / count(*)::DOUBLE, 3) AS mean_chars,
 count(*) FILTER (WHERE len > 75000) AS over_75_seconds, count(*) FILTER (WHERE len > 90000) AS over_90_seconds, count(*) FILTER (WHERE len > 120000) AS over_120_seconds, count(*) FILTER (WHERE bare) AS without_source,
 count(*) FILTER (WHERE end_ms <= start_ms) AS invalid_time_count, count(*) FILTER (WHERE start_ms < ps) AS reverse_order_count, CAST(coalesce(max(greatest(0, start_ms - pe)), 0) AS BIGINT) AS max_gap,
 count(*) FILTER (WHERE fixed) AS with_corrections, count(*) FILTER (WHERE frame_count > 0) AS with_frames, count(*) AS with_evidence, bool_or(text_raw <> text_clean) AS cleaning_changed_text, any_value(source_segment_count) AS source_segment_count, any_value(missing_segment_count) AS missing_segment_count, any_value(duplicate_segment_count) AS duplicate_segment_count
FROM n JOIN cv USING (part_id) GROUP BY part_id""")
def a4(spark, sf):
    """Links from the evidence, its frames and the matched corrections. Some paragraphs lose their segments, some segments stand in a second one."""
    p = paragraphs(spark, sf, reused=True).withColumn("part_no", F.col("part_id").cast("long"))
    hits = frame_hits(spark, sf, p)
    e = evidence(p.withColumn("claim", F.substring("text_clean", 1, 240)).drop("text_raw", "text_clean", "title"), hits)
    link = lambda rows, kind, ref: rows.select("part_id", "paragraph_id", F.lit(kind).alias("kind"), F.col(ref).cast("string").alias("ref_id"))
    segments = v.segments(spark, sf)
    spoken = p.filter("NOT (part_no % 4 = 0 AND group_no % 3 = 0)").select("part_id", "paragraph_id", F.explode("source_segment_ids").alias("segment_id"))
    again = segments.filter("part_no % 5 = 0 AND seq % 2 = 0").withColumn("paragraph_id", F.lit("elsewhere"))
    members = link(spoken, "segment", "segment_id").unionByName(link(again, "segment", "segment_id")).unionByName(link(paragraph_corrections(spark, sf, p), "correction", "term_no"))
    members = members.unionByName(link(hits, "frame", "frame_id")).unionByName(link(e, "evidence", "evidence_id"))
    return rp.paragraph_quality_report(p, PAR_LINE, segments, members)


@query("a15_audit_sample_summary", f"""
WITH RECURSIVE {SESSION_SQL}, {FRAMES_SQL}, {v.TERM_SQL}, {PAR_FIX_SQL}, r AS (SELECT part_id, paragraph_id, printf('P%04d', least(5, start_ms // 300000 + 1)) AS packet_id, part_no % 5 <> 0 AS ok, part_no % 3 <> 0 AS time_ok FROM par),
sm AS (SELECT part_id, paragraph_id FROM par WHERE end_ms - start_ms > 60000 UNION SELECT part_id, paragraph_id FROM pcor WHERE decision = 'accepted' UNION SELECT part_id, paragraph_id FROM par WHERE substr(md5(part_id || paragraph_id), 1, 1) < '4')
SELECT packet_id, count(*) AS sample_count, count(*) FILTER (WHERE NOT ok) AS raw_changed, count(*) FILTER (WHERE NOT time_ok) AS time_wrong FROM r JOIN sm USING (part_id, paragraph_id) GROUP BY packet_id""")
def a15(spark, sf):
    """The sample: long paragraphs, those with an accepted correction, and a quarter of all by the digest of their id."""
    p = paragraphs(spark, sf, reused=True)
    n = F.col("part_id").cast("long")
    tampered = p.withColumns({"text_raw": F.when(n % 5 == 0, F.concat("text_raw", F.lit("!"))).otherwise(F.col("text_raw")),
                              "end_ms": F.when(n % 3 == 0, F.col("end_ms") + 1).otherwise(F.col("end_ms"))})
    reason = lambda rows, name: rows.select("part_id", "paragraph_id", F.lit(name).alias("reason"))
    picked = reason(p.filter("end_ms - start_ms > 60000"), "long").unionByName(reason(paragraph_corrections(spark, sf, p).filter("decision = 'accepted'"), "corrected"))
    picked = picked.unionByName(reason(p.filter(F.substring(F.md5(F.concat("part_id", "paragraph_id")), 1, 1) < "4"), "ordinary"))
    sample = picked.groupBy("part_id", "paragraph_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    audit = rp.audit_sample(tampered, v.segments(spark, sf), sample)
    return audit.groupBy("packet_id").agg(F.count(F.lit(1)).alias("sample_count"), F.count(F.when(~F.col("raw_preserved"), 1)).alias("raw_changed"),
                                          F.count(F.when(~F.col("time_range_correct"), 1)).alias("time_wrong"))


@query("j18_build_topic_tree", """
WITH n AS (SELECT c_nationkey AS k, count(*) AS kids, CAST(sum(c_custkey) AS BIGINT) AS s, min(c_custkey) AS first_kid FROM customer GROUP BY 1)
SELECT r_name, n_name, coalesce(kids, 0) AS kids, coalesce(s, 0) AS kid_sum, first_kid FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN n ON k = n_nationkey""")
def j18(spark, sf):
    r, n, c = (v.read(spark, sf, t) for t in ("region", "nation", "customer"))
    tree, _ = ev.build_topic_tree(r.select(F.col("r_regionkey").alias("root"), "r_name"), n.select(F.col("n_regionkey").alias("root"), F.col("n_nationkey").alias("node"), "n_name"),
                                  c.select(F.col("c_nationkey").alias("node"), "c_custkey", "c_name"), "root", "node", ["c_custkey", "c_name"], "r_name", "n_name")
    flat = tree.select("r_name", F.explode("nodes").alias("x"))
    kids = flat.select("r_name", F.col("x.n_name").alias("n_name"), F.size("x.children").alias("kids"),
                       F.aggregate("x.children", F.lit(0).cast("long"), lambda a, k: a + k["c_custkey"]).alias("s"), F.get("x.children", F.lit(0))["c_custkey"].alias("f"))
    return kids.groupBy("r_name", "n_name").agg(F.sum("kids").alias("kids"), F.sum("s").alias("kid_sum"), F.min("f").alias("first_kid"))


@query("j18_unknown_leaves", "SELECT c_custkey, c_name, c_nationkey AS node FROM customer WHERE c_nationkey % 5 = 0")
def j18_unknown(spark, sf):
    """Customers of nations that the tree leaves out."""
    r, n, c = (v.read(spark, sf, t) for t in ("region", "nation", "customer"))
    middle = n.filter("n_nationkey % 5 <> 0").select(F.col("n_regionkey").alias("root"), F.col("n_nationkey").alias("node"), "n_name")
    leaves = c.select(F.col("c_nationkey").alias("node"), "c_custkey", "c_name")
    return ev.build_topic_tree(r.select(F.col("r_regionkey").alias("root"), "r_name"), middle, leaves, "root", "node", ["c_custkey", "c_name"], "r_name", "n_name")[1]


@query("j19_search_timeline", f"""
WITH RECURSIVE {SESSION_SQL}, {v.TERM_SQL}, i AS (
 SELECT 'paragraph' AS kind, part_id || '/' || paragraph_id AS item_id, start_ms AS t, [text_raw, text_clean, replace(text_clean, 'th', 'TH '), {_TITLE_SQL}] AS h FROM par UNION ALL
 SELECT 'formula', CAST(doc_id AS VARCHAR), 0, [text, source] FROM documents UNION ALL SELECT 'term', CAST(item_id AS VARCHAR), 0, [text] FROM benchmark),
q AS (SELECT DISTINCT original AS query FROM tm UNION SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{{8,}}')) FROM benchmark UNION SELECT unnest(['ÉAU', 'benchmark', 'zz']))
SELECT kind, item_id, t, query FROM i JOIN q ON len(list_filter(h, lambda x: contains(lower(x), lower(query)))) > 0""")
def j19(spark, sf):
    """Every word pair and long word of the benchmark and some more, sought in all layers of paragraphs (the corrected one too), in documents and in benchmark texts."""
    p = paragraphs(spark, sf).select(F.lit("paragraph").alias("kind"), F.concat_ws("/", "part_id", "paragraph_id").alias("item_id"), F.col("start_ms").alias("t"),
                                     F.array("text_raw", "text_clean", F.replace("text_clean", F.lit("th"), F.lit("TH ")), "title").alias("haystack"))
    d = v.docs(spark, sf).select(F.lit("formula").alias("kind"), F.col("doc_id").cast("string").alias("item_id"), F.lit(0).cast("long").alias("t"), F.array("text", "source").alias("haystack"))
    b = v.read(spark, sf, "benchmark").select(F.lit("term").alias("kind"), F.col("item_id").cast("string").alias("item_id"), F.lit(0).cast("long").alias("t"), F.array("text").alias("haystack"))
    words = v.read(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("query"))
    queries = v.terms(spark, sf).select(F.col("original").alias("query")).unionByName(words).unionByName(spark.createDataFrame([("ÉAU",), ("benchmark",), ("zz",)], "query string")).distinct()
    return co.search_timeline(p.unionByName(d).unionByName(b), queries)


_SEC = "printf('%d.%03d', {0} // 1000, {0} % 1000)"


@query("k5_export_text_layers", f"""
WITH RECURSIVE {SESSION_SQL}, l AS (SELECT part_id, group_no, start_ms, end_ms, {_TITLE_SQL} AS title, unnest(['raw', 'cleaned', 'corrected']) AS layer, unnest([text_raw, text_clean, replace(text_clean, ' ', '_')]) AS txt FROM par)
SELECT part_id, layer, (group_no - 1) // 2 AS chunk, string_agg('[' || {_SEC.format('start_ms')} || '–' || {_SEC.format('end_ms')} || '] ' || title || chr(10) || txt, chr(10) || chr(10) ORDER BY group_no) AS body FROM l GROUP BY 1, 2, 3""")
def k5(spark, sf):
    p = paragraphs(spark, sf).withColumn("text_corrected", F.translate("text_clean", " ", "_"))
    return wr.export_text_layers(p, rows=2)


# Child tables of the reader: name, rows with the job as part_id, order, the field that the query shows.
_CHILDREN = (
    ("paragraphs", "par", "group_no", "paragraph_id"), ("corrections", "pcor", "group_no, term_no", "original"), ("sections", "sec", "section_no", "section_id"),
    ("highlights", "sec", "section_no", "printf('H%04d', section_no)"), ("evidence", "evi", "group_no", "evidence_id"), ("formulas", "(SELECT * FROM fr WHERE has_cue)", "t, frame_id", "CAST(frame_id AS VARCHAR)"),
    ("glossary", "(SELECT part_id, original, min(group_no) AS group_no FROM pcor GROUP BY 1, 2)", "group_no, original", "original"), ("frames", "(SELECT * FROM fr WHERE frame_id % 3 <> 0)", "t, frame_id", "'/asset/frame/' || CAST(frame_id AS VARCHAR)"))


@query("k7_assemble_reader_dataset", f"""
WITH RECURSIVE {SECTION_SQL}, {v.TERM_SQL}, {PAR_FIX_SQL},
ch AS ({" UNION ALL ".join(f"SELECT part_id AS job_id, '{name}' AS tab, row_number() OVER (PARTITION BY part_id ORDER BY {order}) AS n, {field} AS x FROM {rows}" for name, rows, order, field in _CHILDREN)}),
pages AS (SELECT job_id, (n - 1) // 4 AS page, {", ".join(f"coalesce(string_agg(x, '|' ORDER BY n) FILTER (WHERE tab = '{name}'), '') AS {name}" for name, *_ in _CHILDREN)} FROM ch GROUP BY 1, 2), j AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS job_id FROM conversations)
SELECT job_id, coalesce(page, 0) AS page, {", ".join(f"coalesce({name}, '') AS {name}" for name, *_ in _CHILDREN)} FROM j LEFT JOIN pages USING (job_id)""")
def k7(spark, sf):
    jobs = v.read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("job_id")).distinct()
    whole = paragraphs(spark, sf, reused=True)
    narrow = whole.select("part_id", F.col("part_id").cast("long").alias("part_no"), "group_no", "paragraph_id", "start_ms", "end_ms", F.substring("text_clean", 1, 240).alias("claim"))
    e = stage_table(evidence(narrow.withColumn("source_segment_ids", F.lit(None)), frame_hits(spark, sf, narrow)))
    shown = e.select("part_id", "group_no", "paragraph_id", "evidence_id", "start_ms", "end_ms", F.substring("claim", 1, 22).alias("summary"), F.when(F.col("frame_count") > 0, "medium").otherwise("high").alias("confidence"))
    plan = shown.select("part_id", "group_no", F.ceil(F.col("group_no") / 2).cast("long").alias("section_no")).groupBy("part_id", "section_no").agg(F.min("group_no").alias("first_no"), F.max("group_no").alias("last_no")).withColumn("title", F.lit(""))
    s = ev.build_sections(plan, shown).withColumn("section_no", F.substring("section_id", 4, 20).cast("long"))
    fixes = stage_table(paragraph_corrections(spark, sf, whole))
    f = frames_of_parts(spark, sf)
    active = f.select("part_id", "frame_id").filter("frame_id % 3 <> 0")
    frames = f.join(active, ["part_id", "frame_id"], "left_semi").withColumn("url", F.concat(F.lit("/asset/frame/"), F.col("frame_id").cast("string")))
    by = lambda *order, span=tl.ROWS_PER_BLOCK: tl.Timeline(("job_id",), order, order[0], span)
    tables = {
        "paragraphs": (whole.select("part_id", "group_no", "paragraph_id", "title", "text_raw", "text_clean"), by("group_no")), "corrections": (fixes, by("group_no", "term_no")),
        "sections": (s.select("part_id", "section_no", "section_id", "title", "summary"), by("section_no")), "highlights": (s.select("part_id", "section_no", "highlight_id", "highlight_paragraph", "highlight_evidence"), by("section_no")),
        "evidence": (e.select("part_id", "group_no", "evidence_id", "evidence_type", "claim"), by("group_no")), "formulas": (f.filter("has_cue").select("part_id", "t", "frame_id"), by("t", "frame_id", span=60_000)),
        "glossary": (fixes.groupBy("part_id", "original").agg(F.min("group_no").alias("group_no")), by("group_no", "original")), "frames": (frames, by("t", "frame_id", span=60_000))}
    out = wr.assemble_reader_dataset(jobs, {n: (rows.withColumnRenamed("part_id", "job_id"), line) for n, (rows, line) in tables.items()}, rows=4)
    fields = {"paragraphs": "paragraph_id", "corrections": "original", "sections": "section_id", "highlights": "highlight_id", "evidence": "evidence_id", "formulas": "frame_id", "glossary": "original", "frames": "url"}
    shown = lambda table, field: F.coalesce(v.listed(F.transform(table, lambda x: x[field])), F.lit("")).alias(table)
    return out.select("job_id", "page", *[shown(table, field) for table, field in fields.items()])
