"""Queries over corrections, terms, references and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscribe.functions import text as tx
from reelscribe.operators import corrections as co
from reelscribe.operators import evidence as ev
from reelscribe.operators import incremental as inc
from reelscribe.operators import reports as rp
from reelscribe.plans import views as v
from reelscribe.plans.registry import query
from reelscribe.plans.text_queries import sql_replace_word


def doc_paragraphs(spark, sf):
    """Documents as paragraphs of one segment each; lower-cased so that the terms occur."""
    d = v.docs(spark, sf)
    ident = F.format_string("T%06d", F.col("doc_id"))
    return d.select(F.col("doc_id").alias("paragraph_no"), F.format_string("PAR%06d", F.col("doc_id")).alias("paragraph_id"), F.lower("text").alias("text_clean"),
                    F.array(ident).alias("source_segment_ids"))


def suggestions(spark, sf):
    t = v.terms(spark, sf)
    original = F.when(F.col("n") % 5 == 0, F.concat(F.split("original", " ")[0], F.lit(" / "), F.col("original"))).otherwise(F.col("original"))
    suggested = F.when(F.col("n") % 10 == 0, F.concat(F.upper(F.split("original", " ")[0]), F.lit("/"), F.col("suggested"))).otherwise(F.col("suggested"))
    return t.select(F.col("term_no").alias("suggestion_no"), original.alias("original"), suggested.alias("suggested"), "confidence", "decision")


def cited(spark, sf):
    """The suggestions of a benchmark text cite the documents whose ids are congruent to its own, and two of three cite a known frame."""
    d, t = v.docs(spark, sf), v.terms(spark, sf)
    n = v.read(spark, sf, "benchmark").agg(F.max("item_id") + 1).scalar()
    segs = d.select((F.col("doc_id") % n).alias("item_id"), F.format_string("T%06d", F.col("doc_id")).alias("segment_id")).join(t.select("item_id", "term_no"), "item_id")
    frames = t.select(F.col("term_no").alias("suggestion_no"), F.concat(F.lit("F"), (F.col("n") % 3).cast("string")).alias("frame_id"))
    return segs.select(F.col("term_no").alias("suggestion_no"), "segment_id").unionByName(frames, allowMissingColumns=True)


def known_frames(spark, sf):
    return v.read(spark, sf, "region").select(F.concat(F.lit("F"), F.col("r_regionkey").cast("string")).alias("frame_id")).filter("frame_id <> 'F2'")


def _occurs(text, term):
    return f"regexp_matches({text}, '(^|[^A-Za-z])' || regexp_replace({term}, '([^A-Za-z0-9 ])', '\\\\\\1', 'g') || '([^A-Za-z]|$)')"


def _found(text, term):
    return f"({term} <> '' AND CASE WHEN regexp_matches(replace(replace({term}, '-', ''), ' ', ''), '^[A-Za-z0-9]+$') THEN {_occurs(text, term)} ELSE contains({text}, {term}) END)"


PROPOSE_SQL = v.TERM_SQL + f""",
sg AS (SELECT term_no AS suggestion_no, item_id, n, CASE WHEN n % 5 = 0 THEN split_part(original, ' ', 1) || ' / ' || original ELSE original END AS original,
  CASE WHEN n % 10 = 0 THEN upper(replace(split_part(original, ' ', 1), 'ß', 'ss')) || '/' || suggested ELSE suggested END AS suggested, confidence, decision FROM tm),
al AS (SELECT *, string_split(original, '/') AS os, string_split(suggested, '/') AS ss FROM sg),
ax AS (SELECT suggestion_no, item_id, n, confidence, decision, i - 1 AS alt_no, trim(os[i]) AS alt_original, CASE WHEN len(os) = len(ss) THEN trim(ss[i]) ELSE suggested END AS alt_suggested FROM (SELECT *, unnest(generate_series(1, len(os))) AS i FROM al)),
dp AS (SELECT doc_id AS paragraph_no, lower(text) AS t, doc_id % (SELECT max(item_id) + 1 FROM benchmark) AS item_id FROM documents),
nr AS (SELECT ax.*, paragraph_no, t FROM ax JOIN dp USING (item_id) WHERE contains(t, alt_original) OR contains(t, replace(alt_original, ' ', ''))),
mt AS (SELECT nr.*, CASE WHEN {_found('t', 'alt_original')} THEN alt_original WHEN {_found('t', "replace(alt_original, ' ', '')")} THEN replace(alt_original, ' ', '') END AS original_text FROM nr),
fs AS (SELECT *, row_number() OVER (PARTITION BY paragraph_no, original_text ORDER BY suggestion_no, alt_no) AS rn FROM mt WHERE original_text IS NOT NULL),
cr AS (SELECT printf('C%06d', row_number() OVER (ORDER BY suggestion_no, alt_no, paragraph_no)) AS correction_id, paragraph_no, suggestion_no, n, original_text, alt_suggested AS suggested_text, confidence,
  CASE WHEN decision = 'accepted' AND (confidence <> 'high' OR n % 3 = 2) THEN 'pending' ELSE decision END AS decision FROM fs WHERE rn = 1)"""


def proposed(spark, sf):
    return co.propose_corrections(suggestions(spark, sf), cited(spark, sf), doc_paragraphs(spark, sf), known_frames(spark, sf))


@query("j6_propose_corrections", f"WITH {PROPOSE_SQL} SELECT correction_id, paragraph_no, suggestion_no, original_text, suggested_text, confidence, decision, decision = 'accepted' AS applied FROM cr")
def j6(spark, sf):
    return proposed(spark, sf)[0].select("correction_id", "paragraph_no", "suggestion_no", "original_text", "suggested_text", "confidence", "decision", "applied")


# A correction covers the suggestions that hold its original and share a segment with its own: those of the same benchmark text.
@query("j6_skipped_suggestions", f"""
WITH {PROPOSE_SQL}, ci AS (SELECT DISTINCT item_id, original_text FROM cr JOIN sg USING (suggestion_no)),
os AS (SELECT suggestion_no, item_id, unnest(string_split(original, '/')) AS original_text FROM sg)
SELECT suggestion_no FROM sg WHERE suggestion_no NOT IN (SELECT suggestion_no FROM os JOIN ci USING (item_id, original_text)
  WHERE EXISTS (SELECT 1 FROM cr JOIN sg s2 USING (suggestion_no) WHERE s2.item_id = os.item_id AND cr.original_text = os.original_text))""")
def j6_skipped(spark, sf):
    return proposed(spark, sf)[1].select("suggestion_no")


@query("j6_correction_members", f"""
WITH {PROPOSE_SQL} SELECT correction_id, 'segment' AS kind, 1 AS position, printf('T%06d', paragraph_no) AS ref_id FROM cr
UNION ALL SELECT correction_id, 'frame', 1, 'F' || CAST(n % 3 AS VARCHAR) FROM cr WHERE n % 3 <> 2""")
def j6_members(spark, sf):
    """Each document is one segment, so a correction has one segment and at most one known frame."""
    return co.correction_members(proposed(spark, sf)[0], cited(spark, sf), doc_paragraphs(spark, sf), known_frames(spark, sf))


def term_corrections(spark, sf):
    """One correction per document and accepted-or-pending word: ``the``, ``der``, ``que`` in turn; later ones may miss."""
    rows = (("the", "THE$1"), ("der", "DER"), ("é", "e"), ("THE", "The"))
    items = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(o).alias("original_text"), F.lit(s).alias("suggested_text")) for i, (o, s) in enumerate(rows)])
    d = v.docs(spark, sf).select(F.col("doc_id"), F.explode(items).alias("x")).select("doc_id", "x.*")
    return d.withColumn("correction_id", F.format_string("C%06d-%d", F.col("doc_id"), F.col("ord"))).withColumn("applied", (F.col("doc_id") + F.col("ord")) % 4 != 0)


def _apply_sql():
    t, out = "text", []
    for i, (o, s, word) in enumerate((("the", "THE$1", True), ("der", "DER", True), ("é", "e", False), ("THE", "The", True))):
        replaced = sql_replace_word(t, f"'{o}'", f"'{s}'") if word else f"replace({t}, '{o}', '{s}')"
        hit = f"regexp_matches({t}, '(^|[^A-Za-z]){o}([^A-Za-z]|$)')" if word else f"contains({t}, '{o}')"
        act = f"(doc_id + {i}) % 4 <> 0"
        out.append(f"s{i} AS (SELECT doc_id, CASE WHEN {act} AND {hit} THEN {replaced} ELSE {t} END AS text, missed || CASE WHEN {act} AND NOT {hit} THEN printf('C%06d-{i}|', doc_id) ELSE '' END AS missed FROM {'s' + str(i - 1) if i else 'base'})")
    return "WITH base AS (SELECT doc_id, text, '' AS missed FROM documents), " + ", ".join(out) + " SELECT doc_id, text AS text_corrected, rtrim(missed, '|') AS not_applied, CAST(4 AS INTEGER) AS listed FROM s3"


@query("j7_apply_corrections", _apply_sql())
def j7(spark, sf):
    out = co.apply_corrections(v.docs(spark, sf).select("doc_id", "text"), term_corrections(spark, sf), "doc_id", "text")
    return out.select("doc_id", "text_corrected", v.listed(F.col("not_applied")).alias("not_applied"), F.size("correction_ids").alias("listed"))


_FIRST_FIX = "CASE WHEN contains({t}, {a}) THEN substr({t}, 1, strpos({t}, {a}) - 1) || {b} || substr({t}, strpos({t}, {a}) + length({a})) ELSE {t} END"


@query("j7_first_occurrence", f"""
WITH {v.SEG_SQL}, one AS (SELECT *, {_FIRST_FIX.format(t="text_raw", a="'th'", b="'TH$1'")} AS t1 FROM seg)
SELECT segment_id, {_FIRST_FIX.format(t="t1", a="'en '", b="''")} AS text_corrected, array_to_string(list_filter([CASE WHEN NOT contains(text_raw, 'th') THEN 'C1' END, CASE WHEN NOT contains(t1, 'en ') THEN 'C2' END], lambda c: c IS NOT NULL), '|') AS not_applied FROM one""")
def j7_first(spark, sf):
    """Two corrections of every segment, first occurrence only, the second one after the first."""
    s = v.segments(spark, sf)
    item = lambda n, a, b: F.struct(F.lit(n).alias("ord"), F.lit(f"C{n}").alias("correction_id"), F.lit(a).alias("original_text"), F.lit(b).alias("suggested_text"), F.lit(True).alias("applied"))
    fixes = s.select("segment_id", F.explode(F.array(item(1, "th", "TH$1"), item(2, "en ", ""))).alias("c")).select("segment_id", "c.*")
    out = co.apply_corrections(s.select("segment_id", "text_raw"), fixes, "segment_id", "text_raw", first_only=True)
    return out.select("segment_id", "text_corrected", v.listed(F.col("not_applied")).alias("not_applied"))


@query("j8_apply_overrides", """
SELECT printf('C%06d', o_orderkey) AS correction_id, CASE WHEN o_orderkey % 97 = 0 THEN 'fixed ' || CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END AS suggested_text, CASE WHEN o_orderkey % 97 = 0 THEN 'rejected' ELSE 'accepted' END AS decision,
 CASE WHEN o_orderkey % 97 = 0 THEN 'low' ELSE 'high' END AS confidence, o_orderkey % 97 <> 0 AS applied, CASE WHEN o_orderkey % 97 = 0 THEN 'independent audit: ' || o_orderstatus ELSE 'first' END AS reason FROM orders""")
def j8(spark, sf):
    o = v.read(spark, sf, "orders").withColumn("correction_id", F.format_string("C%06d", F.col("o_orderkey")))
    c = o.select("correction_id", F.col("o_orderpriority").alias("suggested_text"), F.lit("accepted").alias("decision"), F.lit("high").alias("confidence"), F.lit(True).alias("applied"), F.lit("first").alias("reason"))
    over = o.filter("o_orderkey % 97 = 0").select("correction_id", F.concat(F.lit("fixed "), F.col("o_custkey").cast("string")).alias("suggested_text"), F.lit("rejected").alias("decision"),
                                                  F.lit("low").alias("confidence"), F.col("o_orderstatus").alias("reason"))
    return co.apply_overrides(c, over)[0]


@query("j8_unknown_overrides", "SELECT printf('C%06d', o_orderkey) AS correction_id FROM orders WHERE o_orderkey % 97 = 0 AND o_orderstatus = 'P'")
def j8_unknown(spark, sf):
    """Overrides of every 97th order, while corrections exist only for orders that are not pending."""
    o = v.read(spark, sf, "orders").withColumn("correction_id", F.format_string("C%06d", F.col("o_orderkey")))
    fields = ["correction_id", F.col("o_orderpriority").alias("suggested_text"), F.lit("accepted").alias("decision"), F.lit("high").alias("confidence"), F.col("o_orderstatus").alias("reason")]
    c = o.filter("o_orderstatus <> 'P'").select(*fields, F.lit(True).alias("applied"))
    return co.apply_overrides(c, o.filter("o_orderkey % 97 = 0").select(*fields))[1]


@query("j5_link_by_shared_ids", """
SELECT DISTINCT l_orderkey AS evidence_id, s_nationkey AS section_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""")
def j5(spark, sf):
    e = v.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), "l_suppkey")
    s = v.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("section_id"), "s_suppkey")
    return ev.link_by_shared_ids(e, "evidence_id", "l_suppkey", s, "section_id", "s_suppkey")


@query("j9_find_dangling_references", """
SELECT DISTINCT l_orderkey AS evidence_id, 'part' AS kind, CAST(l_partkey AS VARCHAR) AS missing FROM lineitem WHERE l_partkey % 101 = 0
UNION ALL SELECT DISTINCT l_orderkey, 'supplier', CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_suppkey % 101 = 0 UNION ALL SELECT DISTINCT l_orderkey, 'order', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey % 101 = 0""")
def j9(spark, sf):
    l = v.read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "evidence_id")
    parents = {t: v.read(spark, sf, t) for t in ("part", "supplier", "orders")}
    lines = ev.find_dangling_references(l, "evidence_id", {
        "part": (F.array("l_partkey"), parents["part"].filter("p_partkey % 101 <> 0"), "p_partkey"),
        "supplier": (F.array("l_suppkey"), parents["supplier"].filter("s_suppkey % 101 <> 0"), "s_suppkey")})
    # All lines of an order name the same one.
    return lines.unionByName(ev.find_dangling_references(l.select("evidence_id").distinct(), "evidence_id", {
        "order": (F.array("evidence_id"), parents["orders"].filter("o_orderkey % 101 <> 0"), "o_orderkey")}))


@query("j12_compare_independent_passes", """
WITH r AS (SELECT d.doc_id AS f, substr(md5(text), 1, 6) AS latex, quality, toxic, d.doc_id % 5 AS k FROM documents d LEFT JOIN labels USING (doc_id)),
e AS (SELECT *, CASE WHEN quality IS NULL THEN 'no_blind_observation' WHEN f % 17 = 0 THEN 'no_matching_comparison' WHEN f % 19 = 0 THEN 'comparison_too_early' WHEN f % 23 = 0 THEN 'frame_differs' END AS error,
 quality = 1 AND toxic = 0 AND k < 2 AS ok FROM r)
SELECT f AS formula_id, error, CASE WHEN quality IS NOT NULL THEN ['exact_match', 'equivalent', 'minor_difference', 'material_difference', 'unverifiable'][k + 1] END AS comparison,
 CASE WHEN error IS NULL THEN CASE WHEN ok THEN 'verified' ELSE 'needs_review' END END AS audited_status, CASE WHEN error IS NULL THEN CASE WHEN ok THEN 'high' ELSE 'low' END END AS audited_confidence, CASE WHEN error IS NULL AND ok THEN latex ELSE '' END AS audited_latex FROM e""")
def j12(spark, sf):
    d = v.docs(spark, sf).select(F.col("doc_id").alias("formula_id"), F.substring(F.md5("text"), 1, 6).alias("latex"))
    lab = v.read(spark, sf, "labels").join(d.withColumnRenamed("formula_id", "doc_id"), "doc_id")
    n = F.col("doc_id")
    blind = lab.select(n.alias("formula_id"), F.when(n % 23 == 0, n + 1).otherwise(n).alias("blind_frame"), F.lit(100).alias("observed_at"),
                       F.create_map(F.lit("softmax"), F.col("quality") == 1, F.lit("sum"), F.lit(True)).alias("symbols"), F.when(F.col("toxic") == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("uncertain"),
                       F.lit(False).alias("latex_consulted"))
    later = lab.select(n.alias("formula_id"), F.when(n % 17 == 0, "other").otherwise(F.col("latex")).alias("seen_latex"), F.when(n % 19 == 0, 99).otherwise(101).alias("compared_at"),
                       F.get(F.array(*[F.lit(c) for c in rp.COMPARISONS]), (n % 5).cast("int")).alias("comparison"), F.col("latex").alias("audited_latex"), F.lit("high").alias("audited_confidence"))
    return ev.compare_independent_passes(d.withColumn("frame_id", F.col("formula_id")), blind, later)


@query("j13_diff_manifests", """
SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM orders WHERE o_orderkey % 101 = 0 OR o_orderkey % 97 = 0""")
def j13(spark, sf):
    o, k = v.order_rows(spark, sf), F.col("o_orderkey")
    # Half of the changes are in the price, half in the last column.
    changed = o.filter(k % 101 != 0).withColumns({
        "cents": F.col("cents") + F.when((k % 97 == 0) & (k % 2 == 0), 100).otherwise(0),
        "o_orderpriority": F.when((k % 97 == 0) & (k % 2 == 1), F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority"))})
    a, b = (inc.snapshot(rows, ["o_orderkey"], v.ORDER_COLUMNS) for rows in (o, changed))
    return inc.diff_manifests(a, b, ["o_orderkey"], "hash").select("o_orderkey", "problem")


@query("j14_check_set_equality", """
WITH d AS (SELECT DISTINCT user_id, event_id % 50 AS image FROM events WHERE event_type <> 'error'), o AS (SELECT DISTINCT user_id, event_id % 50 AS image FROM events WHERE event_type <> 'view')
SELECT *, 'missing' AS problem FROM (SELECT * FROM d EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM o EXCEPT SELECT * FROM d)""")
def j14(spark, sf):
    e = v.read(spark, sf, "events").withColumn("image", F.col("event_id") % 50)
    return ev.check_set_equality(e.filter("event_type <> 'error'"), e.filter("event_type <> 'view'"), ["user_id", "image"])


@query("a8_decision_counts", """
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS accepted, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'X') AS rejected FROM orders GROUP BY 1""")
def a8(spark, sf):
    o = v.read(spark, sf, "orders").withColumn("decision", F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "X", "rejected"))
    return o.groupBy("o_orderpriority").agg(*rp.counts_over(o, [], "decision", ("accepted", "pending", "rejected")))


def audits(spark, sf):
    lab, n = v.read(spark, sf, "labels"), F.col("doc_id")
    assessment = F.when(F.col("quality") == 1, "supported").when(n % 3 == 0, "partially_supported").when(n % 3 == 1, "unsupported").otherwise("unverifiable")
    meaning = F.col("toxic") == 0
    decision = F.when(~meaning, "rejected").when(F.col("quality") == 1, "accepted").otherwise("pending")
    return lab.select("doc_id", n.alias("ord"), F.format_string("C%06d", n).alias("correction_id"), assessment.alias("assessment"), meaning.alias("meaning_preserved"), decision.alias("decision"),
                      F.get(F.array(*[F.lit(c) for c in rp.COMPARISONS]), (n % 5).cast("int")).alias("comparison"), F.when(F.col("quality") == 1, "high").otherwise("low").alias("confidence"),
                      (F.col("toxic") == 1).alias("critical_error"))


AUDIT_SQL = """
au AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'supported' WHEN doc_id % 3 = 0 THEN 'partially_supported' WHEN doc_id % 3 = 1 THEN 'unsupported' ELSE 'unverifiable' END AS assessment, toxic = 0 AS meaning_preserved,
 CASE WHEN toxic <> 0 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'pending' END AS decision, ['exact_match', 'equivalent', 'minor_difference', 'material_difference', 'unverifiable'][doc_id % 5 + 1] AS comparison,
 CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS confidence, toxic = 1 AS critical_error, source FROM labels JOIN documents USING (doc_id))"""
_PRECISION_SQL = ", ".join(f"count(*) FILTER (WHERE assessment = '{a}') AS {a}" for a in ("supported", "partially_supported", "unsupported", "unverifiable")) + ", " + ", ".join(
    f"count(*) FILTER (WHERE decision = '{d}') AS {d}" for d in ("accepted", "pending", "rejected"))


@query("a9_audit_precision", f"""
WITH {AUDIT_SQL} SELECT source, count(*) AS audited_count, {_PRECISION_SQL}, count(*) FILTER (WHERE NOT meaning_preserved) AS meaning_changing_errors, round(count(*) FILTER (WHERE assessment = 'supported')::DOUBLE / count(*)::DOUBLE, 6) AS accepted_precision,
 count(*) FILTER (WHERE assessment = 'supported')::DOUBLE / count(*) >= 0.95 AS passed FROM au GROUP BY source""")
def a9(spark, sf):
    return rp.audit_precision(audits(spark, sf).join(v.docs(spark, sf).select("doc_id", "source"), "doc_id"), ["source"])


@query("a10_formula_audit_summary", f"""
WITH {AUDIT_SQL} SELECT source, count(*) AS formula_count, {', '.join(f"count(*) FILTER (WHERE comparison = '{c}') AS {c}" for c in ('exact_match', 'equivalent', 'minor_difference', 'material_difference', 'unverifiable'))},
 {', '.join(f"count(*) FILTER (WHERE confidence = '{c}') AS confidence_{c}" for c in ('high', 'medium', 'low'))}, count(*) FILTER (WHERE critical_error) AS critical_errors FROM au GROUP BY source""")
def a10(spark, sf):
    return rp.formula_audit_summary(audits(spark, sf).join(v.docs(spark, sf).select("doc_id", "source"), "doc_id"), ["source"])


@query("a11_reconcile_terms", f"""
WITH c AS (SELECT doc_id AS ord, doc_id AS segment_id, trim(regexp_replace({v.sql_casefold('text')}, '{v.SQL_WS}+', ' ', 'g'), ' ') AS normalized_term, len(regexp_extract_all(text, '{tx.LATIN_TOKEN}')) AS signals FROM documents),
f AS (SELECT normalized_term, min(ord) AS group_ord FROM c GROUP BY 1)
SELECT c.ord, segment_id, normalized_term, group_ord, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN toxic <> 0 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'pending' END || '_correction' WHEN c.ord > group_ord THEN 'duplicate' WHEN signals > 0 THEN 'normal_term' ELSE 'noise' END AS status
FROM c JOIN f USING (normalized_term) LEFT JOIN labels l ON l.doc_id = c.segment_id AND l.doc_id % 2 = 0""")
def a11(spark, sf):
    c = v.docs(spark, sf).select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("segment_id"), "text", F.size(F.regexp_extract_all("text", F.lit(tx.LATIN_TOKEN), 0)).alias("signals"))
    linked = audits(spark, sf).filter("doc_id % 2 = 0").select(F.col("doc_id").alias("segment_id"), "ord", "decision")
    return rp.reconcile_terms(c, linked)


def tokens(spark, sf):
    """Latin tokens of every document in order; ``ord`` orders all of them."""
    d = v.docs(spark, sf).select("doc_id", "lang", F.posexplode(latin_tokens()).alias("pos", "term"))
    return d.withColumn("ord", F.col("doc_id") * 1_000_000 + F.col("pos"))


def latin_tokens():
    return F.regexp_extract_all("text", F.lit(r"[A-Za-zßé]+"), 0)


def cited_terms(spark, sf):
    """The tokens of each document once, in order of their first places; two of three documents show a frame. Distinct within the row, without a shuffle."""
    d = v.docs(spark, sf).select("doc_id", "lang", F.posexplode(F.array_distinct(latin_tokens())).alias("pos", "term"))
    frames = F.when(F.col("doc_id") % 3 > 0, F.array(F.floor(F.col("doc_id") / 5).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return d.select("doc_id", (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("ord"), "term", F.col("lang").alias("confidence"), F.array("term").alias("aliases"),
                    F.array("doc_id").alias("transcript_ids"), frames.alias("frame_ids"), (F.col("doc_id") * 10).alias("paragraph_start"))


def term_definitions(spark, sf):
    """The last definition of each token: it names the last document that has it. ``ord`` follows the last places in the documents."""
    d = v.docs(spark, sf).select("doc_id", F.posexplode(F.array_distinct(F.reverse(latin_tokens()))).alias("pos", "term"))
    last = d.withColumn("ord", F.col("doc_id") * 1_000_000 - F.col("pos")).groupBy("term").agg(F.max("ord").alias("ord"), F.max("doc_id").alias("doc_id"))
    return last.select("ord", "term", F.concat("term", F.col("doc_id").cast("string")).alias("definition"))


TOKEN_SQL = "tk AS (SELECT doc_id, lang, term, doc_id * 1000000 + i - 1 AS ord FROM (SELECT doc_id, lang, unnest(l) AS term, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, lang, regexp_extract_all(text, '[A-Za-zßé]+') AS l FROM documents)))"


@query("a13_merge_glossary", f"""
WITH {TOKEN_SQL}, {v.TERM_SQL}, k AS (SELECT *, {v.sql_casefold('term')} AS key FROM tk),
g AS (SELECT key, arg_min(term, ord) AS term, arg_min(lang, ord) AS confidence, array_to_string(list_sort(list_distinct(list(term))), '|') AS aliases, count(DISTINCT doc_id) AS evidence_count,
  count(DISTINCT doc_id // 5) FILTER (WHERE doc_id % 3 > 0) AS frame_count, min(doc_id * 10) AS first_start, arg_max(term || CAST(doc_id AS VARCHAR), ord) AS definition FROM k GROUP BY key),
w AS (SELECT {v.sql_casefold("upper(split_part(original, ' ', 1))")} AS key, array_to_string(list_sort(list_distinct(list(original))), '|') AS incorrect FROM tm WHERE decision = 'accepted' GROUP BY 1)
SELECT key, term, confidence, CASE WHEN regexp_matches(term, '^[\x00-\x7f]*$') THEN term END AS english, aliases, coalesce(incorrect, '') AS incorrect, definition, evidence_count, frame_count, first_start FROM g LEFT JOIN w USING (key)""")
def a13(spark, sf):
    fixes = v.terms(spark, sf).select(F.col("original").alias("original_text"), F.upper(F.split("original", " ")[0]).alias("suggested_text"), (F.col("decision") == "accepted").alias("applied"))
    out = rp.merge_glossary(cited_terms(spark, sf), term_definitions(spark, sf), fixes)
    return out.withColumns({"aliases": v.listed(F.col("aliases")), "incorrect": v.listed(F.col("incorrect"))})


@query("a13_term_members", f"""
WITH {TOKEN_SQL}, k AS (SELECT DISTINCT {v.sql_casefold('term')} AS key, doc_id FROM tk), f AS (SELECT DISTINCT key, doc_id // 5 AS ref FROM k WHERE doc_id % 3 > 0)
SELECT key, 'segment' AS kind, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS position, CAST(doc_id AS VARCHAR) AS ref_id FROM k
UNION ALL SELECT key, 'frame', row_number() OVER (PARTITION BY key ORDER BY ref), CAST(ref AS VARCHAR) FROM f""")
def a13_members(spark, sf):
    return rp.glossary_members(cited_terms(spark, sf))


@query("a13_merge_term_runs", f"WITH {TOKEN_SQL} SELECT {v.sql_casefold('term')} AS key, arg_min(term, ord) AS term, min(ord) AS ord FROM tk GROUP BY 1")
def a13_runs(spark, sf):
    return rp.merge_term_runs(tokens(spark, sf))


@query("a14_dedupe_concepts", f"WITH {TOKEN_SQL} SELECT {v.sql_casefold('term')} AS key, arg_min(term, ord) AS concept, min(ord) AS ord FROM tk GROUP BY 1")
def a14(spark, sf):
    return rp.dedupe_concepts(tokens(spark, sf).withColumnRenamed("term", "concept"))


@query("a18_release_gate", f"""
WITH {AUDIT_SQL}, m AS (SELECT count(*) AS formula_count, count(*) FILTER (WHERE critical_error) AS critical_errors, round(count(*) FILTER (WHERE assessment = 'supported')::DOUBLE / count(*)::DOUBLE, 6) AS accepted_precision FROM au),
d AS (SELECT count(*) AS evidence_errors FROM lineitem WHERE l_partkey % 101 = 0)
SELECT formula_count, critical_errors, accepted_precision, evidence_errors, critical_errors = 0 AS ok_no_critical_errors, accepted_precision >= 0.95 AS ok_precision, evidence_errors = 0 AS ok_evidence,
 CASE WHEN critical_errors = 0 AND accepted_precision >= 0.95 AND evidence_errors = 0 THEN 'passed' ELSE 'partial' END AS result FROM m, d""")
def a18(spark, sf):
    a = audits(spark, sf).join(v.docs(spark, sf).select("doc_id"), "doc_id")
    formulas = rp.formula_audit_summary(a).select("formula_count", "critical_errors")
    precision = rp.audit_precision(a).select("accepted_precision")
    errors = v.read(spark, sf, "lineitem").agg(F.count(F.when(F.col("l_partkey") % 101 == 0, 1)).alias("evidence_errors"))
    metrics = rp.side_by_side(formulas, precision, errors)
    return rp.release_gate(metrics, {"no_critical_errors": F.col("critical_errors") == 0, "precision": F.col("accepted_precision") >= 0.95, "evidence": F.col("evidence_errors") == 0})


def _fix_audits(spark, sf):
    a = audits(spark, sf).join(v.docs(spark, sf).select("doc_id", "source"), "doc_id")
    a = a.select("ord", "correction_id", (F.col("decision") != "accepted").alias("fix_required"), F.col("source").alias("corrected_text"), F.lit("accepted").alias("existing_decision"),
                 F.concat("source", F.lit("!")).alias("audited_suggested_text"), F.col("decision").alias("audited_decision"), F.col("confidence").alias("audited_confidence"),
                 F.when(F.col("doc_id") % 2 == 0, F.col("assessment")).alias("fix_reason"), F.array(F.format_string("T%06d", F.col("doc_id"))).alias("transcript_evidence"),
                 F.array(F.format_string("F%06d", F.col("doc_id"))).alias("visual_evidence"))
    return a


@query("a19_build_fix_log", f"""
WITH {AUDIT_SQL}, f AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM au WHERE decision <> 'accepted')
SELECT printf('FIX%04d', n) AS fix_id, 'correction' AS target_type, printf('C%06d', doc_id) AS target_id, '{{"suggested_text":"' || source || '","decision":"accepted"}}' AS before, '{{"suggested_text":"' || source || '!","decision":"' || decision || '"}}' AS after,
 CASE WHEN doc_id % 2 = 0 THEN assessment ELSE 'Independent evidence audit' END AS reason, printf('T%06d|F%06d', doc_id, doc_id) AS evidence FROM f""")
def a19(spark, sf):
    log, _ = rp.build_fix_log(_fix_audits(spark, sf))
    return log.withColumn("evidence", v.listed(F.col("evidence")))


@query("a19_fix_overrides", f"""
WITH {AUDIT_SQL}, f AS (SELECT * FROM au WHERE decision <> 'accepted')
SELECT printf('C%06d', doc_id) AS correction_id, source || '!' AS suggested_text, decision, confidence, CASE WHEN doc_id % 2 = 0 THEN assessment END AS reason FROM f""")
def a19_overrides(spark, sf):
    """The override rows that the fixes hand to J8."""
    return rp.build_fix_log(_fix_audits(spark, sf))[1]


@query("a20_first_mention", f"""
WITH {v.TERM_SQL}, s AS (SELECT doc_id * 100 AS start_ms, replace(lower(text), '-', ' ') AS t FROM documents), k AS (SELECT DISTINCT original FROM tm)
SELECT original AS term, coalesce(min(start_ms), -1) AS first_start FROM k LEFT JOIN s ON contains(t, replace(original, '-', ' ')) GROUP BY original""")
def a20(spark, sf):
    t = v.terms(spark, sf).select(F.col("original").alias("term")).distinct()
    return co.first_mention(t, v.docs(spark, sf).withColumn("start_ms", F.col("doc_id") * 100), ["doc_id"], "text", "start_ms", -1)
