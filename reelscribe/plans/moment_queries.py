"""Queries over frame moments (W10-W13, W20), hashes (D1-D7, J15) and frame reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscribe.operators import evidence as ev
from reelscribe.operators import intervals as iv
from reelscribe.operators import moments as mo
from reelscribe.operators import neardup as nd
from reelscribe.operators import paragraphs as pg
from reelscribe.operators import reports as rp
from reelscribe.operators import timeline as tl
from reelscribe.plans import views as v
from reelscribe.plans.registry import query
from reelscribe.session import stage_table

TOLERANCE = 7_200_000
MERGE_SQL = v.MOM_SQL + f""",
ordered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t, source_rank, event_id) AS n FROM mom),
walk AS (
  SELECT job_id, n, event_id, t AS anchor, 1 AS cluster FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.job_id, o.n, o.event_id, CASE WHEN o.t - w.anchor <= {TOLERANCE} THEN w.anchor ELSE o.t END, w.cluster + CASE WHEN o.t - w.anchor <= {TOLERANCE} THEN 0 ELSE 1 END
  FROM walk w JOIN ordered o ON o.job_id = w.job_id AND o.n = w.n + 1),
merged AS (
  SELECT job_id, CAST(w.cluster AS BIGINT) AS cluster, arg_min(m.event_id, w.n) AS anchor_id, min(m.t) AS t, count(*) AS merged,
         array_to_string(list_sort(list_distinct(list(m.reason))), '|') AS reasons, coalesce(array_to_string(list_sort(list_distinct(list(m.cue_term) FILTER (WHERE m.cue_term IS NOT NULL))), '|'), '') AS cue_terms, max(m.scene_score) AS scene_score
  FROM walk w JOIN mom m USING (job_id, event_id) GROUP BY 1, 2)"""


def merged(spark, sf):
    rows, line = tl.split_hot_blocks(v.moments(spark, sf), v.MOM_LINE)
    return mo.merge_moments(rows, line, "t", "event_id", TOLERANCE)


def _flat(df):
    return df.withColumns({"reasons": v.listed(F.col("reasons")), "cue_terms": v.listed(F.col("cue_terms"))})


@query("w10_merge_moments", f"WITH RECURSIVE {MERGE_SQL} SELECT * FROM merged")
def w10(spark, sf):
    return _flat(merged(spark, sf))


_FRAGMENTS = ("cue1", "cue2")
_PRIORITY_SQL = "CASE WHEN cue_term LIKE '%cue1%' OR cue_term LIKE '%cue2%' THEN 4 WHEN reason = 'subtitle_cue' THEN 3 WHEN reason = 'scene_change' THEN 2 ELSE 1 END"


def prioritised(spark, sf):
    return v.moments(spark, sf).withColumn("priority", mo.priority(F.col("reasons"), F.col("cue_terms"), _FRAGMENTS))


def _order():
    return [F.desc("priority"), F.desc(F.coalesce("scene_score", F.lit(0.0))), F.asc("t"), F.asc("event_id")]


_ORDER_SQL = f"{_PRIORITY_SQL} DESC, coalesce(scene_score, 0) DESC, t, event_id"


@query("w11_rank_and_cap", f"""
WITH {v.MOM_SQL}, r AS (SELECT *, {_PRIORITY_SQL} AS priority, row_number() OVER (PARTITION BY job_id ORDER BY {_ORDER_SQL}) AS rank FROM mom)
SELECT job_id, event_id, priority, rank FROM r WHERE rank <= 24""")
def w11(spark, sf):
    kept, _ = mo.rank_and_cap(prioritised(spark, sf), "job_id", _order(), 24)
    return kept.select("job_id", "event_id", "priority", "rank")


@query("w11_budget_dropped", f"WITH {v.MOM_SQL} SELECT job_id, greatest(0, count(*) - 24) AS dropped FROM mom GROUP BY job_id")
def w11_dropped(spark, sf):
    return mo.rank_and_cap(prioritised(spark, sf), "job_id", _order(), 24)[1]


@query("w12_stratified_top_n", f"""
WITH {v.MOM_SQL}, {v.RANGE_SQL}, c AS (SELECT job_id, count(*) AS n FROM mom GROUP BY job_id),
s AS (SELECT job_id, n, range_start, range_end, greatest(1, CAST(ceil((range_end - range_start) / 300000000) AS BIGINT)) AS b FROM c JOIN rng ON part_id = job_id),
f AS (SELECT m.*, n, b, greatest(1, 60 // b) AS budget, CASE WHEN t = range_end THEN b - 1 ELSE (t - range_start) // 300000000 END AS bucket FROM mom m JOIN s USING (job_id) WHERE n <= 60 OR (t >= range_start AND t <= range_end)),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, bucket ORDER BY {_ORDER_SQL}) AS rn FROM f)
SELECT job_id, event_id, bucket FROM r WHERE n <= 60 OR rn <= budget""")
def w12(spark, sf):
    ranges = v.job_ranges(spark, sf, "job_id")
    out = mo.stratified_top_n(prioritised(spark, sf), ranges, "job_id", "t", _order(), 60, 300_000_000)
    return out.select("job_id", "event_id", "bucket")


_DAY = 86_400_000


def packets(spark, sf, dynamic=False):
    return pg.plan_packets(v.job_ranges(spark, sf, "job_id"), "job_id", span=_DAY, context=_DAY // 10, dynamic=dynamic)


PACKET_SQL = v.RANGE_SQL + f""",
pk AS (SELECT part_id AS job_id, n + 1 AS packet_no, printf('P%04d', n + 1) AS packet_id, n * {_DAY} AS primary_start, CASE WHEN n = c - 1 THEN range_end ELSE (n + 1) * {_DAY} END AS primary_end,
  greatest(range_start, n * {_DAY} - {_DAY // 10}) AS context_start, least(range_end, CASE WHEN n = c - 1 THEN range_end ELSE (n + 1) * {_DAY} END + {_DAY // 10}) AS context_end
  FROM (SELECT *, unnest(generate_series(0, c - 1)) AS n FROM (SELECT *, greatest(1, CAST(ceil((range_end - range_start) / {_DAY}) AS BIGINT)) AS c FROM rng)))"""
_BIN_SQL = f"""
b AS (SELECT pk.job_id, packet_id, CAST(floor((t - primary_start) * 6 / (primary_end - primary_start)) AS BIGINT) AS bin, event_id AS frame_id, t, has_cue, is_scene, coalesce(scene_score, 0) AS s
      FROM mom JOIN pk ON mom.job_id = pk.job_id AND t >= primary_start AND t < primary_end),
bb AS (SELECT *, row_number() OVER (PARTITION BY job_id, packet_id, bin ORDER BY has_cue DESC, is_scene DESC, s DESC, t, frame_id) AS rn FROM b)"""


@query("w13_pick_per_bin", f"WITH {v.MOM_SQL}, {PACKET_SQL}, {_BIN_SQL} SELECT job_id, packet_id, bin, frame_id, t FROM bb WHERE rn = 1")
def w13(spark, sf):
    frames = v.moments(spark, sf).withColumnRenamed("event_id", "frame_id")
    return mo.pick_per_bin(frames, packets(spark, sf), "job_id", "packet_id", "t", bin_size=_DAY)


_FAR = 40 * _DAY


@query("w13_pick_with_fallback", f"""
WITH {v.MOM_SQL}, {PACKET_SQL.replace("pk AS (SELECT", "pk0 AS (SELECT")},
pk AS (SELECT * REPLACE (primary_start + CASE WHEN packet_no % 3 = 0 THEN {_FAR} ELSE 0 END AS primary_start, primary_end + CASE WHEN packet_no % 3 = 0 THEN {_FAR} ELSE 0 END AS primary_end) FROM pk0), {_BIN_SQL},
em AS (SELECT pk.* FROM pk ANTI JOIN b ON b.job_id = pk.job_id AND b.packet_id = pk.packet_id),
fb AS (SELECT em.job_id, em.packet_id, arg_min((mom.event_id, mom.t), (abs(2 * mom.t - primary_start - primary_end), mom.event_id)) AS f FROM em JOIN mom USING (job_id) GROUP BY 1, 2)
SELECT job_id, packet_id, bin, frame_id, t FROM bb WHERE rn = 1 UNION ALL SELECT job_id, packet_id, NULL, f[1], f[2] FROM fb""")
def w13_fallback(spark, sf):
    """Every third packet is moved to a time without moments."""
    frames = v.moments(spark, sf).withColumnRenamed("event_id", "frame_id")
    moved = F.when(F.col("packet_no") % 3 == 0, _FAR).otherwise(0)
    p = packets(spark, sf).withColumns({"primary_start": F.col("primary_start") + moved, "primary_end": F.col("primary_end") + moved})
    return mo.pick_per_bin(frames, p, "job_id", "packet_id", "t", fallback=True, bin_size=_DAY)


HASH_LINE = tl.Timeline(("job_id",), ("t", "frame_no"), "t", 65_536)


@query("w20_alias_adjacent_duplicates", f"""
WITH {v.HASH_SQL}, n AS (SELECT *, frame_no % 5 = 0 AS has_cue, lag(hash_hi) OVER w AS ph, lag(hash_lo) OVER w AS pl, lag(t) OVER w AS pt, lag(frame_no % 5 = 0) OVER w AS pc FROM hs WINDOW w AS (PARTITION BY job_id ORDER BY t, frame_no)),
l AS (SELECT *, coalesce(ph = hash_hi AND pl = hash_lo AND t - pt <= 5 AND NOT pc AND NOT has_cue, false) AS link FROM n),
i AS (SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY t, frame_no) AS island FROM l)
SELECT job_id, frame_no, first_value(frame_no) OVER (PARTITION BY job_id, island ORDER BY t, frame_no) AS canonical_id, NOT link AS active FROM i""")
def w20(spark, sf):
    frames = v.hashes(spark, sf).withColumn("has_cue", F.col("frame_no") % 5 == 0)
    return mo.alias_adjacent_duplicates(frames, HASH_LINE, "frame_no", "t", 5).select("job_id", "frame_no", "canonical_id", "active")


# ---- images --------------------------------------------------------------------------------------

_W, _H = 18, 8


def luma_images(spark, sf):
    """18x8 grey images from the embeddings: value of cell (y, x mod 8) scaled, with a ramp along x."""
    e = v.read(spark, sf, "embeddings")

    def pixel(i):
        x, y = i % _W, F.floor(i / _W).cast("int")
        cell = F.get("embedding", y * 8 + x % 8)
        return ((F.floor((cell.cast("double") + 1) * 100).cast("int") + x * 7) % 256).cast("int")

    return e.select("vec_id", "label", F.transform(F.sequence(F.lit(0), F.lit(_W * _H - 1)), pixel).alias("luma"), F.lit(_W).alias("width"), F.lit(_H).alias("height"))


PIXEL_SQL = f"""
px AS (SELECT vec_id, label, i % {_W} AS x, i // {_W} AS y, (CAST(floor((CAST(embedding[(i // {_W}) * 8 + (i % {_W}) % 8 + 1] AS DOUBLE) + 1) * 100) AS BIGINT) + (i % {_W}) * 7) % 256 AS v
       FROM embeddings, (SELECT unnest(generate_series(0, {_W * _H - 1})) AS i)),
rw AS (SELECT *, lag(v) OVER w + v + lead(v) OVER w AS r3 FROM px WINDOW w AS (PARTITION BY vec_id, y ORDER BY x)),
ed AS (SELECT vec_id, label, x, y, v, CASE WHEN x = 0 OR x = {_W - 1} OR y = 0 OR y = {_H - 1} THEN v
        ELSE greatest(0, least(255, 9 * v - (lag(r3) OVER c + r3 + lead(r3) OVER c))) END AS e FROM rw WINDOW c AS (PARTITION BY vec_id, x ORDER BY y)),
wt(cx, x, w) AS (VALUES {", ".join(f"({i}, {j}, {w})" for i, row in enumerate(nd.resampling_weights(_W, 9).tolist()) for j, w in enumerate(row) if w)}),
cells AS (SELECT vec_id, y, cx, greatest(0, least(255, floor((sum(v * w) + {1 << 21}) / {1 << 22}.0))) AS a FROM px JOIN wt USING (x) GROUP BY 1, 2, 3),
bits AS (SELECT vec_id, y, cx, CASE WHEN a > lead(a) OVER (PARTITION BY vec_id, y ORDER BY cx) THEN 1 ELSE 0 END AS bit FROM cells),
hashed AS (SELECT vec_id, CAST(sum(CASE WHEN y < 4 THEN bit * (CAST(1 AS BIGINT) << (31 - y * 8 - cx)) ELSE 0 END) AS BIGINT) AS hash_hi,
   CAST(sum(CASE WHEN y >= 4 THEN bit * (CAST(1 AS BIGINT) << (31 - (y - 4) * 8 - cx)) ELSE 0 END) AS BIGINT) AS hash_lo FROM bits WHERE cx < 8 GROUP BY vec_id),
met AS (SELECT vec_id, round(avg(CASE WHEN v <= 16 THEN 1.0 ELSE 0.0 END), 6) AS black_ratio, round(avg(v), 6) AS mean_luma, round(stddev_pop(v), 6) AS luma_stddev, round(var_pop(e), 4) AS sharpness FROM ed GROUP BY vec_id)"""


@query("d1_frame_metrics", f"WITH {PIXEL_SQL} SELECT met.*, hash_hi, hash_lo FROM met JOIN hashed USING (vec_id)")
def d1(spark, sf):
    m = luma_images(spark, sf).select("vec_id", nd.frame_metrics(F.col("luma"), F.col("width"), F.col("height")).alias("m"))
    return m.select("vec_id", *[F.round(f"m.{c}", 6).alias(c) for c in ("black_ratio", "mean_luma", "luma_stddev")], F.round("m.sharpness", 4).alias("sharpness"), "m.hash_hi", "m.hash_lo")


def image_pairs(spark, sf):
    """Each image with the next one by id."""
    i = luma_images(spark, sf)
    nxt = i.select((F.col("vec_id") - 1).alias("vec_id"), F.col("luma").alias("other"))
    return i.join(nxt, "vec_id")


@query("d2_pair_change_ratios", f"""
WITH {PIXEL_SQL}, p AS (SELECT a.vec_id, abs(a.v - b.v) AS d, abs(a.e - b.e) AS de FROM ed a JOIN ed b ON b.vec_id = a.vec_id + 1 AND a.x = b.x AND a.y = b.y)
SELECT vec_id, round(avg(CASE WHEN d >= 16 THEN 1.0 ELSE 0.0 END), 6) AS local_ratio, round(avg(CASE WHEN de >= 24 THEN 1.0 ELSE 0.0 END), 6) AS edge_ratio, round(avg(CASE WHEN d >= 64 THEN 1.0 ELSE 0.0 END), 6) AS contrast_ratio FROM p GROUP BY vec_id""")
def d2(spark, sf):
    m = image_pairs(spark, sf).select("vec_id", nd.pair_change_ratios(F.col("luma"), F.col("other"), F.col("width"), F.col("height")).alias("m"))
    return m.select("vec_id", F.round("m.local", 6).alias("local_ratio"), F.round("m.edge", 6).alias("edge_ratio"), F.round("m.contrast", 6).alias("contrast_ratio"))


@query("d3_hamming_distance", f"""
WITH {v.HASH_SQL} SELECT a.frame_no, CAST(bit_count(xor(a.hash_hi, b.hash_hi)) + bit_count(xor(a.hash_lo, b.hash_lo)) AS INTEGER) AS distance FROM hs a JOIN hs b ON b.frame_no = a.frame_no + 1000000""")
def d3(spark, sf):
    h = v.hashes(spark, sf)
    copies = h.select((F.col("frame_no") - 1_000_000).alias("frame_no"), F.col("hash_hi").alias("oh"), F.col("hash_lo").alias("ol"))
    return h.join(copies, "frame_no").select("frame_no", nd.hamming(F.col("hash_hi"), F.col("hash_lo"), F.col("oh"), F.col("ol")).alias("distance"))


@query("d4_quality_flags", f"""
WITH {PIXEL_SQL}, m AS (SELECT vec_id, avg(CASE WHEN w <= 16 THEN 1.0 ELSE 0.0 END) AS black, avg(w) AS mean, stddev_pop(w) AS sd FROM (SELECT vec_id, v * (vec_id % 5) // 16 AS w FROM px) GROUP BY vec_id)
SELECT vec_id, array_to_string(list_filter([CASE WHEN black >= 0.97 THEN 'black' END, CASE WHEN mean <= 24 THEN 'extreme_dark' END, CASE WHEN sd <= 6 THEN 'low_information' END], lambda f: f IS NOT NULL), '|') AS flags FROM m""")
def d4(spark, sf):
    dimmed = F.transform("luma", lambda p: F.floor(p * (F.col("vec_id") % 5) / 16).cast("int"))
    m = luma_images(spark, sf).select("vec_id", nd.frame_metrics(dimmed, F.col("width"), F.col("height")).alias("m"))
    return m.select("vec_id", v.listed(nd.quality_flags(F.col("m.black_ratio"), F.col("m.mean_luma"), F.col("m.luma_stddev"))).alias("flags"))


@query("d5_candidate_pairs_hamming", f"""
WITH {v.HASH_SQL}, u AS (SELECT DISTINCT job_id, hash_hi, hash_lo FROM hs)
SELECT a.job_id, a.hash_hi AS hi, a.hash_lo AS lo, b.hash_hi AS other_hi, b.hash_lo AS other_lo, CAST(bit_count(xor(a.hash_hi, b.hash_hi)) + bit_count(xor(a.hash_lo, b.hash_lo)) AS INTEGER) AS distance
FROM u a JOIN u b ON a.job_id = b.job_id AND (a.hash_hi, a.hash_lo) < (b.hash_hi, b.hash_lo) WHERE bit_count(xor(a.hash_hi, b.hash_hi)) + bit_count(xor(a.hash_lo, b.hash_lo)) <= 6""")
def d5(spark, sf):
    return nd.candidate_pairs(v.hashes(spark, sf), "job_id", 6, v.HALF_BITS)


def dedup_frames(spark, sf):
    """Hash frames with cue, score and quality from their number; pixels from their embedding (copies share them)."""
    n = F.col("frame_no")
    h = v.hashes(spark, sf).withColumns({
        "rank_key": -(n % 7), "protected_cue": n % 11 == 0, "scene_score": F.when(n % 13 == 0, (n % 100) / 100.0),
        "usable": n % 29 != 0, "cue_terms": F.array(F.concat(F.lit("c"), (n % 4).cast("string")))})
    return h


DEDUP_ORDER = ["rank_key", "t", "frame_no"]


def dedup(spark, sf, **options):
    return nd.greedy_dedup(dedup_frames(spark, sf), "job_id", "frame_no", DEDUP_ORDER, nd.Protection(time_gap=400), 6, v.HALF_BITS, **options)


_PROTECTED = "(o.frame_no % 11 = 0 OR abs(o.t - c.t) >= 400 OR (o.frame_no % 13 = 0 AND (o.frame_no % 100) / 100.0 >= 0.45))"
DEDUP_SQL = v.HASH_SQL + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY -(frame_no % 7), t, frame_no) AS n FROM hs WHERE frame_no % 29 <> 0),
step AS (
  SELECT job_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS frame_no, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS BIGINT) AS canonical_id, CAST(NULL AS BIGINT) AS distance FROM (SELECT DISTINCT job_id FROM rk)
  UNION ALL
  SELECT job_id, n, CASE WHEN action = 'duplicate_drop' THEN kept ELSE list_append(kept, frame_no) END, frame_no, action, canonical_id, distance FROM (
    SELECT o.job_id, o.n, s.kept, o.frame_no, c.frame_no AS canonical_id, c.distance,
      CASE WHEN c.frame_no IS NULL THEN 'kept' WHEN """ + _PROTECTED + """ THEN 'progressive_change_protected' ELSE 'duplicate_drop' END AS action
    FROM step s JOIN rk o ON o.job_id = s.job_id AND o.n = s.n + 1
    LEFT JOIN LATERAL (SELECT k.frame_no, k.t, CAST(bit_count(xor(k.hash_hi, o.hash_hi)) + bit_count(xor(k.hash_lo, o.hash_lo)) AS BIGINT) AS distance, k.n
      FROM rk k WHERE k.job_id = o.job_id AND list_contains(s.kept, k.frame_no) AND bit_count(xor(k.hash_hi, o.hash_hi)) + bit_count(xor(k.hash_lo, o.hash_lo)) <= 6 ORDER BY 3, 4 LIMIT 1) c ON true))"""


@query("d6_greedy_dedup", f"""
WITH RECURSIVE {DEDUP_SQL}
SELECT job_id, frame_no, action, canonical_id, distance FROM step WHERE n > 0 UNION ALL SELECT job_id, frame_no, 'quality_drop', NULL, NULL FROM hs WHERE frame_no % 29 = 0""")
def d6(spark, sf):
    return dedup(spark, sf).select("job_id", "frame_no", "action", "canonical_id", F.col("distance").cast("long").alias("distance"))


@query("d6_absorb_duplicates", f"""
WITH RECURSIVE {DEDUP_SQL}
SELECT job_id, CASE WHEN action = 'duplicate_drop' THEN canonical_id ELSE frame_no END AS frame_no, array_to_string(list_sort(list_distinct(list('c' || CAST(frame_no % 4 AS VARCHAR)))), '|') AS cue_terms
FROM step WHERE n > 0 GROUP BY 1, 2""")
def d6_absorb(spark, sf):
    out = nd.absorb_duplicates(dedup(spark, sf), "job_id", "frame_no", ["cue_terms"])
    return out.withColumn("cue_terms", v.listed(F.col("cue_terms")))


def audited_groups(spark, sf):
    """Frames of one label as a group; copies of a frame have its pixels."""
    return v.hashes(spark, sf).withColumn("cue_terms", F.when(F.col("frame_no") % 3 == 0, F.array()).otherwise(F.array(F.concat(F.lit("c"), (F.col("frame_no") % 4).cast("string")))))


def group_labels(spark, sf):
    kinds = F.array(*[F.lit(c) for c in nd.GROUP_CLASSES])
    e = v.read(spark, sf, "embeddings").groupBy(F.col("label").alias("job_id")).agg(F.max("vec_id").alias("keep_id"))
    return e.select("job_id", F.get(kinds, (F.col("job_id") % 6).cast("int")).alias("classification"), "keep_id")


_CLASS_SQL = f"lb AS (SELECT label AS job_id, [{', '.join(repr(c) for c in nd.GROUP_CLASSES)}][label % 6 + 1] AS classification, max(vec_id) AS keep_id FROM embeddings GROUP BY label)"


@query("d7_dedup_group_audit", f"""
WITH {v.HASH_SQL}, {PIXEL_SQL}, p AS (SELECT job_id, frame_no AS right_id, lag(frame_no) OVER w AS left_id, CAST(bit_count(xor(hash_hi, lag(hash_hi) OVER w)) + bit_count(xor(hash_lo, lag(hash_lo) OVER w)) AS INTEGER) AS distance
 FROM hs WINDOW w AS (PARTITION BY job_id ORDER BY t, frame_no)),
c AS (SELECT right_id, abs(a.v - b.v) AS d, abs(a.e - b.e) AS de FROM p JOIN ed a ON a.vec_id = left_id % 1000000 JOIN ed b ON b.vec_id = right_id % 1000000 AND a.x = b.x AND a.y = b.y),
r AS (SELECT right_id, round(avg(CASE WHEN d >= 16 THEN 1.0 ELSE 0.0 END), 6) AS local_ratio, round(avg(CASE WHEN de >= 24 THEN 1.0 ELSE 0.0 END), 6) AS edge_ratio, round(avg(CASE WHEN d >= 64 THEN 1.0 ELSE 0.0 END), 6) AS contrast_ratio FROM c GROUP BY right_id)
SELECT job_id, left_id, right_id, distance, local_ratio, edge_ratio, contrast_ratio FROM p JOIN r USING (right_id) WHERE left_id IS NOT NULL""")
def d7(spark, sf):
    i = luma_images(spark, sf).select(F.explode(F.array("vec_id", F.col("vec_id") + 1_000_000)).alias("frame_no"), "luma", "width", "height")
    out = nd.dedup_group_audit(audited_groups(spark, sf), HASH_LINE, "job_id", "frame_no", i)
    return out.withColumns({c: F.round(c, 6) for c in ("local_ratio", "edge_ratio", "contrast_ratio")})


@query("d7_group_members", f"""
WITH {v.HASH_SQL}, {_CLASS_SQL} SELECT job_id, frame_no, classification, CASE WHEN frame_no = keep_id THEN 'keep' WHEN classification = 'safe_duplicate' THEN 'drop' END AS recommendation FROM hs JOIN lb USING (job_id)""")
def d7_members(spark, sf):
    return nd.dedup_group_members(audited_groups(spark, sf), group_labels(spark, sf), "job_id", "frame_no")


@query("d7_group_cues", f"WITH {v.HASH_SQL} SELECT DISTINCT job_id, 'c' || CAST(frame_no % 4 AS VARCHAR) AS cue_term FROM hs WHERE frame_no % 3 <> 0")
def d7_cues(spark, sf):
    return nd.dedup_group_cues(audited_groups(spark, sf), "job_id")


@query("d7_class_counts", f"""
WITH {_CLASS_SQL} SELECT count(*) AS audited_group_count, {', '.join(f"count(*) FILTER (WHERE classification = '{'safe_duplicate' if c == 'dedup_false_negative' else c}') AS {c}" for c in nd.GROUP_CLASSES)} FROM lb""")
def d7_counts(spark, sf):
    return nd.dedup_class_counts(group_labels(spark, sf))


@query("j15_resolve_canonical_alias", """
WITH e AS (SELECT o_orderkey, list('f' || CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS ids, 'f' || CAST(o_custkey AS VARCHAR) AS extra FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey),
x AS (SELECT o_orderkey, CASE WHEN list_contains(ids, extra) THEN ids ELSE list_append(ids, extra) END AS ids, (SELECT count(*) FROM part) AS parts FROM e)
SELECT o_orderkey, array_to_string(ids, '|') AS ids, array_to_string(list_transform(ids, lambda i: CASE WHEN CAST(substr(i, 2) AS BIGINT) % 3 = 0 AND CAST(substr(i, 2) AS BIGINT) < parts THEN 'f' || CAST(CAST(substr(i, 2) AS BIGINT) // 3 AS VARCHAR) ELSE i END), '|') AS canonical_ids FROM x""")
def j15(spark, sf):
    o, l, p = (v.read(spark, sf, t) for t in ("orders", "lineitem", "part"))
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    cited = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: name(s["l_partkey"])).alias("ids"))
    rows = o.select("o_orderkey", F.array(name(F.col("o_custkey"))).alias("extra")).join(cited, "o_orderkey")
    aliases = p.filter("p_partkey % 3 = 0").select(name(F.col("p_partkey")).alias("frame_id"), name(F.floor(F.col("p_partkey") / 3).cast("long")).alias("canonical_id"))
    out = ev.resolve_canonical(rows, "o_orderkey", "ids", aliases, F.col("extra"))
    return out.select("o_orderkey", v.listed(F.col("ids")).alias("ids"), v.listed(F.col("canonical_ids")).alias("canonical_ids"))


# ---- frame reports -------------------------------------------------------------------------------

_ACTIONS = ("kept", "quality_drop", "duplicate_drop", "progressive_change_protected", "final_budget_drop")


@query("a5_dedup_and_quality_counts", f"""
WITH RECURSIVE {DEDUP_SQL}, d AS (SELECT job_id, action FROM step WHERE n > 0 UNION ALL SELECT job_id, 'quality_drop' FROM hs WHERE frame_no % 29 = 0)
SELECT job_id, {', '.join(f"count(*) FILTER (WHERE action = '{a}') AS {a}" for a in _ACTIONS)} FROM d GROUP BY job_id""")
def a5(spark, sf):
    d = dedup(spark, sf)
    return d.groupBy("job_id").agg(*rp.counts_over(d, ["job_id"], "action", _ACTIONS))


_REASONS = ("scene_change", "subtitle_cue", "periodic")


_CAP, _FINAL_CAP = 40, 25


@query("a6_frame_coverage_report", f"""
WITH RECURSIVE {MERGE_SQL}, {v.RANGE_SQL}, ex AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY t, anchor_id) <= {_CAP}),
pd AS (SELECT * FROM ex WHERE anchor_id % 29 <> 0), k AS (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY t, anchor_id) <= {_FINAL_CAP}),
s0 AS (SELECT job_id, count(*) FILTER (WHERE is_scene) AS scene_count, count(*) FILTER (WHERE has_cue) AS cue_count, count(*) FILTER (WHERE reason = 'periodic') AS periodic_count FROM mom GROUP BY job_id),
s1 AS (SELECT job_id, count(*) AS merged_count FROM merged GROUP BY job_id), s2 AS (SELECT job_id, count(*) AS extracted_count FROM ex GROUP BY job_id), s3 AS (SELECT job_id, count(*) AS post_dedup_count FROM pd GROUP BY job_id),
c AS (SELECT job_id, count(*) AS final_count, {', '.join(f"count(*) FILTER (WHERE contains(reasons, '{r}')) AS reason_{r}" for r in _REASONS)} FROM k GROUP BY job_id),
b AS (SELECT job_id, t FROM k UNION ALL SELECT part_id, range_start FROM rng UNION ALL SELECT part_id, range_end FROM rng),
g AS (SELECT job_id, max(d) AS max_gap FROM (SELECT job_id, t - lag(t) OVER (PARTITION BY job_id ORDER BY t) AS d FROM b) GROUP BY job_id),
r AS (SELECT part_id AS job_id, range_start, range_end FROM rng)
SELECT job_id, range_start, range_end, {', '.join(f"coalesce({n}_count, 0) AS {n}_count" for n in ('scene', 'cue', 'periodic', 'merged', 'extracted', 'post_dedup', 'final'))}, {', '.join(f"coalesce(reason_{r}, 0) AS reason_{r}" for r in _REASONS)}, max_gap,
 round(coalesce(final_count, 0) / greatest((range_end - range_start) / 60000.0::DOUBLE, 1 / 60.0::DOUBLE), 6) AS frames_per_minute, greatest(0, coalesce(merged_count, 0) - {_CAP}) AS candidate_dropped, greatest(0, coalesce(post_dedup_count, 0) - coalesce(final_count, 0)) AS final_dropped
FROM r LEFT JOIN s0 USING (job_id) LEFT JOIN s1 USING (job_id) LEFT JOIN s2 USING (job_id) LEFT JOIN s3 USING (job_id) LEFT JOIN c USING (job_id) LEFT JOIN g USING (job_id)""")
def a6(spark, sf):
    m = v.moments(spark, sf)
    clusters = stage_table(merged(spark, sf).select("job_id", "anchor_id", "t", "reasons"))
    order = [F.asc("t"), F.asc("anchor_id")]
    extracted = mo.rank_and_cap(clusters, "job_id", order, _CAP)[0]
    clear = extracted.filter("anchor_id % 29 <> 0")
    final = mo.rank_and_cap(clear.drop("rank"), "job_id", order, _FINAL_CAP)[0]
    stages = {"scene": m.filter("is_scene"), "cue": m.filter("has_cue"), "periodic": m.filter("reason = 'periodic'"), "merged": clusters, "extracted": extracted, "post_dedup": clear}
    line = tl.by_time(["job_id"], "t", "anchor_id", v.EVENT_BLOCK_US // 1000)
    return rp.frame_coverage_report(final, line, v.job_ranges(spark, sf, "job_id"), "job_id", "t", _REASONS, stages, _CAP)


@query("a7_cue_coverage_ratio", f"""
WITH {v.MOM_SQL}, m AS (SELECT DISTINCT job_id, event_id FROM mom WHERE has_cue)
SELECT job_id, count(*) AS matched_segments, count(*) FILTER (WHERE event_id % 3 <> 0) AS covered_segments, round(count(*) FILTER (WHERE event_id % 3 <> 0)::DOUBLE / count(*)::DOUBLE, 6) AS coverage_ratio FROM m GROUP BY job_id""")
def a7(spark, sf):
    m = v.moments(spark, sf)
    return rp.cue_coverage(m.filter("has_cue"), m.filter("event_id % 3 <> 0"), "job_id", "event_id")


# ---- packets -------------------------------------------------------------------------------------

@query("w18_packet_rows", f"""
WITH {PACKET_SQL} SELECT job_id, packet_id, event_id, NOT (primary_start <= start_ms AND start_ms < primary_end) AS context_only
FROM pk JOIN loc ON part_id = job_id WHERE end_ms > context_start AND start_ms < context_end""")
def w18(spark, sf):
    rows = v.local_intervals(spark, sf).withColumnRenamed("part_id", "job_id")
    return pg.packet_rows(packets(spark, sf), rows, "job_id", "start_ms", "end_ms", _DAY).select("job_id", "packet_id", "event_id", "context_only")


@query("w18_build_packets", f"""
WITH {PACKET_SQL}, r AS (SELECT job_id, packet_id, event_id, NOT (primary_start <= start_ms AND start_ms < primary_end) AS context_only FROM pk JOIN loc ON part_id = job_id WHERE end_ms > context_start AND start_ms < context_end),
s AS (SELECT job_id, packet_id, count(*) AS row_count, count(*) FILTER (WHERE NOT context_only) AS primary_count,
  {", ".join(f"sum(CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR) || ':' || CAST(context_only AS VARCHAR)), {8 * i + 1}, 8) AS BIGINT)) AS w{i}" for i in range(8))} FROM r GROUP BY 1, 2)
SELECT pk.job_id, packet_no, pk.packet_id, primary_start, primary_end, context_start, context_end, coalesce(row_count, 0) AS row_count, coalesce(primary_count, 0) AS primary_count, sha256({" || ':' || ".join(f"CAST(coalesce(w{i}, 0) AS VARCHAR)" for i in range(8))}) AS member_digest
FROM pk LEFT JOIN s ON s.job_id = pk.job_id AND s.packet_id = pk.packet_id""")
def w18_build(spark, sf):
    rows = v.local_intervals(spark, sf).withColumnRenamed("part_id", "job_id")
    p = packets(spark, sf)
    return pg.packet_summary(p, pg.packet_rows(p, rows, "job_id", "start_ms", "end_ms", _DAY), "job_id", "event_id")


_TERM = "[A-Z][a-z]+"


@query("w18_packet_terms", f"""
WITH {PACKET_SQL}, r AS (SELECT job_id, packet_id, primary_start <= start_ms AND start_ms < primary_end AS is_primary, unnest(list_distinct(regexp_extract_all(text, '{_TERM}'))) AS term
  FROM pk JOIN loc ON part_id = job_id JOIN documents ON doc_id = event_id % (SELECT max(doc_id) + 1 FROM documents) WHERE end_ms > context_start AND start_ms < context_end)
SELECT job_id, packet_id, term, count(*) AS row_count, bool_or(is_primary) AS in_primary FROM r GROUP BY 1, 2, 3""")
def w18_terms(spark, sf):
    """Events, each with the text of a document, and the capitalised words in them; a text is searched once."""
    d = v.docs(spark, sf).select(F.col("doc_id").alias("_doc"), F.array_distinct(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0))).alias("terms"))
    doc = F.col("event_id") % v.read(spark, sf, "documents").agg(F.max("doc_id") + 1).scalar()
    rows = v.local_intervals(spark, sf).withColumnRenamed("part_id", "job_id").withColumn("_doc", doc)
    return pg.packet_terms(packets(spark, sf), rows, "job_id", "start_ms", "end_ms", "_doc", d)


def _sums(kind):
    digest = "sha256(CAST(event_id AS VARCHAR) || ':' || CAST(context_only AS VARCHAR))"
    words = " || ':' || ".join(f"CAST(coalesce(sum(CAST('0x' || substr({digest}, {8 * i + 1}, 8) AS BIGINT)) FILTER (event_type = '{kind}'), 0) AS VARCHAR)" for i in range(8))
    return f"count(*) FILTER (event_type = '{kind}') AS {kind}_row_count, count(*) FILTER (event_type = '{kind}' AND NOT context_only) AS {kind}_primary_count, sha256({words}) AS {kind}_member_digest"


_KINDS = ("click", "error", "purchase", "signup", "view")
_PAYLOAD = sorted(["context_end", "context_start", "job_id", "packet_id", "packet_no", "primary_end", "primary_start", *[f"{k}_{c}" for k in _KINDS for c in ("member_digest", "primary_count", "row_count")]])
_PAYLOAD_SQL = " || ',' || ".join(f"'\"{c}\":' || " + (f"'\"' || {c} || '\"'" if c.endswith(("digest", "packet_id")) else f"CAST({c} AS VARCHAR)") for c in _PAYLOAD)


@query("w18_packet_hash", f"""
WITH {PACKET_SQL}, r AS (SELECT pk.*, event_id, event_type, NOT (primary_start <= start_ms AND start_ms < primary_end) AS context_only FROM pk LEFT JOIN loc ON part_id = job_id AND end_ms > context_start AND start_ms < context_end),
c AS (SELECT job_id, packet_no, packet_id, primary_start, primary_end, context_start, context_end, {', '.join(_sums(k) for k in _KINDS)} FROM r GROUP BY ALL)
SELECT job_id, packet_id, {', '.join(f"{k}_row_count" for k in _KINDS)}, sha256('{{' || {_PAYLOAD_SQL} || '}}') AS packet_hash FROM c""")
def w18_hash(spark, sf):
    """Every type of event as a kind of members."""
    rows = v.local_intervals(spark, sf).withColumnRenamed("part_id", "job_id")
    p = packets(spark, sf)
    members = {kind: pg.packet_rows(p, rows.filter(F.col("event_type") == kind), "job_id", "start_ms", "end_ms", _DAY) for kind in _KINDS}
    return pg.packet_contents(p, members, "job_id", "event_id").select("job_id", "packet_id", *[f"{k}_row_count" for k in _KINDS], "packet_hash")


@query("w19_build_packets_dynamic", f"""
WITH {v.RANGE_SQL}, c AS (SELECT *, greatest(1, CAST(round_even((range_end - range_start) / {_DAY}.0::DOUBLE, 0) AS BIGINT)) AS c FROM rng),
n AS (SELECT *, (range_end - range_start) / c::DOUBLE AS w, unnest(generate_series(0, c - 1)) AS n FROM c),
p AS (SELECT *, range_start + CAST(floor(n * w) AS BIGINT) AS ps, CASE WHEN n = c - 1 THEN range_end ELSE range_start + CAST(floor((n + 1) * w) AS BIGINT) END AS pe FROM n)
SELECT part_id AS job_id, n + 6 AS packet_no, printf('P%04d', n + 6) AS packet_id, ps AS primary_start, pe AS primary_end, greatest(range_start, ps - {_DAY // 10}) AS context_start, least(range_end, pe + {_DAY // 10}) AS context_end FROM p""")
def w19(spark, sf):
    return pg.plan_packets(v.job_ranges(spark, sf, "job_id"), "job_id", span=_DAY, context=_DAY // 10, dynamic=True, first=6)


@query("j16_terms_in_packet", f"WITH {PACKET_SQL} SELECT job_id, packet_id, event_id FROM pk JOIN loc ON part_id = job_id WHERE end_ms > primary_start AND start_ms < primary_end")
def j16(spark, sf):
    rows = v.local_intervals(spark, sf).withColumnRenamed("part_id", "job_id")
    return pg.terms_in_packet(packets(spark, sf), rows, "job_id", "start_ms", "end_ms", _DAY).select("job_id", "packet_id", "event_id")


@query("a16_boundary_audit", f"""
WITH {PACKET_SQL}, r AS (SELECT job_id, packet_no, event_id FROM pk JOIN loc ON part_id = job_id WHERE (start_ms >= primary_start AND start_ms < primary_end AND event_id % 19 <> 0) OR (event_id % 23 = 0 AND end_ms > context_start AND start_ms < context_end)),
o AS (SELECT job_id, event_id, count(*) AS n, min(packet_no) AS f FROM r GROUP BY 1, 2),
d AS (SELECT job_id, f AS left_packet, count(*) AS duplicates FROM o WHERE n > 1 GROUP BY 1, 2),
l AS (SELECT pk.job_id, packet_no AS left_packet, count(*) AS omissions FROM loc JOIN pk ON part_id = job_id AND start_ms >= primary_start AND start_ms < primary_end
      WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.job_id = part_id AND o.event_id = loc.event_id) GROUP BY 1, 2),
b AS (SELECT job_id, lag(packet_no) OVER w AS left_packet, packet_no AS right_packet, lag(primary_end) OVER w AS boundary FROM pk WINDOW w AS (PARTITION BY job_id ORDER BY packet_no))
SELECT b.*, coalesce(duplicates, 0) AS duplicates, coalesce(omissions, 0) AS omissions, coalesce(duplicates, 0) + coalesce(omissions, 0) AS unresolved
FROM b LEFT JOIN d ON d.job_id = b.job_id AND d.left_packet = b.left_packet LEFT JOIN l ON l.job_id = b.job_id AND l.left_packet = b.left_packet WHERE b.left_packet IS NOT NULL""")
def a16(spark, sf):
    rows = v.local_intervals(spark, sf).withColumnRenamed("part_id", "job_id").select("job_id", "event_id", "start_ms", "end_ms")
    p = packets(spark, sf)
    members = pg.packet_rows(p, rows, "job_id", "start_ms", "end_ms", _DAY)
    faulty = members.filter("(NOT context_only AND event_id % 19 <> 0) OR event_id % 23 = 0").withColumn("context_only", F.lit(False))
    line = tl.by_position(["job_id"], "packet_no")
    return rp.boundary_audit(p, faulty, line, "job_id", "event_id", rows, "start_ms")
