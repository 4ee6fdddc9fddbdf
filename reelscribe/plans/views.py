"""The driver tables read as transcripts, intervals, moments, hashes, terms and runs, with SQL twins.

Each ``*_SQL`` constant is the body of a common table expression with the columns of the view of the
same name, for use in an oracle query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscribe.functions import text as tx
from reelscribe.operators import sequence as sq
from reelscribe.operators import timeline as tl

DAY_US = 86_400_000_000
EVENT_BLOCK_US = 4 * DAY_US
TURNS_PER_BLOCK = 4096

# Fixed values for SQL text: white space class, clean-text steps.
SQL_WS = tx.WHITESPACE


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def read_text(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A table of texts. The small driver tables are one file of one row group, which a single task would read: that one file
    is dealt out. A table of several files is read as it lies, without a shuffle."""
    df = read(spark, sf, table)
    return df.repartition(spark.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


def sql_clean(text: str) -> str:
    """SQL twin of ``clean_text``."""
    out = f"translate(replace(replace(nfc_normalize({text}), chr(65279), ''), chr(8203), ''), '﹐﹑﹒︰﹔﹖﹗', '，、。：；？！')"
    out = f"trim(regexp_replace({out}, '{SQL_WS}+', ' ', 'g'), ' ')"
    out = f"regexp_replace({out}, ' ([，。！？；：、,.!?;:])', '\\1', 'g')"
    return f"regexp_replace({out}, '([，。！？；：、]) ', '\\1', 'g')"


def sql_casefold(text: str) -> str:
    out = f"translate(lower({text}), 'ſς', 'sσ')"
    for a, b in (("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ŉ", "ʼn")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def sql_timecode(ms: str, sep: str = ".") -> str:
    return (f"printf('%02d:%02d:%02d{sep}%03d', ({ms}) // 3600000, (({ms}) % 3600000) // 60000, "
            f"(({ms}) % 60000) // 1000, ({ms}) % 1000)")


# ---- segments ------------------------------------------------------------------------------------

def raw_segments(spark: SparkSession, sf: str) -> DataFrame:
    c = read_text(spark, sf, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("part_id"), F.col("conv_id").alias("part_no"), F.col("turn").alias("seq"),
                    F.col("role").alias("speaker"), F.col("text").alias("text_raw"), (F.length("text") * 64).cast("long").alias("dur_ms"))
    return rows


SEG_LINE = tl.by_position(["part_id"], "seq", TURNS_PER_BLOCK)


def segments(spark: SparkSession, sf: str, ids: bool = True) -> DataFrame:
    timed = tl.scan(raw_segments(spark, sf), SEG_LINE, sum_before={"start_ms": "dur_ms"}).withColumn("end_ms", F.col("start_ms") + F.col("dur_ms"))
    return sq.assign_stable_ids(timed, SEG_LINE, "part_no") if ids else timed


SEG_TIME_LINE = tl.by_time(["part_id"], "start_ms", "seq", 3_600_000)
SEG_SQL = """
seg AS (
  SELECT CAST(conv_id AS VARCHAR) AS part_id, conv_id AS part_no, turn AS seq, role AS speaker, text AS text_raw,
         CAST(64 * length(text) AS BIGINT) AS dur_ms,
         CAST(coalesce(sum(64 * length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
         CAST(sum(64 * length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end_ms,
         printf('T%06d', row_number() OVER (ORDER BY conv_id, turn)) AS segment_id
  FROM conversations)"""


# ---- intervals -----------------------------------------------------------------------------------

def intervals(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("part_id"), "event_id", start.alias("start_us"),
                    (start + F.round(F.col("value") * 60e6).cast("long")).alias("end_us"), "event_type", "value")


INT_LINE = tl.by_time(["part_id"], "start_us", "event_id", EVENT_BLOCK_US)
INT_SQL = """
iv AS (
  SELECT user_id AS part_id, event_id, epoch_us(ts) AS start_us, epoch_us(ts) + CAST(round(value * 60e6) AS BIGINT) AS end_us, event_type, value
  FROM events)"""
# Start of the events month in microseconds, the zero of part-local times (a fixed value).
EPOCH_US = 1_704_067_200_000_000


def local_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals in milliseconds from the start of the month."""
    iv = intervals(spark, sf)
    ms = lambda c: F.floor((F.col(c) - EPOCH_US) / 1000).cast("long")
    return iv.select("part_id", "event_id", ms("start_us").alias("start_ms"), ms("end_us").alias("end_ms"), "event_type", "value")


LOC_LINE = tl.by_time(["part_id"], "start_ms", "event_id", EVENT_BLOCK_US // 1000)
LOC_SQL = INT_SQL + f""",
loc AS (
  SELECT part_id, event_id, (start_us - {EPOCH_US}) // 1000 AS start_ms, (end_us - {EPOCH_US}) // 1000 AS end_ms, event_type, value FROM iv)"""


def job_ranges(spark: SparkSession, sf: str, key: str = "part_id") -> DataFrame:
    """Per user the range from 0 to the last local end."""
    return local_intervals(spark, sf).groupBy(F.col("part_id").alias(key)).agg(
        F.lit(0).cast("long").alias("range_start"), F.max("end_ms").alias("range_end"))


RANGE_SQL = LOC_SQL + """,
rng AS (SELECT part_id, CAST(0 AS BIGINT) AS range_start, max(end_ms) AS range_end FROM loc GROUP BY part_id)"""


# ---- moments -------------------------------------------------------------------------------------

def moments(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frame moments: signup = scene change, error and purchase = cue, click and view = periodic."""
    e = read(spark, sf, "events")
    t = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / 1000).cast("long")
    reason = (F.when(F.col("event_type") == "signup", "scene_change").when(F.col("event_type").isin("error", "purchase"), "subtitle_cue")
              .otherwise("periodic"))
    k = F.from_json("props", "k bigint")["k"]
    rows = e.select(F.col("user_id").alias("job_id"), "event_id", t.alias("t"), reason.alias("reason"), F.col("value"), k.alias("k"))
    return rows.select(
        "job_id", "event_id", "t", "reason", F.array("reason").alias("reasons"),
        F.when(F.col("reason") == "subtitle_cue", F.array(F.concat(F.lit("cue"), F.col("k").cast("string")))).otherwise(F.array().cast("array<string>")).alias("cue_terms"),
        F.when(F.col("reason") == "scene_change", F.round(F.col("value") / 500, 6)).alias("scene_score"),
        F.when(F.col("reason") == "scene_change", 0).when(F.col("reason") == "subtitle_cue", 2).otherwise(3).alias("source_rank"),
        (F.col("reason") == "subtitle_cue").alias("has_cue"), (F.col("reason") == "scene_change").alias("is_scene"), F.col("event_id").alias("ord"))


MOM_LINE = tl.Timeline(("job_id",), ("t", "source_rank", "event_id"), "t", (EVENT_BLOCK_US // 1000))
MOM_SQL = f"""
mom AS (
  SELECT user_id AS job_id, event_id, (epoch_us(ts) - {EPOCH_US}) // 1000 AS t, event_id AS ord,
         CASE WHEN event_type = 'signup' THEN 'scene_change' WHEN event_type IN ('error', 'purchase') THEN 'subtitle_cue' ELSE 'periodic' END AS reason,
         CASE WHEN event_type IN ('error', 'purchase') THEN 'cue' || json_extract_string(props, '$.k') END AS cue_term,
         CASE WHEN event_type = 'signup' THEN round(value / 500, 6) END AS scene_score,
         CASE WHEN event_type = 'signup' THEN 0 WHEN event_type IN ('error', 'purchase') THEN 2 ELSE 3 END AS source_rank,
         event_type IN ('error', 'purchase') AS has_cue, event_type = 'signup' AS is_scene
  FROM events)"""


# ---- hashes --------------------------------------------------------------------------------------

HALF_BITS = 28


def hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 56-bit grid hashes (each value against its right neighbour), plus one perturbed copy per row."""
    e = read(spark, sf, "embeddings")

    def half(first: int) -> Column:
        """28 bits in grid order from bit ``first``; bit n compares cell (n div 7, n mod 7) with its right neighbour."""
        def add(acc: Column, n: Column) -> Column:
            cell = (F.floor(n / 7) * 8 + n % 7).cast("int")
            return acc * 2 + F.when(F.get("embedding", cell) > F.get("embedding", cell + 1), F.lit(1)).otherwise(F.lit(0)).cast("long")

        return F.aggregate(F.sequence(F.lit(first), F.lit(first + HALF_BITS - 1)), F.lit(0).cast("long"), add)

    base = e.select(F.col("label").alias("job_id"), F.col("vec_id").alias("frame_no"), (F.col("vec_id") * 2).alias("t"),
                    half(0).alias("hash_hi"), half(HALF_BITS).alias("hash_lo"))
    flip = F.expr("shiftleft(1L, cast(frame_no % 9 as int)) - 1L")
    copy = base.select("job_id", (F.col("frame_no") + 1_000_000).alias("frame_no"), (F.col("t") + 1).alias("t"), "hash_hi",
                       F.col("hash_lo").bitwiseXOR(flip).alias("hash_lo"))
    return base.unionByName(copy)


_CELLS = [(r * 8 + c) for r in range(8) for c in range(7)]


def _sql_half(ids: list[int]) -> str:
    return " + ".join(f"(CASE WHEN embedding[{i + 1}] > embedding[{i + 2}] THEN CAST({1 << (HALF_BITS - 1 - n)} AS BIGINT) ELSE 0 END)" for n, i in enumerate(ids))


HASH_SQL = f"""
hb AS (
  SELECT label AS job_id, vec_id AS frame_no, vec_id * 2 AS t, CAST({_sql_half(_CELLS[:28])} AS BIGINT) AS hash_hi,
         CAST({_sql_half(_CELLS[28:])} AS BIGINT) AS hash_lo FROM embeddings),
hs AS (
  SELECT * FROM hb UNION ALL
  SELECT job_id, frame_no + 1000000, t + 1, hash_hi, xor(hash_lo, (CAST(1 AS BIGINT) << CAST(frame_no % 9 AS BIGINT)) - 1) FROM hb)"""


# ---- snapshots -----------------------------------------------------------------------------------

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "cents", "ordered_us", "o_orderpriority"]


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All of an order, with prices in cents and times in microseconds, so that digests do not depend on how numbers are printed."""
    o = read(spark, sf, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
                    F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ordered_us"), "o_orderpriority")


# ---- terms ---------------------------------------------------------------------------------------

def terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of neighbouring words of every benchmark text as a suggestion, upper-cased as its correction.

    ``term_no`` numbers the pairs over all texts, ``n`` turns over decisions and confidences.
    """
    b = read(spark, sf, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[^ \n]+"), F.lit(0)).alias("w"))
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1)))
    t = b.select("item_id", F.posexplode(pairs).alias("pos", "original")).withColumns({"term_no": F.col("item_id") * TERMS_PER_ITEM + F.col("pos"), "n": F.col("item_id") + F.col("pos")})
    decision = F.when(F.col("n") % 3 == 0, "accepted").when(F.col("n") % 3 == 1, "pending").otherwise("rejected")
    return t.select("item_id", "term_no", "n", "original", F.upper("original").alias("suggested"), decision.alias("decision"), F.when(F.col("n") % 2 == 0, "high").otherwise("medium").alias("confidence"))


TERMS_PER_ITEM = 1_000_000
TERM_SQL = f"""
tm AS (
  SELECT item_id, item_id * {TERMS_PER_ITEM} + i - 1 AS term_no, item_id + i - 1 AS n, w[i] || ' ' || w[i + 1] AS original, upper(replace(w[i] || ' ' || w[i + 1], 'ß', 'ss')) AS suggested,
         CASE (item_id + i - 1) % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'pending' ELSE 'rejected' END AS decision,
         CASE WHEN (item_id + i - 1) % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[^ \n]+') AS w FROM benchmark)))"""


# ---- runs ----------------------------------------------------------------------------------------

def attempts(spark: SparkSession, sf: str) -> DataFrame:
    from reelscribe.schemas import STAGES

    e = read(spark, sf, "events")
    status = (F.when(F.col("event_type").isin("view", "click"), "succeeded").when(F.col("event_type") == "error", "failed")
              .when(F.col("event_type") == "purchase", "skipped").otherwise("running"))
    stage = F.get(F.array(*[F.lit(s) for s in STAGES]), (F.col("event_id") % 13).cast("int"))
    tool = F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("tool"), (F.col("user_id") % 2 + F.when(F.col("event_id") % 34 == 0, 1).otherwise(0)).cast("string")))
    return e.select(F.col("user_id").alias("job_id"), stage.alias("stage"), status.alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
                    "event_id", tool.alias("tool"))


def _attempts_sql() -> str:
    from reelscribe.schemas import STAGES

    listed = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
    return f"""
att AS (
  SELECT user_id AS job_id, {listed}[CAST(event_id % 13 AS BIGINT) + 1] AS stage, CAST(event_id % 13 AS BIGINT) AS stage_no,
         CASE WHEN event_type IN ('view', 'click') THEN 'succeeded' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'skipped' ELSE 'running' END AS status,
         epoch_us(ts) AS "at", event_id,
         CASE WHEN event_id % 17 = 0 THEN 'tool' || CAST(user_id % 2 + CASE WHEN event_id % 34 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS tool
  FROM events)"""


ATT_SQL = _attempts_sql()


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_text(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def listed(column: Column, sep: str = "|") -> Column:
    """Array as text, so that results compare as plain values."""
    return F.array_join(column.cast("array<string>"), sep)
