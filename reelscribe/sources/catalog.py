"""Archived catalogue responses: video parts, caption tracks and the choice of one track per part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIEW = (
    "code bigint, message string, data struct<bvid:string, aid:bigint, pubdate:bigint,"
    "pages:array<struct<cid:bigint, page:bigint, part:string, duration:double>>>")
TRACK = "id:bigint, id_str:string, lan:string, lan_doc:string, subtitle_url:string, ai_type:string, ai_status:string, type:string"
PLAYER = (
    f"code bigint, data struct<need_login_subtitle:boolean, subtitle:struct<subtitles:array<struct<{TRACK}>>>>")
# Trusted download hosts and the rank of a track by origin.
TRUSTED_SUFFIXES = (".hdslb.com", ".bilibili.com", ".bilivideo.com")
ORIGIN_RANK = (("uploader", 0), ("bilibili_ai", 1), ("local_file", 2))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` as a column computed once per row.

    A one-element explode keeps the optimizer from copying a costly parse into every later use, which
    after a second explode would mean one parse of the whole response per exploded item.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def explode_parts(responses: DataFrame, page: int | None = None, first_only: bool = False) -> DataFrame:
    """Archived ``view`` responses (``content``) to one row per part; failures keep a reason."""
    data = once(responses, "_v", F.from_json("content", VIEW))
    reason = (F.when(F.col("_v.code").isNull() | (F.col("_v.code") != 0), "api_error")
              .when(~F.coalesce(F.col("_v.data.bvid").rlike("^BV[0-9A-Za-z]{10}$"), F.lit(False)), "invalid_bvid")
              .when(F.col("_v.data.pages").isNull(), "missing_pages"))
    data = data.withColumn("reject_reason", reason)
    pages = F.when(F.col("reject_reason").isNull(), F.col("_v.data.pages"))
    if page is not None:
        pages = F.filter(pages, lambda p: p["page"] == page)
    if first_only:
        pages = F.slice(F.array_sort(pages, lambda a, b: (a["page"] - b["page"]).cast("int")), 1, 1)
    out = data.select("reject_reason", F.col("_v.data.bvid").alias("bvid"), F.col("_v.data.aid").alias("aid"),
                      F.col("_v.data.pubdate").alias("published_at"), F.explode_outer(pages).alias("_p"))
    if page is not None:
        missing = F.when(F.col("_p").isNull(), "part_not_found")
        out = out.withColumn("reject_reason", F.coalesce("reject_reason", missing))
    title = F.coalesce(F.nullif(F.col("_p.part"), F.lit("")), F.concat(F.lit("P"), F.col("_p.page").cast("string")))
    return out.select(
        F.when(F.col("_p").isNotNull(), F.concat("bvid", F.lit("-p"), F.col("_p.page").cast("string"))).alias("part_id"),
        F.col("_p.page").alias("page"), F.col("_p.cid").alias("cid"), title.alias("title"),
        F.col("_p.duration").alias("duration"), "bvid", "aid", "published_at", "reject_reason")


def is_machine_made(track: Column) -> Column:
    def text(name: str) -> Column:
        return F.lower(F.coalesce(track[name], F.lit("")))

    def set_flag(name: str) -> Column:
        return F.coalesce(~track[name].isin("0", "false", "False"), F.lit(False))

    name = text("lan_doc")
    return (text("lan").startswith("ai-") | F.contains(name, F.lit("ai")) | F.contains(name, F.lit("自动"))
            | F.contains(name, F.lit("机翻")) | set_flag("ai_type") | set_flag("ai_status")
            | text("type").isin("ai", "automatic", "auto"))


def explode_candidates(responses: DataFrame) -> DataFrame:
    """Archived ``player`` responses (``part_id``, ``content``) to caption tracks."""
    data = once(responses, "_v", F.from_json("content", PLAYER))
    tracks = data.select("part_id", (F.col("_v.code").isNull() | (F.col("_v.code") != 0)).alias("_failed"),
                         F.coalesce("_v.data.need_login_subtitle", F.lit(False)).alias("need_login"),
                         F.posexplode_outer("_v.data.subtitle.subtitles").alias("_i", "_t"))
    url = F.col("_t.subtitle_url")
    tracks = tracks.filter(F.col("_failed") | (F.coalesce(url, F.lit("")) != ""))
    absolute = (F.when(url.startswith("//"), F.concat(F.lit("https:"), url))
                .when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url)
                .otherwise(F.concat(F.lit("https://www.bilibili.com/"), F.regexp_replace(url, "^/+", ""))))
    host = F.regexp_replace(F.lower(F.regexp_extract(absolute, r"^https://(?:[^/?#]*@)?([^/?#:]*)", 1)), r"\.+$", "")
    trusted = F.lit(False)
    for suffix in TRUSTED_SUFFIXES:
        trusted = trusted | (host == suffix[1:]) | host.endswith(suffix)
    upstream = F.coalesce(F.nullif(F.col("_t.id_str"), F.lit("")), F.nullif(F.col("_t.id"), F.lit(0)).cast("string"),
                          (F.col("_i") + 1).cast("string"))
    digest = F.substring(F.sha2(F.to_json(F.struct(upstream.alias("id"), F.col("part_id").alias("part"))), 256), 1, 16)
    return tracks.select(
        "part_id", F.when(~F.col("_failed"), F.concat("part_id", F.lit("-s"), digest)).alias("candidate_id"),
        F.when(~F.col("_failed"), F.when(is_machine_made(F.col("_t")), "bilibili_ai").otherwise("uploader")).alias("source"),
        F.when(~F.col("_failed"), F.coalesce(F.nullif(F.col("_t.lan"), F.lit("")), F.lit("und"))).alias("language"),
        F.nullif(F.col("_t.lan_doc"), F.lit("")).alias("language_name"), absolute.alias("subtitle_url"), "need_login",
        F.when(F.col("_failed"), "api_error").when(~trusted, "untrusted_host").alias("reject_reason"))


def select_best_candidate(parts: DataFrame, candidates: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Best track per part by origin, preferred language, id; parts without a track are kept.

    The choice is an aggregate with map-side combine, so a part with very many tracks stays cheap.
    """
    origin = F.coalesce(*[F.when(F.col("source") == s, F.lit(r)) for s, r in ORIGIN_RANK])
    lowered = F.lower("language")
    language = F.coalesce(*[F.when(lowered == l.lower(), F.lit(i)) for i, l in reversed(list(enumerate(languages)))],
                          F.lit(len(set(x.lower() for x in languages))))
    rank = F.struct(origin.alias("o"), language.alias("l"), F.col("candidate_id").alias("c"))
    best = candidates.groupBy("part_id").agg(
        F.min_by(F.struct("candidate_id", "source", "language"), rank).alias("_b"),
        F.count(F.lit(1)).alias("candidate_count"))
    reason = (F.when(F.col("_b.source") == "uploader", "uploader_subtitle_preferred")
              .when(F.col("_b.source") == "bilibili_ai", "bilibili_ai_used_no_uploader_subtitle")
              .when(F.col("_b.source") == "local_file", "local_subtitle_used_no_remote_subtitle")
              .otherwise("no_subtitles_available"))
    return parts.join(best, "part_id", "left").select(
        *parts.columns, F.col("_b.candidate_id").alias("selected_candidate_id"),
        F.col("_b.source").alias("selected_source"), F.col("_b.language").alias("selected_language"),
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), reason.alias("reason"))


def availability_class(source: Column, need_login: Column) -> Column:
    """A human, B machine, local_file, E login required, D none."""
    return (F.when(source == "uploader", "A").when(source == "bilibili_ai", "B")
            .when(source == "local_file", "local_file").when(need_login, "E").otherwise("D"))
