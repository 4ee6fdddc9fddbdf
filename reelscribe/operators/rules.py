"""Data-quality rules: each function returns violations as (table, id, rule) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscribe import schemas
from reelscribe.functions import values as vx
from reelscribe.operators import timeline as tl


def violations(df: DataFrame, table: str, ident: str, broken: dict[str, Column]) -> DataFrame:
    """Rows for every condition in ``broken`` that is true; one narrow pass, no shuffle."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in broken.items()]))
    return df.select(F.lit(table).alias("table"), F.col(ident).cast("string").alias("id"), F.explode(names).alias("rule"))


def not_unique(df: DataFrame, table: str, ident: str, scope: Sequence[str] = ()) -> DataFrame:
    twice = df.groupBy(*scope, ident).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return twice.select(F.lit(table).alias("table"), F.col(ident).cast("string").alias("id"), F.lit("not_unique").alias("rule"))


def mixed_values(df: DataFrame, table: str, scope: str, columns: Sequence[str]) -> DataFrame:
    """Scopes whose rows disagree in a column that must be constant (min differs from max)."""
    ends = df.groupBy(scope).agg(*[F.min(c).alias(f"_a_{c}") for c in columns], *[F.max(c).alias(f"_z_{c}") for c in columns])
    return violations(ends, table, scope, {f"mixed_{c}": F.col(f"_a_{c}") != F.col(f"_z_{c}") for c in columns})


def _repeated(ids: Column) -> Column:
    return F.size(F.array_distinct(ids)) != F.size(ids)


def rules_segments(segments: DataFrame) -> DataFrame:
    """V1."""
    timed = F.col("timed") if "timed" in segments.columns else F.lit(True)
    rows = violations(segments, "segments", "segment_id", {
        "bad_id": ~F.col("segment_id").rlike(r"^T[0-9]{6,}$"), "negative_time": (F.col("start_ms") < 0) | (F.col("end_ms") < 0),
        "end_before_start": F.col("end_ms") < F.col("start_ms"), "unknown_source": ~F.col("source").isin(*schemas.SOURCES),
        "empty_language": F.coalesce("language", F.lit("")) == "", "empty_part": F.coalesce("part_id", F.lit("")) == "",
        "timed_without_times": timed & (F.col("start_ms").isNull() | F.col("end_ms").isNull()),
        "untimed_with_times": ~timed & (F.col("start_ms").isNotNull() | F.col("end_ms").isNotNull())})
    return rows.unionByName(not_unique(segments, "segments", "segment_id", ["part_id"])).unionByName(
        mixed_values(segments, "segments", "part_id", ["source", "language"]))


def rules_paragraphs(paragraphs: DataFrame, max_ms: int = 120_001) -> DataFrame:
    """V2."""
    return violations(paragraphs, "paragraphs", "paragraph_id", {
        "end_not_after_start": F.col("end_ms") <= F.col("start_ms"), "too_long": F.col("end_ms") - F.col("start_ms") > max_ms,
        "no_sources": F.size("source_segment_ids") == 0, "repeated_sources": _repeated(F.col("source_segment_ids")),
        "empty_layer": (F.trim("text_raw") == "") | (F.trim("text_clean") == "") | (F.trim("text_corrected") == "")})


def rules_sections(sections: DataFrame) -> DataFrame:
    """V2 for sections."""
    return violations(sections, "sections", "section_id", {
        "end_not_after_start": F.col("end_ms") <= F.col("start_ms"), "no_paragraphs": F.size("paragraph_ids") == 0,
        "no_evidence": F.size("evidence_ids") == 0})


def _cited(rows: DataFrame, listed: str, kind: str) -> Column:
    """How many ids a row cites: the length of its list, or the count of its child rows (``<kind>_count``)."""
    return F.size(listed) if listed in rows.columns else F.col(f"{kind}_count")


def rules_corrections(corrections: DataFrame) -> DataFrame:
    """V3. Evidence as lists, or as counts of child rows (segment_count, frame_count)."""
    accepted = F.col("decision") == "accepted"
    spoken, seen = _cited(corrections, "transcript_evidence", "segment"), _cited(corrections, "visual_evidence", "frame")
    return violations(corrections, "corrections", "correction_id", {
        "end_before_start": F.col("end_ms") < F.col("start_ms"), "applied_not_accepted": F.col("applied") != accepted,
        "accepted_without_evidence": accepted & ((spoken == 0) | (seen == 0) | (F.col("confidence") != "high"))})


def rules_correction_audits(audits: DataFrame) -> DataFrame:
    """V3 for audits."""
    return violations(audits, "correction_audits", "correction_id", {
        "accepted_unsupported": (F.col("audited_decision") == "accepted") & (
            (F.col("assessment") != "supported") | ~F.col("evidence_sufficient") | ~F.col("meaning_preserved")),
        "meaning_changed_not_rejected": ~F.col("meaning_preserved") & (F.col("audited_decision") != "rejected")})


def rules_evidence(evidence: DataFrame) -> DataFrame:
    """V4. Sources as lists, or as counts of child rows (segment_count, frame_count, formula_count)."""
    speech, slide = _cited(evidence, "transcript_ids", "segment") > 0, _cited(evidence, "frame_ids", "frame") > 0
    kind = F.col("evidence_type")
    return violations(evidence, "evidence", "evidence_id", {
        "end_before_start": F.col("end_ms") < F.col("start_ms"), "no_source": ~speech & ~slide,
        "speech_without_transcript": kind.startswith("speech") & ~speech, "slide_without_frame": F.contains(kind, F.lit("slide")) & ~slide,
        "formula_without_formula": F.contains(kind, F.lit("formula")) & (_cited(evidence, "formula_ids", "formula") == 0)})


def rules_formulas(formulas: DataFrame) -> DataFrame:
    """V5."""
    return violations(formulas, "formulas", "formula_id", {
        "verified_without_latex": (F.col("verification_status") == "verified") & (F.coalesce("latex", F.lit("")) == ""),
        "no_description": F.coalesce("visual_transcription", F.lit("")) == "",
        "high_without_symbols": (F.col("confidence") == "high") & (
            (F.col("verification_status") != "verified") | (F.size("uncertain_symbols") > 0) | (F.size("key_symbols") == 0)
            | ~F.forall(F.map_values("key_symbols"), lambda v: v)),
        "crop_sets_differ": (F.size(F.array_except("crop_paths", "crop_regions")) > 0) | (F.size(F.array_except("crop_regions", "crop_paths")) > 0),
        "empty_crop_path": F.exists("crop_paths", lambda p: p == "")})


def rules_frames(frames: DataFrame) -> DataFrame:
    """V6 for frames."""
    score = F.col("scene_score")
    return violations(frames, "frames", "frame_id", {
        "absolute_path": F.col("path").startswith("/"), "path_leaves_job": F.array_contains(F.split("path", "/", -1), ".."),
        "no_reason": F.size("reason") == 0, "score_out_of_range": F.coalesce((score < 0) | (score > 1), F.lit(False)),
        "ratio_out_of_range": (F.col("black_ratio") < 0) | (F.col("black_ratio") > 1), "bad_size": (F.col("width") <= 0) | (F.col("height") <= 0),
        "negative_time": F.col("timestamp_ms") < 0})


def rules_media(media: DataFrame) -> DataFrame:
    """V6 for media."""
    return violations(media, "media", "media_id", {
        "end_not_after_start": F.coalesce(F.col("requested_end") <= F.col("requested_start"), F.lit(False)),
        "missing_path": (F.col("storage") == "job_local") & (F.coalesce("media_path", F.lit("")) == ""),
        "path_leaves_job": F.coalesce(F.col("media_path").startswith("/") | F.array_contains(F.split("media_path", "/", -1), ".."), F.lit(False))})


def rules_packets(packets: DataFrame, line: tl.Timeline, payload: Sequence[str], frozen_ids: DataFrame | None = None, max_frames: int = 6) -> DataFrame:
    """V7. Packets carry ``packet_hash`` and ``frame_count``; ``line`` orders them by number. The hash is computed anew from ``payload``."""
    near = tl.scan(packets, line, previous={"_p_end": "primary_end"})
    part = line.part[0]
    near = near.withColumn("_id", F.concat_ws("/", F.col(part).cast("string"), "packet_id"))
    out = violations(near, "packets", "_id", {
        "range_not_increasing": (F.col("primary_end") <= F.col("primary_start")) | (F.col("context_end") <= F.col("context_start")),
        "primary_outside_packet": (F.col("primary_start") < F.col("context_start")) | (F.col("primary_end") > F.col("context_end")),
        "hash_differs": ~F.col("packet_hash").eqNullSafe(vx.row_fingerprint(payload)),
        "gap_between_packets": F.coalesce(F.col("primary_start") != F.col("_p_end"), F.lit(False)), "too_many_frames": F.col("frame_count") > max_frames})
    if frozen_ids is not None:
        hit = near.join(frozen_ids.select(part, "packet_id").distinct(), [part, "packet_id"], "left_semi")
        out = out.unionByName(hit.select(F.lit("packets").alias("table"), F.col("_id").alias("id"), F.lit("id_is_frozen").alias("rule")))
    return out


def rules_observations(observations: DataFrame, registry: DataFrame) -> DataFrame:
    """V8. observations: observation_id, frame_id, image_path, sha256, image_kind, opened, duplicate_of.
    registry: frame_id, image_path, sha256, is_final."""
    known = registry.select("frame_id", F.col("image_path").alias("_path"), F.col("sha256").alias("_sha"))
    rows = observations.join(known, "frame_id", "left")
    crop = F.col("image_kind") == "crop"
    out = violations(rows, "observations", "observation_id", {
        "not_opened": ~F.col("opened"), "unknown_frame": ~crop & F.col("_path").isNull(),
        "registry_mismatch": ~crop & F.coalesce((F.col("_path") != F.col("image_path")) | (F.col("_sha") != F.col("sha256")), F.lit(False)),
        "absolute_path": F.col("image_path").startswith("/"), "path_leaves_job": F.array_contains(F.split("image_path", "/", -1), "..")})
    out = out.unionByName(not_unique(observations, "observations", "observation_id"))
    final = registry.filter("is_final").select("frame_id").distinct()
    seen = observations.filter("image_kind = 'final_frame'").select("frame_id").distinct()
    missing = final.join(seen, "frame_id", "left_anti").select(F.lit("registry").alias("table"), F.col("frame_id").cast("string").alias("id"), F.lit("not_observed").alias("rule"))
    extra = seen.join(final, "frame_id", "left_anti").select(F.lit("registry").alias("table"), F.col("frame_id").cast("string").alias("id"), F.lit("not_a_final_frame").alias("rule"))
    controls = observations.agg(F.count(F.when(F.col("image_kind") == "black_control", 1)).alias("black"),
                                F.count(F.when(F.col("image_kind") == "duplicate_control", 1)).alias("dup"),
                                F.count(F.when((F.col("image_kind") == "duplicate_control") & F.col("duplicate_of").isNotNull(), 1)).alias("linked"))
    whole = violations(controls.withColumn("_id", F.lit("all")), "observations", "_id", {
        "controls_incomplete": (F.col("black") == 0) | (F.col("dup") < 2), "duplicate_control_not_linked": F.col("linked") == 0})
    return out.unionByName(missing).unionByName(extra).unionByName(whole)
