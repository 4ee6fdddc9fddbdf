"""Explicit table schemas. Media time is long milliseconds; identifiers are strings."""

from __future__ import annotations

from pyspark.sql import types as T


def table(**columns: str) -> str:
    """A table schema as DDL text, which readers and ``from_json`` accept."""
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def struct(ddl: str) -> T.StructType:
    """The schema object; needs a running session."""
    return T.StructType.fromDDL(ddl)


SEGMENTS = table(
    part_id="string", seq="bigint", segment_id="string", start_ms="bigint", end_ms="bigint",
    text_raw="string", text_clean="string", source="string", language="string", confidence="double",
    speaker="string", chapter_id="string", source_ref="map<string,string>")
PARAGRAPHS = table(
    part_id="string", group_no="bigint", paragraph_id="string", start_ms="bigint", end_ms="bigint",
    title="string", text_raw="string", text_clean="string", text_corrected="string",
    source_segment_ids="array<string>", correction_ids="array<string>", evidence_ids="array<string>",
    frame_ids="array<string>", packet_ids="array<string>", confidence="string",
    uncertainties="array<string>")
FRAMES = table(
    job_id="string", frame_id="string", candidate_id="string", timestamp_ms="bigint", path="string",
    reason="array<string>", scene_score="double", cue_terms="array<string>",
    nearby_segment_ids="array<string>", cue_offsets="array<double>", hash_hi="bigint", hash_lo="bigint",
    sharpness="double", black_ratio="double", mean_luma="double", luma_stddev="double",
    width="int", height="int", sha256="string", quality_flags="array<string>")
CORRECTIONS = table(
    correction_id="string", paragraph_id="string", start_ms="bigint", end_ms="bigint",
    original_text="string", suggested_text="string", change_type="string", reason="string",
    transcript_evidence="array<string>", visual_evidence="array<string>", confidence="string",
    decision="string", applied="boolean")
EVIDENCE = table(
    evidence_id="string", start_ms="bigint", end_ms="bigint", topic="string", claim="string",
    transcript_ids="array<string>", frame_ids="array<string>", formula_ids="array<string>",
    evidence_type="string", confidence="string", uncertainty="string")
FORMULAS = table(
    formula_id="string", frame_id="string", timestamp_ms="bigint", latex="string",
    visual_transcription="string", transcript_ids="array<string>", paragraph_ids="array<string>",
    variables="array<struct<symbol:string,meaning:string>>", role="string", confidence="string",
    uncertain_symbols="array<string>", verification_status="string")
ATTEMPTS = table(
    job_id="string", stage="string", attempt="bigint", status="string", at_ms="bigint",
    input_hash="string", config_hash="string", output_hash="string", tool="string", error="string")

# The run stages in order.
STAGES = (
    "created", "metadata_ready", "subtitle_ready", "audio_ready", "transcript_ready", "frames_ready",
    "packets_ready", "analysis_ready", "evidence_ready", "notes_ready", "obsidian_ready", "web_ready",
    "complete",
)
SOURCES = ("uploader", "bilibili_ai", "local_file", "mlx_whisper", "faster_whisper", "vibeasr_bitnet")
