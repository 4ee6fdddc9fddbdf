"""Subtitle and record files as tables.

Parsers take a DataFrame of file contents (``part_id``, ``content``), so they work the same on files
read with ``read_files`` and on contents Spark derives. One file is one row, as one file holds one
video part. Bad cues stay in the result with ``reject_reason`` set; ``split_rejects`` separates them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscribe.functions import text as tx
from reelscribe.functions import values as vx
from reelscribe.sources.catalog import once

_LINE_END = r"[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_TIMING = (r"^((?:[0-9]{1,3}:)?[0-9]{2}:[0-9]{2}[,.][0-9]{3})" + tx.WHITESPACE + "*-->" + tx.WHITESPACE +
           r"*((?:[0-9]{1,3}:)?[0-9]{2}:[0-9]{2}[,.][0-9]{3})(?:" + tx.WHITESPACE + r"+.*)?$")
_SKIPPED_BLOCKS = ("NOTE", "STYLE", "REGION", "X-TIMESTAMP-MAP")


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """One row per file: ``part_id`` (file name without suffix), ``format``, ``content``."""
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1)
    return reader.text(path, wholetext=True).select(
        F.url_decode(F.regexp_replace(name, r"\.[^.]*$", "")).alias("part_id"),
        F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("format"),
        F.col("value").alias("content"))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantined rows)."""
    return df.filter("reject_reason IS NULL").drop("reject_reason"), df.filter("reject_reason IS NOT NULL")


def _without_bom(text: Column) -> Column:
    return F.regexp_replace(text, r"^\x{feff}+", "")


def parse_subtitle_json(files: DataFrame) -> DataFrame:
    """``{"body":[{from,to,content}]}``; content must be a string."""
    item = "`from` string, `to` string, content string"
    body = F.from_json(_without_bom(F.col("content")), "body array<string>")["body"]
    rows = files.select("part_id", F.posexplode_outer(body).alias("body_index", "_item"))
    value = F.from_json("_item", item)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("_item"), "$.content", "variant"))
    start = F.round(value["from"].try_cast("double") * 1000).cast("long")
    end = F.round(value["to"].try_cast("double") * 1000).cast("long")
    reason = (F.when(F.col("body_index").isNull(), "missing_body")
              .when(~F.col("_item").startswith("{"), "item_not_object")
              .when(kind.isNull() | (kind != "STRING"), "content_not_string")
              .when(start.isNull() | end.isNull(), "invalid_time")
              .when((start < 0) | (end < start), "inverted_times"))
    return rows.select("part_id", F.col("body_index").cast("long").alias("seq"), start.alias("start_ms"),
                       end.alias("end_ms"), value["content"].alias("text_raw"), reason.alias("reject_reason"))


def _parse_blocks(files: DataFrame, header: bool) -> DataFrame:
    whole = _without_bom(F.regexp_replace("content", r"\r\n?", "\n"))
    if header:
        first = F.regexp_extract(whole, rf"^([^\n]*)", 1)
        good = tx.strip(first).startswith("WEBVTT")
        body = F.regexp_replace(whole, r"^[^\n]*\n?", "")
    else:
        good, body = F.lit(True), whole
    body = tx.strip(body)
    blocks = F.when(~good, F.array(F.lit(""))).when(body == "", F.array().cast("array<string>")).otherwise(
        F.split(body, r"\n" + tx.WHITESPACE + r"*\n"))
    opened = once(files.select("part_id", F.struct(good.alias("good"), blocks.alias("blocks")).alias("_f0")), "_f", F.col("_f0"))
    rows = opened.select("part_id", F.col("_f.good").alias("_good"), F.posexplode("_f.blocks").alias("_block_no", "_text"))
    rows = rows.withColumn("_lines", F.split("_text", _LINE_END))
    timed_at = F.array_position(F.transform("_lines", lambda l: F.contains(l, F.lit("-->"))), True).cast("int")
    rows = rows.withColumn("_at", timed_at)
    if header:
        lead = F.regexp_replace(F.col("_lines")[0], rf"^{tx.WHITESPACE}+", "")
        skip = F.lit(False)
        for word in _SKIPPED_BLOCKS:
            skip = skip | lead.startswith(word)
        settings = F.forall("_lines", lambda l: F.contains(l, F.lit(":")) | (tx.strip(l) == ""))
        rows = rows.filter(~(F.col("_good") & (F.col("_at") == 0) & (skip | settings)))
    timing = tx.strip(F.element_at("_lines", F.greatest(F.col("_at"), F.lit(1))))
    start = vx.timecode_to_ms(F.translate(F.regexp_extract(timing, _TIMING, 1), ",", "."))
    end = vx.timecode_to_ms(F.translate(F.regexp_extract(timing, _TIMING, 2), ",", "."))
    words = F.array_join(F.slice("_lines", F.col("_at") + 1, F.greatest(F.size("_lines"), F.lit(1))), "\n")
    reason = (F.when(~F.col("_good"), "missing_header")
              .when(F.col("_at") == 0, "missing_timing")
              .when(start.isNull() | end.isNull(), "invalid_timing")
              .when(end < start, "inverted_times"))
    return rows.select("part_id", F.col("_block_no").cast("long").alias("seq"), start.alias("start_ms"),
                       end.alias("end_ms"), F.regexp_replace(words, r"^\n+|\n+$", "").alias("text_raw"),
                       reason.alias("reject_reason"))


def parse_srt(files: DataFrame) -> DataFrame:
    """S2."""
    return _parse_blocks(files, header=False)


def parse_vtt(files: DataFrame) -> DataFrame:
    """S3: ``seq`` counts blocks, so it is ordered but has holes where header blocks were skipped."""
    return _parse_blocks(files, header=True)


def parse_untimed_text(files: DataFrame) -> DataFrame:
    """One untimed row per file; time columns stay null."""
    raw = _without_bom(F.col("content"))
    return files.select("part_id", F.lit(False).alias("timed"), F.lit(None).cast("long").alias("start_ms"),
                        F.lit(None).cast("long").alias("end_ms"), raw.alias("text_raw"),
                        tx.clean_text(raw).alias("text_clean"))


def parse_by_format(files: DataFrame) -> DataFrame:
    """Route each file by ``format``; unknown suffixes become one rejected row."""
    out = None
    for suffix, parser in (("json", parse_subtitle_json), ("srt", parse_srt), ("vtt", parse_vtt)):
        part = parser(files.filter(F.col("format") == suffix)).withColumn("timed", F.lit(True))
        out = part if out is None else out.unionByName(part)
    text = parse_untimed_text(files.filter(F.col("format") == "txt")).drop("text_clean").withColumns(
        {"seq": F.lit(0).cast("long"), "reject_reason": F.lit(None).cast("string")})
    unknown = files.filter(~F.col("format").isin("json", "srt", "vtt", "txt")).select(
        "part_id", F.lit(0).cast("long").alias("seq"), F.lit("unsupported_format").alias("reject_reason"))
    return out.unionByName(text).unionByName(unknown, allowMissingColumns=True)


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """S1-S5 on a directory."""
    return parse_by_format(read_files(spark, path))


def _json_kind(kind: T.DataType) -> str:
    """Pattern of the variant types that a field of this type may hold. A null is allowed, text for a number is not."""
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<(VOID|{_json_kind(kind.elementType)})>"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "OBJECT<.*>"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "BIGINT"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return r"(BIGINT|FLOAT|DOUBLE|DECIMAL\([0-9, ]+\))"
    return "BOOLEAN" if isinstance(kind, T.BooleanType) else "STRING"


def parse_records(lines: DataFrame, schema: T.StructType, major: str, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Versioned JSON lines; unknown majors, unknown fields, broken lines and fields of a wrong type are rejected.

    A line without ``schema_version`` is accepted: the version has a default. ``keep`` names columns of ``lines`` to carry along.
    """
    full = T.StructType([*schema.fields, T.StructField("schema_version", T.StringType())])
    names = [f.name for f in full.fields]
    parsed = lines.withColumn("_r", F.from_json(column, full)).withColumn("_keys", F.json_object_keys(column))
    value = F.try_parse_json(column)
    kinds = [(F.schema_of_variant(F.try_variant_get(value, f"$.{f.name}", "variant")), _json_kind(f.dataType)) for f in full.fields]
    wrong = reduce(lambda a, b: a | b, [F.coalesce(~kind.rlike(f"^(VOID|{fits})$"), F.lit(False)) for kind, fits in kinds])
    reason = (F.when(F.col("_keys").isNull(), "not_an_object")
              .when(F.substring_index("_r.schema_version", ".", 1) != major, "unsupported_version")
              .when(F.size(F.array_except("_keys", F.array(*[F.lit(n) for n in names]))) > 0, "unknown_field")
              .when(wrong, "wrong_type"))
    return parsed.select(*keep, *[F.col("_r")[f.name].alias(f.name) for f in schema.fields], reason.alias("reject_reason"))


def read_records_jsonl(spark: SparkSession, path: str, schema: T.StructType, major: str) -> DataFrame:
    """S8 on files."""
    return parse_records(spark.read.text(path), schema, major)


def records_table(df: DataFrame, columns: Sequence[str], version: str = "1.0.0") -> DataFrame:
    """K1: sorted-key compact JSON lines with a schema version."""
    versioned = df.withColumn("schema_version", F.lit(version))
    return versioned.select(vx.canonical_json([*columns, "schema_version"]).alias("value"))
