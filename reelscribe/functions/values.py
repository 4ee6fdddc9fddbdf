"""Time codes, fingerprints, keys and labels as column expressions. Media time is long milliseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscribe.functions import text as tx

_CODE = r"^(?:([0-9]{1,3}):)?([0-9]{2}):([0-9]{2})([,.])([0-9]{3})$"


def timecode_to_ms(code: Column) -> Column:
    """Strict ``HH:MM:SS[,.]mmm``; hours may be missing only with '.'; null when invalid."""
    value = F.trim(code)

    def group(i: int) -> Column:
        return F.regexp_extract(value, _CODE, i)

    hours = F.when(group(1) == "", F.lit(0)).otherwise(group(1).try_cast("long"))
    minutes, seconds, millis = (group(i).try_cast("long") for i in (2, 3, 5))
    valid = value.rlike(_CODE) & ~((group(1) == "") & (group(4) == ",")) & (minutes < 60) & (seconds < 60)
    return F.when(valid, hours * 3_600_000 + minutes * 60_000 + seconds * 1000 + millis)


def ms_to_timecode(ms: Column, separator: str = ".") -> Column:
    """``HH:MM:SS<sep>mmm``; null for negative time."""
    def div(col: Column, n: int) -> Column:
        return F.floor(col / n).cast("long")

    text = F.format_string(f"%02d:%02d:%02d{separator}%03d", div(ms, 3_600_000),
                           div(ms % 3_600_000, 60_000), div(ms % 60_000, 1000), ms % 1000)
    return F.when(ms >= 0, text)


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON with keys in name order and nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def row_fingerprint(columns: Sequence[str]) -> Column:
    """P12."""
    return F.sha2(canonical_json(columns), 256)


def numbered(prefix: str, number: Column, width: int = 6) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number)


def job_key(kind: Column, identity: Column, page: Column, range_json: Column, normalized: Column | None = None) -> Column:
    """Deterministic job id from the source identity and the requested range.

    A short link has no identity yet (null): it is known by a hash of its ``normalized`` address.
    """
    if normalized is not None:
        short = F.concat(F.lit("short-"), F.substring(F.sha2(F.concat(F.lit('"'), normalized, F.lit('"')), 256), 1, 12))
        identity = F.coalesce(identity, F.when(kind == "bilibili", short))
    range_hash = F.substring(F.sha2(range_json, 256), 1, 8)
    path_hash = F.substring(F.sha2(F.to_json(F.struct(identity.alias("path"))), 256), 1, 16)
    selection = F.coalesce(F.concat(F.lit("p"), page.cast("string")), F.lit("all"))
    video = F.substring(F.concat_ws("-", F.lit("bili"), F.lower(identity), selection, range_hash), 1, 96)
    return (F.when(kind == "bilibili", video)
            .when(kind == "subtitle", F.concat_ws("-", F.lit("subtitle"), path_hash, range_hash))
            .otherwise(F.concat_ws("-", F.lit("local"), path_hash, range_hash)))


def clock_label(ms: Column) -> Column:
    """P20: ``MM:SS`` with whole seconds; minutes may pass 59."""
    seconds = F.floor(ms / 1000).cast("long")
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("long"), seconds % 60)


def time_link(base: Column, ms: Column, page: Column | int = 1) -> Column:
    """P20: deep link into a video at whole seconds."""
    page = F.lit(page) if isinstance(page, int) else page
    return F.format_string("%s?p=%d&t=%d", base, page, F.floor(ms / 1000).cast("long"))


def redact_nested(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mask sensitive keys at every depth; other strings go through ``redact_text``.

    The schema is walked once on the driver; the result is one projection.
    """
    def masked(value: Column, kind: T.DataType) -> Column:
        return F.when(value.isNotNull(), F.lit(tx.MASK)) if isinstance(kind, T.StringType) else F.lit(None).cast(kind)

    def walk(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return tx.redact_text(value)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda v: walk(v, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(value, lambda k, v: F.when(
                tx.is_sensitive_key(k), masked(v, kind.valueType)).otherwise(walk(v, kind.valueType)))
        if isinstance(kind, T.StructType):
            rebuilt = F.struct(*[
                (masked(value[f.name], f.dataType) if tx.is_sensitive_name(f.name)
                 else walk(value[f.name], f.dataType)).alias(f.name) for f in kind.fields])
            return F.when(value.isNotNull(), rebuilt)
        return value

    chosen = set(columns if columns is not None else df.columns)
    return df.select(*[
        ((masked(F.col(f.name), f.dataType) if tx.is_sensitive_name(f.name) else walk(F.col(f.name), f.dataType))
         .alias(f.name)) if f.name in chosen else F.col(f.name)
        for f in df.schema.fields])
