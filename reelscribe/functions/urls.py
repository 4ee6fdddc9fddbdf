"""URL expressions: secret-free URLs and canonical video addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelscribe.functions import text as tx

_SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def split_url(url: Column) -> dict[str, Column]:
    """Scheme, host, port, path, query of an absolute URL; empty strings when absent."""
    net = F.regexp_replace(F.regexp_extract(url, _SHAPE, 2), "^.*@", "")
    return {
        "scheme": F.lower(F.regexp_extract(url, _SHAPE, 1)),
        "host": F.lower(F.regexp_extract(net, r"^(\[[^\]]*\]|[^:]*)", 1)),
        "port": F.regexp_extract(net, r":0*([1-9][0-9]*)$", 1),
        "path": F.regexp_extract(url, _SHAPE, 3),
        "query": F.regexp_extract(url, _SHAPE, 4),
    }


def _decode(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), F.translate(part, "+", " "))


def _encode(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def sanitize_url(url: Column, keep_keys: Sequence[str] | None = None) -> Column:
    """P5: no userinfo, no fragment, sensitive query values masked; other text is masked inline."""
    parts = split_url(url)

    def pair(item: Column) -> Column:
        key = _decode(F.substring_index(item, "=", 1))
        value = F.when(F.contains(item, F.lit("=")), _decode(F.regexp_extract(item, "^[^=]*=(.*)$", 1))).otherwise("")
        shown = F.when(tx.is_sensitive_key(key), F.lit(tx.MASK)).otherwise(value)
        return F.struct(key.alias("k"), F.concat(_encode(key), F.lit("="), _encode(shown)).alias("t"))

    pairs = F.transform(F.filter(F.split(parts["query"], "&", -1), lambda i: i != ""), pair)
    if keep_keys is not None:
        pairs = F.filter(pairs, lambda p: p["k"].isin(*keep_keys))
    query = F.array_join(F.transform(pairs, lambda p: p["t"]), "&")
    netloc = F.concat(parts["host"], F.when(parts["port"] != "", F.concat(F.lit(":"), parts["port"])).otherwise(""))
    out = F.concat(parts["scheme"], F.lit("://"), netloc, parts["path"],
                   F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    absolute = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]")
    return F.when(absolute, out).otherwise(tx.mask_inline(url))


def video_source(value: Column, site: str = "bilibili.com", short_site: str = "b23.tv") -> Column:
    """Canonical identity of a video reference, or the reason it is rejected.

    A bare ``BV…``/``av…`` id, a page of ``site`` with such an id, or a link of ``short_site``.
    """
    ref = F.trim(value)
    parts = split_url(ref)
    host = F.regexp_replace(parts["host"], r"\.+$", "")
    bare_bv = ref.rlike("(?i)^BV[0-9A-Za-z]{10}$")
    bare_av = ref.rlike("(?i)^av[0-9]+$")
    known = (host == site) | host.endswith("." + site) | (host == short_site)
    page_text = F.regexp_extract(parts["query"], r"(?:^|&)p=([^&]+)", 1)
    page = F.when(page_text.rlike(r"^\+?[0-9]{1,9}$"), page_text.cast("int"))
    ident = F.regexp_extract(parts["path"], r"(?i)^/+video/+([^/]+)", 1)
    bv = F.when(bare_bv, ref).when(ident.rlike("(?i)^BV[0-9A-Za-z]{10}$"), ident)
    av_text = F.when(bare_av, F.substr(ref, F.lit(3))).when(ident.rlike("(?i)^av[0-9]+$"), F.substr(ident, F.lit(3)))
    av = av_text.cast("long")
    bare = bare_bv | bare_av
    short = ~bare & (parts["host"] == short_site)
    bad_page = ~bare & (page_text != "") & (page.isNull() | (page < 1))
    reason = (
        F.when(bare, F.lit(None).cast("string"))
        .when(~parts["scheme"].isin("http", "https") | ~known, F.lit("unsupported_host"))
        .when(bad_page, F.lit("invalid_page"))
        .when(~short & bv.isNull() & av.isNull(), F.lit("missing_video_id"))
    )
    video = F.coalesce(bv, F.concat(F.lit("av"), av.cast("string")))
    shown_page = F.when(~bare, page)
    with_page = F.when(shown_page.isNotNull(), F.concat(F.lit("?p="), shown_page.cast("string"))).otherwise("")
    normalized = F.when(short, F.concat(F.lit(f"https://{short_site}"), parts["path"], with_page)).otherwise(
        F.concat(F.lit(f"https://www.{site}/video/"), video, with_page))
    ok = reason.isNull()
    return F.struct(
        reason.alias("reject_reason"),
        F.when(ok, normalized).alias("normalized"),
        F.when(ok & ~short, bv).alias("bvid"),
        F.when(ok & ~short & bv.isNull(), av).alias("aid"),
        F.when(ok, shown_page).alias("page"),
        (ok & short).alias("short_url"),
    )
