"""Text expressions: cleaning, garble detection, redaction, terms, replacement."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space class, punctuation map, terms and key names the results depend on.
WHITESPACE = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
              r"\x{205f}\x{3000}]")
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")
COMPAT_FROM = "﹐﹑﹒︰﹔﹖﹗\ufeff\u200b"
COMPAT_TO = "，、。：；？！"
CJK_STOPS = "，。！？；：、"
GARBLED = (r"\x{fffd}|锟斤拷|ï»¿|[\x00-\x08\x0b\x0c\x0e-\x1f]"
           r"|(?:Ã[^\n]|Â[^\n]|â€|æ[^\n]|å[^\n]|ä[^\n]){2,}")
FORMULA_CUES = (
    "公式", "等式", "损失函数", "目标函数", "概率", "分布", "期望", "方差", "梯度", "参数", "矩阵",
    "向量", "求和", "最小化", "最大化", "定义", "定理", "推导", "如图", "看这里", "这个式子", "上式",
    "下式", "左边", "右边", "分母", "分子", "等于", "定义为", "我们可以写成",
)
LATIN_TOKEN = r"[A-Za-z][A-Za-z0-9+_.-]{1,}"
NUMBER_OR_SYMBOL = r"\p{Nd}+(?:\.\p{Nd}+)?|[A-Za-z]+[_^][A-Za-z0-9]+"
SENSITIVE_KEYS = (
    "authorization", "cookie", "cookies", "password", "passwd", "token", "access_token",
    "refresh_token", "api_key", "apikey", "key", "signature", "sign", "sig", "upsig", "auth_key",
    "wssecret", "ws_secret", "sessdata", "bili_jct", "csrf", "csrf_token", "dedeuserid",
    "dedeuserid__ckmd5", "buvid3", "buvid4", "b_nut", "b_lsid", "sid", "mid", "uid", "user_id",
    "w_rid", "wts", "bili_ticket", "bili_ticket_expires", "ac_time_value",
)
SENSITIVE_SUFFIXES = ("_token", "_secret", "_key")
INLINE_KEYS = (
    "authorization|cookie|password|token|api[_-]?key|sessdata|bili_jct|csrf|dedeuserid(?:__ckmd5)?"
    "|buvid[34]|b_nut|b_lsid|sid|mid|uid|user_id|w_rid|wts|bili_ticket(?:_expires)?|ac_time_value"
)
MASK = "<redacted>"
# The same findings for Java's engine, which then tries the alternatives only where one may begin: a look at the first character, no
# steps back over letters, and no start inside a run of letters, which fails where its first letter does.
_GARBLED_HERE = r"(?=[\x{fffd}锟ïÃÂâæåä\x00-\x08\x0b\x0c\x0e-\x1f])(?:" + GARBLED + ")"
_GARBLED_PLAIN = r"(?=[ïÃÂæåä])(?:ï»¿|(?:[ÃÂæåä][^\n]){2,})"
_NUMBER = r"\p{Nd}+(?:\.\p{Nd}+)?"
_NUMBER_OR_SYMBOL_HERE = _NUMBER + r"|(?<![A-Za-z])[A-Za-z]++[_^][A-Za-z0-9]+"

# Fixed values too: the patterns of inline secrets, header lines and links that masking depends on.
_WS_OPEN = WHITESPACE[1:-1]
INLINE_SECRET = (rf"""(["']?)({INLINE_KEYS})(["']?)({WHITESPACE}*[:=]{WHITESPACE}*)(["']?)"""
                 rf"""([^{_WS_OPEN},;&}}\]"']+)(["']?)""")
AUTH_LINE = rf"^({WHITESPACE}*authorization{WHITESPACE}*:{WHITESPACE}*)[^\r\n]+"
COOKIE_LINE = rf"^({WHITESPACE}*(?:set-)?cookie{WHITESPACE}*:{WHITESPACE}*)[^\r\n]+"
URL_IN_TEXT = rf"https?://[^{_WS_OPEN}'\"<>]+"


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def nfc(text: Column) -> Column:
    """NFC form. Text below U+0300 is its own NFC form, so only other rows carry text to Python."""
    needs = text.rlike(r"[^\x{0}-\x{2ff}]")
    return F.coalesce(_nfc(F.when(needs, text)), text)


def is_plain(text: Column) -> Column:
    """Letters and signs below U+0300 only, and no blanks but spaces and line feeds: most texts, for which fewer rules can apply."""
    return text.rlike(r"^[\n -~\x{a1}-\x{2ff}]*+\z")  # a search for a character outside takes ten times as long in Java


def clean_text(text: Column) -> Column:
    """Normalised, white-space collapsed text with no blanks around punctuation."""
    # One pass maps every kind of blank to a space and the compatibility marks to theirs, and drops
    # the zero-width characters, so that the expressions below only touch the few places to change.
    plain = is_plain(text)
    mapped = F.translate(nfc(text), BLANKS + COMPAT_FROM, " " * len(BLANKS) + COMPAT_TO)
    out = F.when(plain, F.replace(text, F.lit("\n"), F.lit(" "))).otherwise(mapped)
    out = F.trim(F.regexp_replace(out, " {2,}", " "))
    out = F.regexp_replace(out, f" ([{CJK_STOPS},.!?;:])", "$1")
    return F.when(plain, out).otherwise(F.regexp_replace(out, f"([{CJK_STOPS}]) ", "$1"))


def visible_length(text: Column) -> Column:
    """Characters that are no white space."""
    plain = F.length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return F.when(is_plain(text), plain).otherwise(F.length(F.translate(text, BLANKS + " ", ""))).cast("long")


def is_blank(text: Column) -> Column:
    """Nothing but white space."""
    return ~text.rlike("[^" + WHITESPACE[1:])


def number_or_symbol_count(text: Column) -> Column:
    """Distinct numbers and symbols with a mark (``x_1``, ``x^2``); most texts hold no mark, so only numbers are looked for."""
    marked = F.contains(text, F.lit("_")) | F.contains(text, F.lit("^"))
    found = F.when(marked, F.regexp_extract_all(text, F.lit(_NUMBER_OR_SYMBOL_HERE), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)))
    return F.size(F.array_distinct(found))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITESPACE}+|{WHITESPACE}+$", "")


def normalize_readable(text: Column) -> Column:
    """Full-width separators, no blanks, repeated stops collapsed."""
    out = F.translate(text, ",;: \t", "，；：")
    return strip(F.regexp_replace(out, r"([，。！？；：])\1+", "$1"))


def is_garbled(text: Column) -> Column:
    """P3."""
    return F.when(is_plain(text), text.rlike(_GARBLED_PLAIN)).otherwise(text.rlike(_GARBLED_HERE))


def is_sensitive_key(key: Column) -> Column:
    name = F.translate(F.lower(key), "-", "_")
    hit = name.isin(*SENSITIVE_KEYS)
    for suffix in SENSITIVE_SUFFIXES:
        hit = hit | name.endswith(suffix)
    return hit


def is_sensitive_name(key: str) -> bool:
    name = key.lower().replace("-", "_")
    return name in SENSITIVE_KEYS or name.endswith(SENSITIVE_SUFFIXES)


def mask_inline(text: Column) -> Column:
    masked = F.regexp_replace(text, "(?iu)" + INLINE_SECRET, f"$1$2$3$4$5{MASK}$7")
    return F.when(text.rlike("[:=]"), masked).otherwise(text)


def redact_text(text: Column) -> Column:
    """Header lines, then URLs, then inline ``key: value`` secrets."""
    from reelscribe.functions.urls import sanitize_url

    out = F.regexp_replace(text, "(?imud)" + AUTH_LINE, f"$1{MASK}")
    out = F.regexp_replace(out, "(?imud)" + COOKIE_LINE, f"$1{MASK}")
    url = "(?i)" + URL_IN_TEXT
    between = F.split(out, url, -1)
    urls = F.transform(F.regexp_extract_all(out, F.lit(url), 0), lambda u: sanitize_url(u))
    rebuilt = F.array_join(F.zip_with(between, F.array_append(urls, ""), lambda b, u: F.concat(b, u)), "")
    return mask_inline(F.when(out.rlike(url), rebuilt).otherwise(out))


# Cherokee folds to capitals: small letters and their capitals, by rule. A noncharacter stands for the dotless i meanwhile.
_CHEROKEE_SMALL = "".join(map(chr, [*range(0xAB70, 0xABC0), *range(0x13F8, 0x13FE)]))
_CHEROKEE_CAPITAL = "".join(map(chr, [*range(0x13A0, 0x13F0), *range(0x13F0, 0x13F6)]))
_HELD = "\ufdd0"


def casefold(text: Column) -> Column:
    """Full case folding: capitals, then small letters, so that letters written as several ones fold too; without regard to place."""
    ascii = F.octet_length(text) == F.length(text)  # nothing but a-z to fold
    capitals = F.replace(F.upper(F.translate(text, "ı", _HELD)), F.lit("ẞ"), F.lit("SS"))
    return F.when(ascii, F.lower(text)).otherwise(F.translate(F.lower(capitals), _HELD + "ς" + _CHEROKEE_SMALL, "ıσ" + _CHEROKEE_CAPITAL))


def term_key(text: Column, dashes: bool = False) -> Column:
    """Case-folded key with blanks collapsed; ``dashes`` also reads '-' as a blank."""
    blanks = BLANKS + ("-" if dashes else "")
    return F.trim(F.regexp_replace(F.translate(casefold(text), blanks, " " * len(blanks)), " {2,}", " "))


def sorted_matches(text: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0)))


def cues_in(text: Column, cues: Sequence[str]) -> Column:
    listed = F.array(*[F.lit(c) for c in cues])
    return F.filter(listed, lambda c: F.contains(text, c))


def count_of(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty string."""
    removed = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return (removed / F.length(needle)).cast("long")


def is_word_term(original: Column) -> Column:
    return F.translate(original, "- ", "").rlike("^[A-Za-z0-9]+$")


def _quoted(original: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(original, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _literal_pattern(original: Column) -> Column:
    return F.concat(F.lit("(?<![A-Za-z])"), _quoted(original), F.lit("(?![A-Za-z])"))


def _literal_template(suggested: Column) -> Column:
    return F.replace(F.replace(suggested, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def replace_term(text: Column, original: Column, suggested: Column) -> Column:
    """Replace a term, whole-word for ASCII terms; the suggestion is literal text."""
    word = F.regexp_replace(text, _literal_pattern(original), _literal_template(suggested))
    return F.when(is_word_term(original), word).otherwise(F.replace(text, original, suggested))


def count_term(text: Column, original: Column) -> Column:
    """How many replacements ``replace_term`` makes."""
    word = F.regexp_count(text, _literal_pattern(original)).cast("long")
    return F.when(is_word_term(original), word).otherwise(count_of(text, original))


def holds_term(text: Column, original: Column) -> Column:
    """Whether ``replace_term`` replaces anything: a search for the literal first, its neighbours after, up to the first place."""
    quoted = _quoted(original)
    pattern = F.concat(quoted, F.lit("(?<![A-Za-z]"), quoted, F.lit(")(?![A-Za-z])"))
    return F.when(is_word_term(original), F.regexp_like(text, pattern)).otherwise(F.contains(text, original))


def letter_runs(text: Column) -> Column:
    """Hashes of the distinct runs of ASCII letters in a text, for ``key_run``."""
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))), lambda run: F.hash(run))


def key_run(term: Column) -> Column:
    """Hash of the longest run of ASCII letters in a whole-word term: a text that holds the term has this run among its own, as no letter
    stands beside the term. Null where that tells nothing, for other terms and terms without letters."""
    runs = F.regexp_extract_all(term, F.lit("[A-Za-z]+"), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda run: F.struct(F.length(run).alias("n"), run.alias("run"))))["run"]
    return F.when(is_word_term(term) & longest.isNotNull(), F.hash(longest))
