"""SQL twins (DuckDB) of the operators that SQL can say: the same rows by plain relational steps."""

from __future__ import annotations

from reelscribe.llm import licenses, line_dedup, line_rules, sharding
from reelscribe.llm.common import INK_PATTERN, LOWER_ASCII, UPPER_ASCII, WORD_PATTERN

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def low(text: str) -> str:
    return f"translate({text}, '{UPPER_ASCII}', '{LOWER_ASCII}')"


WORDS = f"regexp_extract_all({low("coalesce(text, '')")}, '{WORD_PATTERN}')"

LICENCES = f"""
WITH t(template, label, exact, text) AS (VALUES {", ".join(f"({i}, '{label}', {str(i < len(licenses.PHRASES)).lower()}, '{text}')" for i, (text, label) in enumerate(licenses.PHRASES + licenses.NOTICES))}),
tw AS (SELECT template, label, exact, string_split(text, ' ') AS w, least({licenses.GRAM}, len(string_split(text, ' '))) AS k FROM t),
tg AS (
  SELECT template, label, exact, k, len(w) - k + 1 AS n_grams, spot, array_to_string(w[spot + 1 : spot + k], ' ') AS g
  FROM (SELECT *, unnest(range(len(w) - k + 1)) AS spot FROM tw)
),
dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
dg AS (
  SELECT doc_id, k, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(greatest(0, len(w) - k + 1))) AS pos FROM dw, (SELECT DISTINCT k FROM tg))
),
diagonals AS (
  SELECT doc_id, template, label, exact, n_grams, k, pos - spot AS diagonal, list(DISTINCT spot) AS held, min(pos) AS lo
  FROM dg JOIN tg USING (k, g) GROUP BY ALL
),
opened AS (
  SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER o > {licenses.DRIFT}, true) THEN 1 ELSE 0 END AS opens
  FROM diagonals WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)
),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM opened),
spans AS (
  SELECT doc_id, template, label, exact, n_grams, min(lo) AS lo, len(list_distinct(flatten(list(held)))) AS n_held
  FROM numbered GROUP BY doc_id, template, label, exact, n_grams, span
),
real AS (SELECT *, n_held / n_grams AS share FROM spans WHERE CASE WHEN exact THEN n_held = n_grams ELSE n_held / n_grams >= {licenses.MIN_SHARE} END),
by_doc AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(lo) FILTER (exact) AS first_word, max(lo) FILTER (exact) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(share) AS score, count(*) AS n_spans
  FROM real GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score, coalesce(n_spans, 0) AS n_spans
FROM dw LEFT JOIN by_doc USING (doc_id)
"""

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, {low(f"trim(line, {BLANK})")} AS key FROM l),
shared AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCUMENTS}),
j AS (SELECT k.*, shared.key IS NOT NULL AND k.doc_id <> shared.keeper AS dropped FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
iw AS (SELECT cast(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM iw WHERE len(w) > 0)
),
runs AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(greatest(0, len(w) - n + 1))) AS i FROM dw, (SELECT DISTINCT n FROM windows))
),
hits AS (SELECT doc_id, i, n, item FROM runs JOIN windows USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(ids, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_SYMBOLS = r"[#*$%&|<>]"
_FAILS = f"""(bare <> '' AND (
  (NOT regexp_matches(bare, {quoted(line_rules.AT_LEAST_SHORT_LINE)}) AND NOT regexp_matches(bare, {quoted(line_rules.SENTENCE_END)}))
  OR regexp_matches(bare, {quoted(line_rules.MENU_PATTERN)})
  OR 4 * (length(bare) - length(regexp_replace(bare, '{_SYMBOLS}+', '', 'g'))) > length(bare)
  OR (length(bare) <= {line_rules.NOTICE_CHARS} AND regexp_matches(lower(bare), {quoted("|".join(line_rules.BOILERPLATE))}))))"""

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{INK_PATTERN}') AS w FROM documents),
l AS (SELECT doc_id, unnest(range(len(string_split(body, chr(10))))) AS i, unnest(string_split(body, chr(10))) AS line FROM d),
b AS (SELECT *, trim(line, {BLANK}) AS bare FROM l),
f AS (SELECT *, {_FAILS} AS fails FROM b),
by_line AS (
  SELECT doc_id, count(*) FILTER (bare <> '') - count(DISTINCT line) FILTER (bare <> '') AS n_dup_lines, count(*) FILTER (fails) AS n_lines_removed,
    coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) FILTER (NOT fails), 0) AS chars_left
  FROM f GROUP BY doc_id
),
g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(greatest(0, len(w) - 4))) AS i FROM d)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
by_gram AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(5)) AS o) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(body, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(body) - length(regexp_replace(body, '{_SYMBOLS}', '', 'g')) AS n_symbols, n_dup_lines, coalesce(n, 0) AS n_repeat_words, n_lines_removed, chars_left
  FROM d JOIN by_line USING (doc_id) LEFT JOIN by_gram USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * chars_left >= {line_rules.MIN_KEPT_PERCENT} * word_chars AS kept, n_lines_removed
FROM m
"""

HARD_NEGATIVES = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY rank <= 5
"""

# Ids through the finaliser that common.mix names, drawn numbers by a recursive walk, CRC-32 byte by byte over a table made from its polynomial.
SHARDS = f"""
WITH RECURSIVE k AS (
  SELECT DISTINCT doc_id, ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616)::UBIGINT AS x FROM documents
),
m1 AS (SELECT doc_id, ((xor(x, x >> 30)::UHUGEINT * 13787848793156543929) % 18446744073709551616)::UBIGINT AS x FROM k),
m2 AS (SELECT doc_id, ((xor(x, x >> 27)::UHUGEINT * 10723151780598845931) % 18446744073709551616)::UBIGINT AS x FROM m1),
walk AS (
  SELECT doc_id, xor(x, x >> 31) AS state, 0::BIGINT AS j FROM m2
  UNION ALL
  SELECT doc_id, state, floor((j + 1) * (2147483648.0::DOUBLE / ((state >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, ((state::UHUGEINT * {sharding.STEP} + 1) % 18446744073709551616)::UBIGINT AS state, j FROM walk WHERE j < {sharding.SHARDS + 1})
),
placed AS (SELECT doc_id, max(j) FILTER (j < {sharding.SHARDS})::INT AS shard, max(j) FILTER (j < {sharding.SHARDS + 1})::INT AS grown_shard FROM walk GROUP BY doc_id),
crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
texts AS (SELECT DISTINCT text, coalesce(hex(encode(text)), '') AS h FROM documents),
sums AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: (16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32
  FROM texts, crc_table
)
SELECT d.doc_id, strlen(coalesce(d.text, '')) + 1 AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY d.doc_id NULLS FIRST, text_crc32, strlen(coalesce(d.text, ''))) - 1 AS slot, grown_shard
FROM documents d JOIN placed p ON d.doc_id IS NOT DISTINCT FROM p.doc_id JOIN sums ON d.text IS NOT DISTINCT FROM sums.text
"""
