r"""Comparison SQL of the operators that SQL can express, over whole tables.

Patterns are those of the operators; ``\s`` is written out, as engines differ on it.
"""

from __future__ import annotations

from .decontamination import WIDTH as PHRASE_WORDS
from .line_quality import (BOILERPLATE, MAX_LOST_PERCENT, MAX_REPEAT_PERCENT, MIN_WORDS, NAVIGATION, SEPARATORS,
                           SYMBOLS)
from .ngram_join import WIDTH as SHINGLE_WORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROWS = "SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '{pattern}')"


_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

DECONTAMINATION = f"""WITH docs AS (SELECT rid, doc_id, {_words('t', _TERM)} AS w FROM ({_ROWS})),
items AS (SELECT item_id, w, least(len(w), {PHRASE_WORDS}) AS n FROM (
  SELECT item_id, {_words('text', _TERM)} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
phrases AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
places AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM docs, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)),
hits AS (SELECT rid, i, n, item FROM places JOIN phrases USING (n, phrase)),
words AS (SELECT rid, count(DISTINCT spot) AS n_hit FROM (SELECT rid, i + unnest(range(n)) AS spot FROM hits) GROUP BY rid),
found AS (SELECT rid, list_sort(list(DISTINCT item)) AS found FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  CAST(coalesce(len(found), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(found, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)"""

NGRAM_JOIN = f"""WITH RECURSIVE docs AS (SELECT rid, doc_id, {_words('t', _SPACED)} AS w FROM ({_ROWS})),
tokens AS (SELECT DISTINCT rid, array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' ') AS token FROM (
    SELECT rid, w, unnest(range(1, greatest(len(w) - {SHINGLE_WORDS} + 1, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM tokens GROUP BY rid),
pairs AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM tokens a JOIN tokens b USING (token)
  WHERE a.rid <> b.rid GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.rid JOIN sizes y ON b = y.rid WHERE 100 * k >= 75 * (x.n + y.n - k)),
reached AS (SELECT rid AS a, rid AS b FROM sizes UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a AS rid, min(doc_id) AS component_id FROM reached JOIN docs ON b = docs.rid GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM docs LEFT JOIN sizes USING (rid) LEFT JOIN least USING (rid)"""

_PHRASES = " OR ".join(f"contains(lower(line), '{phrase}')" for phrase in BOILERPLATE)

LINE_QUALITY = f"""WITH docs AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{_SPACED}') AS w FROM ({_ROWS})),
runs AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run FROM (
  SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, run) AS c FROM runs) WHERE c > 1),
repeats AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, i + unnest(range(3)) AS spot FROM again) GROUP BY rid),
lines AS (SELECT rid, line, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS size,
    regexp_replace(line, '[\\p{{L}}\\p{{N}}\\p{{M}}\\x20\\x09-\\x0D]+', '', 'g') AS odd
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs)),
judged AS (SELECT rid, line, size, length(odd) - length(regexp_replace(odd, '[{SYMBOLS}]', '', 'g')) AS symbols,
    length(odd) - length(regexp_replace(odd, '[{SEPARATORS}]', '', 'g')) AS separators, odd FROM lines),
failing AS (SELECT *, size > 0 AND ((size >= 12 AND length(odd) * 10 > size * 3)
    OR NOT regexp_matches(line, '\\p{{L}}') OR symbols * 100 > size * 8 OR separators >= 3
    OR (length(line) - length(replace(line, ' ', '')) <= 8 AND regexp_matches(line, '{NAVIGATION}'))
    OR {_PHRASES}) AS fails FROM judged),
facts AS (SELECT rid, sum(symbols) AS n_symbols,
    count(*) FILTER (size > 0) - count(DISTINCT line) FILTER (size > 0) AS n_dup_lines,
    coalesce(sum(size) FILTER (fails), 0) AS lost, sum(size) AS word_chars FROM failing GROUP BY rid),
counts AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(lost AS BIGINT) AS lost_chars
  FROM docs JOIN facts USING (rid) LEFT JOIN repeats USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND lost_chars * 100 <= word_chars * {MAX_LOST_PERCENT} AS kept FROM counts"""

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_DIGITS}', ((v >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0))

WARC_RECORDS = f"""WITH rows AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
marked AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS response, count(*) OVER (PARTITION BY h) AS n FROM rows),
digests AS (SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(sha1(h), CAST(5 * k + 1 AS BIGINT), 5) AS INTEGER)) AS parts
  FROM marked)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(parts, lambda v: {_BASE32}), '') AS payload_digest,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM response THEN response END AS refers_to FROM digests"""

#: Unsigned crc32 of the decimal text of `c`: a fold over its bytes, eight steps each.
_CRC32 = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), " \
    "lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), " \
    "lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END))"

CONVERSATION_TRIE = f"""WITH turns AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY k) AS w, CAST(xor({_CRC32}, CAST(4294967295 AS BIGINT)) % 9 AS BIGINT) AS h
  FROM turns GROUP BY c),
whole AS (SELECT o.c, list_concat(coalesce(b.w, [])[1:o.h], o.w[o.h + 1:]) AS w FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 5),
rows AS (SELECT c, w, d, w[1:d] AS path FROM (SELECT c, w, unnest(range(len(w) + 1)) AS d FROM whole)),
nodes AS (SELECT path, d, min(c) AS conv_id, count(*) AS n, list(c ORDER BY c) FILTER (len(w) = d) AS ends FROM rows GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
families AS (SELECT s.*, coalesce(k.n, 0) AS n_children,
    CASE WHEN d > 0 THEN (s.n - 1) * octet_length(encode(path[d].x)) ELSE 0 END AS weight
  FROM nodes s LEFT JOIN kids k USING (path, d)),
above AS (SELECT path[1:e] AS path, e AS d, weight, n_children FROM (SELECT *, unnest(range(d + 1)) AS e FROM families)),
sums AS (SELECT path, d, sum(weight) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM above GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(array_to_string(f.ends, ','), '')) AS ends_sha256
FROM families f JOIN sums USING (path, d) LEFT JOIN nodes p ON p.d = f.d - 1 AND p.path = f.path[1:f.d - 1]"""
