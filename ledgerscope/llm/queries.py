"""Registered queries of the operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.llm.decontamination import op4_decontamination
from ledgerscope.llm.disclosure import op12_pii_disclosure
from ledgerscope.llm.fill_middle import op11_fill_middle
from ledgerscope.llm.jaccard_join import op10_jaccard_join
from ledgerscope.llm.language_id import op9_language_id
from ledgerscope.llm.resampling import op13_resampling
from ledgerscope.llm.secret_scan import op6_secret_scan
from ledgerscope.llm.sp_sampling import op8_sentencepiece
from ledgerscope.llm.token_counts import op7_token_counts
from ledgerscope.llm.token_files import op3_token_files
from ledgerscope.llm.topk_search import op1_topk_search
from ledgerscope.llm.toxicity import op2_toxicity
from ledgerscope.llm.warc_zip import op5_warc_zip

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([x[1] * x[2] FOR x IN list_zip(q.w, c.w, true)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""

DECONTAMINATION_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
item_window AS (
  SELECT DISTINCT item, n, words[i:i + n - 1] AS win
  FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i
        FROM (SELECT *, least(10, len(words)) AS n FROM item WHERE len(words) > 0))),
doc_window AS (
  SELECT r, n, i, words[i:i + n - 1] AS win
  FROM (SELECT d.r, d.words, s.n, unnest(range(1, len(d.words) - s.n + 2)) AS i
        FROM doc d, (SELECT DISTINCT n FROM item_window) s WHERE len(d.words) >= s.n)),
hit AS (SELECT r, item, n, i FROM doc_window JOIN item_window USING (n, win)),
hit_words AS (
  SELECT r, count(DISTINCT pos) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT r, n, i FROM hit)) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

WARC_SQL = """
WITH page AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha
  FROM pages),
coded AS (
  SELECT *, max(page_id) OVER (PARTITION BY sha) AS leader,
         array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                                 1 + CAST(CAST(lpad(substr(bits, 5 * i + 1, 5), 32, '0') AS BIT) AS INTEGER), 1)
                          FOR i IN range(32)], '') AS payload_digest
  FROM (SELECT *, CAST(unhex(sha) AS BIT)::VARCHAR AS bits FROM page))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> leader THEN leader END AS refers_to
FROM coded
"""

JACCARD_SQL = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS words FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN words ELSE words[i:i + 4] END AS s
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM doc WHERE len(words) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT s, min(doc_id) AS d FROM shingle GROUP BY s HAVING count(*) > 1),
paired AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM shared JOIN shingle a USING (s) JOIN shingle b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM paired JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y
  WHERE 100 * common >= 80 * (a.n + b.n - common)),
way AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT doc_id, doc_id AS node FROM size
  UNION SELECT reach.doc_id, way.y FROM reach JOIN way ON reach.node = way.x)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c.least, doc.doc_id) AS component_id
FROM doc LEFT JOIN size USING (doc_id)
LEFT JOIN (SELECT doc_id, min(node) AS least FROM reach GROUP BY doc_id) c USING (doc_id)
"""

FILL_MIDDLE_SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n, [CAST('0x' || substr(digest, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM doc),
cut AS (
  SELECT *, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain,
         least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b
  FROM drawn),
part AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
         array_to_string(units[b + 1:n], '') AS s
  FROM cut)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN h[4] % 100 < 50 THEN '<S>' || s || '<P>' || p || '<M>' || m
                   ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM part
"""

RESAMPLING_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
item AS (
  SELECT unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
doc_word AS (SELECT r, unnest(words) AS word FROM doc),
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
word AS (
  SELECT word, xor(list_reduce([4294967295] || [CAST('0x' || substr(digits, 2 * j + 1, 2) AS BIGINT)
                                                 FOR j IN range(CAST(length(digits) / 2 AS BIGINT))],
                               lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS digits FROM (SELECT word FROM doc_word UNION SELECT word FROM item)), crc_table),
s AS (SELECT bucket, count(*) AS s FROM doc_word JOIN word USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM item JOIN word USING (word) GROUP BY bucket),
total AS (
  SELECT (SELECT coalesce(sum(s), 0) FROM s) + 10000 AS sn, (SELECT coalesce(sum(t), 0) FROM t) + 10000 AS tn),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) AS DOUBLE) * sn / (CAST((coalesce(s, 0) + 1) AS DOUBLE) * tn)))
                      AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM word) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), total),
weight AS (
  SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM doc_word JOIN word USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(
           '2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM doc LEFT JOIN weight USING (r)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS able
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank
FROM placed
"""

_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
          "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _pii_sql() -> str:
    """Base spans by the plain patterns; the terms by counts of rows and texts, all in tables."""
    found = " UNION ALL ".join(
        f"SELECT r, text, '{kind}' AS kind, {k} AS k, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM doc"
        for k, (kind, p) in enumerate(_PLAIN.items()))
    bare = "part"
    for kind in ("phone", "email", "ip"):
        bare = f"regexp_replace({bare}, '{_PLAIN[kind]}', ' ', 'g')"
    words = f"regexp_extract_all(translate({bare}, {_ASCII}), '{_LETTERS}{{3,}}')"
    disclosed = "1 - ln(CAST({n} AS DOUBLE) / {of}) / ln(CAST(e.n AS DOUBLE) / (SELECT count(*) FROM doc))"
    known = "e.n < (SELECT count(*) FROM doc)"
    return rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_LOWERED} AS low FROM documents),
found AS ({found}),
run AS (
  SELECT r, text, kind, k, value, digits, place AS start, place + length(value) AS stop
  FROM (SELECT *, m[i] AS value, regexp_replace(m[i], '[^0-9]', '', 'g') AS digits,
               CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT) AS place
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found))
  WHERE kind <> 'card' OR length(digits) BETWEEN 14 AND 19),
mention AS (
  SELECT * FROM (
    SELECT *, coalesce(lag(stop) OVER w, 0) AS before_at, coalesce(lead(start) OVER w, length(text)) AS after_at,
           CASE kind WHEN 'email' THEN 'email:' || translate(value, {_ASCII}) WHEN 'ip' THEN 'ip:' || value
                     ELSE kind || ':' || digits END AS entity
    FROM run WINDOW w AS (PARTITION BY r, kind ORDER BY start))
  WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len([x FOR x IN string_split(value, '.') IF length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 3) AS INT) > 255]) = 0
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
    ELSE list_sum([CASE WHEN j % 2 = 0 THEN CAST(substr(digits, length(digits) - j, 1) AS INT)
                        ELSE CAST(substr(digits, length(digits) - j, 1) AS INT) * 2
                             - CASE WHEN substr(digits, length(digits) - j, 1) > '4' THEN 9 ELSE 0 END END
                   FOR j IN range(length(digits))]) % 10 = 0 END),
side AS (
  SELECT r, entity, true AS head, substr(text, before_at + 1, start - before_at) AS whole FROM mention
  UNION ALL SELECT r, entity, false, substr(text, stop + 1, after_at - stop) FROM mention),
cut AS (
  SELECT r, entity, head, CASE WHEN length(whole) <= 160 THEN whole
           WHEN head THEN regexp_replace(right(whole, 160), '^{_LETTERS}+', '')
           ELSE regexp_replace(left(whole, 160), '{_LETTERS}+$', '') END AS part
  FROM side),
pair AS (
  SELECT DISTINCT r, entity, term FROM (
    SELECT r, entity, unnest(CASE WHEN head THEN list_reverse(words)[1:5] ELSE words[1:5] END) AS term
    FROM (SELECT *, {words} AS words FROM cut)
    UNION ALL SELECT r, entity, '' FROM mention)),
counted AS (
  SELECT entity, term, left(term, CAST(ceil(length(term) / 2) AS INT)) || '*' AS form, count(*) AS n, count(DISTINCT text) AS texts
  FROM pair JOIN doc USING (r) GROUP BY ALL),
word_rows AS (
  SELECT term, left(term, CAST(ceil(length(term) / 2) AS INT)) || '*' AS form, count(*) AS n
  FROM (SELECT DISTINCT r, unnest(regexp_extract_all(low, '{_LETTERS}{{3,}}')) AS term FROM doc) GROUP BY ALL),
revealing AS (
  SELECT c.entity, c.term
  FROM counted c JOIN counted e ON e.entity = c.entity AND e.term = '' JOIN word_rows v ON v.term = c.term
  WHERE c.term <> '' AND c.texts >= 3 AND {known} AND {disclosed.format(n='c.n', of='v.n')} >= 0.8),
term_of AS (SELECT DISTINCT r, term FROM pair JOIN revealing USING (entity, term)),
token AS (
  SELECT r, m[i] AS term,
         CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT r, regexp_extract_all(low, '{_LETTERS}+') AS m, string_split_regex(low, '{_LETTERS}+') AS g
              FROM doc WHERE r IN (SELECT r FROM term_of)))),
span AS (
  SELECT r, k, kind, start, stop FROM mention
  UNION ALL
  SELECT t.r, 4, 'term', t.start, t.start + length(t.term) FROM token t JOIN term_of USING (r, term)
  WHERE NOT EXISTS (SELECT 1 FROM mention b WHERE b.r = t.r AND b.start < t.start + length(t.term) AND t.start < b.stop)),
listed AS (
  SELECT r, count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip, count(*) FILTER (WHERE k = 2) AS n_card,
         count(*) FILTER (WHERE k = 3) AS n_phone,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (WHERE k < 4) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans
  FROM span GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN listed USING (r)
"""


PII_SQL = _pii_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk_search": op1_topk_search,
        "op2_toxicity": op2_toxicity,
        "op3_token_files": op3_token_files,
        "op4_decontamination": op4_decontamination,
        "op5_warc_zip": op5_warc_zip,
        "op6_secret_scan": op6_secret_scan,
        "op7_token_counts": op7_token_counts,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_language_id": op9_language_id,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_fill_middle": op11_fill_middle,
        "op12_pii_disclosure": op12_pii_disclosure,
        "op13_resampling": op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_search": TOPK_SQL,
        "op4_decontamination": DECONTAMINATION_SQL,
        "op5_warc_zip": WARC_SQL,
        "op10_jaccard_join": JACCARD_SQL,
        "op11_fill_middle": FILL_MIDDLE_SQL,
        "op12_pii_disclosure": PII_SQL,
        "op13_resampling": RESAMPLING_SQL,
    }
