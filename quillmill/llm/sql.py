"""Oracle SQL (DuckDB) of the pN_ queries that SQL can express over whole tables."""

from __future__ import annotations

from quillmill.llm.common_words import all_words

P1_FOUND = r"""
WITH t AS (
  SELECT id, raw_text, trim(regexp_replace(lower(source_author), '[\s\x{A0}]+', ' ', 'g')) AS a
  FROM content_reservoir WHERE raw_text IS NOT NULL AND source_author IS NOT NULL),
l AS (SELECT id, a, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 AS line_no FROM t WHERE a <> ''),
n AS (SELECT id, a, line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(line), '[\s\v\p{Z}\x{85}\x{1c}-\x{1f}]+', ' ', 'g'), '\p{Nd}+', '0', 'g'), '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '') AS k FROM l),
r AS (SELECT a, k FROM n WHERE k <> '' GROUP BY a, k HAVING count(DISTINCT id) >= 5)
SELECT DISTINCT n.id AS item_id, CAST(line_no AS INTEGER) AS line_no FROM n JOIN r USING (a, k)
"""

P1_CLEAN = P1_FOUND.replace("SELECT DISTINCT n.id AS item_id, CAST(line_no AS INTEGER) AS line_no FROM n JOIN r USING (a, k)", r""", h AS (SELECT DISTINCT n.id, line_no FROM n JOIN r USING (a, k)),
x AS (SELECT DISTINCT ON (id) id, raw_text FROM content_reservoir),
y AS (SELECT id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 AS line_no FROM x),
z AS (SELECT y.id, coalesce(string_agg(line, chr(10) ORDER BY y.line_no) FILTER (WHERE h.id IS NULL), '') AS clean_text FROM y LEFT JOIN h ON h.id = y.id AND h.line_no = y.line_no GROUP BY y.id)
SELECT x.id, CAST(length(raw_text) AS INTEGER) AS chars_before, CAST(length(clean_text) AS INTEGER) AS chars_after, clean_text FROM x LEFT JOIN z ON z.id = x.id""")

P2_FOUND = """
SELECT id AS item_id, chunk_index FROM content_reservoir WHERE length(raw_text) > 6000
UNION SELECT doc_id AS item_id, chunk_index FROM chunks WHERE length(text) > 6000
"""

_P5 = r"""
WITH l AS (
  SELECT id, upper(regexp_replace(primary_pillar, '^\s+|\s+$', '', 'g')) AS pillar, source_metadata.batch_id AS batch_id, virality_score AS v,
    row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, virality_score DESC NULLS LAST) AS r
  FROM content_atoms),
s AS (SELECT id, pillar, batch_id, CASE WHEN v = 0 THEN CAST(0 AS DOUBLE) ELSE v END AS score FROM l
  WHERE r = 1 AND v IS NOT NULL AND NOT isnan(v) AND batch_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY pillar, batch_id ORDER BY score DESC, id) AS position FROM s)
"""


P9_FOUND = r"""
WITH w AS (SELECT doc_id, string_split_regex(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS a FROM documents WHERE text IS NOT NULL),
v AS (SELECT item_id, string_split_regex(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS a FROM eval_items WHERE text IS NOT NULL),
d AS (SELECT doc_id, array_to_string(a[i:i + 12], ' ') AS g FROM w, range(1, greatest(len(a) - 11, 1)) AS r(i)),
e AS (SELECT DISTINCT item_id, array_to_string(a[i:i + 12], ' ') AS g FROM v, range(1, greatest(len(a) - 11, 1)) AS r(i))
SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)
"""


P6_FOUND = r"""
WITH rows AS (
  SELECT DISTINCT 'r' AS src, id, 0 AS kind, CAST(NULL AS TIMESTAMPTZ) AS ts, raw_text AS text, CAST(NULL AS VARCHAR) AS url FROM content_reservoir
  UNION SELECT DISTINCT 'i', id, CASE WHEN status = 'PENDING' THEN 1 ELSE 0 END, CASE WHEN status = 'PENDING' THEN ingested_at END, raw_content, source_url FROM raw_ingest WHERE status IN ('PASSED', 'PENDING')),
w AS (SELECT src, id, kind, ts, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS a FROM rows WHERE text IS NOT NULL),
g AS (SELECT DISTINCT src, id, kind, ts, hash(a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) AS h FROM w, range(1, len(a) - 1) AS r(i) WHERE len(a) >= 20),
n AS (SELECT src, id, count(*) AS n FROM g GROUP BY src, id),
c AS (SELECT q.id AS qid, x.src AS xsrc, x.id AS xid, count(*) AS k FROM g q JOIN g x ON q.h = x.h
  WHERE q.kind = 1 AND q.id <> x.id AND (x.kind = 0 OR x.ts < q.ts OR (x.ts = q.ts AND x.id < q.id)) GROUP BY q.id, x.src, x.id),
near AS (SELECT DISTINCT qid AS id FROM c JOIN n q ON q.id = qid AND q.src = 'i' JOIN n x ON x.id = xid AND x.src = xsrc WHERE k * 17 >= (q.n + x.n) * 7),
u AS (SELECT id, kind, ts, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', '') AS t FROM rows WHERE url IS NOT NULL),
v AS (SELECT id, kind, ts, regexp_replace(lower(regexp_extract(t, '^([^/?]*)', 1)), '^(?:www\.|m\.)+', '') AS host, regexp_replace(regexp_extract(t, '^[^/?]*(/[^?]*)', 1), '/+$', '') AS path,
  array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_extract(t, '\?(.*)$', 1), '&'), lambda p: regexp_matches(p, '^(p|id|v)=.')))), '&') AS kept FROM u),
k AS (SELECT id, kind, ts, host || ' ' || path || ' ' || kept AS page FROM v WHERE host <> '' AND (path <> '' OR kept <> '')),
same AS (SELECT DISTINCT q.id FROM k q JOIN k x ON q.page = x.page WHERE q.kind = 1 AND q.id <> x.id AND (x.kind = 0 OR x.ts < q.ts OR (x.ts = q.ts AND x.id < q.id)))
SELECT id FROM near UNION SELECT id FROM same
"""


P7_STATISTICS = r"""
WITH t AS (SELECT id, raw_text AS text FROM content_reservoir UNION SELECT id, raw_content FROM raw_ingest),
p AS (SELECT id, length(text) AS chars, regexp_replace(text, '<[^<>\n]+>', ' ', 'g') AS plain FROM t),
q AS (SELECT id, chars, regexp_replace(plain, '[\x{A0}\x{2007}\x{202F}\x{3000}]', ' ', 'g') AS plain FROM p),
f AS (SELECT *, list_filter(string_split(regexp_replace(lower(plain), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws, regexp_extract_all(plain, '[^\s\v]+') AS toks,
  list_filter(list_transform(string_split(plain, chr(10)), lambda l: regexp_replace(l, '^[ \t\r]+|[ \t\r]+$', '', 'g')), lambda l: l <> '') AS ls FROM q),
m AS (SELECT id, chars, len(ws) AS words, len(ls) AS lines, len(toks) AS tokens, length(regexp_replace(plain, '[ \n\r\t]', '', 'g')) AS visible, len(list_filter(ws, lambda w: list_contains(@WORDS@, w))) AS common,
  len(list_filter(ws, lambda k: regexp_matches(k, '\p{L}'))) AS alphabetic, len(regexp_extract_all(plain, '#|…|\.\.\.')) AS symbols,
  len(list_filter(ls, lambda l: regexp_matches(l, '[.!?…:]["''”’»)]{0,2}$'))) AS ended, len(list_filter(ls, lambda l: regexp_matches(l, '^(?:[-–•*·☐›]|\[[ xX]?\]|#?\(?\d{1,3}[.)]?)[ \t]+[^\s\v]'))) AS bullets,
  coalesce(list_sum(list_transform(list_filter(string_split(plain, chr(10)), lambda l: length(regexp_replace(l, '^[ \t\r]+', '')) < 30), lambda l: length(regexp_replace(l, '[ \t\r]', '', 'g')))), 0) AS short FROM f),
s AS (SELECT id AS item_id, CAST(chars AS INTEGER) AS chars, CAST(words AS INTEGER) AS words, CAST(lines AS INTEGER) AS lines, common, coalesce(visible / nullif(tokens, 0), 0) AS mean_word_length, coalesce(common / nullif(words, 0), 0) AS common_share,
  coalesce(alphabetic / nullif(words, 0), 0) AS alphabetic_share, coalesce(symbols / nullif(tokens, 0), 0) AS symbol_ratio, coalesce(ended / nullif(lines, 0), 0) AS ended_share, coalesce(bullets / nullif(lines, 0), 0) AS bullet_share,
  coalesce(CAST(short AS DOUBLE) / nullif(visible, 0), 0) AS short_share FROM m),
v AS (SELECT *, CASE WHEN chars IS NULL THEN NULL WHEN chars >= 100 THEN list_filter([CASE WHEN mean_word_length NOT BETWEEN 3 AND 10 THEN 'word_length' END, CASE WHEN alphabetic_share < CAST(0.8 AS DOUBLE) THEN 'few_alphabetic_words' END,
  CASE WHEN symbol_ratio > CAST(0.1 AS DOUBLE) THEN 'symbols' END, CASE WHEN bullet_share > CAST(0.9 AS DOUBLE) THEN 'bullets' END, CASE WHEN common < 2 THEN 'few_stop_words' END,
  CASE WHEN ended_share < CAST(0.12 AS DOUBLE) AND short_share > CAST(0.67 AS DOUBLE) THEN 'short_lines_without_ends' END, CASE WHEN common_share < CAST(0.12 AS DOUBLE) THEN 'few_common_words' END], lambda x: x IS NOT NULL) ELSE CAST([] AS VARCHAR[]) END AS reasons FROM s)
"""


def oracle_sql() -> dict[str, str]:
    p7 = P7_STATISTICS.replace("@WORDS@", "[" + ", ".join(f"'{w}'" for w in all_words()) + "]")
    return {
        "p1_found": P1_FOUND,
        "p1_clean": P1_CLEAN,
        "p2_found": P2_FOUND,
        "p6_found": P6_FOUND,
        "p7_found": p7 + "SELECT DISTINCT item_id FROM v WHERE len(reasons) > 0",
        "p7_statistics": p7 + "SELECT * EXCLUDE (common), len(reasons) > 0 AS junk FROM (SELECT DISTINCT ON (item_id) * FROM v)",
        "p9_found": P9_FOUND,
        "p5_found": _P5 + "SELECT id FROM p WHERE position <= 3",
        "p5_ranked": _P5 + "SELECT pillar, batch_id, id, score, CAST(position AS BIGINT) AS position FROM p WHERE position <= 3",
    }
