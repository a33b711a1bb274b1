"""Oracle SQL (DuckDB) of the registered queries, written independently of the operators."""

from __future__ import annotations

from quillmill.functions import lexicons as L
from quillmill.operators.elite import AXES
from quillmill.plans import parameters as P


def _alt(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_BLANK = r"[\t\v\f\r \x{85}\p{Z}]"
_SPACE = r"[\s\v\x{85}\p{Z}]"
_CHUNKS = f"""c AS (SELECT *, len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda w: w <> '')) AS wc
  FROM (SELECT DISTINCT ON (doc_id, chunk_index) * FROM chunks))"""
_INGEST = "i AS (SELECT DISTINCT ON (id) * FROM raw_ingest)"
_RESERVOIR = "r AS (SELECT DISTINCT ON (id) * FROM content_reservoir)"
_ATOMS = "a AS (SELECT DISTINCT ON (id, updated_at, virality_score) * FROM content_atoms)"
_URL_KEY = r"left(md5(regexp_replace(regexp_replace(trim(lower(source_url)), '/+$', ''), '[?#](.|\n)*$', '')), 16)"
_HOST = r"replace(lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'www.', '')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_SPACE}+'), lambda w: w <> '')"


def _sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, '. '), lambda s: {_strip('s')}), lambda s: s <> '')"


def _tokens(x: str) -> str:
    return rf"list_distinct(regexp_extract_all({x}, '[\p{{L}}\p{{M}}\p{{N}}_]+'))"


def _has_word(x: str, w: str) -> str:
    return f"contains(' ' || {x} || ' ', ' {w} ')"


def _hits(x: str, patterns: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches({x}, '(?i){_alt([p])}') AS INTEGER)" for p in patterns)


_SIGNALS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){_alt(p)}') THEN '{n}' END" for n, p in P.CORPUS_SIGNALS.items()) + "], lambda x: x IS NOT NULL)"
_QUOTED = "CASE WHEN length(text) > 0 THEN coalesce(list_sum(list_transform(regexp_extract_all(text, '[\"“”]([^\"“”]*)[\"“”]', 1), lambda q: length(q))), 0) / length(text) ELSE 0 END"
_FILLED = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"
_DECISION = f"""CASE WHEN wc < 250 THEN 'WORD_COUNT_LOW' WHEN wc > 900 THEN 'WORD_COUNT_HIGH'
  WHEN {_hits("text", L.META_STRUCTURAL)} >= 2 THEN 'META_STRUCTURAL'
  WHEN {_hits("text", L.INDEX_REFERENCE)} >= 5 THEN 'INDEX_REFERENCE'
  WHEN {_hits("text", L.BIOGRAPHY)} >= 3 AND len({_SIGNALS}) = 0 THEN 'PURE_BIOGRAPHY'
  WHEN {_QUOTED} > 0.30 THEN 'QUOTATION_DUMP'
  WHEN len({_FILLED}) >= 3 AND len(list_filter({_FILLED}, lambda x: regexp_matches(x, '(?i)^(\\d+[.)]\\s|[-•*]\\s|[a-z][.)]\\s)'))) / len({_FILLED}) > 0.5
    AND NOT regexp_matches(text, '(?i){_alt(L.MEANING)}') THEN 'LIST_WITHOUT_MEANING'
  WHEN len({_SIGNALS}) = 0 THEN 'NO_SIGNAL' ELSE 'PASS' END"""

_GATE = f"""g AS (SELECT *, {_sentences("text")} AS ss, lower(array_to_string({_words("text")}[1:100], ' ')) AS head FROM c),
h AS (SELECT *, lower(ss[1]) AS first FROM g),
gate AS (SELECT *, coalesce(len(ss) > 0 AND NOT regexp_matches(first, '(?i){_alt(L.KILL)}')
  AND (contains(array_to_string(ss[1:2], '. '), '?') OR contains(head, ' you ') OR starts_with(first, 'you')
    OR {" OR ".join(_has_word("head", w) for w in L.CONTRAST_OPENING)}
    OR len(list_intersect({_tokens("head")}, {_list(L.EMOTIONAL)})) >= 2
    OR {" OR ".join(f"contains(first, '{w.replace(chr(39), chr(39) * 2)}')" for w in L.STRONG_OPENERS)}
    OR len({_words("first")}) <= 20)
  AND NOT (len(ss) > 3 AND len(list_filter(ss, lambda s: regexp_matches(lower(s), '{_alt(L.EXPLAINER_STARTERS)}'))) / len(ss) > 0.5), false) AS passes FROM h)"""


def _count(x: str, part: str) -> str:
    q = part.replace("'", "''")
    return f"CAST((length({x}) - length(replace({x}, '{q}', ''))) / {len(part)} AS INTEGER)"


def _sum_present(x: str, parts: list[str], each: int) -> str:
    return " + ".join(f"CASE WHEN contains({x}, '{p.replace(chr(39), chr(39) * 2)}') THEN {each} ELSE 0 END" for p in parts)


def _tense(x: str) -> str:
    quoted = [n.replace("'", "''") for n in L.NEGATIONS]
    return "(" + " OR ".join([f"contains({x}, '{n}')" for n in quoted] + [_has_word(x, w) for w in L.CONTRAST_TENSION]) + ")"


# positions of blame terms: the lengths of the parts before them, rebuilt from a split at word starts
_BLAME_AT = (
    r"list_filter(range(0, length(low)), lambda p: regexp_matches(low[p + 1:p + 9], '^(?:" + "|".join(L.BLAME) + r")(?:[^\p{L}\p{M}\p{N}_]|$)') AND (p = 0 OR NOT regexp_matches(low[p:p], '[\p{L}\p{M}\p{N}_]')))"
)
_SENT_SCORE = f"""greatest(CASE WHEN len({_words("s")}) BETWEEN 8 AND 20 THEN 30 WHEN len({_words("s")}) < 8 THEN 15 ELSE 0 END
  + CASE WHEN regexp_matches(lower(s), '^({"|".join(L.CONTEXT_STARTERS)})') THEN 0 ELSE 20 END
  + CASE WHEN list_has_any({_tokens("lower(s)")}, {_list(L.EMOTIONAL)}) THEN 25 ELSE 0 END
  + CASE WHEN contains(lower(s), ' you ') OR list_contains({_list(L.IMPERATIVE_STARTERS)}, regexp_extract(lower(s), '^(\\S+)', 1)) THEN 25 ELSE 0 END
  - CASE WHEN NOT list_has_any({_tokens("lower(s)")}, {_list(L.CONCRETE_NOUNS)}) AND NOT list_has_any({_tokens("lower(s)")}, {_list(L.ACTION_VERBS)}) THEN 20 ELSE 0 END, 0)"""
_AXES = f"""x AS (SELECT doc_id, chunk_index, ss, lower(text) AS low, lower(array_to_string({_words("text")}[1:50], ' ')) AS h50 FROM gate WHERE passes),
y AS (SELECT doc_id, chunk_index,
  least(least(len(list_intersect({_tokens("h50")}, {_list(L.EMOTIONAL)})) * 10, 30)
    + least({" + ".join(f"CASE WHEN {_has_word('h50', w)} THEN 15 ELSE 0 END" for w in L.CONTRAST_OPENING)}, 30)
    + CASE WHEN contains(h50, ' you ') OR starts_with(h50, 'you') THEN 20 ELSE 0 END
    + CASE WHEN len(list_filter(ss[1:2], lambda s: len({_words("s")}) < 15)) > 0 THEN 20 ELSE 0 END, 100) AS punch,
  least({_sum_present("low", L.TRIBAL, 12)} + {_sum_present("low", L.ASPIRATION, 8)} + CASE WHEN regexp_matches(low, '{_alt(L.IDENTITY_COST)}') THEN 20 ELSE 0 END, 100) AS identity,
  least(least(({" + ".join(_count("low", f" {w} ") for w in L.CONTRAST_TENSION)}) * 12, 36) + least(({" + ".join(_count("low", w) for w in L.NEGATIONS)}) * 8, 24)
    + CASE WHEN regexp_matches(low, 'the more .{{5,30}}, the (less|more)') THEN 20 ELSE 0 END
    + CASE WHEN regexp_matches(low, '\\?.*you (think|believe|assume)') THEN 20 ELSE 0 END
    + CASE WHEN len(list_filter(list_transform({_BLAME_AT}, lambda p: low[greatest(p - 50, 0) + 1:p + 50]), lambda w: {_tense("w")})) > 0 THEN 15 ELSE 0 END, 100) AS tension,
  least(coalesce(list_max(list_transform(list_filter(ss, lambda s: length(s) > 10), lambda s: {_SENT_SCORE})), 0), 100) AS quotability FROM x),
z AS (SELECT *, CASE WHEN identity + tension < 60 THEN 24 ELSE 40 END AS novelty FROM y),
axes AS (SELECT doc_id, chunk_index, CAST(punch AS INTEGER) AS punch, CAST(identity AS INTEGER) AS identity, CAST(tension AS INTEGER) AS tension, CAST(quotability AS INTEGER) AS quotability,
  CAST(novelty AS INTEGER) AS novelty, CAST(punch + identity + tension + quotability + novelty AS INTEGER) AS total FROM z)"""


def _elite_ctes(fill_to: int = 1, total: int = 60, edge: int = 0, axes: list[tuple[str, int, int]] = P.ELITE_AXES) -> str:
    """The greedy walk as one running count per axis."""
    out, last = [], "axes"
    out.append("e0 AS (SELECT *, CAST([] AS VARCHAR[]) AS lab FROM axes)")
    for k, (name, quota, least) in enumerate(axes):
        out.append(f"""e{k + 1} AS (SELECT * EXCLUDE (before) REPLACE (CASE WHEN before < {quota} AND {name} >= {least} THEN list_append(lab, '{name}') ELSE lab END AS lab) FROM (
  SELECT *, coalesce(sum(CASE WHEN len(lab) = 0 AND {name} >= {least} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY {name} DESC, chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM e{k}))""")
        last = f"e{k + 1}"
    out.append(f"""fl AS (SELECT *, sum(CASE WHEN len(lab) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS n, len(lab) = 0 AND total >= {total} AND identity + tension >= {edge} AS able FROM {last}),
fr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, able ORDER BY total DESC, chunk_index) AS k FROM fl),
chosen AS (SELECT doc_id, chunk_index, total, CASE WHEN able AND k <= {fill_to} - n THEN ['fill'] ELSE lab END AS lab FROM fr)""")
    return ",\n".join(out)


_ELITE = f"WITH {_CHUNKS}, {_GATE}, {_AXES}, {_elite_ctes()}"


def _docs_md5(expr: str) -> str:
    return f"SELECT doc_id, md5({expr}) AS cleaned_md5 FROM documents WHERE text IS NOT NULL"


_FIXED = "replace(replace(replace(translate(text, '“”‘’–—\xa0�\xad', '\"\"''''-- '), '…', '...'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
_COLLAPSED = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_FIXED}, '{_BLANK}+', ' ', 'g'), ' +(\n)', '\1', 'g'), ' +$', ''), '\n{{3,}}', chr(10) || chr(10), 'g')"
_TWO_BLANKS = r"regexp_replace(regexp_replace({}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g')"
_ARTICLE = _TWO_BLANKS.format("text")
for _p in ("Share this:", "Follow us on", "Subscribe to", "Sign up for", "Tags:", "Categories:", "Posted in", "Leave a comment"):
    _ARTICLE = rf"regexp_replace({_ARTICLE}, '(?i){_p}[^\n]*', '', 'g')"
_ARTICLE = rf"regexp_replace(regexp_replace({_ARTICLE}, '(?i)Comments \(\d+\)', '', 'g'), '(?i)Share on (Facebook|Twitter|LinkedIn)[^\n]*', '', 'g')"
_TRANSCRIPT = _TWO_BLANKS.format("raw_text")
for _p in L.TRANSCRIPT_JUNK:
    _TRANSCRIPT = f"regexp_replace({_TRANSCRIPT}, '(?im){_p}', '', 'g')"

_REASONS = """list_filter([CASE WHEN raw_content IN ('[removed]', '[deleted]') THEN 'content_deleted' END,
  CASE WHEN raw_content IS NULL OR raw_content = '' THEN 'content_empty' END,
  CASE WHEN raw_content <> '' AND raw_content NOT IN ('[removed]', '[deleted]') AND length(raw_content) < 300 THEN 'content_too_short' END,
  CASE WHEN raw_content <> '' AND raw_content NOT IN ('[removed]', '[deleted]') AND length(raw_content) > 5000 THEN 'content_too_long' END{}], lambda x: x IS NOT NULL)"""

_WEEK = "w AS (SELECT event_type, CAST(count(*) AS BIGINT) AS rows FROM events WHERE ts BETWEEN TIMESTAMP '" + P.EVENTS_END + "' - INTERVAL {} DAY AND TIMESTAMP '" + P.EVENTS_END + "' GROUP BY event_type)"
_DAY = "CAST(o_orderdate AS DATE)"
_MONDAY = f"CAST(date_trunc('week', {_DAY}) AS DATE)"


_PIECES = "p AS (SELECT id, format_fit[1] AS kind, atomic_components.core_concept AS c, atomic_components.emotional_hook AS h, atomic_components.supporting_evidence AS e, atomic_components.actionable_insight AS i, atomic_components.quotable_snippet AS q FROM (SELECT DISTINCT ON (id) * FROM content_atoms))"


def _values(rows: list[tuple]) -> str:
    def lit(v: object) -> str:
        if isinstance(v, list):
            return "[" + ", ".join(map(lit, v)) + "]" + ("::INTEGER[]" if all(isinstance(x, int) for x in v) else "")
        return "'" + v + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)

    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


_CANDIDATES = f"""slots AS (SELECT * FROM (VALUES {_values(P.SLOTS)}) t(slot, pillar, format)), angles AS (SELECT * FROM (VALUES {_values(P.ANGLES)}) t(angle, active, pillars, formats, levels, multiplier) WHERE active),
latest AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, CASE WHEN virality_score IS NULL OR isnan(virality_score) THEN -1 ELSE virality_score END DESC) AS n FROM content_atoms),
items AS (SELECT id AS item, upper(trim(primary_pillar)) AS pillar, format_fit, coalesce(complexity_score, 3) AS level, CASE WHEN isnan(virality_score) THEN NULL ELSE virality_score END AS virality FROM latest WHERE n = 1 AND lifecycle_state = 'ACTIVE'),
si AS (SELECT slot, slots.pillar, format, item, level, virality FROM slots JOIN items ON items.pillar = slots.pillar AND list_contains(format_fit, format)),
fit AS (SELECT si.*, angle, multiplier, false AS fallback FROM si JOIN angles ON list_contains(pillars, pillar) AND list_contains(formats, format) AND (len(levels) < 2 OR level BETWEEN levels[1] AND levels[2])),
fb AS (SELECT * FROM (SELECT f AS format, angle, multiplier, row_number() OVER (PARTITION BY f ORDER BY multiplier DESC, angle) AS k FROM (SELECT angle, multiplier, unnest(formats) AS f FROM angles)) WHERE k <= 2),
rest AS (SELECT si.*, angle, multiplier, true AS fallback FROM si JOIN fb ON si.format = fb.format WHERE NOT EXISTS (SELECT 1 FROM fit WHERE fit.slot = si.slot AND fit.item = si.item)),
cand AS (SELECT * FROM fit UNION ALL SELECT * FROM rest)"""
_SCORE = lambda k: f"CAST((l_partkey + {k + 1} * l_linenumber) % 11 AS INTEGER)"
_RATED = f"""s AS (SELECT l_orderkey, l_linenumber, {', '.join(f'{_SCORE(k)} AS {n}' for k, (n, _) in enumerate(P.CRITERIA))} FROM lineitem),
g AS (SELECT *, array_to_string(list_filter([{', '.join(f"CASE WHEN {n} NOT BETWEEN 1 AND 10 THEN '{n}' END" for n, _ in P.CRITERIA)}], lambda x: x IS NOT NULL), ',') AS bad, {' AND '.join(f'{n} >= {m}' for n, m in P.CRITERIA)} AS ok,
  list_filter([{', '.join(f"CASE WHEN {n} < {dict(P.CRITERIA)[n]} THEN '{n}: ' || {n} || '/10' END" for n in ('voice', 'hook', 'share'))}], lambda x: x IS NOT NULL) AS why FROM s)"""
_WEEK_20 = "CAST(o_orderdate AS DATE) >= DATE '1997-05-12' AND CAST(o_orderdate AS DATE) < DATE '1997-05-19'"

# folds over the parts of a text, one step of all documents at a time
_FOLD = rf"""b AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM source),
l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS p FROM b),
m AS (SELECT doc_id, p, x, regexp_matches(lower({_strip("x")}), '^(?:{_alt(L.TOC_START)})$') AS begins, regexp_matches(x, '^{L.TOC_LINE.replace(chr(39), chr(39) * 2)}$') AS entry, {_strip("x")} = '' AS blank FROM l),
f AS (SELECT doc_id, p, x, begins AS inside, 0 AS strange, NOT begins AS keep FROM m WHERE p = 1
  UNION ALL SELECT m.doc_id, m.p, m.x,
    CASE WHEN m.begins THEN true WHEN f.inside AND NOT m.entry AND NOT m.blank AND f.strange + 1 >= 5 THEN false ELSE f.inside END,
    CASE WHEN m.begins THEN 0 WHEN NOT f.inside THEN f.strange WHEN m.entry THEN 0 WHEN m.blank THEN f.strange ELSE f.strange + 1 END,
    NOT m.begins AND (NOT f.inside OR (NOT m.entry AND NOT m.blank AND f.strange + 1 >= 5))
  FROM f JOIN m ON m.doc_id = f.doc_id AND m.p = f.p + 1)"""
_CONTENTS = "source AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), " + _FOLD
_CUT_FRONT = f"""o AS (SELECT *, list_filter(range(0, len(ls)), lambda i: i < floor(len(ls) * CAST(0.15 AS DOUBLE)) AND regexp_matches(lower({_strip("ls[i + 1]")}), '^(?:{_alt(L.ACKNOWLEDGMENTS)})$'))[1] AS s FROM s4),
q AS (SELECT *, list_filter(range(0, len(ls)), lambda i: i > s AND i < least(s + 50, len(ls)) AND regexp_matches(lower({_strip("ls[i + 1]")}), '{_alt(L.FRONT_CHAPTERS)}'))[1] AS e FROM o)"""
_CLEANED = rf"""x AS (SELECT DISTINCT ON (doc_id) doc_id, raw_text AS s0, pages, warnings FROM extraction_results WHERE raw_text IS NOT NULL),
s1 AS (SELECT *, {_FIXED.replace("translate(text,", "translate(s0,")} AS s1 FROM x),
s2 AS (SELECT *, list_filter(string_split(s1, chr(10)), lambda x: NOT regexp_matches(x, '(?i)^(?:{_alt(L.PAGE_NUMBER_LINES)})$')) AS l2 FROM s1),
k2 AS (SELECT *, list_transform(l2, lambda x: lower({_strip("x")})) AS keys FROM s2),
j2 AS (SELECT *, list_filter(keys, lambda k: length(k) > 3 AND length(k) < 100 AND len({_words("k")}) < 10) AS able FROM k2),
i2 AS (SELECT *, list_filter(list_distinct(able), lambda k: len(list_filter(able, lambda y: y = k)) >= 3) AS often FROM j2),
s3 AS (SELECT doc_id, s0, s1, pages, warnings, l2, CASE WHEN len(l2) < 50 THEN l2 ELSE list_filter(l2, lambda x: NOT list_contains(often, lower({_strip("x")}))) END AS l3 FROM i2),
source AS (SELECT doc_id, array_to_string(l3, chr(10)) AS text FROM s3), {_FOLD},
folded AS (SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (WHERE keep), '') AS t FROM f GROUP BY doc_id),
s4 AS (SELECT s3.*, string_split(CASE WHEN pages >= 10 THEN t ELSE array_to_string(l3, chr(10)) END, chr(10)) AS ls FROM s3 JOIN folded ON folded.doc_id = s3.doc_id), {_CUT_FRONT},
s5 AS (SELECT doc_id, s0, s1, pages, warnings, l2, CASE WHEN len(ls) < 30 OR s IS NULL THEN ls ELSE list_concat(ls[1:s], ls[coalesce(e, s + 1) + 1:]) END AS l5 FROM q),
h5 AS (SELECT *, list_filter(range(0, len(l5)), lambda i: i >= floor(len(l5) * CAST(0.85 AS DOUBLE)) AND regexp_matches(lower({_strip("l5[i + 1]")}), '^(?:{_alt(L.BACK_MATTER)})$')) AS hits FROM s5),
s6 AS (SELECT *, array_to_string(CASE WHEN pages < 20 OR len(l5) < 100 OR len(hits) = 0 THEN l5 ELSE l5[1:hits[1]] END, chr(10)) AS s6 FROM h5),
cleaned AS (SELECT doc_id, s0, pages, warnings, length(s1) - length(array_to_string(l2, chr(10))) AS numbers, {_strip(_COLLAPSED.replace(_FIXED, "s6"))} AS cleaned FROM s6)"""
_PARAGRAPHS = rf"""b AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_strip("x")}), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) - 1 AS p FROM b),
m AS (SELECT doc_id, p, x, len({_words("x")}) AS w, regexp_extract(lower(x), '(?i){_alt(L.EARLY_CLOSE)}', 0) AS hit FROM l),
f AS (SELECT doc_id, p, w AS total, 0 AS first, hit, w >= 900 OR w >= 1100 OR (w >= 250 AND w < 1100 AND hit <> '') AS closes FROM m WHERE p = 0
  UNION ALL SELECT m.doc_id, m.p, CASE WHEN f.closes THEN 0 ELSE f.total END + m.w, CASE WHEN f.closes THEN m.p ELSE f.first END, m.hit,
    CASE WHEN f.closes THEN 0 ELSE f.total END + m.w >= 900 OR (CASE WHEN f.closes THEN 0 ELSE f.total END + m.w >= 250 AND CASE WHEN f.closes THEN 0 ELSE f.total END + m.w < 1100 AND m.hit <> '')
  FROM f JOIN m ON m.doc_id = f.doc_id AND m.p = f.p + 1),
d AS (SELECT doc_id, first, p AS last, total, total < 1100 AND total >= 250 AND hit <> '' AS early, hit, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM f WHERE closes),
z AS (SELECT f.doc_id, f.first, f.p AS last, f.total FROM f JOIN (SELECT doc_id, max(p) AS p FROM m GROUP BY doc_id) e ON e.doc_id = f.doc_id AND e.p = f.p WHERE NOT closes),
c AS (SELECT d.doc_id, d.k - 1 AS index, d.first, CASE WHEN k = n AND z.total < 250 THEN z.last ELSE d.last END AS last, d.total + CASE WHEN k = n AND z.total < 250 THEN z.total ELSE 0 END AS words,
    d.early AND NOT (k = n AND coalesce(z.total < 250, false)) AS early, CASE WHEN d.early AND NOT (k = n AND coalesce(z.total < 250, false)) THEN d.hit END AS reason FROM d LEFT JOIN z ON z.doc_id = d.doc_id
  UNION ALL SELECT z.doc_id, coalesce(n.n, 0), z.first, z.last, z.total, false, NULL FROM z LEFT JOIN (SELECT DISTINCT doc_id, n FROM d) n ON n.doc_id = z.doc_id WHERE z.total >= 250 OR n.n IS NULL),
ch AS (SELECT c.doc_id, CAST(c.index AS INTEGER) AS index, CAST(words AS INTEGER) AS word_count, CAST(last - first + 1 AS INTEGER) AS paragraph_count, CAST(first AS INTEGER) AS start_paragraph, CAST(last AS INTEGER) AS end_paragraph, early AS closed_early, reason AS early_close_reason,
  md5(array_to_string(ps[first + 1:last + 1], chr(10) || chr(10))) AS text_md5 FROM c JOIN b ON b.doc_id = c.doc_id)"""

_BOUNDS = (("900", "300"), ("1100", "400"), ("250", "60"))


def _passages() -> str:
    chunks, decision = _PARAGRAPHS.replace("FROM documents WHERE text IS NOT NULL", "FROM cl"), _DECISION
    for a, b in _BOUNDS:
        chunks = chunks.replace(f"< {a}", f"< {b}").replace(f">= {a}", f">= {b}")
        decision = decision.replace(f"wc < {a}", f"wc < {b}").replace(f"wc > {a}", f"wc > {b}")
    chunks = chunks.replace("md5(array_to_string(ps[first + 1:last + 1], chr(10) || chr(10))) AS text_md5", "array_to_string(ps[first + 1:last + 1], chr(10) || chr(10)) AS text")
    return f"""WITH cl AS (WITH RECURSIVE {_CLEANED} SELECT doc_id, cleaned AS text FROM cleaned), pc AS (WITH RECURSIVE {chunks} SELECT doc_id, index AS chunk_index, text, word_count AS wc FROM ch),
c AS (SELECT * FROM pc WHERE {decision} = 'PASS'), {_GATE}, {_AXES}, {_elite_ctes(15, 80, 50)},
adj AS (SELECT *, total + CASE WHEN len(lab) >= 2 THEN 25 ELSE 0 END AS adjusted FROM chosen WHERE len(lab) > 0), placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY adjusted DESC, chunk_index) AS place FROM adj)
SELECT placed.doc_id, placed.chunk_index AS index, wc AS word_count, total, CAST(adjusted AS INTEGER) AS adjusted_total, array_to_string(lab, ',') AS axes FROM placed JOIN pc ON pc.doc_id = placed.doc_id AND pc.chunk_index = placed.chunk_index WHERE place <= 35"""


def oracle_sql() -> dict[str, str]:
    lines = "string_split(raw_text, chr(10))"
    end = f"TIMESTAMP '{P.EVENTS_END}'"
    return {
        "clean_encoding_whitespace": _docs_md5(_COLLAPSED),
        "drop_page_number_lines": f"SELECT doc_id, md5(array_to_string(list_filter({lines}, lambda x: NOT regexp_matches(x, '(?i)^(?:{_alt(L.PAGE_NUMBER_LINES)})$')), chr(10))) AS cleaned_md5 FROM (SELECT DISTINCT ON (doc_id) * FROM extraction_results)",
        "drop_repeated_lines": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS p, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, lower({_strip("x")}) AS k FROM l),
o AS (SELECT doc_id, k FROM m WHERE length(k) > 3 AND length(k) < 100 AND len({_words("k")}) < 10 AND n >= 20 GROUP BY doc_id, k HAVING count(*) >= 2),
j AS (SELECT m.doc_id, m.x, m.p, o.k IS NULL AS keep FROM m LEFT JOIN o ON m.doc_id = o.doc_id AND m.k = o.k)
SELECT doc_id, md5(coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (WHERE keep), '')) AS cleaned_md5 FROM j GROUP BY doc_id""",
        "back_matter_truncate": f"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, list_filter(range(0, len(ls)), lambda i: i >= floor(len(ls) * CAST(0.85 AS DOUBLE)) AND regexp_matches(lower({_strip("ls[i + 1]")}), '^(?:{_alt(L.BACK_MATTER)})$')) AS hits FROM l)
SELECT doc_id, md5(CASE WHEN len(ls) < 20 OR len(hits) = 0 THEN text ELSE array_to_string(ls[1:hits[1]], chr(10)) END) AS cleaned_md5 FROM m""",
        "acknowledgments_cut": f"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, list_filter(range(0, len(ls)), lambda i: i < floor(len(ls) * CAST(0.15 AS DOUBLE)) AND regexp_matches(lower({_strip("ls[i + 1]")}), '^(?:{_alt(L.ACKNOWLEDGMENTS)})$'))[1] AS s FROM l),
n AS (SELECT *, list_filter(range(0, len(ls)), lambda i: i > s AND i < least(s + 50, len(ls)) AND regexp_matches(lower({_strip("ls[i + 1]")}), '{_alt(L.FRONT_CHAPTERS)}'))[1] AS e FROM m)
SELECT doc_id, md5(CASE WHEN len(ls) < 30 OR s IS NULL THEN text ELSE array_to_string(list_concat(ls[1:s], ls[coalesce(e, s + 1) + 1:]), chr(10)) END) AS cleaned_md5 FROM n""",
        "cleaning_pipeline": f"""WITH RECURSIVE {_CLEANED}, r AS (SELECT *, CASE WHEN length(s0) > 0 THEN (length(s0) - length(cleaned)) / CAST(length(s0) AS DOUBLE) ELSE 0 END AS share, length(cleaned) / CAST(greatest(pages, 1) AS DOUBLE) AS per FROM cleaned)
SELECT doc_id, CAST(length(cleaned) AS INTEGER) AS chars, CAST(greatest(numbers, 0) AS INTEGER) AS page_number_chars, round(share, 6) AS removed_share,
  round(least(1.0, greatest(0.0, 1.0 - CASE WHEN share > CAST(0.3 AS DOUBLE) THEN CAST(0.3 AS DOUBLE) WHEN share > CAST(0.2 AS DOUBLE) THEN CAST(0.15 AS DOUBLE) WHEN share > CAST(0.1 AS DOUBLE) THEN CAST(0.05 AS DOUBLE) ELSE 0 END
    - CASE WHEN per < 100 THEN CAST(0.4 AS DOUBLE) WHEN per < 500 THEN CAST(0.2 AS DOUBLE) ELSE 0 END - CAST(0.02 AS DOUBLE) * len(warnings))), 6) AS clean_confidence FROM r""",
        "passage_pipeline": _passages(),
        "contents_fold": f"WITH RECURSIVE {_CONTENTS} SELECT doc_id, md5(coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (WHERE keep), '')) AS cleaned_md5 FROM f GROUP BY doc_id",
        "chunk_paragraph_fold": f"WITH RECURSIVE {_PARAGRAPHS} SELECT * FROM ch",
        "chunk_stats": f"WITH RECURSIVE {_PARAGRAPHS} SELECT doc_id, count(*) AS chunks, CAST(sum(word_count) AS BIGINT) AS words, CAST(sum(paragraph_count) AS BIGINT) AS paragraphs, avg(word_count) AS avg_words, count(*) FILTER (WHERE closed_early) AS early FROM ch GROUP BY doc_id",
        "piece_texts": f"""WITH {_PIECES}, t AS (SELECT id, coalesce(CASE kind WHEN 'REEL' THEN h || ' ' || concat_ws(' ', c, e) || ' ' || i WHEN 'CAROUSEL' THEN concat_ws(' ', c, nullif(e, ''), h, nullif(i, '')) WHEN 'QUOTE' THEN q || ' ' END, '') AS full_,
  coalesce(CASE kind WHEN 'REEL' THEN h WHEN 'CAROUSEL' THEN c WHEN 'QUOTE' THEN string_split(q, '.')[1] END, '') AS first,
  coalesce(CASE kind WHEN 'REEL' THEN i WHEN 'CAROUSEL' THEN CASE WHEN i <> '' THEN i ELSE h END WHEN 'QUOTE' THEN {_strip("string_split(q, '.')[-1]")} END, '') AS last FROM p)
SELECT id, md5(full_) AS full_md5, first, last, CASE {' '.join("WHEN contains(lower(last), '" + x.replace("'", "''") + "') THEN '" + x.replace("'", "''") + "'" for x in L.SUMMARY_ENDINGS)} END AS ending FROM t""",
        "piece_bodies": f"""WITH {_PIECES} SELECT id, md5(coalesce(CASE kind WHEN 'REEL' THEN concat_ws(chr(10) || chr(10), '> "' || h || '"', array_to_string(list_filter(['1. "' || c || '"', '2. "' || e || '"'], lambda x: x IS NOT NULL), chr(10)), '> "' || i || '"')
  WHEN 'CAROUSEL' THEN array_to_string(list_filter(['### 1 (cover)' || chr(10) || chr(10) || '> **' || c || '**' || CASE WHEN e <> '' THEN chr(10) || chr(10) || '> ' || e ELSE '' END,
    '### 2' || chr(10) || chr(10) || '> **' || h || '**' || CASE WHEN i <> '' THEN chr(10) || chr(10) || '> ' || i ELSE '' END], lambda x: x IS NOT NULL), chr(10) || chr(10)) WHEN 'QUOTE' THEN '> ' || q END, '')) AS body_md5 FROM p""",
        "score_gate": f"""WITH {_RATED} SELECT l_orderkey, l_linenumber, CASE WHEN bad = '' THEN round(({' + '.join(n for n, _ in P.CRITERIA)}) / 7, 6) END AS mean, CASE WHEN bad = '' THEN ok END AS passed_all,
  CASE WHEN bad = '' THEN array_to_string(why, ', ') END AS attention, CASE WHEN bad <> '' THEN 'out of range: ' || bad END AS error FROM g""",
        "brief_documents": f"""WITH {_RATED}, t AS (SELECT *, CASE WHEN bad <> '' THEN 'REJECTED' WHEN ok THEN 'APPROVED' ELSE 'FLAGGED' END AS status FROM g)
SELECT l_orderkey, l_linenumber, status, md5('# ORDER #' || l_orderkey || chr(10) || chr(10) || '**Status:** ' || CASE status WHEN 'APPROVED' THEN 'approved' WHEN 'FLAGGED' THEN 'to review' ELSE 'rejected' END
  || CASE WHEN status = 'FLAGGED' AND len(why) > 0 THEN chr(10) || chr(10) || array_to_string(list_transform(why, lambda x: '> - ' || x), chr(10)) ELSE '' END || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || '| criterion | score | |' || chr(10) || '|-|-|-|' || chr(10) || {" || chr(10) || ".join(f"'| {n} | ' || {n} || '/10 | ' || CASE WHEN {n} >= {m} THEN 'ok' ELSE 'low' END || ' |'" for n, m in P.CRITERIA)}
  || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '- order: `' || l_orderkey || '`' || chr(10) || '- line: `' || l_linenumber || '`') AS doc_md5 FROM t""",
        "slot_candidates": f"WITH {_CANDIDATES} SELECT slot, angle, fallback, count(*) AS items, max(CASE WHEN virality = 0 THEN CAST(0 AS DOUBLE) ELSE virality END) AS best FROM cand GROUP BY ALL",
        "fallback_angles": f"WITH angles AS (SELECT * FROM (VALUES {_values(P.ANGLES)}) t(angle, active, pillars, formats, levels, multiplier) WHERE active) SELECT format, angle, multiplier, CAST(k AS INTEGER) AS rank FROM (SELECT f AS format, angle, multiplier, row_number() OVER (PARTITION BY f ORDER BY multiplier DESC, angle) AS k FROM (SELECT angle, multiplier, unnest(formats) AS f FROM angles)) WHERE k <= 2",
        "weekly_assignment": f"""WITH RECURSIVE {_CANDIDATES}, sc AS (SELECT slot, item, angle, round(virality * multiplier, 6) AS score FROM cand WHERE virality IS NOT NULL),
one AS (SELECT slot, item, score, angle FROM (SELECT *, row_number() OVER (PARTITION BY slot, item ORDER BY score DESC, angle) AS k FROM sc) WHERE k = 1),
walk AS (SELECT 0 AS slot, CAST(NULL AS VARCHAR) AS item, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS angle, CAST([] AS VARCHAR[]) AS gone
  UNION ALL SELECT slot, item, score, angle, gone FROM (SELECT o.slot, o.item, o.score, o.angle, list_append(w.gone, o.item) AS gone, row_number() OVER (PARTITION BY o.slot ORDER BY o.score DESC, o.item) AS k
    FROM walk w JOIN one o ON o.slot = w.slot + 1 AND NOT list_contains(w.gone, o.item)) WHERE k = 1)
SELECT CAST(slot AS INTEGER) AS slot, item, score, angle FROM walk WHERE slot > 0""",
        "diversity_report": "WITH " + _WEEK.format(28) + """, s AS (SELECT rows / (SELECT sum(rows) FROM w) AS p FROM w), j AS (SELECT g.event_type, coalesce(rows, 0) AS rows FROM (SELECT DISTINCT event_type FROM events) g LEFT JOIN w ON w.event_type = g.event_type)
SELECT round(-sum(p * log2(p)) / log2(8), 9) AS evenness, (SELECT coalesce(string_agg(event_type, ',' ORDER BY event_type), '') FROM j WHERE rows < (SELECT sum(rows) / count(*) FROM j) * CAST(0.8 AS DOUBLE)) AS underused,
  (SELECT coalesce(string_agg(event_type, ',' ORDER BY event_type), '') FROM w WHERE CAST(rows AS DOUBLE) / (SELECT sum(rows) FROM w) > CAST(0.2 AS DOUBLE)) AS saturated FROM s""",
        "utilisation": "WITH " + _WEEK.format(28) + " SELECT round(sum(rows * CASE event_type " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in P.RATES.items()) + " ELSE 0 END) / sum(rows), 9) AS utilisation FROM w",
        "run_counters": "SELECT count(*) AS processed, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS late FROM orders",
        "seeding_summary": f"WITH {_INGEST} SELECT source_type, count(*) AS processed, count(*) FILTER (WHERE status = 'PASSED') AS success, count(*) FILTER (WHERE status = 'ERROR') AS failed, count(*) FILTER (WHERE status = 'PENDING') AS skipped FROM i GROUP BY source_type",
        "unfilled_orders_of_week": f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {_WEEK_20} AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')",
        "week_present": f"SELECT '1997-20' AS week, EXISTS (SELECT 1 FROM orders WHERE {_WEEK_20}) AS present UNION ALL SELECT '2031-20', false",
        "first_of_week": f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_WEEK_20} AND o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 21",
        "sources_by_title_and_author": f"WITH {_RESERVOIR} SELECT id, raw_title, lower(source_author) AS author FROM r WHERE pillar IN ('PRODUCTIVITY', 'PHILOSOPHY') AND status = 'QUEUED' AND lower(source_author) LIKE 'a%'",
        "rows_of_latest_batch": f"WITH {_INGEST} SELECT id, batch_id FROM i WHERE batch_id = (SELECT max(batch_id) FROM i)",
        "point_lookups": "SELECT wanted, o_orderstatus, o_orderkey IS NOT NULL AS found FROM (SELECT DISTINCT l_orderkey * 2 AS wanted FROM lineitem) LEFT JOIN orders ON o_orderkey = wanted",
        "template_by_day": f"SELECT slot, pillar, format, CASE pillar WHEN 'PRODUCTIVITY' THEN 'wanted' ELSE 'other' END AS part FROM (VALUES {_values(P.SLOTS)}) t(slot, pillar, format)",
        "lookback_filter": f"WITH {_INGEST} SELECT id FROM i WHERE to_timestamp(floor(epoch(ingested_at))) >= TIMESTAMPTZ '{P.AS_OF}+00' - INTERVAL 60 DAY",
        "scaled_quota_sample": f"""WITH {_RESERVOIR}, k AS (SELECT source_type, id, row_number() OVER (PARTITION BY source_type ORDER BY md5(id), id) AS rank FROM r WHERE status = 'AVAILABLE')
SELECT source_type, id, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= CASE source_type WHEN 'YOUTUBE' THEN 2 WHEN 'BLOG' THEN 3 WHEN 'BOOK' THEN 1 ELSE 0 END""",
        "random_sample_hash": f"WITH {_RESERVOIR} SELECT id, source_type FROM r WHERE status = 'AVAILABLE' ORDER BY md5(id), id LIMIT 40",
        "video_keys": f"WITH {_INGEST}, v AS (SELECT id, source_url, coalesce({', '.join(f"nullif(regexp_extract(source_url, '{p.replace(chr(39), chr(39) * 2)}', 1), '')" for p in L.VIDEO_URLS)}) AS v FROM i WHERE source_url IS NOT NULL) SELECT id, CASE WHEN v IS NOT NULL THEN left(md5('youtube:' || v), 16) ELSE {_URL_KEY} END AS key FROM v",
        "body_previews": _docs_md5(r"""CASE WHEN regexp_extract(text, '(?m)^> "([^"]+)"', 1) <> '' THEN regexp_extract(text, '(?m)^> "([^"]+)"', 1) ELSE left(trim(regexp_replace(text, '[*_#>`]', '', 'g'), ' '), 150) END""").replace("cleaned_md5", "preview_md5"),
        "page_blocks_in_order": """WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 + 1 AS page_num, CAST(l_quantity AS DOUBLE) AS x0, CAST(l_suppkey * 7 % 800 AS DOUBLE) AS y0, CAST(l_quantity AS DOUBLE) + l_partkey % 600 AS x1, l_linenumber % 5 = 0 AS image, l_returnflag || '-' || l_linenumber AS text FROM lineitem)
SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY page_num, CASE WHEN (x1 - x0) / 600 > CAST(0.7 AS DOUBLE) THEN 0 ELSE 1 END, y0, x0, text)) AS text_md5 FROM b WHERE NOT image AND y0 / 800 <= CAST(0.92 AS DOUBLE) GROUP BY doc_id""",
        "block_files": f"""WITH t AS (SELECT 'https://' || source || '/' || doc_id AS url, {_strip(_ARTICLE.replace("(text,", "(chr(10) || text,"))} AS content FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)
SELECT url, md5(content) AS content_md5 FROM t WHERE len({_words("content")}) >= 50""",
        "archive_round_trip": "SELECT doc_id, 'https://' || source AS url, trim(title) AS title, trim(author) AS author_id, true AS valid FROM documents WHERE text IS NOT NULL AND title IS NOT NULL AND author IS NOT NULL AND source IS NOT NULL",
        "retry_hints": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey % 50 AS DOUBLE) + 1.0 WHEN 1 THEN CAST(o_orderkey % 900 AS DOUBLE) / 1000 + 0.5 END AS wait FROM orders",
        "enriched_stub": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, CASE WHEN wc <= 2000 THEN CAST(wc % 5 + 1 AS INTEGER) END AS level, wc > 2000 AS failed FROM c",
        "article_clean": _docs_md5(_strip(_ARTICLE)),
        "transcript_clean": f"WITH {_RESERVOIR} SELECT id, md5({_strip(_TRANSCRIPT)}) AS cleaned_md5 FROM r WHERE raw_text IS NOT NULL",
        "chunk_overlap_windows": f"""
WITH w AS (SELECT doc_id, text, title, {_words("text")} AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, CASE WHEN len(ws) <= 400 THEN [0] ELSE range(0, greatest(len(ws) - 51, 0) + 1, 350) END AS ss FROM w),
e AS (SELECT doc_id, text, title, ws, len(ss) AS parts, unnest(ss) AS pos, generate_subscripts(ss, 1) - 1 AS part FROM s)
SELECT doc_id, CAST(part AS BIGINT) AS part, CAST(parts AS BIGINT) AS parts, md5(CASE WHEN len(ws) <= 400 THEN text ELSE array_to_string(ws[pos + 1:pos + 400], ' ') END) AS chunk_md5,
  CASE WHEN parts > 1 THEN coalesce(title, 'null') || ' (Part ' || (part + 1) || '/' || parts || ')' ELSE title END AS chunk_title FROM e""",
        "signal_families": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, array_to_string({_SIGNALS}, ',') AS signals FROM c",
        "rule_filter_decision": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, {_DECISION} AS decision FROM c",
        "drop_reason_histogram": f"WITH {_CHUNKS} SELECT {_DECISION} AS decision, count(*) AS chunks FROM c GROUP BY 1",
        "quotation_shares": f"SELECT doc_id, round(CAST({_QUOTED} AS DOUBLE), 9) AS quoted FROM documents WHERE text IS NOT NULL",
        "opening_gate": f"WITH {_CHUNKS}, {_GATE} SELECT doc_id, chunk_index, passes FROM gate",
        "axis_scores": f"WITH {_CHUNKS}, {_GATE}, {_AXES} SELECT * FROM axes",
        "elite_selection": _ELITE + " SELECT doc_id, chunk_index, total, CAST(total + CASE WHEN len(lab) >= 2 THEN 25 ELSE 0 END AS INTEGER) AS adjusted_total, array_to_string(lab, ',') AS axes FROM chosen WHERE len(lab) > 0",
        "elite_defaults": f"""WITH {_CHUNKS}, {_GATE}, {_AXES.replace("axes AS (SELECT doc_id, chunk_index,", "axes AS (SELECT left(doc_id, 1) AS doc_id, doc_id || '-' || lpad(CAST(chunk_index AS VARCHAR), 9, '0') AS chunk_index,")}, {_elite_ctes(15, 80, 50, AXES)},
adj AS (SELECT *, total + CASE WHEN len(lab) >= 2 THEN 25 ELSE 0 END AS adjusted FROM chosen WHERE len(lab) > 0), placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY adjusted DESC, chunk_index) AS place FROM adj)
SELECT doc_id AS shelf, chunk_index AS place, total, CAST(adjusted AS INTEGER) AS adjusted_total, array_to_string(lab, ',') AS axes FROM placed WHERE place <= 35""",
        "elite_stats": _ELITE + """, ga AS (SELECT doc_id, count(*) FILTER (WHERE NOT passes) AS lost_at_gate, count(*) FILTER (WHERE passes) AS passed FROM gate GROUP BY doc_id),
ch AS (SELECT doc_id, count(*) AS chosen FROM chosen WHERE len(lab) > 0 GROUP BY doc_id)
SELECT ga.doc_id, lost_at_gate, passed - coalesce(chosen, 0) AS lost_in_ranking, coalesce(chosen, 0) AS chosen, coalesce(chosen, 0) < 2 AS low_yield FROM ga LEFT JOIN ch USING (doc_id)""",
        "novelty_scores": """
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings),
p AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u),
q AS (SELECT label, i, avg(x) AS m FROM p GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS m FROM q GROUP BY label),
s AS (SELECT vec_id, u.label, list_inner_product(v, m) / sqrt(list_inner_product(m, m)) AS cosine FROM u JOIN c ON u.label = c.label)
SELECT vec_id, label, round(cosine, 6) AS cosine, CAST(trunc(greatest(0.0, least(100.0, 20.0 + (1.0 - cosine) * 100))) AS INTEGER) AS novelty FROM s""",
        "dedup_first_wins": f"WITH {_INGEST} SELECT id FROM i WHERE raw_content IS NULL UNION ALL SELECT min(id) AS id FROM i WHERE raw_content IS NOT NULL GROUP BY md5(raw_content)",
        "admission_two_keys": f"""WITH RECURSIVE {_INGEST}, o AS (SELECT id, md5(raw_content) AS c, nullif(source_identifier, '') AS s, row_number() OVER (ORDER BY id) AS n FROM i WHERE raw_content IS NOT NULL),
w AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS id, false AS taken, CAST([] AS VARCHAR[]) AS cs, CAST([] AS VARCHAR[]) AS ss
  UNION ALL SELECT n, id, fresh, CASE WHEN fresh THEN list_append(cs, c) ELSE cs END, CASE WHEN fresh AND s IS NOT NULL THEN list_append(ss, s) ELSE ss END
  FROM (SELECT o.n, o.id, c, s, cs, ss, NOT list_contains(cs, c) AND NOT coalesce(list_contains(ss, s), false) AS fresh FROM w JOIN o ON o.n = w.n + 1))
SELECT id FROM w WHERE taken""",
        "admission_against_history": f"""WITH {_INGEST}, k AS (SELECT id, status, md5(raw_content) AS c, {_URL_KEY} AS u FROM i)
SELECT id FROM k WHERE status = 'PENDING' AND NOT EXISTS (SELECT 1 FROM k h WHERE h.status <> 'PENDING' AND h.c = k.c) AND NOT EXISTS (SELECT 1 FROM k h WHERE h.status <> 'PENDING' AND h.u = k.u)""",
        "reservoir_transfer": f"WITH {_RESERVOIR} SELECT id, concat_ws(':', 'reservoir', source_id, CAST(chunk_index AS VARCHAR)) AS source_identifier, 'PENDING' AS status, times_used + 1 AS times_used FROM r WHERE source_type IN ('BOOK', 'BLOG', 'YOUTUBE')",
        "validation_reasons": f"WITH {_INGEST} SELECT id, array_to_string({_REASONS.format(', CASE WHEN source_url IS NULL OR source_url = %s THEN %s END' % (chr(39) * 2, chr(39) + 'no_address' + chr(39)))}, ',') AS reasons FROM i",
        "rejection_records": f"WITH {_INGEST}, w AS (SELECT id, {_REASONS.format('')} AS why FROM i) SELECT id, 'VALIDATION' AS phase, CAST(to_json(why) AS VARCHAR) AS reasons FROM w WHERE len(why) > 0",
        "next_chunk_index": f"""WITH {_RESERVOIR}, t AS (SELECT source_id, max(chunk_index) AS top FROM r WHERE status <> 'AVAILABLE' GROUP BY source_id)
SELECT id, r.source_id, CAST(coalesce(top, -1) + row_number() OVER (PARTITION BY r.source_id ORDER BY id) AS INTEGER) AS next_index FROM r LEFT JOIN t ON r.source_id = t.source_id WHERE status = 'AVAILABLE'""",
        "slug_collisions": """WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(author), '[''’`]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s0 FROM documents WHERE text IS NOT NULL AND author IS NOT NULL),
t AS (SELECT doc_id, CASE WHEN s0 = '' THEN 'unknown' ELSE s0 END AS s FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS k FROM t)
SELECT doc_id, CASE WHEN k = 0 THEN s ELSE s || '_' || k END AS unique_slug FROM n""",
        "import_routing": f"""WITH {_INGEST}, k AS (SELECT id, {_URL_KEY} AS key, source_type AS author, raw_title AS title, status FROM i),
n AS (SELECT *, key IS NULL OR title IS NULL AS bad FROM k WHERE status = 'PENDING'), m AS (SELECT *, row_number() OVER (PARTITION BY bad, key ORDER BY id) AS again FROM n)
SELECT id, CASE WHEN bad THEN 'parse_error' WHEN again > 1 OR key IN (SELECT key FROM k WHERE status = 'PASSED' AND key IS NOT NULL) THEN 'duplicate'
  WHEN author NOT IN ('BLOG', 'REDDIT', 'YOUTUBE') THEN 'unknown_author' WHEN title IN (SELECT title FROM k WHERE status = 'PASSED' AND title IS NOT NULL) THEN 'title_known' ELSE 'inserted' END AS outcome FROM m""",
        "url_dedup_key": f"WITH {_INGEST} SELECT id, {_URL_KEY} AS key FROM i WHERE source_url IS NOT NULL",
        "url_untracked": f"WITH {_INGEST}, k AS (SELECT id, status, {_URL_KEY} AS key FROM i WHERE source_url IS NOT NULL) SELECT id, key FROM k WHERE status = 'PENDING' AND key NOT IN (SELECT key FROM k WHERE status = 'PASSED')",
        "url_titles": rf"""WITH {_INGEST}, p AS (SELECT id, {_HOST} AS host, string_split(regexp_replace(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/')[-1] AS seg FROM i WHERE source_url LIKE 'http%'),
q AS (SELECT id, host, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(seg, '\.(html?|php|aspx?)$', ''), '[-_]', ' ', 'g'), '\d{{4}}[-/]\d{{2}}[-/]\d{{2}}[-/]?', '', 'g'), '\s+', ' ', 'g')) AS t FROM p)
SELECT id, host, CASE WHEN t = '' THEN 'Untitled' ELSE array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS title FROM q""",
        "url_pattern_match": f"WITH {_INGEST} SELECT id, CASE " + " ".join(f"WHEN contains(lower(source_url), '{p}') THEN '{v}'" for p, v in P.URL_PATTERNS) + " END AS owner FROM i WHERE source_url IS NOT NULL",
        "pending_newest_first": f"WITH {_INGEST} SELECT id, source_type FROM i WHERE status = 'PENDING' ORDER BY ingested_at DESC NULLS LAST, id LIMIT 50",
        "pending_oldest_first": f"WITH {_INGEST} SELECT id, source_type FROM i WHERE status = 'PENDING' ORDER BY ingested_at NULLS FIRST, id LIMIT 100",
        "batch_sizes": f"WITH {_INGEST} SELECT batch_id, count(*) AS rows, count(*) FILTER (WHERE status = 'PASSED') AS passed FROM i GROUP BY batch_id",
        "json_path_filter": f"WITH {_INGEST}, w AS (SELECT id, CAST(json_extract_string(raw_metadata, '$.words') AS INTEGER) AS words FROM i) SELECT id, words FROM w WHERE words >= 200",
        "posts_by_score": f"""WITH {_INGEST}, w AS (SELECT *, coalesce(CAST(json_extract_string(raw_metadata, '$.score') AS INTEGER), 0) AS score FROM i)
SELECT id, score FROM w WHERE source_type = 'REDDIT' AND score >= 10 AND raw_content NOT IN ('[removed]', '[deleted]') AND length(raw_content) >= 300 AND ingested_at >= TIMESTAMPTZ '{P.AS_OF}+00' - INTERVAL 60 DAY""",
        "array_containment": f"WITH {_ATOMS} SELECT DISTINCT id, CASE WHEN virality_score = 0 THEN CAST(0 AS DOUBLE) WHEN isnan(virality_score) THEN NULL ELSE virality_score END AS virality_score FROM a WHERE list_contains(format_fit, 'REEL') AND deleted_at IS NULL",
        "secondary_pillar_containment": f"WITH {_ATOMS} SELECT DISTINCT id FROM a WHERE list_contains(secondary_pillars, 'PHILOSOPHY') AND lifecycle_state = 'ACTIVE'",
        "ingest_to_atoms": f"""WITH {_INGEST}, b AS (SELECT DISTINCT id, raw_ingest_id FROM content_atoms WHERE raw_ingest_id IS NOT NULL)
SELECT source_type, count(*) AS atoms, count(DISTINCT raw_ingest_id) AS sources FROM b JOIN i ON b.raw_ingest_id = i.id GROUP BY source_type""",
        "orders_of_week": f"SELECT o_orderkey, l_linenumber, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE isoyear({_DAY}) = 1997 AND weekofyear({_DAY}) = 20 AND o_orderstatus = 'O'",
        "latest_child": "SELECT o_orderkey, l_linenumber, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate DESC NULLS LAST, l_linenumber) AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F') WHERE k = 1",
        "unused_since_window": f"SELECT DISTINCT user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events u WHERE u.user_id = e.user_id AND u.event_type = 'purchase' AND u.ts BETWEEN {end} - INTERVAL 7 DAY AND {end})",
        "unused_pairs": f"SELECT DISTINCT user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events u WHERE u.user_id = e.user_id AND u.event_type = e.event_type AND u.ts BETWEEN {end} - INTERVAL 10 DAY AND {end})",
        "rekeyed_regions": "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN '2' ELSE coalesce(r_name, CAST(n_regionkey AS VARCHAR)) END AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
        "titles_known": f"""WITH {_RESERVOIR}, t AS (SELECT id, raw_title, source_author, status FROM r WHERE raw_title IS NOT NULL AND source_author IS NOT NULL)
SELECT id, EXISTS (SELECT 1 FROM t o WHERE o.status <> 'AVAILABLE' AND o.source_author = n.source_author AND starts_with(o.raw_title, regexp_replace(n.raw_title, '\\s*\\(Part \\d+/\\d+\\)$', ''))) AS known FROM t n WHERE status = 'AVAILABLE'""",
        "status_counts": f"WITH {_RESERVOIR} SELECT coalesce(status, 'UNKNOWN') AS value, count(*) AS rows FROM r GROUP BY 1",
        "source_type_counts": f"WITH {_RESERVOIR} SELECT source_type, count(*) AS rows FROM r WHERE status = 'AVAILABLE' GROUP BY 1",
        "window_counts": "WITH " + _WEEK.format(14) + " SELECT * FROM w",
        "diversity_evenness": "WITH " + _WEEK.format(28) + ", s AS (SELECT rows / (SELECT sum(rows) FROM w) AS p FROM w) SELECT round(-sum(p * log2(p)) / log2(8), 9) AS evenness FROM s",
        "saturation_shares": "WITH " + _WEEK.format(28) + ", s AS (SELECT event_type, rows, CAST(rows AS DOUBLE) / sum(rows) OVER () AS share FROM w) SELECT event_type, rows, round(share, 9) AS share, share > 0.21 AS saturated FROM s",
        "underused_groups": f"""WITH g AS (SELECT DISTINCT user_id FROM events), n AS (SELECT user_id, count(*) AS rows FROM events WHERE ts BETWEEN {end} - INTERVAL 3 DAY AND {end} GROUP BY user_id),
j AS (SELECT g.user_id, coalesce(rows, 0) AS rows FROM g LEFT JOIN n ON g.user_id = n.user_id)
SELECT user_id, CAST(rows AS BIGINT) AS rows FROM j WHERE rows < (SELECT sum(rows) / count(*) FROM j) * CAST(0.8 AS DOUBLE) OR (SELECT sum(rows) FROM j) = 0""",
        "grouping_sets_report": f"WITH {_RESERVOIR} SELECT pillar, source_type, count(*) AS rows, CAST(grouping(pillar, source_type) AS BIGINT) AS level FROM r GROUP BY GROUPING SETS ((pillar), (source_type), (pillar, source_type))",
        "week_bounds": f"SELECT CAST(isoyear({_DAY}) AS INTEGER) AS week_year, CAST(weekofyear({_DAY}) AS INTEGER) AS week, min({_DAY}) AS first_day, max({_DAY}) AS last_day, count(*) AS rows FROM orders GROUP BY 1, 2",
        "week_package_stats": f"SELECT {_MONDAY} AS week, count(*) AS rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, round(avg(o_totalprice), 1) AS mean_price FROM orders GROUP BY 1",
        "iso_week_calendar": f"SELECT DISTINCT {_DAY} AS day, CAST(isoyear({_DAY}) AS INTEGER) AS week_year, CAST(weekofyear({_DAY}) AS INTEGER) AS week, {_MONDAY} AS monday, strftime({_DAY}, '%b %d, %Y') AS label FROM orders",
        "top_per_group": "SELECT p_brand, p_partkey, p_retailprice, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 5",
        "two_tier_candidates": """WITH a AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_size = 1),
a30 AS (SELECT * FROM a WHERE k <= 30), n AS (SELECT p_brand, count(*) AS n FROM a30 GROUP BY p_brand),
b AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_size = 2)
SELECT p_brand, p_partkey, 1 AS tier FROM a30 UNION ALL SELECT b.p_brand, p_partkey, 2 AS tier FROM b LEFT JOIN n ON b.p_brand = n.p_brand WHERE k <= 30 AND coalesce(n, 0) < 10 AND k <= 30 - coalesce(n, 0)""",
        "quota_sample_hash": f"""WITH {_RESERVOIR}, k AS (SELECT source_type, id, row_number() OVER (PARTITION BY source_type ORDER BY md5(id), id) AS rank FROM r WHERE status = 'AVAILABLE')
SELECT source_type, id, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= CASE source_type WHEN 'YOUTUBE' THEN 10 WHEN 'BLOG' THEN 13 WHEN 'BOOK' THEN 2 ELSE 0 END""",
        "ratio_allocation": f"""WITH {_INGEST}, k AS (SELECT id, source_type, ingested_at, row_number() OVER (PARTITION BY source_type ORDER BY ingested_at NULLS FIRST, id) AS rank FROM i WHERE status = 'PENDING'),
o AS (SELECT *, rank <= CASE source_type WHEN 'REDDIT' THEN 20 WHEN 'BLOG' THEN 12 WHEN 'BOOK' THEN 8 ELSE 0 END AS own FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY ingested_at NULLS FIRST, id) AS n FROM o)
SELECT id, source_type, false AS backfill FROM o WHERE own UNION ALL SELECT id, source_type, true AS backfill FROM f WHERE NOT own AND n <= 40 - (SELECT count(*) FROM o WHERE own)""",
        "arg_max_scores": "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice * (1 - l_discount) DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1",
        "pillars_union_all": f"WITH {_RESERVOIR}, u AS (SELECT pillar FROM r UNION ALL SELECT pillar FROM documents) SELECT pillar, count(*) AS rows FROM u WHERE pillar IS NOT NULL GROUP BY pillar",
        "shared_authors": "SELECT source_author AS author FROM content_reservoir INTERSECT SELECT author FROM extraction_results",
        "hosts_only_in_documents": f"SELECT DISTINCT source AS host FROM documents WHERE source IS NOT NULL EXCEPT SELECT {_HOST} AS host FROM raw_ingest WHERE source_url IS NOT NULL",
        "token_overlap": "WITH a AS (SELECT DISTINCT ON (id) id, format_fit FROM content_atoms) SELECT id, CAST(len(list_intersect(format_fit, ['REEL', 'QUOTE'])) AS INTEGER) AS shared, CAST(len(list_filter(list_distinct(format_fit), lambda x: x <> 'REEL')) AS INTEGER) AS others FROM a",
        "merged_dimension": "WITH s AS (SELECT DISTINCT CAST(s_nationkey AS INTEGER) AS key FROM supplier WHERE s_nationkey < 12) SELECT key, 'supplier' AS origin FROM s UNION ALL SELECT DISTINCT CAST(c_nationkey AS INTEGER), 'customer' FROM customer WHERE c_nationkey NOT IN (SELECT key FROM s)",
        "record_projection": f"""WITH {_INGEST} SELECT id, md5(CASE WHEN coalesce(raw_content, '') = '' THEN raw_title ELSE concat_ws(chr(10) || chr(10), raw_title, raw_content) END) AS body_md5, concat_ws(':', source_type, source_identifier) AS source_key FROM i""",
        "lookup_with_default": f"WITH {_RESERVOIR} SELECT id, CASE pillar WHEN 'PRODUCTIVITY' THEN 'URGENT' WHEN 'RELATIONSHIPS' THEN 'WARM' WHEN 'PHILOSOPHY' THEN 'CALM' ELSE 'CURIOUS' END AS tone FROM r",
        "harvest_status": f"""WITH {_INGEST}, b AS (SELECT source_type, count(*) FILTER (WHERE status = 'ERROR') AS errors, count(*) FILTER (WHERE status <> 'ERROR') AS stored FROM i GROUP BY source_type)
SELECT *, CASE WHEN errors > 0 AND stored = 0 THEN 'failed' WHEN errors > 0 THEN 'partial' ELSE 'success' END AS outcome FROM b""",
        "import_progress": f"""WITH {_RESERVOIR}, b AS (SELECT source_author, count(*) AS chunks, count(DISTINCT source_id) AS sources FROM r WHERE source_author IS NOT NULL GROUP BY source_author)
SELECT *, CAST(round(chunks * 100.0 / 40, 1) AS DOUBLE) AS percent, CASE WHEN chunks >= 40 THEN 'done' WHEN chunks >= 10 THEN 'active' ELSE 'remaining' END AS bucket FROM b""",
        "first_and_last_lines": f"""WITH {_CHUNKS}, p AS (SELECT doc_id, chunk_index, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM c)
SELECT doc_id, chunk_index, md5(ls[1]) AS first_md5, md5(ls[-1]) AS last_md5, CAST(len(ls) AS INTEGER) AS lines FROM p""",
        "nested_projection": """WITH a AS (SELECT DISTINCT ON (id) id, classification AS k FROM content_atoms)
SELECT id, CAST(len(k.emotional_triggers) AS INTEGER) AS triggers, '{' || array_to_string(list_filter([CASE WHEN k.proof_type IS NOT NULL THEN '"proof":' || to_json(k.proof_type) END, CASE WHEN k.hook_mechanism IS NOT NULL THEN '"hook":' || to_json(k.hook_mechanism) END], lambda x: x IS NOT NULL), ',') || '}' AS packed FROM a""",
        "latest_by_version": "SELECT id, max(updated_at) AS updated_at FROM content_atoms GROUP BY id",
        "rendered_lists": """WITH a AS (SELECT DISTINCT ON (id) id, format_fit, secondary_pillars FROM content_atoms)
SELECT id, array_to_string(list_transform(format_fit, lambda x, i: i || '. ' || x), chr(10)) AS numbered,
  CASE WHEN len(secondary_pillars) > 0 THEN array_to_string(list_transform(secondary_pillars, lambda x: '- ' || x), chr(10)) ELSE 'N/A' END AS bullets FROM a""",
        "file_names": f"""SELECT o_orderkey, lpad(CAST(o_orderkey % 21 + 1 AS VARCHAR), 2, '0') || '_' || upper(left(dayname({_DAY}), 3)) || '_' || CASE WHEN o_orderstatus = 'F' THEN 'REEL' ELSE 'CAROUSEL' END || '_' ||
  CASE WHEN o_orderkey % 7 = 0 THEN 'TBD' ELSE CAST(CASE WHEN o_orderkey % 24 % 12 = 0 THEN 12 ELSE o_orderkey % 24 % 12 END AS VARCHAR) || CASE WHEN o_orderkey % 24 < 12 THEN 'AM' ELSE 'PM' END END || '.md' AS name FROM orders""",
        "week_overview": f"SELECT {_MONDAY} AS week, md5(string_agg('- ' || o_orderkey || ' ' || o_orderstatus, chr(10) ORDER BY o_orderkey)) AS body_md5 FROM orders GROUP BY 1",
        "length_failures": f"""WITH {_CHUNKS}, p AS (SELECT doc_id, chunk_index, list_filter(string_split(text, chr(10) || chr(10)), lambda x: x <> '') AS ps FROM c)
SELECT doc_id, chunk_index, array_to_string(list_filter(list_concat(list_transform(ps, lambda x, i: CASE WHEN length(x) > 400 THEN 'part ' || i || ' too long' END),
  [CASE WHEN len(ps) < 4 THEN 'too few parts' END, CASE WHEN len(ps) > 8 THEN 'too many parts' END,
   CASE WHEN coalesce(list_sum(list_transform(ps, lambda x: length(x))), 0) > 2200 THEN 'too long' END,
   CASE WHEN len(list_filter(ps, lambda x: contains(x, ';'))) > 0 THEN 'semicolons' END]), lambda x: x IS NOT NULL), ',') AS failures FROM p""",
    }
