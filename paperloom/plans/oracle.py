"""SQL for DuckDB that gives the rows of ``queries``, written without look-arounds and back-references."""

from __future__ import annotations

from ..dialect import DIGIT, LINE_WS, NOT_WS, WORD, WORD_INNER, WS, WS_INNER
from ..functions.markdown import ABSTRACT_PREFIXES, ABSTRACT_WHOLE, REFERENCE_PREFIXES, REFERENCE_WHOLE
from ..functions.masking import PATTERNS
from ..functions.math import ENVIRONMENTS, SIGNS
from ..operators.results import DUPLICATE_SUGGESTION
from . import fixtures


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, {_q(pattern)}, {_q(by)}, 'g')"


def _strip(c: str) -> str:
    return _re(_re(c, rf"\A{WS}+"), rf"{WS}+\z")


_PM = f"(SELECT doc_id, {fixtures.PAPER_MD} AS md FROM documents)"
_NAME = "regexp_extract({0}, '(?s)([^/]*)/*\\z', 1)"
_HAS_FRONT = "(md LIKE '---%' AND position(chr(10) || '---' || chr(10) IN substr(md, 4)) > 0)"
_FRONT_END = "(position(chr(10) || '---' || chr(10) IN substr(md, 4)) + 7)"
_BODIES = f"(SELECT doc_id, CASE WHEN {_HAS_FRONT} THEN substr(md, 1, {_FRONT_END}) END AS front, CASE WHEN {_HAS_FRONT} THEN substr(md, {_FRONT_END} + 1) ELSE md END AS body FROM {_PM})"


def _stem(c: str) -> str:
    return f"regexp_replace({_NAME.format(c)}, '(?s)^(.+)\\.[^.]+\\z', '\\1')"


def _sanitized(c: str) -> str:
    out = _re(_stem(c), r'[:?/\\*<>|"]')
    out = _re(out, f"[-{WS_INNER}]+", "_")
    out = _re(out, f"[^{WORD_INNER}]")
    return _re(_re(out, r"\A_+|_+\z"), "_+", "_")


_FIRST_LINE = "split_part(text, chr(10), 1)"
_TITLES = f"(SELECT doc_id, {_sanitized(_FIRST_LINE)} AS title FROM documents)"
_MD_TITLE = f"nullif({_strip('regexp_extract(md, ' + _q(rf'(?m)^{WS}*#{{1,3}}{WS}+(.+?){WS}*$') + ', 1)')}, '')"
_CANDIDATE = "CASE doc_id % 7 WHEN 0 THEN '2401.' || lpad(CAST(doc_id % 10000 AS VARCHAR), 5, '0') || 'v2' WHEN 1 THEN '  ' || doc_id || '-1_2 ' WHEN 2 THEN 'Paper ' || doc_id || '.PDF' WHEN 3 THEN 'a/b' || doc_id WHEN 4 THEN '　 ' WHEN 5 THEN doc_id || '.pdf' ELSE substr(text, 1, 20) END"


def _placeholder(c: str) -> str:
    low = _re(f"lower({_strip(c)})", r"\.pdf\z")
    return f"({_strip(c)} = '' OR contains({low}, 'http') OR contains({low}, '/') OR contains({low}, '\\') OR regexp_full_match({low}, '{DIGIT}{{4}}\\.{DIGIT}{{4,5}}(v{DIGIT}+)?') OR regexp_full_match({low}, '[0-9._-]+'))"


_EDGES = ", ".join(f"({_q(u)})" for u in fixtures.EDGE_URLS)
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_PIECE_JOIN = "array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(r[i], '')), '')"
_REF = r"!\[([^\]]*)\]\(([^)]+)\)"
_ENTRIES = "[{'old': 'images/q.png', 'new': './assets/image_001.png'}, {'old': 'p' || (doc_id % 5) || '.png', 'new': './assets/image_002.png'}, {'old': 'figs/p6.png', 'new': './assets/image_003.png'}]"


def _rewrite(second: str) -> str:
    """References rebuilt with the first entry whose ``old`` is the path, else with the first for which ``second`` holds of e.old, o and b (the path's last part)."""
    base = "regexp_extract(o, '([^/]*)/*$', 1)"
    second = second.replace("<base>", base)
    new = f"coalesce(list_filter(entries, lambda e: e.old = o)[1].new, list_filter(entries, lambda e: {second})[1].new)"
    return f"""
    WITH t AS (SELECT doc_id, {_ENTRIES} AS entries, string_split_regex(md, {_q(_REF)}) AS p, regexp_extract_all(md, {_q(_REF)}) AS m, regexp_extract_all(md, {_q(_REF)}, 1) AS a, regexp_extract_all(md, {_q(_REF)}, 2) AS os FROM {_PM}),
    n AS (SELECT *, list_transform(os, lambda o: {new}) AS news FROM t),
    r AS (SELECT doc_id, p, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN news[i] IS NULL THEN m[i] ELSE '![' || a[i] || '](' || news[i] || ')' END) AS r FROM n)
    SELECT doc_id, md5({_PIECE_JOIN}) AS digest FROM r"""


_ENV_ALTERNATIVES = "|".join(rf"\\begin\{{{n}\}}.*?\\end\{{{n}\}}" for n in (x.replace("*", r"\*") for x in ENVIRONMENTS))
_OPEN, _CLOSE = "chr(64976)", "chr(64977)"
_SIGN_CHARS = f"""CASE WHEN contains({_q(SIGNS)}, c[i]) AND NOT (i > 1 AND regexp_matches(c[i - 1], '[$A-Za-z]')) AND NOT (i < len(c) AND regexp_matches(c[i + 1], '[A-Za-z]')) THEN '$' || c[i] || '$' ELSE c[i] END"""
_DELIMITERS = _re(_re("md", r"(?s)\\\((.+?)\\\)", r"$\1$"), r"(?s)\\\[(.+?)\\\]", r"$$\1$$")
_WRAPPED = f"""regexp_replace(regexp_replace(regexp_replace(md, {_q('(?s)(' + _ENV_ALTERNATIVES + ')')}, {_OPEN} || '$$' || chr(10) || '\\1' || chr(10) || '$$' || {_CLOSE}, 'g'),
        '\\$\\$' || {_OPEN} || '\\$\\$' || chr(10) || '([^' || {_CLOSE} || ']*)' || chr(10) || '\\$\\$' || {_CLOSE} || '\\$\\$', '$$\\1$$', 'g'), '[' || {_OPEN} || {_CLOSE} || ']', '', 'g')"""
_SUBSCRIPTS = _re("md", rf"(^|[^{WORD_INNER}])([A-Za-z]){WS}*_{WS}*({WORD}+)", r"\1$\2_\3$")
_NUMBER_FIRST = _re("html", rf"({DIGIT}+){WS}*([≤≥≈≠<>]){WS}*({WORD}+)", r"$\1 \2 \3$")
_NUMBER_LAST = _re("x", rf"({WORD}+){WS}*([≤≥≈≠]){WS}*({DIGIT}+)", r"$\1 \2 \3$")
_RANGES = """(SELECT doc_id, pages, c.chunk_idx, c.chunk_idx * size AS start_page, least((c.chunk_idx + 1) * size, pages) - 1 AS end_page
    FROM (SELECT *, CAST(ceil(pages / greatest(least(4, pages), 1)) AS INT) AS size FROM (SELECT doc_id, CAST(ceil(n_chars / 3000) AS INT) AS pages FROM documents)), (SELECT CAST(range AS INT) AS chunk_idx FROM range(4)) c
    WHERE c.chunk_idx < least(4, pages) AND c.chunk_idx * size <= least((c.chunk_idx + 1) * size, pages) - 1)"""
_DEVICES = """(SELECT *, CAST(row_number() OVER (ORDER BY mem, idx) - 1 AS INT) AS gpu_pos FROM (SELECT CAST(s_suppkey AS INT) AS idx, CAST(floor(abs(s_acctbal)) AS INT) AS mem, s_suppkey % 20 AS util FROM supplier) WHERE mem < 2000 AND util < 10)"""

# headings with # outside fences; the view has neither setext headings nor HTML blocks that hold any
_LINES = f"(SELECT doc_id, body, CAST(i - 1 AS INT) AS ln, ls[i] AS line FROM (SELECT doc_id, body, string_split(body, chr(10)) AS ls FROM {_BODIES}), range(1, len(ls) + 1) t(i))"
_MARKED = f"(SELECT *, sum(CAST(regexp_matches(line, '^ {{0,3}}```') AS INT)) OVER (PARTITION BY doc_id ORDER BY ln) AS fences FROM {_LINES})"
_HEAD_TEXT = _re(_re(_re("line", r"^ {0,3}#{1,6}"), r"(?:^|[ \t])[ \t]*#+[ \t]*$"), r"^[ \t]+|[ \t]+$")
_HEADS = f"(SELECT doc_id, ln, length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})', 1)) AS level, {_HEAD_TEXT} AS heading_text FROM {_MARKED} WHERE fences % 2 = 0 AND regexp_matches(line, '^ {{0,3}}#{{1,6}}(?:[ \\t]|$)'))"
_N_LINES = f"(SELECT doc_id, max(ln) + CASE WHEN any_value(body) LIKE '%' || chr(10) THEN 0 ELSE 1 END AS n FROM {_LINES} GROUP BY doc_id)"
_SECTIONS = f"(SELECT h.doc_id, h.ln, any_value(h.level) AS level, any_value(h.heading_text) AS heading_text, coalesce(min(k.ln), any_value(n.n)) AS section_end FROM {_HEADS} h JOIN {_N_LINES} n ON n.doc_id = h.doc_id LEFT JOIN {_HEADS} k ON k.doc_id = h.doc_id AND k.ln > h.ln AND k.level <= h.level GROUP BY h.doc_id, h.ln)"


def _heading(c: str, fixed: bool) -> str:
    out = _re(f"lower({_strip(c)})", rf"\A{WS}*[\p{{Nd}}.)(]+")
    if fixed:
        out = _strip(out)
    return _re(_re(out, f"{WS}+", " "), rf"(?:[:：]|{WS})+\z")


def _begins(c: str, prefixes: tuple, whole: tuple, fixed: bool = False) -> str:
    h = _heading(c, fixed)
    return f"(regexp_matches({h}, '\\A(?:{'|'.join(prefixes)})(?:[^{WORD_INNER}]|\\z)') OR {h} IN ({', '.join(map(_q, whole))}))"


def _stripped(fixed: bool) -> str:
    """Bodies without lines in a references section; the view's sections don't overlap."""
    gone = f"(SELECT doc_id, ln, section_end FROM {_SECTIONS} WHERE {_begins('heading_text', REFERENCE_PREFIXES, REFERENCE_WHOLE, fixed)})"
    kept = f"(SELECT l.doc_id, l.ln, l.line, g.ln AS gone FROM {_LINES} l JOIN {_N_LINES} n ON n.doc_id = l.doc_id AND l.ln < n.n LEFT JOIN {gone} g ON g.doc_id = l.doc_id AND l.ln >= g.ln AND l.ln < g.section_end)"
    return f"""(SELECT b.doc_id, b.body, CASE WHEN k.any_gone THEN coalesce(k.joined, '') || CASE WHEN b.body LIKE '%' || chr(10) THEN chr(10) ELSE '' END ELSE b.body END AS out
        FROM {_BODIES} b JOIN (SELECT doc_id, bool_or(gone IS NOT NULL) AS any_gone, string_agg(line, chr(10) ORDER BY ln) FILTER (gone IS NULL) AS joined FROM {kept} GROUP BY doc_id) k ON k.doc_id = b.doc_id)"""


def _mask_counts(key: str, source: str, text: str) -> str:
    """Each class counted and masked in turn."""
    inner = f"SELECT {key}, {text} AS t0 FROM {source}"
    for k, (name, pattern, _) in enumerate(PATTERNS):
        inner = f"SELECT *, CAST(len(regexp_extract_all(t{k}, {_q(pattern)})) AS BIGINT) AS {name.lower()}, {_re(f't{k}', pattern, f'⟦{name}⟧')} AS t{k + 1} FROM ({inner})"
    return inner


def _numbered_masks(key: str, source: str, text: str) -> str:
    """Each class's spans replaced by numbered masks in turn; n: how many there are so far. A mask that later spans hold is put back in none of them."""
    inner = f"SELECT {key}, {text} AS t0, CAST(0 AS BIGINT) AS n0, CAST([] AS VARCHAR[]) AS spans0, CAST([] AS VARCHAR[]) AS originals0 FROM {source}"
    for k, (name, pattern, _) in enumerate(PATTERNS):
        mask = f"'⟦{name}_' || (n{k} + i) || '⟧'"
        cut = f"SELECT *, string_split_regex(t{k}, {_q(pattern)}) AS p{k}, regexp_extract_all(t{k}, {_q(pattern)}) AS m{k} FROM ({inner})"
        inner = f"""SELECT *, array_to_string(list_transform(range(1, len(p{k}) + 1), lambda i: p{k}[i] || CASE WHEN i <= len(m{k}) THEN {mask} ELSE '' END), '') AS t{k + 1}, n{k} + len(m{k}) AS n{k + 1},
            list_concat(spans{k}, list_transform(range(1, len(m{k}) + 1), lambda i: {mask} || ' ' || m{k}[i])) AS spans{k + 1}, list_concat(originals{k}, m{k}) AS originals{k + 1} FROM ({cut})"""
    return inner


_LAST_MASK = len(PATTERNS)
_SHOWN = f"CASE WHEN doc_id % 2 = 0 AND {_FIRST_LINE} <> '' THEN {_FIRST_LINE} ELSE replace({_sanitized(_FIRST_LINE)}, '_', ' ') END"

_FENCED = _q(rf"(?ms)^{LINE_WS}*```[^\n]*(?:\n|\z)(?:.*?^{LINE_WS}*```[^\n]*(?:\n|\z)|.*\z)")
#: The view with its mathematics normalised outside fences, piece by piece.
_NORMALIZED = f"""(SELECT doc_id, string_agg({_NUMBER_LAST} || coalesce(fence, ''), '' ORDER BY i) AS md FROM (SELECT *, {_NUMBER_FIRST} AS x FROM (
    SELECT doc_id, i, fence, array_to_string(list_transform(range(1, len(c) + 1), lambda i: {_SIGN_CHARS}), '') AS html FROM (SELECT *, string_split({_SUBSCRIPTS}, '') AS c FROM (
    SELECT doc_id, i, fence, {_WRAPPED} AS md FROM (SELECT doc_id, i, fence, {_DELIMITERS} AS md FROM (
    SELECT doc_id, i, p[i] AS md, m[i] AS fence FROM (SELECT doc_id, string_split_regex(md, {_FENCED}) AS p, regexp_extract_all(md, {_FENCED}) AS m FROM {_PM}), range(1, len(p) + 1) t(i))))))) GROUP BY doc_id)"""
_MASK = "'⟦[^⟧]+⟧'"

ORACLE: dict[str, str] = {
    "q01_source_kind": f"""
    SELECT url, regexp_matches(url, '(?i)^https?:') AS is_url, CASE WHEN lower(name) LIKE '%.pdf' THEN name ELSE 'downloaded_paper.pdf' END AS file_name
    FROM (SELECT url, url_decode(regexp_extract({_PATH}, '([^/]*)/*$', 1)) AS name FROM (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES {_EDGES}) e(url)))""",
    "q02_sanitize_title": f"SELECT doc_id, title FROM {_TITLES}",
    "q03_md_title": f"SELECT doc_id, {_MD_TITLE} AS title FROM {_PM}",
    "q04_placeholder_title": f"SELECT doc_id, {_placeholder('c')} AS is_placeholder FROM (SELECT doc_id, {_CANDIDATE} AS c FROM documents)",
    "q05_resolve_title": f"""
    SELECT doc_id, CASE WHEN heading IS NOT NULL AND (detected IS NULL OR {_placeholder('detected')}) THEN heading
        ELSE coalesce(detected, CASE WHEN doc_id % 3 = 0 THEN 'Meta ' || doc_id END, CASE WHEN doc_id % 2 = 1 THEN 'p' || doc_id END, 'untitled_paper') END AS title
    FROM (SELECT doc_id, {_MD_TITLE} AS heading, CASE WHEN doc_id % 5 <> 0 THEN nullif({_CANDIDATE}, '') END AS detected FROM (SELECT *, {fixtures.PAPER_MD} AS md FROM documents))""",
    "q06_math_delims": f"SELECT doc_id, md5({_DELIMITERS}) AS digest FROM {_PM}",
    "q07_math_env": f"SELECT doc_id, md5({_WRAPPED}) AS digest FROM {_PM}",
    "q08_inline_subscript": f"SELECT doc_id, md5({_SUBSCRIPTS}) AS digest FROM {_PM}",
    "q09_inline_greek": f"SELECT doc_id, md5(array_to_string(list_transform(range(1, len(c) + 1), lambda i: {_SIGN_CHARS}), '')) AS digest FROM (SELECT doc_id, string_split(md, '') AS c FROM {_PM})",
    "q10_inline_compare": f"SELECT page_id, md5(x) AS first_digest, md5({_NUMBER_LAST}) AS digest FROM (SELECT page_id, {_NUMBER_FIRST} AS x FROM pages)",
    "q11_fence_segments": f"""
    WITH l AS (SELECT doc_id, i, ls[i] AS line, len(ls) AS n, regexp_matches(ls[i], '^{LINE_WS}*```') AS fence FROM (SELECT doc_id, string_split(md, chr(10)) AS ls FROM {_PM}), range(1, len(ls) + 1) t(i)),
    w AS (SELECT *, sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l)
    SELECT doc_id, CAST(any_value(n) AS INT) AS n_lines, CAST(count(*) FILTER (fence) AS INT) AS n_fences, CAST(count(*) FILTER (NOT fence AND k % 2 = 1) AS INT) AS n_inside,
        md5(coalesce(string_agg(line || CASE WHEN i < n THEN chr(10) ELSE '' END, '' ORDER BY i) FILTER (fence OR k % 2 = 1), '')) AS fenced_digest FROM w GROUP BY doc_id""",
    "q12_image_placeholders": f"""
    WITH t AS (SELECT doc_id, string_split_regex(md, '<!--{WS}*image{WS}*-->') AS p, regexp_extract_all(md, '<!--{WS}*image{WS}*-->') AS m FROM {_PM}),
    r AS (SELECT doc_id, p, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i <= 1 THEN '![Figure ' || i || '](./assets/image_' || lpad(CAST(i AS VARCHAR), 3, '0') || '.png)' ELSE m[i] END) AS r FROM t)
    SELECT doc_id, md5({_PIECE_JOIN}) AS digest FROM r""",
    "q13_image_renumber": """
    WITH c AS (SELECT doc_id, CAST(k AS INT) AS chunk_idx, name FROM documents, range(3) t(k), (VALUES ('b' || k || '.PNG'), ('a.jpg'), ('notes.txt')) n(name) WHERE k <= doc_id % 3 AND (doc_id + k) % 4 <> 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx, name) AS INT) AS n FROM c WHERE lower(name) LIKE '%.png' OR lower(name) LIKE '%.jpg')
    SELECT doc_id, chunk_idx, name, n, printf('image_%03d', n) || regexp_extract(name, '\\.[^.]+$') AS new_name FROM r""",
    "q14_image_rewrite_chunk": _rewrite("e.old = <base>"),
    "q14_image_rewrite_api": _rewrite("contains(o, e.old) OR contains(e.old, o)"),
    "q14_image_rewrite_cli": _rewrite("ends_with(e.old, <base>)"),
    "q15_page_ranges": f"SELECT doc_id, pages, chunk_idx, CAST(start_page AS INT) AS start_page, CAST(end_page AS INT) AS end_page FROM {_RANGES}",
    "q16_gpu_select": f"SELECT idx, mem, gpu_pos FROM {_DEVICES} WHERE gpu_pos < 4",
    "q17_round_robin": f"SELECT r.doc_id, r.chunk_idx, d.idx AS gpu FROM {_RANGES} r JOIN {_DEVICES} d ON d.gpu_pos < 4 AND d.gpu_pos = r.chunk_idx % (SELECT least(4, count(*)) FROM {_DEVICES})",
    "q18_chunk_merge": """
    WITH l AS (SELECT doc_id, i - 1 AS i, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(1, len(ls) + 1) t(i)),
    n AS (SELECT *, sum(CAST(line <> '' AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l)
    SELECT doc_id, count(*) AS n_chunks, CAST(count(*) FILTER (line <> '') AS BIGINT) AS n_images, count(*) FILTER (line = '') AS failed_chunks,
        CASE WHEN count(*) FILTER (line <> '') = 0 THEN 'error' ELSE 'success' END AS status,
        md5(coalesce(string_agg(line || ' ![](./assets/' || printf('image_%03d', CAST(k AS INT)) || '.png)', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) FILTER (line <> ''), '')) AS digest FROM n GROUP BY doc_id""",
    "q19_dup_check": f"""
    WITH t AS (SELECT * FROM {_TITLES}),
    known AS (SELECT DISTINCT CASE WHEN doc_id % 4 = 0 THEN title ELSE regexp_replace(title, '^{DIGIT}{{8}}-', '') END AS k FROM t WHERE doc_id % 2 = 0)
    SELECT doc_id, title AS title_key, title IN (SELECT k FROM known) OR row_number() OVER (PARTITION BY title ORDER BY doc_id) > 1 AS is_duplicate FROM t""",
    "q20_frontmatter_render": f"""
    SELECT doc_id, md5('---' || chr(10) || 'title: "' || {_SHOWN} || '"' || chr(10) || 'date_ingested: {fixtures.RUN_DATE}' || chr(10) || 'source_pdf: reference.pdf' || chr(10) || 'conversion_engine: mineru' || chr(10) || 'tags:' || chr(10) || '  - paper' || chr(10) || '  - inbox' || chr(10) || 'aliases: []' || chr(10) || '---' || chr(10) || chr(10)) AS digest,
        '20260131-' || {_sanitized(_FIRST_LINE)} AS folder FROM documents""",
    "q21_frontmatter_split": f"""
    SELECT doc_id, md5(front) AS front_digest, md5(body) AS body_digest, md5(regexp_replace({_strip('front')}, '\\n([^\\n]*)\\z', chr(10) || 'language: Chinese' || chr(10) || '\\1') || chr(10)) AS language_digest FROM {_BODIES}""",
    "q22_headings": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS INT) AS h_idx, ln AS start_line, CAST(ln + 1 AS INT) AS end_line, CAST(level AS INT) AS level, heading_text FROM {_HEADS}",
    "q23_sections": f"SELECT doc_id, ln AS start_line, CAST(level AS INT) AS level, CAST(section_end AS INT) AS section_end FROM {_SECTIONS}",
    "q24_strip_references": f"SELECT a.doc_id, md5(a.out) AS reference_digest, md5(b.out) AS fixed_digest, a.out <> a.body AS removed FROM {_stripped(False)} a JOIN {_stripped(True)} b ON a.doc_id = b.doc_id",
    "q25_context": f"""
    WITH named AS (SELECT doc_id, CASE WHEN front IS NOT NULL THEN regexp_extract(front, 'title: "([^\\n]*)"', 1) END AS fm FROM {_BODIES}),
    first AS (SELECT doc_id, arg_min({_strip('heading_text')}, ln) AS h FROM {_HEADS} WHERE heading_text <> '' AND NOT {_begins('heading_text', ABSTRACT_PREFIXES, ABSTRACT_WHOLE)} AND NOT {_begins('heading_text', REFERENCE_PREFIXES, REFERENCE_WHOLE)} GROUP BY doc_id),
    parts AS (SELECT s.doc_id, s.ln, {_strip("string_agg(l.line, chr(10) ORDER BY l.ln)")} AS a FROM {_SECTIONS} s JOIN {_LINES} l ON l.doc_id = s.doc_id AND l.ln > s.ln AND l.ln < s.section_end WHERE {_begins('s.heading_text', ABSTRACT_PREFIXES, ABSTRACT_WHOLE)} GROUP BY s.doc_id, s.ln),
    abstracts AS (SELECT doc_id, arg_min(a, ln) AS a FROM parts WHERE a <> '' GROUP BY doc_id),
    x AS (SELECT n.doc_id, coalesce(fm, h) AS title, a AS abstract FROM named n LEFT JOIN first USING (doc_id) LEFT JOIN abstracts USING (doc_id))
    SELECT doc_id, md5(title) AS title_digest, md5(abstract) AS abstract_digest, md5(CASE WHEN nullif(title, '') IS NULL THEN NULL WHEN abstract IS NULL THEN 'Title: ' || title ELSE 'Title: ' || title || chr(10) || 'Abstract:' || chr(10) || abstract END) AS context_digest FROM x""",
    "q26_mask_counts": f"SELECT * EXCLUDE ({', '.join(f't{k}' for k in range(_LAST_MASK + 1))}) FROM ({_mask_counts('doc_id', _BODIES, 'body')})",
    "q26_mask_counts_html": f"SELECT * EXCLUDE ({', '.join(f't{k}' for k in range(_LAST_MASK + 1))}) FROM ({_mask_counts('page_id', 'pages', 'html')})",
    "q27_mask_roundtrip": f"""
    SELECT doc_id, md5(t{_LAST_MASK}) AS masked_digest, n{_LAST_MASK} AS n_spans, md5(array_to_string(spans{_LAST_MASK}, chr(10))) AS spans_digest, md5(t0) AS fixed_digest,
        md5(array_to_string(list_transform(range(1, len(left_) + 1), lambda i: left_[i] || CASE WHEN i <= len(back) THEN originals{_LAST_MASK}[CAST(back[i] AS INT)] ELSE '' END), '')) AS reference_digest
    FROM (SELECT *, string_split_regex(t{_LAST_MASK}, '⟦[A-Z_]+_[0-9]+⟧') AS left_, regexp_extract_all(t{_LAST_MASK}, '⟦[A-Z_]+_([0-9]+)⟧', 1) AS back FROM ({_numbered_masks('doc_id', _BODIES, 'body')}))""",
    "q28_greedy_chunks": """
    WITH RECURSIVE p AS (SELECT doc_id, i, ps[i] AS para FROM (SELECT doc_id, string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\n+') AS ps FROM documents), range(1, len(ps) + 1) t(i)),
    f AS (SELECT doc_id, i, para, CAST(0 AS BIGINT) AS k, CAST(length(para) + 2 AS BIGINT) AS n FROM p WHERE i = 1
        UNION ALL SELECT p.doc_id, p.i, p.para, CASE WHEN f.n + length(p.para) > 3000 THEN f.k + 1 ELSE f.k END, CASE WHEN f.n + length(p.para) > 3000 THEN length(p.para) + 2 ELSE f.n + length(p.para) + 2 END FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
    c AS (SELECT doc_id, k, string_agg(para, chr(10) || chr(10) ORDER BY i) AS chunk FROM f GROUP BY doc_id, k)
    SELECT doc_id, CAST(k AS INT) AS chunk_idx, CAST(length(chunk) AS INT) AS n_chars, md5(chunk) AS digest FROM c""",
    "q29_skip_chunks": f"""
    SELECT doc_id, CAST(len(ps) AS INT) AS n_parts, CAST(len(list_filter(ps, lambda x: length({_strip(_re('x', '⟦[^⟧]+⟧'))}) < 20)) AS INT) AS n_skipped
    FROM (SELECT doc_id, string_split_regex(t{_LAST_MASK}, '\\n\\n+') AS ps FROM ({_mask_counts('doc_id', _BODIES, 'body')}))""",
    "q30_messages": "SELECT conv_id, turn, CASE WHEN turn % 2 = 1 AND role IS NOT NULL THEN 'system,system,user' ELSE 'system,user' END AS roles, md5(text) AS digest, CAST(CASE WHEN turn % 2 = 1 AND role IS NOT NULL THEN 3 ELSE 2 END AS INT) AS n FROM conversations",
    "q32_result_json": f"""
    SELECT doc_id, CASE WHEN ok THEN 'success' ELSE 'error' END AS status, CASE WHEN ok THEN '20260131-' || title || '/full_text.md' END AS markdown_path, CASE WHEN ok THEN 'mineru' END AS engine_used, CASE WHEN ok THEN title END AS title,
        CASE WHEN ok THEN '{fixtures.RUN_DATE}' END AS date, CASE WHEN ok THEN '20260131-' || title END AS paper_dir, CASE WHEN NOT ok THEN 'Duplicate detected: A folder with title ''' || title || ''' already exists' END AS message,
        CASE WHEN doc_id % 4 = 1 THEN {_q(DUPLICATE_SUGGESTION)} END AS suggestion FROM (SELECT *, doc_id % 2 = 0 AS ok FROM {_TITLES})""",
    "q33_throughput": "SELECT doc_id, CASE WHEN pages > 0 AND doc_id % 7 > 0 THEN round(pages / CAST(doc_id % 7 AS DOUBLE), 2) END AS pages_per_second FROM (SELECT doc_id, CAST(ceil(n_chars / 3000) AS INT) AS pages FROM documents)",
    "q34_api_decode": """
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'paper_' || doc_id WHEN 1 THEN 'first' ELSE 'zz' END AS api_stem,
        md5(CASE WHEN doc_id % 3 = 1 THEN 'only' ELSE '![a](./assets/image_001.png) ![b](./assets/image_003.jpg) ' || text END) AS digest,
        CAST(CASE WHEN doc_id % 3 = 1 THEN 0 ELSE 2 END AS INT) AS n_images, CASE WHEN doc_id % 3 = 1 THEN '' ELSE 'image_001.png,image_003.jpg' END AS names,
        CASE WHEN doc_id % 3 <> 1 THEN 'image ' || doc_id END AS first_bytes, CAST(NULL AS VARCHAR) AS api_error FROM documents""",
    "q31_translate_pseudo": f"""
    WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, body, out FROM {_stripped(True)}),
    m AS MATERIALIZED (SELECT doc_id, t{_LAST_MASK} AS masked, spans{_LAST_MASK} AS spans FROM ({_numbered_masks('doc_id', 's', 'out')})),
    p AS MATERIALIZED (SELECT doc_id, i, ps[i] AS para FROM (SELECT doc_id, string_split_regex(masked, '\\n\\n+') AS ps FROM m), range(1, len(ps) + 1) t(i)),
    f AS (SELECT doc_id, i, para, CAST(0 AS BIGINT) AS k, CAST(length(para) + 2 AS BIGINT) AS n FROM p WHERE i = 1
        UNION ALL SELECT p.doc_id, p.i, p.para, CASE WHEN f.n + length(p.para) > 3000 THEN f.k + 1 ELSE f.k END, CASE WHEN f.n + length(p.para) > 3000 THEN length(p.para) + 2 ELSE f.n + length(p.para) + 2 END FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
    c AS (SELECT doc_id, k, string_agg(para, chr(10) || chr(10) ORDER BY i) AS chunk FROM f GROUP BY doc_id, k),
    u AS (SELECT *, length({_strip(f"regexp_replace(chunk, {_MASK}, '', 'g')")}) < 20 AS skip, string_split_regex(chunk, {_MASK}) AS l, regexp_extract_all(chunk, {_MASK}) AS b FROM c),
    w AS (SELECT doc_id, k, skip, CASE WHEN skip THEN chunk ELSE array_to_string(list_transform(range(1, len(l) + 1), lambda i: upper(replace(l[i], 'ß', 'SS')) || coalesce(b[i], '')), '') END AS t FROM u),
    j AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (skip) AS n_skipped, string_agg(t, chr(10) || chr(10) ORDER BY k) AS t FROM w GROUP BY doc_id),
    r AS (SELECT j.*, list_reduce(list_prepend(t, list_reverse(spans)), lambda a, x: replace(a, split_part(x, ' ', 1), substr(x, position(' ' IN x) + 1))) AS back FROM j JOIN m USING (doc_id))
    SELECT doc_id, true AS success, s.out <> s.body AS removed_refs, n_chunks, n_skipped,
        md5(CASE WHEN front IS NOT NULL THEN regexp_replace({_strip('front')}, '\\n([^\\n]*)\\z', chr(10) || 'language: Chinese' || chr(10) || '\\1') || chr(10) || back ELSE back END) AS digest
    FROM r JOIN s USING (doc_id) JOIN {_BODIES} USING (doc_id)""",
    "q35_ingestion": f"""
    WITH n AS (SELECT d.doc_id, '/data/' || lpad(CAST(d.doc_id AS VARCHAR), 9, '0') || '.pdf' AS source, x.md, {_MD_TITLE.replace('md,', 'x.md,')} AS heading, CASE WHEN d.doc_id % 5 <> 0 THEN nullif({_CANDIDATE.replace('doc_id', 'd.doc_id')}, '') END AS detected
        FROM documents d JOIN {_NORMALIZED} x ON x.doc_id = d.doc_id),
    t AS (SELECT *, CASE WHEN heading IS NOT NULL AND (detected IS NULL OR {_placeholder('detected')}) THEN heading ELSE coalesce(detected, {_stem('source')}) END AS title FROM n),
    k AS (SELECT *, {_sanitized('title')} AS title_key FROM t),
    g AS (SELECT *, title_key IN (SELECT title FROM {_TITLES} WHERE doc_id % 4 = 0) OR row_number() OVER (PARTITION BY title_key ORDER BY source) > 1 AS again, '20260131-' || title_key AS paper_dir FROM k)
    SELECT source, title_key, CASE WHEN again THEN 'error' ELSE 'success' END AS status, paper_dir,
        md5('---' || chr(10) || 'title: "' || coalesce(nullif(title, ''), replace(title_key, '_', ' ')) || '"' || chr(10) || 'date_ingested: {fixtures.RUN_DATE}' || chr(10) || 'source_pdf: reference.pdf' || chr(10) || 'conversion_engine: mineru' || chr(10) || 'tags:' || chr(10) || '  - paper' || chr(10) || '  - inbox' || chr(10) || 'aliases: []' || chr(10) || '---' || chr(10) || chr(10) || md) AS text_digest,
        CASE WHEN again THEN CAST(to_json({{'status': 'error', 'message': 'Duplicate detected: A folder with title ''' || title_key || ''' already exists', 'suggestion': {_q(DUPLICATE_SUGGESTION)}}}) AS VARCHAR)
            ELSE CAST(to_json({{'status': 'success', 'markdown_path': paper_dir || '/full_text.md', 'engine_used': 'mineru', 'title': title_key, 'date': '{fixtures.RUN_DATE}', 'paper_dir': paper_dir}}) AS VARCHAR) END AS record
    FROM g""",
}
