"""Views that make the driver's tables exercise document operators, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

_NL, _BS = "chr(10)", "chr(92)"
_ID = "cast(doc_id AS varchar(20))"


def _first(n: int) -> str:
    return f"substr(replace(text, {_NL}, ' '), 1, {n})"


def _cases(of: str, *values: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " ELSE '' END"


_BLANK = f"{_NL} || {_NL}"
_TITLE = f"CASE doc_id % 6 WHEN 1 THEN '2401.' || lpad(cast(doc_id % 10000 AS varchar(20)), 4, '0') WHEN 2 THEN 'Doc ' || {_ID} WHEN 4 THEN 'paper_' || {_ID} || '.pdf' ELSE '' END"
_FRONT = f"CASE WHEN doc_id % 3 = 0 THEN '' ELSE '---' || {_NL} || 'title: \"' || {_TITLE} || '\"' || {_NL} || 'source: ' || source || {_NL} || '---' || {_BLANK} END"
_HEADING = _cases("doc_id % 4", f"'# ' || {_first(40)} || {_BLANK}", f"'### ' || {_first(40)} || {_BLANK}", f"'#### ' || {_first(40)} || {_BLANK}")
_ABSTRACT = "(" + _cases("doc_id % 5", *(f"'{h}' || {_BLANK}" for h in ("## Abstract", "## 1 Abstract", "## Summary:", "# 摘要"))) + f") || {_first(200)} || {_BLANK}"
_MATH = f"'Let ' || {_BS} || '(a_' || cast(doc_id % 10 AS varchar(20)) || {_BS} || ') and ' || {_BS} || '[E = m' || {_BS} || '] with α, αβ, 1 ≤ j, k ≥ 3, $x_i$ and y_j.' || {_BLANK}"
_ENVIRONMENT = f"CASE WHEN doc_id % 2 = 0 THEN {_BS} || 'begin{{align}}a' || {_BS} || 'end{{align}}' ELSE '$$' || {_BS} || 'begin{{cases}}b' || {_BS} || 'end{{cases}}$$' END || {_BLANK}".replace("{{", "{").replace("}}", "}")
_FENCE = f"'```python' || {_NL} || 'x_i = \"α\"' || {_NL} || '# comment' || {_NL} || '```' || {_BLANK}"
_MARKS = f"repeat('<!-- image -->' || {_BLANK}, cast(doc_id % 3 AS int))"
_REFERENCES = f"'![b $y$](images/q.png) ![fig](images/p' || cast(doc_id % 7 AS varchar(20)) || '.png) see [text](http://e.example/' || {_ID} || '_a) [1, 2] `z_k` <table><tr><td>5</td></tr></table>' || {_BLANK} || '---' || {_BLANK}"
_BODY = f"replace(text, {_NL}, {_BLANK}) || {_BLANK}"
_LAST = _cases("doc_id % 4", *(f"'{h}' || {_BLANK} || '[1] Item' || {_BLANK}" for h in ("## References", "## 7. References", "## 7.References")))
_APPENDIX = f"CASE WHEN doc_id % 2 = 0 THEN '# Appendix' || {_BLANK} || 'Tail' || {_NL} ELSE '' END"

#: The Markdown of a document, from the columns doc_id, text and source.
PAPER_MD = " || ".join(f"({x})" for x in (_FRONT, _HEADING, _ABSTRACT, _MATH, _ENVIRONMENT, _FENCE, _MARKS, _REFERENCES, _BODY, _LAST, _APPENDIX))

#: Addresses beside those of the table pages.
EDGE_URLS = ("HTTP://X.org/a%20b.pdf", "https://e.org/a+b%20c.PDF?x=1#y", "/data/p.pdf", "ftp://e.org/x.pdf", "http://e.org/dir/", "https://e.org/paper")
RUN_DATE = "2026-01-31"
