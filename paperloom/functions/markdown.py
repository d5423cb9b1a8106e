"""Markdown structure: front matter, headings, sections, what a translator needs to know of a document.

``headings`` finds ATX and setext headings with a fold over lines. It knows fenced and indented
code, HTML comments and block-level tags, and ATX headings in block quotes and at the beginning
of list items. It doesn't know setext headings and fences within those, headings further down a
list item, and link-reference definitions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dialect import WORD_INNER, WS, lines, not_empty, replace, strip

HEADING = "array<struct<start_line:int,end_line:int,level:int,heading_text:string>>"
# Headings that begin an abstract or the references.
ABSTRACT_PREFIXES, ABSTRACT_WHOLE = ("abstract", "summary"), ("概要", "摘要")
REFERENCE_PREFIXES, REFERENCE_WHOLE = ("references", "reference", "bibliography", "works cited", "literature cited"), ("参考文献", "引用文献", "参考资料")
#: Marks of block quotes and list items before what they hold.
_CONTAINERS = r"^(?: {0,3}(?:> ?|(?:[-+*]|[0-9]{1,9}[.)]) {1,4}(?=[^ \t])))+"
#: Tags that begin an HTML block, which lasts to a blank line.
_BLOCK_TAGS = "address|article|aside|blockquote|body|center|details|dialog|div|dl|dt|dd|fieldset|figure|figcaption|footer|form|h[1-6]|head|header|hr|html|iframe|li|link|main|menu|nav|ol|p|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul"


def front_matter(md: Column) -> Column:
    """The front matter with its closing line; NULL if there is none."""
    end = F.locate("\n---\n", md, 4)
    return F.when(md.startswith("---") & (end > 0), F.left(md, end + 4))


def body(md: Column) -> Column:
    """What follows the front matter."""
    end = F.locate("\n---\n", md, 4)
    return F.when(md.startswith("---") & (end > 0), F.substring(md, end + 5, F.length(md))).otherwise(md)


def with_language(front: Column, language: Column, quirks: str = "reference") -> Column:
    """Front matter with a language line before its last line; with ``quirks="fixed"`` no blank line is added each time."""
    parts = F.split(strip(front), "\n", -1)
    n = F.size(parts)
    line = F.array(F.concat(F.lit("language: "), language))
    joined = F.array_join(F.concat(F.slice(parts, F.lit(1), n - 1), line, F.slice(parts, n, F.lit(1))), "\n")
    return F.concat(joined, F.lit("\n")) if quirks == "reference" else joined


def render_front_matter(title: Column, date: Column, engine: Column, quirks: str = "reference") -> Column:
    """The front matter of an ingested paper and the blank line behind it; with ``quirks="fixed"`` quotes in titles are escaped."""
    if quirks != "reference":
        title = F.replace(F.replace(title, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('---\ntitle: "'), title, F.lit('"\ndate_ingested: '), date, F.lit("\nsource_pdf: reference.pdf\nconversion_engine: "), engine, F.lit("\ntags:\n  - paper\n  - inbox\naliases: []\n---\n\n"))


def headings(text: Column) -> Column:
    """Headings in order: lines from 0, the line after the last, level and text."""
    rows = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(x.alias("line"), i.cast("int").alias("at"))), lambda r: F.lit(True))
    none = F.lit(-1)
    start = F.struct(F.lit("").alias("fence"), F.lit(False).alias("html"), F.lit(False).alias("note"), none.alias("para"), F.lit("").alias("text"), F.array().cast(HEADING).alias("out"))

    def step(acc: Column, r: Column) -> Column:
        x, at = r["line"], r["at"]
        fence = F.regexp_extract(x, r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})", 1)
        closing = F.regexp_extract(x, r"^ {0,3}(`{3,}|~{3,})[ \t]*$", 1)
        in_fence, in_para = acc["fence"] != "", acc["para"] >= 0
        closes = in_fence & closing.startswith(acc["fence"])
        is_blank = x.rlike(r"^[ \t]*$")
        opens_note = x.rlike(r"^ {0,3}<!--")
        stays_html = acc["html"] & ~is_blank
        stays_note = acc["note"] & ~x.contains("-->")
        covered = in_fence | acc["html"] | acc["note"]
        opens_html = x.rlike(rf"(?i)^ {{0,3}}</?(?:{_BLOCK_TAGS})(?:[\s/>]|$)") & ~covered
        indented = x.rlike(r"^(?: {4}| {0,3}\t)") & ~in_para
        inner = replace(x, _CONTAINERS, "")
        atx = F.regexp_extract(inner, r"^ {0,3}(#{1,6})(?:[ \t]|$)", 1)
        is_atx = (atx != "") & ~covered
        under = F.regexp_extract(x, r"^ {0,3}(=+|-+)[ \t]*$", 1)
        is_setext = (under != "") & in_para & ~covered
        rule = x.rlike(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:_[ \t]*){3,}|(?:\*[ \t]*){3,})$")
        container = x.rlike(r"^ {0,3}(?:>|[-+*](?:[ \t]|$)|[0-9]{1,9}[.)](?:[ \t]|$))") & ~in_para
        plain = ~(covered | is_blank | is_atx | is_setext | opens_html | opens_note | indented | rule | container) & (fence == "")
        content = replace(replace(replace(inner, r"^ {0,3}#{1,6}", ""), r"(?:^|[ \t])[ \t]*#+[ \t]*$", ""), r"^[ \t]+|[ \t]+$", "")
        trimmed = replace(x, r"^[ \t]+|[ \t]+$", "")
        found = F.when(is_atx, F.array(F.struct(at.alias("start_line"), (at + 1).alias("end_line"), F.length(atx).alias("level"), content.alias("heading_text")))).when(
            is_setext, F.array(F.struct(acc["para"].alias("start_line"), (at + 1).alias("end_line"), F.when(under.startswith("="), 1).otherwise(2).alias("level"), acc["text"].alias("heading_text")))
        )
        return F.struct(
            F.when(closes, F.lit("")).when(in_fence, acc["fence"]).when((fence != "") & ~acc["html"] & ~acc["note"], fence).otherwise(F.lit("")).alias("fence"),
            (stays_html | opens_html).alias("html"),
            (stays_note | (opens_note & ~covered & ~x.contains("-->"))).alias("note"),
            F.when(plain, F.when(in_para, acc["para"]).otherwise(at)).otherwise(none).alias("para"),
            F.when(plain, F.when(in_para, F.concat(acc["text"], F.lit("\n"), trimmed)).otherwise(trimmed)).otherwise(F.lit("")).alias("text"),
            F.when(found.isNotNull(), F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def normalize_heading(c: Column, quirks: str = "reference") -> Column:
    """A heading without its number, for comparison; with ``quirks="fixed"`` also without the space behind the number."""
    out = replace(F.lower(strip(c)), rf"\A{WS}*[\p{{Nd}}.)(]+", "")
    if quirks != "reference":
        out = strip(out)
    return replace(replace(out, f"{WS}+", " "), rf"(?:[:：]|{WS})+\z", "")


def _begins(c: Column, prefixes: tuple[str, ...], whole: tuple[str, ...]) -> Column:
    return c.rlike(rf"\A(?:{'|'.join(prefixes)})(?![{WORD_INNER}])") | c.isin(*whole)


def is_abstract(c: Column, quirks: str = "reference") -> Column:
    return _begins(normalize_heading(c, quirks), ABSTRACT_PREFIXES, ABSTRACT_WHOLE)


def is_references(c: Column, quirks: str = "reference") -> Column:
    return _begins(normalize_heading(c, quirks), REFERENCE_PREFIXES, REFERENCE_WHOLE)


def sections(heads: Column, n_lines: Column) -> Column:
    """Headings with ``section_end``: the next heading of the same or a higher level, or the end."""

    def one(h: Column, i: Column) -> Column:
        later = F.filter(F.slice(heads, i + 2, F.size(heads)), lambda x: x["level"] <= h["level"])
        return F.struct(h["start_line"].alias("start_line"), h["end_line"].alias("end_line"), h["level"].alias("level"), h["heading_text"].alias("heading_text"), F.coalesce(F.get(later, 0)["start_line"], n_lines).alias("section_end"))

    return F.transform(heads, one)


def strip_references(text: Column, parts: Column, quirks: str = "reference") -> Column:
    """``text`` without its references sections; parts: its ``sections``.

    ``quirks="reference"`` deletes ranges one after another from the last, which takes further
    lines where they overlap; ``"fixed"`` deletes their union.
    """
    found = F.filter(parts, lambda s: is_references(s["heading_text"], quirks) & (s["start_line"] < s["section_end"]))
    found = F.transform(found, lambda s: F.struct(s["start_line"].alias("a"), s["section_end"].alias("b")))
    # the ranges are bound, or else each line would look for them anew
    return F.get(F.transform(F.array(found), lambda ranges: F.when(F.size(ranges) > 0, _without(text, ranges, quirks)).otherwise(text)), 0)


def _without(text: Column, ranges: Column, quirks: str) -> Column:
    rows = lines(text)
    if quirks == "reference":
        ordered = F.reverse(F.array_sort(ranges))

        def delete(acc: Column, r: Column) -> Column:
            end = F.least(r["b"], F.size(acc))
            return F.when(r["a"] < end, F.concat(F.slice(acc, F.lit(1), r["a"]), F.slice(acc, end + 1, F.size(acc)))).otherwise(acc)

        left = F.aggregate(ordered, rows, delete)
    else:
        kept = F.transform(rows, lambda x, i: F.when(~F.exists(ranges, lambda s: (s["a"] <= i) & (i < s["b"])), x))
        left = F.array_compact(kept)
    return F.concat(F.array_join(left, "\n"), F.when(text.endswith("\n"), F.lit("\n")).otherwise(F.lit("")))


def title_for_context(front: Column, heads: Column, quirks: str = "reference") -> Column:
    """The front matter's title, which may be empty, else the first heading that is neither abstract nor references."""
    named = F.get(F.filter(F.split(front, "\n", -1), lambda x: x.rlike(rf"(?i)\A{WS}*title{WS}*:{WS}*.+")), 0)
    value = strip(F.regexp_extract(named, rf"(?is)\A{WS}*title{WS}*:{WS}*(.+)\z", 1))
    value = replace(replace(value, '\\A"+|"+\\z', ""), "\\A'+|'+\\z", "")
    other = F.filter(heads, lambda h: (h["heading_text"] != "") & ~is_abstract(h["heading_text"], quirks) & ~is_references(h["heading_text"], quirks))
    return F.when(named.isNotNull(), value).otherwise(strip(F.get(other, 0)["heading_text"]))


def abstract(text: Column, parts: Column, quirks: str = "reference") -> Column:
    """The first abstract section that isn't blank."""
    rows = lines(text)
    found = F.transform(F.filter(parts, lambda s: is_abstract(s["heading_text"], quirks)), lambda s: strip(F.array_join(F.slice(rows, s["end_line"] + 1, F.greatest(s["section_end"] - s["end_line"], F.lit(0))), "\n")))
    return F.get(F.filter(found, lambda x: x != ""), 0)


def context(title: Column, abstract_text: Column) -> Column:
    title = not_empty(title)
    return F.when(title.isNotNull() & abstract_text.isNotNull(), F.concat(F.lit("Title: "), title, F.lit("\nAbstract:\n"), abstract_text)).when(title.isNotNull(), F.concat(F.lit("Title: "), title))
