"""Golden cases of the column functions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import chunking, images, markdown, masking, math, titles
from paperloom.operators import catalog, paging


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def of(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_folder_names(spark):
    got = of(spark, titles.sanitize_filename, "DeepSeek-V3: Technical Report", "C++ & Rust", "论文 标题", "***", "foo.", "a - b", "GPT-4.5 Report", "x/", None)
    assert got == ["DeepSeek_V3_Technical_Report", "C_Rust", "论文_标题", "", "foo", "a_b", "GPT_4", "x", None]
    assert of(spark, titles.path_stem, "GPT-4.5 Report", "A/B testing", "v1. Intro", "x/", ".hidden") == ["GPT-4", "B testing", "v1", "x", ".hidden"]
    assert of(spark, lambda c: titles.sanitize_filename(c, "fixed"), "GPT-4.5 Report") == ["GPT_45_Report"]


def test_markdown_titles(spark):
    assert of(spark, titles.markdown_title, "#\n\nfoo bar", "#### x\n## y ##", "```\n# c\n```\n", "#nospace", "") == ["foo bar", "y ##", "c", None, None]


def test_placeholder_titles(spark):
    assert of(spark, titles.looks_like_placeholder, "2401.12345v2", "paper.pdf", "12-3_4", "a/b", " ", "Attention") == [True, False, True, True, True, False]


def test_titles_are_resolved(spark):
    rows = spark.createDataFrame([("2401.00001", "no heading", "M", "/a/b.pdf"), (None, "# H", "M", "/a/b.pdf"), ("a/b", "# H", None, "/a/b.pdf"), ("", "x", " ", "/a/b.pdf"), ("", "x", None, "https://e.org/b.pdf")], "d string, md string, m string, s string")
    got = [r[0] for r in rows.select(titles.resolve_title(F.col("d"), F.col("md"), F.col("m"), F.col("s"), titles.is_url(F.col("s")))).collect()]
    assert got == ["2401.00001", "H", "H", "b", "untitled_paper"]


def test_download_names(spark):
    assert of(spark, titles.download_name, "https://e.org/a+b%20c.pdf", "https://e.org/%zz.pdf", "https://e.org/x") == ["a+b c.pdf", "%zz.pdf", "downloaded_paper.pdf"]
    assert one(spark, titles.download_name(F.lit("https://e.org/x"), F.lit('attachment; filename="y.PDF"'))) == "y.PDF"
    assert of(spark, titles.output_suffix, "Chinese", "Japanese") == ["ch", "ja"]


def test_delimiters(spark):
    assert of(spark, math.normalize_delimiters, r"a \[x\] b", r"\(a" + "\n" + r"b\)") == ["a $$x$$ b", "$a\nb$"]
    kept = [r"$$\begin{align}a\end{align}$$", r"$$\begin{equation}\begin{split}a\end{split}\end{equation}$$", r"\begin{align}a\end{split}"]
    assert of(spark, math.wrap_environments, *kept) == kept
    assert of(spark, math.wrap_environments, r"\begin{cases}b\end{cases}") == ["$$\n\\begin{cases}b\\end{cases}\n$$"]
    fenced = "x\n```\n\\(a\\)\n```\n\\(b\\)"
    assert of(spark, math.normalize_delimiters, fenced) == ["x\n```\n\\(a\\)\n```\n$b$"]


def test_inline_mathematics(spark):
    assert of(spark, math.wrap_subscripts, "let $x_i$ be and file_name and x_i_j A _ b") == ["let $$x_i$$ be and file_name and $x_i_j$ $A_b$"]
    assert of(spark, math.wrap_signs, "α $β$ xγ αβ") == ["$α$ $β$ xγ $α$$β$"]
    assert of(spark, math.wrap_comparisons, "1 ≤ 2 and 1 ≤ j ≤ N <h1>De") == ["$$1 ≤ 2$$ and $1 ≤ j$ ≤ N <h$1 > De$"]
    assert of(spark, lambda c: math.wrap_inline(c, "fixed"), "$x_i$ and y_j at [a](u_1) <h1>α") == ["$x_i$ and $y_j$ at [a](u_1) <h1>$α$"]


def test_unclosed_fences_protect_the_rest(spark):
    assert of(spark, math.wrap_inline, "x_i\n```py\ny_j\n", "  ```\na_b\n```x\nc_d") == ["$x_i$\n```py\ny_j\n", "  ```\na_b\n```x\n$c_d$"]


def test_image_marks_and_names(spark):
    assert of(spark, lambda c: math.replace_image_marks(c, F.lit(1)), "<!-- image --> <!--image-->") == ["![Figure 1](./assets/image_001.png) <!--image-->"]
    assert one(spark, math.image_name(F.lit(1000), F.lit(""))) == "image_1000"
    assert of(spark, images.is_image, "a.PNG", "b.jpeg", "c.txt", "d") == [True, True, False, False]
    assert bytes(one(spark, images.decode_data_uri(F.lit("data:image/png;base64,aGk=")))) == b"hi"


def test_page_ranges(spark):
    rows = spark.createDataFrame([(5, 4), (15, 4), (3, 4), (1, 4), (0, 4)], "p int, n int")
    got = [[(x["start_page"], x["end_page"]) for x in r[0]] for r in rows.select(paging.page_ranges(F.col("p"), F.col("n"))).collect()]
    assert got == [[(0, 1), (2, 3), (4, 4)], [(0, 3), (4, 7), (8, 11), (12, 14)], [(0, 0), (1, 1), (2, 2)], [(0, 0)], []]


def test_devices(spark):
    rows = spark.createDataFrame([(3, 1999, 9, 0), (1, 2000, 0, 1), (2, 0, 10, 2), (7, 5, 0, 3), (8, 5, 0, 4)], "idx int, mem int, util int, scan_pos int")
    assert [r["idx"] for r in paging.free_devices(rows).orderBy("gpu_pos").collect()] == [7, 8, 3]
    assert one(spark, paging.listed_devices(F.lit(" 2, ,1"))) == ["2", "1"]


def test_chunks(spark):
    text = "aaaa\n\nbb\n\ncccccccccccc\n\nd"
    assert of(spark, lambda c: chunking.greedy_chunks(c, 10), text, "") == [["aaaa\n\nbb", "cccccccccccc", "d"], [""]]
    assert of(spark, chunking.paragraphs, "a\n\n\n\nb\n\n", "") == [["a", "b", ""], [""]]


HEADINGS = "# T\na\nb\n# not here\n    # code\n\nSetext\nline\n---\n```\n# no\n```\n<div>\n# no\n</div>\n\n## Two ##\n<!-- x\n# no\n-->\n#\n"


def test_headings(spark):
    got = of(spark, markdown.headings, HEADINGS, "")
    assert [(h["start_line"], h["end_line"], h["level"], h["heading_text"]) for h in got[0]] == [(0, 1, 1, "T"), (3, 4, 1, "not here"), (6, 9, 2, "Setext\nline"), (16, 17, 2, "Two"), (20, 21, 1, "")]
    assert got[1] == []
    held = of(spark, markdown.headings, "> # a\n- ## b\n1. > ### c ###\n-# no\n* * *\n")[0]
    assert [(h["start_line"], h["level"], h["heading_text"]) for h in held] == [(0, 1, "a"), (1, 2, "b"), (2, 3, "c")]


def test_sections_and_references(spark):
    heads = F.lit([1]).cast("array<int>")
    text = "# T\n\n## References\n[1]\n### Sub\nx\n# App\nend\n"
    parts = lambda c: markdown.sections(markdown.headings(c), F.lit(8))
    assert [s["section_end"] for s in of(spark, parts, text)[0]] == [6, 6, 6, 8]
    assert of(spark, lambda c: markdown.strip_references(c, parts(c)), text) == ["# T\n\n# App\nend\n"]
    # a section within a section: one after another takes more lines
    nested = "a\n# References\nb\n## References\nc\n# D\ne\nf"
    assert of(spark, lambda c: markdown.strip_references(c, markdown.sections(markdown.headings(c), F.lit(8)), "fixed"), nested) == ["a\n# D\ne\nf"]
    assert of(spark, lambda c: markdown.strip_references(c, markdown.sections(markdown.headings(c), F.lit(8)), "reference"), nested) == ["a\nf"]
    assert heads is not None


def test_normalized_headings(spark):
    assert of(spark, markdown.normalize_heading, "7. References", "7.References", " Abstract： ") == [" references", "references", "abstract"]
    assert of(spark, markdown.is_references, "7. References", "7.References", "参考文献", "Referencesx") == [False, True, True, False]
    assert of(spark, lambda c: markdown.is_references(c, "fixed"), "7. References") == [True]


def test_front_matter(spark):
    text = '---\ntitle: "T"\n---\n\n# H\nx'
    assert of(spark, markdown.front_matter, text, "x", "---\nno end") == ['---\ntitle: "T"\n---\n', None, None]
    assert of(spark, markdown.body, text, "x") == ["\n# H\nx", "x"]
    assert of(spark, lambda c: markdown.with_language(markdown.front_matter(c), F.lit("X")), text) == ['---\ntitle: "T"\nlanguage: X\n---\n']


def test_duplicates(spark):
    known = spark.createDataFrame([("20260131-Foo",)], "dir_name string").select(catalog.title_key(F.col("dir_name")).alias("title_key"))
    incoming = spark.createDataFrame([(1, "Foo"), (2, "foo"), (3, "Bar"), (4, "Bar")], "n int, title_key string")
    got = {r["n"]: r["is_duplicate"] for r in catalog.split_duplicates(incoming, known, "n").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}
    assert not any(r["is_duplicate"] for r in catalog.split_duplicates(incoming, known, "n", force=True).collect())


def test_nested_masks(spark):
    rows = masking.with_masks(spark.createDataFrame([("```\n$x$\n``` [t](u) $z$",), ("see [t](u) $z$",)], "t string"), "t")
    got = {m: [r[0] for r in rows.select(masking.unmask(F.col("masked"), F.col("spans"), m)).collect()] for m in ("reference", "fixed")}
    assert got["fixed"] == ["```\n$x$\n``` [t](u) $z$", "see [t](u) $z$"]
    assert "⟦LATEX_INLINE_1⟧" in got["reference"][0] and got["reference"][1] == "see [t](u) $z$"


MARKED = st.lists(st.sampled_from(["$", "$$", "`", "```", "[1]", "[a](b)", "![c](d)", "<b>", "\n", "---", "x", " ", "é"]), max_size=30).map("".join)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(MARKED, min_size=20, max_size=20))
def test_masks_come_off(spark, texts):
    rows = masking.with_masks(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert rows.where(masking.unmask(F.col("masked"), F.col("spans"), "fixed") != F.col("t")).count() == 0


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), min_size=10, max_size=10))
def test_page_ranges_cover_each_page_once(spark, cases):
    rows = spark.createDataFrame(cases, "p int, n int").select("p", paging.page_ranges(F.col("p"), F.col("n")).alias("r")).collect()
    for r in rows:
        assert [k for x in r["r"] for k in range(x["start_page"], x["end_page"] + 1)] == list(range(r["p"]))


@pytest.mark.parametrize("limit", [1, 7, 40])
def test_chunks_keep_all_text(spark, limit):
    texts = ["a\n\n\nbb\n\nccc" * k + "\n\n" * (k % 3) for k in range(12)]
    for text, chunks in zip(texts, of(spark, lambda c: chunking.greedy_chunks(c, limit), *texts), strict=True):
        import re

        assert "\n\n".join(chunks) == re.sub(r"\n\n+", "\n\n", text)
