"""A query for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dialect import LINE_WS, lines, replace
from ..functions import chunking, images, markdown, masking, math, titles
from ..operators import apiresult, catalog, merging, paging, results
from . import fixtures
from .ingest import ingest
from .translate import translate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paper_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, md)."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.expr(fixtures.PAPER_MD).alias("md"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paper_md(spark, sf_dir).select("doc_id", markdown.front_matter(F.col("md")).alias("front"), markdown.body(F.col("md")).alias("body"))


def _first_line(c: str = "text") -> Column:
    return F.substring_index(c, "\n", 1)


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", titles.sanitize_filename(_first_line()).alias("title"))


@_query
def q01_source_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.range(1).select(F.explode(F.array(*map(F.lit, fixtures.EDGE_URLS))).alias("url"))
    urls = _table(spark, sf_dir, "pages").select("url").union(edges)
    return urls.select("url", titles.is_url(F.col("url")).alias("is_url"), titles.download_name(F.col("url")).alias("file_name"))


@_query
def q02_sanitize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir)


@_query
def q03_md_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paper_md(spark, sf_dir).select("doc_id", titles.markdown_title(F.col("md")).alias("title"))


def _candidate_title() -> Column:
    n = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 7
    return (
        F.when(kind == 0, F.concat(F.lit("2401."), F.lpad((F.col("doc_id") % 10000).cast("string"), 5, "0"), F.lit("v2")))
        .when(kind == 1, F.concat(F.lit("  "), n, F.lit("-1_2 ")))
        .when(kind == 2, F.concat(F.lit("Paper "), n, F.lit(".PDF")))
        .when(kind == 3, F.concat(F.lit("a/b"), n))
        .when(kind == 4, F.lit("　 "))
        .when(kind == 5, F.concat(n, F.lit(".pdf")))
        .otherwise(F.left("text", F.lit(20)))
    )


@_query
def q04_placeholder_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", titles.looks_like_placeholder(_candidate_title()).alias("is_placeholder"))


@_query
def q05_resolve_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(fixtures.PAPER_MD).alias("md"))
    source = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("https://e.org/")).otherwise(F.lit("/data/")), F.lit("p"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    detected = F.when(F.col("doc_id") % 5 != 0, _candidate_title())
    metadata = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Meta "), F.col("doc_id").cast("string")))
    return docs.select("doc_id", titles.resolve_title(detected, F.col("md"), metadata, source, titles.is_url(source)).alias("title"))


@_query
def q06_math_delims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paper_md(spark, sf_dir).select("doc_id", F.md5(math.display_delimiters(math.inline_delimiters(F.col("md")))).alias("digest"))


@_query
def q07_math_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paper_md(spark, sf_dir).select("doc_id", F.md5(math.wrap_environments(F.col("md"))).alias("digest"))


@_query
def q08_inline_subscript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paper_md(spark, sf_dir).select("doc_id", F.md5(math.wrap_subscripts(F.col("md"))).alias("digest"))


@_query
def q09_inline_greek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paper_md(spark, sf_dir).select("doc_id", F.md5(math.wrap_signs(F.col("md"))).alias("digest"))


@_query
def q10_inline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = math.wrap_number_first(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(first).alias("first_digest"), F.md5(math.wrap_number_last(first)).alias("digest"))


@_query
def q11_fence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within fences, with a fold in place of a window so that a document stays one row."""
    marks = F.transform(F.split("md", "\n", -1), lambda x: x.rlike(f"^{LINE_WS}*```"))
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n"))
    step = lambda acc, fence: F.struct((acc["inside"] != fence).alias("inside"), (acc["n"] + F.when(~fence & acc["inside"], 1).otherwise(0)).alias("n"))
    rows = paper_md(spark, sf_dir).select("doc_id", "md", marks.alias("marks"))
    outside = math.outside_code(F.col("md"), lambda x: F.lit(""))
    return rows.select("doc_id", F.size("marks").alias("n_lines"), F.size(F.filter("marks", lambda x: x)).alias("n_fences"), F.aggregate("marks", start, step, lambda acc: acc["n"]).alias("n_inside"), F.md5(outside).alias("fenced_digest"))


@_query
def q12_image_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paper_md(spark, sf_dir).select("doc_id", F.md5(math.replace_image_marks(F.col("md"), F.lit(1))).alias("digest"))


def _chunk_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("chunk_idx"))
    names = F.array(F.concat(F.lit("b"), F.col("chunk_idx").cast("string"), F.lit(".PNG")), F.lit("a.jpg"), F.lit("notes.txt"))
    md = F.when((F.col("doc_id") + F.col("chunk_idx")) % 4 == 0, "").otherwise("x")
    return rows.select("doc_id", "chunk_idx", md.alias("markdown"), F.explode(names).alias("name"))


@_query
def q13_image_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.renumbered(_chunk_images(spark, sf_dir)).select("doc_id", "chunk_idx", "name", "n", "new_name")


def _entries() -> Column:
    entry = lambda k, old: F.struct(F.lit(k).alias("ord"), old.alias("old"), F.lit(f"./assets/image_{k:03d}.png").alias("new"))
    return F.array(entry(1, F.lit("images/q.png")), entry(2, F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string"), F.lit(".png"))), entry(3, F.lit("figs/p6.png")))


def _rewritten(spark: SparkSession, sf_dir: str, rewrite) -> DataFrame:
    return paper_md(spark, sf_dir).select("doc_id", F.md5(rewrite(F.col("md"), _entries())).alias("digest"))


@_query
def q14_image_rewrite_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir, images.rewrite_in_chunk)


@_query
def q14_image_rewrite_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir, images.rewrite_from_api)


@_query
def q14_image_rewrite_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir, images.rewrite_from_cli)


def _pages() -> Column:
    return F.ceil(F.col("n_chars") / 3000).cast("int")


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.exploded_ranges(_table(spark, sf_dir, "documents").select("doc_id", _pages().alias("pages")))


@_query
def q15_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir)


def _devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("idx"), F.floor(F.abs("s_acctbal")).cast("int").alias("mem"), (F.col("s_suppkey") % 20).cast("int").alias("util"), F.col("s_suppkey").alias("scan_pos"))
    return paging.free_devices(rows)


@_query
def q16_gpu_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _devices(spark, sf_dir).where(F.col("gpu_pos") < paging.MOST_WORKERS).select("idx", "mem", "gpu_pos")


@_query
def q17_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _devices(spark, sf_dir).where(F.col("gpu_pos") < paging.MOST_WORKERS)
    return paging.assigned(_ranges(spark, sf_dir), chosen).select("doc_id", "chunk_idx", "gpu")


@_query
def q18_chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks, each with an image of its own."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_idx", "line"))
    name = F.concat(F.lit("f"), F.col("chunk_idx").cast("string"), F.lit(".png"))
    md = F.when(F.col("line") != "", F.concat(F.col("line"), F.lit(" ![]("), name, F.lit(")"))).otherwise("")
    merged = merging.merge_chunks(rows.select("doc_id", "chunk_idx", md.alias("markdown"), F.array(name, F.lit("x.txt")).alias("names")))
    return merged.select("doc_id", "n_chunks", F.col("n_images").cast("long"), "failed_chunks", "status", F.md5("markdown").alias("digest"))


@_query
def q19_dup_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _titles(spark, sf_dir)
    dirs = named.where("doc_id % 2 = 0").select(F.concat(F.when(F.col("doc_id") % 4 == 0, F.lit("20260131-")).otherwise(F.lit("")), "title").alias("dir_name"))
    known = dirs.select(catalog.title_key(F.col("dir_name")).alias("title_key"))
    incoming = named.select("doc_id", F.col("title").alias("title_key"))
    return catalog.split_duplicates(incoming, known, "doc_id").select("doc_id", "title_key", "is_duplicate")


@_query
def q20_frontmatter_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, _first_line()).otherwise("").alias("detected"), titles.sanitize_filename(_first_line()).alias("title"))
    shown = titles.display_title(F.col("detected"), F.col("title"))
    day = F.lit(fixtures.RUN_DATE).cast("date")
    return named.select("doc_id", F.md5(markdown.render_front_matter(shown, F.date_format(day, "yyyy-MM-dd"), F.lit("mineru"))).alias("digest"), F.concat(F.date_format(day, "yyyyMMdd"), F.lit("-"), "title").alias("folder"))


@_query
def q21_frontmatter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bodies(spark, sf_dir)
    return rows.select("doc_id", F.md5("front").alias("front_digest"), F.md5("body").alias("body_digest"), F.md5(markdown.with_language(F.col("front"), F.lit("Chinese"))).alias("language_digest"))


def _with_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bodies(spark, sf_dir).withColumn("heads", markdown.headings(F.col("body")))
    return rows.withColumn("parts", markdown.sections(F.col("heads"), F.size(lines(F.col("body")))))


@_query
def q22_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bodies(spark, sf_dir).select("doc_id", F.posexplode(markdown.headings(F.col("body"))).alias("h_idx", "h"))
    return rows.select("doc_id", "h_idx", "h.start_line", "h.end_line", "h.level", "h.heading_text")


@_query
def q23_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_sections(spark, sf_dir).select("doc_id", F.explode("parts").alias("p"))
    return rows.select("doc_id", "p.start_line", "p.level", "p.section_end")


@_query
def q24_strip_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_sections(spark, sf_dir)
    out = {mode: markdown.strip_references(F.col("body"), F.col("parts"), mode) for mode in ("reference", "fixed")}
    return rows.select("doc_id", *[F.md5(x).alias(f"{mode}_digest") for mode, x in out.items()], (out["reference"] != F.col("body")).alias("removed"))


@_query
def q25_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_sections(spark, sf_dir)
    rows = rows.select("doc_id", markdown.title_for_context(F.col("front"), F.col("heads")).alias("title"), markdown.abstract(F.col("body"), F.col("parts")).alias("abstract"))
    return rows.select("doc_id", F.md5("title").alias("title_digest"), F.md5("abstract").alias("abstract_digest"), F.md5(markdown.context(F.col("title"), F.col("abstract"))).alias("context_digest"))


def _counted(rows: DataFrame, key: str, text: str) -> DataFrame:
    counts = masking.mask_counts(F.col(text))
    return rows.select(key, *[c.cast("long").alias(name.lower()) for name, c in counts.items()])


@_query
def q26_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_bodies(spark, sf_dir), "doc_id", "body")


@_query
def q26_mask_counts_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_table(spark, sf_dir, "pages"), "page_id", "html")


@_query
def q27_mask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masking.with_masks(_bodies(spark, sf_dir).select("doc_id", "body"), "body")
    back = {q: F.md5(masking.unmask(F.col("masked"), F.col("spans"), q)).alias(f"{q}_digest") for q in ("fixed", "reference")}
    shown = F.concat_ws("\n", F.transform("spans", lambda s: F.concat_ws(" ", s["placeholder"], s["original"])))
    return rows.select("doc_id", F.md5("masked").alias("masked_digest"), F.size("spans").cast("long").alias("n_spans"), F.md5(shown).alias("spans_digest"), *back.values())


@_query
def q28_greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.greedy_chunks(text, 3000)).alias("chunk_idx", "chunk"))
    return rows.select("doc_id", "chunk_idx", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@_query
def q29_skip_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of natively masked text."""
    text = F.col("body")
    for name, pattern, _ in masking.PATTERNS:
        text = replace(text, masking.java(pattern), f"⟦{name}⟧")
    rows = _bodies(spark, sf_dir).select("doc_id", chunking.paragraphs(text).alias("parts"))
    return rows.select("doc_id", F.size("parts").alias("n_parts"), F.size(F.filter("parts", masking.mostly_masked)).alias("n_skipped"))


@_query
def q30_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("Title: "), F.col("role")))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", results.messages(F.col("text"), F.lit("Chinese"), about).alias("m"))
    return rows.select("conv_id", "turn", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.md5(F.element_at("m", -1)["content"]).alias("digest"), F.size("m").alias("n"))


@_query
def q31_translate_pseudo(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = paper_md(spark, sf_dir).withColumnRenamed("md", "markdown")
    out = translate(docs, "doc_id", "Chinese", "upper", quirks="fixed")
    return out.select("doc_id", "success", "removed_refs", "n_chunks", "n_skipped", F.md5("translated").alias("digest"))


@_query
def q32_result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titles(spark, sf_dir)
    good = results.ingest_record(F.concat(F.lit("20260131-"), F.col("title")), F.lit("mineru"), F.col("title"), F.lit(fixtures.RUN_DATE))
    bad = results.error_record(results.duplicate_message(F.col("title")), F.when(F.col("doc_id") % 4 == 1, F.lit(results.DUPLICATE_SUGGESTION)))
    record = F.when(F.col("doc_id") % 2 == 0, good).otherwise(bad)
    fields = ("status", "markdown_path", "engine_used", "title", "date", "paper_dir", "message", "suggestion")
    return rows.select("doc_id", record.alias("r")).select("doc_id", *[F.get_json_object("r", f"$.{f}").alias(f) for f in fields])


@_query
def q33_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", results.throughput(_pages(), (F.col("doc_id") % 7).cast("double")).alias("pages_per_second"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    image = F.base64(F.concat(F.lit("image "), n).cast("binary"))
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))
    md = F.concat(F.lit("![a](1.png) ![b](images/3.jpg) "), "text")
    body = F.concat(F.lit('{"md_content":'), F.regexp_extract(quoted(md), r'(?s)^\{"v":(.*)\}$', 1), F.lit(',"images":{"1.png":"data:image/png;base64,'), image, F.lit('","2.png":"broken","3":"data:image/jpeg;base64,'), image, F.lit('"}}'))
    key = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("paper_"), n)).otherwise(F.lit("zz"))
    other = F.when(F.col("doc_id") % 3 == 1, F.lit('"first":{"md_content":"only","images":{}},')).otherwise(F.lit(""))
    reply = F.concat(F.lit('{"backend":"b","version":"1","results":{'), other, F.lit('"'), key, F.lit('":'), body, F.lit("}}"))
    return _table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply"))


@_query
def q34_api_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apiresult.decode_reply(_replies(spark, sf_dir), "reply", F.concat(F.lit("paper_"), F.col("doc_id").cast("string")))
    return out.select("doc_id", "api_stem", F.md5("api_md").alias("digest"), F.size("api_images").alias("n_images"), F.array_join(F.transform("api_images", lambda x: x["new_name"]), ",").alias("names"), F.decode(F.get("api_images", 0)["bytes"], "UTF-8").alias("first_bytes"), "api_error")


@_query
def q35_ingestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestion end to end: the Markdown view of all documents against the folders of some."""
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select(F.concat(F.lit("/data/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".pdf")).alias("source"), F.expr(fixtures.PAPER_MD).alias("markdown"), F.when(F.col("doc_id") % 5 != 0, _candidate_title()).alias("detected_title"), F.lit(None).cast("string").alias("meta_title"))
    existing = _titles(spark, sf_dir).where("doc_id % 4 = 0").select(F.concat(F.lit("20260130-"), "title").alias("dir_name"))
    out = ingest(rows, existing, F.lit(fixtures.RUN_DATE).cast("date"))
    return out.select("source", "title_key", "status", "paper_dir", F.md5("full_text").alias("text_digest"), "record")
