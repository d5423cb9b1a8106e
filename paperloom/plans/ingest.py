"""Ingestion of converted papers: text normalised, titled, checked for duplicates, laid out as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown, math, titles
from ..operators import catalog, results


def normalized(converted: DataFrame, md: str = "markdown", quirks: str = "reference") -> DataFrame:
    """``md`` with delimiters normalised and inline mathematics wrapped, in two steps so that neither is computed twice."""
    out = converted.withColumn(md, math.normalize_delimiters(F.col(md)))
    return out.withColumn(md, math.wrap_inline(F.col(md), quirks))


def titled(rows: DataFrame, quirks: str = "reference") -> DataFrame:
    """Rows (markdown, detected_title, meta_title, source) with title and title_key."""
    source = F.col("source")
    out = rows.withColumn("title", titles.resolve_title(F.col("detected_title"), F.col("markdown"), F.col("meta_title"), source, titles.is_url(source)))
    key = titles.sanitize_filename(F.col("title"), quirks)
    return out.withColumn("title_key", key if quirks == "reference" else F.coalesce(F.nullif(key, F.lit("")), F.lit(titles.UNTITLED)))


def ingest(rows: DataFrame, existing: DataFrame, run_date: Column, engine: str = "mineru", order: str = "source", force: bool = False, quirks: str = "reference") -> DataFrame:
    """Rows (source, markdown, detected_title, meta_title) with title, paper_dir, full_text, notes, status, message, suggestion and record.

    ``existing``: folders that are there, (dir_name). ``run_date`` is given, so that a run can be repeated.
    """
    known = existing.select(catalog.title_key(F.col("dir_name")).alias("title_key"))
    out = catalog.split_duplicates(titled(normalized(rows, quirks=quirks), quirks), known, order, force)
    day = F.date_format(run_date, "yyyy-MM-dd")
    name = F.concat(F.date_format(run_date, "yyyyMMdd"), F.lit("-"), F.col("title_key"))
    shown = titles.display_title(F.col("title"), F.col("title_key"))
    out = out.withColumn("paper_dir", name).withColumn("full_text", F.concat(markdown.render_front_matter(shown, day, F.lit(engine), quirks), F.col("markdown")))
    out = out.withColumn("notes", F.concat(F.lit("# Notes: "), shown, F.lit("\n\n")))
    message = F.when(F.col("is_duplicate"), results.duplicate_message(F.col("title_key")))
    good = results.ingest_record(F.col("paper_dir"), F.lit(engine), F.col("title_key"), day)
    bad = results.error_record(message, F.lit(results.DUPLICATE_SUGGESTION))
    return out.select("*", F.when(message.isNull(), "success").otherwise("error").alias("status"), message.alias("message"), F.when(message.isNotNull(), F.lit(results.DUPLICATE_SUGGESTION)).alias("suggestion"), F.when(message.isNull(), good).otherwise(bad).alias("record"))


def planned_writes(ingested: DataFrame) -> DataFrame:
    """(path, content, only_if_missing) of what an ingested batch writes; ``sources.paperdir`` writes it."""
    good = ingested.where("status = 'success'")
    file = lambda name, content, once: F.struct(F.concat("paper_dir", F.lit("/" + name)).alias("path"), content.alias("content"), F.lit(once).alias("only_if_missing"))
    files = [file("full_text.md", F.col("full_text").cast("binary"), False), file("notes.md", F.col("notes").cast("binary"), True)]
    if "content" in ingested.columns:
        files.append(file("reference.pdf", F.col("content"), False))
    out = good.select(F.explode(F.array(*files)).alias("f")).select("f.*")
    if "images" in ingested.columns:
        assets = good.select("paper_dir", F.explode("images").alias("i")).select(F.concat("paper_dir", F.lit("/assets/"), F.col("i.name")).alias("path"), F.col("i.bytes").alias("content"), F.lit(False).alias("only_if_missing"))
        out = out.union(assets)
    return out
