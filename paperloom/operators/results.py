"""Result records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ingest_record(paper_dir: Column, engine: Column, title: Column, date: Column) -> Column:
    fields = (F.lit("success").alias("status"), F.concat(paper_dir, F.lit("/full_text.md")).alias("markdown_path"), engine.alias("engine_used"), title.alias("title"), date.alias("date"), paper_dir.alias("paper_dir"))
    return F.to_json(F.struct(*fields))


def translate_record(path: Column, backend: Column, language: Column, elapsed: Column) -> Column:
    fields = (F.lit("success").alias("status"), path.alias("output_path"), backend.alias("backend"), language.alias("target_lang"), F.round(elapsed, 1).alias("elapsed_seconds"))
    return F.to_json(F.struct(*fields))


def error_record(message: Column, suggestion: Column | None = None) -> Column:
    """A NULL suggestion isn't in the record."""
    suggestion = F.lit(None).cast("string") if suggestion is None else suggestion
    return F.to_json(F.struct(F.lit("error").alias("status"), message.alias("message"), suggestion.alias("suggestion")))


def duplicate_message(title: Column) -> Column:
    return F.concat(F.lit("Duplicate detected: A folder with title '"), title, F.lit("' already exists"))


DUPLICATE_SUGGESTION = "Remove the existing folder or rename if you want to re-ingest"


def throughput(pages: Column, seconds: Column) -> Column:
    """Pages a second, to two places; NULL unless both are positive."""
    return F.when((pages > 0) & (seconds > 0), F.round(pages / seconds, 2))


def summary(converted: DataFrame, engine: str, seconds: float) -> DataFrame:
    """A row for each mode of conversion (mode, page_count, failed): documents, failed ones, pages, the run's seconds and pages a second."""
    out = converted.groupBy("mode").agg(F.count("*").alias("documents"), F.count("failed").alias("failed"), F.sum("page_count").cast("long").alias("pages"))
    spent = F.lit(seconds)
    return out.select(F.lit(engine).alias("engine"), "mode", "documents", "failed", "pages", F.round(spent, 2).alias("seconds"), throughput(F.col("pages"), spent).alias("pages_per_second"))


def shortened(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def messages(chunk: Column, language: Column, about: Column) -> Column:
    """A chat's messages: what the document is about, if known; the instruction; the chunk."""
    instruction = F.concat(
        F.lit("You translate academic writing. Translate the user's text to "),
        language,
        F.lit(". Keep Markdown, formulas, citations, link targets, code, names and placeholders such as ⟦TYPE_1⟧ exactly as they are, keep line and paragraph breaks, and answer with the translation alone."),
    )
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    known = F.when(about.isNotNull(), message("system", F.concat(F.lit("Paper context (for reference only):\n"), about)))
    return F.array_compact(F.array(known, message("system", instruction), message("user", chunk)))
