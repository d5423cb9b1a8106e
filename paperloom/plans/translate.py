"""Translation of Markdown documents, structure kept."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dialect import lines
from ..functions import chunking, markdown, masking
from ..operators.results import messages
from . import backends

#: Fixed value: calls of a backend at once.
CALLS = 10


def prepared(docs: DataFrame, md: str = "markdown", quirks: str = "reference", references: bool = True) -> DataFrame:
    """``docs`` with front, body (references stripped), removed_refs, context, masked text and its spans."""
    out = docs.withColumn("front", markdown.front_matter(F.col(md))).withColumn("_body", markdown.body(F.col(md)))
    if references:
        out = out.withColumn("_parts", markdown.sections(markdown.headings(F.col("_body")), F.size(lines(F.col("_body")))))
        out = out.withColumn("body", markdown.strip_references(F.col("_body"), F.col("_parts"), quirks))
    else:
        out = out.withColumn("body", F.col("_body"))
    out = out.withColumn("removed_refs", F.col("body") != F.col("_body"))
    out = out.withColumn("_heads", markdown.headings(F.col("body")))
    out = out.withColumn("_sections", markdown.sections(F.col("_heads"), F.size(lines(F.col("body")))))
    about = markdown.context(markdown.title_for_context(F.col("front"), F.col("_heads"), quirks), markdown.abstract(F.col("body"), F.col("_sections"), quirks))
    out = out.withColumn("context", about).drop("_body", "_parts", "_heads", "_sections")
    return masking.with_masks(out, "body")


def chunks(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, context, chunk_idx, chunk, skip, about) of prepared documents; about: what is known of a document, with its first chunk alone."""
    about = F.to_json(F.struct("front", "spans", "removed_refs"))
    out = rows.select(key, "context", about.alias("about"), F.posexplode(chunking.greedy_chunks(F.col("masked"), limit)).alias("chunk_idx", "chunk"))
    return out.withColumn("about", F.when(F.col("chunk_idx") == 0, F.col("about"))).withColumn("skip", masking.mostly_masked(F.col("chunk")))


def call(rows: DataFrame, key: str, make, key_type: str) -> DataFrame:
    """(key, chunk_idx, skip, about, text, success, error): one backend for each partition's iterator, CALLS calls at once. Chunks to skip are their own text."""
    names = [key, "chunk_idx", "skip", "about"]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        with ThreadPoolExecutor(CALLS) as pool:
            for batch in batches:
                todo = batch[~batch["skip"]]
                asked = [[{"role": m["role"], "content": m["content"]} for m in ms] for ms in todo["messages"]]
                found = dict(zip(todo.index, pool.map(backend.translate, asked, todo["chunk"]), strict=True))
                out = [(found[k].text, found[k].success, found[k].error) if k in found else (t, True, None) for k, t in batch["chunk"].items()]
                yield batch[names].assign(text=[x[0] for x in out], success=[x[1] for x in out], error=[x[2] for x in out])

    return rows.select(*names, "chunk", "messages").mapInPandas(step, f"{key} {key_type}, chunk_idx int, skip boolean, about string, text string, success boolean, error string")


def translate(docs: DataFrame, key: str, target_lang: str = "Chinese", backend: str = backends.DEFAULT, md: str = "markdown", quirks: str = "reference", tasks: int | None = None, settings: Mapping[str, str] | None = None) -> DataFrame:
    """(key, translated, success, error, removed_refs, n_chunks, n_skipped) of documents (key, md); keys are unique.

    Only chunks with something to translate reach the backend; the others pass by it. A document
    is parsed and masked once: what is known of it goes with its first chunk. ``tasks`` bounds
    the calls at once, CALLS for each. The first failed chunk, by its place, fails its document.
    """
    make, limit = backends.backend(backend, settings)
    ready = prepared(docs.select(key, md), md, quirks)
    key_type = ready.schema[key].dataType.simpleString()
    parts = chunks(ready, key, limit)
    asked = parts.repartition(tasks, key, "chunk_idx") if tasks else parts.repartition(key, "chunk_idx")
    asked = asked.withColumn("messages", F.when(~F.col("skip"), messages(F.col("chunk"), F.lit(target_lang), F.col("context"))))
    every = call(asked, key, make, key_type)
    known = T.StructType([f for f in ready.schema if f.name in ("front", "spans", "removed_refs")])
    pairs = F.array_sort(F.collect_list(F.struct("chunk_idx", F.col("text").alias("t"))))
    whole = every.groupBy(key).agg(
        F.array_join(F.transform(pairs, lambda x: x["t"]), "\n\n").alias("_text"),
        F.bool_or(F.col("text").isNull()).alias("_missing"),
        F.min_by(F.when(~F.col("success"), F.coalesce("error", F.lit(""))), F.when(~F.col("success"), F.col("chunk_idx"))).alias("_error"),
        F.count("*").alias("n_chunks"),
        F.count_if("skip").alias("n_skipped"),
        F.max("about").alias("about"),
    )
    out = whole.withColumn("about", F.from_json("about", known.simpleString())).select("*", "about.*")
    error = F.coalesce("_error", F.when(F.col("_missing"), F.lit("Translation failed: missing chunk results.")))
    body = masking.unmask(F.col("_text"), F.col("spans"), quirks)
    front = markdown.with_language(F.col("front"), F.lit(target_lang), quirks)
    text = F.when(F.col("front").isNotNull(), F.concat(front, F.lit("\n"), body)).otherwise(body)
    return out.select(key, F.when(error.isNull(), text).otherwise(F.lit("")).alias("translated"), error.isNull().alias("success"), error.alias("error"), "removed_refs", "n_chunks", "n_skipped")
