"""``python -m paperloom.cli ingest|translate``: the pipelines over files, with one JSON line for each document."""

from __future__ import annotations

import argparse
import datetime
import json
import os
import sys
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import titles
from .operators import results
from .plans import backends, engines
from .plans.ingest import ingest, planned_writes
from .plans.translate import translate
from .sources import files, paperdir


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="paperloom")
    kinds = out.add_subparsers(dest="command", required=True)
    one = kinds.add_parser("ingest")
    one.add_argument("pdf_source", help="a folder of papers, one file, or an address")
    one.add_argument("--engine", choices=sorted(engines.ENGINES), default=engines.DEFAULT)
    one.add_argument("--output-dir", "-o", default=".")
    one.add_argument("--images-scale", type=float, default=4.0)
    one.add_argument("--devices", default=os.environ.get("CUDA_VISIBLE_DEVICES"), help="devices for ranges of pages; by default this machine's free ones")
    one.add_argument("--force", action="store_true")
    two = kinds.add_parser("translate")
    two.add_argument("input_file", help="a Markdown file, or a folder of them")
    two.add_argument("--backend", choices=sorted(backends.BACKENDS), default=backends.DEFAULT)
    two.add_argument("--target-lang", default="Chinese")
    two.add_argument("--env-file", default=".env", help="KEY=VALUE lines of settings; the environment's win")
    two.add_argument("--output", help="a folder for the translations; by default beside each file")
    return out


def _is_url(source: str) -> bool:
    return source.lower().startswith(("http:", "https:"))


def _kept(df: DataFrame) -> DataFrame:
    """``df``, computed once: written and reported rows must not be looked for again among the folders that they made."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()


def _refused(path: str, suffix: str, kind: str) -> str | None:
    """Why a path can't be read, if it can't: a file must end in ``suffix``, a folder may hold other files."""
    from pyarrow import fs

    store, at = paperdir.store_of(path)
    found = store.get_file_info(at).type
    if found == fs.FileType.NotFound:
        return f"File not found: {path}"
    return f"Not a {kind} file: {path}" if found == fs.FileType.File and not path.lower().endswith(suffix) else None


def _errors(spark: SparkSession, message: str) -> Iterator[str]:
    yield spark.range(1).select(results.error_record(F.lit(message))).first()[0]


def _read(spark: SparkSession, args: argparse.Namespace, get: Callable) -> DataFrame:
    """(source, path, content, error) of what is to be ingested."""
    if _is_url(args.pdf_source):
        return files.downloads(spark.createDataFrame([(args.pdf_source,)], "source string"), get=get)
    if args.engine == "passthrough":
        read = files.markdown(spark, args.pdf_source).select("path", F.col("markdown").cast("binary").alias("content"))
    else:
        read = files.pdfs(spark, args.pdf_source).select("path", "content")
    return read.select(F.col("path").alias("source"), "content", F.lit(None).cast("string").alias("error"), "path")


def _ingest(args: argparse.Namespace, spark: SparkSession, get: Callable) -> Iterator[str]:
    began = time.time()
    suffix, kind = (".md", "Markdown") if args.engine == "passthrough" else (".pdf", "PDF")
    refused = None if _is_url(args.pdf_source) else _refused(args.pdf_source, suffix, kind)
    if refused:
        yield from _errors(spark, refused)
        return
    read = _read(spark, args, get).withColumnRenamed("error", "read_error")
    if args.engine != "passthrough":
        read = engines.with_pdf_facts(read)
    else:
        read = read.withColumns({"page_count": F.lit(0), "meta_title": F.lit(None).cast("string")})
    used = engines.devices(spark, args.devices) if args.engine == "mineru" else ()
    converted = engines.convert(read.where("read_error is null"), args.engine, engines.Options(images_scale=args.images_scale, devices=used))
    content = [] if args.engine == "passthrough" else ["content"]
    every = converted.select("source", "markdown", "detected_title", "meta_title", "images", "mode", "page_count", F.col("error").alias("failed"), *content)
    unread = read.where("read_error is not null").select("source", F.col("read_error").alias("failed"))
    every = _kept(every.unionByName(unread, allowMissingColumns=True))
    existing = spark.read.format("paperdir").load(args.output_dir)
    done = _kept(ingest(every.where("failed is null").drop("failed"), existing, F.lit(datetime.date.today()), args.engine, force=args.force))
    planned_writes(done).write.format("paperdir").mode("append").save(args.output_dir)
    for line in results.summary(every, args.engine, time.time() - began).collect():  # a row for each mode
        print(line.asDict(), file=sys.stderr)
    failed = every.where("failed is not null").select(results.error_record(F.col("failed")).alias("record"))
    for row in done.select("record").union(failed).toLocalIterator():
        yield row["record"]


def _translate(args: argparse.Namespace, spark: SparkSession) -> Iterator[str]:
    began = time.time()
    refused = _refused(args.input_file, ".md", "Markdown")
    if refused:
        yield from _errors(spark, refused)
        return
    known = dict(os.environ)
    if _refused(args.env_file, "", "") is None:
        known = files.settings(spark, args.env_file, known)
    try:
        done = translate(files.markdown(spark, args.input_file), "path", args.target_lang, args.backend, settings=known)
    except ValueError as e:
        yield from _errors(spark, f"Failed to initialize backend: {e}")
        return
    name = F.concat(titles.path_stem(F.col("path")), F.lit("_"), titles.output_suffix(F.lit(args.target_lang)), F.lit(".md"))
    named = _kept(done.withColumn("name", name))
    root = args.output or (args.input_file.rpartition("/")[0] or "." if args.input_file.endswith(".md") else args.input_file)
    named.where("success").select(F.col("name").alias("path"), F.col("translated").cast("binary").alias("content"), F.lit(False).alias("only_if_missing")).write.format("paperdir").mode("append").save(root)
    good = results.translate_record(F.concat(F.lit(f"{root}/"), F.col("name")), F.lit(args.backend), F.lit(args.target_lang), F.lit(time.time() - began))
    for row in named.select(F.when(F.col("success"), good).otherwise(results.error_record(F.col("error"))).alias("record")).toLocalIterator():
        yield row["record"]


def run(args: argparse.Namespace, spark: SparkSession, get: Callable = files.fetch) -> Iterator[str]:
    """One JSON record for each document, as they come; elapsed seconds are those of the run. ``get`` fetches addresses."""
    paperdir.register(spark)
    return _ingest(args, spark, get) if args.command == "ingest" else _translate(args, spark)


def main() -> None:
    spark = SparkSession.builder.appName("paperloom").getOrCreate()
    failed = False
    for line in run(parser().parse_args(), spark):
        print(line)
        failed |= json.loads(line)["status"] == "error"
    sys.exit(int(failed))


if __name__ == "__main__":
    main()
