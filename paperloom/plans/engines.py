"""Conversion engines: bytes of a PDF to Markdown and images.

An engine is made once for each Python worker's iterator, by a maker that gets the options, and is
a function (path, content) -> dict with some of markdown, title, images, reply, error; it must not
raise. The neural engines are programs and services of their own and are called where they are
installed; ``passthrough`` reads bytes that are Markdown already, for use offline. What they give
is made one by ``convert``: images numbered, references to them rewritten, all by DataFrame functions.
"""

from __future__ import annotations

import io
import os
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import images as I
from ..functions import math, titles
from ..operators import apiresult, merging, paging
from ..sources import files

Engine = Callable[[str, bytes], dict]
IMAGES = "array<struct<name:string,bytes:binary>>"

# Seconds for a whole document and for a range of its pages.
WHOLE_TIMEOUT, RANGE_TIMEOUT = 600, 300


@dataclass(frozen=True)
class Options:
    """``devices``: those that ranges of a document's pages are dealt out to; with one or none documents are converted whole."""

    images_scale: float = 4.0
    devices: tuple[str, ...] = ()
    host: str = os.environ.get("MINERU_API_HOST", "127.0.0.1")
    port: int = int(os.environ.get("MINERU_API_PORT", "8000"))


def passthrough(path: str, content: bytes) -> dict:
    try:
        return {"markdown": content.decode("utf-8")}
    except UnicodeDecodeError:
        return {"error": "not UTF-8 Markdown"}


def _collected(folder: Path, stem: str) -> dict:
    """The Markdown file named like the document, or the first, and the images beside it, in order of name."""
    found = sorted(folder.rglob("*.md"), key=lambda p: (p.stem != stem, str(p)))
    if not found:
        return {"error": "MinerU produced no markdown output"}
    images = sorted(p for p in (found[0].parent / "images").glob("*") if p.suffix.lower() in I.EXTENSIONS)
    return {"markdown": found[0].read_text("utf-8"), "images": [{"name": p.name, "bytes": p.read_bytes()} for p in images]}


def mineru(path: str, content: bytes, device: str | None = None, timeout: int = WHOLE_TIMEOUT) -> dict:
    """The ``mineru`` program, on one device."""
    with tempfile.TemporaryDirectory() as folder:
        source, out = Path(folder, Path(path).name), Path(folder, "out")
        source.write_bytes(content)
        env = os.environ | {"MINERU_HYBRID_BATCH_RATIO": "8"} | ({"CUDA_VISIBLE_DEVICES": device} if device else {})
        try:
            done = subprocess.run(["mineru", "-p", str(source), "-o", str(out), "-b", "hybrid-auto-engine", "-l", "en"], env=env, capture_output=True, text=True, timeout=timeout)
            return _collected(out, source.stem) if done.returncode == 0 else {"error": f"MinerU conversion failed: {done.stderr[:500]}"}
        except subprocess.TimeoutExpired:
            return {"error": f"MinerU conversion timed out (>{timeout // 60} minutes)"}
        except FileNotFoundError:
            return {"error": "MinerU command not found"}
        except (OSError, UnicodeDecodeError) as e:
            return {"error": f"MinerU conversion failed: {e}"}


def docling(options: Options = Options(), converter=None) -> Engine:
    """The ``docling`` library, where it is installed; its converter, and with it its models, is made once."""

    def run(path: str, content: bytes) -> dict:
        nonlocal converter
        try:
            if converter is None:
                from docling.datamodel.base_models import InputFormat
                from docling.datamodel.pipeline_options import PdfPipelineOptions
                from docling.document_converter import DocumentConverter, PdfFormatOption

                asked = PdfPipelineOptions(generate_picture_images=True, generate_table_images=True, do_formula_enrichment=True, images_scale=options.images_scale)
                converter = DocumentConverter(format_options={InputFormat.PDF: PdfFormatOption(pipeline_options=asked)})
        except ImportError as e:
            return {"error": f"Docling import failed: {e}"}
        try:
            with tempfile.TemporaryDirectory() as folder:
                source = Path(folder, Path(path).name)
                source.write_bytes(content)
                doc = converter.convert(str(source)).document
                return {"markdown": doc.export_to_markdown(image_mode="referenced"), "title": getattr(doc, "name", None) or None, "images": _pictures(doc)}
        except Exception as e:  # one bad document must not end the job
            return {"error": f"Docling conversion failed: {e}"}

    return run


def _pictures(doc) -> list[dict]:
    out = []
    for picture in getattr(doc, "pictures", None) or []:
        if getattr(picture, "image", None):
            stream = io.BytesIO()
            picture.image.pil_image.save(stream, format="PNG")
            out.append({"name": f"{len(out):06d}.png", "bytes": stream.getvalue()})
    return out


# The fields of a conversion service's form.
FORM = {"backend": "hybrid-auto-engine", "parse_method": "auto", "lang_list": "en", "return_md": "true", "return_images": "true", "formula_enable": "true", "table_enable": "true"}


def service(path: str, content: bytes, host: str = "127.0.0.1", port: int = 8000, post: Callable | None = None) -> dict:
    """A conversion service's ``reply``; ``operators.apiresult`` decodes it."""
    try:
        if post is None:
            import requests

            post = requests.post
        reply = post(f"http://{host}:{port}/file_parse", files={"files": (Path(path).name, content, "application/pdf")}, data=FORM, timeout=WHOLE_TIMEOUT)
        return {"reply": reply.text} if reply.status_code == 200 else {"error": f"API error: {reply.status_code} - {reply.text[:200]}"}
    except Exception as e:  # a failed service is no end: the program is tried
        return {"error": str(e)}


def _usable(found: dict, path: str) -> dict:
    """A reply without Markdown counts as failed."""
    import json

    if "reply" not in found:
        return found
    try:
        results = json.loads(found["reply"]).get("results") or {}
        picked = results.get(Path(path).stem) or next(iter(results.values()), None) or {}
        return found if picked.get("md_content") else {"error": "the service returned no content"}
    except (ValueError, AttributeError) as e:
        return {"error": str(e)}


def service_is_up(host: str = "127.0.0.1", port: int = 8000, get: Callable | None = None) -> bool:
    try:
        if get is None:
            import requests

            get = requests.get
        return get(f"http://{host}:{port}/docs", timeout=2).status_code == 200
    except Exception:
        return False


def chain(*engines: Engine) -> Engine:
    """The first engine that gives no error."""

    def run(path: str, content: bytes) -> dict:
        out: dict = {"error": "no engine"}
        for engine in engines:
            out = engine(path, content)
            if not out.get("error"):
                break
        return out

    return run


def served(options: Options, post: Callable | None = None, get: Callable | None = None) -> Engine | None:
    """The service as an engine, if it is up."""
    if service_is_up(options.host, options.port, get):
        return lambda path, content: _usable(service(path, content, options.host, options.port, post), path)
    return None


def _service_first(options: Options) -> Engine:
    """The service if it is up, and the program for what it fails on."""
    device = options.devices[0] if options.devices else None
    program = lambda path, content: mineru(path, content, device)
    first = served(options)
    return chain(first, program) if first else program


#: Name to maker.
ENGINES: dict[str, Callable[[Options], Engine]] = {"mineru": _service_first, "docling": docling, "passthrough": lambda options: passthrough}
DEFAULT = "mineru"
RESULT = f"markdown string, title string, images {IMAGES}, reply string, error string"


def _run(rows: DataFrame, begin: Callable[[], Callable[..., dict]], inputs: list[str], drop: list[str] | None = None) -> DataFrame:
    """``rows``, all columns but ``drop``, with RESULT of ``begin()`` applied to ``inputs``; a bad row has an error."""
    kept = [f for f in rows.schema if f.name not in (drop or [])]
    result = T.StructType.fromDDL(RESULT)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = begin()
        for batch in batches:
            found = [engine(*x) for x in zip(*(batch[c] for c in inputs), strict=True)]
            out = {f.name: [x.get(f.name) for x in found] for f in result}
            out["images"] = [x or [] for x in out["images"]]
            yield batch[[f.name for f in kept]].assign(**out)

    return rows.mapInPandas(step, T.StructType([*kept, *result]))


def convert(pdfs: DataFrame, engine: str = DEFAULT, options: Options = Options(), program: Callable[..., dict] = mineru) -> DataFrame:
    """``pdfs`` (path, content, ...), all columns, with markdown, detected_title, images (name, bytes), mode and error.

    Images are named as they are written, and the Markdown refers to them so. A bad document is a
    row with an error and no Markdown. With several devices ranges of pages are converted apart;
    paths are unique then, and ``pdfs`` may have page_count. ``program`` converts a range.
    """
    if engine not in ENGINES:
        raise ValueError(f"Unknown engine: {engine}. Available: {sorted(ENGINES)}")
    if engine == "mineru" and len(options.devices) > 1:
        return _in_ranges(pdfs, options, program)
    make = ENGINES[engine]
    found = _run(pdfs, lambda: (lambda run: lambda path, content: run(path, bytes(content or b"")))(make(options)), ["path", "content"])
    return _finished(found, pdfs.columns, engine)


def _numbered(images: Column) -> Column:
    """(ord, old, name, bytes) of images in their order."""
    return F.transform(images, lambda x, i: F.struct((i + 1).cast("int").alias("ord"), x["name"].alias("old"), math.image_name((i + 1).cast("int"), I.extension(x["name"])).alias("name"), x["bytes"].alias("bytes")))


def _finished(found: DataFrame, columns: list[str], engine: str) -> DataFrame:
    """Documents converted whole: a service's replies decoded, images numbered, references to them rewritten."""
    out = apiresult.decode_reply(found.withColumn("_n", _numbered(F.col("images"))), "reply", titles.path_stem(F.col("path")))
    entries = F.transform("_n", lambda x: F.struct(x["ord"].alias("ord"), F.concat(F.lit("images/"), x["old"]).alias("old"), F.concat(F.lit("./assets/"), x["name"]).alias("new")))
    own = {"docling": math.replace_image_marks(F.col("markdown"), F.size("_n")), "passthrough": F.col("markdown")}.get(engine, I.rewrite_from_cli(F.col("markdown"), entries))
    replied = F.col("reply").isNotNull()
    named = lambda c, name: F.transform(c, lambda x: F.struct(x[name].alias("name"), x["bytes"].alias("bytes")))
    error = F.coalesce("error", F.when(replied, F.col("api_error")))
    out = out.select(
        *columns,
        F.when(error.isNull(), F.when(replied, F.col("api_md")).otherwise(own)).alias("markdown"),
        "title",
        F.when(replied, named("api_images", "new_name")).otherwise(named("_n", "name")).alias("images"),
        F.when(replied, "api").otherwise("cli").alias("mode"),
        error.alias("error"),
    )
    return _titled(out, columns, engine)


def _titled(out: DataFrame, columns: list[str], engine: str) -> DataFrame:
    title = titles.markdown_title(F.col("markdown")) if engine == "mineru" else F.col("title")
    return out.select(*columns, "markdown", title.alias("detected_title"), "images", "mode", "error")


def page_range(content: bytes, start: int, end: int) -> bytes:
    """A PDF of the pages ``start`` to ``end``, inclusive, by the pypdf library."""
    from pypdf import PdfReader, PdfWriter

    reader, writer, out = PdfReader(io.BytesIO(content)), PdfWriter(), io.BytesIO()
    for k in range(start, end + 1):
        writer.add_page(reader.pages[k])
    writer.write(out)
    return out.getvalue()


def _in_ranges(pdfs: DataFrame, options: Options, program: Callable[..., dict], cut: Callable[[bytes, int, int], bytes] = page_range) -> DataFrame:
    """Documents that the service, if it is up, doesn't convert are cut into ranges of pages, one for each of a few devices, dealt out in turn and merged.

    A range's row has the whole document's bytes until it is cut, so a document's bytes are moved
    MOST_WORKERS times at most. Ranges that fail are left out; without any the document has an error.
    """
    rows = pdfs if "page_count" in pdfs.columns else with_pdf_facts(pdfs).drop("meta_title")
    columns = pdfs.columns
    rows = _run(rows, lambda: (lambda run: lambda path, content: run(path, bytes(content or b"")) if run else {})(served(options)), ["path", "content"])
    workers = paging.worker_count(F.lit(len(options.devices)), F.col("page_count"))
    whole = F.array(F.struct(F.lit(0).alias("chunk_idx"), F.lit(0).alias("start_page"), F.lit(-1).alias("end_page")))
    ranges = F.when(F.col("_reply").isNotNull() | (workers <= 1), whole).otherwise(paging.page_ranges(F.col("page_count"), workers))
    rows = rows.drop("markdown", "title", "images", "error").withColumnRenamed("reply", "_reply").withColumn("_r", F.explode(ranges)).select("*", "_r.*").drop("_r")
    rows = rows.withColumn("_device", F.element_at(F.array(*map(F.lit, options.devices)), F.col("chunk_idx") % len(options.devices) + 1))

    def begin():
        def one(path: str, content, reply: str | None, start: int, end: int, device: str) -> dict:
            if reply is not None:
                return {}
            if end < 0:
                return program(path, bytes(content or b""), device)
            try:
                return program(path, cut(bytes(content), start, end), device, RANGE_TIMEOUT)
            except Exception as e:  # a document that can't be cut is a row's error
                return {"error": str(e)}

        return one

    done = _run(rows.repartition("path", "chunk_idx"), begin, ["path", "content", "_reply", "start_page", "end_page", "_device"])
    same = [c for c in columns if c != "path"]
    one = F.col("end_page") < 0
    parts = done.select(F.col("path").alias("doc_id"), "chunk_idx", F.coalesce(F.when(F.col("error").isNull(), F.col("markdown")), F.lit("")).alias("markdown"), "images", one.alias("whole"), "_reply", F.col("error").alias("_error"), F.when(F.col("chunk_idx") == 0, F.struct(*same)).alias("_same"))
    merged = merging.merge_chunks(parts, images=True, keep=["_reply", "_error", "_same"]).withColumn("path", F.col("doc_id"))
    replied = F.col("_reply").isNotNull()
    out = apiresult.decode_reply(merged, "_reply", titles.path_stem(F.col("path")))
    error = F.when(replied, F.col("api_error")).when(F.col("status") == "error", F.when(F.col("n_chunks") == 1, F.coalesce("_error", "message")).otherwise(F.col("message")))
    api = F.transform("api_images", lambda x: F.struct(x["new_name"].alias("name"), x["bytes"].alias("bytes")))
    out = out.select("path", *[F.col(f"_same.{c}").alias(c) for c in same], F.when(error.isNull(), F.when(replied, F.col("api_md")).otherwise(F.col("markdown"))).alias("markdown"), F.when(replied, api).otherwise(F.col("images")).alias("images"), F.when(replied, "api").otherwise("cli").alias("mode"), error.alias("error"), F.lit(None).cast("string").alias("title"))
    return _titled(out, columns, "mineru")


def pdf_facts(content: bytes) -> tuple[int, str | None]:
    """Pages and title by the pypdf library; (0, None) where it is missing or fails."""
    try:
        from pypdf import PdfReader

        reader = PdfReader(io.BytesIO(content))
        title = reader.metadata.title if reader.metadata else None
        return len(reader.pages), (str(title).strip() or None) if title else None
    except Exception:
        return 0, None


def with_pdf_facts(pdfs: DataFrame, read: Callable[[bytes], tuple[int, str | None]] = pdf_facts) -> DataFrame:
    """``pdfs`` with page_count and meta_title."""
    schema = T.StructType([*pdfs.schema, T.StructField("page_count", T.IntegerType()), T.StructField("meta_title", T.StringType())])

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read(bytes(c or b"")) for c in batch["content"]]
            yield batch.assign(page_count=[n for n, _ in found], meta_title=[t for _, t in found])

    return pdfs.mapInPandas(step, schema)


def _device_table() -> str:
    try:
        done = subprocess.run(["nvidia-smi", "--query-gpu=index,memory.used,utilization.gpu", "--format=csv,noheader,nounits"], capture_output=True, text=True)
        return done.stdout.strip() if done.returncode == 0 else ""
    except OSError:
        return ""


def devices(spark: SparkSession, setting: str | None = None, table: Callable[[], str] = _device_table) -> tuple[str, ...]:
    """The devices to use, MOST_WORKERS at most: those of ``setting``, else the free ones of this machine's table, which has few rows."""
    if setting:
        found = spark.range(1).select(paging.listed_devices(F.lit(setting)).alias("d")).first()["d"]
        return tuple(found[: paging.MOST_WORKERS])
    lines = [(k, x) for k, x in enumerate(table().splitlines())]
    if not lines:
        return ()
    free = paging.free_devices(files.devices(spark.createDataFrame(lines, "scan_pos int, value string")))
    return tuple(str(r["idx"]) for r in free.orderBy("gpu_pos").limit(paging.MOST_WORKERS).collect())
