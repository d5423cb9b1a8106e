"""Pipelines, sources and sinks."""

import datetime
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from paperloom.cli import parser, run
from paperloom.operators import merging, results
from paperloom.plans import backends, engines
from paperloom.plans.ingest import ingest, planned_writes
from paperloom.plans.translate import translate
from paperloom.sources import files, paperdir
from paperloom.streaming import ingest as stream

PAPER = '---\ntitle: "T"\n---\n\n# Intro to things\n\nSome words about `code` and $x$ that are long enough [1].\n\n$$\ny\n$$\n\n# References\n\n[1] A\n'


def test_ingest(spark):
    rows = spark.createDataFrame([("/d/a.pdf", "# A title\n\\(x\\)", None, None), ("/d/b.pdf", "# A title\n", None, None), ("/d/c.pdf", "text", None, " ")], "source string, markdown string, detected_title string, meta_title string")
    existing = spark.createDataFrame([("20250101-c",)], "dir_name string")
    got = {r["source"]: r for r in ingest(rows, existing, F.lit("2026-01-31").cast("date"), "passthrough").collect()}
    assert [got[f"/d/{x}.pdf"]["status"] for x in "abc"] == ["success", "error", "error"]
    record = json.loads(got["/d/a.pdf"]["record"])
    assert list(record) == ["status", "markdown_path", "engine_used", "title", "date", "paper_dir"] and record["paper_dir"] == "20260131-A_title"
    assert "suggestion" in json.loads(got["/d/c.pdf"]["record"])
    assert got["/d/a.pdf"]["full_text"].endswith("aliases: []\n---\n\n# A title\n$x$")
    assert planned_writes(ingest(rows, existing, F.lit("2026-01-31").cast("date"))).count() == 2


def test_chunks_are_merged(spark):
    rows = spark.createDataFrame([(1, 1, "b ![](images/z.png) ![](q/y.JPG)", ["z.png", "y.JPG", "n.txt"]), (1, 0, "a ![](z.png)", ["z.png"]), (1, 2, "", ["x.png"]), (2, 0, None, None)], "doc_id int, chunk_idx int, markdown string, names array<string>")
    got = {r["doc_id"]: r for r in merging.merge_chunks(rows).collect()}
    assert got[1]["markdown"] == "a ![](./assets/image_001.png)\n\n---\n\nb ![](./assets/image_003.png) ![](./assets/image_002.JPG)"
    assert (got[1]["n_images"], got[1]["failed_chunks"], got[2]["status"]) == (3, 1, "error")


def test_one_exchange_for_window_and_aggregate(spark):
    rows = spark.createDataFrame([(1, 1, "b", ["z.png"])], "doc_id int, chunk_idx int, markdown string, names array<string>")
    plan = merging.merge_chunks(rows)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_translate_with_stand_in(spark):
    docs = spark.createDataFrame([(1, PAPER), (2, "short"), (3, "")], "id int, markdown string")
    got = {r["id"]: r for r in translate(docs, "id", "Chinese", "upper", quirks="fixed").collect()}
    out = got[1]["translated"]
    assert out.startswith('---\ntitle: "T"\nlanguage: Chinese\n---\n') and "# INTRO TO THINGS" in out
    assert "`code` AND $x$" in out and "$$\ny\n$$" in out and "References" not in out and got[1]["removed_refs"]
    assert got[2]["translated"] == "short" and got[2]["n_skipped"] == 1 and got[3]["translated"] == ""


def test_skipped_chunks_reach_no_backend(spark):
    backends.register("strict", Strict)
    docs = spark.createDataFrame([(1, "short $x$ text"), (2, "this one fails, as it is long enough to go")], "id int, markdown string")
    got = {r["id"]: r for r in translate(docs, "id", "Chinese", "strict").collect()}
    assert got[1]["success"] and got[2]["error"] == "no" and got[2]["translated"] == ""


class Strict(backends.Backend):
    def translate(self, messages, text):
        return backends.Translation("", False, "no")


def test_chat_backend_retries():
    calls, pauses = [], []

    class Client:
        class chat:
            class completions:
                @staticmethod
                def create(**k):
                    calls.append(k)
                    raise OSError("down")

    out = backends.ChatBackend("k", "u", "m", 10, client=Client, sleep=pauses.append).translate([], "x")
    assert not out.success and len(calls) == 3 and pauses == [2.0, 4.0] and "3 attempts: down" in out.error
    assert calls[0]["temperature"] == 0.3 and calls[0]["max_tokens"] == 4096


def test_unknown_names():
    with pytest.raises(ValueError):
        backends.backend("x")
    with pytest.raises(ValueError):
        engines.convert(None, "x")
    os.environ.pop("DEEPSEEK_API_KEY", None)
    with pytest.raises(ValueError):
        backends.backend("deepseek")[0]()


def test_messages(spark):
    rows = spark.createDataFrame([("c", None), ("c", "Title: x")], "t string, about string")
    got = [r[0] for r in rows.select(results.messages(F.col("t"), F.lit("German"), F.col("about"))).collect()]
    assert [[m["role"] for m in x] for x in got] == [["system", "user"], ["system", "system", "user"]]
    assert "German" in got[0][0]["content"] and got[1][-1]["content"] == "c"


def test_throughput_and_records(spark):
    rows = spark.createDataFrame([(15, 12.0), (0, 1.0), (1, 0.0)], "p int, s double")
    assert [r[0] for r in rows.select(results.throughput(F.col("p"), F.col("s"))).collect()] == [1.25, None, None]
    record = spark.range(1).select(results.translate_record(F.lit("o.md"), F.lit("b"), F.lit("Chinese"), F.lit(1.26))).first()[0]
    assert json.loads(record) == {"status": "success", "output_path": "o.md", "backend": "b", "target_lang": "Chinese", "elapsed_seconds": 1.3}


def test_paper_directory(spark, tmp_path):
    paperdir.register(spark)
    root = tmp_path / "root"
    (root / "20250101-Old").mkdir(parents=True)
    planned = spark.createDataFrame([("20260131-A/full_text.md", b"x", False), ("20260131-A/notes.md", b"n", True)], "path string, content binary, only_if_missing boolean")
    for _ in range(2):
        planned.write.format("paperdir").mode("append").save(str(root))
        (root / "20260131-A" / "notes.md").write_text("mine")
    assert (root / "20260131-A" / "full_text.md").read_text() == "x" and (root / "20260131-A" / "notes.md").read_text() == "mine"
    got = sorted(tuple(r) for r in spark.read.format("paperdir").load(str(root)).collect())
    assert got == [("20250101-Old", "Old", "20250101", False), ("20260131-A", "A", "20260131", True)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF")
    (tmp_path / "b.md").write_text("# B\n")
    (tmp_path / "env").write_text('# c\nA = "1"\nB=2=3\nbad\nC=\'x\nA=9\n')
    (tmp_path / "p.png").write_bytes(b"i")
    assert files.pdfs(spark, str(tmp_path)).count() == 1
    assert files.markdown(spark, str(tmp_path)).first()["markdown"] == "# B\n"
    assert files.settings(spark, str(tmp_path / "env"), {"B": "old"}) == {"A": "1", "B": "old", "C": "'x"}
    assert [r["name"] for r in files.images(spark, str(tmp_path)).collect()] == ["p.png"]
    rows = spark.createDataFrame([(0, "0, 10, 5"), (1, "x, 1, 2"), (2, "1,2")], "scan_pos int, value string")
    assert [tuple(r) for r in files.devices(rows).collect()] == [(0, 10, 5, 0)]
    sources = spark.createDataFrame([("https://e.org/x",), ("/no/such.pdf",), ("/a.txt",)], "source string")
    errors = {r["source"]: r["error"] for r in files.checked_sources(sources, files.pdfs(spark, str(tmp_path))).collect()}
    assert errors == {"https://e.org/x": None, "/no/such.pdf": "File not found: /no/such.pdf", "/a.txt": "Not a PDF file: /a.txt"}
    got = files.downloads(sources.where("source like 'https%'"), get=fake_get).first()
    assert got["path"] == "y.pdf" and bytes(got["content"]) == b"c"


def fake_get(url):
    return b"c", "attachment; filename=y.pdf", None


def test_engines(spark):
    rows = spark.createDataFrame([("/a.pdf", bytearray(b"# T\n")), ("/b.pdf", bytearray(b"\xff"))], "path string, content binary")
    got = {r["path"]: r for r in engines.convert(rows, "passthrough").collect()}
    assert got["/a.pdf"]["markdown"] == "# T\n" and got["/b.pdf"]["error"] == "not UTF-8 Markdown"
    assert engines.chain(lambda p, c: {"error": "x"}, engines.passthrough)("p", b"m")["markdown"] == "m"
    assert engines.service("p", b"", post=lambda *a, **k: 1 / 0)["error"] and not engines.service_is_up(get=lambda *a, **k: 1 / 0)
    assert engines.with_pdf_facts(rows, lambda c: (len(c), None)).orderBy("path").first()["page_count"] == 4


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Paper one\nx_i\n")
    out = tmp_path / "out"
    out.mkdir()
    args = parser().parse_args(["ingest", str(tmp_path / "in"), "--engine", "passthrough", "-o", str(out)])
    assert [json.loads(x)["status"] for x in run(args, spark)] == ["success"]
    folder = out / f"{datetime.date.today():%Y%m%d}-Paper_one"
    assert "$x_i$" in (folder / "full_text.md").read_text() and (folder / "notes.md").exists()
    assert [json.loads(x)["status"] for x in run(args, spark)] == ["error"]
    args = parser().parse_args(["translate", str(tmp_path / "in"), "--backend", "upper"])
    record = json.loads(next(run(args, spark)))
    assert record["status"] == "success" and record["elapsed_seconds"] > 0
    assert (tmp_path / "in" / "a_ch.md").exists()


def test_command_line_refuses(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("DEEPSEEK_API_KEY", raising=False)
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "a.md").write_text("x")

    def said(*args):
        return [json.loads(x)["message"] for x in run(parser().parse_args(list(args)), spark)]

    assert said("ingest", str(tmp_path / "no.pdf")) == [f"File not found: {tmp_path}/no.pdf"]
    assert said("ingest", str(tmp_path / "a.txt")) == [f"Not a PDF file: {tmp_path}/a.txt"]
    assert "DEEPSEEK_API_KEY is not set" in said("translate", str(tmp_path / "a.md"), "--backend", "deepseek", "--env-file", str(tmp_path / "no"))[0]
    (tmp_path / "env").write_text("DEEPSEEK_API_KEY=k\nDEEPSEEK_MODEL=m\n")
    backend = backends.backend("deepseek", files.settings(spark, str(tmp_path / "env")))[0]()
    assert (backend.key, backend.model, backend.base_url) == ("k", "m", "https://api.deepseek.com/v1")


def _program(path, content, device=None, timeout=600):
    """Stands for the program: two images, a device's name, a failure for ranges that begin at page 2."""
    if content.startswith(b"2"):
        return {"error": "broken"}
    md = f"# On {device}\n![a](images/b.png) ![](a.jpg) ![](no.gif) {content.decode()}"
    return {"markdown": md, "images": [{"name": "b.png", "bytes": b"B"}, {"name": "a.jpg", "bytes": b"A"}, {"name": "x.txt", "bytes": b"T"}]}


def test_whole_documents_are_finished(spark):
    rows = spark.createDataFrame([("/d/a.pdf", bytearray(b"1"), 7), ("/d/b.pdf", bytearray(b"2"), 8)], "path string, content binary, extra int")
    engines.ENGINES["stand-in"] = lambda options: _program
    try:
        got = {r["path"]: r for r in engines.convert(rows, "stand-in").collect()}
    finally:
        del engines.ENGINES["stand-in"]
    one = got["/d/a.pdf"]
    assert one["markdown"] == "# On None\n![a](./assets/image_001.png) ![](./assets/image_002.jpg) ![](no.gif) 1" and one["extra"] == 7
    assert [(x["name"], bytes(x["bytes"])) for x in one["images"][:2]] == [("image_001.png", b"B"), ("image_002.jpg", b"A")]
    assert got["/d/b.pdf"]["error"] == "broken" and got["/d/b.pdf"]["markdown"] is None


def test_ranges_of_pages_are_merged(spark):
    rows = spark.createDataFrame([("/d/a.pdf", bytearray(b"x"), 5), ("/d/b.pdf", bytearray(b"y"), 1), ("/d/c.pdf", bytearray(b"2"), 1)], "path string, content binary, page_count int")
    options = engines.Options(devices=("4", "6"), port=1)
    got = {r["path"]: r for r in engines._in_ranges(rows, options, _program, cut=lambda content, a, b: f"{a}-{b}".encode()).collect()}
    one = got["/d/a.pdf"]
    assert one["markdown"] == "# On 4\n![a](./assets/image_002.png) ![](./assets/image_001.jpg) ![](no.gif) 0-2\n\n---\n\n# On 6\n![a](./assets/image_004.png) ![](./assets/image_003.jpg) ![](no.gif) 3-4"
    assert [(x["name"], bytes(x["bytes"])) for x in one["images"]] == [("image_001.jpg", b"A"), ("image_002.png", b"B"), ("image_003.jpg", b"A"), ("image_004.png", b"B")]
    assert (one["mode"], one["detected_title"], bytes(one["content"]), one["page_count"]) == ("cli", "On 4", b"x", 5)
    assert got["/d/b.pdf"]["markdown"].startswith("# On 4\n![a](./assets/image_002.png)") and got["/d/c.pdf"]["error"] == "broken"


class Reply:
    status_code = 200
    text = json.dumps({"results": {"a": {"md_content": "# A\n![](images/i.png)", "images": {"i.png": "data:image/png;base64,aQ=="}}}})


def test_service_comes_first(spark, monkeypatch):
    sent = {}

    def post(url, files, data, timeout):
        sent.update(data, url=url)
        return Reply()

    run_ = engines.served(engines.Options(port=9), post, lambda *a, **k: Reply())
    assert run_("/d/a.pdf", b"x") == {"reply": Reply.text} and sent["parse_method"] == "auto" and sent["url"].endswith(":9/file_parse")
    assert engines._usable({"reply": '{"results": {}}'}, "a")["error"] and engines._usable({"reply": "<html>"}, "a")["error"]
    assert engines.served(engines.Options(), post, lambda *a, **k: 1 / 0) is None
    rows = spark.createDataFrame([("/d/a.pdf", bytearray(b"1"))], "path string, content binary")
    text = Reply.text
    engines.ENGINES["mineru"], kept = lambda options: lambda path, content: {"reply": text}, engines.ENGINES["mineru"]
    try:
        got = engines.convert(rows, "mineru").first()
    finally:
        engines.ENGINES["mineru"] = kept
    assert (got["markdown"], got["mode"], got["detected_title"]) == ("# A\n![](./assets/image_001.png)", "api", "A")
    assert [(x["name"], bytes(x["bytes"])) for x in got["images"]] == [("image_001.png", b"i")]


def test_docling_is_made_once():
    class Image:
        def save(self, stream, format):
            stream.write(b"png")

    class Document:
        name = "T"
        pictures = [type("P", (), {"image": type("I", (), {"pil_image": Image()})})]

        def export_to_markdown(self, image_mode):
            return "<!-- image -->"

    class Converter:
        def convert(self, path):
            return type("R", (), {"document": Document()})

    got = engines.docling(engines.Options(), Converter())("/a.pdf", b"")
    assert got == {"markdown": "<!-- image -->", "title": "T", "images": [{"name": "000000.png", "bytes": b"png"}]}


def test_devices_and_addresses(spark, tmp_path, capfd):
    assert engines.devices(spark, "3, 1,") == ("3", "1") and engines.devices(spark, None, lambda: "") == ()
    assert engines.devices(spark, None, lambda: "0, 500, 3\n1, 100, 2\n2, 9000, 1") == ("1", "0")
    engines.ENGINES["docling"], kept = lambda options: lambda path, content: {"markdown": "# Got it", "images": [{"name": "q.png", "bytes": b"i"}]}, engines.ENGINES["docling"]
    try:
        args = parser().parse_args(["ingest", "https://e.org/y", "--engine", "docling", "-o", str(tmp_path)])
        assert [json.loads(x)["status"] for x in run(args, spark, fake_get)] == ["success"]
        args = parser().parse_args(["ingest", "https://e.org/z", "--engine", "docling", "-o", str(tmp_path)])
        assert [json.loads(x)["message"] for x in run(args, spark, lambda url: (None, None, "Failed to download PDF: x"))] == ["Failed to download PDF: x"]
    finally:
        engines.ENGINES["docling"] = kept
    folder = tmp_path / f"{datetime.date.today():%Y%m%d}-Got_it"
    assert (folder / "reference.pdf").read_bytes() == b"c" and (folder / "assets" / "image_001.png").read_bytes() == b"i"
    assert "'engine': 'docling'" in capfd.readouterr().err


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / f"{name}.md").write_text("# Same\n")
    (tmp_path / "in" / "c.md").write_text("# Other\n")
    (tmp_path / "out").mkdir()
    rows = stream.first_arrivals(stream.arrivals(spark, str(tmp_path / "in")))
    q = stream.writer(rows, str(tmp_path / "out"), "2026-01-31").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(os.listdir(tmp_path / "out")) == ["20260131-Other", "20260131-Same"]
