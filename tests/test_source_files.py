"""The file source: one scan, partitions by size, options for the listing, and files that fail as rows."""

import io
import os
import stat
import zipfile

import pytest

from groundling.sources import readers
from groundling.sources import source_files as sf


def docx(*paragraphs, head=""):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f'<?xml version="1.0"?>{head}<w:document xmlns:w="{sf._WORD}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    for k in range(20):
        (tmp_path / "deep" / f"f{k:02d}.txt").write_text(f"text {k} " * 50)
    (tmp_path / "big.txt").write_text("x" * 5000)
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "odd.xyz").write_text("?")
    (tmp_path / "good.docx").write_bytes(docx("Hello &amp; goodbye", "two"))
    (tmp_path / "evil.docx").write_bytes(docx("&a;", head='<!DOCTYPE x [<!ENTITY a "aaaa">]>'))
    (tmp_path / "bomb.docx").write_bytes(docx("y" * 100_000))
    (tmp_path / "_hidden.txt").write_text("no")
    return tmp_path


def test_one_scan_and_errors_as_rows(spark, folder):
    files = readers.source_files(spark, str(folder), limit=2000)
    rows = {r["name"]: r for r in files.collect()}
    assert len(rows) == 26 and rows["f03.txt"]["text"] == "text 3 " * 50 and rows["f03.txt"]["error"] == ""
    errors = {n: r["error"] for n, r in rows.items() if r["error"]}
    assert errors == {"big.txt": "big.txt is 5000 bytes; the limit is 2000", "bad.md": "bad.md is not valid UTF-8", "odd.xyz": "unsupported file type: xyz", "evil.docx": "a document type declaration is refused", "bomb.docx": "word/document.xml grew beyond the limit of 2000 bytes while it was read"}
    assert rows["good.docx"]["text"] == "Hello & goodbye\n\ntwo\n\n"
    plan = readers.read_sources(spark, str(folder), limit=2000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Union" not in plan
    # a store that only Spark reads gives the same rows
    readers_opens, readers._opens = readers._opens, lambda path: False
    try:
        other = {r["name"]: (r["text"], r["error"]) for r in readers.source_files(spark, str(folder), limit=2000).where("name not like '\\\\_%'").collect()}
    finally:
        readers._opens = readers_opens
    assert other == {n: (r["text"], r["error"]) for n, r in rows.items()}


def test_partitions_follow_size_and_options_reach_the_listing(spark, folder):
    reader = sf.SourceFilesReader({"paths": f'["{folder}"]', "limit": "2000", "partitionbytes": str(3 * sf.FILE_COST)})
    parts = reader.partitions()
    assert sum(len(p.files) for p in parts) == 26 and all(1 <= len(p.files) <= 3 for p in parts)
    assert len(sf.SourceFilesReader({"paths": f'["{folder}"]', "limit": "2000"}).partitions()) == 1
    some = readers.source_files(spark, str(folder), limit=2000, names="f0*", longest=400)
    assert sorted(r["name"] for r in some.collect()) == [f"f0{k}.txt" for k in range(10)]
    files = readers.source_files(spark, str(folder), limit=2000)
    assert files.where("name = 'big.txt' or text = ''").count() == 5 and files.where("name like 'f0%' and length <= 400").count() == 10 and files.count() == 26


def test_a_file_that_grows(spark, folder, tmp_path):
    class Growing(io.RawIOBase):
        def read(self, n=-1):
            return b"z" * min(n, 700)

    with pytest.raises(sf.Refused, match="grew beyond the limit of 1500 bytes"):
        sf.read_capped(Growing(), 1500, "a.txt")
    listed = [(str(folder / "big.txt"), 100)]  # listed before it grew
    (row,) = sf.SourceFilesReader({"paths": "[]", "limit": "2000"}).read(sf.Files(listed))
    assert row[3] == "" and row[4].startswith("big.txt grew beyond")
    (row,) = sf.SourceFilesReader({"paths": "[]", "limit": "2000"}).read(sf.Files([(str(folder / "gone.txt"), 1)]))
    assert row[3] == "" and "gone.txt" in row[4]


def test_tools_are_bounded(tmp_path):
    assert sf.run_tool(["sh", "-c", "head -c 3000000 /dev/zero"], 1000) == b"\0" * 1000
    with pytest.raises(sf.Refused, match="^first$"):
        sf.run_tool(["sh", "-c", "echo first >&2; head -c 100000 /dev/zero >&2; exit 3"], 1000)
    with pytest.raises(sf.Refused, match="took more than 0.3 seconds"):
        sf.run_tool(["sleep", "20"], 10, seconds=0.3)
    tool = tmp_path / "pdftotext"
    tool.write_text("#!/bin/sh\necho page of $1\n")
    tool.chmod(tool.stat().st_mode | stat.S_IXUSR)
    before, os.environ["PATH"] = os.environ["PATH"], f"{tmp_path}:{os.environ['PATH']}"
    try:
        assert sf.extract("a.PDF", b"%PDF", 1000).startswith("page of ")
    finally:
        os.environ["PATH"] = before
