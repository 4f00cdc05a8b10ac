"""Files of text as a Spark data source.

``spark.read.format("source_files")`` scans each file once: the reader lists
the folders, deals the files over partitions by their size, and reads a file
chunk by chunk up to the limit. A file that is too large is not opened; one
that grows beyond the limit while it is read, that is broken or of an unknown
kind is a row with an error, so that it costs no other file.

Which names and lengths are wanted is said by options, which the listing
settles before any file is opened. Filters are not pushed down: of a Python
source, Spark 4.1 keeps what one query pushed for the next query of the same
DataFrame, which then lacks rows.
"""

from __future__ import annotations

import io
import json
import shutil
import subprocess
import tempfile
import threading
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from typing import BinaryIO
from xml.parsers import expat

from pyspark.sql import datasource as ds

SCHEMA = "path string, name string, length long, text string, error string"
PARTITION_BYTES, CHUNK_BYTES, FILE_COST = 32 << 20, 1 << 20, 64 << 10
TEXT_KINDS = ("txt", "md", "markdown", "text")
PDF_SECONDS, STDERR_BYTES = 120, 8192
#: Word text, and what ends a paragraph or stands for white space (fixed names of the format).
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


class Refused(Exception):
    """A file that gives no text, and why."""


def read_capped(stream: BinaryIO, limit: int, name: str) -> bytes:
    """All of a stream; :class:`Refused` as soon as it is over ``limit`` bytes."""
    chunks, size = [], 0
    while chunk := stream.read(min(CHUNK_BYTES, limit + 1 - size)):
        chunks.append(chunk)
        size += len(chunk)
        if size > limit:
            raise Refused(f"{name} grew beyond the limit of {limit} bytes while it was read")
    return b"".join(chunks)


def run_tool(command: list[str], limit: int, seconds: float = PDF_SECONDS) -> bytes:
    """What a tool prints, cut at ``limit`` bytes; never more than that is held. A failure is the first line of its complaint."""
    process = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    said: list[bytes] = []

    def listen() -> None:
        said.append(process.stderr.read(STDERR_BYTES))
        while process.stderr.read(CHUNK_BYTES):
            pass

    listener = threading.Thread(target=listen, daemon=True)
    late = threading.Timer(seconds, process.kill)
    listener.start()
    late.start()
    try:
        out = io.BytesIO()
        while chunk := process.stdout.read(CHUNK_BYTES):  # the rest is read too, so that the tool can end
            out.write(chunk[: limit - out.tell()])
        code = process.wait()
    finally:
        timed_out = not late.is_alive()
        late.cancel()
        process.kill()
        process.wait()
        listener.join()
        process.stdout.close()
        process.stderr.close()
    if timed_out:
        raise Refused(f"{command[0]} took more than {seconds:g} seconds")
    if code:
        raise Refused(((said or [b""])[0].decode(errors="replace").strip().splitlines() or ["failed"])[0])
    return out.getvalue()


def pdf_text(content: bytes, limit: int) -> str:
    tool = shutil.which("pdftotext")
    if not tool:
        raise Refused("pdftotext is not installed")
    with tempfile.NamedTemporaryFile(suffix=".pdf") as file:
        file.write(content)
        file.flush()
        text = run_tool([tool, file.name, "-"], limit).decode(errors="replace")
    if not text.strip():
        raise Refused("no text layer")
    return text


def docx_text(content: bytes, limit: int) -> str:
    """Paragraphs of a word-processing document, one line each; document types and entities are refused."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open("word/document.xml") as stream:
            xml = read_capped(stream, limit, "word/document.xml")
    except (zipfile.BadZipFile, KeyError, NotImplementedError, RuntimeError, EOFError) as failure:
        raise Refused(f"not a document: {failure}") from failure
    parser, out, inside = expat.ParserCreate(namespace_separator=" "), io.StringIO(), [False]

    def begin(tag: str, _: dict) -> None:
        inside[0] = tag == f"{_WORD} t"
        if tag in (f"{_WORD} tab", f"{_WORD} br"):
            out.write("\t" if tag.endswith("tab") else "\n")

    def end(tag: str) -> None:
        inside[0] = False
        if tag == f"{_WORD} p":
            out.write("\n\n")

    def refuse(*_: object) -> None:
        raise Refused("a document type declaration is refused")

    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = begin, end, refuse
    parser.CharacterDataHandler = lambda data: out.write(data) if inside[0] else None
    try:
        parser.Parse(xml, True)
    except expat.ExpatError as failure:
        raise Refused(f"not a document: {failure}") from failure
    if not out.getvalue().strip():
        raise Refused("no text layer")
    return out.getvalue()


def kind_of(name: str) -> str:
    return name.rpartition(".")[2].lower() if "." in name else ""


def extract(name: str, content: bytes, limit: int) -> str:
    """Text of a file's bytes by the ending of its name."""
    kind = kind_of(name)
    if kind == "pdf":
        return pdf_text(content, limit)
    if kind == "docx":
        return docx_text(content, limit)
    try:
        return content.decode()
    except UnicodeDecodeError as failure:
        raise Refused(f"{name} is not valid UTF-8") from failure


def known(name: str) -> bool:
    return kind_of(name) in (*TEXT_KINDS, "pdf", "docx")


@dataclass
class Files(ds.InputPartition):
    """Some files (path, length) for one task."""

    files: list[tuple[str, int]]


class SourceFilesReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.limit = int(options["limit"])
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.names = options.get("names", "*")
        self.shortest, self.longest = int(options.get("shortest", 0)), int(options.get("longest", 1 << 62))

    def listing(self) -> list[tuple[str, int]]:
        """(path, length) of all files under the paths that the options leave, by path."""
        from pyarrow import fs

        found = {}
        for path in self.paths:
            system, place = fs.FileSystem.from_uri(path)
            prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
            (info,) = system.get_file_info([place])
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            many = system.get_file_info(fs.FileSelector(place, recursive=True)) if info.type == fs.FileType.Directory else [info]
            found |= {prefix + i.path: i.size for i in many if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))}
        return sorted((path, size) for path, size in found.items() if fnmatchcase(path.rpartition("/")[2], self.names) and self.shortest <= size <= self.longest)

    def partitions(self) -> list[Files]:
        """Files in order of their paths, some ``partition_bytes`` to a task; a file that will not be read costs no more than opening one."""
        out: list[Files] = []
        room = 0
        for path, size in self.listing():
            cost = FILE_COST + (size if size <= self.limit else 0)
            if not out or cost > room:
                out.append(Files([]))
                room = self.partition_bytes
            out[-1].files.append((path, size))
            room -= cost
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        for path, size in partition.files:
            name = path.rpartition("/")[2]
            text, error = "", ""
            try:
                if size > self.limit:
                    raise Refused(f"{name} is {size} bytes; the limit is {self.limit}")
                if not known(name):
                    raise Refused(f"unsupported file type: {kind_of(name)}")
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_stream(place) as stream:
                    content = read_capped(stream, self.limit, name)
                text = extract(name, content, self.limit)
            except (Refused, OSError) as failure:
                error = (str(failure).splitlines() or [type(failure).__name__])[0]
            yield path, name, size, text, error


class SourceFiles(ds.DataSource):
    """Options: ``paths`` (a JSON list of files and folders), ``limit`` (bytes), ``partitionBytes``, ``names`` (a pattern), ``shortest`` and ``longest`` (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> SourceFilesReader:
        return SourceFilesReader(self.options)
