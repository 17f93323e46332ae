"""Files and bytes into markdown, in Python workers; what fails is set aside, not fatal."""

from __future__ import annotations

import csv
import io
import json
import os
import posixpath
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that are converted by default.
EXTENSIONS = [".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".html", ".htm", ".xhtml", ".csv", ".tsv", ".json", ".xml", ".yaml", ".yml", ".txt", ".md", ".markdown", ".rst", ".epub", ".msg", ".eml", ".zip", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".mp3", ".wav", ".m4a"]

Backend = Callable[[bytes, str], tuple[str, str | None]]


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: str | None = None
        self.skip = 0
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif m := re.fullmatch(r"h([1-6])", tag):
            self.out.append("\n\n" + "#" * int(m[1]) + " ")
        elif tag in ("p", "div", "section", "table", "ul", "ol", "article"):
            self.out.append("\n\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("br", "tr"):
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title = ((self.title or "") + data).strip() or None
        elif not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def _text(b: bytes) -> str:
    for codec in ("utf-8-sig", "cp1252"):
        try:
            return b.decode(codec)
        except UnicodeDecodeError:
            continue
    return b.decode("latin-1")


def html(b: bytes, name: str) -> tuple[str, str | None]:
    p = _Html()
    p.feed(_text(b))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(p.out))).strip(), p.title


def delimited(b: bytes, name: str) -> tuple[str, str | None]:
    rows = list(csv.reader(io.StringIO(_text(b)), delimiter="\t" if name.endswith(".tsv") else ","))
    if not rows:
        return "", None
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r) + " |"
    return "\n".join([line(rows[0]), "|" + "---|" * len(rows[0]), *map(line, rows[1:])]), None


def structured(b: bytes, name: str) -> tuple[str, str | None]:
    return "```json\n" + json.dumps(json.loads(_text(b)), ensure_ascii=False, indent=2) + "\n```", None


def xml(b: bytes, name: str) -> tuple[str, str | None]:
    root = ET.fromstring(b)
    return "\n\n".join(t.strip() for t in root.itertext() if t.strip()), root.findtext("title")


def plain(b: bytes, name: str) -> tuple[str, str | None]:
    t = _text(b)
    m = re.search(r"^#\s+(.+)$", t, re.M)
    return t, m[1].strip() if m else None


#: What the standard library can convert; others are added by register().
BACKENDS: dict[str, Backend] = {e: html for e in (".html", ".htm", ".xhtml")} | {".csv": delimited, ".tsv": delimited, ".json": structured, ".xml": xml} | {e: plain for e in (".txt", ".md", ".markdown", ".rst", ".yaml", ".yml")}


def register(extension: str, backend: Backend) -> None:
    BACKENDS[extension.lower() if extension.startswith(".") else "." + extension.lower()] = backend


def scan(spark: SparkSession, folder: str, extensions: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of the files with the given extensions, without case; missing folders are an error."""
    wanted = [e.lower() if e.startswith(".") else "." + e.lower() for e in extensions or EXTENSIONS]
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(folder)
    if not fs.getFileStatus(p).isDirectory():
        raise NotADirectoryError(folder)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", "true").load(folder)
    return df.filter(F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1)).isin(wanted))


def converted(files: DataFrame, path_col: str = "path", content_col: str = "content", backends: dict[str, Backend] | None = None) -> DataFrame:
    """(path, markdown, title, error): a file that can't be converted has an error and no text."""
    table = dict(backends or BACKENDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                ext = os.path.splitext(path or "")[1].lower()
                try:
                    rows.append((path, *table[ext](bytes(content), path.lower()), None))
                except KeyError:
                    rows.append((path, None, None, f"no converter for {ext or 'files without extension'}"))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "markdown", "title", "error"])

    return files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInPandas(run, "path string, markdown string, title string, error string")


def write_markdown(rows: DataFrame, folder: str) -> None:
    """One <stem>.md for each converted row, in a folder that all executors share, by its URI (a path without a scheme is a mounted one).

    Equal stems overwrite one another; a task that is run again writes the same files.
    """
    FileSystem.from_uri(folder)  # an unknown scheme is an error here, not a local folder of that name

    def write(part) -> None:
        target, root = FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        for r in part:
            if r.markdown is not None:
                stem = posixpath.splitext(posixpath.basename(r.path))[0]
                with target.open_output_stream(f"{root}/{stem}.md") as f:
                    f.write(r.markdown.encode())

    rows.select("path", "markdown").foreachPartition(write)


def identifier(name: str) -> str:
    """A table name that may stand in SQL text; anything else is an error."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,127}", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name
