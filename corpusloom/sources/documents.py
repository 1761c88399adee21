"""PDF, Word and Excel files to pages, through the binaryFile scan and pluggable parsers.

A parser maps a file's bytes to its list of page texts. Word and Excel need nothing beyond the
standard library; PDF uses pypdf when installed. Files are parsed one per row inside Arrow
batches; a file that fails keeps its row with an ``error`` and no pages.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import text as tx

Parser = Callable[[bytes], list[str]]


def parse_word(data: bytes) -> list[str]:
    """Paragraph texts of a .docx as one page."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        tree = ElementTree.fromstring(archive.read("word/document.xml"))
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    paragraphs = []
    for paragraph in (e for e in tree.iter() if tag(e) == "p"):
        paragraphs.append("".join(e.text or "" for e in paragraph.iter() if tag(e) == "t"))
    return ["\n\n".join(paragraphs)]


def _sheets(archive: zipfile.ZipFile) -> list[str]:
    """Sheet parts in the order of the workbook; sheets by number where the workbook doesn't say."""
    local = lambda e: {k.rsplit("}", 1)[-1]: v for k, v in e.attrib.items()}
    names = [n for n in archive.namelist() if n.startswith("xl/worksheets/") and n.endswith(".xml")]
    named: list[str] = []
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(archive.namelist()):
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter():
            if sheet.tag.rsplit("}", 1)[-1] == "sheet":
                target = targets.get(sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", local(sheet).get("id")), "")
                named.append(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
    number = lambda n: (int("".join(filter(str.isdigit, n.rsplit("/", 1)[-1])) or 0), n)
    return [n for n in named if n in names] + sorted((n for n in names if n not in named), key=number)


def parse_excel(data: bytes) -> list[str]:
    """Cell texts of an .xlsx, one page per sheet, rows as lines."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")):
                shared.append("".join(e.text or "" for e in item.iter() if tag(e) == "t"))
        pages = []
        for name in _sheets(archive):
            lines = []
            for row in (e for e in ElementTree.fromstring(archive.read(name)).iter() if tag(e) == "row"):
                cells = []
                for cell in row:
                    value = "".join(e.text or "" for e in cell.iter() if tag(e) in ("v", "t"))
                    cells.append(shared[int(value)] if cell.get("t") == "s" and value else value)
                lines.append(" ".join(c for c in cells if c))
            pages.append("\n".join(lines))
    return pages


def parse_pdf(data: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise RuntimeError("reading PDF files needs pypdf") from missing
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


PARSERS: dict[str, Parser] = {"PDF": parse_pdf, "Word": parse_word, "Excel": parse_excel}


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, file_path, file_type, content) of the supported files under ``path``; others are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        name.alias("filename"), F.col("path").alias("file_path"), tx.document_type(name).alias("file_type"), "content"
    ).filter("file_type is not null")


#: Fixed value: the first bytes of compound files, as .doc and .xls are.
_LEGACY = b"\xd0\xcf\x11\xe0"


def parse_files(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(filename, file_path, file_type, pages, error) of scanned files."""
    table = {**PARSERS, **(parsers or {})}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages, errors = [], []
            for kind, content in zip(batch["file_type"], batch["content"]):
                try:
                    if kind in ("Word", "Excel") and bytes(content[:4]) == _LEGACY:
                        raise ValueError(f"the binary {kind} format of before 2007 can't be read")
                    pages.append(list(table[kind](bytes(content))))
                    errors.append(None)
                except Exception as failure:
                    pages.append([])
                    errors.append(f"{type(failure).__name__}: {failure}")
            yield batch[["filename", "file_path", "file_type"]].assign(pages=pages, error=errors)

    schema = "filename string, file_path string, file_type string, pages array<string>, error string"
    return files.mapInPandas(parse, schema)


def load_folder(spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Page rows of every readable file of a folder; unreadable files are skipped."""
    return to_pages(parse_files(scan_files(spark, path), parsers).filter("error is null"))


def to_pages(parsed: DataFrame) -> DataFrame:
    """(filename, file_path, file_type, page_number, text): one row per page, numbered from 0."""
    return parsed.select(
        "filename", "file_path", "file_type", F.posexplode("pages").alias("page_number", "_text")
    ).select("filename", "file_path", "file_type", "page_number", tx.strip(F.col("_text")).alias("text"))
