"""Readers of filings in many formats, over directories of files.

Every reader returns rows keyed by path: texts (path, text), cells (path, row_header,
col_header, value, section, table_number) or headings (path, text, font_size, is_bold).
Formats without a Spark reader are unpacked in mapInPandas with the standard library.
PDF text needs a parser, which the caller passes in.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.written import written

# Extensions of known formats; others are read as text.
FORMATS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "xlsx": "xlsx", "xls": "xlsx", "csv": "csv", "pptx": "pptx", "html": "html", "htm": "html", "json": "json"}
CELLS = "path string, row_header string, col_header string, value string, section string, table_number int"
HEADINGS = "path string, ord int, text string, font_size double, is_bold boolean"
# Sizes of heading styles, and of slide text that counts as a heading.
STYLE_SIZES = {1: 16.0}
OTHER_STYLE, SLIDE_SIZE = 13.0, 13.0


def file_format(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return F.coalesce(known[ext], F.lit("txt"))


def files(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """path, content, format of all files below a folder, of one format where given."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where("length > 0").select("path", "content", file_format(F.col("path")).alias("format"))
    return d if kind is None else d.where(F.col("format") == kind)


def texts(d: DataFrame) -> DataFrame:
    """path, text of plain text files; bytes that are no UTF-8 are replaced."""
    return _parsed(d, lambda raw: raw.decode("utf-8", "replace"))


def _parsed(d: DataFrame, read: Callable[[bytes], str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf.path, "text": [read(bytes(c)) for c in pdf.content]})

    return d.select("path", "content").mapInPandas(run, "path string, text string")


def json_texts(d: DataFrame) -> DataFrame:
    """path, text: JSON files pretty-printed."""
    return _parsed(d, lambda raw: json.dumps(json.loads(raw.decode("utf-8", "replace")), indent=2, ensure_ascii=False))


def pdf_texts(d: DataFrame, parser: Callable[[bytes], str]) -> DataFrame:
    """path, text of PDF files by the caller's parser."""
    return _parsed(d, parser)


def _rows(d: DataFrame, schema: str, read: Callable[[str, bytes], list[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for p, c in zip(pdf.path, pdf.content, strict=True) for r in read(p, bytes(c))], columns=names)

    return d.select("path", "content").mapInPandas(run, schema)


def grid_cells(path: str, grid: list[list[str]], section: str, number: int) -> list[tuple]:
    """Cells of a grid whose first row and column are headers; empty ones are left out."""
    head = grid[0] if grid else []
    return [(path, row[0], head[k] if k < len(head) else "", v, section, number) for row in grid[1:] if row and row[0] for k, v in enumerate(row[1:], 1) if v]


def _csv_cells(path: str, records: Iterator[list[str]], names: list[str]) -> list[tuple]:
    return [(path, row[0], n, v) for row in records for n, v in zip(names[1:], row[1:], strict=False) if row[0].strip() and v.strip()]


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, row_header, col_header, value of CSV files: each file's own header against its first column.

    Lines are taken as records, so that files of any size are split among tasks; a file with
    a line break within quotes, which leaves a line with an odd number of them, is read whole
    in one task.
    """
    kinds, schema = ["path", "row_header", "col_header", "value"], "path string, row_header string, col_header string, value string"
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value").where("trim(value) <> ''")
    first = lines.groupBy("path").agg(F.min_by("value", F.struct("block", "n")).alias("head"), F.min(F.struct("block", "n")).alias("at"), F.max(F.length(F.regexp_replace("value", '[^"]', "")) % 2).alias("odd"))
    first = written(first)
    rows = lines.join(first.where("odd = 0"), "path").where(F.struct("block", "n") > F.col("at")).select("path", "head", "value")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").join(first.where("odd = 1").select("path"), "path", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for (path, head), part in pdf.groupby(["path", "head"], sort=False):
                out += _csv_cells(path, csv.reader(part["value"]), next(csv.reader([head])))
            yield pd.DataFrame(out, columns=kinds)

    def run_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["value"], strict=True):
                records = (r for r in csv.reader(io.StringIO(text, newline="")) if "".join(r).strip())
                out += _csv_cells(path, records, next(records, []))
            yield pd.DataFrame(out, columns=kinds)

    return rows.mapInPandas(run, schema).unionByName(whole.mapInPandas(run_whole, schema))


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _words(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _tag(x) == "t").strip()


def docx_headings(d: DataFrame) -> DataFrame:
    def read(path: str, raw: bytes) -> list[tuple]:
        root, out = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")), []
        for p in root.iter():
            if _tag(p) == "p":
                style = next((v for s in p.iter() if _tag(s) == "pStyle" for v in s.attrib.values()), "")
                level = re.match(r"(?i)heading\s*(\d)", style)
                if level and _words(p):
                    out.append((path, len(out), _words(p), STYLE_SIZES.get(int(level[1]), OTHER_STYLE), True))
        return out

    return _rows(d, HEADINGS, read)


def docx_texts(d: DataFrame) -> DataFrame:
    return _parsed(d, lambda raw: "\n".join(t for p in ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).iter() if _tag(p) == "p" and (t := _words(p))))


def docx_cells(d: DataFrame) -> DataFrame:
    def read(path: str, raw: bytes) -> list[tuple]:
        root, out = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")), []
        for n, t in enumerate((t for t in root.iter() if _tag(t) == "tbl"), 1):
            out += grid_cells(path, [[_words(c) for c in r if _tag(c) == "tc"] for r in t if _tag(r) == "tr"], "TABLE", n)
        return out

    return _rows(d, CELLS, read)


def xlsx_cells(d: DataFrame) -> DataFrame:
    """Cells of every sheet, which is their section."""

    def read(path: str, raw: bytes) -> list[tuple]:
        z, out = zipfile.ZipFile(io.BytesIO(raw)), []
        shared = [_words(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(s) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        names = [s.attrib["name"] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(s) == "sheet"]
        for n, name in enumerate(names, 1):
            grid: list[list[str]] = []
            for row in (r for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{n}.xml")).iter() if _tag(r) == "row"):
                line: list[str] = []
                for c in row:
                    col = 0
                    for ch in re.match(r"[A-Z]*", c.attrib.get("r", ""))[0]:
                        col = col * 26 + ord(ch) - 64
                    v = next((x.text or "" for x in c if _tag(x) == "v"), _words(c))
                    line += [""] * (max(col, len(line) + 1) - len(line))
                    line[-1] = shared[int(v)] if c.attrib.get("t") == "s" and v else v
                grid.append(line)
            out += grid_cells(path, grid, name, n)
        return out

    return _rows(d, CELLS, read)


def pptx_headings(d: DataFrame) -> DataFrame:
    """Slide paragraphs set in SLIDE_SIZE or larger."""

    def read(path: str, raw: bytes) -> list[tuple]:
        z, out = zipfile.ZipFile(io.BytesIO(raw)), []
        for name in sorted((n for n in z.namelist() if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=lambda n: int(re.search(r"\d+", n)[0])):
            for p in (p for p in ElementTree.fromstring(z.read(name)).iter() if _tag(p) == "p"):
                size = max((int(r.attrib["sz"]) / 100 for r in p.iter() if _tag(r) == "rPr" and "sz" in r.attrib), default=0.0)
                if size >= SLIDE_SIZE and _words(p):
                    out.append((path, len(out), _words(p), size, any(r.attrib.get("b") == "1" for r in p.iter() if _tag(r) == "rPr")))
        return out

    return _rows(d, HEADINGS, read)


def vision_cells(replies: DataFrame, key: str) -> DataFrame:
    """key, row_header, value, unit of a vision model's JSON replies; decorative images and empty values give none."""
    body = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    schema = "decorative boolean, data array<struct<label: string, value: string, unit: string>>"
    d = replies.select(key, F.from_json(body, schema).alias("j")).where("j is not null and not coalesce(j.decorative, false)")
    rows = d.select(key, F.inline("j.data"))
    return rows.where("trim(coalesce(label, '')) <> '' and trim(coalesce(value, '')) <> ''").select(key, F.col("label").alias("row_header"), "value", "unit")


def recognised(pages: DataFrame, ocr: Callable[[bytes], str], sparse: int = 100, least: int = 20) -> DataFrame:
    """path, page, text of image pages with less text than sparse, by the caller's OCR; results under least characters go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(text=[ocr(bytes(i)) for i in pdf.image])
            yield pdf.loc[pdf.text.str.len() >= least, ["path", "page", "text"]]

    return pages.where(F.length(F.coalesce("text", F.lit(""))) < sparse).select("path", "page", "image").mapInPandas(run, "path string, page int, text string")


def joined_pages(texts_: DataFrame) -> DataFrame:
    """path, text: pages' texts in order, each after its marker."""
    part = F.concat(F.lit("[PAGE "), F.col("page").cast("string"), F.lit("]\n"), "text")
    return texts_.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", part.alias("p")))), lambda s: s["p"]), "\n").alias("text"))
