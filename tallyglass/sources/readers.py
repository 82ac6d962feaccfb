"""Readers: files by extension to the cell model, documents, images, registries. Formats without a library here raise a clear error."""

from __future__ import annotations

import importlib
import json
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.numeric import parse_number

IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
CELL = "source string, sheet string, col_pos int, col string, idx long, value double"


def extension(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower()


def stem(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rpartition(".")[0] or name


def _as_cells(rows: DataFrame, source: str, columns: list[tuple[str, str]], sheet: Column, min_values: int) -> DataFrame:
    """rows (_row and text columns) to cells; a column counts with min_values parsable cells or more; cells that don't parse are dropped, not kept as gaps."""
    parts = F.array(*[F.struct(F.lit(i).alias("col_pos"), F.lit(name).alias("col"), parse_number(F.col(f"`{c}`").cast("string")).alias("value")) for i, (c, name) in enumerate(columns)])
    long = rows.select("_row", sheet.alias("sheet"), F.inline(parts)).where("value is not null")
    place = F.row_number().over(Window.partitionBy("sheet", "col_pos").orderBy("_row")) - 1
    long = long.withColumn("idx", place.cast("long")).withColumn("source", F.lit(source))
    enough = long.groupBy("sheet", "col_pos").count().where(F.col("count") >= min_values).select("sheet", "col_pos")
    return long.join(enough, ["sheet", "col_pos"], "left_semi").select("source", "sheet", "col_pos", "col", "idx", "value")


def _names(header: list[str], blank: str) -> list[tuple[int, str]]:
    """(position, name) of the columns: blank names are numbered, of equal names the last counts, at the first one's place."""
    names = [(h or "").strip().lstrip("﻿") or f"{blank}{i}" for i, h in enumerate(header)]
    last = {n: i for i, n in enumerate(names)}
    return [(last[n], n) for n in dict.fromkeys(names)]


def csv_cells(spark: SparkSession, path: str, min_values: int = 3, blank: str = "Col_") -> DataFrame:
    """Cells of a CSV file with a header; a byte-order mark and ragged rows are tolerated."""
    raw = spark.read.csv(path, header=False, inferSchema=False, mode="PERMISSIVE", multiLine=True, escape='"')
    head = raw.first()
    if head is None:
        return spark.createDataFrame([], CELL)
    rows = raw.withColumn("_row", F.monotonically_increasing_id()).where("_row > 0")
    return _as_cells(rows, stem(path), [(f"_c{i}", n) for i, n in _names(list(head), blank)], F.lit(""), min_values)


def json_cells(spark: SparkSession, path: str, min_values: int = 3) -> DataFrame:
    """Cells of a JSON file: a list of objects, or an object of arrays (cut to the shortest)."""
    df = spark.read.json(path, multiLine=True)
    arrays = [n for n, t in df.dtypes if t.startswith("array")]
    if arrays and len(arrays) == len(df.columns):
        n = F.least(*[F.size(c) for c in arrays]) if len(arrays) > 1 else F.size(arrays[0])
        df = df.select(F.inline(F.arrays_zip(*[F.slice(c, F.lit(1), n).alias(c) for c in arrays])))
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    return _as_cells(rows, stem(path), [(c, c) for c in df.columns], F.lit(""), min_values)


def columnar_cells(spark: SparkSession, path: str, kind: str, order: list[str], min_values: int = 3) -> DataFrame:
    """Cells of a Parquet or ORC table; rows are numbered by `order`, as such tables have no row order of their own."""
    df = spark.read.format(kind).load(path)
    rows = df.withColumn("_row", F.struct(*order))
    return _as_cells(rows, stem(path), [(c, c) for c in df.columns], F.lit(""), min_values)


_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Numbers of the built-in formats that print a number as a date or a time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _column(reference: str) -> int:
    """0-based column of a cell reference such as AB12."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _dated(styles: bytes | None) -> set[int]:
    """Cell styles that print numbers as dates."""
    from xml.etree import ElementTree

    if styles is None:
        return set()
    root = ElementTree.fromstring(styles)
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter() if _tag(f) == "numFmt"}
    is_date = lambda k: k in DATE_FORMATS or re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(k, "")).lower()) is not None
    formats = next((x for x in root if _tag(x) == "cellXfs"), [])
    return {i for i, x in enumerate(formats) if is_date(int(x.get("numFmtId", 0)))}


def workbook_sheets(content: bytes, active_only: bool = False) -> Iterator[tuple[str, list[list[str | None]]]]:
    """(title, rows) of an .xlsx workbook's sheets in order, or of its active sheet; a cell is its text, None without one. Rows begin at the first of the sheet.

    Formulas have their stored results; errors count as empty; dates aren't numbers and have the text "date".
    """
    import io
    import zipfile
    from xml.etree import ElementTree

    try:
        book = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as odd:
        raise ValueError("not an .xlsx workbook") from odd
    with book as z:
        read = lambda name: z.read(name) if name in z.namelist() else None
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        root = ElementTree.fromstring(z.read("xl/workbook.xml"))
        joined = lambda x: "".join(t.text or "" for part in x for t in ([part] if _tag(part) == "t" else part if _tag(part) == "r" else []) if _tag(t) == "t")
        shared = [joined(x) for x in ElementTree.fromstring(read("xl/sharedStrings.xml") or b"<sst/>")]
        dated = _dated(read("xl/styles.xml"))
        active = next((int(v.get("activeTab", 0)) for v in root.iter() if _tag(v) == "workbookView"), 0)

        def text(cell) -> str | None:
            kind = cell.get("t", "n")
            value = next((x.text for x in cell if _tag(x) == "v"), None)
            if kind == "inlineStr":
                return next((joined(x) for x in cell if _tag(x) == "is"), None)
            if value is None or kind == "e":
                return None
            if kind == "s":
                return shared[int(value)]
            if kind == "b":
                return "True" if value == "1" else "False"
            return "date" if kind == "d" or (kind == "n" and int(cell.get("s", 0)) in dated) else value

        for i, sheet in enumerate(x for x in root.iter() if _tag(x) == "sheet"):
            if active_only and i != active:
                continue
            target = targets[sheet.get(_RELATION)]
            rows: list[list[str | None]] = []
            with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
                for _, row in ElementTree.iterparse(part):
                    if _tag(row) != "row":
                        continue
                    while len(rows) < int(row.get("r", len(rows) + 1)) - 1:
                        rows.append([])
                    line: list[str | None] = []
                    for cell in row:
                        at = _column(cell.get("r", "")) if cell.get("r") else len(line)
                        line += [None] * (at + 1 - len(line))
                        line[at] = text(cell)
                    rows.append(line)
                    row.clear()
            yield sheet.get("name"), rows


def excel_cells(spark: SparkSession, path: str, min_values: int = 3, first_sheet_only: bool = False) -> DataFrame:
    """Cells of all sheets of .xlsx files (columns named sheet/column), or of the active sheet."""
    return workbook_cells(spark.read.format("binaryFile").load(path).select("path", "content"), min_values, first_sheet_only)


def workbook_cells(files: DataFrame, min_values: int = 3, first_sheet_only: bool = False) -> DataFrame:
    """excel_cells() of (path, content)."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                for title, rows in workbook_sheets(content, first_sheet_only):
                    if rows:
                        out = []
                        for i, n in _names([str(h or "") for h in rows[0]], "col_"):
                            values = [r[i] for r in rows[1:] if i < len(r) and r[i] is not None]
                            out += [(stem(file), title, i, f"{title}/{n}", k, v) for k, v in enumerate(values)]
                        yield pd.DataFrame(out, columns=["source", "sheet", "col_pos", "col", "row", "text"])

    cells = files.select("path", "content").mapInPandas(run, "source string, sheet string, col_pos int, col string, row long, text string")
    parsed = cells.withColumn("value", parse_number(F.col("text"))).where("value is not null")
    w = Window.partitionBy("source", "sheet", "col_pos")
    numbered = parsed.withColumn("idx", F.row_number().over(w.orderBy("row")) - 1).withColumn("n", F.count("*").over(w))
    return numbered.where(F.col("n") >= min_values).select("source", "sheet", "col_pos", "col", F.col("idx").cast("long").alias("idx"), "value")


def table_cells(spark: SparkSession, path: str, min_values: int = 3, order: list[str] | None = None) -> DataFrame:
    """Cells of a file by its extension: Excel (.xlsx), JSON, Parquet and ORC, else CSV."""
    kind = extension(path)
    if kind in ("xlsx", "xlsm"):
        return excel_cells(spark, path, min_values)
    if kind == "xls":
        needs("xlrd", "reading .xls files")
    if kind == "json":
        return json_cells(spark, path, min_values)
    if kind in ("parquet", "orc"):
        if not order:
            raise ValueError("a columnar table needs an order")
        return columnar_cells(spark, path, kind, order, min_values)
    return csv_cells(spark, path, min_values)


def tables_cells(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Cells of several files, each a source."""
    out = None
    for path in paths:
        one = table_cells(spark, path, **options)
        out = one if out is None else out.unionByName(one)
    return out


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text) of text files, whole; ids follow the paths' hash."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def pdf_documents(spark: SparkSession, path: str, max_pages: int | None = None) -> DataFrame:
    """(doc_id, path, pages, text) of PDF files in a tree, of their first pages if limited; needs fitz."""
    needs("fitz", "reading PDF files")

    def run(batches: Iterator) -> Iterator:
        import fitz
        import pandas as pd

        for batch in batches:
            out = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    pages = [doc[i].get_text() for i in range(min(len(doc), max_pages or len(doc)))]
                out.append((file, pages, "".join(pages)))
            yield pd.DataFrame(out, columns=["path", "pages", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, pages array<string>, text string").withColumn("doc_id", F.xxhash64("path"))


def images(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """(id, path, height, width, pixels): grey values of the images in a tree, of `least` pixels or more on both sides; unreadable ones are left out."""
    glob = "*.{" + ",".join(IMAGE_EXTENSIONS) + "}"
    df = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)

    def grey(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            out = []
            for p, h, w, n, data in zip(batch["origin"], batch["height"], batch["width"], batch["nChannels"], batch["data"], strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(float)
                g = x[..., 0] if n == 1 else x[..., :3] @ np.array([0.114, 0.587, 0.299])
                out.append((p, h, w, np.rint(g).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["path", "height", "width", "pixels"])

    flat = df.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").where(f"height >= {least} and width >= {least}")
    return flat.mapInPandas(grey, "path string, height int, width int, pixels binary").withColumn("id", F.xxhash64("path"))


def pdf_images(spark: SparkSession, path: str, least: int = 100, min_kb: int = 0, first_of_page: bool = False) -> DataFrame:
    """(id, path, page, number, height, width, pixels) of the pictures in PDF files: of `least` pixels on both sides and `min_kb` kilobytes or more; the first of each page alone if asked for. Needs fitz."""
    needs("fitz", "reading pictures of PDF files")

    def run(batches: Iterator) -> Iterator:
        import fitz
        import pandas as pd

        for batch in batches:
            out = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    for page in doc:
                        for k, (xref, *_) in enumerate(page.get_images()):
                            stored = len(doc.extract_image(xref)["image"])
                            pix = fitz.Pixmap(fitz.csGRAY, fitz.Pixmap(doc, xref))
                            if min(pix.width, pix.height) >= least and stored >= 1024 * min_kb:
                                out.append((file, page.number, k, pix.height, pix.width, bytes(pix.samples)))
                                if first_of_page:
                                    break
            yield pd.DataFrame(out, columns=["path", "page", "number", "height", "width", "pixels"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)
    found = files.select("path", "content").mapInPandas(run, "path string, page int, number int, height int, width int, pixels binary")
    return found.withColumn("id", F.xxhash64("path", "page", "number"))


def parse_tables(name: str, content: bytes, max_rows: int = 5000, density: float = 0.3) -> Iterator[tuple[str, int, list[str]]]:
    """(table, row number, cells) of a CSV file, of a workbook's sheets, or of those in a zip archive (archives in it too), if over `density` of the cells are numbers. max_rows bounds what one table contributes."""
    import csv
    import io
    import zipfile

    if extension(name) == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for inner in z.namelist():
                if not inner.endswith("/"):
                    yield from parse_tables(f"{name}/{inner}", z.read(inner), max_rows, density)
    elif extension(name) == "csv":
        rows = [r for _, r in zip(range(max_rows + 1), csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"))), strict=False)]
        yield from _dense(name, rows, density)
    elif extension(name) in ("xlsx", "xlsm"):
        for title, rows in workbook_sheets(content):
            yield from _dense(f"{name}/{title}", [[c or "" for c in r] for r in rows[: max_rows + 1]], density)


def _dense(name: str, rows: list[list[str]], density: float) -> Iterator[tuple[str, int, list[str]]]:
    cells = [c.strip().replace("%", "").replace(",", "") for r in rows[1:] for c in r]
    if cells and sum(map(_is_number, cells)) / len(cells) > density:
        yield from ((name, i, r) for i, r in enumerate(rows))


def _is_number(cell: str) -> bool:
    try:
        return abs(float(cell)) < float("inf")
    except ValueError:
        return False


def download_tables(links: DataFrame, pause: float = 0.5, timeout: float = 30) -> DataFrame:
    """(page_id, link, table, row, cells, error) of (page_id, link): what the links' CSV files and archives hold. Needs a network."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for page, link in zip(batch["page_id"], batch["link"], strict=True):
                try:
                    with urllib.request.urlopen(link, timeout=timeout) as answer:
                        out += [(page, link, t, i, r, None) for t, i, r in parse_tables(link.split("?")[0], answer.read())]
                except Exception as problem:
                    out.append((page, link, None, None, None, str(problem)))
                time.sleep(pause)
            yield pd.DataFrame(out, columns=["page_id", "link", "table", "row", "cells", "error"]).astype({"row": "Int64"})

    return links.select("page_id", "link").mapInPandas(run, "page_id long, link string, table string, row long, cells array<string>, error string")


def email_database(spark: SparkSession, path: str) -> DataFrame:
    """(paper, email) of a JSON file {"papers": {name: {"emails": [...]}}}, or of the inner object alone."""
    entry = "map<string,struct<emails:array<string>>>"
    raw = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.papers"), F.col("value"))
    return raw.select(F.explode(F.from_json(inner, entry)).alias("paper", "info")).select("paper", F.explode("info.emails").alias("email"))


def supplementary_links(pages: DataFrame, with_xls: bool = False) -> DataFrame:
    """(page_id, link) of (page_id, url, html): links by their text or extension, made absolute; the page itself where there are none."""
    tags = pages.select("page_id", "url", F.explode_outer(F.regexp_extract_all("html", F.lit(r'(?is)(<a[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))).alias("a"))
    href = F.regexp_extract("a", r'(?i)href="([^"]*)"', 1)
    body = F.lower(F.regexp_replace(F.regexp_replace("a", "(?s)<[^>]*>", " "), r"\s+", " "))
    wanted = F.contains(body, F.lit("source data")) | F.contains(body, F.lit("supplementary data")) | F.contains(body, F.lit("supplementary information"))
    wanted = wanted | F.lower(href).rlike(r"\.(xlsx|xls|csv)$" if with_xls else r"\.(xlsx|csv)$")
    root, folder = F.regexp_extract("url", r"^[a-zA-Z]+://[^/]*", 0), F.regexp_extract("url", r"^[a-zA-Z]+://[^/]*(?:/[^?#]*/)?", 0)
    link = F.when(href.rlike("^[a-zA-Z]+://"), href).when(href.startswith("//"), F.concat(F.regexp_extract("url", "^[a-zA-Z]+:", 0), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.regexp_replace(folder, "([^/])$", "$1/"), href))
    found = tags.where(wanted).select("page_id", link.alias("link")).distinct()
    return found.unionByName(pages.select("page_id", F.col("url").alias("link")).join(found, "page_id", "left_anti"))


def needs(module: str, what: str):
    try:
        return importlib.import_module(module)
    except ImportError as missing:
        raise RuntimeError(f"{what} needs the package {module}, which isn't installed") from missing


class TrialRegistry(DataSource):
    """Batch source of a trial registry's REST interface: one partition for each condition, pages by token.

    Options: conditions (separated by |), url, pageSize, maxPages, pause (seconds between requests), hasResults.
    Rows are (condition, position, value), the value being one study's JSON.
    """

    @classmethod
    def name(cls) -> str:
        return "trial_registry"

    def schema(self) -> str:
        return "condition string, position int, value string"

    def reader(self, schema) -> DataSourceReader:
        return _TrialReader(dict(self.options))


class _TrialReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c) for c in self.options["conditions"].split("|") if c]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o, token, at = self.options, None, 0
        for _ in range(int(o.get("maxpages", 5))):
            query = {"query.cond": partition.value, "pageSize": o.get("pagesize", "100"), "format": "json"}
            query |= {"pageToken": token} if token else {}
            with urllib.request.urlopen(f"{o['url']}?{urllib.parse.urlencode(query)}", timeout=float(o.get("timeout", 30))) as answer:
                page = json.load(answer)
            for study in page.get("studies", []):
                if study.get("hasResults") or o.get("hasresults", "true") != "true":
                    yield partition.value, at, json.dumps(study, ensure_ascii=False)
                at += 1
            token = page.get("nextPageToken")
            if not token:
                break
            time.sleep(float(o.get("pause", 0.3)))


def distinct_studies(studies: DataFrame, key: str = "id") -> DataFrame:
    """Studies of several conditions, each once, at its first place."""
    w = Window.partitionBy(key).orderBy("condition", "position")
    return studies.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
