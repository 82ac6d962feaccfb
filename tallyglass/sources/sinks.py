"""Sinks: findings and reports as JSON, Markdown, text, Parquet and workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import findings as fi


def write_json(findings: DataFrame, path: str) -> None:
    """One JSON document a finding."""
    fi.as_json(findings).write.mode("overwrite").text(path)


def write_markdown(findings: DataFrame, path: str, most: int = 10) -> None:
    """A Markdown section for each source, in order of the names."""
    fi.markdown(findings, most).orderBy("source").select("report").write.mode("overwrite").text(path)


def write_ids(rows: DataFrame, column: str, path: str) -> None:
    """The distinct values of a column, a line each."""
    rows.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def write_checkpointed(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys aren't in the table yet, so that a broken-off run goes on where it stopped; returns how many are new."""
    spark = rows.sparkSession
    try:
        seen = spark.read.parquet(path).select(*keys).distinct()
        rows = rows.join(seen, keys, "left_anti")
    except Exception as missing:  # no table yet
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER" not in str(missing):
            raise
    before = _count(spark, path)
    rows.write.mode("append").parquet(path)
    return _count(spark, path) - before


def _count(spark, path: str) -> int:
    try:
        return spark.read.parquet(path).count()
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER" in str(missing):
            return 0
        raise


_SPREADSHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """An .xlsx workbook of (title: rows); numbers are numbers, everything else text, None an empty cell."""
    import io
    import zipfile
    from xml.sax.saxutils import escape, quoteattr

    def cell(x) -> str:
        if x is None:
            return "<c/>"
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return f"<c><v>{x!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_SPREADSHEET}" xmlns:r="{_OFFICE}"><sheets>{"".join(f"<sheet name={quoteattr(t)} sheetId={chr(34)}{i}{chr(34)} r:id={chr(34)}rId{i}{chr(34)}/>" for i, t in enumerate(sheets, 1))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">{"".join(f"<Relationship Id={chr(34)}rId{i}{chr(34)} Type={chr(34)}{_OFFICE}/worksheet{chr(34)} Target={chr(34)}worksheets/sheet{i}.xml{chr(34)}/>" for i in range(1, len(sheets) + 1))}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_SPREADSHEET}"><sheetData>{"".join(f"<row>{"".join(map(cell, r))}</row>" for r in rows)}</sheetData></worksheet>')
    return out.getvalue()
