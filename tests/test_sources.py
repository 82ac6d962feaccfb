"""Readers, sinks, streams and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from tallyglass import __main__ as cli
from tallyglass.operators import columns
from tallyglass.plans import findings as fi
from tallyglass.sources import nested, readers, sinks
from tallyglass.streaming import signals


def values(df):
    out = {}
    for r in df.orderBy("col_pos", "idx").collect():
        out.setdefault(r.col, []).append(r.value)
    return out


def test_csv(spark, tmp_path):
    f = tmp_path / "trial.csv"
    f.write_bytes("﻿age,,x,age\n1,a,\"1,000\",9\n2,b,50%,8\n3,c,nan,7\n4,d,2e1\n".encode())
    got = readers.table_cells(spark, str(f))
    assert values(got) == {"age": [9.0, 8.0, 7.0], "x": [1000.0, 50.0, 20.0]}
    assert {r.source for r in got.collect()} == {"trial"}


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1, "y": "2"}, {"x": 3}, {"x": 5, "y": "q"}]))
    (tmp_path / "b.json").write_text(json.dumps({"x": [1, 2, 3, 4], "y": [5, 6, 7]}))
    assert values(readers.table_cells(spark, str(tmp_path / "a.json"))) == {"x": [1.0, 3.0, 5.0]}
    assert values(readers.table_cells(spark, str(tmp_path / "b.json"))) == {"x": [1.0, 2.0, 3.0], "y": [5.0, 6.0, 7.0]}


def test_missing_libraries_say_so(spark):
    from tallyglass.operators import images

    calls = (
        lambda: readers.table_cells(spark, "x.xls"),
        lambda: readers.pdf_documents(spark, "x"),
        lambda: readers.pdf_images(spark, "x"),
        lambda: images.error_levels(spark.range(1)),
        lambda: images.key_point_matches(spark.range(1), spark.range(1)),
    )
    for call in calls:
        with pytest.raises(RuntimeError, match="isn't installed"):
            call()


def test_email_database(spark, tmp_path):
    inner = {"p1": {"file": "a", "emails": ["x@a.com", "y@b.org"]}, "p2": {"emails": ["x@a.com"]}}
    for name, doc in (("a.json", {"papers": inner}), ("b.json", inner)):
        (tmp_path / name).write_text(json.dumps(doc))
        assert readers.email_database(spark, str(tmp_path / name)).count() == 3


def test_supplementary_links(spark):
    html = '<a href="/d/t.CSV">data</a><a class="x" href="s.html">Supplementary <b>Data</b></a><a href="old.xls">x</a><a href="https://o.org/z.xlsx">z</a>'
    pages = spark.createDataFrame([(1, "https://j.org/a/b.html?q", html), (2, "https://j.org/c", None)], "page_id long, url string, html string")
    got = {(r.page_id, r.link) for r in readers.supplementary_links(pages).collect()}
    assert got == {(1, "https://j.org/d/t.CSV"), (1, "https://j.org/a/s.html"), (1, "https://o.org/z.xlsx"), (2, "https://j.org/c")}
    assert (1, "https://j.org/a/old.xls") in {(r.page_id, r.link) for r in readers.supplementary_links(pages, True).collect()}


def test_registry_source_options(spark):
    spark.dataSource.register(readers.TrialRegistry)
    parts = readers._TrialReader({"conditions": "a|b", "url": "http://localhost"}).partitions()
    assert [p.value for p in parts] == ["a", "b"]
    rows = spark.createDataFrame([("b", 0, "1"), ("a", 3, "1"), ("a", 1, "2")], "condition string, position int, id string")
    assert {(r.id, r.condition) for r in readers.distinct_studies(rows).collect()} == {("1", "a"), ("2", "a")}
    assert nested.parse_trials(spark.createDataFrame([("{}",)], "value string")).count() == 1


def test_sinks(spark, tmp_path):
    wide = spark.createDataFrame([("s", i, float(i), i + 2.5) for i in range(8)], "source string, idx long, a double, b double")
    found = fi.detect_tables(wide, ["a", "b"])
    sinks.write_json(found, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == found.count()
    sinks.write_markdown(found, str(tmp_path / "m"))
    assert "## s" in {r.value for r in spark.read.text(str(tmp_path / "m")).collect()}
    sinks.write_ids(found, "source", str(tmp_path / "i"))
    assert [r.value for r in spark.read.text(str(tmp_path / "i")).collect()] == ["s"]
    ids = spark.range(5)
    assert sinks.write_checkpointed(ids, str(tmp_path / "c"), ["id"]) == 5
    assert sinks.write_checkpointed(spark.range(8), str(tmp_path / "c"), ["id"]) == 3


def test_streams(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "e"))
    q = signals.digit_windows(stream).writeStream.outputMode("complete").format("memory").queryName("digits").start()
    q.processAllAvailable()
    q.stop()
    batch = signals.digit_windows(spark.read.parquet(str(tmp_path / "e")))
    order = lambda df: sorted(map(tuple, df.select(F.col("start").cast("string"), "event_type", "n", "n_05").collect()))
    assert order(spark.table("digits")) == order(batch)
    papers = spark.createDataFrame([("2024-01-01", "a", "x@y.com"), ("2024-01-02", "b", "x@y.com z@y.com"), ("2024-01-02", "b", "x@y.com")], "ts string, paper string, text string").withColumn("ts", F.to_timestamp("ts"))
    papers.write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(papers.schema).parquet(str(tmp_path / "p"))
    q = signals.shared_addresses(stream).writeStream.outputMode("complete").format("memory").queryName("shared").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("shared").collect()] == [("x@y.com", "a", "b", 2)]


def test_command_line(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("a,b\n" + "\n".join(f"{i},{i + 3}" for i in range(12)))
    found = cli.run(spark, cli.parser().parse_args(["tables", str(f), "-x"]))
    assert {"CONSTANT_SHIFT", "CROSS_FILE_FIXED_DIFFERENCE"} <= {r.detector for r in found.collect()}
    assert cli.run(spark, cli.parser().parse_args(["sequences", str(f), "--all"])).count() == 2
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.txt").write_text("差异无统计学意义(P<0.05)")
    assert cli.run(spark, cli.parser().parse_args(["texts", str(tmp_path / "d")])).first().severity == "HIGH"
    assert cli.run(spark, cli.parser().parse_args(["simulate", "--n-sim", "2", "--n-groups", "1", "--n-variables", "2"])).count() >= 0


def test_gaps_are_dropped_not_kept(spark, tmp_path):
    f = tmp_path / "g.csv"
    f.write_text("a\n1\nx\n3\n\n5\n7\n9\n")
    assert columns.arithmetic_sequence(readers.table_cells(spark, str(f)).drop("sheet")).first().n == 5


def test_workbooks(spark, tmp_path):
    book = sinks.workbook({"a & b": [["age", None, "x", "age"], [1, "t", "1,000", 9], [2, None, "50%", 8], [], [3, "u", "nan", 7.5], [4, "v", "2e1"]], "words": [["w"], ["x"], ["y"], ["z"]]})
    (tmp_path / "trial.xlsx").write_bytes(book)
    got = readers.table_cells(spark, str(tmp_path / "trial.xlsx"))
    assert values(got) == {"a & b/age": [9.0, 8.0, 7.5], "a & b/x": [1000.0, 50.0, 20.0]}
    assert {(r.source, r.sheet) for r in got.collect()} == {("trial", "a & b")}
    assert [t for t, _ in readers.workbook_sheets(book, True)] == ["a & b"]
    assert [r[0] for r in readers.parse_tables("s.xlsx", book)] == ["s.xlsx/a & b"] * 6
    with pytest.raises(ValueError, match="not an .xlsx"):
        list(readers.workbook_sheets(b"no workbook"))


def test_workbook_styles_and_strings():
    import io
    import zipfile

    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="{rel}"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="A" r:id="r1"/><sheet name="B" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><x Id="r1" Target="worksheets/a.xml"/><x Id="r2" Target="/xl/worksheets/b.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>plain</t></si><si><r><t>rich </t></r><r><t>text</t></r></si></sst>")
        z.writestr("xl/styles.xml", '<s><numFmts><numFmt numFmtId="164" formatCode="0.0&quot;days&quot;"/><numFmt numFmtId="165" formatCode="yyyy-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></s>')
        z.writestr("xl/worksheets/a.xml", "<w><sheetData/></w>")
        z.writestr("xl/worksheets/b.xml", '<w><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="D2" t="b"><v>1</v></c></row><row r="3"><c r="A3" s="1"><v>45000</v></c><c r="B3" s="2"><v>1.5</v></c><c r="C3" s="3"><v>2</v></c><c r="AA3" t="e"><v>#N/A</v></c></row></sheetData></w>')
    assert list(readers.workbook_sheets(out.getvalue(), True)) == [("B", [[], [None, "rich text", None, "True"], ["date", "1.5", "date", *[None] * 24]])]


def test_supplement_archives():
    import io
    import zipfile

    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("n.csv", "a,b\n1,2\n3,x\n")
        z.writestr("words.csv", "a,b\nx,y\nz,1\nq,r\n")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner.getvalue())
    got = list(readers.parse_tables("s.zip", outer.getvalue()))
    assert got == [("s.zip/in.zip/n.csv", 0, ["a", "b"]), ("s.zip/in.zip/n.csv", 1, ["1", "2"]), ("s.zip/in.zip/n.csv", 2, ["3", "x"])]


def test_trial_metadata(spark):
    study = {"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "T"}, "designModule": {"phases": ["P1", "P2"], "enrollmentInfo": {"count": 7}}}, "hasResults": True}
    r = nested.trial_metadata(spark.createDataFrame([(json.dumps(study),)], "value string")).first()
    assert (r.nct, r.title, r.phases, r.enrollment, r.status, r.has_results) == ("N1", "T", "P1|P2", 7, None, True)


def png(rows: list[bytes]) -> bytes:
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


def test_pictures_to_figures(spark, tmp_path):
    from tallyglass.operators import images

    tile = [bytes((x * 7 + y * 3) % 200 + 20 for x in range(32)) for y in range(32)]
    whole = [row * 4 for row in tile] * 4
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(png(whole))
    (tmp_path / "small.png").write_bytes(png([bytes(20)] * 20))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    got = readers.images(spark, str(tmp_path), 100)
    r = got.first()
    assert got.count() == 1 and (r.height, r.width) == (128, 128) and bytes(r.pixels) == b"".join(whole)
    f = images.figure_bundle(got).first()
    assert (f.duplicates, f.blocks) == (8, 9)
    assert images.frequency_scores(got).count() == 1
