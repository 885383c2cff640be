"""The workbook source and sink: files written, failed and read."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from capweave.sources import workbooks

CELL = "array<struct<col:string,text:string,number:string,formula:string,number_format:string>>"


def sheets(spark, docs):
    """docs: doc_id -> row_no -> cells."""
    rows = [(d, r, m, c) for d, lines in docs.items() for r, (m, c) in lines.items()]
    return workbooks.sheet_xml(spark.createDataFrame(rows, f"doc_id string, row_no int, merged string, cells {CELL}").repartition(3), ("#,##0", '"a"&0'))


ODD = "<&>\" '_x0041_ \r\n\t \x01\x0b é 한 \U0001f600  "


def test_cells_come_back(spark, tmp_path):
    docs = {
        "a/b?": {14: ("C:D", [("C", ODD, None, None, None), ("E", None, "1.5", "SUM(E1:E3)", "#,##0"), ("F", None, "2", None, '"a"&0'), ("G", None, None, None, None)]), 2: (None, [("B", "", None, None, None)])},
        "한": {1: (None, [("AA", "x", None, None, None)])},
    }
    path = str(tmp_path / "books")
    workbooks.write(sheets(spark, docs), path, ("#,##0", '"a"&0'), {"A": 5.125, "C": 38.25}, 'S & "T"')
    assert sorted(os.listdir(path)) == ["%ED%95%9C.xlsx", "a%2Fb%3F.xlsx"]
    got = {tuple(r) for r in workbooks.cells(spark, path).collect()}
    assert got == {
        ("a/b?", 'S & "T"', 2, "B", "text", "", None, "General"), ("a/b?", 'S & "T"', 14, "C", "text", ODD, None, "General"), ("a/b?", 'S & "T"', 14, "E", "number", "1.5", "SUM(E1:E3)", "#,##0"),
        ("a/b?", 'S & "T"', 14, "F", "number", "2", None, '"a"&0'), ("한", 'S & "T"', 1, "AA", "text", "x", None, "General"),
    }
    assert {tuple(r) for r in workbooks.layout(spark, path).where("doc_id = 'a/b?'").collect()} == {("a/b?", 'S & "T"', "merged", "C14:D14", None), ("a/b?", 'S & "T"', "width", "A:A", "5.125"), ("a/b?", 'S & "T"', "width", "C:C", "38.25")}
    for f in os.listdir(path):
        assert zipfile.ZipFile(f"{path}/{f}").testzip() is None


def test_filters_and_columns_are_pushed(spark, tmp_path):
    docs = {f"d{i}": {r: (None, [("B", f"{i}.{r}", None, None, None), ("C", None, str(r), None, None)]) for r in range(1, 6)} for i in range(4)}
    path = str(tmp_path / "books")
    workbooks.write(sheets(spark, docs), path)
    out = workbooks.cells(spark, path, "doc_id", "value").where("doc_id = 'd2'")
    assert out.columns == ["doc_id", "value"] and out.count() == 10
    out = workbooks.cells(spark, path).where("doc_id IN ('d1', 'd3') AND row_no >= 4 AND col = 'B' AND value LIKE '%5'")
    assert sorted(r["value"] for r in out.collect()) == ["1.5", "3.5"]
    reader = workbooks.WorkbookReader({"path": path}, out.schema)
    rest = list(reader.pushFilters([workbooks.ds.EqualTo(("doc_id",), "d2"), workbooks.ds.LessThan(("row_no",), 3), workbooks.ds.EqualTo(("value",), "x")]))
    assert [f.attribute for f in rest] == [("value",)] and [x for p in reader.partitions() for x, _ in p.files] == ["d2"]
    assert {(r[2], r[0]) for p in reader.partitions() for r in reader.read(p)} == {(1, "d2"), (2, "d2")}


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "books")
    rows = sheets(spark, {f"d{i}": {1: (None, [("B", "x", None, None, None)])} for i in range(20)})
    broken = rows.withColumn("xml", F.when(F.col("doc_id") == "d7", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("xml")))
    with pytest.raises(Exception, match="broken"):
        workbooks.write(broken, path)
    assert not [f for _, _, files in os.walk(path) for f in files]
    workbooks.write(rows, path)
    workbooks.write(rows.where("doc_id = 'd1'"), path, mode="overwrite")
    assert os.listdir(path) == ["d1.xlsx"]


def test_rows_that_are_not_together_are_refused(spark, tmp_path):
    writer = workbooks.WorkbookWriter({"path": str(tmp_path / "books")}, False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": ["a", "b", "a"], "row_no": [1, 1, 2], "xml": ["<row/>"] * 3, "merged": [None] * 3})
    with pytest.raises(ValueError, match="together"):
        writer.write(iter([batch]))
    writer.abort([None])
    assert not [f for _, _, files in os.walk(tmp_path) for f in files]
    with pytest.raises(ValueError, match="need"):
        workbooks.WorkbookSource({}).writer(spark.range(1).schema, False)


def test_files_of_other_programs(spark, tmp_path):
    """Shared and rich strings, styles by built-in number, rows and cells without addresses, two sheets, heights and validations."""
    head, main = workbooks._HEAD, workbooks._MAIN
    book = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{workbooks._REL}"><sheets><sheet name="one" sheetId="1" r:id="a"/><sheet name="two" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{workbooks._PACKAGE}/relationships"><Relationship Id="a" Target="/xl/worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="10"/></cellXfs></styleSheet>',
        "xl/worksheets/s1.xml": f'<worksheet xmlns="{main}"><sheetData><row><c t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c><v>7</v></c></row><row ht="20"><c t="b"><v>1</v></c><c s="1"><f>A1</f></c><c s="9"/></row></sheetData></worksheet>',
        "xl/worksheets/s2.xml": f'<worksheet xmlns="{main}"><sheetData><row r="5" ht="30"><c r="A5" t="str"><f>T(1)</f><v>t</v></c></row></sheetData><dataValidations count="1"><dataValidation type="list" sqref="A1:A9"><formula1>"x,y"</formula1></dataValidation></dataValidations></worksheet>',
    }
    os.makedirs(tmp_path / "books")
    with zipfile.ZipFile(tmp_path / "books" / "other.xlsx", "w") as z:
        for name, text in book.items():
            z.writestr(name, head + text)
    (tmp_path / "books" / "note.txt").write_text("not a workbook")
    path = str(tmp_path / "books")
    got = {tuple(r)[1:] for r in workbooks.cells(spark, path).collect()}
    assert got == {
        ("one", 1, "A", "text", "plain", None, "General"), ("one", 1, "C", "text", "rich", None, "General"), ("one", 1, "D", "number", "7", None, "General"), ("one", 2, "A", "boolean", "1", None, "General"),
        ("one", 2, "B", "number", None, "A1", "0.00%"), ("two", 5, "A", "text", "t", "T(1)", "General"),
    }
    assert {tuple(r)[2:] for r in workbooks.layout(spark, path).where("sheet = 'two'").collect()} == {("height", "5", "30"), ("validation", "A1:A9", 'list: "x,y"')}
    assert workbooks.cells(spark, f"{path}/other.xlsx").count() == 6


def test_large_files_have_a_partition_a_sheet(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "books")
    workbooks.write(sheets(spark, {f"d{i}": {1: (None, [("B", "x", None, None, None)])} for i in range(3)}), path)
    reader = workbooks.WorkbookReader({"path": path}, workbooks.cells(spark, path).schema)
    assert len(reader.partitions()) == 1
    monkeypatch.setattr(workbooks, "PART_BYTES", 10)
    assert [(len(p.files), p.sheets) for p in reader.partitions()] == [(1, ["Sheet1"])] * 3
    os.makedirs(tmp_path / "none")
    assert workbooks.cells(spark, str(tmp_path / "none")).count() == 0


def _written(path, n, **options):
    import pyarrow as pa

    writer = workbooks.WorkbookWriter({"path": path, **options}, options.pop("overwrite", False))
    xml = '<row r="1" ht="9"><c r="B1" t="inlineStr"><is><t>x</t></is></c></row>'
    return writer, writer.write(iter([pa.RecordBatch.from_pydict({"doc_id": [f"d{i}" for i in range(n)], "row_no": [1] * n, "xml": [xml] * n, "merged": ["C1:D1"] * n})]))


def test_very_many_files_stay_in_folders(spark, tmp_path, monkeypatch):
    """What the driver holds, moves and lists are folders; tasks list and delete their files."""
    monkeypatch.setattr(workbooks, "FOLDER_FILES", 2)
    path = str(tmp_path / "books")
    writer, wrote = _written(path, 5, folders="true")
    assert len(wrote.files) == 3 and not [f for f in os.listdir(path) if f.startswith("books-")]
    writer.commit([wrote, None])
    assert sorted(len(os.listdir(f"{path}/{f}")) for f in os.listdir(path)) == [1, 2, 2]
    out = workbooks.cells(spark, path, "doc_id", "value")
    assert out.rdd.getNumPartitions() == 3 and sorted(tuple(r) for r in out.collect()) == [(f"d{i}", "x") for i in range(5)]
    assert [tuple(r) for r in out.where("doc_id = 'd3'").collect()] == [("d3", "x")]
    assert workbooks.layout(spark, path).count() == 10
    writer, wrote = _written(path, 1, folders="true", overwrite=True)
    writer.commit([wrote])
    assert [r["doc_id"] for r in workbooks.cells(spark, path).collect()] == ["d0"]
    workbooks.write(sheets(spark, {"e": {1: (None, [("B", "y", None, None, None)])}}), path, folders=True)
    assert sorted(r["value"] for r in workbooks.cells(spark, path).collect()) == ["x", "y"]
    workbooks.remove(spark, path)
    assert not os.path.exists(path)


def test_equal_parts_are_parsed_once_and_large_sheets_as_a_stream(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "books")
    writer, wrote = _written(path, 20)
    writer.commit([wrote])
    parsed, real = [], workbooks.ElementTree.fromstring
    monkeypatch.setattr(workbooks.ElementTree, "fromstring", lambda x: parsed.append(x) or real(x))
    for ddl, part in ((workbooks.CELLS, "cells"), (workbooks.LAYOUT, "layout")):
        reader = workbooks.WorkbookReader({"path": path, "part": part}, workbooks.StructType.fromDDL(ddl))
        parsed.clear()
        whole = [r for p in reader.partitions() for r in reader.read(p)]
        assert len(parsed) <= 20 + 3 and len(whole) == (20 if part == "cells" else 40)
        monkeypatch.setattr(workbooks, "WHOLE_BYTES", 10)
        assert sorted(map(str, (r for p in reader.partitions() for r in reader.read(p)))) == sorted(map(str, whole))
        monkeypatch.setattr(workbooks, "WHOLE_BYTES", 1 << 20)
