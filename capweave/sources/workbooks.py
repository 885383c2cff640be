"""Workbooks (Office Open XML) as a Spark data source, `workbook`: one file a document to write; cells or layout to read.

    workbooks.register(spark)
    workbooks.write(sheet_lines, path)                         # or .write.format("workbook")
    workbooks.cells(spark, path).where("row_no >= 14")

Writing: rows (doc_id, row_no, xml, merged), where xml is a whole <row> element, made by Spark from a table of cells (sheet_xml()).
A task streams its documents' rows, sorted by document and row, into files of a folder of its own attempt; only the job's commit moves them to their place, so a
task that fails or runs twice leaves no file, and abort removes all there is. Memory: some rows, and a document's merged ranges. What all files share is made and
compressed once a task. With the option `folders`, files stay in folders of up to FOLDER_FILES files, books-*, which the commit moves whole: then nothing on the
driver grows with the files but by their folders, and remove() deletes them in tasks.

Reading: `part` is cells (a row a cell) or layout (merged ranges, widths, heights, validations). A partition has one sheet of a large file, small files up to
PART_BYTES, or a folder that the writer made, listed by its task. Sheets beyond WHOLE_BYTES are parsed as a stream. Only columns of the given schema are made. Filters on doc_id (the file's name), sheet, row_no and col are pushed:
files, sheets and rows that can't fit aren't opened or made (spark.sql.python.filterPushdown.enabled). Shared and inline strings, formulas with their
values and number formats are understood; values are text as stored.

Paths are what pyarrow's file systems open (local, HDFS, object stores). Null doc_ids aren't written. Characters that XML can't hold are escaped as _xHHHH_, and back.
"""

from __future__ import annotations

import io
import itertools
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PART_BYTES = 8 << 20
WHOLE_BYTES = 1 << 20
FOLDER_FILES = 2_000
FOLDER = "books-"
ROWS = "doc_id string, row_no int, xml string, merged string"
CELLS = "doc_id string, sheet string, row_no int, col string, kind string, value string, formula string, number_format string"
LAYOUT = "doc_id string, sheet string, kind string, ref string, value string"
# Names and numbers of the file format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
BUILT_IN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "mm-dd-yy", 49: "@"}
_FIRST_OWN = 164
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
BATCH = 5_000


# ---------------------------------------------------------------- cells to XML, in Spark


def escaped(x: Column) -> Column:
    """Text for an element: markup, characters that XML can't hold or would change, and what looks like their escapes."""
    codes = [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0D, 0x20), 0xFFFE, 0xFFFF]
    plain = F.regexp_replace(x, "_(?=x[0-9A-Fa-f]{4}_)", "_x005F_")
    odd = plain
    for c in codes:
        odd = F.replace(odd, F.lit(chr(c)), F.lit(f"_x{c:04X}_"))
    out = F.when(x.rlike("[\\x00-\\x08\\x0B-\\x1F\\uFFFE\\uFFFF]"), odd).otherwise(plain)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    # Most texts have none of these.
    return F.when(x.rlike("[&<>_\\x00-\\x08\\x0B-\\x1F\\uFFFE\\uFFFF]"), out).otherwise(x)


def sheet_xml(lines: DataFrame, formats: tuple[str, ...]) -> DataFrame:
    """ROWS of lines (doc_id, row_no, merged, cells: array of structs of col, text, number, formula, number_format). A cell with neither text nor number is
    left out; columns within a line are in order. formats: the workbook's number formats; others count as General."""

    def style(x: Column) -> Column:
        out = F
        for i, f in enumerate(formats):
            out = out.when(x["number_format"] == f, f'" s="{i + 1}"')
        return F.lit('"') if out is F else out.otherwise('"')

    def cell(x: Column) -> Column:
        start = (F.lit('<c r="'), x["col"], F.col("__n"), style(x))
        formula = F.when(x["formula"].isNotNull(), F.concat(F.lit("<f>"), escaped(x["formula"]), F.lit("</f>"))).otherwise("")
        kept = F.when(x["text"].rlike(r"^\s|\s\z|\s\s|[\t\n]"), ' t="inlineStr"><is><t xml:space="preserve">').otherwise(' t="inlineStr"><is><t>')
        text = F.concat(*start, kept, escaped(x["text"]), F.lit("</t></is></c>"))
        number = F.concat(*start, F.lit(">"), formula, F.lit("<v>"), x["number"], F.lit("</v></c>"))
        return F.when(x["text"].isNotNull(), text).when(x["number"].isNotNull(), number).otherwise("")

    lines = lines.withColumn("__n", F.col("row_no").cast("string"))
    number = F.col("__n")
    xml = F.concat(F.lit('<row r="'), number, F.lit('">'), F.array_join(F.transform("cells", cell), ""), F.lit("</row>"))
    merged = F.transform(F.split("merged", ":"), lambda c: F.concat(c, number))
    return lines.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("row_no").cast("int").alias("row_no"), xml.alias("xml"), F.array_join(merged, ":").alias("merged"))


# ---------------------------------------------------------------- writing


def _root(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _is_folder(f: fs.FileInfo) -> bool:
    """Whether a writer's task made it for its files."""
    return f.type == fs.FileType.Directory and f.base_name.startswith(FOLDER)


@dataclass
class Wrote(ds.WriterCommitMessage):
    """A task's files, or its folders of files: where each is, and its name."""

    files: list[tuple[str, str]]


class WorkbookWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.sheet = options.get("sheet", "Sheet1")
        self.formats = [v for k, v in sorted(options.items()) if re.fullmatch(r"format\d+", k)]
        self.widths = [x.split("=") for x in options.get("widths", "").split(",") if x]
        self.folders = options.get("folders", "false").lower() == "true"

    def _work(self, root: str) -> str:
        return f"{root}/_workbooks-{self.job}"

    def _styles(self) -> str:
        own = "".join(f'<numFmt numFmtId="{_FIRST_OWN + i}" formatCode={quoteattr(f)}/>' for i, f in enumerate(self.formats))
        kinds = "".join(f'<xf numFmtId="{n}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for n in [0, *(_FIRST_OWN + i for i in range(len(self.formats)))])
        plain = '<fonts count="1"><font/></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        return f'{_HEAD}<styleSheet xmlns="{_MAIN}">' + (f'<numFmts count="{len(self.formats)}">{own}</numFmts>' if own else "") + f'{plain}<cellXfs count="{len(self.formats) + 1}">{kinds}</cellXfs></styleSheet>'

    def _parts(self) -> dict[str, str]:
        types = "".join(f'<Override PartName="/xl/{n}.xml" ContentType="{_TYPE}.{t}+xml"/>' for n, t in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("styles", "styles")))
        to = lambda n, kind, target: f'<Relationship Id="rId{n}" Type="{_REL}/{kind}" Target="{target}"/>'
        relations = lambda inner: f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{inner}</Relationships>'
        return {
            "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>',
            "_rels/.rels": relations(to(1, "officeDocument", "xl/workbook.xml")),
            "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name={quoteattr(self.sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": relations(to(1, "worksheet", "worksheets/sheet1.xml") + to(2, "styles", "styles.xml")),
            "xl/styles.xml": self._styles(),
        }

    def _shared(self) -> tuple[bytes, list[zipfile.ZipInfo]]:
        """What every file begins with, and the archive's entries of it."""
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            for part, text in self._parts().items():
                book.writestr(part, text)
            return out.getvalue(), book.filelist

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        system, root = _root(self.path)
        own, files = f"{self._work(root)}/{uuid.uuid4().hex}", []
        system.create_dir(own, recursive=True)
        (begin, entries), folder, room, left = self._shared(), own, 0, 0
        columns = "".join(f'<col min="{ord(c) - 64}" max="{ord(c) - 64}" width="{w}" customWidth="1"/>' for c, w in self.widths)
        head = f'{_HEAD}<worksheet xmlns="{_MAIN}">{f"<cols>{columns}</cols>" if columns else ""}<sheetData>'
        now = stream = book = sheet = None
        merged: list[str] = []
        text: list[str] = []

        def flush():
            sheet.write("".join(text).encode())
            text.clear()

        def close():
            nonlocal room, left
            if book:
                ranges = "".join(f'<mergeCell ref="{m}"/>' for m in merged)
                text.append("</sheetData>" + (f'<mergeCells count="{len(merged)}">{ranges}</mergeCells>' if merged else "") + "</worksheet>")
                flush()
                sheet.close()
                book.close()
                room, left = room - stream.tell(), left - 1
                stream.close()

        seen: set[str] = set()
        for batch in iterator:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            for doc, xml, merge in zip(*(batch.column(at[c]).to_pylist() for c in ("doc_id", "xml", "merged"))):
                if doc is None:
                    continue
                if doc != now:
                    close()
                    if doc in seen:
                        raise ValueError(f"rows of {doc!r} aren't together; sort by doc_id and row_no, as write() does")
                    seen.add(doc)
                    now, name = doc, f"{quote(doc, safe='')}.xlsx"
                    if not self.folders:
                        files.append((f"{own}/{name}", name))
                    elif left <= 0 or room <= 0:
                        to = f"{FOLDER}{uuid.uuid4().hex}"
                        folder, room, left = f"{own}/{to}", PART_BYTES, FOLDER_FILES
                        system.create_dir(folder)
                        files.append((folder, to))
                    stream = system.open_output_stream(f"{folder}/{name}", buffer_size=1 << 16)
                    stream.write(begin)
                    book = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                    book.filelist += entries
                    sheet = book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
                    text.append(head)
                    merged.clear()
                text.append(xml)
                if len(text) >= 256:
                    flush()
                if merge:
                    merged.append(merge)
        close()
        return Wrote(files)

    def commit(self, messages: list[Wrote | None]) -> None:
        system, root = _root(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.is_file and f.base_name.endswith(".xlsx"):
                    system.delete_file(f.path)
                elif _is_folder(f):
                    system.delete_dir(f.path)
        for m in messages:
            for at, name in m.files if m else ():
                system.move(at, f"{root}/{name}")
        self._clear(system, root)

    def abort(self, messages: list[Wrote | None]) -> None:
        self._clear(*_root(self.path))

    def _clear(self, system, root) -> None:
        if system.get_file_info(self._work(root)).type != fs.FileType.NotFound:
            system.delete_dir(self._work(root))


# ---------------------------------------------------------------- reading


@dataclass
class Part(ds.InputPartition):
    """Files, as (doc_id, path); of one file, perhaps only the sheets named. Or the files of a folder."""

    files: list[tuple[str, str]]
    sheets: list[str] | None = None
    folder: str | None = None


def _unescaped(x: str) -> str:
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), x) if "_x" in x else x


_T, _R, _PHONETIC, _ROW, _C, _V, _F, _IS = (f"{{{_MAIN}}}{n}" for n in ("t", "r", "rPh", "row", "c", "v", "f", "is"))
_KINDS = {"s": "text", "str": "text", "inlineStr": "text", "n": "number", "b": "boolean", "e": "error"}


def _text(element) -> str:
    """Of a rich or plain string, without the reading aids beside it."""
    if len(element) == 1 and element[0].tag == _T:
        return _unescaped(element[0].text or "")
    aids = element.findall(f"{_PHONETIC}/{_T}")
    return "".join(_unescaped(t.text or "") for t in element.iter(_T) if t not in aids)


class Workbook:
    """An open file: names and places of its sheets, its number formats and shared strings (read when first asked for). known: what parts of the file read before
    say; files that one program made mostly have the same."""

    def __init__(self, file, known: dict[str, tuple] | None = None):
        self.zip = zipfile.ZipFile(file)
        self._has, self._known = set(self.zip.namelist()), {} if known is None else known
        self.sheets: dict[str, str] = self._parsed(self._places, "xl/workbook.xml", "xl/_rels/workbook.xml.rels")
        self._formats = self._strings = None

    def _parsed(self, parse, *names: str):
        """parse(*parts), once for equal parts in a row."""
        parts = tuple(self.zip.read(n) for n in names)
        before, out = self._known.get(names[0], (None, None))
        if parts != before:
            out = parse(*parts)
            self._known[names[0]] = parts, out
        return out

    @staticmethod
    def _places(book: bytes, relations: bytes) -> dict[str, str]:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(relations)}
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        return {s.get("name"): place(targets[s.get(f"{{{_REL}}}id")]) for s in ElementTree.fromstring(book).iter(f"{{{_MAIN}}}sheet")}

    @staticmethod
    def _number_formats(styles: bytes) -> list[str]:
        tree = ElementTree.fromstring(styles)
        own = {int(f.get("numFmtId")): f.get("formatCode") for f in tree.iter(f"{{{_MAIN}}}numFmt")}
        return [own.get(n := int(x.get("numFmtId") or 0), BUILT_IN.get(n, str(n))) for x in tree.findall(f"{{{_MAIN}}}cellXfs/{{{_MAIN}}}xf")]

    @property
    def formats(self) -> list[str]:
        if self._formats is None:
            self._formats = self._parsed(self._number_formats, "xl/styles.xml") if "xl/styles.xml" in self._has else []
        return self._formats

    @property
    def strings(self) -> list[str]:
        if self._strings is None:
            self._strings = []
            if "xl/sharedStrings.xml" in self._has:
                with self.zip.open("xl/sharedStrings.xml") as f:
                    for _, e in ElementTree.iterparse(f):
                        if e.tag == f"{{{_MAIN}}}si":
                            self._strings.append(_text(e))
                            e.clear()
        return self._strings

    def _elements(self, sheet: str, tag: str | None = None):
        """Finished elements (of a tag); a large sheet is parsed as a stream, and its rows are cleared when they were taken."""
        part = self.sheets[sheet]
        if self.zip.getinfo(part).file_size <= WHOLE_BYTES:
            yield from ElementTree.fromstring(self.zip.read(part)).iter(tag)
            return
        with self.zip.open(part) as f:
            for _, e in ElementTree.iterparse(f):
                if tag is None or e.tag == tag:
                    yield e
                if e.tag == _ROW:
                    e.clear()

    def cells(self, sheet: str, fits=None) -> Iterator[tuple]:
        """(row_no, col, kind, value, formula, number_format) of cells with content; fits(row_no, col): whether one is wanted."""
        row, formats = 0, self.formats
        for line in self._elements(sheet, _ROW):
            row, col = int(line.get("r") or row + 1), ""
            for e in line.iter(_C):
                col = (e.get("r") or "").rstrip("0123456789") or _column(_number(col) + 1)
                if fits and not fits(row, col):
                    continue
                kind, v, f, inline = e.get("t") or "n", e.find(_V), e.find(_F), e.find(_IS)
                value = _text(inline) if inline is not None else None if v is None else self.strings[int(v.text)] if kind == "s" else _unescaped(v.text or "")
                if value is not None or f is not None:
                    style = int(e.get("s") or 0)
                    yield row, col, _KINDS.get(kind, kind), value, None if f is None else _unescaped(f.text or ""), formats[style] if style < len(formats) else BUILT_IN[0]

    def layout(self, sheet: str) -> Iterator[tuple]:
        """(kind, ref, value): merged ranges, widths of columns, heights of rows, validations."""
        names: dict[str, str] = {}
        for e in self._elements(sheet):
            tag = names.get(e.tag)
            if tag is None:
                tag = names[e.tag] = e.tag.rpartition("}")[2]
            if tag == "row":
                if e.get("ht"):
                    yield "height", e.get("r"), e.get("ht")
            elif tag == "mergeCell":
                yield "merged", e.get("ref"), None
            elif tag == "col":
                yield "width", f"{_column(int(e.get('min')))}:{_column(int(e.get('max')))}", e.get("width")
            elif tag == "dataValidation":
                formula = e.find(f"{{{_MAIN}}}formula1")
                yield "validation", e.get("sqref"), f"{e.get('type')}: {'' if formula is None else formula.text}"


def _column(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _number(col: str) -> int:
    n = 0
    for c in col:
        n = 26 * n + ord(c) - 64
    return n


_TESTS = {
    ds.EqualTo: lambda x, v: x == v,
    ds.GreaterThan: lambda x, v: x > v,
    ds.GreaterThanOrEqual: lambda x, v: x >= v,
    ds.LessThan: lambda x, v: x < v,
    ds.LessThanOrEqual: lambda x, v: x <= v,
    ds.In: lambda x, v: x in v,
    ds.StringStartsWith: lambda x, v: x.startswith(v),
}
_PUSHED = ("doc_id", "sheet", "row_no", "col")


class WorkbookReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.part, self.names = options["path"], options.get("part", "cells"), schema.names
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) is ds.IsNotNull and column in _PUSHED:
                continue  # they never are null
            if type(f) in _TESTS and column in (_PUSHED if self.part == "cells" else _PUSHED[:2]):
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def _fits(self, **values) -> bool:
        return all(_TESTS[kind](values[c], v) for c, kind, v in self.tests if c in values)

    def _doc(self, f: fs.FileInfo) -> str | None:
        """The doc_id of a file that is wanted."""
        doc = unquote(f.base_name.removesuffix(".xlsx"))
        return doc if f.is_file and f.base_name.endswith(".xlsx") and self._fits(doc_id=doc) else None

    def partitions(self):
        system, root = _root(self.path)
        found = system.get_file_info(fs.FileSelector(root)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        out, held, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            if _is_folder(f):
                out.append(Part([], folder=f.path))
                continue
            doc = self._doc(f)
            if doc is None:
                continue
            if f.size > PART_BYTES:
                with system.open_input_file(f.path) as file:
                    out += [Part([(doc, f.path)], [s]) for s in Workbook(file).sheets if self._fits(sheet=s)]
                continue
            if held and size + f.size > PART_BYTES:
                out.append(Part(held))
                held, size = [], 0
            held.append((doc, f.path))
            size += f.size
        return [*out, Part(held)] if held or not out else out

    def _rows(self, partition: Part) -> Iterator[tuple]:
        """Rows with all columns."""
        system, _ = _root(self.path)
        files = partition.files
        if partition.folder:
            found = system.get_file_info(fs.FileSelector(partition.folder))
            files = [(doc, f.path) for f in found if (doc := self._doc(f)) is not None]
        fits = (lambda r, c: self._fits(row_no=r, col=c)) if any(c in ("row_no", "col") for c, _, _ in self.tests) else None
        known: dict[str, tuple] = {}
        for doc, path in files:
            with system.open_input_file(path) as file:
                book = Workbook(io.BytesIO(file.read()) if file.size() <= PART_BYTES else file, known)
                for sheet in partition.sheets or book.sheets:
                    if self._fits(sheet=sheet):
                        for row in book.cells(sheet, fits) if self.part == "cells" else book.layout(sheet):
                            yield doc, sheet, *row

    def _taken(self) -> list[int]:
        """Places of the asked columns."""
        all_names = [c.split()[0] for c in (CELLS if self.part == "cells" else LAYOUT).split(", ")]
        return [all_names.index(n) for n in self.names]

    def read(self, partition: Part) -> Iterator[tuple]:
        take = self._taken()
        for row in self._rows(partition):
            yield tuple(row[i] for i in take)


class WorkbookArrowReader(WorkbookReader):
    """The same rows as Arrow batches."""

    def __init__(self, options: dict[str, str], schema: StructType):
        super().__init__(options, schema)
        self.arrow = to_arrow_schema(schema)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        take, rows = self._taken(), self._rows(partition)
        while batch := list(itertools.islice(rows, BATCH)):
            columns = list(zip(*batch))
            yield pa.RecordBatch.from_arrays([pa.array(columns[i], f.type) for i, f in zip(take, self.arrow)], schema=self.arrow)


class WorkbookSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS if self.options.get("part", "cells") == "cells" else LAYOUT

    def reader(self, schema: StructType) -> WorkbookArrowReader:
        return WorkbookArrowReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        if missing := {"doc_id", "row_no", "xml", "merged"} - set(schema.names):
            raise ValueError(f"a workbook's rows need {sorted(missing)}")
        return WorkbookWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(rows: DataFrame, path: str, formats: tuple[str, ...] = (), widths: dict[str, float] | None = None, sheet: str = "Sheet1", mode: str = "append", folders: bool = False) -> None:
    """Writes ROWS, one file a document. A document's rows go through one task, as a stream. folders: files stay in folders, for very many of them."""
    register(rows.sparkSession)
    dealt = rows.where("doc_id IS NOT NULL").repartition("doc_id").sortWithinPartitions("doc_id", "row_no")
    out = dealt.write.format("workbook").mode(mode).option("path", path).option("sheet", sheet).option("folders", str(folders)).option("widths", ",".join(f"{c}={w}" for c, w in (widths or {}).items()))
    for i, f in enumerate(formats):
        out = out.option(f"format{i:03d}", f)
    out.save()


def _delete(folders: Iterator[str]) -> None:
    for f in folders:
        system, at = _root(f)
        if system.get_file_info(at).type != fs.FileType.NotFound:  # of a task that runs twice
            system.delete_dir(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of workbooks; what the writer's folders hold is deleted by tasks."""
    system, root = _root(path)
    folders = [f"{path}/{f.base_name}" for f in system.get_file_info(fs.FileSelector(root)) if _is_folder(f)]
    if folders:
        spark.sparkContext.parallelize(folders, len(folders)).foreachPartition(_delete)
    system.delete_dir(root)


def _read(spark: SparkSession, path: str, part: str, columns: tuple[str, ...]) -> DataFrame:
    register(spark)
    whole = StructType.fromDDL(CELLS if part == "cells" else LAYOUT)
    schema = StructType([whole[c] for c in columns]) if columns else whole
    return spark.read.format("workbook").option("path", path).option("part", part).schema(schema).load()


def cells(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """CELLS of all workbooks in a folder, or of one; with names, these columns only."""
    return _read(spark, path, "cells", columns)


def layout(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """LAYOUT of all workbooks in a folder, or of one."""
    return _read(spark, path, "layout", columns)
