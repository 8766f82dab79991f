"""Word, slide and workbook files as blocks, through a Python data source.

``register(spark)`` makes ``spark.read.format("docweave_office").load(folder)``
available. Files are dealt to partitions by size; a partition reads its files one
after the other, so memory holds one file. A file is a zip of XML parts: their
relationships say which slide, sheet, note, image or pivot cache belongs where;
shared strings and shared items of pivot caches are resolved. What can't be read
becomes one row of type ``error``, and the others go on.

Where only Spark reaches the store, :func:`office_blocks` does the same over a
frame of binary files.

Blocks of a file are numbered in the order: paragraphs, tables, images of a
document; text, tables, images of each slide; table, formulas, pivots, images of
each sheet. Blank paragraphs and empty rows and columns of a sheet make no block.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, block_order int, part int, part_name string, type string, style string, text string, headers array<string>, rows array<array<string>>, ref string, digest string"
#: bytes of files that one partition reads
PARTITION_BYTES = 64 << 20
_BLANKS = " \t\r\n"


class Block(NamedTuple):
    type: str
    text: str = ""
    part: int = 1
    part_name: str | None = None
    style: str | None = None
    headers: list[str] | None = None
    rows: list[list[str]] | None = None
    ref: str | None = None
    digest: str | None = None


def _tag(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _get(node: ElementTree.Element, name: str) -> str | None:
    """An attribute by its local name; names of several namespaces may share it."""
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


def _children(node: ElementTree.Element | None, name: str) -> list[ElementTree.Element]:
    return [] if node is None else [c for c in node if _tag(c) == name]


def _child(node: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    for name in path:
        node = next(iter(_children(node, name)), None)
    return node


class Package:
    """The zip's parts and their relationships."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def relations(self, name: str) -> dict[str, tuple[str, str]]:
        """By id: (kind, target) of what a part refers to inside the file."""
        folder, base = posixpath.split(name)
        rels = f"{folder}/_rels/{base}.rels".lstrip("/")
        if rels not in self.names:
            return {}
        out = {}
        for r in self.xml(rels):
            if r.get("TargetMode") != "External":
                target = r.get("Target", "")
                full = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], full)
        return out

    def targets(self, name: str, kind: str) -> list[str]:
        found = [t for k, t in self.relations(name).values() if k == kind and t in self.names]
        return sorted(found, key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])

    def images(self, name: str, part: int) -> Iterator[Block]:
        for target in self.targets(name, "image"):
            content = self.zip.read(target)
            if content:
                yield Block("image_caption", part=part, ref=target, digest=hashlib.sha256(content).hexdigest())


def _said(node: ElementTree.Element) -> str:
    """Text of a paragraph's runs, tabs and breaks."""
    out = []
    for x in node.iter():
        t = _tag(x)
        out.append(x.text or "" if t == "t" else "\t" if t == "tab" else "\n" if t in ("br", "cr") else "")
    return "".join(out)


def _paragraphs(node: ElementTree.Element | None) -> str:
    return "\n".join(_said(p) for p in _children(node, "p"))


def _table(rows: list[list[str]], **more) -> Block:
    return Block("table", "\n".join(" | ".join(r) for r in rows), headers=rows[0] if rows else [], rows=rows[1:], **more)


def _word_rows(table: ElementTree.Element) -> list[list[str]]:
    """Cells as a grid: one over several columns stands in each, one that goes
    on downwards has the text of the one above."""
    out: list[list[str]] = []
    for tr in _children(table, "tr"):
        row: list[str] = []
        for tc in _children(tr, "tc"):
            props = _child(tc, "tcPr")
            span, merge = _child(props, "gridSpan"), _child(props, "vMerge")
            text = _paragraphs(tc).strip(_BLANKS)
            if merge is not None and _get(merge, "val") != "restart" and out and len(row) < len(out[-1]):
                text = out[-1][len(row)]
            row += [text] * int(_get(span, "val") or 1 if span is not None else 1)
        out.append(row)
    return out


def word_blocks(content: bytes) -> Iterator[Block]:
    package = Package(content)
    main = "word/document.xml"
    styles = {}
    for target in package.targets(main, "styles"):
        for s in _children(package.xml(target), "style"):
            name = _child(s, "name")
            styles[_get(s, "styleId")] = _get(name, "val") if name is not None else None
    body = _child(package.xml(main), "body")
    for p in _children(body, "p"):
        text = _said(p).strip(_BLANKS)
        style = _child(p, "pPr", "pStyle")
        name = (styles.get(_get(style, "val")) or _get(style, "val")) if style is not None else "Normal"
        if text:
            yield Block("heading" if name and name.lower().startswith(("heading", "title")) else "text", text, style=name)
    for table in _children(body, "tbl"):
        yield _table(_word_rows(table))
    yield from package.images(main, 1)


def _shapes(tree: ElementTree.Element | None) -> Iterator[ElementTree.Element]:
    """Shapes in order, those of groups in the group's place."""
    for shape in tree if tree is not None else ():
        if _tag(shape) == "grpSp":
            yield from _shapes(shape)
        else:
            yield shape


def slide_blocks(content: bytes) -> Iterator[Block]:
    package = Package(content)
    main = "ppt/presentation.xml"
    relations = package.relations(main)
    shown = _child(package.xml(main), "sldIdLst")
    rel_ns = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    for number, slide in enumerate(_children(shown, "sldId"), 1):
        name = relations[slide.get(rel_ns, "")][1]
        shapes = list(_shapes(_child(package.xml(name), "cSld", "spTree")))
        parts = [t for s in shapes if _tag(s) == "sp" and (t := _paragraphs(_child(s, "txBody")).strip(_BLANKS))]
        for target in package.targets(name, "notesSlide"):
            for s in _shapes(_child(package.xml(target), "cSld", "spTree")):
                place = _child(s, "nvSpPr", "nvPr", "ph")
                note = _paragraphs(_child(s, "txBody")).strip(_BLANKS)
                if place is not None and place.get("type") == "body" and note:
                    parts.append(f"Speaker Notes: {note}")
        if parts:
            yield Block("text", "\n".join(parts), part=number)
        for s in shapes:
            grid = _child(s, "graphic", "graphicData", "tbl")
            if grid is not None:
                rows = [[_paragraphs(_child(tc, "txBody")).strip(_BLANKS) for tc in _children(tr, "tc")] for tr in _children(grid, "tr")]
                yield _table(rows, part=number)
        yield from package.images(name, number)


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _number(text: str) -> str:
    """Whole numbers without a point, others as written."""
    try:
        value = float(text)
    except ValueError:
        return text
    return str(int(value)) if value == int(value) and abs(value) < 2**53 else text


def _cells(package: Package, name: str, strings: list[str]) -> Iterator[tuple[int, int, str, str | None]]:
    """(row, column, value, formula) of a sheet's cells, read as a stream."""
    with package.zip.open(name) as f:
        row = 0
        for _, node in ElementTree.iterparse(f):
            if _tag(node) != "row":
                continue
            row = int(node.get("r") or row + 1)
            column = 0
            for c in _children(node, "c"):
                at = re.match("[A-Z]+", c.get("r") or "")
                column = _column(at[0]) if at else column + 1
                kind, v, f_ = c.get("t", "n"), _child(c, "v"), _child(c, "f")
                text = "" if v is None else v.text or ""
                if kind == "s":
                    text = strings[int(text)] if text else ""
                elif kind == "inlineStr":
                    inline = _child(c, "is")
                    text = _said(inline) if inline is not None else ""
                elif kind == "b":
                    text = {"1": "TRUE", "0": "FALSE"}.get(text, text)
                elif kind == "n":
                    text = _number(text) if text else ""
                yield row, column, text, None if f_ is None else f"={f_.text or ''}"
            node.clear()


def _grid(cells: list[tuple[int, int, str]]) -> list[list[str]]:
    """Rows without the empty rows and columns."""
    full = [(r, c, t) for r, c, t in cells if t.strip(_BLANKS)]
    columns = {c: k for k, c in enumerate(sorted({c for _, c, _ in full}))}
    rows: dict[int, list[str]] = {}
    for r, c, t in full:
        rows.setdefault(r, [""] * len(columns))[columns[c]] = t
    return [rows[r] for r in sorted(rows)]


def _shared_item(node: ElementTree.Element) -> str:
    kind, v = _tag(node), node.get("v")
    return "" if kind == "m" or v is None else {"1": "TRUE", "0": "FALSE"}.get(v, v) if kind == "b" else _number(v) if kind == "n" else v


def _pivot(package: Package, name: str, sheet: str, number: int) -> Iterator[Block]:
    """A pivot table's cache: its fields and its records, shared items resolved."""
    title = package.xml(name).get("name") or "unnamed_pivot"
    for cache in package.targets(name, "pivotCacheDefinition"):
        definition = package.xml(cache)
        source = _child(definition, "cacheSource", "worksheetSource")
        fields = _children(_child(definition, "cacheFields"), "cacheField")
        items = [[_shared_item(i) for i in (_child(f, "sharedItems") if _child(f, "sharedItems") is not None else ())] for f in fields]
        headers = [f.get("name") or f"field_{k}" for k, f in enumerate(fields)]
        rows = []
        for target in package.targets(cache, "pivotCacheRecords"):
            for record in _children(package.xml(target), "r"):
                rows.append([items[k][int(x.get("v", "0"))] if _tag(x) == "x" else _shared_item(x) for k, x in enumerate(record)])
        if headers or rows:
            yield Block("pivot", "\n".join(" | ".join(r) for r in [headers, *rows]), number, sheet, title, headers, rows, source.get("ref") if source is not None else None)


def workbook_blocks(content: bytes) -> Iterator[Block]:
    package = Package(content)
    main = "xl/workbook.xml"
    relations = package.relations(main)
    strings = [_said(si) for t in package.targets(main, "sharedStrings") for si in _children(package.xml(t), "si")]
    rel_ns = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    for number, sheet in enumerate(_children(_child(package.xml(main), "sheets"), "sheet"), 1):
        title, name = sheet.get("name", ""), relations[sheet.get(rel_ns, "")][1]
        cells, formulas = [], []
        for r, c, text, formula in _cells(package, name, strings):
            cells.append((r, c, text))
            if formula:
                formulas.append(Block("formula", formula, number, title, ref=f"{title}!{column_letters(c)}{r}"))
        grid = _grid(cells)
        if grid:
            heads = [h if h.strip(_BLANKS) else f"column_{k}" for k, h in enumerate(grid[0])]
            yield _table([heads, *grid[1:]], part=number, part_name=title, ref=f"{title}!A1:{column_letters(len(heads))}{len(grid)}")
        yield from formulas
        for target in package.targets(name, "pivotTable"):
            yield from _pivot(package, target, title, number)
        for drawing in package.targets(name, "drawing"):
            yield from package.images(drawing, number)


READERS = {"docx": word_blocks, "pptx": slide_blocks, "xlsx": workbook_blocks, "xlsm": workbook_blocks}


def file_rows(path: str, content: bytes) -> list[tuple]:
    """A file's rows in the order of :data:`SCHEMA`; all or an error."""
    reader = READERS.get(path.rpartition(".")[2].lower())
    try:
        if reader is None:
            raise ValueError("not a Word, slide or workbook file")
        found = list(reader(content))
    except Exception as e:  # noqa: BLE001  a broken file is a row, whatever is broken in it
        found = [Block("error", f"{type(e).__name__}: {e}")]
    return [(path, k, b.part, b.part_name, b.type, b.style, b.text, b.headers, b.rows, b.ref, b.digest) for k, b in enumerate(found)]


_ARROW = pa.schema(
    [("path", pa.string()), ("block_order", pa.int32()), ("part", pa.int32()), ("part_name", pa.string()), ("type", pa.string()), ("style", pa.string()), ("text", pa.string())]
    + [("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("ref", pa.string()), ("digest", pa.string())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        uri = self.options["path"]
        fs, base = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        found = fs.get_file_info(base) if fs.get_file_info(base).type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, recursive=True))
        found = found if isinstance(found, list) else [found]
        files = sorted((f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: -f.size)
        most = int(self.options.get("partitionbytes", PARTITION_BYTES))
        parts: list[list[str]] = []
        size = most
        for f in files:
            if size + f.size > most:
                parts.append([])
                size = 0
            parts[-1].append(f.path)
            size += f.size
        return [_Files(p) for p in parts] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        uri = self.options["path"]
        fs, _ = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        for path in partition.paths:
            with fs.open_input_stream(path) as f:
                rows = file_rows(path, f.read())
            if rows:
                yield _batch(rows)


class OfficeFiles(DataSource):
    """``spark.read.format("docweave_office").load(folder)``; ``partitionBytes`` says
    how many bytes of files a partition takes."""

    @classmethod
    def name(cls) -> str:
        return "docweave_office"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OfficeFiles)


def office_blocks(files: DataFrame) -> DataFrame:
    """The same rows from a frame with path and content (``binaryFile``)."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for k in range(b.num_rows):
                rows = file_rows(b.column(0)[k].as_py(), b.column(1)[k].as_py())
                if rows:
                    yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
