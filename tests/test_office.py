"""Office files: broken ones, merged cells, groups, shared items, partitions."""

import io
import zipfile

import pytest
from docweave.sources import office, office_writer
from pyspark.sql import functions as F


@pytest.fixture()
def folder(tmp_path):
    word = office_writer.word_file([("Heading1", "Head"), ("Normal", " body\twith tab "), ("Normal", "  ")], [[["a", "b"], ["1", "<2>"]]], [b"png"])
    slides = office_writer.slide_file([(["one", "two", "three"], [], "say it"), ([], [[["x", "y"], ["1", "2"]]], ""), ([], [], "")])
    book = office_writer.workbook_file("My Sheet", [["k", "", "v"], ["a", "", 1.0], ["b", "", 2.5], ["a", "", 3]], {"C2": "1+0"})
    for name, content in {"w.docx": word, "s.pptx": slides, "b.xlsx": book, "broken.docx": word[:200], "bad.pptx": b"no zip", "t.txt": b"text", "empty.xlsx": b""}.items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def by_file(df):
    out = {}
    for r in df.orderBy("path", "block_order").collect():
        out.setdefault(r.path.rpartition("/")[2], []).append(r)
    return out


@pytest.mark.parametrize("size", [1, 1 << 26])
def test_blocks(spark, folder, size):
    office.register(spark)
    df = spark.read.format("docweave_office").option("partitionBytes", size).load(folder)
    assert df.rdd.getNumPartitions() == (7 if size == 1 else 1)
    got = by_file(df)
    assert [(r.type, r.text, r.style) for r in got["w.docx"]] == [("heading", "Head", "heading 1"), ("text", "body\twith tab", "Normal"), ("table", "a | b\n1 | <2>", None), ("image_caption", "", None)]
    assert got["w.docx"][2].rows == [["1", "<2>"]] and got["w.docx"][3].digest == __import__("hashlib").sha256(b"png").hexdigest()
    assert [(r.part, r.type, r.text) for r in got["s.pptx"]] == [(1, "text", "one\ntwo\nthree\nSpeaker Notes: say it"), (2, "table", "x | y\n1 | 2")]
    sheet, formula, pivot = got["b.xlsx"]
    assert (sheet.headers, sheet.rows, sheet.ref) == (["k", "v"], [["a", "1"], ["b", "2.5"], ["a", "3"]], "My Sheet!A1:B4")
    assert (formula.ref, formula.text) == ("My Sheet!C2", "=1+0")
    assert (pivot.headers, pivot.rows, pivot.ref, pivot.part_name) == (["k", "field_1", "v"], [["a", "", "1"], ["b", "", "2.5"], ["a", "", "3"]], "A1:C4", "My Sheet")
    for name in ("broken.docx", "bad.pptx", "t.txt", "empty.xlsx"):
        assert [r.type for r in got[name]] == ["error"] and got[name][0].text


def test_binary_frames_give_the_same(spark, folder):
    office.register(spark)
    # Spark itself passes over files without bytes
    a = spark.read.format("docweave_office").load(folder).where("path not like '%empty.xlsx'").drop("path")
    b = office.office_blocks(spark.read.format("binaryFile").load(folder)).drop("path")
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_no_files(spark, tmp_path):
    office.register(spark)
    assert spark.read.format("docweave_office").load(str(tmp_path)).where(F.col("type") != "error").count() == 0


def test_merged_cells_and_external_links():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f'<w:tbl><w:tr>{cell("wide", "<w:gridSpan w:val=\'2\'/>")}{cell("c")}</w:tr><w:tr>{cell("down", "<w:vMerge w:val=\'restart\'/>")}{cell("x")}{cell("y")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("x2")}{cell("y2")}</w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="x/image" Target="http://a/b.png" TargetMode="External"/></Relationships>')
    (block,) = office.word_blocks(out.getvalue())
    assert (block.headers, block.rows) == (["wide", "wide", "c"], [["down", "x", "y"], ["down", "x2", "y2"]])


def test_column_letters():
    assert [office.column_letters(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(office._column(office.column_letters(n)) == n for n in range(1, 2000))
