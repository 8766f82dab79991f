"""Office files: written from the shared tables, read back through the data source."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..registry import query, table
from ..sources import office, office_writer
from ..sources.fixtures import BLOCKS
from ..sources.shared import shared_folder, write_file

_TRIM = "' ' || chr(9) || chr(13) || chr(10)"
_CLEAN = f"trim(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), {_TRIM})"
_ROW = f"array_to_string(list_transform(string_split(text, ' | '), lambda c: trim(regexp_replace(c, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), {_TRIM})), ' | ')"


def _lines(text: str | None) -> list[str]:
    return text.split("\n") if text is not None else []


def _files(df, folder, ending, make):
    """A file for each (id, text), written by the tasks; their number."""

    def write(batches):
        for b in batches:
            for i, text in zip(*(c.to_pylist() for c in b.columns)):
                write_file(folder, f"{i}.{ending}", make(i, text))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return df.mapInArrow(write, "n long").agg(F.sum("n")).first()[0]


def _read(spark, folder):
    office.register(spark)
    return spark.read.format(office.OfficeFiles.name()).load(folder).withColumn("document_id", F.regexp_extract("path", "([0-9]+)\\.[a-z]+$", 1).cast("long"))


def _as_word(i, text):
    body = [x for x in _lines(text) if " | " not in x]
    rows = [x.split(" | ") for x in _lines(text) if " | " in x]
    made = office_writer.word_file([("Heading1" if len(x) < 40 else "Normal", x) for x in body], [rows] if rows else [])
    return made[: len(made) // 2] if i % 97 == 5 else made  # a broken file among sound ones


@query(
    f"""WITH {BLOCKS}, b AS (SELECT * FROM blocks WHERE document_id % 97 <> 5),
    p AS (SELECT document_id, 0 AS g, block_order AS o, type, {_CLEAN} AS text FROM b WHERE type <> 'table' UNION ALL
      SELECT document_id, 1, 0, 'table', string_agg({_ROW}, chr(10) ORDER BY block_order) FROM b WHERE type = 'table' GROUP BY document_id)
    SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY g, o) - 1 AS INTEGER) AS block_order, type, text FROM p WHERE g = 1 OR text <> ''
    UNION ALL SELECT doc_id, 0, 'error', '' FROM documents WHERE doc_id % 97 = 5"""
)
def src_word(spark, d):
    folder = shared_folder(spark, "word")
    _files(table(spark, d, "documents").select("doc_id", "text"), folder, "docx", _as_word)
    return _read(spark, folder).select("document_id", "block_order", "type", F.when(F.col("type") == "error", "").otherwise(F.col("text")).alias("text"))


def _as_slides(i, text):
    lines = _lines(text)
    slides = []
    for k in range(0, len(lines), 4):
        four = lines[k : k + 4]
        rows = [x.split(" | ") for x in four if " | " in x]
        slides.append(([x for x in four if " | " not in x], [rows] if rows else [], f"page {k // 4 + 1} of {i}"))
    return office_writer.slide_file(slides)


@query(
    f"""WITH {BLOCKS}, n AS (SELECT document_id, page, block_order, {_CLEAN} AS text FROM blocks WHERE type <> 'table' UNION ALL
      SELECT document_id, page, 1 + max(block_order), 'Speaker Notes: page ' || page || ' of ' || document_id FROM blocks GROUP BY ALL)
    SELECT document_id, CAST(page AS INTEGER) AS slide, 'text' AS type, string_agg(text, chr(10) ORDER BY block_order) AS text FROM n WHERE text <> '' GROUP BY document_id, page
    UNION ALL SELECT document_id, CAST(page AS INTEGER), 'table', string_agg({_ROW}, chr(10) ORDER BY block_order) FROM blocks WHERE type = 'table' GROUP BY document_id, page"""
)
def src_ppt(spark, d):
    folder = shared_folder(spark, "slides")
    _files(table(spark, d, "documents").select("doc_id", "text"), folder, "pptx", _as_slides)
    return _read(spark, folder).select("document_id", F.col("part").alias("slide"), "type", "text")


def _workbooks(spark, d):
    """A workbook for each supplier: its lines as a sheet with a formula in each,
    and a pivot table over them."""
    folder = shared_folder(spark, "workbooks")

    def write(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")])
        lines = [[f, s, p, int(q), p * int(q)] for f, s, p, q in zip(*(group.column(c).to_pylist() for c in ("l_returnflag", "l_linestatus", "l_partkey", "l_quantity")))]
        formulas = {f"E{k}": f"C{k}*D{k}" for k in range(2, len(lines) + 2)}
        supplier = group.column("l_suppkey")[0].as_py()
        write_file(folder, f"{supplier}.xlsx", office_writer.workbook_file("Lines", [["flag", "status", "part", "quantity", "product"], *lines], formulas))
        return pa.table({"n": pa.array([1], pa.int64())})

    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey", "l_quantity")
    lines.groupBy("l_suppkey").applyInArrow(write, "n long").agg(F.sum("n")).first()
    return _read(spark, folder).withColumnRenamed("document_id", "l_suppkey")


_LINES = "l AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, l_linestatus) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)"


@query(f"WITH {_LINES} SELECT l_suppkey, CAST(r AS INTEGER) AS r, 'Lines!A1:E' || (n + 1) AS cell_range, l_returnflag AS flag, l_linestatus AS status, CAST(l_partkey AS VARCHAR) AS part, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, CAST(l_partkey * CAST(l_quantity AS BIGINT) AS VARCHAR) AS product FROM l")
def src_excel(spark, d):
    rows = _workbooks(spark, d).where("type = 'table'").select("l_suppkey", F.col("ref").alias("cell_range"), "headers", F.posexplode("rows").alias("r", "row"))
    names = ("flag", "status", "part", "quantity", "product")
    at = lambda c: F.get("row", F.array_position("headers", F.lit(c)).cast("int") - 1).alias(c)
    return rows.select("l_suppkey", (F.col("r") + 1).alias("r"), "cell_range", *map(at, names))


@query(f"WITH {_LINES} SELECT l_suppkey, 'Lines!E' || (r + 1) AS cell_ref, '=C' || (r + 1) || '*D' || (r + 1) AS formula FROM l")
def src_excel_formula(spark, d):
    return _workbooks(spark, d).where("type = 'formula'").select("l_suppkey", F.col("ref").alias("cell_ref"), F.col("text").alias("formula"))


@query(f"WITH {_LINES} SELECT l_suppkey, 'Pivot1' AS pivot, 'A1:E' || (n + 1) AS source_range, l_returnflag AS flag, l_linestatus AS status, count(*) AS records, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM l GROUP BY ALL")
def src_excel_pivot(spark, d):
    cache = _workbooks(spark, d).where("type = 'pivot'").select("l_suppkey", F.col("style").alias("pivot"), F.col("ref").alias("source_range"), F.explode("rows").alias("row"))
    return cache.groupBy("l_suppkey", "pivot", "source_range", F.get("row", 0).alias("flag"), F.get("row", 1).alias("status")).agg(F.count("*").alias("records"), F.sum(F.get("row", 3).cast("long")).alias("quantity"))


@query("SELECT page_id, CAST(sha256(html) AS VARCHAR) AS digest, kind FROM pages, (VALUES ('docx'), ('xlsx')) t(kind)", name="src_excel_images")
def src_excel_images(spark, d):
    """Pictures in documents and workbooks: each page's bytes stand for one."""
    folder = shared_folder(spark, "pictures")
    pages = table(spark, d, "pages").select("page_id", "html")
    _files(pages, folder, "docx", lambda i, html: office_writer.word_file([("Normal", str(i))], [], [html.encode()]))
    _files(pages, folder, "xlsx", lambda i, html: office_writer.workbook_file("S", [["page"], [i]], images=[html.encode()]))
    found = _read(spark, folder).where("type = 'image_caption'")
    return found.select(F.col("document_id").alias("page_id"), "digest", F.regexp_extract("path", "([a-z]+)$", 1).alias("kind"))
