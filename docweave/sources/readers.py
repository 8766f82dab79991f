"""Sources: files by type and content, folders as streams, markup, validated SQL."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File types by extension, as the pipeline and as the classifier name them
FILE_TYPES = {
    "pdf": "pdf", "xlsx": "excel", "xls": "excel", "xlsm": "excel", "pptx": "ppt", "ppt": "ppt", "docx": "docx", "doc": "docx",
    "png": "image", "jpg": "image", "jpeg": "image", "bmp": "image", "tif": "image", "tiff": "image", "webp": "image",
}
WIDE_TYPES = {
    "pdf": "pdf", "xlsx": "excel", "xls": "excel", "csv": "spreadsheet", "pptx": "ppt", "ppt": "ppt", "docx": "docx", "doc": "docx",
    "png": "image", "jpg": "image", "jpeg": "image", "bmp": "image", "gif": "image", "tiff": "image",
    "dwg": "diagram", "dxf": "diagram", "svg": "diagram", "zip": "archive", "rar": "archive", "7z": "archive",
}


def file_type(path: Column, types: dict[str, str] | None = None) -> Column:
    known = F.create_map(*(F.lit(x) for kv in (types or FILE_TYPES).items() for x in kv))
    return F.coalesce(known[F.regexp_extract(F.lower(path), "\\.([a-z0-9]+)$", 1)], F.lit("unknown"))


def support_status(kind: Column) -> Column:
    """Never silent: what can't be read says so."""
    return F.when(kind == "unknown", F.struct(F.lit("unsupported").alias("status"), F.lit("convert the file to a supported type").alias("hint"))).otherwise(
        F.struct(F.lit("queued").alias("status"), F.lit(None).cast("string").alias("hint"))
    )


def content_id(content: Column) -> Column:
    """SHA-256 of the bytes."""
    return F.sha2(content, 256)


def document_id(digest: Column) -> Column:
    """A name-based identifier (version 5 form) from the digest's SHA-1."""
    h = F.sha1(digest.cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def display_name(path: Column) -> Column:
    """The file's name without its folder and without an identifier in front."""
    name = F.regexp_replace(path, "^.*[/\\\\]", "")
    return F.regexp_replace(name, "^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}_", "")


def unique_paths(files: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """Names that stand twice in a folder get a number before the extension."""
    n = F.row_number().over(Window.partitionBy(folder, name).orderBy(order))
    stem, ext = F.regexp_extract(name, "^(.*?)(\\.[^.]*)?$", 1), F.regexp_extract(name, "^(.*?)(\\.[^.]*)?$", 2)
    return files.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), (n - 1).cast("string"), ext)))


def text_head(blocks: DataFrame, pages: int = 3) -> DataFrame:
    return blocks.where(F.col("page") <= pages).groupBy("document_id").agg(F.expr("listagg(text, '\\n') within group (order by block_order)").alias("head"))


def toc(blocks: DataFrame, pages: int = 2) -> DataFrame:
    """Titles of headings; where there are none, the first pages."""
    titles = blocks.where("type = 'heading'").groupBy("document_id").agg(F.expr("listagg(text, '\\n') within group (order by block_order)").alias("titles"))
    return text_head(blocks, pages).join(titles, "document_id", "full_outer").select("document_id", F.coalesce("titles", "head").alias("toc"))


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, kind, document_hash, document_id, size of the files of a folder."""
    f = spark.read.format("binaryFile").load(folder)
    h = content_id(F.col("content"))
    return f.select("path", display_name(F.col("path")).alias("name"), file_type(F.col("path")).alias("kind"), h.alias("document_hash"), document_id(h).alias("document_id"), F.col("length").alias("size"))


def watch(spark: SparkSession, folder: str, done: str | None = None) -> DataFrame:
    """A stream of the files that come into a folder; read ones move to ``done``."""
    reader = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", 100)
    if done:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", done)
    f = reader.load(folder)
    return f.select("path", "modificationTime", content_id(F.col("content")).alias("document_hash"), F.col("length").alias("size"))


def load_config(text: str, env: dict[str, str] | None = None) -> dict:
    """JSON configuration with ``${NAME}`` filled from the environment; names
    that aren't set stay as they stand."""
    import json

    known = os.environ if env is None else env
    return json.loads(re.sub(r"\$\{(\w+)\}", lambda m: known.get(m[1], m[0]), text))


def table_blocks(sheets: DataFrame, doc: str, sheet: str, rows: str) -> DataFrame:
    """Sheets as table blocks: empty rows and columns go, the first row heads,
    blank names count up, ``cell_range`` says where it stood."""
    kept = F.filter(rows, lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    base = sheets.select(doc, sheet, kept.alias("g")).where(F.size("g") > 0)
    wide = F.array_max(F.transform("g", lambda r: F.size(r)))
    used = F.filter(F.sequence(F.lit(0), wide - 1), lambda i: F.exists("g", lambda r: F.trim(F.coalesce(F.get(r, i), F.lit(""))) != ""))
    grid = base.select(doc, sheet, F.transform("g", lambda r: F.transform(used, lambda i: F.coalesce(F.get(r, i), F.lit("")))).alias("g"))
    head = F.transform(F.get("g", 0), lambda c, i: F.when(F.trim(c) == "", F.concat(F.lit("column_"), i.cast("string"))).otherwise(c))
    last = F.char((64 + F.size(F.get("g", 0))).cast("int"))
    where = F.concat(F.col(sheet), F.lit("!A1:"), last, F.size("g").cast("string"))
    return grid.select(doc, sheet, head.alias("headers"), F.slice("g", 2, F.size("g")).alias("rows"), where.alias("cell_range"))


def clean_value(cell: Column) -> Column:
    """A cell as text: none is empty, whole numbers lose their point, others are rounded to six places."""
    number = F.try_to_number(cell, F.lit("S999999999999D999999999")).cast("double")
    return F.when(cell.isNull() | cell.isin("NaN", "None"), "").when(number.isNotNull() & (number == F.floor(number)), F.floor(number).cast("string")).when(number.isNotNull(), F.round(number, 6).cast("string")).otherwise(cell)


PAGE_SCHEMA = "document_id string, page int, block_order int, type string, text string"


def extract_pages(files: DataFrame, extractor) -> DataFrame:  # noqa: ANN001
    """Blocks of binary files by an injected ``extractor(path, content)`` that
    yields (page, order, type, text). What it raises becomes an error block, so
    one broken file never ends a job. The default salvages printable text."""
    import pandas as pd

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                try:
                    rows += [(r.document_id, *b) for b in extractor(r.path, r.content)]
                except Exception as e:  # noqa: BLE001
                    rows.append((r.document_id, 0, 0, "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["document_id", "page", "block_order", "type", "text"])

    return files.select("document_id", "path", "content").mapInPandas(run, PAGE_SCHEMA)


def salvage_text(path: str, content: bytes, limit: int = 5000):  # noqa: ANN201
    """Text of a zipped XML document (slides, paragraphs) or of any bytes."""
    import io
    import zipfile

    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            parts = sorted((n for n in z.namelist() if re.search(r"(slides/slide\d+|word/document|worksheets/sheet\d+)\.xml$", n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
            for i, name in enumerate(parts, 1):
                text = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", z.read(name).decode("utf-8", "replace"))).strip()
                if text:
                    yield i, i - 1, "text", text[:limit]
    else:
        text = re.sub(r"[^\x20-\x7e]+", " ", content.decode("utf-8", "replace")).strip()
        if text:
            yield 1, 0, "text", text[:limit]
