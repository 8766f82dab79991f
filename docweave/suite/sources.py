"""Sources over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, table
from ..sources import readers as S
from ..sources.fixtures import BLOCKS, TABLES, blocks, cell_tables

_PATH = "'/in/doc' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.csv' WHEN 3 THEN '.docx' WHEN 4 THEN '.jpeg' ELSE '.exe' END"


def _paths(spark, d):
    ext = F.get(F.array(*map(F.lit, (".PDF", ".xlsx", ".csv", ".docx", ".jpeg", ".exe"))), (F.col("doc_id") % 6).cast("int"))
    return table(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("/in/doc"), F.col("doc_id").cast("string"), ext).alias("path"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'excel' WHEN 3 THEN 'docx' WHEN 4 THEN 'image' ELSE 'unknown' END AS kind FROM documents")
def src_file_type(spark, d):
    return _paths(spark, d).select("doc_id", S.file_type(F.col("path")).alias("kind"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'excel' WHEN 2 THEN 'spreadsheet' WHEN 3 THEN 'docx' WHEN 4 THEN 'image' ELSE 'unknown' END AS kind FROM documents")
def src_file_type_wide(spark, d):
    return _paths(spark, d).select("doc_id", S.file_type(F.col("path"), S.WIDE_TYPES).alias("kind"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 IN (2, 5) THEN 'unsupported' ELSE 'queued' END AS status FROM documents")
def src_unsupported(spark, d):
    return _paths(spark, d).select("doc_id", S.support_status(S.file_type(F.col("path")))["status"].alias("status"))


@query("SELECT doc_id, h AS document_hash, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || substr('89ab', CAST(('0x' || s[17:17])::INT % 4 + 1 AS INT), 1) || s[18:20] || '-' || s[21:32] AS document_id FROM (SELECT doc_id, h, sha1(h) AS s FROM (SELECT doc_id, sha256(text) AS h FROM documents))")
def src_content_id(spark, d):
    h = S.content_id(F.col("text").cast("binary"))
    return table(spark, d, "documents").select("doc_id", h.alias("document_hash"), S.document_id(h).alias("document_id"))


@query("SELECT doc_id, 'my file.pdf' AS name FROM documents")
def src_display_name(spark, d):
    p = F.concat(F.lit("/up/0f8fad5b-d9cb-469f-a165-70867728950e_my file.pdf"))
    return table(spark, d, "documents").select("doc_id", S.display_name(p).alias("name"))


@query("SELECT doc_id, CASE WHEN r = 1 THEN source || '.txt' ELSE source || '_' || (r - 1) || '.txt' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents)")
def src_unique_path(spark, d):
    f = table(spark, d, "documents").select("doc_id", "lang", F.concat("source", F.lit(".txt")).alias("name"))
    return S.unique_paths(f, "lang", "name", "doc_id").select("doc_id", "unique_name")


@query(f"WITH {BLOCKS} SELECT document_id, string_agg(text, chr(10) ORDER BY block_order) AS head FROM blocks WHERE page <= 3 GROUP BY document_id")
def src_text_head(spark, d):
    return S.text_head(blocks(spark, d))


@query(f"WITH {BLOCKS}, t AS (SELECT document_id, string_agg(text, chr(10) ORDER BY block_order) AS t FROM blocks WHERE type = 'heading' GROUP BY document_id), h AS (SELECT document_id, string_agg(text, chr(10) ORDER BY block_order) AS h FROM blocks WHERE page <= 2 GROUP BY document_id) SELECT document_id, coalesce(t, h) AS toc FROM h FULL JOIN t USING (document_id)")
def src_toc(spark, d):
    return S.toc(blocks(spark, d))


@query(f"WITH {TABLES} SELECT table_id, CAST(least(len(rows), 3) AS BIGINT) AS n_rows, ['column_0', 'column_1', 'column_2', 'column_3'] AS headers FROM tables")
def src_excel_fallback(spark, d):
    heads = F.transform(F.sequence(F.lit(0), F.size(F.get("rows", 0)) - 1), lambda i: F.concat(F.lit("column_"), i.cast("string")))
    return cell_tables(spark, d).select("table_id", F.size(F.slice("rows", 1, 3)).cast("long").alias("n_rows"), heads.alias("headers"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 200")
def src_sql(spark, d):
    from ..plans.sql import run_readonly

    table(spark, d, "orders").createOrReplaceTempView("dw_orders")
    return run_readonly(spark, "SELECT o_orderkey, o_orderstatus FROM dw_orders WHERE o_totalprice > 100000 ORDER BY o_orderkey", limit=200)


@query("SELECT event_id, CASE WHEN value IS NULL THEN '' WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE 'fraction' END AS cell FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN floor(value) ELSE floor(value) + 0.5 END AS value FROM events)", name="fn_excel_cell")
def fn_excel_cell(spark, d):
    v = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 2 == 0, F.floor("value").cast("double")).otherwise(F.floor("value") + 0.5)
    cell = S.clean_value(v.cast("decimal(20,3)").cast("string"))
    return table(spark, d, "events").select("event_id", F.when(F.contains(cell, F.lit(".")), "fraction").otherwise(cell).alias("cell"))
