"""Chunking over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..registry import query, table
from ..sources.fixtures import BLOCKS, BOXES, TABLES, blocks, boxes, cell_tables

_WIN = """w AS (SELECT doc_id AS document_id, trim(text) AS t, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT document_id, t, w, unnest(CASE WHEN len(w) = 0 THEN []::BIGINT[] WHEN len(w) <= 100 THEN [0::BIGINT] ELSE list_filter(range(0, len(w), 80), lambda i: i = 0 OR i - 80 + 100 < len(w)) END) AS i FROM w),
c AS (SELECT document_id, i // 80 AS ordinal, CASE WHEN len(w) <= 100 THEN t ELSE array_to_string(w[i + 1:i + 100], ' ') END AS text FROM s)"""


@query(f"WITH {_WIN} SELECT document_id, ordinal, md5(text) AS text_md5, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS token_count, sha256(document_id || '|' || ordinal) AS chunk_id FROM c")
def ck_window(spark, d):
    c = C.window_chunks(table(spark, d, "documents"), "doc_id", "text", 100, 20)
    return c.select("document_id", "ordinal", F.md5(F.col("text").cast("binary")).alias("text_md5"), "token_count", "chunk_id")


@query()
def ck_fold(spark, d):
    return C.section_chunks(blocks(spark, d), 100, 20)


@query(
    f"""WITH RECURSIVE {TABLES}, r AS (SELECT table_id, unnest(rows) AS row, unnest(range(1, len(rows) + 1)) AS r FROM tables), n AS (SELECT *, len(row) + 1 + list_sum(list_transform(row, lambda c: len(string_split(c, ' '))))::BIGINT AS n FROM r),
    f(table_id, r, part, used) AS (SELECT table_id, 0::BIGINT, 1::BIGINT, 18::BIGINT FROM tables
      UNION ALL SELECT f.table_id, n.r, CASE WHEN used + n <= 60 OR used = 18 THEN part ELSE part + 1 END, CASE WHEN used + n <= 60 OR used = 18 THEN used + n ELSE 18 + n END FROM f JOIN n ON n.table_id = f.table_id AND n.r = f.r + 1)
    SELECT table_id, part, count(*) AS n_rows, min(r) || '-' || max(r) AS row_range, '| part | qty | flag | date |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| ' || array_to_string(row, ' | ') || ' |', chr(10) ORDER BY r) AS text FROM f JOIN n USING (table_id, r) GROUP BY table_id, part"""
)
def ck_table_groups(spark, d):
    return C.row_groups(cell_tables(spark, d), ["part", "qty", "flag", "date"], 60)


@query(f"WITH {TABLES}, r AS (SELECT table_id, unnest(rows) AS row, unnest(range(0, len(rows))) AS r FROM tables) SELECT table_id, r AS row, '[Troubleshooting: ' || row[1] || '] qty: ' || row[2] || ' | flag: ' || row[3] || ' | date: ' || row[4] AS text FROM r")
def ck_trouble(spark, d):
    return C.labelled_rows(cell_tables(spark, d), ["part", "qty", "flag", "date"], "Troubleshooting")


@query(
    f"""WITH {TABLES}, r AS (SELECT table_id, unnest(rows) AS row, unnest(range(0, len(rows))) AS r FROM tables), e AS (SELECT table_id, r, row, CASE WHEN r > 0 AND r % 3 = 2 THEN '' ELSE row[1] END AS id FROM r),
    h AS (SELECT *, max(CASE WHEN id <> '' THEN r END) OVER (PARTITION BY table_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS head FROM e)
    SELECT table_id, head AS row, '[Alarm: ' || min_by(id, r) || '] ' || string_agg('qty: ' || row[2] || ' | flag: ' || row[3], ' | ' ORDER BY r) AS text FROM h GROUP BY table_id, head"""
)
def ck_alarm(spark, d):
    rows = F.transform("rows", lambda r, i: F.array(F.when((i > 0) & (i % 3 == 2), "").otherwise(F.get(r, 0)), F.get(r, 1), F.get(r, 2)))
    return C.labelled_rows(cell_tables(spark, d).select("table_id", rows.alias("rows")), ["code", "qty", "flag"], "Alarm")


@query("SELECT o_orderkey, 'Warning' AS severity, 'Warning Type: Warning' || chr(10) || 'Text: warning ' || o_orderpriority AS chunk FROM orders WHERE o_orderstatus = 'F'")
def ck_warning(spark, d):
    said = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("warning "), "o_orderpriority")).otherwise(F.lit("all fine"))
    return C.warning_chunks(table(spark, d, "orders").select("o_orderkey", said.alias("text"))).select("o_orderkey", "severity", "chunk")


@query(f"WITH {TABLES}, r AS (SELECT table_id, unnest(rows) AS row, unnest(range(0, len(rows))) AS r FROM tables), m AS (SELECT table_id, r, row[1] AS name, unnest(['qty', 'flag']) AS model, unnest([row[2], row[3]]) AS value FROM r) SELECT table_id, model, string_agg(name || ': ' || value, ' | ' ORDER BY r) AS text FROM m GROUP BY table_id, model")
def ck_model_matrix(spark, d):
    return C.model_columns(cell_tables(spark, d).select("table_id", F.transform("rows", lambda r: F.slice(r, 1, 3)).alias("rows")), ["part", "qty", "flag"], 1)


@query("SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 0.7 WHEN 1 THEN 0.9 WHEN 2 THEN 1.0 ELSE 0.7 END AS DOUBLE) AS confidence, doc_id % 4 = 2 AS exclude FROM documents")
def ck_caption_conf(spark, d):
    n = F.col("doc_id") % 4
    kind = F.when(n == 0, "unknown").when(n == 1, "text").when(n == 2, "logo").otherwise("photo")
    return table(spark, d, "documents").select("doc_id", C.caption_confidence(kind, n == 3).alias("x")).select("doc_id", "x.confidence", "x.exclude")


_T = f"""WITH {BLOCKS}, {BOXES}, t AS (SELECT b.document_id, b.block_order, b.page, b.text, len(string_split(b.text, ' | ')) AS n_columns, y0, y1 FROM blocks b JOIN boxes USING (document_id, block_order) WHERE type = 'table'),
 p AS (SELECT *, coalesce(page = lag(page) OVER w + 1 AND n_columns = lag(n_columns) OVER w AND lag(y1) OVER w >= 0.7 * 650 AND y0 <= 0.3 * 650, false) AS continues FROM t WINDOW w AS (PARTITION BY document_id ORDER BY block_order))"""


def _tables(spark, d):
    b = blocks(spark, d).where("type = 'table'").join(boxes(spark, d).select("document_id", "block_order", "y0", "y1"), ["document_id", "block_order"])
    return b.withColumns({"n_columns": F.size(F.split("text", " \\| ")), "height": F.lit(650)})


@query(f"{_T} SELECT document_id, block_order, continues FROM p")
def pl_stitch_pred(spark, d):
    return C.stitchable(_tables(spark, d)).select("document_id", "block_order", "continues")


@query(f"{_T}, g AS (SELECT *, sum(CASE WHEN continues THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY block_order ROWS UNBOUNDED PRECEDING) AS g FROM p) SELECT document_id, min(block_order) AS block_order, count(*) AS parts, string_agg(text, chr(10) ORDER BY block_order) AS text FROM g GROUP BY document_id, g")
def pl_stitch(spark, d):
    return C.stitch(_tables(spark, d))


@query(f"WITH {TABLES} SELECT table_id, CASE WHEN table_id % 3 = 0 THEN 'merge' WHEN table_id % 3 = 1 THEN 'separate' ELSE 'ambiguous' END AS decision FROM tables")
def pl_stitch_fp(spark, d):
    n = F.col("table_id") % 3
    arr = lambda *x: F.array(*map(F.lit, x))
    a = F.when(n == 2, arr("text", "text")).otherwise(arr("num", "text"))
    b = F.when(n == 0, arr("num", "text")).when(n == 1, arr("text", "text")).otherwise(arr("text", "code"))
    return cell_tables(spark, d).select("table_id", C.fingerprint(a, b).alias("decision"))


@query(f"WITH {_WIN} SELECT document_id, ordinal, 'rev-1' AS revision_id, sha256(CAST(document_id AS VARCHAR)) AS document_hash, 'words@' || sha256('words:64')[1:8] AS index_version FROM c")
def ck_stamp(spark, d):
    c = C.window_chunks(table(spark, d, "documents"), "doc_id", "text", 100, 20)
    version = F.concat(F.lit("words@"), F.substring(F.sha2(F.lit("words:64").cast("binary"), 256), 1, 8))
    return c.select("document_id", "ordinal", F.lit("rev-1").alias("revision_id"), F.sha2(F.col("document_id").cast("string").cast("binary"), 256).alias("document_hash"), version.alias("index_version"))


@query(f"WITH {TABLES} SELECT table_id, len(list_distinct(list_transform(rows, lambda r: r[3]))) < len(rows) AS header_anomaly, len(rows) <= 2 AS orphan_table FROM tables")
def ck_table_classify(spark, d):
    from ..functions import geometry as G

    flags = F.transform("rows", lambda r: F.get(r, 2))
    return cell_tables(spark, d).select("table_id", G.header_anomaly(flags).alias("header_anomaly"), G.orphan_table(F.col("rows")).alias("orphan_table"))


