"""Scalar functions of text, tables and boxes over the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..registry import query, table
from ..sources.fixtures import BLOCKS, BOXES, SAID, TABLES, blocks, boxes, cell_tables, said


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents")
def fn_ntok(spark, d):
    return table(spark, d, "documents").select("doc_id", X.n_tokens(F.col("text")).alias("n_tokens"))


@query("SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS est_tokens FROM documents")
def fn_est_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", X.estimated_tokens(F.col("text")).alias("est_tokens"))


@query("SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1] AS first_unit, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:5], ' ') AS head FROM documents")
def fn_units(spark, d):
    w = X.words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.get(w, 0).alias("first_unit"), F.array_join(F.slice(w, 1, 5), " ").alias("head"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS clean_md5 FROM documents")
def fn_clean_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean_spaces(F.col("text")).cast("binary")).alias("clean_md5"))


@query("SELECT doc_id, 'Item ....... end' AS cell, length(text) AS n FROM documents WHERE doc_id % 10 = 0")
def fn_collapse_repeat(spark, d):
    cell = F.concat(F.lit("Item "), F.repeat(F.lit("."), 40), F.lit(" end"))
    docs = table(spark, d, "documents").where("doc_id % 10 = 0")
    return docs.select("doc_id", F.regexp_replace(X.collapse_repeats(cell), "\\.{3}", ".......").alias("cell"), F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def fn_fullwidth(spark, d):
    # letters and digits written wide come back as they were
    wide = F.translate("text", X.ASCII_WIDTH, X.FULL_WIDTH)
    return table(spark, d, "documents").select("doc_id", F.md5(X.half_width(wide).cast("binary")).alias("text_md5"))


@query(
    """SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', '; ', 'g'), '<[^>]+>', '', 'g') = '' AS is_empty,
       md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', '; ', 'g'), '<[^>]+>', '', 'g'), '\\s*;\\s*', '; ', 'g'), '^[; ]+|[; ]+$', '', 'g'))) AS cell_md5 FROM pages"""
)
def fn_clean_cell(spark, d):
    cell = X.clean_cell(F.col("html"))
    return table(spark, d, "pages").select("page_id", (F.regexp_replace(F.regexp_replace("html", "(?i)<br\\s*/?>", "; "), "<[^>]+>", "") == "").alias("is_empty"), F.md5(cell.cast("binary")).alias("cell_md5"))


@query("SELECT doc_id, md5(trim(text)) AS inner_md5 FROM documents")
def fn_strip_fences(spark, d):
    wrapped = F.concat(F.lit("```markdown\n"), F.col("text"), F.lit("\n```"))
    return table(spark, d, "documents").select("doc_id", F.md5(X.strip_fences(wrapped).cast("binary")).alias("inner_md5"))


@query("SELECT page_id, substring(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 5000) AS text, CAST(0.2 AS DOUBLE) AS confidence FROM pages")
def src_ppt_xml(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"), F.lit(0.2).cast("double").alias("confidence"))


@query(
    """WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[\\x{80}-\\x{10FFFF}]', '_', 'g'), '\\b[A-Za-z0-9][A-Za-z0-9\\-*/.]*\\b') AS c FROM documents),
    u AS (SELECT doc_id, list_transform(list_filter(c, lambda x: length(x) >= 3 AND regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]')), lambda x: regexp_replace(upper(x), '^[.\\-]+|[.\\-]+$', '', 'g')) AS c FROM t)
    SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(c, lambda x: length(x) >= 3 AND NOT regexp_matches(replace(x, '.', ''), '^[0-9]+$')))), ','), '') AS codes FROM u"""
)
def fn_component_codes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.component_codes(F.col("text")), ",").alias("codes"))


@query(
    """SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(upper(text),
       '\\b[A-Z]{1,3}[0-9]{2,4}\\b|\\b[A-Z]{2,}-[A-Z0-9]+(?:-[A-Z0-9]+)*\\b|\\b[A-Z]{2,}[0-9]+[A-Z0-9]*\\b'))), ','), '') AS codes FROM documents"""
)
def fn_component_codes_cad(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.drawing_codes(F.col("text")), ",").alias("codes"))


@query(
    f"""WITH {BLOCKS}, {BOXES}, t AS (SELECT b.document_id, b.block_order, CASE WHEN b.block_order % 3 = 0 THEN b.page || '.' || b.block_order || ' ' || b.text ELSE b.text END AS title, y1 - y0 AS h, x0 FROM blocks b JOIN boxes USING (document_id, block_order) WHERE type = 'heading')
    SELECT document_id, block_order, CAST(CASE WHEN regexp_extract(trim(title), '^(\\d+(?:\\.\\d+)*)\\b', 1) <> '' THEN length(regexp_extract(trim(title), '^(\\d+(?:\\.\\d+)*)\\b', 1)) - length(replace(regexp_extract(trim(title), '^(\\d+(?:\\.\\d+)*)\\b', 1), '.', '')) + 1
      WHEN h >= 12 THEN 1 WHEN x0 >= 75 THEN 3 ELSE 2 END AS BIGINT) AS level FROM t"""
)
def fn_heading_level(spark, d):
    b = blocks(spark, d).where("type = 'heading'").join(boxes(spark, d).drop("page"), ["document_id", "block_order"])
    title = F.when(F.col("block_order") % 3 == 0, F.concat_ws("", F.col("page").cast("string"), F.lit("."), F.col("block_order").cast("string"), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    box = F.array(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")))
    return b.select("document_id", "block_order", X.heading_level(title, box).alias("level"))


@query(
    f"""WITH {BLOCKS}, t AS (SELECT document_id, block_order, CASE block_order % 5 WHEN 0 THEN '[ note ]' WHEN 1 THEN '**WARNING** ' || left(text, CAST(document_id % 3 AS BIGINT)) WHEN 2 THEN 'One Point ' || text ELSE text END AS t FROM blocks)
    SELECT document_id, block_order, regexp_matches(t, '(?i)^[\\s<\\[(*]*(IMPORTANT|NOTE|ONE POINT|WARNING|CAUTION|DANGER)[\\s>\\])*]*$') AS callout FROM t"""
)
def fn_callout_heading(spark, d):
    n, t = F.col("block_order") % 5, F.col("text")
    said = F.when(n == 0, "[ note ]").when(n == 1, F.concat(F.lit("**WARNING** "), F.left(t, (F.col("document_id") % 3).cast("int")))).when(n == 2, F.concat(F.lit("One Point "), t)).otherwise(t)
    return blocks(spark, d).select("document_id", "block_order", X.is_callout(said).alias("callout"))


@query(f"WITH {BLOCKS}, t AS (SELECT document_id, block_order, CASE WHEN block_order % 3 = 0 THEN ' - ' || text ELSE text END AS t FROM blocks) SELECT document_id, block_order, md5(CASE WHEN starts_with(trim(t), '-') THEN trim(t) ELSE '- ' || trim(t) END) AS item_md5 FROM t")
def fn_list_marker(spark, d):
    t = F.when(F.col("block_order") % 3 == 0, F.concat(F.lit(" - "), "text")).otherwise(F.col("text"))
    return blocks(spark, d).select("document_id", "block_order", F.md5(X.list_item(t, F.lit("-")).cast("binary")).alias("item_md5"))


@query(
    f"""WITH {TABLES} SELECT table_id, '| part | qty | flag | date |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
    array_to_string(list_transform(rows, lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10)) AS md FROM tables"""
)
def fn_md_table(spark, d):
    head = F.array(*map(F.lit, ("part", "qty", "flag", "date")))
    return cell_tables(spark, d).select("table_id", X.markdown_table(head, F.col("rows")).alias("md"))


@query(f"WITH {TABLES} SELECT table_id, CAST(len(rows) AS BIGINT) AS n_rows, rows[1][1] AS first_cell, rows[len(rows)][4] AS last_cell FROM tables")
def fn_md_parse(spark, d):
    head = F.array(*map(F.lit, ("part", "qty", "flag", "date")))
    grid = cell_tables(spark, d).select("table_id", X.parse_markdown(X.markdown_table(head, F.col("rows"))).alias("g"))
    return grid.select("table_id", (F.size("g") - 1).cast("long").alias("n_rows"), F.get(F.get("g", 1), 0).alias("first_cell"), F.get(F.element_at("g", -1), 3).alias("last_cell"))


_CELL_TYPE = """CASE WHEN s = '' THEN 'empty' WHEN regexp_matches(s, '\\d{1,4}[/-]\\d{1,4}') THEN 'date' WHEN regexp_matches(s, '^[\\d.,$%/+\\-\\s]+$') THEN 'num' WHEN length(s) <= 4 AND regexp_matches(s, '\\d') THEN 'code' ELSE 'text' END"""


@query(f"SELECT l_orderkey, l_linenumber, {_CELL_TYPE} AS kind FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 2 THEN CAST(l_partkey AS VARCHAR) WHEN 3 THEN l_returnflag || '7' WHEN 4 THEN '' ELSE l_linestatus END AS s FROM lineitem)")
def fn_cell_type(spark, d):
    n = F.col("l_linenumber")
    s = F.when(n == 1, F.date_format("l_shipdate", "yyyy-MM-dd")).when(n == 2, F.col("l_partkey").cast("string")).when(n == 3, F.concat("l_returnflag", F.lit("7"))).when(n == 4, F.lit("")).otherwise(F.col("l_linestatus"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.cell_type(s).alias("kind"))


_GARBLED = """(len(regexp_extract_all(t, '\\S+')) >= 4 AND (len(regexp_extract_all(t, '[À-ÿƐ-ʒ¿¶]')) / greatest(len(regexp_extract_all(t, '[A-Za-z]')), 1) > 0.05
 OR (len(regexp_extract_all(t, '[A-Za-z]{4,}')) >= 6 AND len(list_filter(regexp_extract_all(t, '[A-Za-z]{4,}'), lambda w: NOT regexp_matches(w, '[aeiouAEIOU]'))) >= 0.25 * len(regexp_extract_all(t, '[A-Za-z]{4,}')))))"""
_GARBLED_LINE = """(len(regexp_extract_all(t, '[À-ÿƐ-ʒ¿¶]')) / greatest(len(regexp_extract_all(t, '[A-Za-z]')), 1) > 0.08
 OR (len(regexp_extract_all(t, '[A-Za-z]{4,}')) >= 2 AND (len(list_filter(regexp_extract_all(t, '[A-Za-z]{4,}'), lambda w: NOT regexp_matches(w, '[aeiouAEIOU]'))) >= 0.5 * len(regexp_extract_all(t, '[A-Za-z]{4,}'))
 OR len(list_filter(regexp_extract_all(t, '[A-Za-z]{4,}'), lambda w: length(w) >= 5 AND regexp_matches(w, '(?i)[^aeiouy]{4,}'))) >= 0.4 * len(regexp_extract_all(t, '[A-Za-z]{4,}')))))"""


@query(f"SELECT doc_id, {_GARBLED} AS garbled FROM (SELECT doc_id, text AS t FROM documents)")
def fn_garbled(spark, d):
    return table(spark, d, "documents").select("doc_id", X.is_garbled(F.col("text")).alias("garbled"))


@query(f"WITH {BLOCKS} SELECT document_id, block_order, {_GARBLED_LINE} AS garbled FROM (SELECT document_id, block_order, text AS t FROM blocks)")
def fn_line_garbled(spark, d):
    return blocks(spark, d).select("document_id", "block_order", X.is_garbled_line(F.col("text")).alias("garbled"))


@query(
    f"""WITH {BLOCKS}, g AS (SELECT document_id, count(*) AS n, count(*) FILTER (WHERE {_GARBLED_LINE}) AS bad FROM (SELECT document_id, text AS t FROM blocks) WHERE length(trim(t)) >= 8 GROUP BY document_id)
    SELECT doc_id, {_GARBLED} OR coalesce(n >= 3 AND bad >= 0.12 * n, false) AS unreliable FROM (SELECT doc_id, text AS t FROM documents) LEFT JOIN g ON doc_id = document_id"""
)
def fn_unreliable(spark, d):
    return table(spark, d, "documents").select("doc_id", X.is_unreliable(F.col("text")).alias("unreliable"))


@query(
    f"""WITH {BLOCKS}, n AS (SELECT document_id, page, regexp_replace(trim(lower(text)), '\\s+', ' ', 'g') AS t FROM blocks WHERE type IN ('text', 'heading') AND length(trim(text)) >= 20)
    SELECT document_id, page, count(*) >= 3 AND count(*) - count(DISTINCT t) >= 2 AS duplicated FROM n GROUP BY document_id, page"""
)
def fn_dup_text(spark, d):
    long = blocks(spark, d).where("type in ('text', 'heading') and length(trim(text)) >= 20")
    plain = F.regexp_replace(F.trim(F.lower("text")), "\\s+", " ")
    seen = long.select("document_id", "page", plain.alias("t")).groupBy("document_id", "page").agg(F.count("*").alias("n"), F.count_distinct("t").alias("k"))
    return seen.select("document_id", "page", ((F.col("n") >= 3) & (F.col("n") - F.col("k") >= 2)).alias("duplicated"))


@query("SELECT doc_id, CAST(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\ufffd]')) / length(text) ELSE 0 END AS DOUBLE) AS share FROM documents")
def fn_ctrl_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", X.control_share(F.col("text")).alias("share"))


@query(f"WITH {TABLES} SELECT table_id, len(list_distinct(list_transform(rows, lambda r: r[3]))) <> len(rows) AS dup_flag, len(rows) <= 2 AS orphan, CAST(len(list_distinct(list_transform(rows, lambda r: len(r)))) > 1 AS BOOLEAN) AS ragged FROM tables", name="fn_header_anomaly")
def fn_header_anomaly(spark, d):
    flags = F.transform("rows", lambda r: F.get(r, 2))
    return cell_tables(spark, d).select("table_id", G.header_anomaly(flags).alias("dup_flag"), G.orphan_table(F.col("rows")).alias("orphan"), G.ragged_rows(F.col("rows")).alias("ragged"))


@query(f"WITH {TABLES}, c AS (SELECT table_id, list_filter(list_transform(flatten(rows), lambda x: trim(x)), lambda x: x <> '') AS cells, len(rows) AS n FROM tables) SELECT table_id, n >= 2 AND len(cells) >= 6 AND len(list_filter(cells, lambda x: length(x) <= 2 OR regexp_matches(x, '^[\\d\\W]+$'))) > 0.45 * len(cells) AS diagram FROM c")
def fn_diagram_grid(spark, d):
    return cell_tables(spark, d).select("table_id", G.diagram_grid(F.col("rows")).alias("diagram"))


@query(f"WITH {TABLES}, r AS (SELECT table_id, list_transform(rows, lambda x: [CASE WHEN x[3] = 'R' THEN '' ELSE x[1] END, x[2]]) AS rows FROM tables) SELECT table_id, len(rows) >= 2 AND len(list_filter(rows, lambda x: x[1] = '' AND x[2] <> '')) > 0 AS blank_continuation FROM r")
def fn_blank_continuation(spark, d):
    rows = F.transform("rows", lambda x: F.array(F.when(F.get(x, 2) == "R", "").otherwise(F.get(x, 0)), F.get(x, 1)))
    return cell_tables(spark, d).select("table_id", G.blank_continuation(rows).alias("blank_continuation"))


@query(f"WITH {TABLES} SELECT table_id, table_id % 2 = 0 AS placeholder FROM tables")
def fn_placeholder_headers(spark, d):
    head = F.when(F.col("table_id") % 2 == 0, F.array(F.lit("0"), F.lit("1"))).otherwise(F.array(F.lit("part"), F.lit("1")))
    return cell_tables(spark, d).select("table_id", G.placeholder_headers(head).alias("placeholder"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN false ELSE doc_id % 2 = 0 END AS missing FROM documents")
def fn_context_anchor(spark, d):
    lead = F.when(F.col("doc_id") % 3 == 0, F.lit("no code here")).when(F.col("doc_id") % 2 == 0, F.lit("see 11H and 12K")).otherwise(F.lit("see 11H"))
    cells = F.when(F.col("doc_id") % 2 == 0, F.lit("a b")).otherwise(F.lit("row 11h b"))
    return table(spark, d, "documents").select("doc_id", G.lacks_anchor(cells, lead).alias("missing"))


_KEY = {"thing": ["that", "and"], "other": ["der", "die"], "rest": ["que", "la"]}


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(that|and)([^\\p{L}\\p{N}_]|$)') AS has_word, CASE WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(that|and)([^\\p{L}\\p{N}_]|$)') THEN 'thing' WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(der|die)([^\\p{L}\\p{N}_]|$)') THEN 'other' WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(que|la)([^\\p{L}\\p{N}_]|$)') THEN 'rest' END AS industry FROM documents", name="fn_industry")
def fn_industry(spark, d):
    return table(spark, d, "documents").select("doc_id", X.has_keyword(F.col("text"), _KEY["thing"]).alias("has_word"), X.industry(F.col("text"), _KEY).alias("industry"))


@query("SELECT doc_id, contains(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'), 'of the') AS supported FROM documents")
def fn_evidence(spark, d):
    return table(spark, d, "documents").select("doc_id", X.evidence_supported(F.lit(" Of  THE!"), F.col("text")).alias("supported"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'financial_statement' WHEN 'click' THEN 'invoice' WHEN 'error' THEN 'manual' ELSE 'report' END AS doc_type FROM events")
def fn_coerce_doctype(spark, d):
    e = F.col("event_type")
    raw = F.when(e == "view", "Financial Statement / invoice").when(e == "click", "invoice").when(e == "error", "Manual").otherwise("some other thing")
    return table(spark, d, "events").select("event_id", X.coerce_type(raw, ["invoice", "statement", "financial_statement"]).alias("doc_type"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'licen') THEN 'licensed' WHEN contains(lower(text), '@') THEN 'mail' ELSE 'report' END AS doc_type, CAST(CASE WHEN contains(lower(text), 'licen') OR contains(lower(text), '@') THEN 0.6 ELSE 0.5 END AS DOUBLE) AS confidence FROM documents")
def fn_heuristic_doctype(spark, d):
    g = X.guess_type(F.col("text"), None, {"licensed": ["licen"], "mail": ["@"]})
    return table(spark, d, "documents").select("doc_id", g["doc_type"].alias("doc_type"), g["confidence"].cast("double").alias("confidence"))


@query("SELECT item_id, text AS embedded FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 'short' || chr(10) || 'Keywords: a, b' || chr(10) || text FROM benchmark WHERE item_id % 2 = 1")
def fn_embed_input(spark, d):
    odd = F.col("item_id") % 2 == 1
    keys = F.when(odd, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "benchmark").select("item_id", X.embed_input(F.when(odd, "short").otherwise(""), keys, F.col("text")).alias("embedded"))


@query("SELECT vec_id, CAST(1.0 AS DOUBLE) AS norm FROM embeddings")
def fn_l2_normalize(spark, d):
    v = X.unit_vector(F.transform("embedding", lambda x: x * 3))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.reduce(v, F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


@query(f"WITH {SAID} SELECT conv_id, turn, regexp_matches(lower(text), 'not found in|i don''t know|no information') AS refusal FROM said")
def fn_refusal(spark, d):
    return said(spark, d).select("conv_id", "turn", X.is_refusal(F.col("text")).alias("refusal"))


@query("WITH " + SAID + " SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z ]', '', 'g')) IN ('hi', 'hello', 'hey', 'good morning', 'good afternoon', 'good evening', 'thanks', 'thank you') AS greeting, regexp_matches(text, '(?i)\\b(list all|all the|every|overview|summar(y|ise|ize)|compare|everything)\\b') AS broad, regexp_matches(text, '(?is)(^|\\n)\\s*(step\\s+\\d+|\\(?\\d+[.)])\\s+\\S') AS steps FROM said", name="fn_greeting")
def fn_greeting(spark, d):
    t = F.col("text")
    return said(spark, d).select("conv_id", "turn", X.is_greeting(t).alias("greeting"), X.is_broad(t).alias("broad"), X.has_steps(t).alias("steps"))


@query("SELECT p_partkey, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) WHEN n <= 702 THEN chr(CAST(65 + ((n - 1) // 26 - 1) % 26 AS INT)) || chr(CAST(65 + (n - 1) % 26 AS INT)) ELSE chr(CAST(65 + (((n - 1) // 26 - 1) // 26 - 1) % 26 AS INT)) || chr(CAST(65 + ((n - 1) // 26 - 1) % 26 AS INT)) || chr(CAST(65 + (n - 1) % 26 AS INT)) END AS letters FROM (SELECT p_partkey, p_partkey % 18000 + 1 AS n FROM part)")
def fn_col_letter(spark, d):
    return table(spark, d, "part").select("p_partkey", X.column_letter(F.col("p_partkey") % 18000 + 1).alias("letters"))


@query(f"WITH {BLOCKS}, {BOXES} SELECT a.document_id, a.block_order, CAST(round(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))), 6) AS DOUBLE) AS iou FROM boxes a JOIN boxes b ON a.document_id = b.document_id AND b.block_order = a.block_order + 1")
def fn_iou(spark, d):
    a = boxes(spark, d)
    b = a.select("document_id", (F.col("block_order") - 1).alias("block_order"), *(F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")))
    return a.join(b, ["document_id", "block_order"]).select("document_id", "block_order", F.round(G.iou(G.box("x0", "y0", "x1", "y1"), G.box("bx0", "by0", "bx1", "by1")), 6).alias("iou"))


@query(f"WITH {BLOCKS}, {BOXES} SELECT document_id, block_order, CAST(y0 AS DOUBLE) AS top_y0, CAST(y0 + (y1 - y0) * 0.55 AS DOUBLE) AS top_y1, CAST(y0 + (y1 - y0) * 0.45 AS DOUBLE) AS low_y0, CAST(y1 AS DOUBLE) AS low_y1 FROM boxes")
def fn_split_bbox(spark, d):
    h = G.halves(G.box("x0", "y0", "x1", "y1"), 0.1)
    return boxes(spark, d).select("document_id", "block_order", h["top"]["y0"].alias("top_y0"), h["top"]["y1"].alias("top_y1"), h["low"]["y0"].alias("low_y0"), h["low"]["y1"].alias("low_y1"))


@query(f"WITH {BLOCKS}, {BOXES} SELECT document_id, block_order, CAST(round(x0 / 600.0, 6) AS DOUBLE) AS x0, CAST(round(y0 / 800.0, 6) AS DOUBLE) AS y0, CAST(round(x1 / 600.0, 6) AS DOUBLE) AS x1, CAST(round(y1 / 800.0, 6) AS DOUBLE) AS y1 FROM boxes WHERE x1 <= 600 AND y1 <= 800", name="flt_bbox_valid")
def flt_bbox_valid(spark, d):
    b = boxes(spark, d).where("x1 <= 600 and y1 <= 800").select("document_id", "block_order", G.normalised(G.box("x0", "y0", "x1", "y1"), 600.0, 800.0).alias("b"))
    return b.where("b is not null").select("document_id", "block_order", "b.x0", "b.y0", "b.x1", "b.y1")


@query(f"WITH {BLOCKS}, {BOXES} SELECT document_id, block_order, CAST(100 + x0 * 0.5 AS DOUBLE) AS x0, CAST(200 + y0 * 0.25 AS DOUBLE) AS y0 FROM boxes")
def prj_bbox_remap(spark, d):
    r = G.remap(G.box("x0", "y0", "x1", "y1"), 100.0, 200.0, 0.5, 0.25)
    return boxes(spark, d).select("document_id", "block_order", r["x0"].alias("x0"), r["y0"].alias("y0"))


@query(f"WITH {BLOCKS}, {BOXES} SELECT document_id, block_order, CAST(800 - y1 AS DOUBLE) AS top, CAST(800 - y0 AS DOUBLE) AS bottom FROM boxes")
def prj_bbox_topleft(spark, d):
    r = G.from_bottom(G.box("x0", "y0", "x1", "y1"), 800.0)
    return boxes(spark, d).select("document_id", "block_order", r["y0"].alias("top"), r["y1"].alias("bottom"))


@query(f"WITH {BLOCKS}, {BOXES} SELECT document_id, block_order, CAST(greatest(0, x0 - 10) AS DOUBLE) AS x0, CAST(greatest(0, y0 - 20) AS DOUBLE) AS y0, CAST(least(500, x1 + 10) AS DOUBLE) AS x1, CAST(least(700, y1 + 5) AS DOUBLE) AS y1 FROM boxes")
def prj_crop_pad(spark, d):
    r = G.padded(G.box("x0", "y0", "x1", "y1"), (10.0, 20.0, 10.0, 5.0), 500.0, 700.0)
    return boxes(spark, d).select("document_id", "block_order", r["x0"].alias("x0"), r["y0"].alias("y0"), r["x1"].alias("x1"), r["y1"].alias("y1"))


@query("SELECT page_id, CAST(ty AS BIGINT) AS tile_y, CAST(tx AS BIGINT) AS tile_x, CAST(greatest(0, tx * 400 - 40) AS BIGINT) AS x0, CAST(least(1200, tx * 400 + 440) AS BIGINT) AS x1 FROM pages, range(3) a(tx), range(2) b(ty)", name="prj_tiles")
def prj_tiles(spark, d):
    return G.tiles(table(spark, d, "pages").select("page_id"), 1200, 800, 3, 2, 40).select("page_id", "tile_y", "tile_x", "x0", "x1")


@query("SELECT page_id, CAST(least(8, ceil(length(html) / 500.0)) AS BIGINT) AS n_tiles FROM pages")
def fn_tile_grid(spark, d):
    return table(spark, d, "pages").select("page_id", G.tile_count(F.length("html"), 500, 8).alias("n_tiles"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'diagram' WHEN length(html) > 3000 THEN 'large_format' WHEN length(html) < 600 THEN 'scanned' ELSE 'text' END AS page_class FROM pages")
def fn_page_class(spark, d):
    return table(spark, d, "pages").select("page_id", G.page_class(F.col("page_id") % 5 == 0, F.length("html") > 3000, F.length("html") < 600).alias("page_class"))


@query(f"WITH {BLOCKS}, {BOXES} SELECT document_id, page, CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE) / 524288 AS covered, sum((x1 - x0) * (y1 - y0)) > 24000 AS image_dominant FROM boxes GROUP BY document_id, page")
def fn_page_profile(spark, d):
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    p = boxes(spark, d).groupBy("document_id", "page").agg(F.sum(area).alias("a"))
    return p.select("document_id", "page", (F.col("a") / 524288.0).alias("covered"), (F.col("a") > 24000).alias("image_dominant"))


@query(
    """WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN '20240115_' || (1000 + doc_id) || '-' ELSE '' END || source || '_' || lang || '--' || doc_id || '.pdf', '\\.[A-Za-z0-9]+$', ''), '^(?:[0-9]{4,8}[_-]+)+', '') AS n FROM documents)
    SELECT doc_id, array_to_string(list_transform(string_split(trim(regexp_replace(n, '[_\\-]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM n"""
)
def prj_title(spark, d):
    i = F.col("doc_id").cast("string")
    dated = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("20240115_"), (F.col("doc_id") + 1000).cast("string"), F.lit("-"))).otherwise("")
    name = F.concat(dated, "source", F.lit("_"), "lang", F.lit("--"), i, F.lit(".pdf"))
    return table(spark, d, "documents").select("doc_id", X.title_from_filename(name).alias("title"))


@query(
    """WITH t AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' Please retry in ' || (doc_id % 97) || '.5s.' WHEN 1 THEN ' Try again after ' || doc_id || ' seconds' ELSE '' END AS t FROM documents)
    SELECT doc_id, TRY_CAST(regexp_extract(t, '(?i)(?:retry|try again)[^0-9]{0,20}([0-9]+(?:\\.[0-9]+)?)\\s*s', 1) AS DOUBLE) AS wait FROM t"""
)
def fn_retry_after(spark, d):
    i, n = F.col("doc_id"), F.col("doc_id") % 3
    more = F.when(n == 0, F.concat(F.lit(" Please retry in "), (i % 97).cast("string"), F.lit(".5s."))).when(n == 1, F.concat(F.lit(" Try again after "), i.cast("string"), F.lit(" seconds"))).otherwise("")
    return table(spark, d, "documents").select("doc_id", X.retry_seconds(F.concat("text", more)).alias("wait"))


@query("SELECT doc_id, page AS paragraph, text FROM (SELECT doc_id, unnest(range(0, len(p))) AS page, unnest(p) AS text FROM (SELECT doc_id, string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n') AS p FROM documents))")
def fn_paragraphs(spark, d):
    p = F.split(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")), "\\n\\s*\\n")
    return table(spark, d, "documents").select("doc_id", F.posexplode(p).alias("i", "text")).select("doc_id", F.col("i").cast("long").alias("paragraph"), "text")


# ---------------------------------------------------------------- operators over every row's own text
# as it stands, without the additions of the queries named without _all


@query()
def fn_collapse_repeat_all(spark, d):
    return table(spark, d, "documents").select("doc_id", X.collapse_repeats(F.col("text")).alias("text"))


@query()
def fn_fullwidth_all(spark, d):
    return table(spark, d, "documents").select("doc_id", X.half_width(F.col("text")).alias("text"))


@query()
def fn_callout_heading_all(spark, d):
    return blocks(spark, d).select("document_id", "block_order", X.is_callout(F.col("text")).alias("callout"), X.callout_format(F.col("text")).alias("formatted"))


@query()
def fn_list_marker_all(spark, d):
    return blocks(spark, d).select("document_id", "block_order", X.list_item(F.col("text"), F.lit("-")).alias("item"))


@query()
def fn_context_anchor_all(spark, d):
    # the lead-in of a table is the block before it
    lead = F.lag("text", 1, "").over(Window.partitionBy("document_id").orderBy("block_order"))
    led = blocks(spark, d).withColumn("lead", lead).where("type = 'table'")
    return led.select("document_id", "block_order", G.lacks_anchor(F.col("text"), F.col("lead")).alias("missing"))


@query()
def prj_title_all(spark, d):
    return table(spark, d, "documents").select("doc_id", X.title_from_filename(F.col("source")).alias("title"))


@query()
def fn_retry_after_all(spark, d):
    return table(spark, d, "documents").select("doc_id", X.retry_seconds(F.col("text")).alias("wait"))


@query()
def fn_step_markers_all(spark, d):
    return table(spark, d, "documents").select("doc_id", X.has_steps(F.col("text")).alias("steps"))
