"""Joins over the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import joins as J
from ..registry import query, table
from ..sources.fixtures import BLOCKS, BOXES, CALLS, TABLES, blocks, boxes, calls, cell_tables


@query("SELECT e.event_id AS hit, o.o_orderkey AS id, o.o_orderpriority, row_number() OVER (PARTITION BY e.user_id ORDER BY e.value DESC, e.event_id) AS rank FROM events e JOIN orders o ON o.o_orderkey = e.event_id")
def jn_hydrate(spark, d):
    hits = table(spark, d, "events").select(F.col("event_id").alias("hit"), "user_id", "value")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    found = J.hydrate(hits, rows, F.col("hit") == F.col("id"))
    return found.select("hit", "id", "o_orderpriority", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "hit")).cast("long").alias("rank"))


@query(f"WITH {BLOCKS} SELECT doc_id, lang, string_agg(b.text, ' ' ORDER BY block_order) AS head FROM documents LEFT JOIN blocks b ON doc_id = document_id AND (page = 1 OR block_order < 3) GROUP BY doc_id, lang")
def jn_doc_page1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    head = blocks(spark, d).where("page = 1 or block_order < 3").groupBy("document_id").agg(F.expr("listagg(text, ' ') within group (order by block_order)").alias("head"))
    return docs.join(head, F.col("doc_id") == F.col("document_id"), "left").select("doc_id", "lang", "head")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jn_sessions_exists(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT DISTINCT ON (conv_id) conv_id, left(text, 60) AS first_message FROM conversations WHERE role = 'user' ORDER BY conv_id, turn, text")
def jn_first_message(spark, d):
    users = table(spark, d, "conversations").where("role = 'user'")
    return users.groupBy("conv_id").agg(F.left(F.min_by("text", F.struct("turn", "text")), F.lit(60)).alias("first_message"))


@query(
    """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events), x AS (SELECT * FROM a WHERE r <= 20),
    b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events), y AS (SELECT * FROM b WHERE r <= 20)
    SELECT user_id, event_id, round(0.6 * coalesce(1.0::DOUBLE / (20 + x.r), 0) + 0.4 * coalesce(1.0::DOUBLE / (20 + y.r), 0), 9) AS score FROM x FULL JOIN y USING (user_id, event_id)"""
)
def jn_full_outer_rrf(spark, d):
    e = table(spark, d, "events")
    rank = lambda c: F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(c), "event_id"))
    x = e.select("user_id", "event_id", rank("value").alias("rx")).where("rx <= 20")
    y = e.select("user_id", "event_id", rank("ts").alias("ry")).where("ry <= 20")
    return J.fuse(x, y, ["user_id", "event_id"], "rx", "ry", k=20).select("user_id", "event_id", F.round("score", 9).alias("score"))


@query(f"WITH {BLOCKS}, seed AS (SELECT DISTINCT document_id, page FROM blocks WHERE type = 'heading' AND block_order > 0) SELECT document_id, page, string_agg(text, chr(10) || chr(10) ORDER BY block_order) AS page_text FROM blocks JOIN seed USING (document_id, page) GROUP BY document_id, page")
def jn_page_expand(spark, d):
    b = blocks(spark, d)
    seed = b.where("type = 'heading' and block_order > 0").select("document_id", "page")
    return J.expand_pages(seed, b)


@query("SELECT a.conv_id, a.turn, a.text AS call, b.text AS result FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'")
def jn_tool_calls(spark, d):
    c = table(spark, d, "conversations")
    calls_ = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("call"))
    results = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("result"))
    return calls_.join(results, ["conv_id", "turn"], "left")


@query(
    """WITH scope AS (SELECT c_custkey AS n, CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN c_name ELSE 'no such name' END AS item FROM customer)
    SELECT n, coalesce(CAST(a.c_custkey AS BIGINT), b.c_custkey) AS resolved FROM scope LEFT JOIN customer a ON item = CAST(a.c_custkey AS VARCHAR) LEFT JOIN customer b ON item = b.c_name"""
)
def jn_scope_resolve(spark, d):
    c = table(spark, d, "customer")
    item = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise("no such name")
    scope = c.select(F.col("c_custkey").alias("n"), item.alias("item"))
    keys = [c.select(F.col("c_custkey").cast("string").alias("key"), F.col("c_custkey").alias("id")), c.select(F.col("c_name").alias("key"), F.col("c_custkey").alias("id"))]
    return J.resolve(scope, keys).select("n", F.col("id").alias("resolved"))


@query(
    f"""WITH {BLOCKS}, {BOXES}, twice AS (SELECT document_id, page, block_order, x0, y0, x1, y1 FROM boxes UNION ALL SELECT document_id, page, block_order + 10000, x0 + block_order % 40, y0 + 5, x1 + block_order % 40, y1 + 5 FROM boxes), o AS (SELECT a.document_id, a.block_order AS first, b.block_order AS second,
      greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb
      FROM twice a JOIN twice b ON a.document_id = b.document_id AND a.page = b.page AND a.block_order < b.block_order)
    SELECT document_id, first, second FROM o WHERE inter > 0.3 * (sa + sb - inter) OR inter > 0.8 * sb"""
)
def jn_iou_dedup(spark, d):
    # what two detectors found on a page: the second one's boxes lie a little aside
    b = boxes(spark, d).select("document_id", "page", "block_order", "x0", "y0", "x1", "y1")
    aside = F.col("block_order") % 40
    b = b.unionByName(b.select("document_id", "page", (F.col("block_order") + 10000).alias("block_order"), (F.col("x0") + aside).alias("x0"), (F.col("y0") + 5).alias("y0"), (F.col("x1") + aside).alias("x1"), (F.col("y1") + 5).alias("y1")))
    return J.overlapping(b, b, ["document_id", "page"], 0.3, 0.8).where("block_order < other_order").select("document_id", F.col("block_order").alias("first"), F.col("other_order").alias("second"))


@query(
    f"""WITH {BLOCKS}, {BOXES}, o AS (SELECT a.document_id, a.block_order, b.block_order AS other,
      greatest(0, least(a.x1, b.x1 + 9) - greatest(a.x0, b.x0 + 9)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb
      FROM boxes a JOIN boxes b ON a.document_id = b.document_id AND a.page = b.page)
    SELECT document_id, block_order, other AS best FROM (SELECT *, row_number() OVER (PARTITION BY document_id, block_order ORDER BY inter::DOUBLE / (sa + sb - inter) DESC, other) AS r FROM o WHERE inter >= 0.3 * (sa + sb - inter)) WHERE r = 1"""
)
def jn_iou_best(spark, d):
    b = boxes(spark, d)
    moved = b.withColumns({"x0": F.col("x0") + 9, "x1": F.col("x1") + 9})
    return J.best_overlap(b, moved, ["document_id", "page"], 0.3).select("document_id", "block_order", F.col("other_order").alias("best"))


@query(
    f"""WITH {BLOCKS}, {BOXES} SELECT document_id, block_order FROM boxes a WHERE block_order % 2 = 1 AND NOT EXISTS (SELECT 1 FROM boxes b WHERE a.document_id = b.document_id AND a.page = b.page AND b.block_order % 2 = 0
      AND (greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.3 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))
        OR greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.6 * (a.x1 - a.x0) * (a.y1 - a.y0)))"""
)
def jn_iou_anti(spark, d):
    b = boxes(spark, d)
    return J.not_overlapping(b.where("block_order % 2 = 1"), b.where("block_order % 2 = 0"), ["document_id", "page"], 0.3, 0.6).select("document_id", "block_order")


@query(f"WITH {BLOCKS}, {BOXES} SELECT a.document_id, a.block_order, min(b.block_order) AS cell FROM boxes a JOIN boxes b ON a.document_id = b.document_id AND a.page = b.page AND (a.x0 + a.x1) / 2.0 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2.0 BETWEEN b.y0 AND b.y1 GROUP BY ALL")
def jn_cell_contains(spark, d):
    b = boxes(spark, d)
    return J.containing_cell(b, b, ["document_id", "page"]).select("document_id", "block_order", F.col("cell"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN n_name ELSE c_mktsegment END AS filled FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def jn_sparse_fill(spark, d):
    c = table(spark, d, "customer").withColumn("cell", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")))
    return J.fill_empty(c, table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "cell", "n_name").select("c_custkey", F.col("cell").alias("filled"))


@query(f"WITH {BLOCKS}, {BOXES} SELECT a.document_id, a.block_order, min((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0)) AS distance2 FROM boxes a JOIN boxes b ON a.document_id = b.document_id AND a.page = b.page AND a.block_order % 4 = 0 AND b.block_order % 4 <> 0 GROUP BY ALL")
def jn_nearest_token(spark, d):
    b = boxes(spark, d)
    return J.nearest(b.where("block_order % 4 = 0"), b.where("block_order % 4 <> 0"), ["document_id", "page"]).select("document_id", "block_order", "distance2")


@query("SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 0.9 WHEN 'fr' THEN 0.8 ELSE 0.5 END AS DOUBLE) AS trust FROM documents")
def jn_trust(spark, d):
    return J.trust(table(spark, d, "documents"), "lang", {"en": 0.9, "fr": 0.8}, 0.5).select("doc_id", "trust")


@query(f"WITH {CALLS} SELECT event_id, round(input_tokens * CASE model WHEN 'model-0' THEN 0.15 WHEN 'model-1' THEN 0.50 ELSE 0.10 END::DOUBLE, 6) AS micro_usd FROM calls")
def jn_cost(spark, d):
    price = spark.createDataFrame([("model-0", 0.15), ("model-1", 0.50), ("model-2", 0.10)], "model string, price double")
    return calls(spark, d).join(F.broadcast(price), "model", "left").select("event_id", F.round(F.col("input_tokens") * F.coalesce("price", F.lit(0.0)), 6).alias("micro_usd"))


_SECTIONS = "sec AS (SELECT document_id, block_order AS section, page AS page_start, greatest(page, coalesce(lead(page) OVER (PARTITION BY document_id ORDER BY block_order) - 1, page + 10)) AS page_end FROM blocks WHERE type = 'heading')"


@query(f"WITH {BLOCKS}, {_SECTIONS} SELECT b.document_id, b.block_order, min(section) AS section FROM blocks b JOIN sec s ON b.document_id = s.document_id AND b.page BETWEEN page_start AND page_end WHERE b.type = 'text' GROUP BY ALL")
def jn_interval_section(spark, d):
    b = blocks(spark, d)
    sections = J.section_ranges(b.where("type = 'heading'"))
    return J.in_section(b.where("type = 'text'"), sections).select("document_id", "block_order", "section")


@query(f"WITH {BLOCKS} SELECT document_id, block_order, (SELECT max(h.block_order) FROM blocks h WHERE h.document_id = b.document_id AND h.type = 'heading' AND h.block_order <= b.block_order) AS heading FROM blocks b")
def jn_asof_section(spark, d):
    return J.carry(blocks(spark, d), F.when(F.col("type") == "heading", F.col("block_order")), "heading").select("document_id", "block_order", "heading")


@query(f"WITH {TABLES} SELECT a.table_id, array_to_string(a.rows[1], ',') = array_to_string(b.rows[1], ',') AS same_first FROM tables a JOIN tables b USING (table_id)", name="jn_table_self")
def jn_table_self(spark, d):
    t = cell_tables(spark, d)
    other = t.select("table_id", F.col("rows").alias("again"))
    return t.join(other, "table_id").select("table_id", (F.array_join(F.get("rows", 0), ",") == F.array_join(F.get("again", 0), ",")).alias("same_first"))
