"""Windows, rankings, sorts, top-k and set operations over the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as W
from ..registry import query, table
from ..sources.fixtures import BLOCKS, BOXES, TABLES, blocks, boxes, cell_tables


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events")
def win_rank_rrf(spark, d):
    return W.ranked(table(spark, d, "events"), ["user_id"], [F.desc("value"), F.asc("event_id")]).select("user_id", "event_id", "rank")


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS r FROM conversations) WHERE r <= 4")
def win_last_n(spark, d):
    return W.top(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn"), F.desc("text")], 4).select("conv_id", "turn", "text")


@query("SELECT conv_id, left(text, 60) AS title FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations WHERE role = 'user') WHERE r = 1")
def win_first_user(spark, d):
    u = table(spark, d, "conversations").where("role = 'user'")
    return u.groupBy("conv_id").agg(F.left(F.min_by("text", F.struct("turn", "text")), F.lit(60)).alias("title"))


@query("SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTES PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling FROM events")
def win_session_cum(spark, d):
    e = table(spark, d, "events").withColumn("score", F.floor("value"))
    return W.rolling_sum(e, "user_id", "ts", "score", 30).select("event_id", "rolling")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW) AS recent FROM events")
def win_recent(spark, d):
    e = table(spark, d, "events").withColumn("one", F.lit(1).cast("long"))
    return W.rolling_sum(e, "event_type", "ts", "one", 5, "recent").select("event_id", "recent")


@query(f"WITH {BLOCKS} SELECT document_id, block_order, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY block_order ROWS UNBOUNDED PRECEDING) AS section FROM blocks")
def win_carry_section(spark, d):
    past = Window.partitionBy("document_id").orderBy("block_order").rowsBetween(Window.unboundedPreceding, 0)
    return blocks(spark, d).select("document_id", "block_order", F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True).over(past).alias("section"))


@query(f"WITH {BLOCKS} SELECT document_id, block_order, coalesce(string_agg(text, ' ') OVER (PARTITION BY document_id ORDER BY block_order ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS context FROM blocks WHERE type <> 'table'")
def win_prev5(spark, d):
    before = Window.partitionBy("document_id").orderBy("block_order").rowsBetween(-5, -1)
    return blocks(spark, d).where("type <> 'table'").select("document_id", "block_order", F.array_join(F.collect_list("text").over(before), " ").alias("context"))


@query(f"WITH {BLOCKS} SELECT document_id, block_order, page, greatest(page, coalesce(lead(page) OVER (PARTITION BY document_id ORDER BY block_order) - 1, page + 10)) AS page_end FROM blocks WHERE type = 'heading'")
def win_section_range(spark, d):
    nxt = F.lead("page").over(Window.partitionBy("document_id").orderBy("block_order"))
    return blocks(spark, d).where("type = 'heading'").select("document_id", "block_order", "page", F.greatest("page", F.coalesce(nxt - 1, F.col("page") + 10)).alias("page_end"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) // 2 + 1 AS turn_no FROM conversations")
def win_turn_no(spark, d):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", (F.floor(n / 2) + 1).alias("turn_no"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w AS part, count(*) OVER (PARTITION BY l_orderkey) AS parts, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS upto FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)")
def win_table_part(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long").alias("part"), F.count("*").over(every).alias("parts"), F.sum(F.col("l_quantity").cast("long")).over(w).alias("upto"))


@query("SELECT o_orderkey, o_orderdate::VARCHAR AS created FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50)", name="srt_list_docs")
def srt_list_docs(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("SELECT c_custkey, pinned FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS pinned, c_acctbal FROM customer ORDER BY coalesce(CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END, false) DESC, c_acctbal DESC, c_custkey LIMIT 40)")
def srt_sessions(spark, d):
    pinned = F.when(F.col("c_custkey") % 3 == 0, F.lit(True)).when(F.col("c_custkey") % 3 == 1, F.lit(False))
    c = table(spark, d, "customer").withColumn("pinned", pinned)
    return c.orderBy(F.coalesce("pinned", F.lit(False)).desc(), F.desc("c_acctbal"), "c_custkey").limit(40).select("c_custkey", "pinned")


@query(f"WITH {BLOCKS} SELECT document_id, block_order, type FROM blocks ORDER BY document_id, block_order")
def srt_blocks(spark, d):
    return blocks(spark, d).select("document_id", "block_order", "type").orderBy("document_id", "block_order")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 10")
def srt_page_audit(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.orderBy(F.desc("ts"), "event_id").offset(10).limit(25).select("event_id", "event_type")


@query(
    """SELECT user_id, event_id, rank, used, cut FROM (SELECT *, min(CASE WHEN used <= 500 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS fits,
      false AS cut FROM (SELECT user_id, event_id, row_number() OVER w AS rank, CAST(sum(t) OVER w AS BIGINT) AS used FROM (SELECT *, CAST(floor(value) AS BIGINT) % 200 AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING))) WHERE fits = 1"""
)
def topk_context_pack(spark, d):
    e = table(spark, d, "events").withColumn("t", F.floor("value") % 200)
    return W.pack_prefix(e, ["user_id"], [F.desc("value"), F.asc("event_id")], "t", 500).select("user_id", "event_id", "rank", "used", "cut")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 200 AS t, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events),
    f(user_id, r, used, n) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM e
      UNION ALL SELECT f.user_id, e.r, CASE WHEN used + t <= 500 THEN used + t ELSE used END, CASE WHEN used + t <= 500 THEN n + 1 ELSE n END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1),
    l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC) AS k FROM f) SELECT user_id, used, n AS taken, r - n AS dropped FROM l WHERE k = 1"""
)
def topk_greedy_budget(spark, d):
    e = table(spark, d, "events").withColumn("t", F.floor("value") % 200)
    return W.pack_greedy(e, ["user_id"], [F.desc("value"), F.asc("event_id")], "t", 500, "event_id").select("user_id", "used", F.size("taken").cast("long").alias("taken"), "dropped")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE value >= 50) WHERE r <= 5")
def topk_rerank(spark, d):
    return W.top(table(spark, d, "events").where("value >= 50"), ["user_id"], [F.desc("value"), F.asc("event_id")], 5).select("user_id", "event_id")


@query("SELECT event_id AS id, min(sub) AS sub FROM (SELECT event_id, 0 AS sub FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 1 FROM events WHERE value > 90) GROUP BY event_id")
def set_union_dedup(spark, d):
    e = table(spark, d, "events")
    both = e.where("event_type = 'error'").select(F.col("event_id").alias("id"), F.lit(0).alias("sub")).union(e.where("value > 90").select("event_id", F.lit(1)))
    return W.first_of(both, ["id"], [F.asc("sub")])


@query("SELECT user_id, max(value) AS best FROM (SELECT user_id, value FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, value / 2 FROM events WHERE event_type = 'click') GROUP BY user_id")
def set_union_maxscore(spark, d):
    e = table(spark, d, "events")
    both = e.where("event_type = 'view'").select("user_id", "value").union(e.where("event_type = 'click'").select("user_id", F.col("value") / 2))
    return both.groupBy("user_id").agg(F.max("value").alias("best"))


@query(f"WITH {BLOCKS} SELECT document_id, min(block_order) AS block_order FROM (SELECT document_id, page, block_order, regexp_replace(trim(text), '\\s+', ' ', 'g') AS t FROM blocks WHERE text <> '') GROUP BY document_id, page, t")
def set_dedup_chunk(spark, d):
    b = blocks(spark, d).where("text <> ''").withColumn("t", F.regexp_replace(F.trim("text"), "\\s+", " "))
    return b.groupBy("document_id", "page", "t").agg(F.min("block_order").alias("block_order")).select("document_id", "block_order")


@query(f"WITH {BLOCKS} SELECT document_id, page, min(block_order) AS first FROM blocks GROUP BY document_id, page")
def set_dedup_source(spark, d):
    return blocks(spark, d).groupBy("document_id", "page").agg(F.min("block_order").alias("first"))


_SUBS = "[CASE WHEN item_id % 3 = 0 THEN '  ' || lower(text) || ' ' WHEN item_id % 3 = 1 THEN split_part(text, '.', 1) ELSE text || '?' END, 'other']"


@query(f"SELECT item_id, s || CASE WHEN list_contains(list_transform(s, lambda q: lower(trim(q))), lower(trim(text))) OR length(text) > 300 THEN [] ELSE [text] END AS subs FROM (SELECT item_id, text, {_SUBS} AS s FROM benchmark)")
def set_dedup_query(spark, d):
    t, n = F.col("text"), F.col("item_id") % 3
    first = F.when(n == 0, F.concat(F.lit("  "), F.lower(t), F.lit(" "))).when(n == 1, F.split_part(t, F.lit("."), F.lit(1))).otherwise(F.concat(t, F.lit("?")))
    return table(spark, d, "benchmark").select("item_id", W.with_verbatim(F.array(first, F.lit("other")), t, 300).alias("subs"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS captioned FROM documents")
def set_dedup_image(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("captioned"))
    return docs.join(first, "h").select("doc_id", "captioned")


@query("SELECT a.item_id, CAST(len(list_intersect(list_distinct(regexp_split_to_array(lower(a.text), '\\s+')), list_distinct(regexp_split_to_array(lower(b.text), '\\s+')))) AS BIGINT) AS common FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def set_intersect(spark, d):
    b = table(spark, d, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.split(F.lower("text"), "\\s+").alias("w2"))
    return b.join(other, "item_id").select("item_id", F.size(F.array_intersect(F.split(F.lower("text"), "\\s+"), "w2")).cast("long").alias("common"))


@query("SELECT user_id, event_type FROM events WHERE value > 50 EXCEPT SELECT user_id, event_type FROM events WHERE value > 150")
def set_except(spark, d):
    e = table(spark, d, "events")
    return e.where("value > 50").select("user_id", "event_type").exceptAll(e.where("false").select("user_id", "event_type")).dropDuplicates().join(e.where("value > 150").select("user_id", "event_type").dropDuplicates(), ["user_id", "event_type"], "left_anti")


@query()
def set_merge_boxes(spark, d):
    return W.merge_boxes(boxes(spark, d), ["document_id", "page"], "block_order")


@query(f"WITH {TABLES} SELECT table_id, CAST(len(rows) AS BIGINT) AS n FROM tables INTERSECT SELECT l_orderkey, count(*) FROM lineitem GROUP BY l_orderkey")
def set_intersect_rows(spark, d):
    t = cell_tables(spark, d).select("table_id", F.size("rows").cast("long").alias("n"))
    return t.intersect(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.count("*").alias("n")))
