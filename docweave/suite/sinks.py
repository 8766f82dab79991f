"""Sinks over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sinks as S
from ..registry import query, table
from ..sources.fixtures import BLOCKS, blocks


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 100000000, 'X' FROM orders WHERE o_orderkey % 50 = 0")
def snk_chunk_upsert(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = old.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus")).union(old.where("o_orderkey % 50 = 0").select(F.col("o_orderkey") + 100000000, F.lit("X")))
    return S.upsert(old, new, ["o_orderkey"])


@query(f"WITH {BLOCKS} SELECT document_id, block_order, CASE WHEN document_id % 2 = 0 THEN text || '!' ELSE text END AS text FROM blocks WHERE document_id % 2 = 1 OR block_order < 2")
def snk_blocks_replace(spark, d):
    old = blocks(spark, d).select("document_id", "block_order", "text")
    new = old.where("document_id % 2 = 0 and block_order < 2").withColumn("text", F.concat("text", F.lit("!")))
    # a document always has a first block, so every even one is replaced
    return S.replace_group(old, new, ["document_id"])


@query(f"WITH {BLOCKS}, old AS (SELECT document_id, block_order FROM blocks WHERE page <> 1), top AS (SELECT document_id, max(block_order) AS top FROM old GROUP BY document_id) SELECT document_id, block_order FROM old UNION ALL SELECT document_id, coalesce(top, -1) + row_number() OVER (PARTITION BY document_id ORDER BY block_order) FROM (SELECT document_id, block_order FROM blocks WHERE page = 1) LEFT JOIN top USING (document_id)")
def snk_page_blocks(spark, d):
    b = blocks(spark, d)
    cols = ["document_id", "block_order"]
    return S.append_after(b.where("page <> 1").select(*cols), b.where("page = 1").select(*cols), "document_id", "block_order")


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey + 1000000, c_name FROM customer WHERE c_custkey % 10 = 0")
def snk_doc_insert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name")
    new = old.where("c_custkey % 10 = 0")
    return S.insert_absent(old, new.select("c_custkey", F.lit("again").alias("c_name")).union(new.select(F.col("c_custkey") + 1000000, "c_name")), ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'done' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def snk_progress(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = old.where("c_custkey % 4 = 0").select("c_custkey", F.lit("done").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return S.update_known(old, new, "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("SELECT o_orderkey, CASE WHEN n = 0 THEN 'empty' WHEN bad > 0 THEN 'failed' ELSE 'ready' END AS status, n FROM (SELECT o_orderkey, count(l_orderkey) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS bad FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)")
def snk_finalize(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    both = table(spark, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left").fillna(0, ["n", "bad"])
    return both.select("o_orderkey", F.when(F.col("n") == 0, "empty").when(F.col("bad") > 0, "failed").otherwise("ready").alias("status"), "n")


@query("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS superseded_by, CASE WHEN lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN 'active' ELSE 'superseded' END AS status FROM conversations")
def snk_supersede(spark, d):
    return S.supersede(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query(f"WITH {BLOCKS} SELECT document_id, page, max(block_order) AS block_order FROM blocks GROUP BY document_id, page")
def snk_page_image(spark, d):
    return S.latest(blocks(spark, d).select("document_id", "page", "block_order"), ["document_id", "page"], "block_order")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def snk_delete_cascade(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return S.delete_keys(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), gone, "l_orderkey")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '0f8fad5b-d9cb-469f-a165-70867728950e' END AS document_uuid FROM documents")
def snk_llm_calls(spark, d):
    t = F.when(F.col("doc_id") % 2 == 0, "0f8fad5b-d9cb-469f-a165-70867728950e").otherwise("not one")
    return table(spark, d, "documents").select("doc_id", S.valid_uuid(t).alias("document_uuid"))


@query("SELECT conv_id, turn, sha256(text) AS query_hash, left(text, 500) AS excerpt FROM conversations WHERE role = 'user'")
def snk_query_audit(spark, d):
    return S.audit(table(spark, d, "conversations").where("role = 'user'"), "text", "text").select("conv_id", "turn", "query_hash", "excerpt")


@query("SELECT DISTINCT 'words@' || sha256(lang || ':64')[1:8] AS index_version, lang FROM documents")
def snk_index_version(spark, d):
    v = F.concat(F.lit("words@"), F.substring(F.sha2(F.concat("lang", F.lit(":64")).cast("binary"), 256), 1, 8))
    new = table(spark, d, "documents").select(v.alias("index_version"), "lang").dropDuplicates()
    return S.insert_absent(new.where("lang = 'en'"), new, ["index_version"])


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase')")
def snk_guard_events(spark, d):
    return S.security_events(table(spark, d, "events"), ("error", "purchase")).select("event_id", "event_type")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 5 <> 0")
def snk_vectors(spark, d):
    e = table(spark, d, "embeddings").withColumn("vector", F.when(F.col("vec_id") % 5 != 0, F.col("embedding")))
    return e.where("vector is not null").select("vec_id", "label")


@query("SELECT vec_id, label = 3 AS superseded FROM embeddings WHERE label <> 4", name="snk_vec_supersede")
def snk_vec_supersede(spark, d):
    e = table(spark, d, "embeddings")
    gone = e.where("label = 4").select("vec_id")
    return S.delete_keys(e, gone, "vec_id").select("vec_id", (F.col("label") == 3).alias("superseded"))


@query("SELECT doc_id, length(text) AS n FROM documents")
def snk_strip_nul(spark, d):
    dirty = F.concat(F.lit("\x00"), "text", F.lit("\x00"))
    return table(spark, d, "documents").select("doc_id", F.length(S.strip_nul(dirty)).cast("long").alias("n"))


@query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS VARCHAR) AS day, CAST(o_totalprice AS DOUBLE) AS price FROM orders")
def snk_json_safe(spark, d):
    j = F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_totalprice").alias("price")))
    back = F.from_json(j, "day string, price double")
    return table(spark, d, "orders").select("o_orderkey", back.alias("x")).select("o_orderkey", "x.day", "x.price")


@query("SELECT conv_id, count(*) AS turns, left(min_by(text, turn) FILTER (WHERE role = 'user'), 60) AS first_message FROM conversations GROUP BY conv_id")
def snk_turn(spark, d):
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.left(first, F.lit(60)).alias("first_message"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN 'edited' ELSE text END AS text FROM conversations")
def snk_turn_update(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"))
    edits = c.where("conv_id % 3 = 0 and turn = 1").select("message_id", F.lit("edited").alias("text"))
    return S.update_known(c, edits, "message_id", ["text"]).select("conv_id", "turn", "text")


@query("SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'renamed' ELSE 'untitled' END AS title, conv_id % 2 = 0 AS pinned FROM conversations")
def snk_session_upsert(spark, d):
    old = table(spark, d, "conversations").select("conv_id").dropDuplicates().select("conv_id", F.lit("untitled").alias("title"), F.lit(False).alias("pinned"))
    new = old.where("conv_id % 2 = 0").select("conv_id", F.lit("renamed").alias("title"), F.lit(True).alias("pinned"))
    return S.update_known(old, new, "conv_id", ["title", "pinned"])


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 5 <> 0")
def snk_session_delete(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return S.delete_keys(c, c.where("conv_id % 5 = 0").select("conv_id").dropDuplicates(), "conv_id")


@query("SELECT event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total, max(value) AS most FROM events GROUP BY event_type")
def snk_trace_metrics(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total"), F.max("value").alias("most"))


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END AS BIGINT) AS n FROM documents")
def js_contains_append(spark, d):
    a = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    return table(spark, d, "documents").select("doc_id", F.size(S.append_absent(a, F.when(F.col("doc_id") % 2 == 0, 1).otherwise(7).cast("long"))).cast("long").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def js_path(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k') = '42'")
def js_message_id(spark, d):
    return table(spark, d, "events").where(F.get_json_object("props", "$.k") == "42").select("event_id", "props")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'note ' || event_id AS note FROM events")
def js_extract_obj2(spark, d):
    said = F.concat(F.lit("Sure, here: "), "props", F.lit(" — note "), F.col("event_id").cast("string"))
    obj = F.from_json(F.regexp_extract(said, "(?s)(\\{.*\\})", 1), "k int")
    return table(spark, d, "events").select("event_id", obj["k"].alias("k"), F.regexp_extract(said, "(note \\d+)$", 1).alias("note"))


@query("SELECT doc_id, 'Field: lang | Value: ' || lang AS line FROM documents")
def ar_structured(spark, d):
    pairs = F.map_entries(F.create_map(F.lit("lang"), F.col("lang")))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(pairs, lambda e: F.concat(F.lit("Field: "), e["key"], F.lit(" | Value: "), e["value"])), "\n").alias("line"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x rows' ELSE 'x' || chr(10) || 'rows' END AS text FROM documents")
def ar_text_plus_table(spark, d):
    t = F.when(F.col("doc_id") % 2 == 0, "x rows").otherwise("x")
    return table(spark, d, "documents").select("doc_id", F.when(F.contains(t, F.lit("rows")), t).otherwise(F.concat(t, F.lit("\nrows"))).alias("text"))


