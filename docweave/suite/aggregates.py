"""Aggregations over the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..registry import query, table
from ..sources.fixtures import BLOCKS, BOXES, CALLS, TABLES, blocks, boxes, calls, cell_tables


@query(f"WITH {CALLS} SELECT kind, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM calls GROUP BY kind")
def agg_usage_kind(spark, d):
    return A.usage_by_kind(calls(spark, d))


@query(
    f"""WITH {CALLS}, p(model, p_in, p_out) AS (VALUES ('model-0', 0.15::DOUBLE, 0.60::DOUBLE), ('model-1', 0.50, 1.50), ('model-2', 0.10, 0.40)),
    u AS (SELECT model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM calls GROUP BY model)
    SELECT model, input_tokens, output_tokens, round((input_tokens * coalesce(p_in, 0) + output_tokens * coalesce(p_out, 0)) / 1e6, 6) AS cost FROM u LEFT JOIN p USING (model)"""
)
def agg_usage_model_cost(spark, d):
    return A.usage_cost(calls(spark, d))


@query(f"WITH {CALLS} SELECT session_id, max(input_tokens) AS peak FROM calls GROUP BY session_id")
def agg_context_peak(spark, d):
    return A.context_peak(calls(spark, d))


@query(
    f"""WITH {CALLS} SELECT session_id, round(sum(CASE model WHEN 'model-0' THEN 0.15 WHEN 'model-1' THEN 0.50 ELSE 0.10 END::DOUBLE * i) / 1e6, 6) AS cost
    FROM (SELECT session_id, model, sum(input_tokens) AS i FROM calls GROUP BY session_id, model) GROUP BY session_id"""
)
def agg_cost_backfill(spark, d):
    # usage as JSON by model, as it is stored with a document, exploded again
    packed = calls(spark, d).groupBy("session_id", "model").agg(F.sum("input_tokens").alias("i")).groupBy("session_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("model", "i")))).alias("usage"))
    back = packed.select("session_id", F.explode(F.from_json("usage", "map<string,bigint>")).alias("model", "i"))
    price = spark.createDataFrame([(m, p[0]) for m, p in A.PRICES.items()], "model string, price double")
    return back.join(F.broadcast(price), "model").groupBy("session_id").agg(F.round(F.sum(F.col("price") * F.col("i")) / 1e6, 6).alias("cost"))


@query(f"WITH {BLOCKS} SELECT document_id, count(*) AS n_chunks, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM blocks GROUP BY document_id")
def agg_indexed_tokens(spark, d):
    return blocks(spark, d).groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum(F.floor(F.length("text") / 4)).alias("tokens"))


@query(
    f"""WITH {BLOCKS}, now AS (SELECT document_id, count(*) AS n, avg(0.5 + (block_order % 2) * 0.25::DOUBLE) AS confidence, count(*) FILTER (WHERE document_id % 5 = 0) AS drawings,
      count(*) FILTER (WHERE document_id % 5 = 0 AND type = 'heading') AS bare FROM blocks GROUP BY document_id),
    s AS (SELECT document_id, n, n * (1 + document_id % 3) AS prev, confidence, drawings, bare FROM now)
    SELECT document_id, n AS n_chunks, round(0.5 * (CASE WHEN (prev - n) / prev > 0.30 THEN greatest(0.0, 1 - ((prev - n) / prev) / 0.30 * 0.5) ELSE 1.0 END) + 0.3 * confidence + 0.2 * (CASE WHEN drawings > 0 THEN 1 - bare / drawings ELSE 1.0 END), 3)::DOUBLE AS score,
      round(0.5 * (CASE WHEN (prev - n) / prev > 0.30 THEN greatest(0.0, 1 - ((prev - n) / prev) / 0.30 * 0.5) ELSE 1.0 END) + 0.3 * confidence + 0.2 * (CASE WHEN drawings > 0 THEN 1 - bare / drawings ELSE 1.0 END), 3) < 0.5 AS warn FROM s"""
)
def agg_quality_gate(spark, d):
    b = blocks(spark, d)
    chunks = b.select(
        "document_id",
        (0.5 + (F.col("block_order") % 2) * 0.25).alias("confidence"),
        F.when(F.col("document_id") % 5 == 0, "cad").otherwise("manual").alias("doc_type"),
        (F.col("type") != "heading").alias("has_codes"),
    )
    before = b.groupBy("document_id").agg((F.count("*") * (1 + F.col("document_id") % 3)).alias("previous"))
    return A.quality_gate(chunks, before)


@query(
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word, unnest(range(0, len(regexp_extract_all(lower(text), '[a-z]{4,}')))) AS place FROM documents),
    c AS (SELECT doc_id, word, count(*) AS n, min(place) AS first FROM w WHERE word NOT IN ('that', 'with') GROUP BY doc_id, word)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 8"""
)
def agg_keyword_freq(spark, d):
    return A.keyword_frequency(table(spark, d, "documents"), "doc_id", "text", ("that", "with"))


@query(
    """WITH w AS (SELECT DISTINCT doc_id, lower(text) AS t, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents),
    c AS (SELECT doc_id, word, CAST((length(t) - length(replace(t, word, ''))) / length(word) AS BIGINT) AS n FROM w)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 8"""
)
def agg_keyword_cad(spark, d):
    return A.keyword_occurrences(table(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {BLOCKS} SELECT document_id, string_agg(text, chr(10) ORDER BY block_order) AS head FROM blocks WHERE page = 1 GROUP BY document_id")
def agg_string(spark, d):
    return blocks(spark, d).where("page = 1").groupBy("document_id").agg(F.expr("listagg(text, '\\n') within group (order by block_order)").alias("head"))


@query(f"WITH {BLOCKS} SELECT doc_id, coalesce(max(block_order), -1) AS last FROM documents LEFT JOIN blocks ON doc_id = document_id AND type = 'table' GROUP BY doc_id")
def agg_max_order(spark, d):
    tables = blocks(spark, d).where("type = 'table'").groupBy("document_id").agg(F.max("block_order").alias("last"))
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(tables, F.col("doc_id") == F.col("document_id"), "left").select("doc_id", F.coalesce("last", F.lit(-1).cast("long")).alias("last"))


_KIND = "CASE WHEN regexp_matches(cell, '\\d{1,4}[/-]\\d{1,4}') THEN 'date' WHEN regexp_matches(cell, '^[\\d.,$%/+\\-\\s]+$') THEN 'num' WHEN length(cell) <= 4 AND regexp_matches(cell, '\\d') THEN 'code' ELSE 'text' END"


@query(
    f"""WITH {TABLES}, r AS (SELECT table_id, unnest(rows) AS row, unnest(range(0, len(rows))) AS r FROM tables), c AS (SELECT table_id, r, unnest(row) AS cell, unnest(range(0, 4)) AS "column" FROM r),
    k AS (SELECT table_id, "column", {_KIND} AS kind, count(*) AS n, min(r) AS first FROM c GROUP BY ALL)
    SELECT table_id, "column", kind FROM (SELECT *, row_number() OVER (PARTITION BY table_id, "column" ORDER BY n DESC, first) AS rank FROM k) WHERE rank = 1"""
)
def agg_mode_coltype(spark, d):
    return A.column_types(cell_tables(spark, d))


@query(
    f"""WITH {TABLES}, r AS (SELECT table_id, unnest(rows) AS row FROM tables), c AS (SELECT table_id, unnest([CASE WHEN row[3] = 'R' THEN '' ELSE row[1] END, row[2], CASE WHEN row[3] <> 'N' THEN '' ELSE row[3] END]) AS cell, unnest(range(0, 3)) AS "column" FROM r),
    s AS (SELECT table_id, "column", count(*) FILTER (WHERE cell = '') / count(*) AS share FROM c GROUP BY ALL)
    SELECT table_id, "column", share, share >= 0.5 AND min(share) OVER (PARTITION BY table_id) <= 0.2 AS sparse FROM s"""
)
def agg_empty_frac(spark, d):
    rows = F.transform("rows", lambda r: F.array(F.when(F.get(r, 2) == "R", "").otherwise(F.get(r, 0)), F.get(r, 1), F.when(F.get(r, 2) != "N", "").otherwise(F.get(r, 2))))
    return A.empty_share(cell_tables(spark, d).select("table_id", rows.alias("rows")))


@query(f"WITH {BLOCKS}, {BOXES} SELECT document_id, page, list_sort(list(y1 - y0))[len(list(y1 - y0)) // 2 + 1] AS height FROM boxes GROUP BY document_id, page")
def agg_median(spark, d):
    return boxes(spark, d).groupBy("document_id", "page").agg(A.upper_median(F.col("y1") - F.col("y0")).alias("height"))


@query(f"WITH {BLOCKS} SELECT document_id, block_order, count(*) OVER (PARTITION BY document_id, page) AS on_page FROM blocks")
def agg_page_count(spark, d):
    return blocks(spark, d).select("document_id", "block_order", F.count("*").over(Window.partitionBy("document_id", "page")).alias("on_page"))


@query(f"WITH {BLOCKS}, p AS (SELECT document_id, page, sum(length(text)) > 400 AS digital FROM blocks GROUP BY ALL) SELECT document_id, CASE WHEN bool_and(digital) THEN 'digital' WHEN bool_and(NOT digital) THEN 'scanned' ELSE 'mixed' END AS kind FROM p GROUP BY document_id")
def agg_pdf_kind(spark, d):
    p = blocks(spark, d).groupBy("document_id", "page").agg((F.sum(F.length("text")) > 400).alias("digital"))
    return p.groupBy("document_id").agg(F.when(F.bool_and("digital"), "digital").when(F.bool_and(~F.col("digital")), "scanned").otherwise("mixed").alias("kind"))


@query(f"WITH {BLOCKS}, p AS (SELECT document_id, page, CAST(sum(length(text)) AS BIGINT) AS n FROM blocks GROUP BY ALL) SELECT document_id, count(*) AS pages, count(*) FILTER (WHERE n > 400) AS digital, min(n) AS shortest, max(n) AS longest FROM p GROUP BY document_id")
def agg_pdf_health(spark, d):
    p = blocks(spark, d).groupBy("document_id", "page").agg(F.sum(F.length("text")).alias("n"))
    return p.groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if(F.col("n") > 400).alias("digital"), F.min("n").alias("shortest"), F.max("n").alias("longest"))


@query("SELECT source, count(*) AS images, count(DISTINCT md5(text)) AS distinct_images FROM documents GROUP BY source")
def agg_image_dup(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("images"), F.count_distinct(F.md5(F.col("text").cast("binary"))).alias("distinct_images"))


@query(f"WITH {BLOCKS} SELECT document_id, page, string_agg(text, ' | ' ORDER BY block_order) AS merged FROM blocks WHERE type = 'heading' GROUP BY document_id, page HAVING count(*) >= 3")
def agg_icon_merge(spark, d):
    small = blocks(spark, d).where("type = 'heading'").groupBy("document_id", "page").agg(F.count("*").alias("n"), F.expr("listagg(text, ' | ') within group (order by block_order)").alias("merged"))
    return small.where("n >= 3").drop("n")


@query(
    """WITH p AS (SELECT a.item_id, lower(a.text) AS x, lower(b.text) AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
    a AS (SELECT item_id, w, count(*) AS a FROM (SELECT item_id, unnest(regexp_split_to_array(x, '\\s+')) AS w FROM p) WHERE w <> '' GROUP BY ALL),
    b AS (SELECT item_id, w, count(*) AS b FROM (SELECT item_id, unnest(regexp_split_to_array(y, '\\s+')) AS w FROM p) WHERE w <> '' GROUP BY ALL),
    s AS (SELECT item_id, sum(least(coalesce(a, 0), coalesce(b, 0))) AS hit, sum(coalesce(a, 0)) AS n_a, sum(coalesce(b, 0)) AS n_b FROM a FULL JOIN b USING (item_id, w) GROUP BY item_id)
    SELECT item_id, round(hit / n_a, 3)::DOUBLE AS precision, round(hit / n_b, 3)::DOUBLE AS recall, round(2 * hit / (n_a + n_b), 3)::DOUBLE AS f1 FROM s"""
)
def agg_word_f1(spark, d):
    b = table(spark, d, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("truth"))
    return A.word_f1(b.join(other, "item_id"), "item_id", "text", "truth")


@query("SELECT user_id, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS block_rate, avg(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0 END) AS redact_rate FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 50 GROUP BY user_id")
def agg_guard_rates(spark, d):
    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, d, "events").withColumn("rank", F.row_number().over(last)).where("rank <= 50")
    return e.groupBy("user_id").agg(F.avg((F.col("event_type") == "error").cast("double")).alias("block_rate"), F.avg((F.col("event_type") == "click").cast("double")).alias("redact_rate"))


_EVIDENCE = """ev AS (SELECT event_id // 4 AS request, CASE event_type WHEN 'view' THEN 'input' WHEN 'click' THEN 'retrieval' ELSE 'output' END AS stage, CAST(floor(value) AS BIGINT) % 60 AS risk_score, event_type = 'error' AND event_id % 7 = 0 AS hard_block FROM events)"""


def evidence(spark, d):
    t = F.col("event_type")
    stage = F.when(t == "view", "input").when(t == "click", "retrieval").otherwise("output")
    hard = (t == "error") & (F.col("event_id") % 7 == 0)
    return table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 4).alias("request"), stage.alias("stage"), (F.floor("value") % 60).alias("risk_score"), hard.alias("hard_block"))


@query(
    f"""WITH {_EVIDENCE}, s AS (SELECT request, bool_or(hard_block) AS hard, round(least(100.0, sum(risk_score * CASE stage WHEN 'input' THEN 1.0 WHEN 'retrieval' THEN 1.2 ELSE 1.5 END::DOUBLE)), 6) AS score FROM ev GROUP BY request)
    SELECT request, score, CASE WHEN hard OR score >= 80 THEN 'block' WHEN score >= 40 THEN 'warn' ELSE 'allow' END AS verdict FROM s"""
)
def agg_policy_sum(spark, d):
    return A.policy(evidence(spark, d), "request")


@query("SELECT user_id, ts::DATE::VARCHAR AS day, CAST(least(100, sum(CASE event_type WHEN 'error' THEN 30 WHEN 'click' THEN 20 WHEN 'purchase' THEN 25 ELSE 0 END)) AS BIGINT) AS score FROM events GROUP BY ALL")
def agg_rule_score(spark, d):
    points = F.create_map(*(F.lit(x) for x in ("error", 30, "click", 20, "purchase", 25)))
    e = table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.agg(F.least(F.lit(100), F.sum(F.coalesce(points[F.col("event_type")], F.lit(0)))).cast("long").alias("score"))


@query(f"WITH {BLOCKS} SELECT document_id, page, count(*) AS blocks, count(*) FILTER (WHERE type = 'table') AS tables, count(*) FILTER (WHERE type = 'heading') AS headings, CASE WHEN sum(length(text)) > 400 THEN 'digital' ELSE 'vlm' END AS route FROM blocks GROUP BY document_id, page")
def agg_extraction_report(spark, d):
    g = blocks(spark, d).groupBy("document_id", "page")
    return g.agg(F.count("*").alias("blocks"), F.count_if(F.col("type") == "table").alias("tables"), F.count_if(F.col("type") == "heading").alias("headings"), F.when(F.sum(F.length("text")) > 400, "digital").otherwise("vlm").alias("route"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def agg_distinct_scope(spark, d):
    return table(spark, d, "events").select("user_id", "event_type").dropDuplicates()


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def agg_rollup(spark, d):
    nation = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def agg_grouping_sets(spark, d):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, d, "lineitem").groupingSets([[flag], [status], []], flag, status).agg(F.sum("l_quantity").cast("long").alias("qty"))
