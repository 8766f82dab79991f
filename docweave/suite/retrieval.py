"""Search and answers over the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import retrieval as R
from ..registry import query, table
from ..sources.fixtures import BLOCKS, blocks

_DENSE = """q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT query_id, vec_id AS id, round(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), lambda p: p[1] * p[2])), 9) AS score FROM q, embeddings e),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM d) WHERE rank <= 20)"""


def _dense(spark, d, k=20):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.dense_top(e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), e, k)


@query(f"WITH {_DENSE} SELECT query_id, id, rank FROM dense")
def topk_dense(spark, d):
    return _dense(spark, d).select("query_id", "id", "rank")


@query(f"WITH {_DENSE} SELECT query_id, id FROM dense WHERE rank <= 5")
def rt_naive(spark, d):
    return _dense(spark, d, 5).select("query_id", "id")


_BM25 = """w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), '\\s+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT id, n, term, count(*) AS tf FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM w) GROUP BY ALL),
st AS (SELECT count(*) AS total, avg(n) AS mean FROM (SELECT DISTINCT id, n FROM p)),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), '\\s+'), lambda x: x <> '')) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query_id, id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM p JOIN qt USING (term) JOIN df USING (term), st GROUP BY query_id, id),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 20)"""


def _sparse(spark, d, k=20):
    asked = R.postings(table(spark, d, "benchmark"), "item_id", "text").select(F.col("id").alias("query_id"), "term")
    return R.search(asked, table(spark, d, "documents"), "doc_id", "text", k)


@query(f"WITH {_BM25} SELECT query_id, id, score, rank FROM sparse")
def topk_sparse(spark, d):
    return _sparse(spark, d)


@query()
def em_sparse_weights(spark, d):
    index = R.postings(table(spark, d, "documents"), "doc_id", "text")
    return R.bm25_weights(R.postings(table(spark, d, "benchmark"), "item_id", "text"), index)


_FUSED = """x AS (SELECT query_id % 40 AS query_id, id, min(rank) AS rx FROM dense GROUP BY ALL), f AS (SELECT query_id, id, round(0.6 * coalesce(1.0::DOUBLE / (20 + rx), 0) + 0.4 * coalesce(1.0::DOUBLE / (20 + sparse.rank), 0), 9) AS score FROM x FULL JOIN sparse USING (query_id, id)),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10)"""


@query(f"WITH {_DENSE}, {_BM25}, {_FUSED} SELECT query_id, id, score, rank FROM fused")
def rt_hybrid(spark, d):
    dense = _dense(spark, d).groupBy((F.col("query_id") % 40).alias("query_id"), "id").agg(F.min("rank").alias("rank"))
    return R.hybrid(dense, _sparse(spark, d), 10, 20)


@query(f"WITH {_BM25}, h AS (SELECT query_id, id, rank, b.text AS query, t.text FROM sparse JOIN benchmark b ON query_id = item_id JOIN documents t ON id = doc_id), o AS (SELECT query_id, id, rank, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> '')) AS q, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM h), r AS (SELECT query_id, id, rank, round(len(list_intersect(q, t)) / len(q), 6) AS rerank_score FROM o) SELECT query_id, id, rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, id) AS final FROM r) WHERE final <= 5")
def rt_rerank(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = _sparse(spark, d).join(R.small(asked), "query_id").join(docs, "id")
    return R.rerank(hits, 5).select("query_id", "id", "rerank_score")


@query(f"WITH {BLOCKS} SELECT document_id, block_order, NOT (document_id % 2 = 0) OR type = 'table' OR length(text) // 4 < 120 AS thin FROM blocks")
def flt_thin_chunk(spark, d):
    b = blocks(spark, d).withColumns({"tokens": F.floor(F.length("text") / 4), "summary": F.when(F.col("document_id") % 2 == 0, "s"), "kind": F.when(F.col("type") == "table", "table")})
    return b.select("document_id", "block_order", R.is_thin("tokens", "summary", "kind").alias("thin"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 4 = 1")
def flt_rbac(spark, d):
    roles = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 4 == 1, F.array(F.lit("Admin"))).otherwise(F.array(F.lit("guest")))
    return table(spark, d, "documents").withColumn("roles", roles).where(R.allowed("roles", ["admin"])).select("doc_id")


@query("SELECT user_id, event_id FROM (SELECT *, max(CASE WHEN value > 95 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS hits FROM events) WHERE value > 95 OR hits = 0")
def flt_hard_soft(spark, d):
    return R.filtered_or_all(table(spark, d, "events"), "user_id", F.col("value") > 95).select("user_id", "event_id")


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND user_id = 3")
def flt_payload(spark, d):
    from functools import reduce

    wanted = {"event_type": ["view", "click"], "user_id": 3, "props": None}
    tests = [F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v for c, v in wanted.items() if v is not None]
    return table(spark, d, "events").where(reduce(lambda a, b: a & b, tests)).select("event_id")


@query("SELECT doc_id, count(*) OVER () AS total FROM documents WHERE lang = 'en' AND lower(trim(source)) = 'src3'")
def flt_doc_list(spark, d):
    docs = table(spark, d, "documents").where((F.col("lang") == "en") & (F.lower(F.trim("source")) == "src3"))
    total = docs.agg(F.count("*").alias("total"))
    return docs.select("doc_id").crossJoin(F.broadcast(total))


@query(f"WITH {BLOCKS} SELECT document_id, block_order, text FROM blocks WHERE page = 2")
def flt_page(spark, d):
    return blocks(spark, d).where("page = 2").select("document_id", "block_order", "text")


@query("SELECT c_custkey, CASE WHEN c_name = 'Customer#000000007' THEN 1 WHEN lower(c_name) = lower('customer#000000007') THEN 2 ELSE 3 END AS priority FROM customer WHERE lower(c_name) = lower('customer#000000007') OR c_name LIKE '%0007'")
def flt_doc_lookup(spark, d):
    wanted = "Customer#000000007"
    n = F.col("c_name")
    hit = (F.lower(n) == wanted.lower()) | F.endswith(n, F.lit("0007"))
    return table(spark, d, "customer").where(hit).select("c_custkey", F.when(n == wanted, 1).when(F.lower(n) == wanted.lower(), 2).otherwise(3).alias("priority"))


@query(f"WITH {BLOCKS} SELECT document_id, page, 'doc ' || document_id || ', p.' || page AS locator FROM (SELECT DISTINCT document_id, page FROM blocks)")
def prj_locator(spark, d):
    p = blocks(spark, d).select("document_id", "page").dropDuplicates()
    return p.select("document_id", "page", F.concat(F.lit("doc "), F.col("document_id").cast("string"), F.lit(", p."), F.col("page").cast("string")).alias("locator"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '1,2,3,5' WHEN 1 THEN '2' ELSE '' END AS cited FROM documents")
def fn_cited(spark, d):
    a = F.when(F.col("doc_id") % 3 == 0, "see [1-3] and [5, p.7]").when(F.col("doc_id") % 3 == 1, "see [2, page 4]").otherwise("no source")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(R.cited_indexes(a), lambda x: x.cast("string")), ",").alias("cited"))


@query(f"WITH {BLOCKS}, thin AS (SELECT DISTINCT document_id, page FROM blocks WHERE length(text) < 80), capped AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY document_id ORDER BY page) AS r FROM thin) WHERE r <= 5) SELECT document_id, page, string_agg(text, chr(10) || chr(10) ORDER BY block_order) AS page_text FROM blocks JOIN capped USING (document_id, page) GROUP BY document_id, page")
def rt_thin_expand(spark, d):
    b = blocks(spark, d)
    thin = b.where(F.length("text") < 80).select("document_id", "page").dropDuplicates()
    capped = thin.withColumn("r", F.dense_rank().over(Window.partitionBy("document_id").orderBy("page"))).where("r <= 5")
    return J.expand_pages(capped, b)


@query("SELECT item_id, CAST(len(list_intersect(list_distinct(string_split(lower(text), ' ')), ['the', 'of', 'and'])) AS DOUBLE) / len(list_distinct(string_split(lower(text), ' '))) AS share FROM benchmark")
def fn_containment(spark, d):
    w = F.array_distinct(F.split(F.lower("text"), " "))
    return table(spark, d, "benchmark").select("item_id", (F.size(F.array_intersect(w, F.array(*map(F.lit, ("the", "of", "and"))))) / F.size(w)).alias("share"))


