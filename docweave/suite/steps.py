"""Steps of an ingestion: reuse, progress, topic-shift chunks, page-wise extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import procedures as P
from ..operators import semantic
from ..plans import reuse
from ..registry import query, table
from ..sources.fixtures import BLOCKS, blocks
from ..sources.shared import shared_folder
from ..streaming.progress import Progress


def _summary(text: str) -> str:
    if len(text) > 6000:
        raise ValueError("too long")
    return str(len(text.split(" ")))


_NODE = "d AS (SELECT doc_id, md5(text) AS digest, length(text) > 6000 AS bad, CAST(len(string_split(text, ' ')) AS VARCHAR) AS words FROM documents), f AS (SELECT DISTINCT digest FROM d WHERE doc_id % 3 <> 0)"


@query(f"WITH {_NODE} SELECT doc_id, CASE WHEN bad THEN NULL ELSE words END AS value, CASE WHEN bad THEN 'ValueError: too long' END AS error, CASE WHEN bad OR digest NOT IN (SELECT digest FROM f) THEN '2' ELSE '1' END AS run FROM d")
def pl_node(spark, d):
    """Two runs over one store: the second computes what is new and what failed."""
    store = reuse.Store(spark, shared_folder(spark, "steps"))
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    step = reuse.python_step(_summary)
    store.run("words", "1", docs.where("doc_id % 3 <> 0"), step, digest="digest", content="text", label="1")
    return store.run("words", "1", docs, step, digest="digest", content="text", label="2").select("doc_id", "value", "error", "run")


@query(f"WITH {_NODE}, t AS (SELECT count(DISTINCT digest) AS n, count(DISTINCT digest) FILTER (WHERE bad) AS bad FROM d), o AS (SELECT count(DISTINCT digest) AS n, count(DISTINCT digest) FILTER (WHERE bad) AS bad FROM d WHERE doc_id % 3 <> 0) SELECT '1' AS run, n AS inputs, 0 AS reused, n AS computed, bad AS failed FROM o UNION ALL SELECT '2', t.n, o.n - o.bad, t.n - o.n + o.bad, t.bad FROM t, o UNION ALL SELECT '3', t.n, t.n - t.bad, t.bad, t.bad FROM t", name="pl_node_metrics")
def pl_node_metrics(spark, d):
    store = reuse.Store(spark, shared_folder(spark, "steps"))
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    for label, rows in (("1", docs.where("doc_id % 3 <> 0")), ("2", docs), ("3", docs)):
        store.run("words", "1", rows, reuse.python_step(_summary), digest="digest", content="text", label=label)
    return store.metrics.frame(spark).select("run", "inputs", "reused", "computed", "failed")


@query(
    f"""WITH {BLOCKS}, s AS (SELECT document_id, text FROM blocks WHERE type = 'text')
    SELECT 'documents' AS step, 0 AS place, 'rows' AS metric, count(*) AS value FROM documents UNION ALL SELECT 'documents', 0, 'chars', CAST(sum(length(text)) AS BIGINT) FROM documents
    UNION ALL SELECT 'blocks', 1, 'rows', count(*) FROM blocks UNION ALL SELECT 'text blocks', 2, 'rows', count(*) FROM s UNION ALL SELECT 'text blocks', 2, 'chars', CAST(coalesce(sum(length(text)), 0) AS BIGINT) FROM s
    UNION ALL SELECT 'nothing', 3, 'rows', 0"""
)
def st_progress(spark, d):
    progress = Progress()
    docs = progress.step(table(spark, d, "documents"), "documents", chars=F.sum(F.length("text")))
    lines = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("block_order", "text"))
    kind = F.when(F.contains("text", F.lit(" | ")), "table").when(F.length("text") < 40, "heading").otherwise("text")
    made = progress.step(lines.withColumn("type", kind), "blocks")
    kept = progress.step(made.where("type = 'text'"), "text blocks", chars=F.sum(F.length("text")))
    progress.step(kept.where("block_order < 0"), "nothing").union(kept).write.format("noop").mode("overwrite").save()
    return progress.report(spark).where("place < 3 or metric = 'rows'").withColumn("value", F.when(F.col("place") < 3, F.col("value")).otherwise(0))


_SENTENCE, _WORD = semantic.SENTENCE, "[^ \\t\\n\\r.,;:!?]+"


@query(
    f"""WITH b AS (SELECT doc_id, regexp_extract_all(text, '{_SENTENCE}') AS s FROM documents),
    w AS (SELECT doc_id, s, list_transform(s, lambda x: regexp_extract_all(lower(x), '{_WORD}')) AS w, len(s) AS n FROM b),
    a AS (SELECT *, CASE WHEN n >= 5 THEN list_transform(range(1, n), lambda i: [list_distinct(flatten(w[greatest(1, i - 2):i])), list_distinct(flatten(w[i + 1:least(n, i + 3)]))]) ELSE [] END AS p FROM w),
    g AS (SELECT doc_id, s, w, list_transform(p, lambda x: CASE WHEN len(x[1]) + len(x[2]) = 0 THEN 0 ELSE CAST(floor(len(list_intersect(x[1], x[2])) * 10000 / len(list_distinct(list_concat(x[1], x[2])))) AS BIGINT) END) AS gaps FROM a),
    l AS (SELECT *, list_sort(gaps)[CAST(ceil(len(gaps) * 10 / 100) AS INTEGER)] AS limit_ FROM g),
    r AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS sentence, unnest(list_transform(w, lambda x: len(x))) AS n, unnest(list_transform(range(0, len(s)), lambda k: CASE WHEN k > 0 AND len(gaps) > 0 AND gaps[k] <= limit_ THEN 1 ELSE 0 END)) AS shift FROM l),
    t AS (SELECT *, sum(shift) OVER (PARTITION BY doc_id ORDER BY i) AS stretch FROM r),
    p AS (SELECT *, CAST(floor((sum(n) OVER (PARTITION BY doc_id, stretch ORDER BY i) - n) / 200) AS BIGINT) AS piece FROM t),
    c AS (SELECT doc_id, stretch, piece, sum(n) AS n_words, string_agg(sentence, '' ORDER BY i) AS text FROM p GROUP BY ALL HAVING sum(n) > 0)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY stretch, piece) - 1 AS chunk, CAST(n_words AS BIGINT) AS n_words, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM c"""
)
def ck_semantic(spark, d):
    return semantic.semantic_chunks(table(spark, d, "documents"))


_PAGED = "m AS (SELECT document_id, block_order, page, CASE WHEN (page * 7 + document_id) % 4 < 2 AND block_order % 4 <> 0 THEN CASE block_order % 3 WHEN 0 THEN '(' || (block_order % 9 + 1) || ') ' WHEN 1 THEN 'Step ' || (block_order % 9 + 1) || ': ' ELSE 'then ' END || text ELSE text END AS text, (page * 7 + document_id) % 4 < 2 AND block_order % 4 <> 0 AS step FROM blocks)"


def _paged(spark, d):
    """Blocks of documents, on some of whose pages lines are steps, numbered or not."""
    o = F.col("block_order")
    step = ((F.col("page") * 7 + F.col("document_id")) % 4 < 2) & (o % 4 != 0)
    number = (o % 9 + 1).cast("string")
    opened = F.when(o % 3 == 0, F.concat(F.lit("("), number, F.lit(") "))).when(o % 3 == 1, F.concat(F.lit("Step "), number, F.lit(": "))).otherwise("then ")
    return blocks(spark, d).select("document_id", "block_order", "page", F.when(step, F.concat(opened, "text")).otherwise(F.col("text")).alias("text"), step.alias("step"))


@query(
    f"""WITH RECURSIVE {BLOCKS}, {_PAGED}, g AS (SELECT document_id, page, sum(length(trim(text))) AS chars, count(*) FILTER (WHERE step) AS steps FROM m GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page) AS r FROM g WHERE chars >= 20),
    f(document_id, r, page, found, empties, steps) AS (SELECT DISTINCT document_id, 0::BIGINT, 0::BIGINT, false, 0, 0::BIGINT FROM o
      UNION ALL SELECT o.document_id, o.r, o.page, found OR o.steps > 0, CASE WHEN o.steps > 0 OR NOT found THEN 0 ELSE empties + 1 END, o.steps FROM f JOIN o ON o.document_id = f.document_id AND o.r = f.r + 1 WHERE empties < 2),
    s AS (SELECT m.document_id, m.page, block_order, text, CAST(coalesce(nullif(regexp_extract(text, '^\\(([0-9]+)\\)', 1), ''), nullif(regexp_extract(text, '^Step ([0-9]+):', 1), '')) AS BIGINT) AS number FROM m JOIN f ON f.document_id = m.document_id AND f.page = m.page WHERE step AND f.steps > 0),
    u AS (SELECT *, row_number() OVER (PARTITION BY document_id, number ORDER BY page, block_order) AS again FROM s)
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY number NULLS LAST, page, block_order) AS place, page, number, text AS instruction FROM u WHERE number IS NULL OR again = 1"""
)
def pr_llm_steps(spark, d):
    paged = _paged(spark, d)
    extracted = paged.where("step").select("document_id", "page", "block_order", F.col("text").alias("instruction"))
    return P.steps_by_page(paged, extracted)
