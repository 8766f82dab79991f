"""Procedures, pipeline plans and tool histories over the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import enrichment as E
from ..operators import procedures as P
from ..operators.intervals import counts_within
from ..plans import pipeline as L
from ..registry import query, table
from ..sources.fixtures import BLOCKS, blocks

_MANUAL = "m AS (SELECT document_id, block_order, page, CASE WHEN block_order % 5 = 0 THEN (document_id % 7) || '.' || (block_order // 5 + 1) || ' Title of part ' || page ELSE (block_order % 5) || ') Remove part ' || block_order END AS text FROM blocks)"


def manual(spark, d):
    o = F.col("block_order")
    s = lambda c: c.cast("string")
    head = F.concat(s(F.col("document_id") % 7), F.lit("."), s(F.floor(o / 5) + 1), F.lit(" Title of part "), s(F.col("page")))
    return blocks(spark, d).select("document_id", "block_order", "page", F.when(o % 5 == 0, head).otherwise(F.concat(s(o % 5), F.lit(") Remove part "), s(o))).alias("text"))


@query(f"WITH {BLOCKS}, {_MANUAL} SELECT document_id, (document_id % 7) || '.' || (block_order // 5 + 1) AS number, text AS title, page, greatest(page, coalesce(lead(page) OVER (PARTITION BY document_id ORDER BY block_order) - 1, page + 10)) AS page_end FROM m WHERE block_order % 5 = 0")
def pr_scan_sections(spark, d):
    return P.sections(manual(spark, d)).select("document_id", "number", "title", "page", "page_end")


@query(f"WITH {BLOCKS}, {_MANUAL}, s AS (SELECT document_id, block_order, page, greatest(page, coalesce(lead(page) OVER (PARTITION BY document_id ORDER BY block_order) - 1, page + 10)) AS page_end FROM m WHERE block_order % 5 = 0) SELECT s.document_id, s.block_order AS section, count(m.block_order) AS steps FROM s LEFT JOIN m ON m.document_id = s.document_id AND m.block_order % 5 <> 0 AND m.page BETWEEN s.page AND s.page_end GROUP BY ALL")
def pr_fast_sections(spark, d):
    m = manual(spark, d)
    s = P.sections(m).select("document_id", F.col("block_order").alias("section"), F.col("page").alias("lo"), "page_end")
    st = P.steps(m).select("document_id", "page")
    counted = counts_within(st, s, "document_id", "page", "lo", "page_end", "steps")
    return counted.select("document_id", "section", "steps")


@query(f"WITH {BLOCKS}, {_MANUAL} SELECT document_id, block_order, CAST(block_order % 5 AS BIGINT) AS step, 'Remove part ' || block_order AS instruction FROM m WHERE block_order % 5 <> 0")
def pr_numbered(spark, d):
    return P.steps(manual(spark, d)).select("document_id", "block_order", "step", "instruction")


@query(f"WITH {BLOCKS}, {_MANUAL} SELECT document_id, block_order, max(CASE WHEN block_order % 5 = 0 THEN text END) OVER (PARTITION BY document_id, block_order // 5) AS section FROM m")
def pr_sections_steps(spark, d):
    m = manual(spark, d)
    past = Window.partitionBy("document_id").orderBy("block_order").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("document_id", "block_order", F.last(F.when(F.regexp_extract("text", P.SECTION, 1) != "", F.col("text")), ignorenulls=True).over(past).alias("section"))


@query(f"WITH {BLOCKS}, {_MANUAL} SELECT document_id, min(block_order) AS block_order FROM m WHERE block_order % 5 <> 0 GROUP BY document_id, left(lower(text), 60)")
def pr_collect(spark, d):
    return P.imperative_steps(manual(spark, d))


@query(f"WITH {BLOCKS}, {_MANUAL} SELECT document_id, min(page) AS first_page, max(page) AS last_page FROM m WHERE block_order % 5 = 1 GROUP BY document_id")
def pr_boundaries(spark, d):
    return P.boundaries(manual(spark, d), F.col("text").rlike("^1\\)"))


@query(f"WITH {BLOCKS}, {_MANUAL} SELECT document_id, block_order, block_order // 5 + 1 AS group_no FROM m WHERE block_order % 5 <> 0")
def pr_group(spark, d):
    return P.grouped(P.steps(manual(spark, d))).select("document_id", "block_order", "group_no")


@query(f"WITH {BLOCKS}, {_MANUAL} SELECT document_id, page, min(block_order) AS next_step FROM m WHERE block_order % 5 > 1 GROUP BY document_id, page")
def pr_next_step(spark, d):
    return P.steps(manual(spark, d)).where("step > 1").groupBy("document_id", "page").agg(F.min("block_order").alias("next_step"))


@query(f"WITH {BLOCKS}, {_MANUAL} SELECT document_id, block_order AS step_order, page FROM m WHERE block_order % 5 = 2")
def pr_step_page(spark, d):
    m = manual(spark, d)
    wanted = P.steps(m).where("step = 2").select("document_id", F.col("block_order").alias("step_order"), F.concat(F.lit("2) "), "instruction").alias("snippet"))
    pages = m.select("document_id", "page", F.col("text").alias("snippet"))
    return wanted.join(pages, ["document_id", "snippet"]).groupBy("document_id", "step_order").agg(F.min("page").alias("page"))


_SEL = """c AS (SELECT a.item_id AS q, b.item_id AS section, list_distinct(string_split(lower(a.text), ' ')) AS qw, list_distinct(string_split(lower(b.text), ' '))[1:0] AS none, string_split(lower(b.text), ' ') AS bw FROM benchmark a JOIN benchmark b ON a.item_id // 4 = b.item_id // 4),
s AS (SELECT q, section, CAST(3 * len(list_intersect(qw, list_distinct(bw[1:5]))) + len(list_intersect(qw, list_distinct(bw))) AS BIGINT) AS score FROM c)"""


@query(f"WITH {_SEL}, w AS (SELECT *, max(score) OVER (PARTITION BY q) AS best, count(*) FILTER (WHERE score > 0) OVER (PARTITION BY q) * 2 >= count(*) OVER (PARTITION BY q) AS half FROM s) SELECT q, section, score FROM w WHERE half OR (score > 0 AND score >= 0.3 * best)")
def pr_select(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("w"))
    q = b.select(F.floor(F.col("item_id") / 4).alias("g"), F.col("item_id").alias("q"), F.array_distinct("w").alias("query_words"))
    s = b.select(F.floor(F.col("item_id") / 4).alias("g"), F.col("item_id").alias("section"), F.slice("w", 1, 5).alias("title_words"), F.col("w").alias("body_words"))
    return P.selection(q.join(s, "g"), "q").select("q", "section", "score")


@query("WITH i AS (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark), n AS (SELECT DISTINCT page_id, unnest(string_split(lower(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), ' ')) AS w FROM pages), h AS (SELECT item_id, page_id, count(*) AS common FROM i JOIN n USING (w) GROUP BY ALL) SELECT item_id, page_id, common FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY common DESC, page_id) AS r FROM h) WHERE r = 1")
def pr_related_drawing(spark, d):
    i = table(spark, d, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("w"))
    # pages stand for drawings, their headings for the titles
    n = table(spark, d, "pages").select("page_id", F.split(F.lower(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1)), " ").alias("nw"))
    return P.best_name(i, n, "item_id", "w", "page_id", "nw")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    f(user_id, r, state, moves) AS (SELECT DISTINCT user_id, 0::BIGINT, 'idle', 0::BIGINT FROM e
      UNION ALL SELECT user_id, r, t, moves + CASE WHEN t <> state THEN 1 ELSE 0 END FROM (SELECT f.user_id, e.r, f.state, f.moves,
        CASE WHEN (state, event_type) IN (('idle', 'view'), ('done', 'view')) THEN 'offer' WHEN (state, event_type) IN (('offer', 'click'), ('overview', 'click'), ('active', 'click'), ('paused', 'click')) THEN 'active'
          WHEN (state, event_type) = ('offer', 'signup') THEN 'overview' WHEN (state, event_type) = ('active', 'error') THEN 'paused' WHEN (state, event_type) = ('active', 'purchase') THEN 'done' ELSE state END AS t
        FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)),
    l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC) AS k FROM f) SELECT user_id, state, moves FROM l WHERE k = 1"""
)
def pr_state(spark, d):
    return P.run_states(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS done, count(*) AS total, CAST(least(count(*) FILTER (WHERE event_type = 'click')::DOUBLE / count(*), 0.99) AS DOUBLE) AS progress FROM events GROUP BY user_id")
def pr_progress(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("done"), F.count("*").alias("total"))
    return g.withColumn("progress", F.least(F.col("done") / F.col("total"), F.lit(0.99)))


@query("SELECT user_id, CAST(least(count(*) / 100.0::DOUBLE, 0.99) AS DOUBLE) AS progress FROM events GROUP BY user_id")
def prj_progress(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.least(F.count("*") / 100.0, F.lit(0.99)).alias("progress"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant')) WHERE r <= 6")
def ag_history(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, d, "conversations").where("role in ('user', 'assistant')").withColumn("r", F.row_number().over(w)).where("r <= 6").select("conv_id", "turn", "role")


@query("SELECT conv_id, turn FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE NOT coalesce(role = 'user' AND r = role AND t = text, false)")
def ag_dedup_turn(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumns({"r": F.lag("role").over(w), "t": F.lag("text").over(w)})
    same = F.coalesce((F.col("role") == "user") & (F.col("r") == F.col("role")) & (F.col("t") == F.col("text")), F.lit(False))
    return c.where(~same).select("conv_id", "turn")


@query("SELECT doc_id, CASE WHEN length(text) < 200 THEN 'short' WHEN lang = 'en' THEN 'english' ELSE 'other' END AS route, CASE WHEN length(text) < 200 THEN length(text) ELSE length(text) // 4 END AS n FROM documents")
def pl_graph(spark, d):
    docs = table(spark, d, "documents").withColumn("route", F.when(F.length("text") < 200, "short").when(F.col("lang") == "en", "english").otherwise("other"))
    plan = L.Plan(
        [
            L.Step("size", lambda df: df.withColumn("n", F.length("text").cast("long"))),
            L.Step("shrink", lambda df: df.withColumn("n", F.floor(F.col("n") / 4)), routes=("english", "other")),
        ]
    )
    return plan.run(docs).select("doc_id", "route", "n")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'digital' WHEN lang = 'de' THEN 'scanned' ELSE 'text_default' END AS extractor FROM documents")
def pl_dispatch(spark, d):
    docs = table(spark, d, "documents")
    out = L.dispatch(docs, F.when(F.col("lang") == "en", "a").when(F.col("lang") == "de", "b"), {"a": lambda x: x.withColumn("extractor", F.lit("digital")), "b": lambda x: x.withColumn("extractor", F.lit("scanned"))}, lambda x: x.withColumn("extractor", F.lit("text_default")))
    return out.select("doc_id", "extractor")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'deleted' WHEN length(text) = 0 THEN 'empty' WHEN lang = 'de' THEN 'failed' ELSE 'ready' END AS status FROM documents")
def pl_status(spark, d):
    return table(spark, d, "documents").select("doc_id", L.status(F.col("doc_id") % 10 == 0, F.lit(False), F.col("lang") == "de", F.length("text")).alias("status"))


@query(f"WITH {BLOCKS}, p AS (SELECT document_id, page, sum(length(text)) AS n FROM blocks GROUP BY ALL), r AS (SELECT *, CASE WHEN n < 20 THEN 'blank' WHEN n > 400 THEN 'digital' ELSE 'vlm' END AS route FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY document_id, route ORDER BY page) AS r FROM r) SELECT document_id, page, CASE WHEN route = 'vlm' AND r > 2 THEN 'local' ELSE route END AS route FROM k")
def pl_rescue(spark, d):
    p = blocks(spark, d).groupBy("document_id", "page").agg(F.sum(F.length("text")).alias("n"))
    r = p.withColumn("route", F.when(F.col("n") < 20, "blank").when(F.col("n") > 400, "digital").otherwise("vlm"))
    return L.within_budget(r, ["document_id"], "page", "vlm", 2, "local").select("document_id", "page", "route")


_TAGS = f"""{BLOCKS}, c AS (SELECT document_id, block_order, text, type, max(CASE WHEN type = 'heading' THEN block_order END) OVER (PARTITION BY document_id ORDER BY block_order ROWS UNBOUNDED PRECEDING) AS h FROM blocks),
  k AS (SELECT c.document_id, c.block_order, c.text, s.text AS section, CASE WHEN c.block_order % 3 = 0 THEN 'manual' END AS doc_type, source FROM c LEFT JOIN blocks s ON s.document_id = c.document_id AND s.block_order = h JOIN documents ON doc_id = c.document_id WHERE c.type = 'text'),
  w AS (SELECT document_id, block_order, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS word, unnest(range(0, len(regexp_extract_all(lower(text), '[a-z]{{4,}}')))) AS place FROM k),
  n AS (SELECT document_id, block_order, word, count(*) AS n, min(place) AS first FROM w WHERE word NOT IN ('that', 'with') GROUP BY ALL),
  t AS (SELECT document_id, block_order, string_agg(word, ',' ORDER BY n DESC, first) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY document_id, block_order ORDER BY n DESC, first) AS r FROM n) WHERE r <= 5 GROUP BY ALL),
  e AS (SELECT document_id, block_order, coalesce(source, 'unknown') AS industry, coalesce(doc_type, CASE WHEN regexp_matches(lower(text), '\\b(step|install|press)\\b') THEN 'procedure' ELSE 'reference' END) AS doc_type, section, keywords,
    CASE WHEN length(trim(text)) < 80 THEN NULL ELSE nullif(trim(regexp_extract(text, '^[^.!?]*[.!?]')), '') END AS summary, length(trim(text)) < 80 AS short FROM k LEFT JOIN t USING (document_id, block_order))"""


def _tagged(spark, d):
    """Text blocks as chunks with some tags of their own, enriched by rules."""
    b = blocks(spark, d)
    past = Window.partitionBy("document_id").orderBy("block_order").rowsBetween(Window.unboundedPreceding, 0)
    named = b.withColumn("section", F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True).over(past)).where("type = 'text'")
    chunks = named.join(table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("industry")), "document_id")
    kind = F.when(F.col("text").rlike("(?i)\\b(step|install|press)\\b"), "procedure").otherwise("reference")
    return E.tags(chunks.withColumn("doc_type", F.when(F.col("block_order") % 3 == 0, "manual")), ["document_id", "block_order"], "text", defaults={"industry": F.lit("unknown"), "doc_type": kind, "section": F.lit(None).cast("string")}, stop=("that", "with"))


@query(f"WITH {_TAGS} SELECT document_id, block_order, industry, doc_type, section, keywords, summary, CASE WHEN short THEN 'short' WHEN summary IS NULL THEN 'failed' ELSE 'done' END AS outcome FROM e")
def en_tags(spark, d):
    return _tagged(spark, d).select("document_id", "block_order", "industry", "doc_type", "section", F.array_join("keywords", ",").alias("keywords"), "summary", "outcome")


@query(f"WITH {_TAGS} SELECT document_id, count(*) AS chunks, count(*) FILTER (WHERE short) AS short, count(*) FILTER (WHERE NOT short AND summary IS NULL) AS failed FROM e GROUP BY document_id", name="en_tags_counts")
def en_tags_counts(spark, d):
    return E.outcomes(_tagged(spark, d), ["document_id"])


@query()
def em_dense(spark, d):
    return L.embed(table(spark, d, "benchmark"), "item_id", "text", 64)


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS captioned_from, length(text) < 100 AS deferred FROM documents")
def pl_vision(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), (F.length("text") < 100).alias("deferred"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("captioned_from"))
    return docs.join(first, "h").select("doc_id", "captioned_from", "deferred")


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 'no_text' WHEN length(text) > 5000 THEN 'large' WHEN length(text) < 60 THEN 'small' END AS reason FROM documents")
def pl_fig_defer(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").select("doc_id", F.when(n == 0, "no_text").when(n > 5000, "large").when(n < 60, "small").alias("reason"))


