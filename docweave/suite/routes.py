"""Scopes, routes, dispatch, fallbacks and limits over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..operators import guards as G
from ..operators import joins as J
from ..operators import retrieval as R
from ..operators import routing as O
from ..operators import windows as W
from ..registry import query, table
from ..sources.fixtures import BLOCKS, BOXES, TABLES, blocks, boxes, cell_tables
from .retrieval import _BM25, _sparse

# ---------------------------------------------------------------- texts


@query("SELECT doc_id, CASE WHEN strlen(text) <= 90 THEN text ELSE left(text, list_max(list_filter(range(0, 91), lambda i: strlen(left(text, i)) <= 90))::BIGINT) END AS cut FROM documents")
def fn_truncate_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate_utf8(F.col("text"), 90).alias("cut"))


_GAPS = "CASE WHEN block_order % 3 = 0 THEN replace(text, ' ', repeat(' ', CAST(9 + document_id % 12 AS BIGINT))) ELSE text END"


@query(f"WITH {BLOCKS}, {BOXES}, g AS (SELECT b.document_id, b.block_order, {_GAPS.replace('document_id', 'b.document_id').replace('block_order', 'b.block_order')} AS t, y0 FROM blocks b JOIN boxes x USING (document_id, block_order)) SELECT document_id, block_order FROM g WHERE NOT (y0 <= 60 AND contains(t, repeat(' ', 15)) AND length(trim(regexp_replace(t, '\\s+', ' ', 'g'))) < 80)")
def flt_running_header(spark, d):
    gaps = F.when(F.col("block_order") % 3 == 0, F.replace("text", F.lit(" "), F.repeat(F.lit(" "), (9 + F.col("document_id") % 12).cast("int")))).otherwise(F.col("text"))
    b = blocks(spark, d).withColumn("text", gaps).join(boxes(spark, d).select("document_id", "block_order", "y0"), ["document_id", "block_order"])
    return b.where(~X.is_running_header(F.col("text"), F.col("y0"))).select("document_id", "block_order")


@query(
    f"""WITH {BLOCKS}, c AS (SELECT document_id, block_order, unnest(w) AS t, unnest(range(0, len(w))) AS i, type = 'table' AS structured FROM (SELECT *, string_split(CASE WHEN block_order % 4 = 0 THEN block_order || '-' || document_id || ' xiv ' || text ELSE text END, ' ') AS w FROM blocks))
    SELECT document_id, block_order, CAST(i AS INTEGER) AS i, t FROM c WHERE structured OR NOT (regexp_matches(trim(t), '^[0-9]+(-[0-9]+)?$') OR regexp_matches(trim(t), '^[iIvVxXlLcCdDmM]+$') OR length(trim(t)) <= 3)"""
)
def flt_tiny_chunk(spark, d):
    b = blocks(spark, d)  # words as chunks, with some numbers and numerals among them
    said = F.when(F.col("block_order") % 4 == 0, F.concat(F.col("block_order").cast("string"), F.lit("-"), F.col("document_id").cast("string"), F.lit(" xiv "), F.col("text"))).otherwise(F.col("text"))
    c = b.select("document_id", "block_order", F.posexplode(F.split(said, " ")).alias("i", "t"), (F.col("type") == "table").alias("structured"))
    return c.where(~X.is_tiny(F.col("t"), F.lit(1), F.col("structured"))).select("document_id", "block_order", "i", "t")


# ---------------------------------------------------------------- routes and guards

_TYPES = list(O.ROUTES)


@query(
    f"SELECT event_id, CASE WHEN (event_id % 100) / 100.0 < 0.5 THEN 'text_default' ELSE CASE {_TYPES + ['odd']}[event_id % 17 + 1] WHEN 'cad_drawing' THEN 'cad_route' WHEN 'circuit_diagram' THEN 'circuit_route' WHEN 'schematic' THEN 'diagram_heavy' WHEN 'datasheet' THEN 'diagram_heavy' WHEN 'image' THEN 'image_route' ELSE 'text_default' END END AS route FROM events"
)
def fn_route(spark, d):
    kind = F.get(F.array(*map(F.lit, [*_TYPES, "odd"])), (F.col("event_id") % 17).cast("int"))
    return table(spark, d, "events").select("event_id", O.route(kind, F.col("event_id") % 100 / 100).alias("route"))


_HEX = "('0x' || substr(sha256(CAST(user_id AS VARCHAR)), {}, 16))::UBIGINT % 100 * {}"
_BUCKET = "(" + " + ".join(_HEX.format(a, m) for a, m in ((49, 1), (33, 16), (17, 56), (1, 96))) + ") % 100"


@query(f"SELECT user_id, {_BUCKET} < 25 AS quarter, {_BUCKET} < 50 AS half, user_id % 10 = 0 OR {_BUCKET} < 5 AS unnamed, false AS none, true AS every FROM (SELECT DISTINCT user_id FROM events)")
def fn_bucket(spark, d):
    u = table(spark, d, "events").select("user_id").dropDuplicates()
    s = F.col("user_id").cast("string")
    unnamed = F.when(F.col("user_id") % 10 == 0, "").otherwise(s)  # no session: the guard applies
    return u.select("user_id", G.applies(s, 25).alias("quarter"), G.applies(s, 50).alias("half"), G.applies(unnamed, 5).alias("unnamed"), G.applies(s, 0).alias("none"), G.applies(s, 100).alias("every"))


@query(
    """WITH s AS (SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN replace(props, ': ', ': x') ELSE props END AS JSON) ->> '$.k' AS k FROM events), v AS (SELECT event_id, TRY_CAST(k AS INTEGER) AS k FROM s)
    SELECT event_id, CASE WHEN k IS NULL THEN 'safe_reply' WHEN k >= 80 THEN 'block' ELSE 'allow' END AS safe, CASE WHEN k IS NULL THEN 100 ELSE k END::BIGINT AS score, CASE WHEN k >= 80 THEN 'block' ELSE 'allow' END AS open FROM v"""
)
def gd_failmode(spark, d):
    # one in five replies can't be read: the guard's expression gives null
    props = F.when(F.col("event_id") % 5 == 0, F.replace("props", F.lit(": "), F.lit(": x"))).otherwise(F.col("props"))
    k = F.get_json_object(props, "$.k").try_cast("int")
    verdict = F.when(k >= 80, "block").when(k < 80, "allow")
    out = table(spark, d, "events").select("event_id", O.guarded(verdict, k, fail_open=False).alias("s"), O.guarded(verdict, k, fail_open=True).alias("o"))
    return out.select("event_id", F.col("s.verdict").alias("safe"), "s.score", F.col("o.verdict").alias("open"))


_CASES = [
    ({}, 0),
    ({"policy": {"block_threshold": 60, "warn_threshold": 60}}, 1),
    ({"policy": {"block_threshold": 0}}, 2),
    ({"rollout": {"output_guard_pct": 50}, "token_quota": {"window_minutes": 0}}, 2),
    ({"input": {"max_query_chars": 10}, "logging": {"ring_buffer_size": 5000}}, 0),
    ({"output": {"groundedness": {"timeout_ms": 31000}}, "policy": {"bypass_alert_rate": 1.5}}, 2),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {n}::BIGINT)" for i, (_, n) in enumerate(_CASES)) + ") t(setting, errors)")
def gd_config(spark, d):
    return spark.createDataFrame([(i, len(O.config_errors(c))) for i, (c, _) in enumerate(_CASES)], "setting long, errors long")


# ---------------------------------------------------------------- scopes

_TURNS = """t AS (SELECT c_custkey AS turn_id, CASE c_custkey % 6 WHEN 0 THEN 'please Search ALL documents for ' || p_name WHEN 1 THEN 'explain the ' || p_name WHEN 2 THEN 'what does it say there' WHEN 3 THEN 'what of brand 12' WHEN 4 THEN 'what is this about' ELSE 'and ' || split_part(p_name, ' ', 1) || '?' END AS message,
  CASE WHEN c_custkey % 6 IN (2, 5) THEN c_custkey % 7 * 1000000 + c_custkey END AS viewer_doc, CASE WHEN c_custkey % 6 = 3 THEN c_custkey END AS session_doc FROM customer JOIN part ON p_partkey = c_custkey),
docs AS (SELECT p_partkey AS document_id, p_name || ' ' || p_type AS about FROM part WHERE p_partkey % 10 < 8)"""


@query(
    f"""WITH {_TURNS}, gen AS (SELECT unnest({O.GENERIC}) AS g), tt AS (SELECT DISTINCT turn_id, unnest(regexp_extract_all(lower(message), '[a-z0-9_-]{{4,}}')) AS term FROM t), tk AS (SELECT * FROM tt WHERE term NOT IN (SELECT g FROM gen)), tn AS (SELECT turn_id, count(*) AS n FROM tk GROUP BY turn_id),
    dk AS (SELECT DISTINCT document_id, unnest(regexp_extract_all(lower(about), '[a-z0-9_-]{{3,}}')) AS term FROM docs), hit AS (SELECT turn_id, document_id, count(*) AS h FROM tk JOIN (SELECT * FROM dk WHERE term NOT IN (SELECT g FROM gen)) USING (term) GROUP BY ALL),
    men AS (SELECT turn_id, list_sort(list(document_id)) AS m FROM hit JOIN tn USING (turn_id) WHERE h >= 2 OR h >= 0.7 * n GROUP BY turn_id),
    r AS (SELECT t.*, m, v.document_id AS v, s.document_id AS s, lower(trim(message)) AS low FROM t LEFT JOIN men USING (turn_id) LEFT JOIN docs v ON v.document_id = viewer_doc LEFT JOIN docs s ON s.document_id = session_doc),
    k AS (SELECT *, CASE WHEN contains(low, 'search all') OR contains(low, 'all documents') THEN 'reset' WHEN m IS NOT NULL THEN 'mention' WHEN v IS NOT NULL THEN 'viewer' WHEN s IS NOT NULL THEN 'session' WHEN contains(low, 'what is this about') THEN 'deictic' ELSE 'none' END AS tier FROM r)
    SELECT turn_id, tier, CASE tier WHEN 'mention' THEN array_to_string(m, ',') WHEN 'viewer' THEN CAST(v AS VARCHAR) WHEN 'session' THEN CAST(s AS VARCHAR) END AS scope, tier = 'deictic' AS ambiguous FROM k"""
)
def rt_scope5(spark, d):
    p, c = table(spark, d, "part"), table(spark, d, "customer").select("c_custkey")
    n = F.col("c_custkey") % 6
    message = (
        F.when(n == 0, F.concat(F.lit("please Search ALL documents for "), "p_name"))
        .when(n == 1, F.concat(F.lit("explain the "), "p_name"))
        .when(n == 2, "what does it say there")
        .when(n == 3, "what of brand 12")
        .when(n == 4, "what is this about")
        .otherwise(F.concat(F.lit("and "), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("?")))
    )
    viewer = F.when(n.isin(2, 5), F.col("c_custkey") % 7 * 1000000 + F.col("c_custkey"))
    turns = c.join(p, F.col("p_partkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("turn_id"), message.alias("message"), viewer.alias("viewer_doc"), F.when(n == 3, F.col("c_custkey")).alias("session_doc"))
    docs = p.where("p_partkey % 10 < 8").select(F.col("p_partkey").alias("document_id"), F.concat_ws(" ", "p_name", "p_type").alias("about"))
    out = O.resolve_scope(turns, docs)
    return out.select("turn_id", "tier", F.array_join(F.transform("scope", lambda x: x.cast("string")), ",").alias("scope"), "ambiguous")


# ---------------------------------------------------------------- tables and figures


@query(
    f"""WITH {TABLES}, r AS (SELECT table_id, unnest(rows) AS row, unnest(range(0, len(rows))) AS r FROM tables), g AS (SELECT table_id, max(CASE WHEN row[3] = 'R' THEN 1 ELSE 0 END) AS returned, max(CASE WHEN CAST(row[2] AS INTEGER) >= 45 THEN 1 ELSE 0 END) AS heavy, count(*) AS n FROM r GROUP BY table_id),
    k AS (SELECT table_id, CASE WHEN n >= 6 AND heavy = 1 THEN 'trouble' WHEN returned = 1 THEN 'alarm' WHEN n <= 2 THEN 'model' ELSE 'rows' END AS strategy, n FROM g)
    SELECT table_id, strategy, CASE strategy WHEN 'alarm' THEN (SELECT count(*) FROM r WHERE r.table_id = k.table_id AND row[3] = 'R') WHEN 'model' THEN 2 ELSE n END AS chunks FROM k"""
)
def ck_table_strategy(spark, d):
    t = cell_tables(spark, d)
    heads = ["part", "qty", "flag", "date"]
    heavy = t.where((F.size("rows") >= 6) & F.exists("rows", lambda r: F.get(r, 1).cast("int") >= 45))
    returned = t.select("table_id", F.filter("rows", lambda r: F.get(r, 2) == "R").alias("rows")).where(F.size("rows") > 0)
    small = t.where(F.size("rows") <= 2).select("table_id", F.transform("rows", lambda r: F.slice(r, 1, 3)).alias("rows"))
    made = [
        ("trouble", C.labelled_rows(heavy, heads, "Troubleshooting")),
        ("alarm", C.labelled_rows(returned, heads, "Alarm")),
        ("model", C.model_columns(small, heads[:3], 1)),
        ("rows", C.labelled_rows(t, heads, "Row")),
    ]
    chosen = O.first_chunker([(name, df.select("table_id", "text")) for name, df in made], "table_id")
    return chosen.groupBy("table_id", "strategy").agg(F.count("*").alias("chunks"))


@query(
    f"""WITH {TABLES}, n AS (SELECT table_id, rows[1] AS head, CASE table_id % 3 WHEN 0 THEN ['PART ', 'Qty', 'flag', 'date'] WHEN 1 THEN ['0', '1', '2', '3'] ELSE rows[1] END AS h, list_concat(rows[2:], [['part', 'QTY', 'Flag', 'date']]) AS more FROM tables)
    SELECT table_id, CAST(1 + CASE WHEN table_id % 3 = 2 THEN 1 ELSE 0 END + len(more) - 1 AS BIGINT) AS n_rows, md5(array_to_string(list_transform(list_concat([head], CASE WHEN table_id % 3 = 2 THEN [h] ELSE [] END, more[1:len(more) - 1]), lambda r: array_to_string(r, '|')), ';')) AS rows_md5 FROM n"""
)
def pl_stitch_merge(spark, d):
    n = F.col("table_id") % 3
    arr = lambda *x: F.array(*map(F.lit, x))
    headers = F.when(n == 0, arr("PART ", "Qty", "flag", "date")).when(n == 1, arr("0", "1", "2", "3")).otherwise(F.get("rows", 0))
    lead = F.struct(arr("part", "qty", "flag", "date").alias("headers"), F.slice("rows", 1, 1).alias("rows"))
    # the next page's rows, among them the header printed again
    more = F.concat(F.slice("rows", 2, 1 << 20), F.array(arr("part", "QTY", "Flag", "date")))
    out = cell_tables(spark, d).select("table_id", C.merge_continuation(lead, headers, more).alias("r"))
    return out.select("table_id", F.size("r").cast("long").alias("n_rows"), F.md5(F.array_join(F.transform("r", lambda x: F.array_join(x, "|")), ";").cast("binary")).alias("rows_md5"))


@query(
    f"""WITH {BLOCKS}, {BOXES}, k AS (SELECT *, CASE WHEN y0 < 65 THEN 'header' WHEN y1 > 585 THEN 'footer' END AS place FROM boxes JOIN (SELECT document_id, block_order, text FROM blocks) USING (document_id, block_order)),
    f AS (SELECT *, row_number() OVER w AS r, first_value(text) OVER w AS first FROM k WINDOW w AS (PARTITION BY document_id, place, x1 - x0, y1 - y0 ORDER BY page, block_order))
    SELECT document_id, block_order, place IS NOT NULL AND r > 1 AS reused, md5(CASE WHEN place IS NOT NULL THEN first ELSE text END) AS caption_md5 FROM f"""
)
def pl_fig_header_cache(spark, d):
    figures = boxes(spark, d).join(blocks(spark, d).select("document_id", "block_order", F.col("text").alias("caption")), ["document_id", "block_order"]).withColumn("height", F.lit(650))
    return C.reuse_furniture(figures).select("document_id", "block_order", "reused", F.md5(F.col("caption").cast("binary")).alias("caption_md5"))


@query(f"WITH {BLOCKS} SELECT document_id, block_order FROM blocks WHERE list_contains(['text', 'table', 'title'], CASE block_order % 5 WHEN 0 THEN 'page_header' WHEN 1 THEN 'page_footer' WHEN 2 THEN 'title' ELSE type END)")
def flt_furniture(spark, d):
    label = F.when(F.col("block_order") % 5 == 0, "page_header").when(F.col("block_order") % 5 == 1, "page_footer").when(F.col("block_order") % 5 == 2, "title").otherwise(F.col("type"))
    return blocks(spark, d).withColumn("label", label).where(~F.col("label").isin("page_header", "page_footer", "heading")).select("document_id", "block_order")


# ---------------------------------------------------------------- search

_LISTS = "x AS (SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rx FROM events) WHERE rx <= 10), y AS (SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS ry FROM events) WHERE ry <= 10)"


@query(f"WITH {_LISTS} SELECT user_id, event_id, round(coalesce(0.6 / (80 + rx)::DOUBLE, 0) + coalesce(0.4 / (80 + ry)::DOUBLE, 0), 9) AS score FROM x FULL JOIN y USING (user_id, event_id)")
def rt_rrf(spark, d):
    e = table(spark, d, "events")
    x = W.top(e, ["user_id"], [F.desc("value"), F.asc("event_id")], 10).select("user_id", "event_id", F.col("rank").alias("rx"))
    y = W.top(e, ["user_id"], [F.desc("ts"), F.asc("event_id")], 10).select("user_id", "event_id", F.col("rank").alias("ry"))
    return J.fuse(x, y, ["user_id", "event_id"], "rx", "ry", k=80).select("user_id", "event_id", F.round("score", 9).alias("score"))


@query(
    f"""WITH {_BM25}, qp AS (SELECT item_id AS id, term, count(*) AS tf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '\\s+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL)
    SELECT 'passage' AS side, id, term, tf, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)), 9) AS weight FROM p, st
    UNION ALL SELECT 'query', id, term, tf, round(ln(1 + (total - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)), 9) FROM qp LEFT JOIN df USING (term), st"""
)
def em_sparse(spark, d):
    index = R.postings(table(spark, d, "documents"), "doc_id", "text")
    w = R.bm25_weights(R.postings(table(spark, d, "benchmark"), "item_id", "text"), index)
    return w.select("side", "id", "term", "tf", F.round("weight", 9).alias("weight"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''))"


@query(
    f"""WITH {_BM25}, best AS (SELECT query_id // 4 AS question, id, max(score) AS score FROM sparse GROUP BY ALL), q AS (SELECT item_id // 4 AS question, min_by(text, item_id) AS query FROM benchmark GROUP BY 1),
    o AS (SELECT question, id, score, {_WORDS.format('query')} AS q, {_WORDS.format('text')} AS t FROM best JOIN q USING (question) JOIN documents ON id = doc_id), r AS (SELECT question, id, score, round(len(list_intersect(q, t)) / len(q), 6) AS rerank_score FROM o)
    SELECT * FROM (SELECT question, id, score, rerank_score, row_number() OVER (PARTITION BY question ORDER BY rerank_score DESC, score DESC, id) AS final FROM r) WHERE final <= 5"""
)
def rt_multi(spark, d):
    b = table(spark, d, "benchmark")
    question = F.floor(F.col("item_id") / 4).alias("question")
    asked = b.groupBy(question).agg(F.min_by("text", "item_id").alias("query"))
    hits = _sparse(spark, d).select(F.floor(F.col("query_id") / 4).alias("question"), "id", "score")
    return R.multi_rerank(hits, asked, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 5)


_PAGED = "hp AS (SELECT query_id, id, rank, score, id AS document_id, query_id % 3 + 1 AS page FROM sparse), pt AS (SELECT document_id, page, string_agg(trim(text), chr(10) || chr(10) ORDER BY block_order) AS page_text FROM blocks WHERE trim(text) <> '' GROUP BY ALL)"


def _paged(spark, d):
    """Hits with the document and page that they lie on."""
    return _sparse(spark, d).select("query_id", "id", "rank", "score", F.col("id").alias("document_id"), (F.col("query_id") % 3 + 1).alias("page"))


@query(
    f"""WITH {BLOCKS}, {_BM25}, {_PAGED}, wk AS (SELECT query_id, max(score) < 40 AS weak FROM hp GROUP BY query_id)
    SELECT query_id, id, rank, CASE WHEN weak AND rank <= 2 AND page_text IS NOT NULL THEN 'page' ELSE 'chunk' END AS kind, md5(CASE WHEN weak AND rank <= 2 AND page_text IS NOT NULL THEN page_text ELSE 'chunk ' || id END) AS text_md5 FROM hp JOIN wk USING (query_id) LEFT JOIN pt USING (document_id, page)"""
)
def rt_fallback_page(spark, d):
    hits = _paged(spark, d).withColumn("text", F.concat(F.lit("chunk "), F.col("id").cast("string")))
    out = R.fallback_pages(hits, blocks(spark, d), 40)
    return out.select("query_id", "id", "rank", "kind", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    f"""WITH {BLOCKS}, {_BM25}, {_PAGED}, f AS (SELECT query_id, document_id, page, min(rank) AS rank FROM hp WHERE query_id % 2 = 0 AND id % 5 <> 0 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, document_id, page) AS place FROM f)
    SELECT query_id, document_id, page, place, md5(page_text) AS text_md5 FROM k JOIN pt USING (document_id, page) WHERE place <= 10"""
)
def rt_force_expand(spark, d):
    answers = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Sorry, I do not know: "), "text")).otherwise("It is so [1].").alias("answer"))
    hits = _paged(spark, d).withColumn("filename", F.concat(F.col("id").cast("string"), F.when(F.col("id") % 5 == 0, ".XLSX").otherwise(".pdf")))
    out = R.force_expand(answers, hits, blocks(spark, d), 10)
    return out.select("query_id", "document_id", "page", "place", F.md5(F.col("page_text").cast("binary")).alias("text_md5"))


def _methods(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    sparse = lambda: _sparse(spark, d)
    reranked = lambda: R.rerank(sparse().join(R.small(asked), "query_id").join(docs, "id"), 5).select("query_id", "id", F.col("final").alias("rank"))
    keyword = lambda: sparse().where("rank <= 5").select("query_id", "id", "rank")
    broken = lambda: spark.table("no_such_index")
    return {"hybrid_rerank": reranked, "enriched": reranked, "naive": broken}, keyword


_RERANKED = f"h AS (SELECT query_id, id, rank, {_WORDS.format('b.text')} AS q, {_WORDS.format('t.text')} AS t FROM sparse JOIN benchmark b ON query_id = item_id JOIN documents t ON id = doc_id), re AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(len(list_intersect(q, t)) / len(q), 6) DESC, rank, id) AS rank FROM h) WHERE rank <= 5)"


@query(f"WITH {_BM25}, {_RERANKED} SELECT query_id, id, rank, 'hybrid_rerank' AS method FROM re UNION ALL SELECT query_id, id, rank, 'keyword_fallback' FROM sparse WHERE rank <= 5")
def rt_dispatch(spark, d):
    # one method runs; another's index is missing, so keyword search takes its place
    methods, keyword = _methods(spark, d)
    return O.dispatch(methods, "hybrid_rerank", keyword).unionByName(O.dispatch(methods, "naive", keyword))


@query(f"WITH {_BM25}, {_RERANKED} SELECT query_id, id, rank, 'enriched' AS method FROM re")
def rt_enriched(spark, d):
    methods, keyword = _methods(spark, d)
    return O.dispatch(methods, "enriched", keyword)


@query(f"WITH {BLOCKS}, t AS (SELECT document_id, page, string_agg(text, ' ' ORDER BY block_order) AS said FROM blocks WHERE type <> 'table' GROUP BY ALL) SELECT document_id, page, md5('Describe the figure of this ' || CASE WHEN document_id % 2 = 0 THEN 'manual' ELSE 'report' END || '. The page says: ' || left(said, 1200)) AS prompt_md5 FROM t")
def pl_vision_prompt(spark, d):
    # the prompt of a document's route with what its page says, cut to 1,200 characters
    said = blocks(spark, d).where("type <> 'table'").groupBy("document_id", "page").agg(F.expr("listagg(text, ' ') within group (order by block_order)").alias("said"))
    kind = F.when(F.col("document_id") % 2 == 0, "manual").otherwise("report")
    prompt = F.concat(F.lit("Describe the figure of this "), kind, F.lit(". The page says: "), F.left("said", F.lit(1200)))
    return said.select("document_id", "page", F.md5(prompt.cast("binary")).alias("prompt_md5"))


# ---------------------------------------------------------------- sessions

_ENTITIES = {"Reranker": ["rerank", "reranker"], "Chunker": ["chunker", "chunking"]}
_ASKED = """q AS (SELECT conv_id AS session, turn, TIMESTAMP '2024-01-01' + to_seconds(turn * (conv_id % 9) * 120) AS ts, CASE (turn * 3 + conv_id) % 8 WHEN 0 THEN 'tell of the reranker ' || left(text, 9) WHEN 1 THEN 'its speed' WHEN 2 THEN 'Model Name' WHEN 3 THEN 'list its parts' WHEN 4 THEN 'and then' WHEN 5 THEN 'compare it' WHEN 6 THEN 'Chunking now' ELSE left(text, 40) END AS text FROM conversations),
n AS (SELECT *, lower(text) AS low, CASE WHEN regexp_matches(lower(text), '\\b(rerank|reranker)\\b') THEN 'Reranker' WHEN regexp_matches(lower(text), '\\b(chunker|chunking)\\b') THEN 'Chunker' END AS entity FROM q),
c AS (SELECT *, last_value(CASE WHEN entity IS NOT NULL THEN {'e': entity, 'turn': turn, 'ts': ts} END IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM n),
v AS (SELECT *, coalesce(turn - held.turn <= 3 AND epoch_us(ts) - epoch_us(held.ts) <= 900000000, false) AS valid, regexp_matches(low, '\\bcompare\\b|\\blist\\b|\\bshow all\\b|\\bwhat models\\b|\\ball models\\b|\\bsummarize\\b') AS broad,
  regexp_matches(trim(low), '^\\s*model\\s*name\\s*$|^\\s*model\\s*$|^\\s*its\\s+model\\b|^\\s*what\\s+is\\s+its?\\b|^\\s*its\\s+version\\b|^\\s*its\\s+speed\\b') OR (len(list_filter(regexp_split_to_array(trim(low), '\\s+'), lambda x: x <> '')) <= 2 AND entity IS NULL) AS follow_up FROM c)"""


def _asked(spark, d):
    n, t = (F.col("turn") * 3 + F.col("conv_id")) % 8, F.col("text")
    said = (
        F.when(n == 0, F.concat(F.lit("tell of the reranker "), F.left(t, F.lit(9))))
        .when(n == 1, "its speed")
        .when(n == 2, "Model Name")
        .when(n == 3, "list its parts")
        .when(n == 4, "and then")
        .when(n == 5, "compare it")
        .when(n == 6, "Chunking now")
        .otherwise(F.left(t, F.lit(40)))
    )
    ts = F.timestamp_micros(F.lit(1704067200000000) + F.col("turn") * (F.col("conv_id") % 9) * 120000000)
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", ts.alias("ts"), said.alias("text"))


@query(f"WITH {_ASKED} SELECT session, turn, broad, follow_up FROM v")
def fn_broad(spark, d):
    t = F.col("text")
    return _asked(spark, d).select("session", "turn", O.is_broad_question(t).alias("broad"), O.is_follow_up(t, _ENTITIES).alias("follow_up"))


@query(f"WITH {_ASKED} SELECT session, turn, entity, entity IS NULL AND NOT broad AND follow_up AND valid AS rewritten, CASE WHEN entity IS NULL AND NOT broad AND follow_up AND valid THEN held.e || ' ' || text ELSE text END AS asked FROM v")
def rt_context(spark, d):
    return O.carry_entities(_asked(spark, d), _ENTITIES).select("session", "turn", "entity", "rewritten", "asked")


@query(f"WITH {_ASKED} SELECT session, turn, valid FROM v")
def st_context_ttl(spark, d):
    return O.carry_entities(_asked(spark, d), _ENTITIES).select("session", "turn", "valid")
