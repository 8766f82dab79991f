"""Replies of models, injected models, sheets' results and tools over the shared tables."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import replies as R
from ..functions import text as X
from ..operators import retrieval as S
from ..operators import routing as O
from ..plans import sql as Q
from ..registry import query, table
from ..sources.fixtures import BLOCKS, TABLES, blocks, cell_tables
from .retrieval import _BM25, _sparse
from .salvage import _WORDS, _words

_KNOWN = ["invoice", "contract", "purchase_order", "manual", "report"]


@query(
    f"""WITH r AS (SELECT event_id, {_KNOWN}[event_id % 5 + 1] AS t, event_id % 100 AS c, event_id // 5 % 4 AS k FROM events)
    SELECT event_id, CASE WHEN k = 3 OR (k = 2 AND t = 'report') THEN 'report' ELSE t END AS doc_type, CASE WHEN k = 3 OR (k = 2 AND t = 'report') THEN 0.3 WHEN k = 2 AND c <= 1 THEN c::DOUBLE ELSE c / 100.0::DOUBLE END AS confidence,
      CASE WHEN k IN (0, 1) THEN 'json' WHEN k = 3 OR t = 'report' THEN 'default' ELSE 'prose' END AS source FROM r"""
)
def js_classification(spark, d):
    e = table(spark, d, "events")
    t, c, k = F.get(F.array(*map(F.lit, _KNOWN)), (F.col("event_id") % 5).cast("int")), (F.col("event_id") % 100).cast("string"), F.floor(F.col("event_id") / 5) % 4
    body = F.concat(F.lit('{"document_type": "'), t, F.lit('", "confidence": '), F.format_string("%.2f", F.col("event_id") % 100 / 100), F.lit("}"))
    prose = F.concat(F.lit("I'd say a "), F.replace(t, F.lit("_"), F.lit(" ")), F.lit(" it is, confidence: "), c, F.lit(" per cent"))
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("So: "), body, F.lit(" (sure)"))).when(k == 2, prose).otherwise(F.lit("can't say what that is {"))
    return e.select("event_id", R.classification(reply, _KNOWN).alias("x")).select("event_id", "x.*")


@query(
    f"""WITH {_WORDS}, k AS (SELECT doc_id, w[1] AS a, w[len(w)] AS z, doc_id % 3 AS k FROM w WHERE len(w) > 0)
    SELECT doc_id, CASE k WHEN 0 THEN a || chr(10) || chr(10) || 'Entities: ' || a || ', ' || z WHEN 1 THEN z ELSE 'no JSON ' || a END AS text, CASE k WHEN 0 THEN 'chart' WHEN 1 THEN 'photo' ELSE 'other' END AS kind, CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 0.95 ELSE 0.0 END::DOUBLE AS confidence, k = 2 AS failed FROM k"""
)
def js_caption(spark, d):
    a, z, k = F.element_at("w", 1), F.element_at("w", -1), F.col("doc_id") % 3
    full = F.concat(F.lit('{"description": " '), a, F.lit('", "entities": ["'), a, F.lit('", "'), z, F.lit('"], "type": "chart", "confidence": 0.5}'))
    reply = F.when(k == 0, full).when(k == 1, F.concat(F.lit('well {"caption": "'), z, F.lit('", "kind": "photo", "confidence": "high"}'))).otherwise(F.concat(F.lit(" no JSON "), a))
    return _words(spark, d).where("size(w) > 0").select("doc_id", R.caption(reply).alias("x")).select("doc_id", "x.*")


@query(
    f"""WITH {_WORDS}, k AS (SELECT doc_id, array_to_string(w, ' ') AS q, w FROM w WHERE len(w) > 0), s AS (SELECT doc_id, q, CASE doc_id % 3 WHEN 0 THEN w[1:3] WHEN 1 THEN [q || ' ', w[1]] ELSE [] END AS subs FROM k)
    SELECT doc_id, array_to_string(CASE WHEN list_contains(list_transform(subs, lambda x: lower(trim(x))), q) THEN subs ELSE list_append(subs, q) END, ';') AS questions FROM s"""
)
def rt_plan(spark, d):
    q, k = F.array_join("w", " "), F.col("doc_id") % 3
    said = lambda xs: F.to_json(xs)
    reply = F.when(k == 0, F.concat(F.lit("Plan: "), said(F.col("w")))).when(k == 1, said(F.array(F.concat(q, F.lit(" ")), F.element_at("w", 1)))).otherwise(F.lit("no plan"))
    return _words(spark, d).where("size(w) > 0").select("doc_id", F.array_join(R.planned(reply, q), ";").alias("questions"))


_PASSAGE = _BM25.replace("regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), '\\s+'), lambda x: x <> '')) AS term FROM benchmark", "regexp_replace('It is said of ' || text, '[^\\p{L}\\p{N}]+', ' ', 'g')), '\\s+'), lambda x: x <> '')) AS term FROM benchmark")


@query(f"WITH {_PASSAGE} SELECT query_id, id, score, rank FROM sparse")
def rt_hyde(spark, d):
    # the passage that a model would write is a function of the question, given from outside
    write = lambda q: F.concat(F.lit("It is said of "), q)
    asked = table(spark, d, "benchmark").select("item_id", write(F.col("text")).alias("text"))
    terms = S.postings(asked, "item_id", "text").select(F.col("id").alias("query_id"), "term")
    return S.search(terms, table(spark, d, "documents"), "doc_id", "text", 20)


@query(f"WITH {_BM25} SELECT query_id, left(text, 200) || ' [1]' AS answer, 'doc-' || id AS citation FROM sparse JOIN documents ON id = doc_id WHERE rank = 1")
def rt_answer(spark, d):
    # without a model the answer is an extract of the best hit, cited
    best = _sparse(spark, d, 1).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return best.select("query_id", F.concat(F.left("text", F.lit(200)), F.lit(" [1]")).alias("answer"), F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("citation"))


@query("SELECT item_id, 2.0 * length(a) / (2 * length(a) + k) >= 0.7 AS near FROM (SELECT item_id, left(text, 80) AS a, item_id % 90 AS k FROM benchmark)")
def fn_seq_ratio(spark, d):
    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])

    a, k = F.left("text", F.lit(80)), (F.col("item_id") % 90).cast("int")
    return table(spark, d, "benchmark").select("item_id", (ratio(a, F.concat(a, F.repeat(F.lit("~"), k))) >= 0.7).alias("near"))


_STOP = {"en": ("the", "and", "of", "that", "is"), "de": ("der", "die", "und", "das", "ist"), "fr": ("les", "des", "est", "une", "dans"), "es": ("que", "los", "las", "una", "por")}
_VOTES = ", ".join(f"len(list_intersect(w, {list(ws)})) AS {lang}" for lang, ws in _STOP.items())


@query(
    f"""WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS w FROM documents), v AS (SELECT doc_id, {_VOTES} FROM w)
    SELECT doc_id, CASE greatest(en, de, fr, es) WHEN 0 THEN 'en' WHEN en THEN 'en' WHEN de THEN 'de' WHEN fr THEN 'fr' ELSE 'es' END AS language FROM v"""
)
def fn_lang(spark, d):
    return table(spark, d, "documents").select("doc_id", O.vote_language(F.col("text"), _STOP).alias("language"))


_B = "(^|[^\\p{{L}}\\p{{N}}_])({})([^\\p{{L}}\\p{{N}}_]|$)"
_TYPE_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{t}'" for t, ws in X.TYPE_WORDS.items()) + " ELSE 'report' END"
_INDUSTRY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{_B.format('|'.join(ws))}') THEN '{n}'" for n, ws in X.INDUSTRIES.items()) + " ELSE 'general' END"
_MORE = "CASE doc_id % 6 WHEN 0 THEN ' Invoice, bill to Acme' WHEN 1 THEN ' Datasheet of the pcb' WHEN 2 THEN ' this agreement has a clause' WHEN 3 THEN ' the patient, doi: 1' ELSE '' END"


@query(
    f"""WITH t AS (SELECT doc_id, text || {_MORE} AS text FROM documents), g AS (SELECT doc_id, {_TYPE_SQL} AS doc_type, {_INDUSTRY_SQL} AS industry FROM t)
    SELECT doc_id, doc_type, industry, CASE WHEN doc_type = 'report' THEN 0.5 ELSE 0.6 END::DOUBLE AS confidence, CASE doc_type WHEN 'datasheet' THEN 'diagram_heavy' ELSE 'text_default' END AS route,
      'type ' || doc_type || CASE WHEN doc_type = 'report' THEN ' (0.50)' ELSE ' (0.60)' END || ', industry ' || industry AS reasoning FROM g"""
)
def pl_categorize(spark, d):
    n = F.col("doc_id") % 6
    more = F.when(n == 0, " Invoice, bill to Acme").when(n == 1, " Datasheet of the pcb").when(n == 2, " this agreement has a clause").when(n == 3, " the patient, doi: 1").otherwise("")
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", more).alias("text"))
    return O.categorise(docs).select("doc_id", "doc_type", "industry", "confidence", "route", "reasoning")


@query(
    """WITH c AS (SELECT doc_id, string_split(CASE WHEN doc_id % 6 = 0 THEN replace(text, ' ', ' 1. ') ELSE text END, chr(10)) AS c FROM documents), k AS (SELECT doc_id, doc_id % 7 = 0 AS spans, doc_id % 2 = 0 AS ruled, doc_id % 5 = 0 AS ragged, doc_id % 3 = 0 AS local, ['auto', 'pymupdf', 'vlm', 'auto'][doc_id // 2 % 4 + 1] AS mode,
      len(list_filter(c, lambda x: length(x) > 160 OR len(regexp_extract_all(x, '(?:^|\\s)\\d{1,2}\\.\\s')) >= 2)) >= 2 AS heavy FROM c)
    SELECT doc_id, CASE WHEN ruled AND (mode = 'pymupdf' OR (mode = 'auto' AND heavy AND NOT spans AND NOT ragged)) THEN 'pymupdf' WHEN mode = 'vlm' OR (mode = 'auto' AND (spans OR heavy)) THEN CASE WHEN local THEN 'local' ELSE 'vlm' END ELSE 'tableformer' END AS source FROM k"""
)
def pl_table_route(spark, d):
    i = F.col("doc_id")
    cells = F.split(F.when(i % 6 == 0, F.replace("text", F.lit(" "), F.lit(" 1. "))).otherwise(F.col("text")), "\n")
    mode = F.get(F.array(*map(F.lit, ("auto", "pymupdf", "vlm", "auto"))), (F.floor(i / 2) % 4).cast("int"))
    spans = i % 7 == 0
    source = O.table_source(mode, O.is_complex_table(cells, spans), spans, i % 2 == 0, i % 5 == 0, i % 3 == 0)
    return table(spark, d, "documents").select("doc_id", source.alias("source"))


@query(f"WITH {BLOCKS}, k AS (SELECT document_id, block_order, CASE WHEN block_order % 6 = 5 THEN '' ELSE text END AS caption, CASE block_order % 3 WHEN 0 THEN upper(left(text, 12)) WHEN 1 THEN 'Fig. ' || block_order ELSE '' END AS known FROM blocks WHERE regexp_full_match(text, '[ -~]*')), c AS (SELECT *, CASE WHEN caption = '' THEN '[figure]' ELSE caption END AS said FROM k) SELECT document_id, block_order, md5(CASE WHEN known = '' OR contains(lower(said), lower(known)) THEN said ELSE known || ' — ' || said END) AS caption_md5 FROM c")
def pl_fig_caption(spark, d):
    b = blocks(spark, d).where(F.col("text").rlike("^[ -~]*$"))
    n, t = F.col("block_order") % 3, F.col("text")
    known = F.when(n == 0, F.upper(F.left(t, F.lit(12)))).when(n == 1, F.concat(F.lit("Fig. "), F.col("block_order").cast("string"))).otherwise("")
    said = O.with_known_caption(F.when(F.col("block_order") % 6 == 5, "").otherwise(t), known)
    return b.select("document_id", "block_order", F.md5(said.cast("binary")).alias("caption_md5"))


@query(f"WITH {TABLES} SELECT table_id, CASE WHEN table_id % 5 = 0 THEN 'row count' WHEN table_id % 5 = 1 THEN 'empty' WHEN table_id % 5 = 2 THEN 'untraceable' END AS error FROM tables")
def ck_repair_validate(spark, d):
    n = F.col("table_id") % 5
    said = F.transform("rows", lambda r: F.concat(F.lit("Part: "), F.array_join(r, " of the lot, "), F.lit(" and 12345")))
    # one row too many; an empty one; four words that come from nowhere; three, and words of the context
    repaired = (
        F.when(n == 0, F.array_append(said, F.lit("part")))
        .when(n == 1, F.concat(F.slice(said, 1, F.size(said) - 1), F.array(F.lit(" "))))
        .when(n == 2, F.transform(said, lambda t: F.concat(t, F.lit(" quite alien matter here"))))
        .when(n == 3, F.transform(said, lambda t: F.concat(t, F.lit(" quite alien matter"))))
        .otherwise(F.transform(said, lambda t: F.concat(t, F.lit(" of shipped goods"))))
    )
    heads = F.array(*map(F.lit, ("part", "qty", "flag", "date")))
    error = O.repair_error(repaired, F.col("rows"), heads, F.lit("Goods of the lot, shipped"), stops=("and",))
    return cell_tables(spark, d).select("table_id", error.alias("error"))


# ---------------------------------------------------------------- statements, sheets and tools


@query("SELECT n_nationkey, n_name, (SELECT count(*) FROM nation WHERE n_regionkey < 3) AS row_count FROM nation WHERE n_regionkey < 3")
def sq_result(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("sq_nation")
    found = Q.result(Q.run_readonly(spark, "SELECT n_nationkey, n_name FROM sq_nation WHERE n_regionkey < 3", 100))
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"], found["row_count"]) for r in found["rows"]], "n_nationkey int, n_name string, row_count long")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def sq_timeout(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("sq_orders")
    found = Q.run_within(spark, "SELECT o_orderstatus, count(*) AS n FROM sq_orders GROUP BY o_orderstatus", 60.0)
    return spark.createDataFrame([(r["o_orderstatus"], r["n"]) for r in found["rows"]], "o_orderstatus string, n long")


@query(
    """WITH f AS (SELECT c_custkey || ' | ' || c_name || ' | ' || c_mktsegment AS line, c_custkey FROM (SELECT * FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 20)), t AS (SELECT string_agg(line, chr(10) ORDER BY c_custkey) AS t FROM f)
    SELECT (SELECT count(*) FROM customer WHERE c_nationkey = 3) AS n_rows, 3::BIGINT AS n_columns, CASE WHEN length(t) > 300 THEN left(t, 300) || chr(10) || '...[truncated: exceeded 300 chars]' ELSE t END AS text FROM t"""
)
def uf_code_result(spark, d):
    own = table(spark, d, "customer").where("c_nationkey = 3").select("c_custkey", "c_name", "c_mktsegment")
    return Q.shown(own, ["c_custkey"], 20, 300)


#: tools by name: what they do, their arguments, and the function
_TOOLS = {
    "list_documents": ("Documents of a language", {"lang": "string"}, lambda spark, d, lang: table(spark, d, "documents").where(F.col("lang") == lang).select(F.col("doc_id").alias("id"))),
    "find_orders": ("Orders of a customer", {"customer": "long"}, lambda spark, d, customer: table(spark, d, "orders").where(F.col("o_custkey") == customer).select(F.col("o_orderkey").alias("id"))),
}


@query("SELECT 'list_documents' AS tool, doc_id AS id FROM documents WHERE lang = 'fr' UNION ALL SELECT 'find_orders', o_orderkey FROM orders WHERE o_custkey = 7")
def ag_tools(spark, d):
    calls = [("list_documents", {"lang": "fr"}), ("find_orders", {"customer": 7})]
    made = (_TOOLS[name][2](spark, d, **args).select(F.lit(name).alias("tool"), "id") for name, args in calls)
    return reduce(lambda a, b: a.unionByName(b), made)


@query(
    f"""WITH {_WORDS}, k AS (SELECT doc_id, doc_id % 5 AS k, w FROM w WHERE len(w) >= 4)
    SELECT doc_id, CASE k WHEN 0 THEN w[1] || ',' || w[2] || ';' || w[3] || ',' || w[4] WHEN 1 THEN 'h,i;' || w[1] || ',' || w[2] WHEN 2 THEN w[3] || ',' || w[4] WHEN 3 THEN w[1] || ',' || w[2] || ';' || w[3] || ',' || w[4] ELSE '' END AS grid FROM k"""
)
def ar_grid(spark, d):
    w = lambda i: F.element_at("w", i)
    k = F.col("doc_id") % 5
    two = F.array(F.array(F.concat(F.lit(" "), w(1)), w(2)), F.array(w(3), F.concat(w(4), F.lit("\n"))))
    grid = F.when(k == 0, two)
    headers = F.when(k <= 1, F.array(F.lit("h"), F.lit("i")))
    rows = F.when(k <= 1, F.array(F.array(w(1), w(2)))).when(k == 2, F.array(F.array(w(3), w(4))))
    text = F.when(k == 4, "no table | here").otherwise(F.concat(F.lit("| "), w(1), F.lit(" | "), w(2), F.lit(" |\n|---|---|\nwords\n| "), w(3), F.lit(" | "), w(4), F.lit(" |")))
    cells = X.grid_of(grid, headers, rows, text)
    told = _words(spark, d).where("size(w) >= 4")
    return told.select("doc_id", F.array_join(F.transform(cells, lambda r: F.array_join(r, ",")), ";").alias("grid"))


@query(
    """WITH k AS (SELECT doc_id, ['search_documents', 'list_documents', 'get_page_context', 'read_sheet'][doc_id % 4 + 1] AS tool, text FROM documents)
    SELECT doc_id, md5(CASE tool WHEN 'search_documents' THEN text || chr(10) || '[1] = a.pdf (page ' || doc_id || ') [id: d' || doc_id || ']' || chr(10) || '[2] = unknown' WHEN 'list_documents' THEN left(text, 15000) WHEN 'get_page_context' THEN left(text, 25000) ELSE left(text, 2000) END) AS kept_md5 FROM k"""
)
def js_compact(spark, d):
    i = F.col("doc_id")
    tool = F.get(F.array(*map(F.lit, ("search_documents", "list_documents", "get_page_context", "read_sheet"))), (i % 4).cast("int"))
    cited = F.array(
        F.struct(F.lit("a.pdf").alias("filename"), i.alias("page"), F.concat(F.lit("d"), i.cast("string")).alias("document_id")),
        F.struct(F.lit(None).cast("string").alias("filename"), F.lit(None).cast("long").alias("page"), F.lit(None).cast("string").alias("document_id")),
    )
    content = F.when(i % 4 == 0, F.to_json(F.struct(F.col("text").alias("answer"), cited.alias("citations"), F.repeat(F.lit("x"), 3000).alias("debug")))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(R.compacted(tool, content).cast("binary")).alias("kept_md5"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) <= 10 - doc_id // 10 % 4 THEN upper(source) END AS result FROM documents")
def js_align(spark, d):
    # batches of ten; the reply of some batches is up to three results short, or longer than the batch
    g = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "source"))).alias("b"))
    results = F.slice(F.concat(F.transform("b", lambda x: F.upper(x["source"])), F.array_repeat(F.lit("beyond"), 3)), F.lit(1), (10 - F.col("batch") % 4).cast("int"))
    return g.select(F.explode(R.aligned(F.transform("b", lambda x: x["doc_id"]), results)).alias("p")).select(F.col("p.input").alias("doc_id"), F.when(F.col("p.result") != "beyond", F.col("p.result")).alias("result"))


@query("SELECT * FROM (VALUES ('db.url', 'pg://host/x'), ('db.user', '${UNSET_NAME}'), ('limit', '20')) t(setting, value)")
def src_config(spark, d):
    from ..sources.readers import load_config

    held = load_config('{"db": {"url": "pg://${DB_HOST}/x", "user": "${UNSET_NAME}"}, "limit": 20}', {"DB_HOST": "host"})
    flat = [(f"{k}.{n}", v[n]) for k, v in held.items() if isinstance(v, dict) for n in v] + [(k, str(v)) for k, v in held.items() if not isinstance(v, dict)]
    return spark.createDataFrame(flat, "setting string, value string")


@query("SELECT * FROM (VALUES ('list_documents', 'Documents of a language', 'lang:string'), ('find_orders', 'Orders of a customer', 'customer:long')) t(tool, description, arguments)")
def uf_agent_tool(spark, d):
    told = [(name, about, ",".join(f"{k}:{v}" for k, v in args.items())) for name, (about, args, _) in _TOOLS.items()]
    return spark.createDataFrame(told, "tool string, description string, arguments string")
