"""Search: dense, sparse and fused; expansion to pages; packing into answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.shared import shared_folder, spread
from .joins import fuse

#: rows of the query side up to which it is sent to every executor
BROADCAST_QUERIES = 10_000


def small(side: DataFrame, limit: int = BROADCAST_QUERIES) -> DataFrame:
    """The side marked for broadcast if it has at most ``limit`` rows; else as
    it is, and the planner shuffles both."""
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def dot(a: str, b: str):  # noqa: ANN201
    return F.reduce(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_top(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: the nearest vectors of each query. A stated set
    of queries is held against all vectors: every Arrow batch of vectors is a
    matrix product with a block of queries (``BROADCAST_QUERIES`` of them at most,
    by a hash of their ids), of which only the best k per query go on. Where there
    are more queries the vectors are read once for each block."""
    import numpy as np
    import pyarrow as pa

    def near(block: DataFrame) -> DataFrame:
        rows = block.toArrow()
        ids = rows.column("query_id").to_numpy().astype(np.int64)
        q = np.array(rows.column("vector").to_pylist(), np.float64).reshape(len(ids), -1)
        held = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches):
            ids, q = held.value
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                own = b.column(0).to_numpy(zero_copy_only=False)
                scores = q @ v.T
                n = min(k, b.num_rows)
                # ties at the border of the best n go by id, so all of them are kept
                border = np.partition(scores, -n, axis=1)[:, -n]
                row, col = np.nonzero(scores >= border[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(own[col]), pa.array(scores[row, col])], ["query_id", "id", "score"])

        return vectors.select("id", "vector").mapInArrow(run, "query_id long, id long, score double")

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector")
    n = asked.count()
    blocks = max(1, -(-n // BROADCAST_QUERIES))
    part = F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks if blocks > 1 else 1))
    parts = [near(asked.where(part == i)) for i in range(2 * blocks if blocks > 1 else 1)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return every.withColumn("score", F.round("score", 9)).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def postings(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf, n (words of the text)."""
    w = words(F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[^\\p{L}\\p{N}]+", " ")))
    listed = chunks.select(F.col(id_col).alias("id"), w.alias("w"))
    return listed.select("id", F.size("w").cast("long").alias("n"), F.explode("w").alias("term")).groupBy("id", "n", "term").agg(F.count("*").alias("tf"))


def bm25_weights(queries: DataFrame, index: DataFrame, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """side, id, term, tf, weight: every posting of the texts (side passage) with
    its saturated frequency, every term of the queries (side query) with its idf;
    the product of both, summed over a query's terms, is the score of ``bm25``."""
    texts = index.select("id", "n").dropDuplicates()
    stats = F.broadcast(texts.agg(F.count("*").alias("total"), F.avg("n").alias("mean")))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    passages = index.crossJoin(stats).select(F.lit("passage").alias("side"), "id", "term", "tf", gain.alias("weight"))
    asked = small(queries.select("term").dropDuplicates())
    df = index.join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    held = F.coalesce(F.col("df"), F.lit(0))
    idf = F.log(1 + (F.col("total") - held + 0.5) / (held + 0.5))
    wanted = queries.join(df, "term", "left").crossJoin(stats)
    return passages.unionByName(wanted.select(F.lit("query").alias("side"), "id", "term", "tf", idf.alias("weight")))


#: (query, term) pairs that are scored in one pass over the texts' postings
QUERY_TERMS = 8_000


def _terms_of(chunks: DataFrame, id_col: str, text_col: str, terms) -> DataFrame:  # noqa: ANN001
    """id, n, codes, tf: for each text with words its length, and of the asked
    terms those it has, by their place in ``terms``. Texts are split once."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held = chunks.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        terms = held.value
        for b in batches:
            lists = b.column(1)
            n = lists.value_lengths().to_numpy()
            code = pc.index_in(lists.flatten(), value_set=terms).fill_null(-1).to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            key, tf = np.unique((row * (len(terms) + 1) + code)[code >= 0], return_counts=True)
            ends = np.searchsorted(key, np.arange(len(n) + 1) * (len(terms) + 1))
            listed = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), listed(key % (len(terms) + 1)), listed(tf)], ["id", "n", "codes", "tf"])

    w = words(F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[^\\p{L}\\p{N}]+", " ")))
    split = spread(chunks.select(F.col(id_col).cast("long").alias("id"), F.col(text_col))).select("id", w.alias("w")).where(F.size("w") > 0)
    return split.mapInArrow(run, "id long, n long, codes array<int>, tf array<int>")


def search(queries: DataFrame, chunks: DataFrame, id_col: str, text_col: str, k: int, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, score, rank: the best texts (by BM25) of each query (query_id,
    term).

    The queries are a stated set, held against all texts in blocks. Texts are split
    once, into a written table of the asked terms that each has. For a block of
    queries a batch of texts is a matrix of saturated frequencies, times one of
    weights; only the best ``k`` of a batch and ties with them leave the task, so no
    pair of a query and a text that is merely like it in some word is ever shuffled.
    """
    import math

    import numpy as np
    import pyarrow as pa

    spark = chunks.sparkSession
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "term").where("term is not null").dropDuplicates().toArrow()
    terms = asked.column("term").combine_chunks().unique() if asked.num_rows else pa.array([], pa.string())
    path = shared_folder(spark, "postings")
    _terms_of(chunks, id_col, text_col, terms).write.parquet(path)
    table = spark.read.parquet(path)
    stats = table.agg(F.count("*").alias("total"), F.avg("n").alias("mean")).first()
    df = np.zeros(len(terms))
    for r in table.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # no more rows than asked terms
        df[r["code"]] = r["count"]
    total, mean = stats["total"], stats["mean"] or 1.0
    idf = np.array([math.log(1 + (total - d + 0.5) / (d + 0.5)) for d in df])
    code = asked.column("term").combine_chunks().dictionary_encode().indices.to_numpy() if asked.num_rows else np.zeros(0, int)
    query = asked.column("query_id").to_numpy() if asked.num_rows else np.zeros(0, int)
    order = np.argsort(query, kind="stable")
    code, query = code[order], query[order]
    ids, first = np.unique(query, return_index=True)

    def scored(own, at, weights) -> DataFrame:  # noqa: ANN001
        """The best texts of the queries ``own``, whose terms are ``at``."""
        held = spark.sparkContext.broadcast((own, at, weights))

        def run(batches):
            own, at, weights = held.value
            place = np.full(len(idf) + 1, -1)
            place[at] = np.arange(len(at))
            step = max(1, (1 << 22) // max(1, len(at)))
            for big in batches:
                for s in range(0, big.num_rows, step):
                    b_ = big.slice(s, step)
                    texts, n = b_.column(0).to_numpy(zero_copy_only=False), b_.column(1).to_numpy()
                    row = np.repeat(np.arange(len(n)), b_.column(2).value_lengths().to_numpy())
                    col, tf = place[b_.column(2).flatten().to_numpy()], b_.column(3).flatten().to_numpy()
                    on = col >= 0
                    gains = np.zeros((len(n), len(at)))
                    gains[row[on], col[on]] = (tf * (k1 + 1) / (tf + k1 * (1 - b + b * n[row] / mean)))[on]
                    raw = (gains @ weights).T  # above 0 where any term is shared
                    score = np.round(raw, 6)
                    m = min(k, len(n))
                    border = np.partition(score, -m, axis=1)[:, -m]
                    q, t = np.nonzero((score >= border[:, None]) & (raw > 0))
                    yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(texts[t]), pa.array(score[q, t])], ["query_id", "id", "score"])

        return table.mapInArrow(run, "query_id long, id long, score double")

    blocks: list[DataFrame] = []
    begin = 0
    bounds = [*first[1:].tolist(), len(query)] if len(query) else []
    for i, end in enumerate(bounds):
        last = i + 1 == len(bounds)
        if last or bounds[i + 1] - first[begin] > QUERY_TERMS:
            part = slice(first[begin], end)
            at, col = np.unique(code[part], return_inverse=True)
            weights = np.zeros((len(at), i + 1 - begin))
            weights[col, np.searchsorted(ids[begin : i + 1], query[part])] = idf[code[part]]
            blocks.append(scored(ids[begin : i + 1], at, weights))
            begin = i + 1
    every = blocks[0] if blocks else spark.createDataFrame([], "query_id long, id long, score double")
    for more in blocks[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return every.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, candidates: int) -> DataFrame:
    """Both ranked lists fused; the constant is the number of candidates."""
    x = dense.select("query_id", "id", F.col("rank").alias("rx"))
    y = sparse.select("query_id", "id", F.col("rank").alias("ry"))
    both = fuse(x, y, ["query_id", "id"], "rx", "ry", k=candidates).withColumn("score", F.round("score", 9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return both.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def overlap_score(query: str, text: str):  # noqa: ANN201
    """The default reranker: the share of the query's words that the text has."""
    q, t = F.array_distinct(words(F.lower(F.col(query)))), F.array_distinct(words(F.lower(F.col(text))))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, k: int, score=None, least: float | None = None) -> DataFrame:  # noqa: ANN001
    """Hits (query, text) by a score, those under ``least`` dropped."""
    scored = hits.withColumn("rerank_score", F.round(overlap_score("query", "text") if score is None else score, 6))
    kept = scored if least is None else scored.where(F.col("rerank_score") >= least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank", "id"))
    return kept.withColumn("final", rank.cast("long")).where(F.col("final") <= k)


def is_thin(tokens: str, summary: str, kind: str, floor: int = 120):  # noqa: ANN201
    no_summary = F.trim(F.coalesce(F.col(summary), F.lit(""))) == ""
    return no_summary | F.coalesce(F.col(kind).isin("table", "list", "header"), F.lit(False)) | (F.coalesce(F.col(tokens), F.lit(0)) < floor)


def allowed(roles: str, wanted: list[str]):  # noqa: ANN201
    """Public rows, or those that share a role, but for case; without wanted roles all."""
    if not wanted:
        return F.lit(True)
    have = F.transform(F.coalesce(F.col(roles), F.array().cast("array<string>")), lambda r: F.lower(r))
    return (F.size(have) == 0) | F.arrays_overlap(have, F.array(*(F.lit(w.lower()) for w in wanted)))


def filtered_or_all(rows: DataFrame, key: str, soft):  # noqa: ANN001, ANN201
    """The rows that pass the soft filter; where none of a key does, all of it."""
    some = F.max(soft.cast("int")).over(Window.partitionBy(key))
    return rows.withColumn("_some", some).where(soft | (F.col("_some") == 0)).drop("_some")


def cited_indexes(answer):  # noqa: ANN001, ANN201
    """Numbers in brackets, ranges of fewer than 50 spelled out, page numbers not counted."""
    inside = F.regexp_extract_all(answer, F.lit("\\[([^\\]]+)\\]"), F.lit(1))
    clean = F.transform(inside, lambda c: F.regexp_replace(c, "(?i)\\b(?:p|pg|page)\\.?\\s*\\d+", ""))

    def numbers(c):  # noqa: ANN001, ANN202
        ranges = F.transform(F.regexp_extract_all(c, F.lit("\\b(\\d+\\s*-\\s*\\d+)\\b"), F.lit(1)), lambda r: F.transform(F.split(r, "-"), lambda x: F.trim(x).cast("int")))
        good = F.filter(ranges, lambda r: (r[0] <= r[1]) & (r[1] - r[0] < 50))
        spelled = F.flatten(F.transform(good, lambda r: F.sequence(r[0], r[1])))
        return F.concat(spelled, F.transform(F.regexp_extract_all(c, F.lit("\\b(\\d+)\\b"), F.lit(1)), lambda n: n.cast("int")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(clean, numbers))))


def page_texts(blocks: DataFrame) -> DataFrame:
    """document_id, page, page_text: the blocks of each page in order."""
    said = blocks.where(F.trim("text") != "")
    return said.groupBy("document_id", "page").agg(F.expr("listagg(trim(text), '\\n\\n') within group (order by block_order)").alias("page_text"))


def fallback_pages(hits: DataFrame, blocks: DataFrame, threshold: float, k: int = 2) -> DataFrame:
    """Where a query's best score is under the threshold its first ``k`` hits
    get the text of their page (kind page); all others stay (kind chunk)."""
    weak = hits.groupBy("query_id").agg((F.max("score") < threshold).alias("weak"))
    marked = hits.join(weak, "query_id").withColumn("open", F.col("weak") & (F.col("rank") <= k))
    wanted = marked.where("open").select("document_id", "page").dropDuplicates()
    pages = page_texts(blocks.join(wanted, ["document_id", "page"], "left_semi"))
    out = marked.join(pages, ["document_id", "page"], "left")
    grown = F.col("open") & F.col("page_text").isNotNull()
    return out.select("query_id", "id", "rank", F.when(grown, F.col("page_text")).otherwise(F.col("text")).alias("text"), F.when(grown, "page").otherwise("chunk").alias("kind"))


def force_expand(answers: DataFrame, hits: DataFrame, blocks: DataFrame, pages: int = 10) -> DataFrame:
    """For answers that refuse: the pages of the query's hits, best first, each
    once and at most ``pages`` of them, with their whole text. Sheets stay out."""
    from ..functions.text import is_refusal

    refused = answers.where(is_refusal(F.col("answer"))).select("query_id")
    own = hits.join(refused, "query_id", "left_semi").where(~F.coalesce(F.lower("filename"), F.lit("")).rlike("\\.xls[xm]?$"))
    first = own.groupBy("query_id", "document_id", "page").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "document_id", "page"))
    some = first.withColumn("place", place.cast("long")).where(F.col("place") <= pages)
    return some.join(page_texts(blocks.join(some.select("document_id", "page").dropDuplicates(), ["document_id", "page"], "left_semi")), ["document_id", "page"]).select("query_id", "document_id", "page", "place", "page_text")


def multi_rerank(hits: DataFrame, questions: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Hits of sub-questions (question, id, score): the best score of each text
    stays, and all texts of a question are ranked once, by the question itself."""
    best = hits.groupBy("question", "id").agg(F.max("score").alias("score"))
    both = best.join(small(questions), "question").join(texts, "id")
    scored = both.withColumn("rerank_score", F.round(overlap_score("query", "text"), 6))
    final = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("rerank_score"), F.desc("score"), "id"))
    return scored.withColumn("final", final.cast("long")).where(F.col("final") <= k).select("question", "id", "score", "rerank_score", "final")
