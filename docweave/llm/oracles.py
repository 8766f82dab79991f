"""SQL (DuckDB) for the rows of those queries that SQL can express in full."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = "[^\\x20\\x09-\\x0D]+"
_ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# all pairs that share a shingle, their similarity, and what each document reaches through links
OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 85 * (nx.n + ny.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id"""

OP4 = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS l FROM w),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM w WHERE len(w) >= 8),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
p AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS i FROM t) GROUP BY doc_id),
m AS (SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM w JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 10 > (length(text) - length(replace(text, chr(10), '')) + 1) * 3 OR word_chars > n_words * 20 OR word_chars < n_words * 2 OR len(regexp_extract_all(text, '\\p{{Lu}}{{2,}}')) * 10 > n_words * 3) AS kept FROM b"""

# windows of 13 words, or an item of fewer, as texts; every run of so many words of a document is looked up
OP9 = f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT DISTINCT item, least(len(w), 13) AS size, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 11, 2)), lambda k: array_to_string(w[k:k + 12], ' ')) END) AS win FROM i),
z AS (SELECT DISTINCT size FROM v),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
u AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS k, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))) AS win FROM d, z WHERE len(w) >= size),
h AS (SELECT doc_id, size, k, item FROM u JOIN v USING (size, win)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

# all phrases of up to three words with their counts; every cut of a candidate looked up
OP12 = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(CASE WHEN len(w) >= k THEN list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) ELSE [] END) AS phrase FROM w, (VALUES (1), (2), (3)) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE k > 1 AND f >= 10),
x AS (SELECT c.*, cut, array_to_string(s[1:cut], ' ') AS lp, array_to_string(s[cut + 1:k], ' ') AS rp FROM c, (VALUES (1), (2)) v(cut) WHERE cut < k),
y AS (SELECT x.*, fl.f AS l, fr.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(fl.f AS HUGEINT) * fr.f) AS BIGINT) AS score FROM x JOIN f fl ON fl.lang = x.lang AND fl.phrase = x.lp JOIN f fr ON fr.lang = x.lang AND fr.phrase = x.rp),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
o AS (SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, z.phrase) AS rank, z.phrase, a, l, r, score FROM z LEFT JOIN i ON i.lang = z.lang AND i.phrase = z.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000"""

# every query against every row, told apart by place
OP13 = """WITH v AS (SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.place <> c.place WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20"""

ORACLE_SQL = {"op1_near_dedup": OP1, "op4_quality_rules": OP4, "op9_decontamination": OP9, "op12_collocations": OP12, "op13_top_k": OP13}
