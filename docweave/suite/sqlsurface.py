"""The read-only SQL surface over the shared tables: each query is run through
the validator, so the whole SELECT language is at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.sql import run_readonly, validate
from ..registry import query, table

NAMES = "region nation customer supplier part orders lineitem events".split()


def _run(spark, d, statement, limit=1000):
    for n in NAMES:
        table(spark, d, n).createOrReplaceTempView(n)
    return run_readonly(spark, statement, limit)


_JOIN = "SELECT n_name, count(*) AS customers, CAST(sum(CASE WHEN o_orderkey IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name"


@query(_JOIN)
def sq_join(spark, d):
    return _run(spark, d, _JOIN)


_WINDOW = "SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer ORDER BY c_custkey LIMIT 500"


@query(f"SELECT c_custkey, c_nationkey, CAST(place AS INTEGER) AS place FROM ({_WINDOW})")
def sq_window(spark, d):
    return _run(spark, d, _WINDOW)


_SETS = "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 0"


@query(_SETS)
def sq_setops(spark, d):
    return _run(spark, d, _SETS)


_SUB = "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5) SELECT c_custkey, n FROM customer JOIN big ON c_custkey = o_custkey WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) ORDER BY n DESC, c_custkey LIMIT 300"


@query(_SUB)
def sq_subquery(spark, d):
    return _run(spark, d, _SUB)


_FULL = "SELECT coalesce(n_nationkey, s_nationkey) AS k, count(s_suppkey) AS suppliers FROM nation FULL OUTER JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY coalesce(n_nationkey, s_nationkey)"


@query(_FULL)
def sq_outer(spark, d):
    return _run(spark, d, _FULL)


_CROSS = "SELECT r_name, p.size AS size FROM region CROSS JOIN (SELECT DISTINCT p_size AS size FROM part WHERE p_size <= 3) p"


@query(_CROSS)
def sq_cross(spark, d):
    return _run(spark, d, _CROSS)


CASES = [
    ("SELECT 1", True),
    ("select * from a; drop table a", False),
    ("DELETE FROM a", False),
    ("SELECT 'drop table' AS x", True),
    ("SELECT 1 -- delete", True),
    ("WITH x AS (SELECT 1) SELECT * FROM x", True),
    ("SELECT pg_read_file('x')", False),
    ("SELECT * INTO b FROM a", False),
    ("EXPLAIN SELECT 1", True),
    ("", False),
]


@query("SELECT i, ok FROM (VALUES " + ", ".join(f"({i}::BIGINT, {str(ok).lower()})" for i, (_, ok) in enumerate(CASES)) + ") t(i, ok)")
def sq_validate(spark, d):
    def passes(s):
        try:
            validate(s)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(i, passes(s)) for i, (s, _) in enumerate(CASES)], "i long, ok boolean")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def sq_limit(spark, d):
    return _run(spark, d, "SELECT o_orderkey FROM orders ORDER BY o_orderkey", limit=25)


@query("SELECT DISTINCT n_name AS name, CAST(r_name AS VARCHAR) AS region FROM nation JOIN region ON n_regionkey = r_regionkey", name="sq_tables")
def sq_tables(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    n.select(F.col("n_name").alias("name"), F.col("r_name").alias("region")).createOrReplaceTempView("dw_places")
    return run_readonly(spark, "SELECT DISTINCT name, region FROM dw_places", limit=1000)
