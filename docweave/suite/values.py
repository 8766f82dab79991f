"""Nested values and model calls over the shared tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import nested as N
from ..plans import models
from ..registry import query, table

_SAID = "'{\"a\":{\"list\":[' || user_id % 3 || ',{\"x\":' || k || ',\"y\":\"' || event_type || '\"}],\"z\":null},\"b\":' || user_id % 2 || '}'"
_ARGS = "e AS (SELECT event_id, event_type, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4 AS k FROM events)"


def _calls(spark, d):
    """Calls whose arguments come with their keys in one order or another, with blanks."""
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", (F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 4).alias("k"))
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    b, one, kind, k = s(F.col("user_id") % 2), s(F.col("user_id") % 3), F.col("event_type"), s("k")
    forward = F.concat(F.lit('{"a": {"z": null, "list": ['), one, F.lit(', {"y": "'), kind, F.lit('", "x": '), k, F.lit('}]}, "b": '), b, F.lit("}"))
    back = F.concat(F.lit('{"b":'), b, F.lit(',"a":{"list":['), one, F.lit(',{"x":'), k, F.lit(',"y":"'), kind, F.lit('"}],"z":null}}'))
    broken = F.concat(F.lit('{"a": '), k)
    n = F.col("event_id") % 3
    return e.select("event_id", "event_type", F.when(n == 0, forward).when((n == 1) | (F.col("event_id") % 7 != 0), back).otherwise(broken).alias("args"))


@query(f"WITH {_ARGS}, c AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 2 AND event_id % 7 = 0 THEN NULL ELSE {_SAID} END AS args FROM e), o AS (SELECT DISTINCT event_type, args FROM c WHERE event_id % 20 = 0 AND args IS NOT NULL) SELECT event_id, c.args AS args_key, o.args IS NOT NULL AS approved FROM c LEFT JOIN o ON o.event_type = c.event_type AND o.args = c.args")
def fn_args_key(spark, d):
    calls = _calls(spark, d)
    told = N.approved(calls, calls.where("event_id % 20 = 0"), "event_type", "args")
    return told.select("event_id", N.canonical(F.col("args")).alias("args_key"), "approved")


@query(
    """WITH f AS (SELECT c_custkey AS id, unnest(['name', 'limits.balance', 'limits.tags[0]', 'limits.tags[1].nation', 'empty']) AS path,
      unnest(['"' || c_name || '"', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), '"a"', CAST(c_nationkey AS VARCHAR), '{}']) AS value FROM customer),
    x AS (SELECT c_custkey AS id, unnest(['limits.balance', 'extra', 'unknown']) AS path, unnest(['0', 'true', '1']) AS value FROM customer WHERE c_nationkey % 3 = 0)
    SELECT coalesce(f.id, x.id) AS id, coalesce(f.path, x.path) AS path, coalesce(x.value, f.value) AS value FROM f FULL JOIN x ON f.id = x.id AND f.path = x.path WHERE f.id IS NOT NULL OR x.path = 'extra'"""
)
def prj_settings(spark, d):
    c = table(spark, d, "customer")
    s = lambda x: x.cast("string")
    text = F.concat(F.lit('{"name": "'), F.col("c_name"), F.lit('", "empty": {}, "limits": {"tags": ["a", {"nation": '), s(F.col("c_nationkey")), F.lit('}], "balance": '), s(F.floor("c_acctbal")), F.lit("}}"))
    flat = N.flat_settings(c.select("c_custkey", text.alias("settings")), "c_custkey", "settings")
    changed = F.explode(F.create_map(*map(F.lit, ("limits.balance", "0", "extra", "true", "unknown", "1")))).alias("path", "value")
    changes = c.where("c_nationkey % 3 = 0").select(F.col("c_custkey").alias("id"), changed)
    return N.apply_settings(flat, changes, optional=("extra",))


class _Digests:
    """Stands for a model that takes texts up to a length and is busy at times."""

    def __init__(self, name: str, most: int):
        self.name, self.most, self.calls = name, most, 0

    def __call__(self, texts: list[str]) -> list[str]:
        self.calls += 1
        if self.calls % 5 == 1:
            raise models.Retry("busy")
        if any(len(t) > self.most for t in texts):
            raise models.Refused("too long")
        return [hashlib.md5(t.encode()).hexdigest() for t in texts]  # noqa: S324


@query("SELECT doc_id AS id, CASE WHEN length(text) <= 9000 THEN md5(text) END AS value, CASE WHEN length(text) <= 1500 THEN 'short' WHEN length(text) <= 9000 THEN 'long' END AS provider, CASE WHEN length(text) > 9000 THEN 'long: too long' END AS error FROM documents")
def uf_model(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return models.call_models(docs, "doc_id", "text", lambda: [_Digests("short", 1500), _Digests("long", 9000)], batch=16, backoff=0.0).drop("calls")
