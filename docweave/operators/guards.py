"""Guards: masking of personal data, injection tests, scores and verdicts."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import fold
from pyspark.sql.types import StringType

from .aggregates import BLOCK_AT, WARN_AT

# Payment handles
HANDLES = """okaxis okhdfcbank okicici oksbi ybl ibl axisbank upi paytm apl abfspay allbank aubank barodampay
centralbank dbs equitas fbl federal finobank hdfcbank icici idbi idfcbank indus jkb jsb karb kotak kvb lvb mahb
nsdl obc pingpay postpay pnb rbl sbi scb sib syndicate timecosmos uco union utbi vijb""".split()

# Patterns of personal data, in the order in which they are masked
PII = {
    "GSTIN": "\\b\\d{2}[A-Z]{5}\\d{4}[A-Z][A-Z\\d]Z[A-Z\\d]\\b",
    "PAN": "\\b[A-Z]{5}\\d{4}[A-Z]\\b",
    "AADHAAR": "\\b\\d{4}[\\s\\-]?\\d{4}[\\s\\-]?\\d{4}\\b",
    "CARD": "\\b(?:\\d[ \\-]?){15,16}\\b",
    "EMAIL": "\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}\\b",
    "UPI": "(?i)\\b[\\w.\\-]+@(" + "|".join(HANDLES) + ")\\b",
    "PHONE": "(?:\\+91|0)?[6-9]\\d{9}\\b",
}

# Patterns of injected instructions
INJECTION = [
    "ignore\\s+(all\\s+)?(previous|prior|above|earlier)\\s+(instructions?|prompts?|rules?)",
    "you\\s+are\\s+now\\s+(a|an)\\s+\\w+",
    "(system|human|assistant)\\s*:\\s*\\[",
    "</?(system|human|assistant|instruction|context)>",
    "new\\s+instructions?\\s*:",
    "disregard\\s+(all\\s+)?(previous|prior|your)\\s+(instructions?|rules?|training)",
    "DAN\\s+mode|do\\s+anything\\s+now",
    "jailbreak|prompt\\s+injection",
]
VERBS = "\\b(pretend|roleplay|imagine|act\\s+as|behave\\s+as|simulate|impersonate|forget\\s+everything)\\b"

# Points of rules
POINTS = {
    "regex_injection_match": 30,
    "structural_instruction_verb": 20,
    "pii_in_query": 25,
    "chunk_injection_found": 35,
    "groundedness_unsupported": 50,
    "pii_in_output": 30,
    "query_too_long": 100,
    "guard_crash_safe_reply": 100,
}


# what every text with such a value has
HINTS = {"GSTIN": "[A-Z]{5}[0-9]{4}[A-Z]", "PAN": "[A-Z]{5}[0-9]{4}[A-Z]", "AADHAAR": "[0-9]{4}[\\s\\-]?[0-9]{4}", "CARD": "(?:[0-9][ \\-]?){15}", "EMAIL": "@", "UPI": "@", "PHONE": "[6-9][0-9]{9}"}


def mask_pii(text: Column) -> Column:
    """Every value replaced by its label, in the order of the patterns. A text is
    rewritten only for patterns that a cheaper look says it may have."""

    def step(label: str, pattern: str):  # noqa: ANN202
        hint = HINTS[label]
        seen = (lambda x: F.contains(x, F.lit(hint))) if hint == "@" else (lambda x: x.rlike(hint))
        return lambda x: F.when(seen(x), F.regexp_replace(x, pattern, f"[{label} REDACTED]")).otherwise(x)

    out = text
    for label, pattern in PII.items():
        out = F.element_at(F.transform(F.array(out), step(label, pattern)), 1)  # the text so far, computed once
    return out


def pii_found(text: Column) -> Column:
    """Labels of what was masked. Text that others masked before is looked at."""
    found, out = [], text
    for label, pattern in PII.items():
        found.append(F.when(out.rlike(pattern), F.lit(label)))
        out = F.regexp_replace(out, pattern, f"[{label} REDACTED]")
    return F.array_compact(F.array(*found))


def has_injection(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in INJECTION))


def has_instruction_verb(text: Column) -> Column:
    return text.rlike("(?i)" + VERBS)


@F.pandas_udf(StringType())
def normalise(text):  # noqa: ANN001, ANN201
    """NFKC, no zero-width characters, HTML entities and code fences undone.
    Spark has no Unicode normalisation, so this runs over Arrow batches."""
    import html
    import re
    import unicodedata

    zero = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))

    def one(s):  # noqa: ANN001, ANN202
        if s is None:
            return None
        s = html.unescape(unicodedata.normalize("NFKC", s).translate(zero))
        return re.sub(r"```[a-zA-Z]*\n?(.*?)```", r"\1", s, flags=re.S)

    return text.map(one)


def check_input(queries: DataFrame, text_col: str = "text", max_chars: int = 2000, normal: Column | None = None) -> DataFrame:
    """Masked text, points and verdict of each query. Too long ones are blocked."""
    text, masked = F.coalesce(F.col(text_col), F.lit("")), F.col("masked")
    plain = masked if normal is None else normal
    queries = queries.withColumn("masked", mask_pii(text))  # once, for all that look at it
    fired = F.array_compact(
        F.array(
            F.when(masked != text, F.lit("pii_in_query")),
            F.when(has_injection(plain), F.lit("regex_injection_match")),
            F.when(has_instruction_verb(plain), F.lit("structural_instruction_verb")),
        )
    )
    points = F.create_map(*(F.lit(x) for kv in POINTS.items() for x in kv))
    long = F.length(text) > max_chars
    scored = queries.select("*", F.when(long, F.array(F.lit("query_too_long"))).otherwise(fired).alias("rules"))
    score = F.least(F.lit(100), F.reduce("rules", F.lit(0), lambda a, r: a + points[r]))
    verdict = F.when(F.col("score") >= BLOCK_AT, "block").when(F.col("score") >= WARN_AT, "warn").otherwise("allow")
    return scored.withColumn("score", score.cast("long")).withColumn("verdict", verdict)


def rollout_bucket(session: Column) -> Column:
    """SHA-256 of the session modulo 100, folded over its hexadecimal digits."""
    digits = F.split(F.sha2(session.cast("binary"), 256), "")
    return F.reduce(digits, F.lit(0), lambda a, c: (a * 16 + F.conv(c, 16, 10).cast("int")) % 100)


def applies(session: Column, percent: int) -> Column:
    if percent >= 100:
        return F.lit(True)
    if percent <= 0:
        return F.lit(False)
    return F.when(F.coalesce(session, F.lit("")) == "", F.lit(True)).otherwise(rollout_bucket(session) < percent)


def scan_chunks(chunks: DataFrame, text_col: str = "text", mask: str = "[CONTENT REDACTED]") -> DataFrame:
    """Retrieved texts with injected instructions are replaced and score points."""
    hit = has_injection(F.coalesce(F.col(text_col), F.lit("")))
    return chunks.select("*", hit.alias("injected"), F.when(hit, POINTS["chunk_injection_found"]).otherwise(0).cast("long").alias("points"), F.when(hit, F.lit(mask)).otherwise(F.col(text_col)).alias("safe_text"))


def quota(requests: DataFrame, key: str, ts: str, tokens: str, item: str, limit: int, minutes: int) -> DataFrame:
    """Which requests fit into the rolling quota of their session. A refused
    one uses nothing, so it is a fold over a session's requests in order: they
    stream through a task, and only those still in the window are held."""

    def step(state: dict, row: tuple) -> list[tuple]:
        name, us, size = row
        held = state["held"]
        while held and us - held[0][0] > minutes * 60_000_000:
            state["used"] -= held.popleft()[1]
        ok = state["used"] + size <= limit
        if ok:
            held.append((us, size))
            state["used"] += size
        return [(name, ok)]

    kind = requests.schema[item].dataType.simpleString()
    timed = requests.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_tokens", F.col(tokens).cast("long"))
    return fold(timed, [key], ["_us", item], [item, "_us", "_tokens"], lambda: {"held": deque(), "used": 0}, step, f"`{item}` {kind}, admitted boolean")


def ambiguity(hits: DataFrame, key: str, score: str, entity: str, order: str, delta: float = 0.12, first: int = 5) -> DataFrame:
    """Ambiguous: among the first hits close to the best, two entities or more."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc(score), order)
    top = hits.withColumns({"_r": F.row_number().over(w), "_best": F.max(score).over(Window.partitionBy(key))}).where(F.col("_r") <= first)
    near = top.where((F.col("_best") > 0) & (F.col("_best") - F.col(score) <= delta))
    return near.groupBy(key).agg((F.count_distinct(entity) >= 2).alias("ambiguous"), F.array_join(F.array_sort(F.collect_set(entity)), ",").alias("options"))
