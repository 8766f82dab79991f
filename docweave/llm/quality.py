"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a predicate over a text's metrics (true: the document fails). On
a sample each rule's cost is timed and its verdicts are kept; rules then run in
the order of rejection per cost, where a rule counts only what the rules before
it let through. A document leaves the cascade at the first rule it fails
(``CASE WHEN`` stops there, and but for the split into words a metric is computed
inside the branches that use it). The order changes what is paid, never which documents are kept: it is
taken anew in each run, so no result tells it.

The two base limits are rules like the others.

Words are runs of characters other than space and \\x09-\\x0D; a null or empty
text has none and so is too short. A line counts if it has a word. Every row is
judged for itself: null and repeated ids, repeated rows and other columns, of
whatever name, change nothing and pass through :func:`keep_good` as they are.
Very long texts are judged whole; an empty table gives an empty one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import cut, release

WINDOW = 8
_SPACE = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` is a
    lambda over arrays."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        # windows of one hash stand side by side once sorted; their places,
        # sorted again, each add the words up to the next place, at most width
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

        gaps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width))))
        return let(ordered, lambda s: let(places(s), lambda p: F.reduce(gaps(p), F.lit(0), lambda a, g: a + g)))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))

    def count(h: Column) -> Column:
        some = F.when(F.size(h) > width, let(windows(h), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0)))
        return F.coalesce(some, F.lit(0)).cast("long")

    return let(F.transform(words, lambda w: F.xxhash64(w)), count)


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def metrics(text: Column, words: Column | None = None) -> dict[str, Column]:
    """Expressions of a text (and its words, where they are at hand)."""
    known = F.coalesce(text, F.lit(""))
    split = words_of(text) if words is None else words
    return {
        "n_words": F.size(split).cast("long"),
        "word_chars": F.length(F.array_join(split, "")).cast("long"),
        "n_symbols": F.regexp_count(known, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_words(split),
        "n_lines": (F.regexp_count(known, F.lit("\n")) + 1).cast("long"),
        "n_capitals": F.regexp_count(known, F.lit("\\p{Lu}{2,}")).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """``fails`` makes a predicate of the columns of :func:`metrics`."""

    name: str
    fails: Callable[[Mapping[str, Column]], Column]


#: the base limits
SHORT = Rule("short", lambda m: m["n_words"] < 20)
REPEATED = Rule("repeated_words", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 30)


def default_rules() -> list[Rule]:
    """The base limits, symbols, doubled lines, odd words, shouting."""
    return [
        SHORT,
        REPEATED,
        Rule("symbols", lambda m: m["n_symbols"] * 10 > m["n_words"]),
        Rule("repeated_lines", lambda m: m["n_dup_lines"] * 10 > m["n_lines"] * 3),
        Rule("word_length", lambda m: (m["word_chars"] > m["n_words"] * 20) | (m["word_chars"] < m["n_words"] * 2)),
        Rule("shouting", lambda m: m["n_capitals"] * 10 > m["n_words"] * 3),
    ]


def by_gain(rules: list[Rule], cost: list[float], verdicts: dict[tuple[bool, ...], int]) -> list[Rule]:
    """The rules by rejection per cost, each among what those before it left;
    ``verdicts`` counts rows by which rules they fail."""
    order: list[int] = []
    left = dict(verdicts)
    while len(order) < len(rules):
        gain = {i: sum(n for v, n in left.items() if v[i]) / cost[i] for i in range(len(rules)) if i not in order}
        best = max(gain, key=lambda i: (gain[i], -cost[i], -i))
        order.append(best)
        left = {v: n for v, n in left.items() if not v[best]}
    return [rules[i] for i in order]


def ordered(docs: DataFrame, rules: list[Rule], *, text_col: str = "text", sample_rows: int = 1000) -> list[Rule]:
    """The rules in the order to run them, from a sample of about
    ``sample_rows`` rows (a bound on what is timed; every row still runs the
    cascade). A rule's cost is the shorter of two timed runs over the sample,
    less that of a run that only reads it."""
    total = docs.count()
    if not total or len(rules) < 2:
        return rules
    part = docs.select(F.col(text_col).alias("text"))
    part = part.sample(fraction=sample_rows / total, seed=7) if total > sample_rows else part
    part = cut(part.select("text", words_of(F.col("text")).alias("words")), "sample")
    m = metrics(F.col("text"), F.col("words"))

    def timed(column: Column) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            part.agg(F.max(column)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    reading = timed(F.length("text") + F.size("words"))
    cost = [max(timed(r.fails(m).cast("int")) - reading, 1e-3) for r in rules]
    flags = [F.coalesce(r.fails(m), F.lit(False)).alias(f"f{i}") for i, r in enumerate(rules)]
    seen = part.select(*flags).groupBy(*(f"f{i}" for i in range(len(rules)))).count().collect()
    release(part)
    return by_gain(rules, cost, {tuple(r[:-1]): r[-1] for r in seen})


def cascade(rules: list[Rule], m: Mapping[str, Column]) -> Column:
    """True where a rule fails; those after it are not looked at."""
    out = None
    for r in rules:
        out = F.when(r.fails(m), True) if out is None else out.when(r.fails(m), True)
    return F.lit(False) if out is None else out.otherwise(False)


def quality(docs: DataFrame, *, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000) -> DataFrame:
    """doc_id, the metrics, base_failed and kept, for every row of ``docs``.
    As all metrics are asked for, the cascade only saves the rest."""
    rules = default_rules() if rules is None else rules
    run = ordered(docs, rules, text_col=text_col, sample_rows=sample_rows)
    split = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), words_of(F.col(text_col)).alias("words"))
    m = metrics(F.col("text"), F.col("words"))
    told = split.select("doc_id", "text", *(m[c].alias(c) for c in METRICS))
    known = metrics(F.col("text")) | {c: F.col(c) for c in METRICS}
    base = SHORT.fails(known) | REPEATED.fails(known)
    return told.select("doc_id", *METRICS, base.alias("base_failed"), (~cascade(run, known)).alias("kept"))


def keep_good(docs: DataFrame, *, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = 1000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns."""
    run = ordered(docs, default_rules() if rules is None else rules, text_col=text_col, sample_rows=sample_rows)
    # nearly every rule asks for the words, so a text is split once; the rest is made where a rule asks
    return docs.where(let(words_of(F.col(text_col)), lambda w: ~cascade(run, metrics(F.col(text_col), w))))
