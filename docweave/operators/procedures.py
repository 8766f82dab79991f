"""Procedures in documents: sections, steps, boundaries, selection, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold

STEP = "^\\s*(?:\\(?([0-9]{1,3})[.)])\\s+\\S"
SECTION = "^\\s*([0-9]+\\.[0-9]+)\\s+([A-Za-z0-9 ()/,:.-]{3,80})"
# Verbs that open a step
VERBS = """remove loosen clean insert press click turn tighten check attach fix mount operate place release rotate
confirm apply grind screw lift close open start stop shut display input put scrape use extract push pull""".split()


def sections(blocks: DataFrame, open_pages: int = 10) -> DataFrame:
    """Numbered headings (the first of each number) with their pages: up to the
    page before the next section's, the last one ``open_pages`` more."""
    text = F.trim("text")
    number, title = F.regexp_extract(text, SECTION, 1), F.regexp_extract(text, SECTION, 2)
    found = blocks.where((number != "") & ~F.contains(text, F.lit("..."))).select("document_id", "block_order", "page", number.alias("number"), F.trim(F.regexp_replace(F.concat_ws(" ", number, title), "\\s+", " ")).alias("title"))
    first = Window.partitionBy("document_id", "number").orderBy("block_order")
    once = found.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    nxt = F.lead("page").over(Window.partitionBy("document_id").orderBy("block_order"))
    return once.withColumn("page_end", F.greatest("page", F.coalesce(nxt - 1, F.col("page") + open_pages)))


def steps(blocks: DataFrame) -> DataFrame:
    """Lines that open with a number, in order."""
    n = F.regexp_extract("text", STEP, 1)
    return blocks.where(n != "").select("document_id", "block_order", "page", n.cast("long").alias("step"), F.trim(F.regexp_replace("text", "^\\s*\\(?[0-9]{1,3}[.)]\\s+", "")).alias("instruction"))


def imperative_steps(blocks: DataFrame, dedup: int = 60) -> DataFrame:
    """Lines with a verb of action; of equal beginnings only the first."""
    acts = blocks.where(F.col("text").rlike("(?i)\\b(" + "|".join(VERBS) + ")\\b"))
    key = F.left(F.lower(F.trim("text")), F.lit(dedup))
    return acts.withColumn("_k", key).groupBy("document_id", "_k").agg(F.min("block_order").alias("block_order")).drop("_k")


def boundaries(blocks: DataFrame, marker: Column) -> DataFrame:
    """First and last page with a marker."""
    return blocks.where(marker).groupBy("document_id").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def grouped(steps_: DataFrame, order: str = "block_order") -> DataFrame:
    """A new group wherever the numbers start again."""
    w = Window.partitionBy("document_id").orderBy(order)
    again = F.coalesce((F.col("step") <= F.lag("step").over(w)).cast("int"), F.lit(1))
    return steps_.withColumn("_n", again).withColumn("group_no", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def selection(candidates: DataFrame, key: str, share: float = 0.3) -> DataFrame:
    """Sections by 3 × title overlap + body overlap, at least that share of the
    best; where half of all match, all stay."""
    score = 3 * F.size(F.array_intersect("query_words", "title_words")) + F.size(F.array_intersect("query_words", "body_words"))
    s = candidates.withColumn("score", score.cast("long"))
    w = Window.partitionBy(key)
    half = F.sum((F.col("score") > 0).cast("int")).over(w) * 2 >= F.count("*").over(w)
    return s.withColumns({"_half": half, "_best": F.max("score").over(w)}).where(F.col("_half") | ((F.col("score") > 0) & (F.col("score") >= share * F.col("_best")))).drop("_half", "_best")


def best_name(items: DataFrame, names: DataFrame, key: str, words: str, name: str, name_words: str) -> DataFrame:
    """The name that shares most words with each item (of equal ones the first)."""
    pairs = items.select(key, F.explode(F.array_distinct(words)).alias("w")).join(names.select(name, F.explode(F.array_distinct(name_words)).alias("w")), "w")
    hits = pairs.groupBy(key, name).agg(F.count("*").alias("common"))
    w = Window.partitionBy(key).orderBy(F.desc("common"), name)
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


TRANSITIONS = {
    ("idle", "view"): "offer",
    ("offer", "click"): "active",
    ("offer", "signup"): "overview",
    ("overview", "click"): "active",
    ("active", "click"): "active",
    ("active", "error"): "paused",
    ("paused", "click"): "active",
    ("active", "purchase"): "done",
    ("done", "view"): "offer",
}


def run_states(events: DataFrame, key: str, order: list[str], event: str, transitions: dict[tuple[str, str], str] | None = None, start: str = "idle") -> DataFrame:
    """The state after all events of each session, and how many changed it;
    unknown events leave the state. A session's events stream through its task."""
    table = transitions or TRANSITIONS

    def step(held: dict, row: tuple) -> tuple:
        to = table.get((held["state"], row[0]), held["state"])
        held["moves"] += to != held["state"]
        held["state"] = to
        return ()

    return fold(events, [key], order, [event], lambda: {"state": start, "moves": 0}, step, "state string, moves long", lambda h: [(h["state"], h["moves"])])


#: a number that opens a step: (3), 3., Step 3:, [3]
NUMBERED = "^\\s*(?:\\(([0-9]+)\\)|([0-9]+)\\.|(?i:step)\\s+([0-9]+)[:.]?|\\[([0-9]+)\\])"


def steps_by_page(blocks: DataFrame, extracted: DataFrame, *, start: str | None = None, empty: int = 2, least_chars: int = 20) -> DataFrame:
    """document_id, place, page, number, instruction: steps read page by page.

    ``extracted`` has (document_id, page, block_order, instruction), from a model
    or from rules. Pages of fewer than ``least_chars`` characters are passed over;
    with ``start``, a column of ``blocks``, so are those before it. Reading stops
    after ``empty`` pages in a row without a step, once one was found. A number
    that came before is left out; where any step has a number they are ordered by
    it, those without one last, and else stay in reading order.
    """
    chars = F.sum(F.length(F.trim("text"))).alias("chars")
    pages = blocks.where(F.length(F.trim("text")) > 0)
    pages = (pages.where(F.col("page") >= F.col(start)) if start else pages).groupBy("document_id", "page").agg(chars).where(F.col("chars") >= least_chars)
    found = extracted.groupBy("document_id", "page").agg(F.count("*").alias("steps"))
    read = pages.join(found, ["document_id", "page"], "left").withColumn("steps", F.coalesce("steps", F.lit(0)))
    order = Window.partitionBy("document_id").orderBy("page")
    # an island of empty pages: those since the last page with a step
    island = F.sum((F.col("steps") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = read.withColumn("island", island)
    place = F.row_number().over(Window.partitionBy("document_id", "island").orderBy("page"))
    ends = marked.withColumn("place", place).where((F.col("island") > 0) & (F.col("steps") == 0) & (F.col("place") == empty + 1))
    stop = ends.groupBy("document_id").agg(F.min("page").alias("stop"))
    kept = read.where("steps > 0").join(stop, "document_id", "left").where("stop is null or page < stop").select("document_id", "page")
    number = F.coalesce(*(F.nullif(F.regexp_extract("instruction", NUMBERED, k), F.lit("")) for k in (1, 2, 3, 4))).try_cast("long")
    steps_ = extracted.join(kept, ["document_id", "page"]).select("document_id", "page", "block_order", "instruction", number.alias("number"))
    again = F.row_number().over(Window.partitionBy("document_id", "number").orderBy("page", "block_order"))
    once = steps_.withColumn("again", again).where("number is null or again = 1")
    final = F.row_number().over(Window.partitionBy("document_id").orderBy(F.asc_nulls_last("number"), "page", "block_order"))
    return once.select("document_id", final.cast("long").alias("place"), "page", "number", "instruction")
