"""From blocks to chunks: windows of words, sections, tables row by row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CALLOUTS, markdown_table, n_tokens, words


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words that share ``overlap``; a text of no more words
    is one, as it is; none for an empty one."""
    step = max(1, size - overlap)

    def cut(w: Column) -> Column:
        n = F.size(w)
        starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda i: (i == 0) | (i - step + size < n))
        pieces = F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(F.trim(text))).otherwise(pieces)

    return F.element_at(F.transform(F.array(words(text)), cut), 1)


def chunk_id(document: Column, ordinal: Column) -> Column:
    """The same for the same document and place, in every run."""
    return F.sha2(F.concat_ws("|", document.cast("string"), ordinal.cast("string")).cast("binary"), 256)


def window_chunks(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """document_id, ordinal, text, token_count, chunk_id of every window."""
    cut = docs.select(F.col(id_col).alias("document_id"), F.posexplode(windows(F.col(text_col), size, overlap)).alias("ordinal", "text"))
    return cut.select("document_id", F.col("ordinal").cast("long").alias("ordinal"), "text", n_tokens(F.col("text")).alias("token_count"), chunk_id(F.col("document_id"), F.col("ordinal")).alias("chunk_id"))


def _level(text: str) -> int:
    import re

    m = re.match(r"(\d+(?:\.\d+)*)\b", text)
    return m[1].count(".") + 1 if m else 2


def _sections(blocks: pd.DataFrame, size: int, overlap: int) -> Iterator[tuple]:
    """(page, section, kind, text) of one document's chunks. A heading opens a
    section; headings without text of their own lead what comes next; tables and
    captions stand alone; a new page ends a stream; headings at the end go."""
    import re

    callout = re.compile(r"[\s<\[(*]*(" + "|".join(CALLOUTS) + r")[\s>\])*]*", re.I)
    held: list[str] = []
    page, only_headings = None, True
    path: list[str] = []
    opened: tuple[int, str] | None = None

    def stream() -> Iterator[tuple]:
        nonlocal held, page, only_headings, opened
        text = "\n".join(held).strip()
        if text and not only_headings:
            w = text.split()
            pieces = [text] if len(w) <= size else []
            at = 0
            while len(w) > size:
                pieces.append(" ".join(w[at : at + size]))
                if at + size >= len(w):
                    break
                at += max(1, size - overlap)
            for p in pieces:
                yield opened[0], opened[1], "text", p
        held, page, only_headings, opened = [], None, True, None

    for b in blocks.itertuples():
        text = (b.text or "").strip()
        if page is not None and b.page != page:
            if only_headings:
                page = b.page
            else:
                yield from stream()
        if b.type == "heading" and text and not callout.fullmatch(text):
            if not only_headings:
                yield from stream()
            path = [*path[: _level(text) - 1], text]
            opened = opened or (b.page, "")
            opened = (opened[0], " > ".join(path))
            held.append(text)
            page, only_headings = b.page, True
        elif b.type in ("table", "image_caption"):
            lead = "\n".join(held).strip() if only_headings else ""
            yield from stream()
            if text:
                yield b.page, " > ".join(path), b.type, f"{lead}\n{text}".strip()
        elif text:
            opened = opened or (b.page, " > ".join(path))
            if page is None:
                page = b.page
            held.append(text)
            only_headings = False
    yield from stream()


def section_chunks(blocks: DataFrame, size: int = 400, overlap: int = 60) -> DataFrame:
    """Chunks along sections. What a block becomes depends on those before it,
    so a document's blocks are folded in order; documents are independent, and
    one document's blocks fit into one Arrow group. Of equal chunks of a page
    only the first stays; scraps (bare numbers, three characters) go."""
    import re

    scrap = re.compile(r"\d+(-\d+)?|[ivxlcdm]+", re.I)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc = pdf["document_id"].iloc[0]
        seen, out = set(), []
        for page, section, kind, text in _sections(pdf.sort_values("block_order"), size, overlap):
            if len(text.split()) < 5 and kind == "text" and (len(text) <= 3 or scrap.fullmatch(text)):
                continue
            key = (page, " ".join(text.split()))
            if key not in seen:
                seen.add(key)
                out.append((doc, len(out), page, section, kind, text))
        return pd.DataFrame(out, columns=["document_id", "ordinal", "page", "section", "kind", "text"])

    return blocks.groupBy("document_id").applyInPandas(run, "document_id long, ordinal long, page long, section string, kind string, text string")


def row_groups(tables: DataFrame, headers: list[str], size: int) -> DataFrame:
    """Rows packed in order into parts whose text, header included, has at most
    ``size`` words; a single row that is longer is a part of its own. Greedy, so
    a fold over the rows; its state is the words of the open part and the first
    rows of the parts, and the parts are slices of the table where it stands."""
    head = F.array(*(F.lit(h) for h in headers))
    base = 2 * len(headers) + 1 + len(headers) + 1 + sum(len(h.split()) for h in headers)
    cost = lambda r: F.size(r) + 1 + F.reduce(F.transform(r, lambda c: F.size(words(c))), F.lit(0), lambda a, n: a + n)
    costs = F.transform("rows", lambda r, i: F.struct(cost(r).alias("n"), i.alias("i")))
    start = F.struct(F.lit(base).alias("used"), F.array(F.lit(0)).alias("firsts"))

    def step(acc: Column, row: Column) -> Column:
        fits = (acc["used"] + row["n"] <= size) | (acc["used"] == base)
        here = F.struct((acc["used"] + row["n"]).alias("used"), acc["firsts"].alias("firsts"))
        return F.when(fits, here).otherwise(F.struct((base + row["n"]).alias("used"), F.array_append(acc["firsts"], row["i"]).alias("firsts")))

    placed = tables.where(F.size("rows") > 0).select("table_id", "rows", F.reduce(costs, start, step)["firsts"].alias("firsts"))
    parts = placed.select("table_id", "rows", "firsts", F.posexplode("firsts").alias("p", "first"))
    after = F.coalesce(F.get("firsts", F.col("p") + 1), F.size("rows"))
    cut = parts.select("table_id", (F.col("p") + 1).cast("long").alias("part"), "first", F.slice("rows", F.col("first") + 1, after - F.col("first")).alias("own"))
    span = F.concat((F.col("first") + 1).cast("string"), F.lit("-"), (F.col("first") + F.size("own")).cast("string"))
    return cut.select("table_id", "part", F.size("own").cast("long").alias("n_rows"), span.alias("row_range"), markdown_table(head, F.col("own")).alias("text"))


def labelled_rows(tables: DataFrame, headers: list[str], label: str) -> DataFrame:
    """A chunk for each row with a first cell: ``[label: id] header: value | …``;
    rows without one continue the row before."""
    rows = tables.select("table_id", F.posexplode("rows").alias("r", "row"))
    past = Window.partitionBy("table_id").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.trim(F.get("row", 0)) != "", F.col("r")), ignorenulls=True).over(past)
    pairs = F.array_compact(F.array(*(F.when(F.get("row", i) != "", F.concat(F.lit(f"{h}: "), F.get("row", i))) for i, h in enumerate(headers) if i)))
    said = rows.withColumn("head", head).where("head is not null").select("table_id", "head", "r", F.get("row", 0).alias("id"), F.array_join(pairs, " | ").alias("details"))
    joined = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("r", "details"))), lambda x: x["details"]), lambda d: d != ""), " | ")
    out = said.groupBy("table_id", "head").agg(F.min_by("id", "r").alias("id"), joined.alias("details"))
    return out.select("table_id", F.col("head").cast("long").alias("row"), F.concat(F.lit(f"[{label}: "), "id", F.lit("] "), "details").alias("text"))


def warning_chunks(blocks: DataFrame) -> DataFrame:
    """Blocks with a severity word, as warnings."""
    word = F.regexp_extract("text", "(?i)\\b(DANGER|WARNING|CAUTION|NOTICE|MANDATORY|PROHIBITED)\\b", 1)
    out = blocks.withColumn("severity", F.initcap(word)).where(word != "")
    return out.withColumn("chunk", F.concat(F.lit("Warning Type: "), "severity", F.lit("\nText: "), F.trim("text")))


def model_columns(tables: DataFrame, headers: list[str], first: int) -> DataFrame:
    """A chunk for each column from ``first`` on: the label column with its values."""
    cells = tables.select("table_id", F.posexplode("rows").alias("r", "row"))
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("model"), F.get("row", i).alias("value")) for i, h in enumerate(headers) if i >= first)))
    long = cells.select("table_id", "r", F.get("row", 0).alias("name"), each.alias("x")).select("table_id", "r", "name", "x.*").where("value <> ''")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(": ", "name", "value").alias("t")))), lambda x: x["t"])
    return long.groupBy("table_id", "model").agg(F.array_join(listed, " | ").alias("text"))


def caption_confidence(kind: Column, conflated: Column) -> Column:
    """(confidence, exclude) of a caption by the kind of its figure."""
    base = 1.0 - F.when(kind == "unknown", 0.3).otherwise(0.0) - F.when(kind.isin("text", "blank", "decoration"), 0.1).otherwise(0.0) - F.when(conflated, 0.3).otherwise(0.0)
    score = F.round(F.greatest(F.lit(0.0), base), 6)
    return F.struct(score.alias("confidence"), ((score < 0.7) | F.coalesce(kind.isin("logo", "banner", "header_footer"), F.lit(False))).alias("exclude"))


def stitchable(tables: DataFrame) -> DataFrame:
    """Whether a table continues the one before: the next page, as many columns,
    that one low on its page (70 %) and this one high (30 %)."""
    w = Window.partitionBy("document_id").orderBy("block_order")
    before = {c: F.lag(c).over(w) for c in ("page", "n_columns", "y1")}
    ok = (F.col("page") == before["page"] + 1) & (F.col("n_columns") == before["n_columns"]) & (before["y1"] >= 0.7 * F.col("height")) & (F.col("y0") <= 0.3 * F.col("height"))
    return tables.withColumn("continues", F.coalesce(ok, F.lit(False)))


def stitch(tables: DataFrame) -> DataFrame:
    """Continued tables as one: number of parts and all rows in order."""
    past = Window.partitionBy("document_id").orderBy("block_order").rowsBetween(Window.unboundedPreceding, 0)
    group = F.sum((~F.col("continues")).cast("int")).over(past)
    g = stitchable(tables).withColumn("g", group)
    ordered = F.array_sort(F.collect_list(F.struct("block_order", "text")))
    return g.groupBy("document_id", "g").agg(F.min("block_order").alias("block_order"), F.count("*").alias("parts"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text")).drop("g")


def fingerprint(a: Column, b: Column) -> Column:
    """Column types of two tables: merge, separate or ambiguous."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    telling = F.filter(pairs, lambda p: p["a"].isin("num", "date") | p["b"].isin("num", "date"))
    clash = F.size(F.filter(telling, lambda p: p["a"] != p["b"]))
    n = F.size(telling)
    return F.when(n == 0, "ambiguous").when(clash == 0, "merge").when(clash > n * 0.3, "separate").otherwise("ambiguous")


def merge_continuation(lead: Column, headers: Column, rows: Column) -> Column:
    """Rows (lists of cells) of a table and of its next page (headers, rows): the
    next page's header goes if it repeats the lead's or only numbers its columns,
    else it is a row; repeated headers among its rows go too."""
    plain = lambda cells: F.transform(cells, lambda c: F.lower(F.trim(c)))
    repeats = lambda cells: (F.size(lead["headers"]) > 0) & (plain(cells) == plain(lead["headers"]))
    numbered = F.forall(headers, lambda c: F.trim(c).rlike("^([0-9]+|[Cc]ol(umn)?_?[0-9]+|)$"))
    own = F.when(~numbered & ~repeats(headers), F.array(headers)).otherwise(F.filter(F.array(headers), lambda _: F.lit(False)))
    return F.concat(lead["rows"], own, F.filter(rows, lambda r: ~repeats(r)))


def reuse_furniture(figures: DataFrame) -> DataFrame:
    """Figures in the top or bottom tenth of a page: those of one footprint
    (place, width, height) in a document take the caption of the first."""
    top, bottom = F.col("y0") < F.col("height") * 0.1, F.col("y1") > F.col("height") * 0.9
    place = F.when(top, "header").when(bottom, "footer")
    keyed = figures.withColumns({"place": place, "w": F.round(F.col("x1") - F.col("x0")), "h": F.round(F.col("y1") - F.col("y0"))})
    w = Window.partitionBy("document_id", "place", "w", "h").orderBy("page", "block_order")
    edge = F.col("place").isNotNull()
    out = keyed.withColumns({"reused": edge & (F.row_number().over(w) > 1), "first": F.first("caption").over(w)})
    return out.withColumn("caption", F.when(F.col("reused"), F.col("first")).otherwise(F.col("caption"))).drop("first", "w", "h")
