"""Scalar text functions, as expressions over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- counting and cleaning


def words(text: Column) -> Column:
    """White-space separated words; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")


def n_tokens(text: Column) -> Column:
    """The count of words stands for the count of tokens."""
    return F.size(words(text)).cast("long")


def estimated_tokens(text: Column) -> Column:
    """A token for every four characters."""
    return F.floor(F.length(text) / 4).cast("long")


def clean_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def collapse_repeats(text: Column) -> Column:
    """A unit of one to three characters ten times or more becomes three of it."""
    return F.regexp_replace(text, "(.{1,3}?)\\1{9,}", "$1$1$1")


def truncate_utf8(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes of the text in UTF-8, no character cut in two."""
    raw = text.cast("binary")
    cuts = [F.substring(raw, 1, max(0, limit - k)).cast("string") for k in range(4)]
    whole = F.coalesce(*(F.when(F.is_valid_utf8(c), c) for c in cuts))
    return F.when(F.octet_length(text) <= limit, text).otherwise(whole)


def is_running_header(text: Column, top: Column) -> Column:
    """High on the page, little text, and a gap of 15 spaces or more in it."""
    return (top <= 60) & text.rlike(" {15,}") & (F.length(clean_spaces(text)) < 80)


def is_tiny(text: Column, tokens: Column, structured: Column) -> Column:
    """Under five tokens and a number or range, a roman numeral or three
    characters at most; tables and images are never tiny."""
    t = F.trim(F.coalesce(text, F.lit("")))
    bare = t.rlike("^[0-9]+(-[0-9]+)?$") | t.rlike("^[iIvVxXlLcCdDmM]+$") | (F.length(t) <= 3)
    return (tokens < 5) & ~structured & bare


# Full-width letters and digits, and what they stand for
FULL_WIDTH = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
ASCII_WIDTH = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def half_width(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH, ASCII_WIDTH)


def clean_cell(text: Column) -> Column:
    """Line-break tags become semicolons, other tags go."""
    plain = F.regexp_replace(F.regexp_replace(text, "(?i)<br\\s*/?>", "; "), "<[^>]+>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "\\s*;\\s*", "; "), "^[; ]+|[; ]+$", ""))


def strip_fences(text: Column) -> Column:
    inner = F.regexp_replace(F.trim(text), "^```[a-zA-Z]*\\s*", "")
    return F.trim(F.regexp_replace(inner, "\\s*```$", ""))


def strip_tags(markup: Column, limit: int = 5000) -> Column:
    """Text of markup: tags become spaces, spaces collapse, cut to ``limit``."""
    return F.substring(clean_spaces(F.regexp_replace(markup, "<[^>]+>", " ")), 1, limit)


def title_from_filename(name: Column) -> Column:
    """Drop the extension and leading dates or codes, spell separators as spaces."""
    stem = F.regexp_replace(name, "\\.[A-Za-z0-9]+$", "")
    stem = F.regexp_replace(stem, "^(?:[0-9]{4,8}[_-]+)+", "")
    return F.initcap(F.trim(F.regexp_replace(stem, "[_\\-]+", " ")))


# ---------------------------------------------------------------- codes and headings


# Fixed value: what stands in a text as a component code (letters and digits together)
CODE_TOKEN = "\\b(?=[A-Za-z0-9][A-Za-z0-9\\-*/.]{2,}\\b)(?=[A-Za-z0-9\\-*/.]*[A-Za-z])(?=[A-Za-z0-9\\-*/.]*\\d)[A-Za-z0-9][A-Za-z0-9\\-*/.]*\\b"


def component_codes(text: Column) -> Column:
    """Sorted distinct tokens of letters and digits together, upper case."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CODE_TOKEN), F.lit(0))
    codes = F.transform(found, lambda c: F.regexp_replace(F.upper(c), "^[.\\-]+|[.\\-]+$", ""))
    keep = F.filter(codes, lambda c: (F.length(c) >= 3) & ~F.regexp_replace(c, "\\.", "").rlike("^[0-9]+$"))
    return F.array_sort(F.array_distinct(keep))


def drawing_codes(text: Column) -> Column:
    """Codes as drawings have them: a letter or two with digits, or parts joined by hyphens."""
    token = "\\b[A-Z]{1,3}[0-9]{2,4}\\b|\\b[A-Z]{2,}-[A-Z0-9]+(?:-[A-Z0-9]+)*\\b|\\b[A-Z]{2,}[0-9]+[A-Z0-9]*\\b"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(token), F.lit(0))))


def heading_level(text: Column, box: Column | None = None) -> Column:
    """Dots of a leading number and one; else by the box's height and indent
    (in points, or in shares of the page where all four are at most 1); else 2."""
    number = F.regexp_extract(F.trim(text), "^(\\d+(?:\\.\\d+)*)\\b", 1)
    numbered = F.length(number) - F.length(F.regexp_replace(number, "\\.", "")) + 1
    out = F.when(number != "", numbered)
    if box is not None:
        share = F.forall(box, lambda v: (v >= 0) & (v <= 1))
        high, deep = F.when(share, 0.02).otherwise(12.0), F.when(share, 0.10).otherwise(75.0)
        shaped = F.when(box[3] - box[1] >= high, 1).when(box[0] >= deep, 3).otherwise(2)
        out = out.when(F.size(box) == 4, shaped)
    return out.otherwise(2).cast("long")


# Words of callouts that aren't headings
CALLOUTS = ("IMPORTANT", "NOTE", "ONE POINT", "WARNING", "CAUTION", "DANGER")


def is_callout(text: Column) -> Column:
    return text.rlike("(?i)^[\\s<\\[(*]*(" + "|".join(CALLOUTS) + ")[\\s>\\])*]*$")


def callout_format(text: Column) -> Column:
    """``<NOTE> …`` as a bold callout."""
    return F.regexp_replace(text, "(?i)<(" + "|".join(CALLOUTS) + ")>\\s*", "**$1:** ")


def list_item(text: Column, marker: Column) -> Column:
    """The marker in front, unless the text has it."""
    return F.when(F.startswith(F.trim(text), marker), F.trim(text)).otherwise(F.concat(marker, F.lit(" "), F.trim(text)))


# ---------------------------------------------------------------- broken text

# Glyphs that text recognition leaves, and the shares of them and of
# words without a vowel above which a text or line counts as garbled
_STRAY = "[À-ÿƐ-ʒ¿¶]"
_LONG = "[A-Za-z]{4,}"


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _stray_share(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_STRAY)) / F.greatest(F.regexp_count(text, F.lit("[A-Za-z]")), F.lit(1))


def is_garbled(text: Column, threshold: float = 0.25) -> Column:
    """Stray glyphs over a twentieth of the letters, or many words without a vowel."""
    text = F.coalesce(text, F.lit(""))
    long_words = F.regexp_extract_all(text, F.lit(_LONG), F.lit(0))
    mute = F.size(F.filter(long_words, lambda w: ~w.rlike("[aeiouAEIOU]")))
    enough = F.regexp_count(text, F.lit("\\S+")) >= 4
    return enough & ((_stray_share(text) > 0.05) | ((F.size(long_words) >= 6) & (mute >= F.size(long_words) * threshold)))


def is_garbled_line(line: Column) -> Column:
    long_words = F.regexp_extract_all(line, F.lit(_LONG), F.lit(0))
    n = F.size(long_words)
    mute = F.size(F.filter(long_words, lambda w: ~w.rlike("[aeiouAEIOU]")))
    runs = F.size(F.filter(long_words, lambda w: (F.length(w) >= 5) & w.rlike("(?i)[^aeiouy]{4,}")))
    return (_stray_share(line) > 0.08) | ((n >= 2) & ((mute >= n * 0.5) | (runs >= n * 0.4)))


def is_unreliable(text: Column, share: float = 0.12) -> Column:
    """A garbled page, or one with that share of garbled lines."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.trim(x)) >= 8)
    bad = F.size(F.filter(lines, is_garbled_line))
    return is_garbled(text) | ((F.size(lines) >= 3) & (bad >= F.size(lines) * share))


def control_share(text: Column) -> Column:
    """Share of control and replacement characters."""
    return _share(F.regexp_count(text, F.lit("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\uFFFD]")), F.length(text))


# ---------------------------------------------------------------- classification


def has_keyword(text: Column, keywords: list[str]) -> Column:
    import re

    return F.coalesce(F.lower(text), F.lit("")).rlike("\\b(" + "|".join(re.escape(k.lower()) for k in keywords) + ")\\b")


# Keywords of industries, in order of preference
INDUSTRIES = {
    "automotive": ["toyota", "ford", "bmw", "vehicle", "engine", "torque", "transmission", "chassis", "automotive"],
    "electronics": ["circuit", "pcb", "schematic", "voltage", "resistor", "capacitor", "signal", "semiconductor"],
    "manufacturing": ["assembly", "drawing", "tolerance", "weld", "machining", "fixture", "jig", "bom", "part number"],
    "finance": ["balance sheet", "revenue", "profit", "ledger", "audit", "fiscal", "equity", "financial statement"],
    "legal": ["contract", "agreement", "clause", "liability", "indemnity", "arbitration", "jurisdiction"],
    "healthcare": ["patient", "diagnosis", "clinical", "pharma", "dosage", "trial", "medical", "drug", "therapy"],
}


def industry(text: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """The first industry that has a keyword in the text."""
    return F.coalesce(*(F.when(has_keyword(text, k), F.lit(name)) for name, k in (keywords or INDUSTRIES).items()))


def evidence_supported(evidence: Column, source: Column) -> Column:
    """Whether the phrase stands in the source, but for case and punctuation."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "), " +", " ")
    phrase = F.trim(plain(evidence))
    return F.coalesce((phrase != "") & F.contains(plain(source), phrase), F.lit(False))


def coerce_type(raw: Column, known: list[str]) -> Column:
    """A known type: the whole text, else the one named first (the longest of
    several there); else a single word as it is; else ``report``."""
    value = F.trim(F.lower(F.coalesce(raw, F.lit(""))))
    plain = F.concat(F.lit(" "), F.regexp_replace(value, "[^a-z0-9]+", " "), F.lit(" "))
    hits = F.array(*(F.struct(F.nullif(F.instr(plain, f" {t.replace('_', ' ')} "), F.lit(0)).alias("at"), F.lit(-len(t)).alias("n"), F.lit(t).alias("t")) for t in known))
    first = F.array_min(F.filter(hits, lambda h: h["at"].isNotNull()))["t"]
    single = (value != "") & ~F.contains(F.trim(plain), F.lit(" ")) & ~F.contains(value, F.lit("/"))
    return F.when(value.isin(known), value).otherwise(F.coalesce(first, F.when(single, value), F.lit("report")))


# Document types by words of their text, in order of preference
TYPE_WORDS = {
    "invoice": ["invoice", "bill to", "amount due"],
    "purchase_order": ["purchase order", "po number"],
    "financial_statement": ["balance sheet", "income statement", "profit and loss"],
    "datasheet": ["datasheet", "specifications", "rated voltage"],
    "presentation": ["agenda", "slide "],
    "contract": ["agreement", "terms and conditions"],
    "research_paper": ["abstract", "references", "doi:"],
}


def guess_type(text: Column, file_type: Column | None = None, type_words: dict[str, list[str]] | None = None) -> Column:
    """(type, confidence) by the first type one of whose words the text has."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, ws in (type_words or TYPE_WORDS).items():
        hit = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in ws))
        value = F.struct(F.lit(name).alias("doc_type"), F.lit(0.6).alias("confidence"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    if file_type is not None:
        out = out.when(file_type == "image", F.struct(F.lit("image").alias("doc_type"), F.lit(0.6).alias("confidence")))
    return out.otherwise(F.struct(F.lit("report").alias("doc_type"), F.lit(0.5).alias("confidence")))


def cell_type(cell: Column) -> Column:
    s = F.trim(F.coalesce(cell, F.lit("")))
    return (
        F.when(s == "", "empty")
        .when(s.rlike("\\d{1,4}[/-]\\d{1,4}"), "date")
        .when(s.rlike("^[\\d.,$%/+\\-\\s]+$"), "num")
        .when((F.length(s) <= 4) & s.rlike("\\d"), "code")
        .otherwise("text")
    )


# ---------------------------------------------------------------- tables


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.trim(F.regexp_replace(c, "\n", " "))), " | "), F.lit(" |"))


def markdown_table(headers: Column, rows: Column) -> Column:
    """Headers, a separator and the rows as a pipe table."""
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.concat_ws("\n", markdown_row(headers), rule, F.array_join(F.transform(rows, markdown_row), "\n"))


def parse_markdown(text: Column) -> Column:
    """Rows of cells of a pipe table, without separator rows."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    cut = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), "^\\|+|\\|+$", ""), "\\|"), clean_cell))
    return F.filter(cut, lambda r: ~F.forall(r, lambda c: c.rlike("^[-: ]+$")))


def grid_of(grid: Column, headers: Column, rows: Column, text: Column) -> Column:
    """Cells of a table, cleaned: of its grid, else of headers and rows, else of
    the rows alone, else of the pipe rows of its text; an empty array if none has any."""
    some = lambda a: F.when(F.size(a) > 0, a)
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & x.endswith("|") & ~x.rlike("^\\|[\\s:|-]+\\|$"))
    cut = F.transform(lines, lambda x: F.split(F.substring(x, F.lit(2), F.length(x) - 2), "\\|"))
    with_head = F.when(F.size(headers) > 0, F.concat(F.array(headers), some(rows)))
    raw = F.coalesce(some(grid), with_head, some(rows), some(cut), F.array().cast("array<array<string>>"))
    clean = F.transform(raw, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))))
    return F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))


# ---------------------------------------------------------------- questions and answers


def embed_input(summary: Column, keywords: Column, text: Column) -> Column:
    """What is embedded: summary, keywords and text, those that there are."""
    listed = F.when(F.size(keywords) > 0, F.concat(F.lit("Keywords: "), F.array_join(keywords, ", ")))
    return F.concat_ws("\n", F.nullif(summary, F.lit("")), listed, text)


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(F.reduce(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


# Markers of a refusal
REFUSALS = ("i don't know", "i do not know", "not found in", "no information", "cannot find", "could not find", "not available in", "unable to find")


def is_refusal(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in REFUSALS))


GREETINGS = ("hi", "hello", "hey", "good morning", "good afternoon", "good evening", "thanks", "thank you")


def is_greeting(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z ]", "")).isin(*GREETINGS)


def is_broad(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?i)\\b(list all|all the|every|overview|summar(y|ise|ize)|compare|everything)\\b")


def has_steps(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?is)(^|\\n)\\s*(step\\s+\\d+|\\(?\\d+[.)])\\s+\\S")


def column_letter(n: Column) -> Column:
    """1 → A, 26 → Z, 27 → AA (up to three letters)."""
    one = F.char((65 + (n - 1) % 26).cast("int"))
    rest = F.floor((n - 1) / 26)
    two = F.char((65 + (rest - 1) % 26).cast("int"))
    rest2 = F.floor((rest - 1) / 26)
    three = F.char((65 + (rest2 - 1) % 26).cast("int"))
    return F.when(n <= 26, one).when(n <= 702, F.concat(two, one)).otherwise(F.concat(three, two, one))


def retry_seconds(message: Column) -> Column:
    """Seconds to wait that an error message names."""
    found = F.regexp_extract(F.coalesce(message, F.lit("")), "(?i)(?:retry|try again)[^0-9]{0,20}([0-9]+(?:\\.[0-9]+)?)\\s*s", 1)
    return F.nullif(found, F.lit("")).cast("double")
