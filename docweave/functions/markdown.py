"""Markdown as pages are transcribed in: headings, pipe tables, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the lines of a transcription look like
ATX = "^#{1,6}\\s+(.+)$"
SETEXT = "^[=-]{3,}$"
PLACEHOLDER = "(?i)^\\[(image|figure|diagram|photo|illustration|chart|graphic)\\s*:"


def markdown_blocks(text: Column) -> Column:
    """Array of (type, text). Lines get a kind and a group (paragraph lines next to
    each other share one, as do the rows of a table); a group is one block. A
    paragraph in capitals under 100 characters is a heading; those without a
    letter or digit go, as do image placeholders and blank lines."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "^```[A-Za-z]*\\s*", ""), "\\s*```$", "")
    lines = F.transform(F.split(bare, "\r?\n"), lambda x: F.trim(x))

    def kinds(ls: Column) -> Column:
        def kind(s: Column, i: Column) -> Column:
            after, before = (F.coalesce(F.get(ls, i + k), F.lit("")) for k in (1, -1))
            row = s.startswith("|") & (F.contains(F.substring(s, 2, 1 << 30), F.lit("|")) | before.startswith("|"))
            plain = (before != "") & ~before.rlike(ATX) & ~before.rlike(PLACEHOLDER) & ~before.rlike(SETEXT) & ~before.startswith("|")
            # an underline is part of the line before it
            return (
                F.when((s == "") | s.rlike(PLACEHOLDER) | (s.rlike(SETEXT) & plain), "none")
                .when(s.rlike(ATX), "heading")
                .when(row, "table")
                .when(after.rlike(SETEXT) & ~s.rlike(SETEXT) & ~s.startswith("|"), "heading")
                .otherwise("text")
            )

        return F.transform(ls, lambda s, i: F.struct(kind(s, i).alias("kind"), F.when(s.rlike(ATX), F.trim(F.regexp_extract(s, ATX, 1))).otherwise(s).alias("text"), i.alias("i")))

    def groups(ks: Column) -> Column:
        starts = F.filter(ks, lambda k, i: (k["kind"] != "none") & ((k["kind"] == "heading") | (F.coalesce(F.get(ks, i - 1)["kind"], F.lit("")) != k["kind"])))

        def block(k: Column, j: Column) -> Column:
            upto = F.coalesce(F.get(starts, j + 1)["i"], F.size(ks))
            own = F.filter(F.slice(ks, k["i"] + 1, upto - k["i"]), lambda x: x["kind"] == k["kind"])
            texts = F.transform(own, lambda x: x["text"])
            said = F.when(k["kind"] == "table", F.array_join(texts, "\n")).otherwise(F.array_join(texts, " "))
            shout = (F.upper(said) == said) & (F.lower(said) != said) & (F.length(said) < 100)
            return F.struct(F.when((k["kind"] == "text") & shout, "heading").otherwise(k["kind"]).alias("type"), said.alias("text"))

        return F.transform(starts, block)

    once = lambda v, f: F.element_at(F.transform(F.array(v), f), 1)
    out = once(lines, lambda ls: once(kinds(ls), groups))
    return F.filter(out, lambda b: (b["text"] != "") & ((b["type"] != "text") | b["text"].rlike("[A-Za-z0-9]")))


def column_variants(name: Column) -> Column:
    """Sorted spellings of a column's name: as it is and before a bracket, each
    also in lower case, without spaces and with underscores; ``set up`` as one word."""
    stems = F.array_compact(F.array(name, *(F.when(F.contains(name, F.lit(c)), F.nullif(F.trim(F.substring_index(name, c, 1)), F.lit(""))) for c in "([")))
    joined = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "set up", "setup"), "Set up", "Setup"), "SET UP", "SETUP")
    every = F.concat(stems, F.transform(F.filter(stems, lambda v: F.contains(F.lower(v), F.lit("set up"))), joined))
    spelled = F.flatten(F.transform(every, lambda v: F.array(v, F.replace(v, F.lit(" "), F.lit("")), F.replace(v, F.lit(" "), F.lit("_")))))
    return F.array_sort(F.array_distinct(F.concat(spelled, F.transform(spelled, lambda v: F.lower(v)))))
