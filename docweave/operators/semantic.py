"""Chunks that end where the topic shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: a sentence with the marks that end it, or a rest without any; word separators
SENTENCE = "[^.!?]*[.!?]+|[^.!?]+"
WORD = "[^ \\t\\n\\r.,;:!?]+"


def _likeness(a: Column, b: Column) -> Column:
    """Shared words in ten-thousandths of all words of both."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0).otherwise(F.floor(F.size(F.array_intersect(a, b)) * 10_000 / union)).cast("long")


def semantic_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 3, percent: int = 10, least: int = 5, size: int = 200) -> DataFrame:
    """id, chunk (from 0), n_words, text.

    Between any two sentences the ``window`` sentences before are held against
    those after, by shared words. A gap as unlike as the least ``percent`` percent
    of its text's gaps (rounded up) ends a chunk. Texts of fewer than ``least``
    sentences have no gaps to compare and are one stretch. Stretches of more than
    ``size`` words are cut before the sentence that begins beyond each ``size``.

    Null texts and texts without words give no chunk. A row's text is split and
    compared within the row, in time linear in its length for a fixed window.
    """
    sentences = F.regexp_extract_all(F.col(text_col), F.lit(SENTENCE), F.lit(0))
    base = docs.select(F.col(id_col), sentences.alias("s")).withColumn("w", F.transform("s", lambda x: F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0))))
    n = F.size("s")
    part = lambda first, last: F.array_distinct(F.flatten(F.slice("w", first, last - first + 1)))
    gaps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: _likeness(part(F.greatest(F.lit(1), i - window + 1), i), part(i + 1, F.least(n, i + window))))
    compared = base.withColumn("gaps", F.when(n >= max(2, least), gaps).otherwise(F.array().cast("array<bigint>")))
    at = F.ceil(F.size("gaps") * percent / 100).cast("int")
    limit = F.when(at > 0, F.element_at(F.array_sort("gaps"), at))
    told = compared.withColumn("limit", limit).select(id_col, "gaps", "limit", F.posexplode("s").alias("i", "sentence"), "w")
    rows = told.select(id_col, "i", "sentence", F.size(F.get("w", F.col("i"))).alias("n"), F.coalesce(F.get("gaps", F.col("i") - 1) <= F.col("limit"), F.lit(False)).cast("int").alias("shift"))
    before = Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stretch", F.sum("shift").over(before))
    inside = Window.partitionBy(id_col, "stretch").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("piece", F.floor((F.sum("n").over(inside) - F.col("n")) / size))
    pieces = rows.groupBy(id_col, "stretch", "piece").agg(F.sum("n").alias("n_words"), F.expr("listagg(sentence, '') within group (order by i)").alias("text")).where("n_words > 0")
    number = F.row_number().over(Window.partitionBy(id_col).orderBy("stretch", "piece")) - 1
    return pieces.select(id_col, number.cast("long").alias("chunk"), F.col("n_words").cast("long").alias("n_words"), F.trim(F.col("text"), F.lit(" \t\n\r")).alias("text"))
