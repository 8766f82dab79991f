"""Tags of chunks: what they bring stays, what lacks is filled in by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import keyword_frequency

#: a summary needs a text of so many characters
LEAST_CHARS = 80


def first_sentence(text: Column) -> Column:
    """A text's first sentence, null where no mark ends one."""
    return F.nullif(F.trim(F.regexp_extract(text, "^[^.!?]*[.!?]", 0)), F.lit(""))


def tags(chunks: DataFrame, keys: list[str], text: str, *, defaults: dict[str, Column], summary: Column | None = None, stop: tuple[str, ...] = (), top: int = 5) -> DataFrame:
    """``chunks`` with the columns of ``defaults`` filled where null, keywords (the
    ``top`` most frequent words; null where there is none), summary and outcome:
    ``short`` where the text is too short to sum up, ``failed`` where no summary
    came, else ``done``. ``summary`` may come from a model; the rule is the first
    sentence. Short texts are not sent anywhere."""
    filled = chunks.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})
    short = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < LEAST_CHARS
    summed = filled.withColumn("summary", F.when(~short, first_sentence(F.col(text)) if summary is None else summary))
    told = summed.withColumn("outcome", F.when(short, "short").when(F.col("summary").isNull(), "failed").otherwise("done"))
    named = told.withColumn("_key", F.to_json(F.struct(*keys)))
    words = keyword_frequency(named, "_key", text, stop, top)
    listed = words.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))
    return named.join(listed, "_key", "left").drop("_key")


def outcomes(tagged: DataFrame, by: list[str]) -> DataFrame:
    """How many chunks there are, and how many were too short or failed."""
    count = lambda what: F.count_if(F.col("outcome") == what).alias(what)
    return tagged.groupBy(*by).agg(F.count("*").alias("chunks"), count("short"), count("failed"))
