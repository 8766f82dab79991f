"""A corpus pipeline of five operators: each stage takes the documents that the
one before kept and returns documents; the last returns their encoding."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, decontaminate, near_dedup, quality, secrets
from docweave.llm._scratch import cut

#: SQL can't express the sketches, the automaton, the network or the merges
ORACLE_SQL = None


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``out`` with the columns of ``docs``, and n_chars of its texts."""
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def _plain_scan(docs: DataFrame) -> bool:
    """Whether the rows come straight from files, so that their places stay."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    return not re.search(r"Join|Aggregate|Sort|Repartition|Sample|Generate|Window|Union|Limit|Python|Arrow|Pandas|LocalRelation|LogicalRDD|Range|rand\(|uuid\(", re.sub(r"#\d+L?", "", plan))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go. Null and empty texts have no words and
    go; repeated rows and ids have one verdict each; other columns pass as they
    are, whatever their names."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group (five-word shingles, similarity of 0.8 or more) one row
    stays: that of the smallest doc_id, rows without one last, and among equal
    ids the first in the table. Rows are told apart by their place and not by
    their id: different texts of one id both stay, equal ones without ids are
    one. Rows without words link with none and stay. Other columns pass as they
    are. ``docs`` is read from files, as between stages; other frames are written
    first, so that places mean the same rows throughout."""
    if not _plain_scan(docs):
        docs = cut(docs, "docs")
    place = "place"
    while place in docs.columns:
        place += "_"
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    groups = near_dedup.near_duplicates(placed, width=5, num=80, den=100, id_col=place)
    several = groups.where("not kept and n_shingles > 0").select("component_id").distinct()
    members = groups.join(several, "component_id").select("component_id", F.col("doc_id").alias("at"))
    ids = placed.select(F.col(place).alias("at"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(place).alias("at")).alias("order"))
    members = cut(members.join(ids, "at"), "members")
    first = members.groupBy("component_id").agg(F.min("order").alias("first"))
    gone = cut(members.join(first, "component_id").where("at <> first.at").select(F.col("at").alias(place)), "gone")
    return placed.join(gone, place, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str, *, cut_spans: bool = False) -> DataFrame:
    """Contaminated documents go; others stay as they are. With ``cut_spans``
    no document goes: contaminated ones lose the benchmark's passages instead
    (a text that was nothing else becomes empty), and n_chars follows."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    if not cut_spans:
        return decontaminate.keep_clean(docs, benchmark)
    return _counted(decontaminate.remove_spans(docs, benchmark), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows it. No row goes; null and
    empty texts stay as they are, and so do other columns and repeated rows."""
    return _counted(secrets.redact(docs), docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of ids and decoded texts, a row for every
    row; null texts count as empty; other columns end here."""
    return bpe.encode(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json")).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("bpe encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return docs
