"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows with equal texts form a group and stay together, unless the group alone
is more than half a shard in some measure; then it is dealt in pieces by
a hash of the row's place in a written table. A group of at least a 64th of a
shard is packed by its own vector; smaller ones are gathered by a hash into a
fixed number of bundles. So what is packed is at most ``bundles`` vectors, a
number of groups that the shards alone bound, and their pieces, whatever the
table's size. They are placed largest first, each in the
shard where the dot product of its vector and the shard's residual capacity is
highest; a shard whose bytes are used up comes only after all others.

Places in a shard follow from counts of parts of shards, so no task ever sorts
a whole shard.

One row comes out for every row. Nulls: a null text has no bytes and no tokens;
all null texts form one group. Rows with a null id, and rows that repeat an id,
are placed like others (no choice hangs on the id, so equal ones don't pile up).
Very long texts are one row of their size; other columns are not read; an empty
table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import cut

_SHARE = 2  # a group of over half a shard is dealt in pieces
_OWN = 64  # a group of at least this part of a shard is packed by itself


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector (columns: bytes, tokens, rows). The first
    column rules: a shard that has its fill of it takes no more."""
    total = np.maximum(vectors.sum(axis=0), 1)
    need = vectors / total * shards  # in shares of a shard
    out = np.zeros(len(vectors), np.int64)
    residual = np.ones((shards, vectors.shape[1]))
    for i in np.lexsort((np.arange(len(vectors)), -need.max(axis=1))):
        score = residual @ need[i]
        fits = residual[:, 0] >= need[i, 0]
        score = np.where(fits, score, -np.inf) if fits.any() else residual[:, 0]
        out[i] = at = int(score.argmax())
        residual[at] -= need[i]
    return out


def assign(docs: DataFrame, *, shards: int = 40, bundles: int = 4096, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """doc_id, size, n_tokens, text_crc32, group_id, shard, slot: one row for
    each row of ``docs``. ``tokens`` counts a text's tokens (words by default)."""
    spark = docs.sparkSession
    text = F.col(text_col)
    raw = F.coalesce(text, F.lit("")).cast("binary")
    count = F.regexp_count(text, F.lit("\\S+")) if tokens is None else tokens
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(raw) + 16).cast("long").alias("size"),
            F.coalesce(count, F.lit(0)).cast("long").alias("n_tokens"),
            F.crc32(raw).alias("text_crc32"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("group_id"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "rows",
    )
    sums = [F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows")]
    total = rows.agg(*sums).first()
    if not total["n_rows"]:
        return rows.drop("place").select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = F.greatest(*(F.col(c) * shards / max(total[c], 1) for c in ("size", "n_tokens", "n_rows")))
    groups = rows.groupBy("group_id").agg(*sums)
    # each of these has at least such a share of the table: there are few of them
    own = groups.where(share * _OWN >= 1).select("group_id", F.ceil(share * _SHARE).cast("int").alias("pieces"))
    bundle = F.pmod(F.xxhash64("group_id"), F.lit(bundles))
    piece = F.pmod(F.xxhash64("place"), F.col("pieces").cast("long"))
    keyed = rows.join(F.broadcast(own), "group_id", "left").withColumn(
        "unit", F.when(F.col("pieces") > 1, F.concat_ws("/", "group_id", piece)).when(F.col("pieces") == 1, F.col("group_id")).otherwise(bundle.cast("string"))
    )
    units = keyed.groupBy("unit").agg(*sums).orderBy("unit").toArrow()
    vectors = np.column_stack([units.column(c).to_numpy() for c in ("size", "n_tokens", "n_rows")])
    placed = list(zip(units.column("unit").to_pylist(), pack(vectors, shards).tolist()))
    where = F.broadcast(spark.createDataFrame(placed, "unit string, shard int"))
    # parts of a shard, few enough to sum up in one place and each short enough to sort
    parts = max(1, min(1024, total["n_rows"] // (shards * 32)))
    dealt = keyed.join(where, "unit").withColumn("part", F.pmod(F.xxhash64("place"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("shard", "part").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")
    starts = F.broadcast(sizes.select("shard", "part", before.alias("start")))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "place"))
    return dealt.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "n_tokens", "text_crc32", "group_id", "shard", (F.col("start") + place - 1).cast("long").alias("slot")
    )
