"""Near-duplicate groups from bottom-k sketches of one hash function.

1. Every text becomes its set of distinct word shingles (64-bit hashes), the
   set's digest and a sketch: the ``k`` smallest hashes. Texts with equal sets
   form a class at once (aggregated, so a class of any size is one row).
2. Two sets of the required similarity share at least ``c`` retained values
   (exactly, where the sketch is the whole set; else but for a chance of
   2.3 in a million at the threshold itself, and far below above it). So they
   share one of the ``s - c + 1`` first values in any common order; with
   frequent values last, the inverted lists of shared passages stay out.
3. Every list links its members to two pivots, and lists that then still have
   members of several components to eight more. A pair passes if the estimate
   from the union's sketch may reach the threshold (but for 5.2 in a million), and is a link if the
   Jaccard similarity of the full sets does.
4. Components of the links follow from min-label propagation with pointer
   jumping. Members of one list that are still in different components are
   then held against each other, so no link between components is missed, and
   a group of near copies never emits all its pairs: a pair leaves the join
   only if the parity bitmaps of the two sketches differ in no more bits than
   two sets of the required similarity can.

Nulls: a null text is an empty text; an empty set links with nothing. Rows
with one id count as one document. A row with a null id may belong to a group
but never names it, and isn't kept. Repeated rows are copies of each other; ties
go to the smallest id. Other columns are not read; very long texts are read whole,
and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._resident import tidy
from ._scratch import cut, release
from ._words import NOT_SPACE, blocks, shingles

_BITS = 1 << 20
_WORDS = 8  # 64-bit words of a parity bitmap
_PIVOTS = 8  # drawn for each list that is still mixed
_Z = 4.75  # standard deviations: by the exact binomial tail a chance of 2 to 6 in a million (k = 192)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, end, words in blocks(batch.column(1), NOT_SPACE):
        h, ptr = shingles(words, width)
        for i in range(first, end):
            yield i, np.unique(h[ptr[i - first] : ptr[i - first + 1]])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    if ends[-1] >= 2**31:
        raise ValueError("a batch holds too many shingles; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, n (size of the set), digest (of the whole set), sketch (its k
    smallest values, ascending), bits (of each value one of 512 bits is turned,
    so two bitmaps differ in at most as many bits as the sketches in values)."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                n, digest, sketch, bits = [], [], [], []
                for _, s in _sets(batch, width):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sketch.append(s[:k])
                    odd = np.bincount((s[:k] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(55)).astype(np.int64), minlength=64 * _WORDS) & 1
                    bits.append(np.packbits(odd.astype(np.uint8)).view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _lists(sketch), _lists(bits)], ["doc_id", "n", "digest", "sketch", "bits"]
                )

    return docs.mapInArrow(tidy(run, alone=True), "doc_id long, n long, digest binary, sketch array<long>, bits array<long>")


def _full_sets(docs: DataFrame, width: int, bits: np.ndarray) -> DataFrame:
    """doc_id, full: the sets of the documents whose id may be in ``bits``."""

    def run(batches):
        for whole in batches:
            ids = whole.column(0).to_numpy(zero_copy_only=False)
            keep = ~np.asarray(whole.column(0).is_null()) & bits[_bucket(np.nan_to_num(ids).astype(np.int64))]
            picked = whole.filter(pa.array(keep))
            for at in range(0, picked.num_rows, 512):
                batch = picked.slice(at, 512)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists([s for _, s in _sets(batch, width)])], ["doc_id", "full"])

    return docs.mapInArrow(tidy(run, alone=True), "doc_id long, full array<long>")


def _bucket(ids: np.ndarray) -> np.ndarray:
    return (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def _some_bits(ids: DataFrame) -> np.ndarray:
    """A table of 2**20 bits in which those of the ids are set; its size does
    not depend on how many ids there are."""

    def run(batches):
        seen = np.zeros(_BITS, bool)
        for b in batches:
            seen[_bucket(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["bits"])

    bits = np.zeros(_BITS // 8, np.uint8)
    for row in ids.coalesce(16).mapInArrow(tidy(run, alone=True), "bits binary").toLocalIterator():
        bits |= np.frombuffer(row[0], np.uint8)
    return np.unpackbits(bits).astype(bool)


def _frequent(classes: DataFrame, at_most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Retained values in many sketches, and their counts: at most ``at_most``
    of them. They only fix the order of values, which may be any common order."""

    def run(batches):
        held, size = [], 0

        def flush():
            v, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(v[c > 2]), pa.array(c[c > 2].astype(np.int64))], ["v", "c"])

        for b in batches:
            held.append(b.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size > 1 << 21:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counted = classes.select("sketch").mapInArrow(tidy(run, alone=True), "v long, c long").groupBy("v").agg(F.sum("c").alias("c"))
    rows = counted.where("c >= 16").orderBy(F.desc("c"), "v").limit(at_most).toArrow()
    v, c = rows.column("v").to_numpy(), rows.column("c").to_numpy()
    order = np.argsort(v)
    return v[order], c[order]


def _least_overlap(n: np.ndarray, k: int, num: int, den: int) -> np.ndarray:
    """Values that the sketch of a set of size ``n`` shares with that of any
    set of the required similarity. While both sketches must be whole sets it
    is exact; else the shared values of the union's sketch are a draw without
    replacement from a union of at most n / t values, and fewer than this come
    with a chance of 2.3 in a million at most (k = 192, t of 0.80 or 0.85)."""
    t = num / den
    free = np.maximum(0, 1 - k * t / np.maximum(n, 1))
    drawn = np.floor(k * t - _Z * np.sqrt(k * t * (1 - t) * free))
    sure = -(-np.minimum(n, k) * num // den)
    return np.where(n * den <= k * num, sure, np.minimum(sure, drawn)).astype(np.int64)


def _prefixes(classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """v, rep, n, need (see above): the values through which a class can meet its
    links."""
    hot, count = _frequent(classes)

    def run(batches):
        for b in batches:
            sketch, ptr = b.column(2).flatten().to_numpy(), b.column(2).offsets.to_numpy()
            ptr = ptr - ptr[0]
            if len(hot):
                at = np.minimum(np.searchsorted(hot, sketch), len(hot) - 1)
                rank = np.where(hot[at] == sketch, count[at], 0)
            else:
                rank = np.zeros(len(sketch), np.int64)
            size = np.diff(ptr)
            need = _least_overlap(b.column(1).to_numpy(), k, num, den)
            take = np.where(size > 0, size - need + 1, 0)
            order = np.lexsort((sketch, rank, np.repeat(np.arange(len(size)), size)))
            place = np.arange(len(sketch)) - np.repeat(ptr[:-1], size)
            chosen = order[place < np.repeat(take, size)]
            rows = np.repeat(np.arange(len(size)), take)
            columns = [pa.array(sketch[chosen]), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(need[rows].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["v", "rep", "n", "need"])

    return classes.select("rep", "n", "sketch").mapInArrow(tidy(run, alone=True), "v long, rep long, n long, need int")


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, k: int, num: int, den: int) -> DataFrame:
    """a, b: those of the distinct pairs whose full sets reach the threshold."""
    slack = _Z * math.sqrt(num / den * (1 - num / den) / k)
    of = lambda side: classes.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    whole = (F.col("n_a") <= k) & (F.col("n_b") <= k)
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), union))
    exact = both * den >= (F.col("n_a") + F.col("n_b") - both) * num
    maybe = common >= F.size(union) * (num / den - slack)
    judged = cut(
        pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", whole.alias("sure"), F.when(whole, exact).otherwise(maybe).alias("ok")).where("ok").drop("ok"), "judged"
    )
    sure, rest = judged.where("sure").select("a", "b"), judged.where("not sure").select("a", "b")
    bits = _some_bits(rest.select(F.col("a").alias("i")).union(rest.select("b")))
    full = _full_sets(docs, width, bits)
    half = rest.join(full.select(F.col("doc_id").alias("a"), F.col("full").alias("f_a")), "a")
    shared = F.size(F.array_intersect("f_a", "f_b"))
    proven = half.join(full.select(F.col("doc_id").alias("b"), F.col("full").alias("f_b")), "b").where(
        shared * den >= (F.size("f_a") + F.size("f_b") - shared) * num
    )
    out = cut(sure.union(proven.select("a", "b")).distinct(), "links")
    release(judged)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest id that each end of a link can reach. Every
    round takes the least label of the neighbours and of the label's own
    label, so chains shorten by powers of two."""
    edges = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a"))
    labels = cut(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("low")).select("node", F.least("node", "low").alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), "comp"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        above = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        step = cut(step.join(above, "comp", "left").select("node", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        moved = step.where("comp <> was").limit(1).count()
        release(labels)
        labels = step.select("node", "comp")
        labels._docweave_path = step._docweave_path
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, k: int = 192) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for every row of ``docs``.

    Rows are linked where ``den * |A & B| >= num * |A | B|`` on their sets of
    ``width``-word shingles.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = cut(sketches(texts, width, k), "sketches")
    grouped = base.where("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min_by(F.struct("sketch", "bits"), "doc_id").alias("s")).select("digest", "n", "rep", "copies", "s.*")
    classes = cut(grouped.where("rep is not null"), "classes")
    prefixes = _prefixes(classes, k, num, den)
    ends = prefixes.groupBy("v").agg(F.min(F.struct("rep", "n")).alias("low"), F.max(F.struct("rep", "n")).alias("high")).where("low.rep < high.rep")
    members = cut(prefixes.join(ends, "v"), "members")
    near = lambda x, y: (F.least(x, y) * den >= F.greatest(x, y) * num)
    star = lambda end: members.where(near(F.col("n"), F.col(f"{end}.n"))).select(F.least("rep", f"{end}.rep").alias("a"), F.greatest("rep", f"{end}.rep").alias("b"))
    tried = cut(star("low").union(star("high")).where("a < b").distinct(), "tried")
    links = _links(tried, classes, texts, width, k, num, den)
    labels = components(links)

    def mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows with their components, of lists that still have several."""
        placed = rows.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        several = placed.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("v")
        return placed.join(several, "v")

    def side(rows: DataFrame, s: str, *more: str) -> DataFrame:
        return rows.select("v", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "need", "comp", "bits", *more)))

    n_x, n_y = F.col("n_x"), F.col("n_y")
    whole = (n_x <= k) & (n_y <= k)
    shared = F.when(whole, F.ceil((n_x + n_y) * num / (num + den))).otherwise(F.greatest("need_x", "need_y"))
    differ = sum((F.bit_count(F.col("bits_x")[i].bitwiseXOR(F.col("bits_y")[i])) for i in range(_WORDS)), F.lit(0))
    may = (F.col("comp_x") != F.col("comp_y")) & near(n_x, n_y) & (differ <= F.least(n_x, F.lit(k)) + F.least(n_y, F.lit(k)) - 2 * shared)
    pair = [F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")]

    open_ = cut(mixed(members.select("v", "rep", "n", "need"), labels).join(classes.select("rep", "bits"), "rep"), "open")
    # more pivots for the lists that are still mixed: the same few members in all
    # lists of a group, so the pairs stay in proportion to its members
    drawn = [F.min(F.struct(F.xxhash64("rep", F.lit(i)).alias("h"), "rep", "n", "need", "comp", "bits")).alias(f"p{i}") for i in range(_PIVOTS)]
    pivots = open_.groupBy("v").agg(*drawn).select("v", F.array(*(f"p{i}" for i in range(_PIVOTS))).alias("p"))
    fan = side(open_, "x").join(pivots, "v").select("*", F.explode("p").alias("y"))
    fan = fan.select("*", *(F.col(f"y.{c}").alias(f"{c}_y") for c in ("rep", "n", "need", "comp", "bits")))
    again = cut(fan.where(may).select(*pair).distinct().join(tried, ["a", "b"], "left_anti"), "again")
    links = cut(links.union(_links(again, classes, texts, width, k, num, den)), "links")
    labels = components(links)

    # a pair meets in every list that it shares; only the first of them (by
    # value) keeps it, so each is made once
    left = cut(mixed(open_.drop("comp"), labels), "left")
    own = left.groupBy("rep").agg(F.collect_list("v").alias("own"))
    left_own = cut(left.join(own, "rep"), "left")
    x, y = (side(left_own, s, "own") for s in "xy")
    first = F.array_min(F.array_intersect("own_x", "own_y")) == F.col("v")
    rest = x.join(y, "v").where((F.col("rep_x") < F.col("rep_y")) & may & first)
    rest = cut(rest.select(*pair).distinct().join(tried.union(again), ["a", "b"], "left_anti"), "rest")
    more = _links(rest, classes, texts, width, k, num, den)
    labels = components(links.union(more))

    named = classes.select("digest", "rep", "copies").join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    named = cut(named.where("copies > 1 or comp < rep").select("digest", F.coalesce("comp", "rep").alias("comp")), "named")
    release(members, tried, again, open_, left, left_own, rest, classes)
    out = base.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
