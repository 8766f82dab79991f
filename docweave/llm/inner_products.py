"""Exact top-k search by inner product, over vectors in order of their length.

Components become integers, ``floor(scale * x)``. The vectors are written once
to the shared folder, longest first, in files whose ranges of length don't
overlap. A task holds a block of queries and reads the files in that order. It
stops as soon as no query of the block can gain: by Cauchy-Schwarz a score is
at most the product of both lengths, and lengths only fall.

Within a block of vectors, queries and vectors are turned by the singular
vectors of the whole table, so that few coordinates carry most of each length.
Partial sums over the leading coordinates plus the product of what remains of
both lengths bound a score from above. Pairs whose bound is below the query's
k-th best score go; the others are scored in integers. Bounds only decide what
is scored: every result is an exact integer, and ties keep the smaller id.

The rotation comes from the sums of products of all rows, added up by Spark; the
driver sees one matrix of d x d numbers and a short row for each file.

Null vectors and vectors that hold a null or a component that isn't finite take
no part; a shorter vector counts as followed by zeros, an empty one as all zeros.
Rows are told apart by their place and not by id: a query's own row is left out,
other rows of the same id are candidates, and two query rows of one id give their
results twice. Rows without an id are candidates, after all ids among ties, and
never queries. Components are held to 64 bits and scores to the limits of a long.
Columns other than id and vector are not looked at. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import cut

#: queries that a task holds at once, and vectors that it reads at once
QUERIES = 1024
VECTORS = 4096
#: shares of the squared lengths that the stages of partial sums cover
STAGES = (0.5, 0.75, 0.9)
#: share of pairs below which the rest is scored pair by pair
FEW = 0.02
_TOP, _LOW = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _whole(vector: Column, scale: float) -> Column:
    """The vector in integers, null where it takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(sound, F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))))


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), d), np.int64)
    out[np.arange(d) < n[:, None]] = flat
    return out


def _sums_of_products(table: DataFrame, d: int) -> np.ndarray:
    """The d x d sums of products of components over all rows."""

    def add(batches):
        total = np.zeros((d, d))
        for b in batches:
            x = _matrix(b.column(0), d).astype(float)
            total += x.T @ x
        at = np.arange(d * d)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["cell", "value"])

    cells = table.select("v").mapInArrow(add, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(d * d)
    for r in cells.collect():
        out[r["cell"]] = r["value"]
    return out.reshape(d, d)


class _Plan:
    """What every task needs: files with their largest length, and the rotation."""

    def __init__(self, table: DataFrame, k: int):
        about = table.select(F.max(F.size("v")).alias("d")).first()
        self.k, self.d = k, max(1, int(about["d"] or 0))
        values, turn = np.linalg.eigh(_sums_of_products(table, self.d))
        self.turn = np.ascontiguousarray(turn[:, ::-1])
        share = np.cumsum(np.maximum(values[::-1], 0))
        ends = np.searchsorted(share, np.array(STAGES) * share[-1]) + 1 if share[-1] > 0 else np.array([], int)
        self.stages = sorted({int(e) for e in ends if e < self.d} | {self.d})
        files = table.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.max("norm").alias("norm"))
        self.folder = table._docweave_path
        self.files = [(r["file"], r["norm"]) for r in files.orderBy(F.desc("norm"), "file").collect()]


def _blocks(fs, path: str, d: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, whether they are null, places, lengths, integers) in rows of a file."""
    with fs.open_input_file(path) as f:
        step, held = 64, None
        for b in pq.ParquetFile(f).iter_batches(VECTORS, columns=["vec_id", "place", "norm", "v"]):
            held, at = b, 0
            while at < len(held):  # the first are few, so that thresholds rise before most pairs are met
                part = held.slice(at, step)
                at, step = at + step, min(VECTORS, step * 4)
                ids = part.column("vec_id")
                yield ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column("place").to_numpy(), part.column("norm").to_numpy(), _matrix(part.column("v"), d)


def _scores(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of the rows of two tables of the same height."""
    if bound < 2.0**62:
        return np.einsum("ij,ij->i", q, c)
    exact = (q.astype(object) * c.astype(object)).sum(axis=1)
    return np.array([min(max(int(x), _LOW), _TOP) for x in exact], np.int64)


class _Best:
    """The k best rows of each query of a block."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.at = self.score = self.vec = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)
        self.least = np.full(n, -np.inf)

    def add(self, at: np.ndarray, score: np.ndarray, vec: np.ndarray, null: np.ndarray) -> None:
        at, score, vec, null = (np.concatenate(x) for x in ((self.at, at), (self.score, score), (self.vec, vec), (self.null, null)))
        order = np.lexsort((vec, null, -score.astype(object) if (score == _LOW).any() else -score, at))
        at = at[order]
        first = np.searchsorted(at, np.arange(self.n))
        place = np.arange(len(at)) - first[at]
        keep = order[place < self.k]
        self.at, self.score, self.vec, self.null = at[place < self.k], score[keep], vec[keep], null[keep]
        full = np.flatnonzero(place == self.k - 1)
        self.least[at[full]] = score[order[full]]

    def rank(self) -> np.ndarray:
        return np.arange(len(self.at)) - np.searchsorted(self.at, self.at) + 1


def _search(plan: _Plan, places: np.ndarray, norms: np.ndarray, q: np.ndarray) -> _Best:
    """The best rows of a block of queries, over all files."""
    best = _Best(len(q), plan.k)
    turned = q @ plan.turn
    left = _rest(turned, plan.stages)
    fs, base = pafs.FileSystem.from_uri(plan.folder)
    for name, longest in plan.files:
        if not (norms * longest * (1 + 1e-9) + 1 >= best.least).any():
            break
        for vec, null, place, length, c in _blocks(fs, f"{base}/{name}", plan.d):
            top = float(length.max())
            on = np.flatnonzero(norms * top * (1 + 1e-9) + 1 >= best.least)
            if not len(on):
                break  # the rest of this file is shorter
            i, j = _survivors(plan, turned[on], [x[on] for x in left], norms[on], best.least[on], c @ plan.turn, length)
            i = on[i]
            other = places[i] != place[j]
            i, j = i[other], j[other]
            if len(i):
                best.add(i, _scores(q[i], c[j], float(norms.max()) * top), vec[j], null[j])
    return best


def _rest(turned: np.ndarray, stages: list[int]) -> list[np.ndarray]:
    """Length of what lies behind each stage."""
    return [np.sqrt((turned[:, e:] ** 2).sum(axis=1)) for e in stages]


def _survivors(plan: _Plan, q, q_left, q_norm, least, c, c_norm) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) whose bound reaches the query's least score."""
    c_left = _rest(c, plan.stages)
    slack = 0.25 + 1e-13 * plan.d * float(q_norm.max()) * float(c_norm.max())  # more than sums of doubles can be off
    least = least - slack
    total, done = np.zeros((len(q), len(c))), 0
    for end, ql, cl in zip(plan.stages, q_left, c_left):
        total += q[:, done:end] @ c[:, done:end].T
        done = end
        bound = total + np.outer(ql, cl) if end < plan.d else total
        alive = bound >= least[:, None]
        if end == plan.d or np.count_nonzero(alive) <= FEW * alive.size:
            break
    i, j = np.nonzero(alive)
    for e, ql, cl in zip(plan.stages, q_left, c_left):  # the few left: their own sums, stage by stage
        if e <= done or not len(i):
            continue
        part = total[i, j] + np.einsum("ij,ij->i", q[i, done:e], c[j, done:e])
        keep = part + ql[i] * cl[j] >= least[i]
        i, j = i[keep], j[keep]
        break
    return i, j


def top_k(vectors: DataFrame, *, k: int = 20, every: int = 20, scale: float = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of every
    row whose id is divisible by ``every`` with all other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), _whole(F.col(vector_col), scale).alias("v")).where("v is not null")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    placed = rows.select("vec_id", F.monotonically_increasing_id().alias("place"), norm.alias("norm"), "v")
    # equal lengths are told apart by place, so no length fills a partition alone
    table = cut(placed.repartitionByRange(F.desc("norm"), "place").sortWithinPartitions(F.desc("norm"), "place"), "vectors")
    plan = _Plan(table, k)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t.column("vec_id").to_numpy()
            best = _search(plan, t.column("place").to_numpy(), t.column("norm").to_numpy(), _matrix(t.column("v").chunk(0), plan.d))
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.at], pa.int64()), pa.array(best.rank(), pa.int32()), pa.array(best.vec, pa.int64(), mask=best.null), pa.array(best.score, pa.int64())], ["query_id", "rank", "vec_id", "score"])

        for b in batches:
            for s in range(0, b.num_rows, QUERIES):
                held.append(b.slice(s, QUERIES))
                if sum(map(len, held)) >= QUERIES:
                    yield from flush()
        if held:
            yield from flush()

    queries = table.where(F.col("vec_id") % every == 0).select("vec_id", "place", "norm", "v")
    return queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "place").mapInArrow(run, "query_id long, rank int, vec_id long, score long")
