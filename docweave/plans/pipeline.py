"""Plans: ordered steps with gates, dispatch by route, budgets, injected models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Frame = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Step:
    """A transformation; with ``routes`` only rows on one of them take it."""

    name: str
    run: Frame
    routes: tuple[str, ...] | None = None


@dataclass
class Plan:
    """Steps in order. A gated step splits the rows by their route and unites
    them again, so a plan stays one lazy DataFrame."""

    steps: Sequence[Step]
    route_col: str = "route"
    enabled: Callable[[str], bool] = field(default=lambda name: True)

    def run(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            if not self.enabled(step.name):
                continue
            if step.routes is None:
                df = step.run(df)
                continue
            on = F.coalesce(F.col(self.route_col).isin(*step.routes), F.lit(False))
            df = step.run(df.where(on)).unionByName(df.where(~on), allowMissingColumns=True)
        return df


def dispatch(df: DataFrame, choice: Column, ways: dict[str, Frame], default: Frame) -> DataFrame:
    """Each row through the way that ``choice`` names; others by the default."""
    tagged = df.withColumn("_way", choice)
    known = F.coalesce(F.col("_way").isin(*ways), F.lit(False))
    parts = [way(tagged.where(F.col("_way") == name)) for name, way in ways.items()] + [default(tagged.where(~known))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).drop("_way")


def status(deleted: Column, unsupported: Column, failed: Column, chunks: Column) -> Column:
    return F.when(deleted, "deleted").when(unsupported, "unsupported").when(chunks == 0, "empty").when(failed, "failed").otherwise("ready")


def within_budget(rows: DataFrame, keys: list[str], order: str, route: str, most: int, beyond: str) -> DataFrame:
    """At most ``most`` rows of a key keep the route; later ones take another."""
    n = F.row_number().over(Window.partitionBy(*keys, "route").orderBy(order))
    return rows.withColumn("_n", n).withColumn("route", F.when((F.col("route") == route) & (F.col("_n") > most), beyond).otherwise(F.col("route"))).drop("_n")


def hashed_vectors(texts: list[str], dim: int) -> list[list[float]]:
    """The default embedding: unit vectors of hashed words."""
    import zlib

    import numpy as np

    out = np.zeros((len(texts), dim))
    for row, t in zip(out, texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            row[h % dim] += 1 if h >> 16 & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype("float32").tolist()


def embed(rows: DataFrame, id_col: str, text_col: str, dim: int, model: Callable[[list[str], int], list[list[float]]] = hashed_vectors, prefix: str = "") -> DataFrame:
    """Vectors of texts by an injected model, a batch at a time."""
    import pandas as pd

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "vector": model([prefix + (t or "") for t in pdf[text_col]], dim)})

    return rows.select(id_col, text_col).mapInPandas(run, f"{id_col} long, vector array<float>")
