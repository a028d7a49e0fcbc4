"""A stored index of vectors in lists around centres: nearest neighbours by cosine from the lists that can have them.

The centres are fitted by k-means on a bounded sample of unit vectors; every vector goes to its nearest centre's list,
and a list's radius is the distance of its farthest member. Lists are folders, so a search opens those that it needs, and
a large list is many files and tasks.

`probe` reads the lists of the nearest centres alone: approximate, its recall depends on their number. `nearest` then
goes on: no member of a list is nearer than the distance of its centre less its radius, so the lists whose bound reaches
the k-th best so far are read as well, and the result is exact. Vectors without a direction are in the first list and
have a score of 0 with all, as have queries without one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import top
from tessera.operators.resolve import Best, _unit, query_block, query_blocks, unit_rows
from tessera.operators.shared import kept

SAMPLE = 20_000  # vectors on which the centres are fitted


def _centres(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k-means from spread-out beginnings; a centre that loses all its members stays where it is."""
    r = np.random.default_rng(seed)
    chosen = [sample[r.integers(len(sample))]]
    near = np.full(len(sample), np.inf)
    for _ in range(1, min(lists, len(sample))):
        near = np.minimum(near, ((sample - chosen[-1]) ** 2).sum(1))
        if not near.max() > 0:
            break
        chosen.append(sample[r.choice(len(sample), p=near / near.sum())])
    centres = np.array(chosen)
    for _ in range(rounds):
        own = _closest(sample, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _closest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * vectors @ centres.T, axis=1)


class Lists:
    """An index under a folder: vectors by list, and the centres with their radii and sizes, which `lists` bounds."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, vectors: DataFrame, lists: int, sample: int = SAMPLE) -> None:
        """vectors: id, vector. All are indexed; the centres are fitted on some `sample` of them, chosen by a hash of their ids."""
        n = vectors.count()
        hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
        rows = vectors.where(hashed < int(min(1.0, sample / max(n, 1)) * (1 << 30))).limit(2 * sample).select("vector").collect()
        units = _unit([r.vector for r in rows])
        units = units[(units**2).sum(1) > 0]
        centres = _centres(units, lists) if len(units) else np.zeros((1, 1))
        shared = self.spark.sparkContext.broadcast(centres)
        kind, vector = (vectors.schema[c].dataType.simpleString() for c in ("id", "vector"))

        def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                units = _unit(list(batch["vector"]))
                own = np.where((units**2).sum(1) > 0, _closest(units, shared.value) if units.shape[1] == shared.value.shape[1] else 0, 0)
                away = np.sqrt(((units - shared.value[own]) ** 2).sum(1)) if units.shape[1] == shared.value.shape[1] else np.zeros(len(units))
                yield batch[["id", "vector"]].assign(away=away, list=own.astype("int32"))

        vectors.select("id", "vector").mapInPandas(listed, f"id {kind}, vector {vector}, away double, list int").write.mode("overwrite").partitionBy("list").parquet(f"{self.root}/vectors")
        found = {r.list: (r.radius, r.n) for r in self._read(kind, vector).groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()}
        made = [(k, c.tolist(), *found[k]) for k, c in enumerate(centres) if k in found]
        schema = "list int, centre array<double>, radius double, n long, id_kind string, vector_kind string"
        self.spark.createDataFrame([(*m, kind, vector) for m in made], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centres")

    def _read(self, kind: str, vector: str) -> DataFrame:
        return self.spark.read.schema(f"id {kind}, vector {vector}, away double, list int").parquet(f"{self.root}/vectors")

    def probe(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """query_id, id, score, rank of queries (query_id, vector), from the lists of the `probes` nearest centres."""
        return self._ranked(queries, k, probes, exact=False)[0]

    def nearest(self, queries: DataFrame, k: int, probes: int = 4) -> DataFrame:
        """query_id, id, score, rank, as `resolve.nearest` of all vectors gives them."""
        return self._ranked(queries, k, probes, exact=True)[0]

    def share_read(self, queries: DataFrame, k: int, probes: int, exact: bool) -> float:
        """The part of all pairs of a query and a vector that a search compares."""
        return self._ranked(queries, k, probes, exact)[1]

    def _ranked(self, queries: DataFrame, k: int, probes: int, exact: bool) -> tuple[DataFrame, float]:
        centres = self.spark.read.parquet(f"{self.root}/centres").orderBy("list").collect()
        blocks = query_blocks(queries, k)
        out, compared, asked = [], 0, 0
        for block in range(blocks):
            asked_ids, units = query_block(queries, blocks, block)
            if not len(asked_ids) or not centres:
                continue
            ids = asked_ids.to_pylist()
            middle, radius = np.array([c.centre for c in centres]), np.array([c.radius for c in centres])
            away = np.sqrt(np.maximum((units**2).sum(1)[:, None] + (middle**2).sum(1) - 2 * units @ middle.T, 0)) if units.shape[1] == middle.shape[1] else np.zeros((len(units), len(middle)))
            first = np.argsort(away, axis=1, kind="stable")[:, :probes]
            chosen = np.zeros(away.shape, bool)
            np.put_along_axis(chosen, first, True, axis=1)
            kind = queries.schema["query_id"].dataType.simpleString()
            found = kept(top(self._compared(asked_ids, units, chosen, centres, k, kind), k, ["query_id"], F.desc(F.round("score", 9)), F.asc("id")))
            if exact:
                last = {r.query_id: r.score for r in found.where(F.col("rank") == k).collect()}  # a row a query of the block
                worst = np.array([np.sqrt(max(0.0, 2 - 2 * last[i])) if i in last and (u**2).sum() > 0 else np.inf for i, u in zip(ids, units, strict=True)])
                # Members without a direction have a score of 0, the distance of the root of 2; the first list has them.
                bound = np.maximum(0, away - radius)
                bound[:, 0] = np.minimum(bound[:, 0], np.sqrt(2.0))
                more = (bound <= worst[:, None] + 1e-6) & ~chosen
                if more.any():
                    rest = self._compared(asked_ids, units, more, centres, k, kind)
                    found = kept(top(found.drop("rank").unionByName(rest), k, ["query_id"], F.desc(F.round("score", 9)), F.asc("id")))
                chosen |= more
            out.append(found)
            compared += int((chosen * np.array([c.n for c in centres])).sum())
            asked += len(ids)
        total = sum(c.n for c in centres) * max(asked, 1)
        empty = self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {centres[0].id_kind if centres else 'long'}, score double, rank int")
        return reduce(DataFrame.unionByName, out) if out else empty, compared / max(total, 1)

    def _compared(self, ids: pa.Array, units: np.ndarray, chosen: np.ndarray, centres: list, k: int, kind: str) -> DataFrame:
        """query_id, id, score: the tasks' best for the queries among the members of the lists that each of them wants; as many tasks as run at once."""
        by_list: dict[int, np.ndarray] = {centres[c].list: np.flatnonzero(chosen[:, c]) for c in range(len(centres)) if chosen[:, c].any()}
        shared = self.spark.sparkContext.broadcast((ids, units, by_list))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, units, by_list = shared.value
            best = Best(ids, units, k)
            for batch in batches:
                lists, vectors = batch.column("list").to_numpy(), unit_rows(batch.column("vector"))
                for number in np.unique(lists):
                    at = np.flatnonzero(lists == number)
                    best.add(by_list[int(number)], vectors[at], batch.column("id").take(pa.array(at)))
            yield from best.rows()

        rows = self._read(centres[0].id_kind, centres[0].vector_kind).where(F.col("list").isin(*by_list)).select("id", "vector", "list")
        dealt = rows.repartition(self.spark.sparkContext.defaultParallelism).sortWithinPartitions("list")
        return dealt.mapInArrow(scored, f"query_id {kind}, id {centres[0].id_kind}, score double")
