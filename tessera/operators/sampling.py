"""The quota sampler: a seeded sample in one order, exact, from a bounded part of the input.

Seeds are served in order: each takes its first unseen matches until it occurs
in `min_per_seed` chosen rows, each of which counts for all its seeds; then the
sample is filled up to `limit`. A seed's picks lie among its first
`min_per_seed` matches, and the fill among the first `limit` rows, so no more
than seeds x min_per_seed + limit rows can be chosen. Only these reach the
greedy choice, whatever the size of the input.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.relational import top


def bounded(rows: DataFrame, seeds: Sequence[str], column: str, *, min_per_seed: int, limit: int, order: Sequence[str], id: str) -> DataFrame:
    """id, the order columns as o0, o1 and so on, and the seeds of the rows that can be chosen."""
    by = [f"o{n}" for n in range(len(order))]
    named = rows.select(F.col(id).alias("id"), *(F.col(c).alias(o) for c, o in zip(order, by, strict=True)), text.matched(F.col(column), seeds).alias("seeds"))
    # The fill is one more list beside those of the seeds, so that the texts are matched once; a task keeps the head of each list alone.
    listed = named.select("*", F.explode(F.concat("seeds", F.array(F.lit(None).cast("string")))).alias("list"))
    most = F.when(F.col("list").isNull(), limit).otherwise(min_per_seed)
    heads = top(listed, max(min_per_seed, limit, 0), ["list"], *(F.col(c).asc() for c in by)).where(F.col("rank") <= most)
    return heads.drop("list", "rank").dropDuplicates(["id"])


def choose(rows: pd.DataFrame, seeds: Sequence[str], min_per_seed: int, limit: int) -> list:
    """Ids in the order in which they are chosen from rows (id, seeds) in their order."""
    chosen: dict = {}
    coverage: Counter = Counter()
    held = [(i, set(s)) for i, s in zip(rows["id"], rows["seeds"], strict=True)]

    def pick(wanted: str | None) -> None:
        for i, own in held:
            if len(chosen) >= limit or (wanted is not None and coverage[wanted] >= min_per_seed):
                return
            if i not in chosen and (wanted is None or wanted in own):
                chosen[i] = True
                coverage.update(own)

    for seed in seeds:
        pick(seed)
    pick(None)
    return list(chosen)


def quota_sample(rows: DataFrame, seeds: Sequence[str], column: str, *, min_per_seed: int, limit: int, order: Sequence[str], id: str) -> DataFrame:
    """id, pick (from 0): the sample. `order` must be unique, so that preferred rows come first by its first column."""
    seeds = tuple(seeds)
    few = bounded(rows, seeds, column, min_per_seed=min_per_seed, limit=limit, order=order, id=id)

    by = [f"o{n}" for n in range(len(order))]

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            ids = choose(pd.concat(held).sort_values(by), seeds, min_per_seed, limit)
            yield pd.DataFrame({"id": ids, "pick": range(len(ids))})

    return few.coalesce(1).mapInPandas(greedy, f"id {few.schema['id'].dataType.simpleString()}, pick long")
