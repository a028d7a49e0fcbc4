"""Mentions to canonical entities, cheapest stage first; what no stage is sure of is queued, never guessed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.relational import top
from tessera.operators.shared import kept

ACCEPT = 92  # of 100
CANDIDATES = 5


def mention_parts(mentions: DataFrame, id: str = "mention_id", mention: str = "mention") -> DataFrame:
    """mention_id, part, name: the normalised parts of each mention that are not empty."""
    parts = F.posexplode(F.split(text.normalise_mention(F.col(mention)), "/"))
    return mentions.select(F.col(id).alias("mention_id"), parts.alias("part", "name")).where("name <> ''")


def exact(parts: DataFrame, aliases: DataFrame) -> DataFrame:
    """mention_id, part, entity_id by equal normalised alias; the least entity if an alias is ambiguous."""
    one = aliases.select(text.normalise_mention(F.col("alias")).alias("name"), "entity_id").groupBy("name").agg(F.min("entity_id").alias("entity_id"))
    return parts.join(one, "name").select("mention_id", "part", "entity_id")


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity of 0 to 100 of two texts' token sets: shared tokens against shared tokens with the rest of each, and the rests against each other, by edit distance."""
    ta, tb = F.array_sort(F.array_distinct(text.words(a))), F.array_sort(F.array_distinct(text.words(b)))
    shared = F.array_join(F.array_sort(F.array_intersect(ta, tb)), " ")
    with_rest = lambda own, other: F.trim(F.concat_ws(" ", shared, F.array_join(F.array_except(own, other), " ")))

    def ratio(x: Column, y: Column) -> Column:
        total = F.length(x) + F.length(y)
        return F.when(total == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))))

    left, right = with_rest(ta, tb), with_rest(tb, ta)
    best = F.greatest(ratio(left, right), F.when(shared != "", F.greatest(ratio(shared, left), ratio(shared, right))))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(best)


def trigram_pairs(left: DataFrame, right: DataFrame, least: float = 0.3) -> DataFrame:
    """left_id, right_id, similarity of names (id, name) that share trigrams: an equi-join on the trigrams, never all pairs.

    Equal names are one row of the join, so a name that many rows share costs once. By prefix filter, a name is indexed
    by the rarest of its trigrams only: with n trigrams, n - ceil(least * n) + 1 of them meet every name that is similar enough.
    """
    grams = lambda d, side: d.select(F.col("name").alias(f"{side}_name")).distinct().withColumn(f"{side}_grams", text.trigrams(F.col(f"{side}_name"))).where(F.size(f"{side}_grams") > 0)
    a, b = grams(left, "l"), grams(right, "r")
    often = b.select(F.explode("r_grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("often"))

    def prefix(d: DataFrame, side: str) -> DataFrame:
        each = d.select(f"{side}_name", F.size(f"{side}_grams").alias("n"), F.explode(f"{side}_grams").alias("gram")).join(often, "gram", "left")
        ranked = each.groupBy(f"{side}_name", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram"))).alias("ranked"))
        head = F.slice("ranked", 1, F.col("n") - F.ceil(F.lit(least) * F.col("n")).cast("int") + 1)
        return ranked.select(f"{side}_name", F.explode(head).alias("g")).select(f"{side}_name", F.col("g.gram").alias("gram"))

    met = prefix(a, "l").join(prefix(b, "r"), "gram").select("l_name", "r_name").distinct()
    both = met.join(a, "l_name").join(b, "r_name")
    shared = F.size(F.array_intersect("l_grams", "r_grams"))
    scored = both.withColumn("similarity", shared / (F.size("l_grams") + F.size("r_grams") - shared)).where(F.col("similarity") >= least).select("l_name", "r_name", "similarity")
    named = scored.join(left.select(F.col("id").alias("left_id"), F.col("name").alias("l_name")), "l_name").join(right.select(F.col("id").alias("right_id"), F.col("name").alias("r_name")), "r_name")
    return named.select("left_id", "right_id", "l_name", "r_name", "similarity")


def subset_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, l_name, r_name of names (id, name) of which one has all words of the other: an equi-join on the smaller one's rarest word."""
    sets = lambda d, side: d.select(F.col("name").alias(f"{side}_name")).distinct().withColumn(f"{side}_words", F.array_sort(F.array_distinct(text.words(F.col(f"{side}_name"))))).where(F.size(f"{side}_words") > 0)
    a, b = sets(left, "l"), sets(right, "r")
    each = lambda d, side: d.select(f"{side}_name", F.explode(f"{side}_words").alias("word"))
    often = each(a, "l").union(each(b, "r")).groupBy("word").agg(F.count("*").alias("often"))
    rarest = lambda d, side: each(d, side).join(often, "word").groupBy(f"{side}_name").agg(F.min(F.struct("often", "word")).alias("m")).select(f"{side}_name", F.col("m.word").alias("word"))
    met = rarest(a, "l").join(each(b, "r"), "word").select("l_name", "r_name").union(rarest(b, "r").join(each(a, "l"), "word").select("l_name", "r_name")).distinct()
    both = met.join(a, "l_name").join(b, "r_name")
    shared = F.size(F.array_intersect("l_words", "r_words"))
    held = both.where(shared == F.least(F.size("l_words"), F.size("r_words"))).select("l_name", "r_name")
    return held.join(left.select(F.col("id").alias("left_id"), F.col("name").alias("l_name")), "l_name").join(right.select(F.col("id").alias("right_id"), F.col("name").alias("r_name")), "r_name").select("left_id", "right_id", "l_name", "r_name")


def is_sure(a: Column, b: Column, accept: float = ACCEPT) -> Column:
    """Whether a token-set ratio may decide: it reaches `accept`, and so does the ratio of all words where one text's are only some of the other's.

    Shared words against the rest make 100 of any text that holds the other ("zinc oxide in water" and "water"), which says nothing on what the rest means.
    """
    ta, tb = (F.array_sort(F.array_distinct(text.words(x))) for x in (a, b))
    whole = 100.0 * (1 - F.levenshtein(F.array_join(ta, " "), F.array_join(tb, " ")) / F.greatest(F.length(F.array_join(ta, " ")), F.length(F.array_join(tb, " ")), F.lit(1)))
    shared = F.size(F.array_intersect(ta, tb))
    part = (shared == F.least(F.size(ta), F.size(tb))) & (F.size(ta) != F.size(tb))
    return (token_set_ratio(a, b) >= accept) & (~part | (whole >= accept))


def fuzzy(parts: DataFrame, aliases: DataFrame, accept: float = ACCEPT, least: float = 0.3) -> DataFrame:
    """mention_id, part, entity_id, score: the best alias by token-set ratio, if it is good enough.

    Scored are aliases whose trigram similarity is `least` or more; which may be accepted, `is_sure` tells. The first by score, then trigram similarity, then least entity.
    """
    keyed = parts.select(F.struct("mention_id", "part").alias("id"), "name")
    named = aliases.select(F.col("entity_id").alias("id"), text.normalise_mention(F.col("alias")).alias("name")).distinct()
    sure = trigram_pairs(keyed, named, least).where(is_sure(F.col("l_name"), F.col("r_name"), accept))
    scored = sure.withColumn("score", token_set_ratio(F.col("l_name"), F.col("r_name")))
    best = scored.groupBy("left_id").agg(F.max(F.struct("score", "similarity", (-F.col("right_id")).alias("r"))).alias("b"))
    return best.select("left_id.*", (-F.col("b.r")).alias("entity_id"), F.col("b.score").alias("score"))


def suggested(parts: DataFrame, aliases: DataFrame, k: int = CANDIDATES, least: float = 0.3) -> DataFrame:
    """mention_id, part, name, names, ids, scores: candidates for a judge by their text, best first: aliases with similar trigrams, and those whose words hold all of the mention's or are all among them, however long either is."""
    keyed = parts.select(F.struct("mention_id", "part", "name").alias("id"), "name")
    named = aliases.select(F.col("entity_id").alias("id"), text.normalise_mention(F.col("alias")).alias("name")).distinct()
    near = trigram_pairs(keyed, named, least).drop("similarity").union(subset_pairs(keyed, named)).distinct()
    scored = near.withColumn("score", token_set_ratio(F.col("l_name"), F.col("r_name")))
    best = top(scored, k, ["left_id"], F.desc(F.round("score", 9)), F.asc("r_name"), F.asc("right_id"))
    grouped = best.groupBy("left_id").agg(F.array_sort(F.collect_list(F.struct("rank", "r_name", "right_id", "score"))).alias("c"))
    return grouped.select("left_id.*", F.col("c.r_name").alias("names"), F.col("c.right_id").alias("ids"), F.col("c.score").alias("scores"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


QUERY_BYTES = 64 << 20
TILE = 2048, 1024  # vectors and queries that are multiplied at once


def nearest(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """query_id, id, score, rank: the k nearest of vectors (id, vector) to each of queries (query_id, vector), by exact cosine; null without a direction.

    Queries go to the tasks in blocks of QUERY_BYTES, their best included, which are measured first. The vectors are dealt
    to as many tasks as run at once, whatever their number; a task multiplies tiles of them with the block and keeps the
    best k for each query, so its memory doesn't grow, and what is shuffled grows with the queries alone.
    """
    n = query_blocks(queries, k)
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    dealt = vectors.select("id", "vector").repartition(queries.sparkSession.sparkContext.defaultParallelism)
    dealt = kept(dealt) if n > 1 else dealt
    out = None
    for part in range(n):
        ids, block = query_block(queries, n, part)
        shared = queries.sparkSession.sparkContext.broadcast((ids, block))

        def scored(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, block = shared.value
            best = Best(ids, block, k)
            for batch in batches:
                best.add(None, unit_rows(batch.column("vector")), batch.column("id"))
            yield from best.rows()

        found = dealt.mapInArrow(scored, f"query_id {kinds[0]}, id {kinds[1]}, score double")
        if n > 1:  # one block is held at a time
            found = kept(top(found, k, ["query_id"], F.desc(F.round("score", 9)), F.asc("id")).drop("rank"))
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return top(out, k, ["query_id"], F.desc(F.round("score", 9)), F.asc("id"))


def query_blocks(queries: DataFrame, k: int) -> int:
    """Blocks of QUERY_BYTES of queries (query_id, vector), with room for the k best of each."""
    size = queries.agg(F.sum(8 * F.size("vector") + 16 + 24 * k)).first()[0] or 0
    return max(1, -(-size // QUERY_BYTES))


def query_block(queries: DataFrame, blocks: int, number: int) -> tuple[pa.Array, np.ndarray]:
    rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).select("query_id", "vector").toArrow()
    return rows.column("query_id").combine_chunks(), unit_rows(rows.column("vector").combine_chunks())


class Best:
    """The k best for each query of a block among the vectors that a task sees: by score to 9 digits as Spark rounds it, then id."""

    def __init__(self, queries: pa.Array, block: np.ndarray, k: int):
        self.queries, self.block, self.k = queries, block, k
        self.score = np.zeros((len(block), k))
        self.rounded = np.full((len(block), k), np.iinfo(np.int64).min)  # of places that aren't taken
        self.id: np.ndarray | None = None

    def add(self, asking: np.ndarray | None, units: np.ndarray, ids: pa.Array) -> None:
        """Compares vectors of one batch with the queries at `asking`, by default all."""
        whole = pa.types.is_integer(ids.type) and not ids.null_count
        keys = ids.to_numpy() if whole else _objects([(i is not None, i) for i in ids.to_pylist()])  # nulls first, as Spark has them
        if self.id is None:
            self.id = np.zeros(self.score.shape, keys.dtype) if whole else _objects([(False, None)] * self.score.size).reshape(self.score.shape)
        elif self.id.dtype != keys.dtype:  # the first batch with a null
            objects = lambda x: x if x.dtype == object else _objects([(True, i) for i in x.ravel().tolist()]).reshape(x.shape)
            self.id, keys = objects(self.id), objects(keys)
        asked = np.arange(len(self.block)) if asking is None else asking
        for at in range(0, len(units), TILE[0]):
            for q in range(0, len(asked), TILE[1]):
                self._tile(asked[q : q + TILE[1]], units[at : at + TILE[0]], keys[at : at + TILE[0]])

    def _tile(self, asked: np.ndarray, units: np.ndarray, keys: np.ndarray) -> None:
        scores = self.block[asked] @ units.T
        full = self.rounded[asked, -1] > np.iinfo(np.int64).min
        floor = np.where(full, self.score[asked].min(axis=1), -np.inf)
        least = min(self.k, scores.shape[1])
        if not full.all():
            floor = np.maximum(floor, np.partition(scores, -least, axis=1)[:, -least])
        q, at = np.nonzero(scores >= floor[:, None] - 2e-9)
        values = scores[q, at]
        q, rounded, ids = asked[q], _nine_digits(values), keys[at]
        last = self.rounded[q, -1]
        better = (rounded > last) | ((rounded == last) & (ids < self.id[q, -1]))
        q, rounded, ids, values = q[better], rounded[better], ids[better], values[better]
        if not len(q):
            return
        changed = np.unique(q)
        held, place = np.nonzero(self.rounded[changed] > np.iinfo(np.int64).min)
        held = changed[held]
        q, rounded, ids, values = (np.concatenate(x) for x in ((q, held), (rounded, self.rounded[held, place]), (ids, self.id[held, place]), (values, self.score[held, place])))
        order = np.lexsort((ids, -rounded, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        order, q, rank = order[rank < self.k], q[rank < self.k], rank[rank < self.k]
        self.rounded[q, rank], self.id[q, rank], self.score[q, rank] = rounded[order], ids[order], values[order]

    def rows(self, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        """query_id, id, score."""
        q, place = np.nonzero(self.rounded > np.iinfo(np.int64).min)
        for at in range(0, len(q), size):
            own, n = q[at : at + size], place[at : at + size]
            ids = self.id[own, n]
            yield pa.RecordBatch.from_arrays([self.queries.take(pa.array(own)), pa.array([i for _, i in ids] if ids.dtype == object else ids), pa.array(self.score[own, n])], names=["query_id", "id", "score"])


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _nine_digits(scores: np.ndarray) -> np.ndarray:
    """Billionths, halves away from 0, as `round(score, 9)` gives them; what is all but a half is decided by its decimal digits."""
    scaled = scores * 1e9
    out = np.rint(scaled).astype(np.int64)
    for n in np.flatnonzero(np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-5):
        out[n] = int(Decimal(repr(float(scores[n]))).scaleb(9).to_integral_value(ROUND_HALF_UP))
    return out


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Arrow lists as `_unit` has them."""
    lengths = np.diff(vectors.offsets.to_numpy())
    if len(vectors) and not vectors.null_count and not vectors.flatten().null_count and (lengths == lengths[0]).all():
        return _normed(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64))
    return _unit(vectors.to_pylist())


def _unit(vectors: list) -> np.ndarray:
    return _normed(np.array([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1)))


def _normed(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


Judge = Callable[[pd.Series, pd.Series], pd.Series]


def adjudicate(candidates: DataFrame, judge: Judge | None = None) -> DataFrame:
    """mention_id, part, entity_id of candidates (mention_id, part, name, names, ids) for which a judge names one; by default none is named.

    A judge gets the name and the candidates' names of a batch, and returns the place of the one it chooses, or none.
    """
    if judge is None:
        return candidates.select("mention_id", "part", F.lit(None).cast("long").alias("entity_id")).where("entity_id is not null")

    @F.pandas_udf("int")
    def judged(name: pd.Series, names: pd.Series) -> pd.Series:
        return judge(name, names)

    chosen = F.try_element_at("ids", judged("name", "names") + 1)
    return candidates.select("mention_id", "part", chosen.alias("entity_id")).where("entity_id is not null")


def embedded(names: DataFrame, mention_vectors: DataFrame, entity_vectors: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """mention_id, part, name, names, ids, scores: the k entities nearest to each name, best first; candidates for a judge, never an answer.

    mention_vectors: name, vector; entity_vectors: id, name, vector.
    """
    asked = names.join(mention_vectors, "name").select(F.struct("mention_id", "part", "name").alias("query_id"), "vector")
    found = nearest(asked, entity_vectors.select("id", "vector"), k).join(entity_vectors.select("id", F.col("name").alias("entity")), "id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "entity", "id", "score")))
    grouped = found.groupBy("query_id").agg(ordered.alias("c"))
    return grouped.select("query_id.*", F.col("c.entity").alias("names"), F.col("c.id").alias("ids"), F.col("c.score").alias("scores"))


def cascade(
    mentions: DataFrame, aliases: DataFrame, *, id: str = "mention_id", mention: str = "mention", judged: DataFrame | None = None, mention_vectors: DataFrame | None = None, entity_vectors: DataFrame | None = None, judge: Judge | None = None
) -> DataFrame:
    """mention_id, part, name, entity_id, stage (exact, fuzzy, judged or unresolved): each stage sees what the ones before left.

    judged: earlier decisions (name, entity_id). With a judge, what is left then gets candidates, by text and with vectors
    also the nearest entities, of which the judge names one or none; `learned` makes aliases of its decisions.
    """
    parts = mention_parts(mentions, id, mention)
    names = parts.select("name").distinct().select(F.xxhash64("name").alias("mention_id"), F.lit(0).alias("part"), "name")  # each name once
    one = exact(names, aliases).withColumn("stage", F.lit("exact"))
    left = names.join(one, ["mention_id"], "left_anti")
    two = fuzzy(left, aliases).select("mention_id", "part", "entity_id", F.lit("fuzzy").alias("stage"))
    found = one.unionByName(two)
    if judged is not None:
        three = judged.select(F.xxhash64("name").alias("mention_id"), F.lit(0).alias("part"), "entity_id", F.lit("judged").alias("stage"))
        found = found.unionByName(three.join(found, "mention_id", "left_anti"))
    if judge is not None:
        waiting = kept(names.join(found, "mention_id", "left_anti"))
        candidates = suggested(waiting, aliases)
        if mention_vectors is not None and entity_vectors is not None:
            candidates = candidates.unionByName(embedded(waiting, mention_vectors, entity_vectors))
            both = candidates.groupBy("mention_id", "part", "name").agg(F.array_sort(F.collect_list(F.struct("names", "ids", "scores"))).alias("c"))
            candidates = both.select("mention_id", "part", "name", *(F.flatten(f"c.{n}").alias(n) for n in ("names", "ids", "scores")))
        found = found.unionByName(adjudicate(candidates, judge).withColumn("stage", F.lit("judged")))
    known = names.join(found.drop("part"), "mention_id", "left").select("name", "entity_id", F.coalesce("stage", F.lit("unresolved")).alias("stage"))
    return parts.join(known, "name").select("mention_id", "part", "name", "entity_id", "stage")


def learned(resolved: DataFrame, source: str, confidence: float) -> DataFrame:
    """alias, ingredient_id, source, confidence: what a judge has decided, as rows of the table of aliases; a name once."""
    decided = resolved.where("stage = 'judged'").groupBy(F.col("name").alias("alias")).agg(F.min("entity_id").alias("ingredient_id"))
    return decided.select("alias", "ingredient_id", F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))


def review_queue(resolved: DataFrame) -> DataFrame:
    """name, n: what no stage is sure of, and how many mentions wait for it."""
    return resolved.where("stage = 'unresolved'").groupBy("name").agg(F.count("*").alias("n"))


def stages(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("stage").agg(F.count("*").alias("n"))
