"""Chunks, filtered hybrid search, rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.relational import top
from tessera.operators.shared import kept

K1, B = 1.2, 0.75
FUSION = 60


def chunks(documents: DataFrame, size: int = 200, step: int = 150, id: str = "document_id", body: str = "text") -> DataFrame:
    """document_id, chunk, text: windows of `size` words, each `step` after the one before; a last one that adds nothing is left out."""
    w = F.filter(F.split(F.col(body), r"\s+"), lambda x: x != "")
    words = documents.select(F.col(id).alias("document_id"), w.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - size) / step), F.lit(0)).cast("int")
    return words.select("document_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk")).select("document_id", "chunk", F.array_join(F.slice("w", F.col("chunk") * step + 1, size), " ").alias("text"))


def tagged(chunks_: DataFrame, names: dict[str, int], body: str = "text") -> DataFrame:
    """chunks with `tags`: ids of the entities of a fixed list that they name, in order."""
    low = F.lower(F.col(body))
    return chunks_.withColumn("tags", F.array_compact(F.array(*(F.when(low.rlike(text.word_pattern(n)), F.lit(i)) for n, i in sorted(names.items(), key=lambda x: x[1])))))


def about(tags: Column, ids: Sequence[int], every: bool) -> Column:
    """Whether a chunk names all of the ids (questions on interactions) or any (others); applied before ranking."""
    wanted = F.array(*(F.lit(i) for i in ids))
    return F.size(F.array_intersect(tags, wanted)) == len(set(ids)) if every else F.arrays_overlap(tags, wanted)


def bm25(documents: DataFrame, terms: Sequence[str], k: int = 30, id: str = "id", body: str = "text") -> DataFrame:
    """id, score, rank: the k best texts for the terms.

    One pass over the texts, without making their words: what is kept of each is its length and how often it has each
    term. The corpus figures and the scores come from that; they are one row. Texts without any term don't count as hits.
    """
    terms = sorted({t.lower() for t in terms})
    low = documents.select(F.col(id).alias("id"), F.lower(body).alias("low"))
    tf = [F.regexp_count("low", F.lit(text.word_pattern(t))).alias(f"tf{n}") for n, t in enumerate(terms)]
    rows = kept(low.select("id", F.regexp_count("low", F.lit("[a-z0-9]+")).alias("length"), *tf))
    totals = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{n}") > 0).alias(f"df{n}") for n in range(len(terms))))
    score = F.lit(0.0)
    for n in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{n}") + 0.5) / (F.col(f"df{n}") + 0.5))
        score = score + idf * F.col(f"tf{n}") * (K1 + 1) / (F.col(f"tf{n}") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    hit = F.greatest(*(F.col(f"tf{n}") for n in range(len(terms))), F.lit(0)) > 0
    scored = rows.where(hit).join(F.broadcast(totals)).select("id", score.alias("score"))  # one row of totals
    best = scored.orderBy(F.desc(F.round("score", 9)), F.asc("id")).limit(k)
    return top(best.withColumn("q", F.lit(0)), k, ["q"], F.desc(F.round("score", 9)), F.asc("id")).drop("q")


def fuse(*ranked: DataFrame, k: int = 30, constant: int = FUSION) -> DataFrame:
    """id, score, rank by reciprocal rank fusion of lists (id, rank); the lists are top lists."""
    out = ranked[0].select("id", "rank")
    for r in ranked[1:]:
        out = out.unionByName(r.select("id", "rank"))
    summed = out.groupBy("id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score")).withColumn("q", F.lit(0))
    return top(summed, k, ["q"], F.desc(F.round("score", 12)), F.asc("id")).drop("q")


def rerank(candidates: DataFrame, score: Column, k: int = 8, id: str = "id") -> DataFrame:
    """The k best of a top list by another score."""
    return top(candidates.withColumn("relevance", score).withColumn("q", F.lit(0)), k, ["q"], F.desc("relevance"), F.asc(id)).drop("q")


def overlap(body: Column, terms: Sequence[str]) -> Column:
    """A stand-in for a cross-encoder: the share of the terms that a text has."""
    return F.size(F.array_intersect(text.words(body), F.array(*(F.lit(t.lower()) for t in terms)))) / max(1, len(set(terms)))
