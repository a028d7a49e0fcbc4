"""What a service over the tables answers, each as a DataFrame; serving them is left to the caller."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import answers, search
from tessera.operators.store import Store
from tessera.schemas import TABLES


def ask(question: str, chunks: DataFrame, entities: Mapping[str, int], interactions: DataFrame, *, k: int = 8) -> DataFrame:
    """route, effect, evidence, chunk_id, text, rank: the best chunks for a question, and for a pair of entities its reviewed interaction.

    chunks: chunk_id, text. Chunks are filtered to those on the question's entities (all of them for an interaction)
    before they are ranked. A refused question has its route alone, as has one on which there is no chunk.
    """
    spark = chunks.sparkSession
    asked = spark.createDataFrame([(question,)], "question string").select(answers.route(F.col("question")).alias("route"))
    route = asked.first().route
    named = search.tagged(spark.createDataFrame([(question,)], "text string"), dict(entities)).first().tags
    columns = "effect string, evidence string, chunk_id string, text string, rank int"
    if route == "refused":
        return asked.select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(", ")))
    about = search.tagged(chunks, dict(entities)).where(search.about(F.col("tags"), named, every=route == "interaction")) if named else chunks
    terms = [w for w in {*question.lower().replace("?", " ").split()} if w.isascii() and w.isalnum()]
    best = search.bm25(about, terms, 30, id="chunk_id").join(about.select(F.col("chunk_id").alias("id"), "text"), "id")
    ranked = search.rerank(best.drop("rank"), search.overlap(F.col("text"), terms), k).select(F.col("id").cast("string").alias("chunk_id"), "text", "rank")
    pairs = spark.createDataFrame([(a, b) for n, a in enumerate(sorted(named)) for b in sorted(named)[n + 1 :]], "a long, b long")  # of the entities of one question
    known = answers.lookup(pairs, interactions).select(F.lit(route).alias("route"), "effect", "evidence") if route == "interaction" else asked.where("false").select("route", F.lit("").alias("effect"), F.lit("").alias("evidence"))
    return asked.join(known, "route", "left").join(ranked.withColumn("route", F.lit(route)), "route", "left").select("route", "effect", "evidence", "chunk_id", "text", "rank")


def check_routine(products: Sequence[str], positions: DataFrame, interactions: DataFrame) -> DataFrame:
    """a, b, effect, evidence: the reviewed interactions among the ingredients of some products. positions: product_id, entity_id."""
    wanted = positions.where(F.col("product_id").isin(*products)).select(F.lit(0).alias("routine"), F.col("entity_id").alias("item"))
    return answers.routine_check(wanted, interactions, "routine", "item").drop("routine")


def routine_evidence(products: Sequence[str], positions: DataFrame, interactions: DataFrame, chunks: DataFrame, *, k: int = 8) -> DataFrame:
    """What check_routine flags, with the k best chunks (chunk_id, ingredient_ids, published) that are tagged with both ingredients, the newest first."""
    flagged = check_routine(products, positions, interactions).withColumn("routine", F.lit(0))
    return answers.evidence(flagged, chunks, "routine", score=F.col("published"), k=k).drop("routine")


def ingredient(store: Store, cosing_id: str) -> DataFrame:
    """An ingredient by its id: one row, or none."""
    return store.lookup(TABLES["ingredients"], cosing_id=cosing_id)


def ready(store: Store) -> DataFrame:
    """table, version, ready: whether each table has a version that can be read."""
    rows = [(t.name, max(store.versions(t), default=None)) for t in TABLES.values() if t.name != "ingestion_runs"]
    return store.spark.createDataFrame(rows, "table string, version int").withColumn("ready", F.col("version").isNotNull())
