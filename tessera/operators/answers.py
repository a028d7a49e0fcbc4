"""Interactions, suitability, routines, citations and the routing of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.relational import first_wins, top

# How strong each kind of evidence is.
EVIDENCE = {"clinical trial": "strong", "small study": "moderate", "in vitro": "weak", "anecdotal": "weak"}
MEDICAL = r"\b(prescri\w*|infect\w*|severe|pregnan\w*|bleed\w*|swollen|swelling)\b"
FEW = 32  # items of a routine that makes its pairs
ROUTES = (
    ("refused", MEDICAL),
    ("routine_check", r"\b(routine|regimen|morning and night|all of these)\b"),
    ("interaction", r"\b(together|combine|mix|layer|with)\b"),
    ("suitability", r"\b(suitable|safe for|good for|oily|dry|sensitive)\b"),
)


def evidence_level(kind: Column) -> Column:
    out = F.lit("weak")
    for k, level in EVIDENCE.items():
        out = F.when(F.lower(kind) == k, level).otherwise(out)
    return out


def route(question: Column) -> Column:
    """One of four classes, or refused for medical questions, which get no advice."""
    out = F.lit("info")
    for name, pattern in reversed(ROUTES):
        out = F.when(text.lowered(question).rlike(pattern.replace(r"\b", text.EDGE)), name).otherwise(out)
    return out


def reviewed(interactions: DataFrame) -> DataFrame:
    """a, b (a < b), effect, evidence: the pairs that may be shown; of several rows of a pair the first by effect, then evidence."""
    pairs = interactions.where("reviewed").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "effect", "evidence")
    return first_wins(pairs.withColumn("o", F.struct("effect", "evidence")), ["a", "b"], ["o"]).drop("o")


def queue(interactions: DataFrame) -> DataFrame:
    return interactions.where(~F.coalesce("reviewed", F.lit(False)))


def lookup(pairs: DataFrame, interactions: DataFrame) -> DataFrame:
    """pairs (a, b in either order) with the reviewed interaction of each."""
    low = pairs.withColumns({"__a": F.least("a", "b"), "__b": F.greatest("a", "b")})
    known = reviewed(interactions).withColumnsRenamed({"a": "__a", "b": "__b"})
    return low.join(known, ["__a", "__b"]).drop("__a", "__b")


def routine_pairs(items: DataFrame, group: str, item: str) -> DataFrame:
    """group, a, b: the pairs of distinct items in each routine, which is as short as a routine is."""
    own = items.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    a, b = own.alias("a"), own.alias("b")
    return a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.i") < F.col("b.i"))).select(F.col("a.g").alias(group), F.col("a.i").alias("a"), F.col("b.i").alias("b"))


def routine_check(items: DataFrame, interactions: DataFrame, group: str, item: str) -> DataFrame:
    """group, a, b, effect, evidence: the reviewed interactions within each routine.

    A routine of at most FEW items makes the pairs of those that interact with anything, at most FEW / 2 for each, and
    pairs look up their interaction. In larger ones no pairs are made (_within_large). Items and pairs meet what is
    grouped by them as structs (items of the same type), so both sides are dealt out anew and Spark can split a frequent one.
    """
    known = reviewed(interactions)
    either = interactions.where("reviewed").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    ends = either.select(F.explode(F.array("a", "b")).alias("x"), (F.col("a") == F.col("b")).alias("same")).groupBy("x").agg(F.bool_or("same").alias("same"))
    own = items.select(F.col(group).alias("g"), F.col(item).alias("i"))
    sizes = own.groupBy("g").agg(F.count("*").alias("n"))
    key = (lambda c: F.struct(F.col(c).alias("x"))) if own.schema["i"].dataType == ends.schema["x"].dataType else F.col
    met = own.select("g", key("i").alias("i")).join(ends.select(key("x").alias("end"), "x", "same"), F.col("i") == F.col("end"))
    some = met.select("g", "x", "same").join(sizes.where(F.col("n") <= FEW).select("g"), "g")
    lists = some.groupBy("g").agg(F.array_sort(F.collect_set(F.struct("x", "same"))).alias("xs"))
    each = lists.select("g", "xs", F.posexplode("xs").alias("at", "one"))
    later = F.expr("slice(xs, at + if(one.same, 1, 2), size(xs))")  # an item that interacts with itself is a pair of its own
    pairs = each.select("g", F.col("one.x").alias("a"), F.explode(later).alias("two")).select("g", "a", F.col("two.x").alias("b"))
    found = pairs.unionByName(_within_large(own.join(sizes.where(F.col("n") > FEW), "g", "left_semi"), either))
    met = found.select("g", F.struct("a", "b").alias("pair")).join(known.select(F.struct("a", "b").alias("pair"), "effect", "evidence"), "pair")
    return met.select(F.col("g").alias(group), "pair.a", "pair.b", "effect", "evidence")


def _within_large(own: DataFrame, either: DataFrame) -> DataFrame:
    """g, a, b: the pairs of `either` (a <= b) within each routine (g, i).

    Each pair hangs on the one of its two items that has fewer of them, items of a routine find what hangs on them, and
    what they find stays if the routine has the other item too. So the work is that of the items' interactions, whatever
    the routines' sizes, and an item that interacts with all others costs little.
    """
    there = own.select("i").distinct()
    pairs = either.join(there, F.col("a") == F.col("i"), "left_semi").join(there, F.col("b") == F.col("i"), "left_semi").distinct()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count("*").alias("degree"))
    marked = pairs.join(ends.select(F.col("x").alias("a"), F.col("degree").alias("da")), "a").join(ends.select(F.col("x").alias("b"), F.col("degree").alias("db")), "b")
    fewer = F.col("da") <= F.col("db")
    hung = marked.select("a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("y"))
    once = own.distinct()
    half = once.join(hung, F.col("i") == F.col("x")).select("g", "y", "a", "b")
    return half.join(once.select("g", F.col("i").alias("y")), ["g", "y"], "left_semi").select("g", "a", "b")


def evidence(flagged: DataFrame, chunks: DataFrame, group: str, *, chunk: str = "chunk_id", ids: str = "ingredient_ids", score: Column | None = None, k: int = 8) -> DataFrame:
    """flagged (group, a, b and more) with the k best chunks that are tagged with both of a pair: chunk, rank. A pair without any isn't there.

    Pairs are ranked once, however many groups share them: chunks meet the distinct pairs on the rarer of their two
    items and keep those that have the other, so no pairs of a chunk's tags are made.
    """
    pairs = flagged.select("a", "b").distinct()
    each = chunks.select(F.col(chunk).alias("chunk__"), F.col(ids).alias("ids__"), (F.lit(0) if score is None else score).alias("score__"))
    items = pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct()
    tagged = each.select("chunk__", "ids__", "score__", F.explode(F.array_distinct("ids__")).alias("x"))
    often = tagged.join(items, "x", "left_semi").groupBy("x").agg(F.count("*").alias("n"))
    rarity = pairs.join(often.select(F.col("x").alias("a"), F.col("n").alias("na")), "a").join(often.select(F.col("x").alias("b"), F.col("n").alias("nb")), "b")
    hung = rarity.select("a", "b", F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("x"))
    both = tagged.join(hung, "x").where(F.array_contains("ids__", F.col("a")) & F.array_contains("ids__", F.col("b")))
    best = top(both, k, ["a", "b"], F.desc("score__"), F.asc("chunk__")).select("a", "b", F.col("chunk__").alias(chunk), "rank")
    return flagged.join(best, ["a", "b"])


def suitability(ingredients: DataFrame, flags: DataFrame, product: str, item: str) -> DataFrame:
    """product, n_items, n_flagged, flagged (in order), suitable, for every product."""
    marked = ingredients.select(product, item).distinct().join(flags.select(item).distinct().withColumn("__flag", F.lit(True)), item, "left")
    return marked.groupBy(product).agg(
        F.count("*").alias("n_items"),
        F.count("__flag").alias("n_flagged"),
        F.array_sort(F.collect_list(F.when(F.col("__flag"), F.col(item)))).alias("flagged"),
    ).withColumn("suitable", F.col("n_flagged") == 0)


def ingredient_positions(products: DataFrame, id: str, listed: str) -> DataFrame:
    """id, position (from 1), name: the entries of each ingredient list, in its order, which is about that of concentration."""
    each = F.posexplode(F.split(F.col(listed), r",(?![^(]*\))"))
    named = products.select(F.col(id).alias("id"), each.alias("at", "name")).select("id", (F.col("at") + 1).alias("position"), F.trim("name").alias("name"))
    return named.where("name <> ''")


def valid_claims(claims: DataFrame, chunks: DataFrame, claim: str = "claim_id", cited: str = "chunk_ids", chunk: str = "chunk_id") -> DataFrame:
    """The claims all of whose citations exist; a claim without citations is dropped."""
    each = claims.select(claim, F.explode(cited).alias("__cited"))
    missing = each.join(chunks.select(F.col(chunk).alias("__cited")).distinct(), "__cited", "left_anti").select(claim).distinct()
    return claims.where(F.size(cited) > 0).join(missing, claim, "left_anti")
