"""Metrics of retrieval, resolution and answers, and the regression gate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.shared import kept
from tessera.operators.store import Store, load
from tessera.schemas import TABLES


def retrieval(ranked: DataFrame, gold: DataFrame, k: int = 8) -> DataFrame:
    """recall_at_k (questions with a gold id among the first k), mrr, questions; ranked: question, id, rank; gold: question, id."""
    return _found(gold.join(ranked, ["question", "id"], "left").groupBy("question").agg(F.min("rank").alias("rank")), k)


def _found(first: DataFrame, k: int) -> DataFrame:
    return first.agg(
        F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias("recall_at_k"),
        F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
        F.count("*").alias("questions"),
    )


def retrieval_by_class(ranked: DataFrame, questions: DataFrame, items: DataFrame, k: int = 8) -> DataFrame:
    """`retrieval` where the gold ids of a question are the other items of its class; ranked: question, id, rank; questions: question, class; items: id, class.

    Only what is ranked is looked up, so no pairs of a class are made: a question has gold if its class has another item.
    """
    asked = questions.where("class is not null").select("question", "class").distinct()
    has = items.groupBy("class").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    with_gold = asked.join(has, "class").where((F.col("low") != F.col("question")) | (F.col("high") != F.col("question"))).select("question").distinct()
    hits = ranked.where(F.col("question") != F.col("id")).join(asked, "question").join(items.select("id", "class").distinct(), ["id", "class"], "left_semi")
    first = with_gold.join(hits.groupBy("question").agg(F.min("rank").alias("rank")), "question", "left")
    return _found(first, k)


def precision_recall(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    counts = rows.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def share(rows: DataFrame, **conditions: Column) -> DataFrame:
    """The share of rows for which each condition holds, nulls left out: faithfulness, citation validity, refusal accuracy."""
    return rows.agg(*(F.avg(c.cast("double")).alias(n) for n, c in conditions.items()))


SKETCH = 4096  # values of a KLL sketch: a rank is off by some 0.05 % of all
GRID = 1024  # quantiles that are read off a sketch
RANKED = 1 << 16  # values between two bounds that are put in order


def sketches(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """by, sketch: a mergeable sketch of each group's values, of bounded size; nulls don't count. Those of days make one of a year."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH).alias("sketch"))


def merged(sketched: DataFrame, *by: str) -> DataFrame:
    return sketched.groupBy(*by).agg(F.kll_merge_agg_double("sketch", SKETCH).alias("sketch"))


def latency(rows: DataFrame, value: str, by: str, share: float = 0.95, sketched: DataFrame | None = None, ranked: int = RANKED) -> DataFrame:
    """by, p95: the exact quantile of each group, interpolated between its neighbours; nulls don't count.

    A group's sketch (made here, or given as by, sketch) says between which values the wanted places lie, up to its error;
    what is below is counted, what is between is sketched again, until no group has more than `ranked` different values
    between its bounds. Only these are put in order, equal ones as one, so neither tails nor a value that many rows
    share make a task large. Each round reads the values once and narrows the bounds some two hundredfold.
    """
    given = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
    bounds = kept(given.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    sketch = given.groupBy("g").agg(F.kll_sketch_agg_double("v", SKETCH).alias("sketch")) if sketched is None else sketched.select(F.col(by).alias("g"), "sketch")
    same = F.col("a.g").eqNullSafe(F.col("b.g"))
    at = (F.col("n") - 1) * F.lit(share)  # places from 0
    below = F.lit(0).cast("long")
    bounds = bounds.withColumn("below", below)
    for _ in range(8):
        # Among the values between, the wanted places; the sketch's answers to a little before and after are tried as new bounds.
        inside = bounds.alias("a").join(sketch.alias("b"), same).select("a.g", "n", "low", "high", "below", "sketch")
        held = F.greatest(F.kll_sketch_get_n_double("sketch"), F.lit(1))
        cuts = F.kll_sketch_get_quantile_double("sketch", F.array(*(F.lit(k / GRID) for k in range(GRID + 1))))
        place = lambda p, off: F.greatest(F.least(F.floor((p - F.col("below")) / held * GRID) + 1 + off, F.lit(GRID + 1)), F.lit(1)).cast("int")
        first, last = (F.element_at("cuts", place(f(at), off)) for f, off in ((F.floor, -2), (F.ceil, 3)))
        inside = inside.withColumn("cuts", cuts)
        tried = kept(inside.select("g", "n", "low", "high", F.greatest(first, F.col("low")).alias("first"), F.least(last, F.col("high")).alias("last")))
        counts = given.alias("a").join(tried.alias("b"), same).groupBy("b.g", "n", "low", "high", "first", "last").agg(F.count_if(F.col("v") < F.col("first")).alias("before"), F.count_if(F.col("v") <= F.col("last")).alias("to"), F.count_if(F.col("v") < F.col("low")).alias("older"))
        # A sketch's bound is taken where it proves right.
        fits_low, fits_high = F.col("before") <= F.floor(at), F.col("to") > F.ceil(at)
        bounds = kept(counts.select("g", "n", F.when(fits_low, F.col("first")).otherwise(F.col("low")).alias("low"), F.when(fits_high, F.col("last")).otherwise(F.col("high")).alias("high"), F.when(fits_low, F.col("before")).otherwise(F.col("older")).alias("below")))
        between = given.alias("a").join(bounds.alias("b"), same).where(F.col("v").between(F.col("low"), F.col("high"))).select("b.g", "n", "below", "v")
        values = between.groupBy("g", "n", "below", "v").agg(F.count("*").alias("times"))
        most = values.groupBy("g").count().agg(F.max("count")).first()[0] or 0
        if most <= ranked:
            break
        sketch = between.groupBy("g").agg(F.kll_sketch_agg_double("v", SKETCH).alias("sketch"))
    up_to = F.sum("times").over(Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = values.withColumn("to", F.col("below") + up_to)
    low, high = (F.min(F.when(F.col("to") > f(at), F.col("v"))) for f in (F.floor, F.ceil))
    found = placed.groupBy("g", "n").agg(low.alias("x"), high.alias("y"))
    return found.select(F.col("g").alias(by), (F.col("x") + (F.col("y") - F.col("x")) * (at - F.floor(at))).alias("p95"))


def ablations(rows: DataFrame, stages: Sequence[str], predicted: str, stage: str, actual: str, id: str, draws: int = 200) -> DataFrame:
    """left_out, tp, fp, fn, precision, recall, f1, f1_low, f1_high for the whole cascade ('' left out) and for it without each stage, in one pass.

    rows: a labelled mention with what is predicted, by which stage, and what is right; nulls stand for no answer. What a
    left-out stage has answered counts as unanswered. The interval holds 95 % of `draws` Poisson bootstraps: a mention's
    weight in each is a Poisson(1) number that follows from its id, so any partitioning gives the same.
    """
    if not stages:
        raise ValueError("there is no stage")
    right = F.col(predicted).isNotNull() & F.col(predicted).eqNullSafe(F.col(actual))
    told = rows.select(
        F.coalesce(F.when(F.col(predicted).isNotNull(), F.col(stage)), F.lit("")).alias("stage"),
        right.alias("right"), (F.col(predicted).isNotNull() & ~right).alias("wrong"), F.col(actual).isNotNull().alias("has"),
        F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))).alias("draw"), F.col(id).alias("id"),
    )
    u = (F.pmod(F.xxhash64("draw", "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight, p, total = F.lit(0), math.exp(-1), 0.0
    for k in range(12):
        total += p
        weight = weight + (u > F.lit(total)).cast("int")
        p /= k + 1
    weighed = told.withColumn("w", F.when(F.col("draw") < 0, 1).otherwise(weight).cast("long"))
    # One pass: sums by stage and draw, and over all stages of a draw.
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("w"))), F.lit(0))
    sums = kept(weighed.groupingSets([[F.col("stage"), F.col("draw")], [F.col("draw")]], "stage", "draw").agg(F.grouping("stage").alias("all"), count("right").alias("right"), count("wrong").alias("wrong"), count("has").alias("has")))
    whole = sums.where(F.col("all") == 1).select("draw", F.col("right").alias("r"), F.col("wrong").alias("w"), F.col("has").alias("h"))
    names = rows.sparkSession.createDataFrame([("",), *((s,) for s in stages)], "left_out string")
    own = sums.where((F.col("all") == 0) & (F.col("stage") != "")).select(F.col("stage").alias("left_out"), "draw", "right", "wrong")
    each = whole.join(F.broadcast(names)).join(own, ["left_out", "draw"], "left")  # draws times stages rows
    tp, fp = (F.col(a) - F.coalesce(b, F.lit(0)) for a, b in (("r", "right"), ("w", "wrong")))
    scored = each.select("left_out", "draw", tp.alias("tp"), fp.alias("fp"), (F.col("h") - tp).alias("fn"))
    scored = scored.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))
    range_ = scored.where("draw >= 0").groupBy("left_out").agg(F.percentile("f1", F.lit(0.025)).alias("f1_low"), F.percentile("f1", F.lit(0.975)).alias("f1_high"))
    main = scored.where("draw < 0").select("left_out", "tp", "fp", "fn", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), "f1")
    return main.join(range_, "left_out", "left")


def cost(calls: DataFrame, prices: DataFrame, by: str) -> DataFrame:
    """by, calls, cost, mean: what the answers of each kind cost; calls: call, by, part, units; prices: part, price of a unit, a row for each part of the service."""
    priced = calls.join(F.broadcast(prices), "part")
    return priced.groupBy(by).agg(F.countDistinct("call").alias("calls"), F.sum(F.col("units") * F.col("price")).alias("cost")).withColumn("mean", F.col("cost") / F.col("calls"))


def recorded(store: Store, run_id: str, metrics: DataFrame, started_at: datetime) -> dict[str, int]:
    """Stores a run's metrics, one row with a column each, in the table of evaluation runs; a run that is recorded again replaces its values."""
    names = [c for c, t in metrics.dtypes if t in ("double", "float", "int", "bigint", "boolean")]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names)))
    rows = metrics.select(pairs.alias("m")).select(F.lit(run_id).alias("run_id"), F.lit(started_at).alias("started_at"), "m.*")
    return load(store, TABLES["eval_runs"], rows)


def regressions(store: Store, metric: str, most: float = 3.0) -> DataFrame:
    """`gate` over what is stored of a metric, by the runs' beginnings."""
    runs = store.read(TABLES["eval_runs"]).where(F.col("metric") == metric)
    return gate(runs.select("started_at", "value"), "started_at", "value", most)


def gate(metrics: DataFrame, order: str, value: str, most: float = 3.0) -> DataFrame:
    """Each run's value, the one before and whether it fell by more than `most`. metrics has a row a run: one partition holds them."""
    before = F.lag(value).over(Window.partitionBy(F.lit(0)).orderBy(order))
    return metrics.select(order, value, before.alias("before"), F.coalesce(before - F.col(value) > most, F.lit(False)).alias("regressed"))
