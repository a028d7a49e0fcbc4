"""Registry search responses: JSON pages of ingredients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

# Fields that make up an ingredient's restrictions.
RESTRICTIONS = ("annexNo", "refNo", "cosmeticRestriction", "maximumConcentration", "wordingOfConditions", "otherRestrictions", "sccsOpinion")


def valid(payload: Column) -> Column:
    """Whether a response holds results and isn't an error that came as success."""
    parsed = F.try_parse_json(payload)
    return F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, "$.results", "variant")).startswith("ARRAY"), F.lit(False))


def faults(answers: DataFrame) -> DataFrame:
    """key, fault of answers (key, payload)."""
    return answers.select("key", F.when(~valid(F.col("payload")), "not a search result").alias("fault"))


def restrictions(metadata: Column) -> Column:
    """The restriction fields that have values; null if none has."""
    entries = [F.struct(F.lit(f).alias("key"), text.variant_values(metadata, f).alias("value")) for f in RESTRICTIONS]
    found = F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))
    return F.when(F.size(found) > 0, found)


def cas(values: Column) -> Column:
    """The first number as it is written; null if it is only blanks, slashes and dashes."""
    first = F.try_element_at(values, F.lit(1))
    return F.when(F.regexp_replace(first, "[ /-]", "") != "", first)


def ingredients(metadata: DataFrame, column: str = "metadata") -> DataFrame:
    """One row for each usable VARIANT of metadata; other columns stay in front."""
    m = F.col(column)
    ids, names = text.variant_values(m, "substanceId"), text.variant_values(m, "inciName")
    usable = (text.variant_values(m, "itemType") == F.array(F.lit("ingredient"))) & (F.size(ids) > 0) & (F.size(names) > 0)
    rest = [c for c in metadata.columns if c != column]
    return metadata.where(usable).select(
        *rest,
        ids[0].alias("cosing_id"),
        names[0].alias("inci_name"),
        text.variant_values(m, "functionName").alias("functions"),
        restrictions(m).alias("restrictions"),
        cas(text.variant_values(m, "casNo")).alias("cas_number"),
    )


def parse(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The ingredients of each payload, with their place in it; invalid payloads give none, as `valid` tells."""
    results = F.try_variant_get(F.try_parse_json(F.col(payload)), "$.results", "array<variant>")
    rest = [c for c in payloads.columns if c != payload]
    each = payloads.select(*rest, F.posexplode(results).alias("position", "result"))
    return ingredients(each.withColumn("metadata", F.try_variant_get("result", "$.metadata", "variant")).drop("result"))
