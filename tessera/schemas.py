"""Tables, their keys and their checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(required: dict[str, T.DataType], optional: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, False) for n, t in required.items()] + [T.StructField(n, t, True) for n, t in optional.items()])


_TEXT, _TEXTS, _TIME = T.StringType(), T.ArrayType(T.StringType()), T.TimestampType()
INGREDIENTS = _struct({"cosing_id": _TEXT, "inci_name": _TEXT, "functions": _TEXTS, "updated_at": _TIME}, {"restrictions": T.MapType(_TEXT, _TEXTS), "cas_number": _TEXT})
PRODUCTS = _struct({"source": _TEXT, "source_id": _TEXT, "name": _TEXT, "raw_ingredient_text": _TEXT, "updated_at": _TIME}, {"brand": _TEXT, "category": _TEXT})
DOCUMENTS = _struct(
    {"source": _TEXT, "source_id": _TEXT, "title": _TEXT, "url": _TEXT, "license": _TEXT, "updated_at": _TIME},
    {"pmid": _TEXT, "published_at": T.DateType(), "abstract": _TEXT, "full_text": _TEXT},
)
RUNS = _struct(
    {"run_id": _TEXT, "dag": _TEXT, "started_at": _TIME, "status": _TEXT, "counts": T.MapType(_TEXT, T.LongType()), "errors": _TEXTS},
    {"finished_at": _TIME},
)

ALIASES = _struct({"alias": _TEXT, "ingredient_id": T.LongType(), "source": _TEXT, "updated_at": _TIME}, {"confidence": T.DoubleType()})
PRODUCT_INGREDIENTS = _struct({"product_id": _TEXT, "position": T.IntegerType(), "updated_at": _TIME}, {"ingredient_id": T.LongType(), "match_confidence": T.DoubleType()})
CHUNKS = _struct({"chunk_id": _TEXT, "document_id": _TEXT, "text": _TEXT, "updated_at": _TIME}, {"embedding": T.ArrayType(T.FloatType()), "ingredient_ids": T.ArrayType(T.LongType())})
INTERACTIONS = _struct(
    {"ingredient_a": T.LongType(), "ingredient_b": T.LongType(), "effect": _TEXT, "updated_at": _TIME},
    {"evidence_level": _TEXT, "chunk_ids": T.ArrayType(_TEXT), "reviewed": T.BooleanType()},
)
EVAL_RUNS = _struct({"run_id": _TEXT, "started_at": _TIME, "metric": _TEXT}, {"value": T.DoubleType()})


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    key: tuple[str, ...]
    lengths: dict[str, int]


TABLES = {
    t.name: t
    for t in (
        Table("ingredients", INGREDIENTS, ("cosing_id",), {"cosing_id": 32}),
        Table("products", PRODUCTS, ("source", "source_id"), {"source": 32, "source_id": 64}),
        Table("documents", DOCUMENTS, ("source", "source_id"), {"source": 32, "source_id": 64, "pmid": 16}),
        Table("ingredient_aliases", ALIASES, ("alias", "ingredient_id"), {"source": 32}),
        Table("product_ingredients", PRODUCT_INGREDIENTS, ("product_id", "position"), {"product_id": 64}),
        Table("chunks", CHUNKS, ("chunk_id",), {}),
        Table("interactions", INTERACTIONS, ("ingredient_a", "ingredient_b", "effect"), {"evidence_level": 16}),
        Table("eval_runs", EVAL_RUNS, ("run_id", "metric"), {"metric": 64}),
        Table("ingestion_runs", RUNS, ("run_id",), {"dag": 64, "status": 16}),
    )
}


def violations(table: Table) -> Column:
    """The names of the checks that a row fails: nulls where none may be, and texts over their length."""
    nulls = [F.when(F.col(f.name).isNull(), F.lit(f"{f.name} is null")) for f in table.schema if not f.nullable and f.name != "updated_at"]
    long = [F.when(F.length(c) > n, F.lit(f"{c} is over {n} characters")) for c, n in table.lengths.items()]
    return F.array_compact(F.array(*nulls, *long))


def create(spark: SparkSession, table: Table, database: str = "default") -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{table.name} ({columns}) USING parquet")


def drop(spark: SparkSession, table: Table, database: str = "default") -> None:
    spark.sql(f"DROP TABLE IF EXISTS {database}.{table.name}")


def empty(spark: SparkSession, table: Table) -> DataFrame:
    return spark.createDataFrame([], table.schema)
