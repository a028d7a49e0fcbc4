"""A stored inverted index: batches of questions read the postings of their own terms, and of those the blocks that can matter.

Texts are dealt to blocks by a hash of their id. A row is a term in a block: the ids of the block's texts that have it,
how often, and how long they are, with the greatest frequency and the least length as bounds. Rows are stored by a hash
of the term and in order of terms, so a scan for some terms skips nearly all files and row groups. New texts are a new
segment; the figures of the whole corpus (texts, mean length, texts with a term) come from all segments at the time of a
question, so segments give the scores of one index made at once. An id belongs into one segment.

A question's best k: bounds of all its blocks are added up from the narrow columns. The blocks with the greatest bounds
are scored first, as many as hold 2 k texts with their rarest term; the k-th best score there is one that the result has
at least, so blocks whose bound is below it are never opened. No step holds a term's whole postings: a hot term is many blocks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.relational import top
from tessera.operators.search import K1, B
from tessera.operators.shared import kept

BLOCK = 512  # texts
BUCKETS = 64
LISTED = 2000  # terms of a batch that a filter of the scan names; beyond, a join finds them


def _rounded(score: str) -> Column:
    return F.desc(F.round(score, 9))


class Postings:
    """Segments of an index under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def segments(self) -> list[dict]:
        """number, texts and words of each segment; one whose figures aren't there yet isn't read."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/figures")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return []
        return sorted((json.loads(r.value) for r in self.spark.read.text(f"{self.root}/figures").collect()), key=lambda s: s["number"])

    def add(self, documents: DataFrame, id: str = "id", body: str = "text") -> dict:
        """A segment of texts; texts without words count as texts. Its figures are written last, which makes it visible."""
        number = len(self.segments())
        words = documents.select(F.col(id).alias("id"), text.words(F.coalesce(F.col(body), F.lit(""))).alias("w"))
        texts, total = words.agg(F.count("*"), F.coalesce(F.sum(F.size("w")), F.lit(0))).first()
        block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-texts // BLOCK)))).cast("int")
        kind = words.schema["id"].dataType.simpleString()
        each = words.mapInArrow(_counted, f"id {kind}, term string, tf int, length int").withColumn("block", block)
        posting = F.struct("id", "tf", "length")
        rows = each.groupBy("term", "block").agg(F.array_sort(F.collect_list(posting)).alias("p"), F.count("*").alias("n"), F.max("tf").alias("most"), F.min("length").alias("least"))
        out = rows.select("term", "block", "n", "most", "least", "p", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        out.repartition("bucket").sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings/segment={number}")
        figures = {"number": number, "texts": texts, "words": total, "kind": kind}
        self.spark.createDataFrame([(json.dumps(figures),)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/figures")
        return figures

    def of(self, terms: DataFrame) -> DataFrame:
        """The postings of terms (term), from the buckets and row groups that can have them."""
        segments = self.segments()
        kind = segments[0]["kind"] if segments else "long"
        schema = f"term string, block int, n long, most int, least int, p array<struct<id: {kind}, tf: int, length: int>>, bucket int"
        some = [r.term for r in terms.limit(LISTED + 1).collect()]
        numbered = terms.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        buckets = [r.bucket for r in numbered.distinct().collect()]  # BUCKETS at most
        out = None
        for s in segments:
            rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/postings/segment={s['number']}").parquet(f"{self.root}/postings/segment={s['number']}")
            rows = rows.where(F.col("bucket").isin(*buckets))
            rows = (rows.where(F.col("term").isin(*some)) if len(some) <= LISTED else rows.join(terms, "term", "left_semi")).withColumn("segment", F.lit(s["number"]))
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], f"{schema}, segment int") if out is None else out

    def best(self, questions: DataFrame, k: int = 30, question: str = "question", terms: str = "terms") -> DataFrame:
        """question, id, score, rank: the k best texts for the terms (an array) of each question, as `search.bm25` ranks them; null terms, repeated ones and those in capitals don't count twice."""
        scored, _ = self._scored(questions, k, question, terms)
        return top(scored, k, ["question"], _rounded("score"), F.asc("id")).withColumnRenamed("question", question)

    def opened(self, questions: DataFrame, k: int = 30, question: str = "question", terms: str = "terms") -> tuple[int, int]:
        """(blocks that are scored, blocks that have a term of a question)."""
        _, blocks = self._scored(questions, k, question, terms)
        return blocks.where("wanted").count(), blocks.count()

    def _scored(self, questions: DataFrame, k: int, question: str, terms: str) -> tuple[DataFrame, DataFrame]:
        asked = questions.select(F.col(question).alias("question"), F.explode(F.array_distinct(F.transform(terms, F.lower))).alias("term")).where("term is not null").distinct()
        segments = self.segments()
        texts, words = sum(s["texts"] for s in segments), sum(s["words"] for s in segments)
        found = self.of(asked.select("term").distinct())
        narrow = kept(found.select("segment", "block", "term", "n", "most", "least"))
        idf = F.log(1 + (F.lit(texts) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = kept(asked.join(narrow.groupBy("term").agg(F.sum("n").alias("df")), "term").select("question", "term", idf.alias("idf")))

        def part(tf: str, length: str) -> Column:
            return F.col("idf") * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / F.lit(words / max(texts, 1))))

        bounds = narrow.join(weights, "term").groupBy("question", "segment", "block").agg(F.sum(part("most", "least")).alias("bound"), F.min("n").alias("hits"))
        order = Window.partitionBy("question").orderBy(F.desc("bound"), "segment", "block").rowsBetween(Window.unboundedPreceding, -1)
        bounds = kept(bounds.withColumn("first", F.coalesce(F.sum("hits").over(order), F.lit(0)) < 2 * k))

        def scores(blocks: DataFrame) -> DataFrame:
            wanted = blocks.select("question", "segment", "block").join(weights, "question")
            rows = found.select("segment", "block", "term", "p").join(wanted, ["segment", "block", "term"])
            each = rows.select("question", "idf", F.explode("p").alias("e")).select("question", "idf", "e.id", "e.tf", "e.length")
            return each.groupBy("question", "id").agg(F.sum(part("tf", "length")).alias("score"))

        before = kept(top(scores(bounds.where("first")), k, ["question"], _rounded("score"), F.asc("id")))
        floor = before.where(F.col("rank") == k).select("question", (F.col("score") - 1e-6).alias("floor"))  # what rounding may do
        blocks = bounds.join(floor, "question", "left").withColumn("wanted", F.col("first") | F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
        return before.drop("rank").unionByName(scores(blocks.where("wanted and not first"))), blocks


SLICE_WORDS = 1 << 18  # words that are counted at once


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, term, tf, length of each different word of each row, by slices of SLICE_WORDS or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("w")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_WORDS, side="right")))
            yield from _counts(batch.slice(at, to - at))
            at = to


def _counts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    w = batch.column("w")
    row, word = pc.list_parent_indices(w), pc.list_flatten(w)
    counts = pa.table({"row": row, "term": word}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
    if not counts.num_rows:
        return
    at = counts.column("row").combine_chunks()
    columns = [batch.column("id").take(at), counts.column("term").combine_chunks(), counts.column("count_all").combine_chunks().cast(pa.int32()), pc.list_value_length(w).take(at)]
    yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["id", "term", "tf", "length"])
