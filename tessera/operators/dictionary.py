"""Whole-word matches of a large dictionary: one automaton over all names, one pass over the texts.

The automaton (Aho-Corasick) finds every name at every place; a match counts where no letter or digit stands on either
side, as in `functions.text.word_pattern`. It goes to the tasks in blocks of a measured size: a dictionary over
BLOCK_BYTES is several automata, which work one after the other on the rows of one scan, so what is broadcast at a time
is bounded and the texts are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20  # of names; their automaton is some 20 times as large in a task
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _automaton(names: list[tuple[str, list]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for name, ids in names:
        out.add_word(name, (len(name), ids))
    out.make_automaton()
    return out


def _found(text: str, automata: list[ahocorasick.Automaton]) -> list:
    """The ids of the names that stand in a lower-case text as whole words, in order."""
    ids: set = set()
    for a in automata:
        for end, (size, own) in a.iter(text):
            low = end - size
            if (low < 0 or text[low] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                ids.update(own)
    return sorted(ids)


def mentioned(rows: DataFrame, names: DataFrame, body: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows with `tags`: the ids of the names (id, name) that their texts have as whole words, in order, each once.

    Null and empty names match nothing, and null texts have no tags. Equal names of several ids give all of these.
    """
    kind = names.schema["id"].dataType.simpleString()
    lowered = names.select(F.lower("name").alias("name"), "id").where("name <> '' and id is not null")
    one = lowered.groupBy("name").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    size = one.agg(F.coalesce(F.sum(F.octet_length("name") + 8 * F.size("ids")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    spark, out = rows.sparkSession, rows.withColumn("tags", F.array().cast(f"array<{kind}>"))
    for block in range(blocks):
        part = [(r.name, list(r.ids)) for r in one.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).collect()]  # block_bytes at most
        if not part:
            continue
        shared = spark.sparkContext.broadcast(part)
        place, schema = rows.columns.index(body), out.schema

        def tagged(batches: Iterator[pa.RecordBatch], shared=shared, place=place, schema=schema) -> Iterator[pa.RecordBatch]:
            automata = None
            for batch in batches:
                automata = automata or [_automaton(shared.value)]
                before = batch.column(len(schema) - 1).to_pylist()
                tags = [sorted({*old, *_found((t or "").lower(), automata)}) for t, old in zip(batch.column(place).to_pylist(), before, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(tags, batch.column(len(schema) - 1).type)], schema=batch.schema)

        out = out.mapInArrow(tagged, schema)
    return out
