"""Benchmark decontamination by suffix arrays over the training words.

Every shard of documents (a few megabytes, whole texts) gets a suffix array of
its words. Each suffix of each benchmark item is binary-searched in it: the
interval of suffixes that start with the item's window gives every occurrence,
and the neighbours of the place found give the longest verbatim match and where
it is. Nothing is shuffled: a document's verdict needs its own shard and the
benchmark, which is sent to the executors in blocks of a checked size; more
blocks mean more passes, whose results meet by document.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z folded;
a document's word is the benchmark's only if their bytes are equal.
Null and empty texts have no words and are never hit. Items without words are
never found. Repeated items count by id. Rows with equal doc_id stay apart as
long as the benchmark fits one block; with more blocks they are told apart by a
row number given before the passes. Empty tables on either side give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm import _spark, _words

WINDOW = 13
BLOCK_BYTES = 32 << 20
SCHEMA = "n_words long, n_hit long, items array<{id}>, longest long, longest_item {id}, longest_at long, hits binary"


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; only suffixes that still tie are sorted again.

    The end of the array is smaller than any token.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(tokens, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    ordered = tokens[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = 1
    while True:
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(tied):
            return order
        at = order[tied]
        own, then = rank[at], rank[np.minimum(at + depth, n)]
        again = np.lexsort((then, own))
        at, own, then = at[again], own[again], then[again]
        order[tied] = at
        first = np.r_[True, (own[1:] != own[:-1]) | (then[1:] != then[:-1])]
        new[tied] = first
        rank[at] = np.maximum.accumulate(np.where(first, tied, 0))
        depth *= 2


class Items:
    """The windows and suffixes of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str], window: int):
        kept = [(i, t or "") for i, t in zip(ids, texts, strict=True)]
        data = np.frombuffer("".join(t for _, t in kept).encode(), np.uint8)
        offsets = np.cumsum([0, *(len(t.encode()) for _, t in kept)])
        found = _words.words(data, offsets, _words.NOT_ALNUM, lower=True)
        self.ids, self.row, self.text = [i for i, _ in kept], found.row, _words.Bytes(_words.lowered(data))
        numbers, first = _words.identify(self.text, found)
        order = np.argsort(found.hash[first], kind="stable")
        first = first[order]
        # The vocabulary: distinct words by hash; `other` has the place in it of each of the items' words.
        self.hash, self.word_start, self.word_end = found.hash[first], found.start[first], found.end[first]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.other = place[numbers]
        self.ends = _words.by_row(found.row, len(kept))[1:][found.row] if len(found.row) else found.row
        starts = np.arange(len(self.row))
        length = self.ends - starts
        first = np.r_[True, self.row[1:] != self.row[:-1]] if len(self.row) else np.zeros(0, bool)
        self.start = starts
        self.length = np.minimum(length, window)
        self.is_window = (length >= window) | first

    def places(self, text: _words.Bytes, found: _words.Words) -> np.ndarray:
        """For each word, its place in the vocabulary or -1. The hash only finds what is compared."""
        out, n = np.full(len(found.hash), -1), len(self.hash)
        at = np.searchsorted(self.hash, found.hash)
        open_ = np.arange(len(at))
        while len(open_):
            open_ = open_[at[open_] < n]
            open_ = open_[self.hash[at[open_]] == found.hash[open_]]
            c = at[open_]
            same = _words.equal(text, found.start[open_], found.end[open_], self.text, self.word_start[c], self.word_end[c])
            out[open_[same]] = c[same]
            open_ = open_[~same]
            at[open_] += 1
        return out


def _match(tokens: np.ndarray, n: int, at: np.ndarray, other: np.ndarray, start: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many tokens from `at` equal those of `other` from `start`, at most `most`."""
    length, alive = np.zeros(len(at), np.int64), np.flatnonzero((at >= 0) & (at < n))
    k = 0
    while len(alive):
        a, b = at[alive] + k, start[alive] + k
        alive = alive[(k < most[alive]) & (a < n)]
        a, b = at[alive] + k, start[alive] + k
        alive = alive[tokens[a] == other[b]]
        k += 1
        length[alive] = k
    return length


def search(tokens: np.ndarray, order: np.ndarray, other: np.ndarray, start: np.ndarray, length: np.ndarray, right: bool) -> np.ndarray:
    """For each pattern other[start:start+length], how many suffixes are smaller (right: smaller or starting with it)."""
    n = len(order)
    low, high = np.zeros(len(start), np.int64), np.full(len(start), n)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        at, b, most = order[middle], start[open_], length[open_]
        same = _match(tokens, n, at, other, b, most)
        ended = same == most
        past = at + same >= n
        less = np.where(ended, right, past | (tokens[np.minimum(at + same, n - 1)] < other[np.minimum(b + same, len(other) - 1)]))
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


def _shard(data: np.ndarray, offsets: np.ndarray, items: Items) -> Iterator[tuple]:
    """n_words, n_hit, items found, longest match, its item, its first word, the hit words, for each row of a shard."""
    n_rows, found = len(offsets) - 1, _words.words(data, offsets, _words.NOT_ALNUM, lower=True)
    edges = _words.by_row(found.row, n_rows)
    counts = np.diff(edges)
    nothing = (0, [], 0, None, None, np.zeros(0, np.int64))
    place = items.places(_words.Bytes(_words.lowered(data)), found)
    if not (place >= 0).any():
        yield from ((int(c), *nothing) for c in counts)
        return
    # Tokens: the benchmark's words by rank; any other word, and the end of a text, a number of its own that equals nothing.
    tokens = np.full(len(place) + n_rows, -1, np.int64)
    slots = np.arange(len(place)) + found.row
    tokens[slots] = place
    at = np.flatnonzero(tokens < 0)
    tokens[at] = len(items.hash) + np.arange(len(at))
    other = items.other
    order = suffix_array(tokens)
    low = search(tokens, order, other, items.start, items.length, right=False)
    high = search(tokens, order, other, items.start, items.length, right=True)
    row_of = np.empty(len(tokens), np.int64)
    row_of[:] = np.searchsorted(np.arange(1, n_rows + 1) + edges[1:] - 1, np.arange(len(tokens)))
    # Occurrences of windows.
    wins = np.flatnonzero(items.is_window & (high > low))
    sizes = high[wins] - low[wins]
    which = np.repeat(wins, sizes)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    where = order[low[which] + inside]
    hit = _words.covered(where, items.length[which], len(tokens))
    pairs = np.unique(np.stack([row_of[where], items.row[which]]), axis=1)
    # Longest matches: the neighbours of the place where a whole suffix of an item would stand.
    whole = items.ends - items.start
    stand = search(tokens, order, other, items.start, whole, right=False)
    tops = []
    for side in (stand - 1, stand):
        there = order[np.clip(side, 0, len(order) - 1)]
        length = np.where((side >= 0) & (side < len(order)), _match(tokens, len(tokens), there, other, items.start, whole), 0)
        some = np.flatnonzero(length)
        tops.append(np.stack([row_of[there[some]], -length[some], items.row[some], there[some]]))
    top = np.concatenate(tops, axis=1)
    top = top[:, np.lexsort(top[::-1])]
    top = top[:, np.r_[True, top[0, 1:] != top[0, :-1]]] if top.shape[1] else top
    best = {int(r): (-int(a), int(b), int(c)) for r, a, b, c in top.T}
    first = edges[:-1] + np.arange(n_rows)
    item_edges = np.searchsorted(pairs[0], np.arange(n_rows + 1))
    for r in range(n_rows):
        hits = np.flatnonzero(hit[first[r] : first[r] + counts[r]])
        names = [items.ids[x] for x in pairs[1, item_edges[r] : item_edges[r + 1]]]
        length, item, slot = best.get(r, (0, 0, 0))
        yield int(counts[r]), len(hits), names, length, items.ids[item] if length else None, int(slot - first[r]) if length else None, hits


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """Blocks of items of about block_bytes each; one block comes to the driver at a time."""
    n = max(1, -(-_spark.total_bytes(benchmark, "text") // block_bytes))
    for k in range(n):
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = part.orderBy("item_id").collect()
        yield [r.item_id for r in rows], [r.text for r in rows]


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, items (whose windows occur), longest, longest_item, longest_at (its first word).

    A window is `window` consecutive words of an item, or a shorter item whole; a word of a document is hit inside any occurrence.
    """
    spark = docs.sparkSession
    source = _spark.columns(docs, doc_id=id, text=text)
    benchmark = _spark.columns(benchmark, item_id=item_id, text=item_text)
    item_type, doc_type = (x.schema[0].dataType.simpleString() for x in (benchmark, source))
    schema, item = SCHEMA.format(id=item_type), to_arrow_type(benchmark.schema[0].dataType)
    kinds = pa.int64(), pa.int64(), pa.list_(item), pa.int64(), item, pa.int64(), pa.binary()
    blocks = _blocks(benchmark, block_bytes)
    passes, pending = [], next(blocks)
    while pending is not None:
        now, pending = pending, next(blocks, None)
        if passes or pending is not None:  # more than one pass: rows need names
            if not passes:
                source = _spark.checkpoint(source.withColumn("doc_id", F.struct("doc_id", F.monotonically_increasing_id().alias("n"))))
        shared = _spark.share(spark, now)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value, window)
            for batch in batches:
                out: list[tuple] = []
                for _, _, data, offsets in _words.text_chunks(batch.column("text")):
                    out += _shard(data, offsets, items)
                cols = list(zip(*out, strict=True)) if out else [()] * 7
                cols[6] = [x.astype("<u4").tobytes() for x in cols[6]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_hit", "items", "longest", "longest_item", "longest_at", "hits"])

        passes.append(source.mapInArrow(_spark.freed(scan), f"doc_id {source.schema[0].dataType.simpleString()}, {schema}"))
    if len(passes) == 1:
        return passes[0].drop("hits")
    union = passes[0]
    for x in passes[1:]:
        union = union.unionByName(x)

    def merged(group: pa.Table) -> pa.Table:
        hits = np.unique(np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in group.column("hits")]))
        top = max(group.select(["longest", "longest_item", "longest_at"]).to_pylist(), key=lambda x: (x["longest"], -(x["longest_at"] or 0)))
        items = sorted({i for x in group.column("items").to_pylist() for i in x})
        first = group.slice(0, 1).to_pylist()[0]
        return pa.Table.from_pylist([{"doc_id": first["doc_id"], "n_words": first["n_words"], "n_hit": len(hits), "items": items, **top}], schema=group.drop_columns(["hits"]).schema)

    both = union.groupBy("doc_id").applyInArrow(merged, f"doc_id {source.schema[0].dataType.simpleString()}, {schema}".removesuffix(", hits binary"))
    return both.withColumn("doc_id", F.col("doc_id.doc_id")).select("doc_id", "n_words", "n_hit", "items", "longest", "longest_item", "longest_at")


def contaminated() -> "F.Column":
    """Any hit, and at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that aren't contaminated. A benchmark of one block needs one pass and no shuffle."""
    items = _spark.columns(benchmark, item_id=item_id, text=item_text)
    if _spark.total_bytes(items, "text") > block_bytes:
        rows = _spark.checkpoint(docs.withColumn("__row", F.monotonically_increasing_id()))
        hit = find(rows, benchmark, window=window, id="__row", text=text, item_id=item_id, item_text=item_text, block_bytes=block_bytes).where(contaminated())
        return rows.join(hit.select(F.col("doc_id").alias("__row")), "__row", "left_anti").select(*(rows[f"`{c}`"] for c in docs.columns))
    shared = _spark.share(docs.sparkSession, next(_blocks(items, block_bytes)))
    at = docs.columns.index(text)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value, window)
        for batch in batches:
            clean = []
            for _, _, data, offsets in _words.text_chunks(batch.column(at)):
                clean += [not (n_hit > 0 and 20 * n_hit >= n_words) for n_words, n_hit, *_ in _shard(data, offsets, items)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(_spark.freed(left), docs.schema)
