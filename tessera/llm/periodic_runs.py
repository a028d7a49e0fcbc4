"""Maximal periodic runs of words, by a scan of all lags.

The word numbers of a chunk of documents stand in one array, separated by
numbers that occur once. For every lag up to the longest document's
n / min_exponent the array is compared with itself shifted by the lag, and
stretches of equal places are measured; a stretch of length m at lag q is a run
of m + q words. Since a run of q has at least max(min_length, min_exponent * q)
- q equal places, the comparison first looks at every such many-th place alone,
of which one lies in every stretch that counts, so all lags together cost about
n log n comparisons. Places with two equal neighbours on a side are followed to
the stretch's ends. A run is kept at its smallest period: where the q words from
an equal place repeat something shorter, the shorter lag reports it.

Documents over `long_bytes` are written once and dealt out as pairs of a document
and a range of lags; the ranges' runs are collected by document afterwards
(there are fewer runs than words).

Words are separated by ASCII blanks. Null and empty texts have no words and no
runs. Rows with equal ids are judged each by itself, also with null ids; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _spark, _words

LONG_BYTES = 1 << 21  # texts beyond are scanned by several tasks
LAGS = 1 << 18  # lags of a long text that a task scans
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _equal_from(ids: np.ndarray, place: int, lag: int, step: int) -> int:
    """How many places in a row, from `place` on in steps of 1 or -1, are equal to those a lag later."""
    total, size = 0, 64
    while True:
        if step > 0:
            low, high = place + total, min(place + total + size, len(ids) - lag)
        else:
            low, high = max(0, place - total - size + 1), place - total + 1
        if high <= low:
            return total
        same = ids[low:high] == ids[low + lag : high + lag]
        same = same if step > 0 else same[::-1]
        if not same.all():
            return total + int(np.argmin(same))
        total, size = total + high - low, min(2 * size, 1 << 16)


def _primes(q: int) -> list[int]:
    found, k = [], 2
    while k * k <= q:
        if q % k == 0:
            found.append(k)
            while q % k == 0:
                q //= k
        k += 1
    return found + [q] * (q > 1)


def _repeats(ids: np.ndarray, place: int, q: int) -> bool:
    """Whether the q words from a place on are a shorter sequence twice or more."""
    return any(_equal_from(ids[place : place + q], 0, q // p, 1) == q - q // p for p in _primes(q))


def scan(ids: np.ndarray, reach: Callable[[int], int], lags: range, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs. ids: word numbers, and a number of its own at both ends and between documents; reach(q): places that can hold a run of q."""
    found: list[tuple[int, int, int]] = []
    period, end = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64)  # of the last run found at each place
    for q in lags:
        size = reach(q)
        if not size:
            break
        least = max(min_length, min_exponent * q) - q
        at = np.flatnonzero(ids[: size - q : least] == ids[q:size:least]) * least
        if not len(at):
            continue
        known = (period[at] > 0) & (q % np.maximum(period[at], 1) == 0) & (at + q < end[at])  # whole periods of a run already found
        at = at[~known]
        if least >= 5 and len(at):
            same = [ids[at + k] == ids[np.minimum(at + q + k, len(ids) - 1)] for k in (-2, -1, 1, 2)]
            at = at[(same[0] & same[1]) | (same[2] & same[3])]
        done = 0
        for j in at.tolist():
            if j < done or (period[j] and q % period[j] == 0 and j + q < end[j]):
                continue
            if _repeats(ids, j, q):
                continue
            left, right = _equal_from(ids, j - 1, q, -1), _equal_from(ids, j, q, 1)
            done = j + right
            if left + right >= least:
                start = j - left
                found.append((start, left + right + q, q))
                period[start : done + q], end[start : done + q] = q, done + q
    return found


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, _words.Words, np.ndarray, np.ndarray]]:
    """(first row, bytes, words, their numbers, where each row's words begin)."""
    for low, high, data, offsets in _words.text_chunks(batch.column("text")):
        found = _words.words(data, offsets, _words.BLANKS, lower=False)
        ids = _words.identify(_words.Bytes(data), found)[0] if len(found.hash) else np.zeros(0, np.int64)
        yield low, data, found, ids, _words.by_row(found.row, high - low)


def _runs(ids: np.ndarray, edges: np.ndarray, lags: tuple[int, int | None], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each row, by start, then period."""
    sizes = np.diff(edges)
    order = np.argsort(-sizes, kind="stable")  # the documents that a lag can concern come first
    starts = np.zeros(len(order) + 1, np.int64)
    np.cumsum(sizes[order] + 1, out=starts[1:])
    line = np.empty(int(starts[-1]) + 1, np.int32)
    line[starts] = -1 - np.arange(len(starts))
    for k, row in enumerate(order.tolist()):
        line[starts[k] + 1 : starts[k + 1]] = ids[edges[row] : edges[row + 1]]
    falling = -sizes[order]
    reach = lambda q: int(starts[np.searchsorted(falling, -max(min_length, min_exponent * q), "right")])
    longest = int(sizes.max(initial=0))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(sizes))]
    for start, length, q in scan(line, reach, range(lags[0], min(lags[1] or longest, longest // min_exponent + 1)), min_length, min_exponent):
        k = int(np.searchsorted(starts, start, "right")) - 1
        out[order[k]].append((start - int(starts[k]) - 1, length, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def _array(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = [r for x in runs for r in x]
    columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RUN)))


def _collapsed(data: np.ndarray, found: _words.Words, edges: np.ndarray, runs: list[list[tuple[int, int, int]]]) -> list[str]:
    """Of each row, the words that no run holds after its first period, joined by one blank."""
    keep = np.ones(len(found.start), bool)
    for k, own in enumerate(runs):
        if own:
            r = np.array(own)
            keep[edges[k] : edges[k + 1]] = ~_words.covered(r[:, 0] + r[:, 2], r[:, 1] - r[:, 2], int(edges[k + 1] - edges[k]))
    start, size = found.start[keep], (found.end - found.start)[keep] + 1
    places = np.concatenate([[0], np.cumsum(size)])
    text = np.append(data, np.uint8(32))[np.arange(places[-1]) + np.repeat(start - places[:-1], size)] if len(start) else np.zeros(0, np.uint8)
    text[places[1:] - 1] = 32
    rows = places[np.concatenate([[0], np.cumsum(keep)])[edges]]
    return [text[a : max(a, b - 1)].tobytes().decode() for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]


def find(docs: DataFrame, *, min_length: int = 6, min_exponent: int = 4, long_bytes: int = LONG_BYTES, lags: int = LAGS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: doc_id, runs (start, length, period in words; by start, then period) and collapsed, the text with each run cut to one period."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    source = _spark.columns(docs, doc_id=id, text=text)
    kind, key = source.schema["doc_id"].dataType.simpleString(), F.sha2("text", 256)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.less_equal(pc.fill_null(pc.binary_length(batch.column("text")), 0), long_bytes))
            for low, data, found, ids, edges in _chunks(batch):
                runs = _runs(ids, edges, (1, None), min_length, min_exponent)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, len(runs)), _array(runs), pa.array(_collapsed(data, found, edges, runs), pa.string())], names=["doc_id", "runs", "collapsed"])

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                for _, _, _, ids, edges in _chunks(batch.slice(k, 1)):
                    low = batch.column("low")[k].as_py()
                    runs = _runs(ids, edges, (low, low + lags), min_length, min_exponent)
                    yield pa.RecordBatch.from_arrays([batch.column("key").slice(k, 1), _array(runs)], names=["key", "runs"])

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [[(r["start"], r["length"], r["period"]) for r in x or ()] for x in batch.column("runs").to_pylist()]
            for low, data, found, _, edges in _chunks(batch):
                runs = [sorted(x, key=lambda r: (r[0], r[2])) for x in given[low : low + len(edges) - 1]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, len(runs)), _array(runs), pa.array(_collapsed(data, found, edges, runs), pa.string())], names=["doc_id", "runs", "collapsed"])

    schema = f"doc_id {kind}, runs {RUNS}, collapsed string"
    short = source.mapInArrow(_spark.freed(whole), schema)
    long = _spark.checkpoint(source.where(F.octet_length("text") > long_bytes).withColumn("key", key))
    if long.isEmpty():
        return short
    last = F.greatest(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) / min_exponent, F.lit(1)).cast("long")
    ranges = long.dropDuplicates(["key"]).select("key", "text", F.explode(F.sequence(F.lit(1), last, F.lit(lags))).alias("low"))
    parts = ranges.repartition("key", "low").mapInArrow(_spark.freed(ranged), f"key string, runs {RUNS}")
    joined = long.join(parts.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs")), "key").select("doc_id", "text", "runs")
    return short.union(joined.mapInArrow(_spark.freed(collapse), schema))
