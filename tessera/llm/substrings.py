"""Exact substring deduplication by relative Lempel-Ziv parsing.

A passage is factored greedily against an indexed reference block: a suffix
array of the block's words gives, for each place, the longest match in a
document with a smaller id; a match of a window or more is a factor, the parse
goes on at its end, and there the windows that straddle the boundary are
checked, of which the one that reaches farthest begins the next factor. Words
in factors are duplicates. The index tells matches apart up to LONGEST words; a
factor that is as long is followed in its source to where they differ.

Which blocks can match is known beforehand: a window's block is the one of its
rarest 4-word anchor (of least hash), and equal windows have equal anchors, so
parsing a passage against its own block is parsing it against every block. What
is shuffled is the passages' text, compressed. Before that, each batch of
documents is parsed against itself and windows that a smaller document of the
batch has are left out: a passage that a third of all documents share reaches
its block once a batch.

Blocks are as many as the text's measured bytes ask for. The windows of each
block are counted first, in a sketch of at most COUNTERS numbers; where a block has far
more than the mean, as a frequent anchor in many contexts makes it, each of its
windows goes to a block by its own hash instead, which spreads them and keeps
equal ones together. Where such a block is still far over the mean, a window that
nearly every batch has is in it: its passages are first parsed in SALTS groups of
batches, each of which passes on the smallest document's copy alone. Blocks that
share a counter with a heavy one are treated as it is, which moves their windows
and changes no result.

Words are separated by ASCII blanks. Hashes only choose blocks and skip windows
that are alone; matches are of words. Null, empty and shorter texts have no
window and lose nothing. Windows are judged on the input; equal ids count as one
document, so repeated rows of one id don't remove each other. An empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _spark, _words

WINDOW = 13
ANCHOR = 4
LONGEST = 64
BATCH_BYTES = 6 << 20
BLOCK_BYTES = 8 << 20  # of passages, whose text overlaps: some OVERLAP times that of the documents
OVERLAP = 3.3
HEAVY = 4  # times the mean
COUNTERS = 1 << 20  # of windows by block: 8 MB in a task, 1 MB of bits for all
SALTS = 64
TEXT_LEVEL, HEAD_LEVEL = 5, 3  # of compression; a higher one makes heads larger and texts hardly smaller

FACTOR = np.dtype([("start", "<u4"), ("n", "<u4"), ("ref_start", "<u4"), ("ref_doc", "<i8")])


def _anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window, the least hash of its anchors."""
    return _words.least(_words.windows(hashes, anchor), window - anchor + 1)


def longest_matches(tokens: np.ndarray, docs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest match, up to `most`, that begins in a smaller document, and where it does.

    The index is the order of all suffixes by their first `most` tokens, found by prefix doubling. On both sides of a
    place the nearest of a smaller document is the best of that side; ranks of each depth tell how far it matches.
    """
    n = len(tokens)
    order = np.argsort(tokens)
    ordered = tokens[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, depth = [rank.astype(np.int32)], 1
    while depth < most and len(tied := np.flatnonzero(~(new & np.r_[new[1:], True]))):
        at = order[tied]
        both = rank[at] * (n + 2) + rank[np.minimum(at + depth, n)] + 1
        again = np.argsort(both)
        at, both = at[again], both[again]
        order[tied] = at
        first = np.r_[True, both[1:] != both[:-1]]
        new[tied] = first
        rank[at] = np.maximum.accumulate(np.where(first, tied, 0))
        levels.append(rank.astype(np.int32))
        depth *= 2
    owner = docs[order]
    length, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for side in (-1, 1):
        near = np.arange(n) + side
        open_ = np.arange(n)
        while len(open_):
            to = near[open_]
            open_ = open_[(to >= 0) & (to < n)]
            open_ = open_[owner[near[open_]] >= owner[open_]]
            near[open_] = near[near[open_]]
        found = np.flatnonzero((near >= 0) & (near < n))
        a, b = order[found], order[near[found]]
        same = np.zeros(len(found), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same += np.where(levels[k][a + same] == levels[k][b + same], 1 << k, 0)
        same = np.minimum(same, most)
        better = same > length[a]
        length[a[better]], source[a[better]] = same[better], b[better]
    return length, source


def parse(length: np.ndarray, window: int) -> list[int]:
    """Where the factors begin: the greedy parse over the longest matches of all places."""
    starts = np.flatnonzero(length >= window)
    reach = (starts + length[starts]).tolist()
    starts = starts.tolist()
    out, end, k, n = [], -1, 0, len(starts)
    while k < n:
        best = k
        if starts[k] <= end:  # windows that straddle the boundary
            j = k
            while j < n and starts[j] <= end:
                best = j if reach[j] > reach[best] else best
                j += 1
            if reach[best] <= end:
                k = j
                continue
        out.append(starts[best])
        end = reach[best]
        k = bisect_left(starts, end - window + 1, best + 1)
    return out


class Block:
    """Passages with their documents, parsed against those of smaller documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, window: int):
        self.found = found = _words.words(data, offsets, _words.BLANKS, lower=False)
        self.docs, n = docs[found.row], len(found.row)
        m = max(n - window + 1, 0)
        self.at = np.flatnonzero(found.row[:m] == found.row[n - m :]) if m else np.zeros(0, np.int64)  # where windows begin
        self.keys = _words.windows(found.hash, window)[self.at]
        self.again = np.zeros(len(self.at), bool)  # windows that a smaller document has
        self.start = self.n = self.source = np.zeros(0, np.int64)  # factors: first word, words, first word of the match
        order = np.argsort(self.keys)
        same = self.keys[order[1:]] == self.keys[order[:-1]]
        shared = np.zeros(len(order), bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        if not shared.any():
            return
        # The index holds the words of windows that aren't alone, with a token of its own after each passage of these.
        held = np.flatnonzero(_words.covered(self.at[shared], np.full(int(shared.sum()), window), n))
        ends = np.r_[(np.diff(held) > 1) | (np.diff(found.row[held]) != 0), True]
        place = np.arange(len(held)) + np.r_[0, np.cumsum(ends)[:-1]]
        words = _words.Words(*(x[held] for x in (found.row, found.hash, found.start, found.end)), found.chars)
        ids, first = _words.identify(_words.Bytes(data), words)
        tokens = np.empty(len(held) + int(ends.sum()), np.int64)
        word_of = np.zeros(len(tokens), np.int64)
        tokens[place], word_of[place] = ids, held
        stops = place[ends] + 1
        tokens[stops] = len(first) + np.arange(len(stops))
        word_of[stops] = held[ends]
        length, source = longest_matches(tokens, self.docs[word_of], LONGEST)
        length[stops] = 0
        again = np.zeros(n, bool)
        again[word_of[length >= window]] = True
        self.again = again[self.at]
        factors = _followed(np.array(parse(length, window), np.int64), length, source, tokens)
        self.start, self.n, self.source = word_of[factors], length[factors], word_of[source[factors]]


def _followed(factors: np.ndarray, length: np.ndarray, source: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The factors that are left when those of LONGEST words go on as far as their sources do; `length` is changed. A factor within another goes."""
    out: list[int] = []
    end = -1
    for f in factors.tolist():
        if f + length[f] <= end:
            continue
        if length[f] == LONGEST:
            n, step, a, b = LONGEST, LONGEST, f, int(source[f])
            while True:
                size = min(step, len(tokens) - max(a, b) - n)
                same = tokens[a + n : a + n + size] == tokens[b + n : b + n + size]
                if size <= 0 or not same.all():
                    n += int(np.argmin(same)) if size > 0 else 0
                    break
                n, step = n + size, 2 * step
            length[f] = n
        out.append(f)
        end = f + length[f]
    return np.array(out, np.int64)


def _packed(block: Block, starts: np.ndarray) -> dict[int, bytes]:
    """Each document's factors; starts: where the passage of each word's row begins in its document, less its place in the block."""
    out = np.empty(len(block.start), FACTOR)
    out["start"], out["n"] = block.start + starts[block.start], block.n
    out["ref_doc"], out["ref_start"] = block.docs[block.source], block.source + starts[block.source]
    owner = block.docs[block.start]
    order = np.argsort(owner, kind="stable")
    owner, out = owner[order], out[order]
    edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(owner) else np.zeros(1, int)
    return {int(owner[a]): out[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)}


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """bytes, offsets and ids of at most so many bytes of texts, or of one text."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shifts = np.cumsum([0, *(len(d) for d, _, _ in held)])
        offsets = np.concatenate([[0], *(o[1:] + s for (_, o, _), s in zip(held, shifts, strict=False))]).astype(np.int64)
        return np.concatenate([d for d, _, _ in held]), offsets, np.concatenate([i for _, _, i in held])

    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for low, high, data, offsets in _words.text_chunks(batch.column("text"), most):
            if held and size + len(data) > most:
                yield joined()
                held, size = [], 0
            held.append((data, offsets, ids[low:high]))
            size += len(data)
    if held:
        yield joined()


def _slots(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_words.mix(keys ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(buckets)).astype(np.int64)


def _planes(heads: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as differences, byte by byte of all numbers, so that what repeats stands together."""
    return np.ascontiguousarray(np.diff(heads, axis=1, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _heads(planes: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<i8").reshape(3, -1), axis=1)


@dataclass
class Spread:
    """Which blocks' windows go by their own hash, and which blocks are still heavy then, by counter."""

    buckets: int
    heavy: np.ndarray
    hot: np.ndarray

    def slots(self, anchors: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of each window, and whether it is a hot one."""
        slot, own = _slots(anchors, self.buckets), _slots(keys, self.buckets)
        by_own = self.heavy[slot % len(self.heavy)]
        return np.where(by_own, own, slot), by_own & self.hot[own % len(self.hot)]


def _passages(block: Block, data: np.ndarray, docs_start: np.ndarray, spread: Spread, window: int, anchor: int) -> Iterator[tuple[int, bool, bytes, bytes, int, int]]:
    """(block, whether it is hot, heads, text, passages, bytes of text): the windows that are left, as passages for each block. Heads have document, first word and bytes of each."""
    found = block.found
    if not len(block.at):
        return
    slot, hot = spread.slots(_anchors(found.hash, window, anchor)[block.at], block.keys)
    slot = 2 * slot + hot
    left = np.flatnonzero(~block.again)
    left = left[np.argsort(slot[left], kind="stable")]
    at, slot = block.at[left], slot[left]
    if not len(at):
        return
    row = found.row[at]
    new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(row) != 0) | (np.diff(slot) != 0)])
    last = at[np.r_[new[1:], len(at)] - 1] + window - 1
    low, size = found.start[at[new]], found.end[last] - found.start[at[new]]
    heads = np.stack([block.docs[at[new]], at[new] + docs_start[at[new]], size])
    cuts = np.flatnonzero(np.r_[True, np.diff(slot[new]) != 0, True])
    texts, head = pa.Codec("zstd", TEXT_LEVEL), pa.Codec("zstd", HEAD_LEVEL)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        sizes = size[a:b]
        shift = np.repeat(low[a:b] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        text = data[np.arange(int(sizes.sum())) + shift].tobytes()
        yield int(slot[new[a]]) // 2, bool(slot[new[a]] % 2), head.compress(_planes(heads[:, a:b]), asbytes=True), texts.compress(text, asbytes=True), b - a, len(text)


def _spread(source: DataFrame, buckets: int, window: int, anchor: int) -> Spread:
    """Blocks with HEAVY times the mean of windows, by anchors and by the windows' own hashes; what comes to the driver is bounded by COUNTERS."""

    batch_bytes, counters = BATCH_BYTES, min(buckets, COUNTERS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * counters, np.int64)
        for data, offsets, _ in _batches(batches, batch_bytes):
            found = _words.words(data, offsets, _words.BLANKS, lower=False)
            m = max(len(found.row) - window + 1, 0)
            at = np.flatnonzero(found.row[:m] == found.row[len(found.row) - m :]) if m else np.zeros(0, np.int64)
            if len(at):
                keys, first = np.unique(_words.windows(found.hash, window)[at], return_index=True)
                counts[:counters] += np.bincount(_slots(_anchors(found.hash, window, anchor)[at[first]], buckets) % counters, minlength=counters)
                counts[counters:] += np.bincount(_slots(keys, buckets) % counters, minlength=counters)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slots, pa.int64()), "n": pa.array(counts[slots], pa.int64())})

    counts = source.mapInArrow(_spark.freed(counted), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # A counter has the windows of several blocks where there are more blocks than counters; one of these is heavy if that many more are there.
    total = counts.where(F.col("slot") < counters).agg(F.sum("n").alias("total")).select((F.col("total") / counters + (HEAVY - 1) * F.col("total") / buckets).alias("most"))
    heavy = np.zeros(2 * counters, bool)
    heavy[[r.slot for r in counts.join(F.broadcast(total), F.col("n") > F.col("most")).select("slot").collect()]] = True  # total is one row
    return Spread(buckets, heavy[:counters], heavy[counters:])


def spans(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans: the factors of each document that has any, as arrays of packed FACTOR records: first word, words, and where they are in a smaller document."""
    source = _spark.columns(docs, doc_id=id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id is not null and text is not null")
    buckets = max(_spark.partitions(docs.sparkSession), int(OVERLAP * _spark.total_bytes(source, "text") / block_bytes) + 1)
    spread = _spread(source, buckets, window, anchor)
    shared, batch_bytes, salts = _spark.share(docs.sparkSession, spread), BATCH_BYTES, SALTS
    kinds = {"block": pa.int64(), "salt": pa.int64(), "doc_id": pa.int64(), "heads": pa.binary(), "passages": pa.binary(), "n": pa.int64(), "size": pa.int64()}
    schema = "block long, salt long, doc_id long, heads binary, passages binary, n long, size long"

    def rows_of(block: Block, data: np.ndarray, docs_start: np.ndarray, salt: int | None) -> list[tuple]:
        """Factors that are found, and passages for the blocks; those of hot windows with a salt, if there is one."""
        rows = [(int(_slots(np.array([i], np.int64).view(np.uint64), buckets)[0]), None, i, x, None, 0, 0) for i, x in _packed(block, docs_start).items()]
        return rows + [(b, salt if hot else None, None, *rest) for b, hot, *rest in _passages(block, data, docs_start, shared.value, window, anchor)]

    def columns(rows: list[tuple]) -> list[pa.Array]:
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return [pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, ids in _batches(batches, batch_bytes):
            block = Block(data, offsets, ids, window)
            edges = _words.by_row(block.found.row, len(ids))
            salt = int(_slots(ids[:1].view(np.uint64), salts)[0])
            yield pa.RecordBatch.from_arrays(columns(rows_of(block, data, -edges[:-1][block.found.row], salt)), names=list(kinds))

    def read(heads: list[np.ndarray], texts: list[bytes]) -> tuple[Block, np.ndarray, np.ndarray]:
        """A block of passages, its bytes, and where each word is in its document, less its place in the block."""
        (docs, starts, sizes), data = np.concatenate(heads, axis=1), np.frombuffer(b"".join(texts), np.uint8)
        block = Block(data, np.r_[0, np.cumsum(sizes)], docs, window)
        return block, data, (starts - _words.by_row(block.found.row, len(docs))[:-1])[block.found.row]

    def passages_of(group: pa.Table) -> tuple[list[np.ndarray], list[bytes]]:
        heads, texts = [], []
        for h, t, n, size in zip(*(group.column(c).to_pylist() for c in ("heads", "passages", "n", "size")), strict=True):
            heads.append(_heads(pa.decompress(h, 24 * n, "zstd", asbytes=True)))
            texts.append(pa.decompress(t, size, "zstd", asbytes=True))
        return heads, texts

    def reduced(group: pa.Table) -> pa.Table:
        """Of a hot block's passages in one group of batches, the windows' first copies."""
        return pa.table(columns(rows_of(*read(*passages_of(group)), None)), names=list(kinds))

    def factor(group: pa.Table) -> pa.Table:
        done: dict[str, list] = {"doc_id": [], "spans": []}
        known = pc.is_valid(group.column("doc_id"))
        done["doc_id"], done["spans"] = (group.filter(known).column(c).to_pylist() for c in ("doc_id", "heads"))
        heads, texts = passages_of(group.filter(pc.invert(known)))
        if heads:
            block, _, starts = read(heads, texts)
            found = _packed(block, starts)
            done["doc_id"] += found
            done["spans"] += found.values()
        return pa.table(done, schema=pa.schema([("doc_id", pa.int64()), ("spans", pa.binary())]))

    passages = source.mapInArrow(_spark.freed(split), schema)
    if spread.hot.any():
        passages = _spark.checkpoint(passages)  # not parsed once for each of the two branches
        first = passages.where("salt is not null").groupBy("block", "salt").applyInArrow(reduced, schema)
        passages = passages.where("salt is null").unionByName(first)
    found = passages.groupBy("block").applyInArrow(factor, "doc_id long, spans binary")
    return found.groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))


def remove(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the words left, joined by one space), for every row of docs; with a null id nothing is removed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, packed in zip(batch.column("text"), batch.column("spans"), strict=True):
                found = (text.as_py() or "").encode().split()
                n_words.append(len(found))
                if packed.is_valid:
                    factors = np.frombuffer(b"".join(packed.as_py()), FACTOR)
                    gone = _words.covered(factors["start"].astype(np.int64), factors["n"].astype(np.int64), len(found))
                    found = [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(found))
                kept.append(b" ".join(found).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    source = _spark.columns(docs, doc_id=id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = spans(docs, window=window, anchor=anchor, block_bytes=block_bytes, id=id, text=text)
    return source.join(found, "doc_id", "left").mapInArrow(_spark.freed(cut), "doc_id long, n_words long, n_removed long, kept_text string")
