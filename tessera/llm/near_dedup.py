"""Near-duplicate classes by one-permutation MinHash.

A document's set is its distinct word shingles. One hash of each shingle fills
128 bins with their least values; empty bins copy a full one found by a
universal probe (optimal densification). 32 bands of 4 bins make buckets.

Documents of the same words are one class from the start, so a text that a third
of all rows repeat is one row further on. In a bucket every class gets one edge,
to the bucket's smallest id (a star), and each edge is confirmed on full sets.
An edge that isn't confirmed says nothing about the bucket's other pairs, so
after connected components over the confirmed edges, members of a bucket that
are still in different components are joined by exact prefix and position
filters on their shingles, and the pairs left are confirmed too. No candidate
pair is left out and there is no cap; pairs that only share a common text,
whose number would grow with the square of a group, aren't made.

Hashes of shingles only make signatures and candidates. Sizes of sets and links
come from the words themselves, so words of one hash link nothing; equal texts
are known by a cryptographic digest of their words.

Words are separated by ASCII blanks, with A-Z folded. A text with fewer words
than a shingle is one shingle of all its words. Texts that are null or have no
words have an empty set and are linked with nothing. Rows with a null id are kept and
have a null component. Rows of equal id are the same document: all of them are
kept or none. An empty table gives no rows. The join of labels with their own
labels has one key for each class; Spark's adaptive skew join splits a giant one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _spark, _words

BINS = 128
BANDS = 32
SLOTS = 1 << 20
_PROBES = 4096


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The sorted set of the hashes of a document's shingles."""
    if len(hashes) >= n:
        return np.unique(_words.windows(hashes, n))
    return _words.windows(hashes, len(hashes)) if len(hashes) else hashes


_probe: np.ndarray | None = None


def _probe_table() -> np.ndarray:
    global _probe
    if _probe is None:
        t, i = np.meshgrid(np.arange(_PROBES, dtype=np.uint64), np.arange(BINS, dtype=np.uint64), indexing="ij")
        _probe = (_words.mix(i * np.uint64(1 << 32) + t + np.uint64(1)) % np.uint64(BINS)).astype(np.int16)
    return _probe


def signature(found: np.ndarray) -> np.ndarray:
    """One value a bin; bin i of two sets agrees with the probability of their similarity."""
    ordered = np.sort(_words.mix(found ^ np.uint64(0x5851F42D4C957F2D)))
    bins = (ordered >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.r_[True, bins[1:] != bins[:-1]]
    values, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[first]], full[bins[first]] = ordered[first], True
    empty, table, t = np.flatnonzero(~full), _probe_table(), 0
    while len(empty) and t < _PROBES:
        source = table[t, empty]
        good = full[source]
        values[empty[good]] = values[source[good]]
        empty, t = empty[~good], t + 1
    values[empty] = ordered[0]
    return values


def _bands(values: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in values.reshape(BANDS, -1).T:
        keys = _words.mix(keys * np.uint64(0x9FB21C651E98DF25) + column)
    return keys.view(np.int64)


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The hashed set of each text."""
    for low, high, data, offsets in _words.text_chunks(texts):
        found = _words.words(data, offsets, _words.BLANKS, lower=True)
        edges = _words.by_row(found.row, high - low)
        for k in range(high - low):
            yield shingles(found.hash[edges[k] : edges[k + 1]], n)


def _exact_sets(data: np.ndarray, offsets: np.ndarray, found: _words.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row as (row, shingle), sorted; shingles are numbered, equal for equal words only."""
    ids, _ = _words.identify(_words.Bytes(_words.lowered(data)), found)
    edges = _words.by_row(found.row, len(offsets) - 1)
    m = max(len(ids) - n + 1, 0)
    at = np.flatnonzero(found.row[:m] == found.row[len(ids) - m :]) if m else np.zeros(0, np.int64)
    numbers = _words.identify_windows(ids, _words.windows(found.hash, n)[at], n, at)
    short = np.flatnonzero((np.diff(edges) > 0) & (np.diff(edges) < n))
    whole: dict[bytes, int] = {}  # texts shorter than a shingle equal each other alone
    own = [-1 - whole.setdefault(ids[edges[k] : edges[k + 1]].tobytes(), len(whole)) for k in short]
    rows, numbers = np.r_[found.row[at], short], np.r_[numbers, np.array(own, np.int64)]
    order = np.lexsort((numbers, rows))
    rows, numbers = rows[order], numbers[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (numbers[1:] != numbers[:-1])] if len(rows) else np.zeros(0, bool)
    return rows[new], numbers[new]


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, words (a digest of the words in order), bands (null for an empty set)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands = [], [], []
            for low, high, data, offsets in _words.text_chunks(batch.column("text")):
                found = _words.words(data, offsets, _words.BLANKS, lower=True)
                edges = _words.by_row(found.row, high - low)
                sizes += np.bincount(_exact_sets(data, offsets, found, n)[0], minlength=high - low).tolist()
                for k in range(high - low):
                    digests.append(hashlib.blake2b(b" ".join(data[offsets[k] : offsets[k + 1]].tobytes().lower().split()), digest_size=16).digest())
                    mine = shingles(found.hash[edges[k] : edges[k + 1]], n)
                    bands.append(_bands(signature(mine)) if len(mine) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "words", "bands"])

    return docs.mapInArrow(_spark.freed(signed), "doc_id long, n_shingles long, words binary, bands array<long>")


def compare(texts: list[str], n: int) -> Iterator[tuple[int, int]]:
    """Sizes of intersection and union of the full sets of each two texts in a row, on their words."""
    for low, high in _pairs_of_a_size(texts):
        column = pa.array(texts[low:high], pa.large_string())
        for _, _, data, offsets in _words.text_chunks(column, 1 << 62):
            found = _words.words(data, offsets, _words.BLANKS, lower=True)
            rows, numbers = _exact_sets(data, offsets, found, n)
            edges = np.searchsorted(rows, np.arange(high - low + 1))
            for k in range(0, high - low, 2):
                x, y = numbers[edges[k] : edges[k + 1]], numbers[edges[k + 1] : edges[k + 2]]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                yield shared, len(x) + len(y) - shared


def _pairs_of_a_size(texts: list[str]) -> Iterator[tuple[int, int]]:
    low = size = 0
    for k in range(0, len(texts), 2):
        size += len(texts[k]) + len(texts[k + 1])
        if size >= _words.ROWS_BYTES // 2:
            yield low, k + 2
            low, size = k + 2, 0
    if low < len(texts):
        yield low, len(texts)


def _compared(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """a, b, shared, together: sizes of intersection and union of the full sets of each pair."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [t.as_py() for pair in zip(batch.column("x"), batch.column("y"), strict=True) for t in pair]
            shared, together = zip(*compare(both, n), strict=True) if both else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(together, pa.int64())], names=["a", "b", "shared", "together"])

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(_spark.freed(compared), "a long, b long, shared long, together long")


def _rarity(texts: DataFrame, n: int) -> np.ndarray:
    """How often shingles occur in the sets, by SLOTS hashed counters that go to the driver: 8 MB at most, whatever the sets."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for found in _sets(batch.column("text"), n):
                np.add.at(counts, (found % np.uint64(SLOTS)).astype(np.int64), 1)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slots, pa.int32()), "n": pa.array(counts[slots], pa.int64())})

    rows = texts.select("text").mapInArrow(_spark.freed(counted), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def _candidates(rest: DataFrame, n: int, over: int, under: int) -> DataFrame:
    """a, b: the pairs of different components that can be similar, by exact prefix and position filters.

    With shingles in one order for all sets, rarest first, similar sets share a shingle so early in both that enough
    shingles follow it. The smaller set of a pair needs a shorter beginning than the larger one, as what both share is
    at least 2t / (1 + t) of it: members that differ from a common text by more than that allows have none of its
    shingles there, so the common text makes no pairs of them.
    """
    counts = _spark.share(rest.sparkSession, _rarity(rest, n))

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, heads, brief = [], [], []
            for found in _sets(batch.column("text"), n):
                size = len(found)
                order = np.lexsort((found, counts.value[(found % np.uint64(SLOTS)).astype(np.int64)]))
                heads.append(found[order[: size - -(-size * over // under) + 1]].view(np.int64))
                sizes.append(size)
                brief.append(size - -(-2 * over * size // (over + under)) + 1)
            names = ["id", "component", "lone"]
            arrays = [pa.array(sizes, pa.int64()), pa.array(brief, pa.int64()), pa.array(heads, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *arrays], names=[*names, "n", "brief", "head"])

    early_ = rest.select("id", "component", "lone", "text").mapInArrow(_spark.freed(early), "id long, component long, lone boolean, n long, brief long, head array<long>")
    rows = _spark.checkpoint(early_.select("id", "component", "lone", "n", "brief", F.posexplode("head").alias("at", "shingle")))
    small, y = rows.where("at < brief"), rows.alias("y")
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    near = left * (over + under) >= over * (F.col("x.n") + F.col("y.n"))
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    fits = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component")) & smaller & near
    met = small.where("lone").alias("x").join(y, fits).unionAll(small.where("not lone").alias("x").join(rows.where("lone").alias("y"), fits))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component: for each end of an edge (a, b), the smallest id that can be reached.

    Least labels of neighbours and of labels' own labels, until nothing changes; each round is checkpointed,
    and only the number of changes comes to the driver.
    """
    both = _spark.checkpoint(edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct())
    labels = _spark.checkpoint(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("near"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = labels.join(near, "id").join(up, "component").select("id", F.least("near", "up", "component").alias("new"), "component")
        new = _spark.checkpoint(new)
        changed = new.where("new <> component").limit(1).count()
        labels = new.select("id", F.col("new").alias("component"))
        if not changed:
            return labels


def cluster(docs: DataFrame, *, shingle: int = 5, similar: tuple[int, int] = (80, 100), id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of its class), kept, for every row.

    Two documents are linked if similar[1] * |intersection| >= similar[0] * |union|.
    """
    over, under = similar
    source = _spark.columns(docs, doc_id=id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = _spark.checkpoint(signatures(source, shingle))
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("words").agg(F.min(F.struct("doc_id", "bands")).alias("least"))
    classes = classes.select("words", F.col("least.doc_id").alias("id"), F.col("least.bands").alias("bands"))
    entries = classes.select("id", F.explode("bands").alias("bucket"))
    stars = entries.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("size")).where("size > 1").drop("size")
    members = _spark.checkpoint(entries.join(stars, "bucket"))
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    texts = _spark.checkpoint(source.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "text"))
    star = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    link = F.col("shared") * under >= F.col("together") * over
    links = _spark.checkpoint(_compared(star, texts, shingle).where(link).select("a", "b"))
    labels = components(links)

    # Members of one bucket that are still apart. Of two such, one at least isn't of the bucket's largest component.
    apart = members.join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    parts = apart.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    lone = F.max(F.col("component") != F.col("top.component")).alias("lone")
    rest = _spark.checkpoint(apart.join(mixed, "bucket").groupBy("id", "component").agg(lone))
    if rest.limit(1).count():
        pairs = _candidates(texts.join(rest, "id"), shingle, over, under)
        more = _spark.checkpoint(_compared(pairs, texts, shingle).where(link).select("a", "b"))
        if more.limit(1).count():
            labels = components(links.union(more))

    named = classes.select("words", "id").join(labels, "id", "left").select("words", F.coalesce("component", "id").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("words")).alias("words")).join(named, "words", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, *, shingle: int = 5, similar: tuple[int, int] = (80, 100), id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, but those of documents that aren't the first of their class."""
    gone = cluster(docs, shingle=shingle, similar=similar, id=id, text=text).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[f"`{id}`"].cast("long") == gone["__gone"], "left_anti")
