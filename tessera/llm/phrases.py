"""Collocations: phrases of two to five words that are frequent in a language, scored against chance.

Patterns grow as in PrefixSpan, by contiguous extension to the right. Scans of
the texts first find what can be frequent: words, then pairs of neighbours whose
words both can be, then triples whose pairs both can be. They are counted under
64-bit keys and looked up in bitmaps of fixed size, so a collision lets
something more through and never leaves anything out. The last scan projects:
from every place with a word that may be frequent, the window of up to `longest`
words as far as its triples may be, equal ones counted together before the
shuffle. All windows of a prefix (their first PRUNED words, or all if they have
fewer) go to one task, packed with those of other prefixes in its bucket. There a
prefix holds pointers to its windows, divides these by the next word, and follows
each that is frequent depth-first. Windows of a triple differ in what follows it
alone, and only as far as triples are frequent, so a word that everything follows
isn't one task's group; the counts of shorter prefixes, which several tasks
share, are added up.

Counts of words and phrases then meet in joins: each cut of a candidate finds
the counts of its parts (which are frequent, since they occur at least as
often), and a candidate that some candidate one word longer holds as often goes.
One step is enough, as everything between a phrase and a longer one that holds
it as often has the same count.

Texts are split at `[.,;:!?\\x0A-\\x0D]`, words are `[^\\x20\\x09]+` with A-Z folded;
null texts are empty, a null language is `und`. Ids aren't looked at, so
repeated rows count each time they occur. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _spark, _words

U64 = np.uint64
BITS = 1 << 26  # of the bitmap: 8 MB
HELD = 1 << 21  # different keys that a task holds before it passes them on
PRUNED = 3  # words of the longest phrases that are counted by keys before windows are made
BUCKETS = 1024  # of prefixes; more where the session has more partitions
_PIECE_ENDS = np.zeros(256, bool)
_PIECE_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATORS = _PIECE_ENDS.copy()
_SEPARATORS[[0x20, 0x09]] = True


class _Text:
    """A chunk's words: hashes, exact numbers, languages, and which have the next word as neighbour in their piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.data = _words.lowered(data)
        self.words = _words.words(self.data, offsets, _SEPARATORS, lower=False)
        self.lang = langs[self.words.row]
        ends = np.concatenate([[0], np.cumsum(_PIECE_ENDS[self.data], dtype=np.int32)])
        w = self.words
        self.joined = np.append((w.row[1:] == w.row[:-1]) & (ends[w.start[1:]] == ends[w.end[:-1]]), False) if len(w.row) else np.zeros(0, bool)

    def keys(self, seeds: np.ndarray) -> np.ndarray:
        """A hash of each word and its language."""
        return _words.mix(self.words.hash + seeds[self.lang])

    def identify(self) -> tuple[np.ndarray, np.ndarray]:
        return _words.identify(_words.Bytes(self.data), self.words)

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at these places."""
        start, size = self.words.start[at], (self.words.end - self.words.start)[at]
        places = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.arange(places[-1]) + np.repeat(start - places[:-1], size)]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[_Text, pa.Array, np.ndarray]]:
    """Chunks with the languages' names and a number for each that goes into hashes."""
    langs = batch.column("lang").dictionary_encode()
    codes = langs.indices.to_numpy(zero_copy_only=False)
    names = langs.dictionary.to_pylist()
    seeds = pa.array(names, pa.string())
    text = np.concatenate([np.frombuffer(n.encode(), np.uint8) for n in names]) if names else np.zeros(0, np.uint8)
    edges = np.cumsum([0, *(len(n.encode()) for n in names)])
    hashes = _words.mix(_words._hash_spans(_words.Bytes(text), edges[:-1], edges[1:])) if names else np.zeros(0, np.uint64)
    for low, high, data, offsets in _words.text_chunks(batch.column("text")):
        yield _Text(data, offsets, codes[low:high]), seeds, hashes


class Bitmap:
    """Hashes of what may be frequent. Built by tasks, in fragments; BITS bits in all."""

    def __init__(self, keys: DataFrame):
        slots = keys.select((F.pmod("key", F.lit(BITS)) + 1).alias("slot"))
        parts = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        self.bits = np.zeros(BITS // 8, np.uint8)
        for bucket, bits in parts.collect():  # at most BITS / 8 bytes
            self.bits[(bucket - 1) * len(bits) : bucket * len(bits)] = np.frombuffer(bits, np.uint8)

    @staticmethod
    def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        slot = (keys.view(np.int64) % BITS).astype(np.int64)
        return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _grams(text: _Text, seeds: np.ndarray, maps: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Where phrases of 1, 2, ... words begin that the bitmaps have; then the places and keys of those one word longer whose two parts they have."""
    single = text.keys(seeds)
    at, keys, goods = np.arange(len(single)), single, []
    for size, bits in enumerate(maps, 1):
        has = Bitmap.has(bits, keys)
        at, keys = at[has], keys[has]
        good = np.zeros(len(single) + 1, bool)
        good[at] = True
        goods.append(good)
        longer = good[at + 1] & text.joined[at]
        at, keys = at[longer], keys[longer]
        keys = _words.mix(keys * U64(0x9E3779B97F4A7C15) + single[at + size])
    return goods, at, keys


def count_keys(source: DataFrame, maps: list[np.ndarray]) -> DataFrame:
    """key and n of the phrases one word longer than there are bitmaps, whose parts these have; n is at least the phrase's count. With a null key, lang and n: a language's words."""
    shared = _spark.share(source.sparkSession, maps)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys)
            first = np.flatnonzero(np.r_[True, keys[order[1:]] != keys[order[:-1]]])
            return keys[order[first]], np.add.reduceat(n[order], first)

        def passed(langs: pa.Array, keys: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([langs, keys, pa.array(n, pa.int64())], names=["lang", "key", "n"])

        def all_held() -> pa.RecordBatch:
            keys, n = merged()
            return passed(pa.nulls(len(keys), pa.string()), pa.array(keys.view(np.int64)), n)

        for batch in batches:
            for text, names, seeds in _texts(batch):
                if not len(text.lang):
                    continue
                if not shared.value:
                    langs, n = np.unique(text.lang, return_counts=True)
                    yield passed(names.take(pa.array(langs)), pa.nulls(len(n), pa.int64()), n)
                keys = _grams(text, seeds, shared.value)[2]
                if len(keys):
                    held.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in held) > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield all_held()
                    held = []
        if held:
            yield all_held()

    return source.mapInArrow(_spark.freed(counted), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def project(source: DataFrame, maps: list[np.ndarray], longest: int, buckets: int) -> DataFrame:
    """bucket and windows, a packed table of lang, window (words joined by a blank) and n, from each place whose word the first bitmap has, as far as the others have the phrases that begin there and after."""
    shared = _spark.share(source.sparkSession, maps)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's different windows with their counts, a row for each bucket, in several parts if there are very many."""
        held: list[pa.Table] = []
        for made in windows(batches):
            held.append(pa.Table.from_batches([made]))
            if sum(map(len, held)) > HELD // 2:
                held = [_summed(held)]
                if len(held[0]) > HELD // 4:
                    yield _packed(held[0])
                    held = []
        if held:
            yield _packed(_summed(held))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, names, seeds in _texts(batch):
                goods = [np.append(g, np.zeros(longest, bool)) for g in _grams(text, seeds, shared.value)[0]]
                at = np.flatnonzero(goods[0])
                if not len(at):
                    continue
                size = sum(g[at].astype(np.int64) for g in goods)
                for k in range(len(goods), longest):
                    size += goods[-1][at + k - len(goods) + 1] & (size == k)
                ids, first = text.identify()
                width = np.arange(longest)
                rows = np.where(width < size[:, None], np.append(ids, np.zeros(longest, np.int64))[at[:, None] + width], -1)
                rows = np.column_stack([text.lang[at], rows]).astype(np.int64)
                mixed = np.zeros(len(at), np.uint64)
                for column in rows.T:
                    mixed = _words.mix(mixed * U64(0x9E3779B97F4A7C15) + column.view(np.uint64) + U64(1))
                numbers, places = _words.numbered(mixed, lambda a, b, rows=rows: (rows[a] == rows[b]).all(1))
                n = np.bincount(numbers)
                chosen = rows[places]
                used, column = np.unique(chosen[:, 1:], return_inverse=True)
                words = text.strings(first[np.maximum(used, 0)])
                column = column.reshape(len(chosen), longest)
                parts = [words.take(pa.array(column[:, k], mask=chosen[:, k + 1] < 0)) for k in range(longest)]
                window = pc.binary_join_element_wise(*parts, pa.scalar(" "), null_handling="skip")
                single = text.keys(seeds)
                heads = single[at[places]]
                for k in range(1, len(goods)):
                    longer = size[places] > k
                    heads[longer] = _words.mix(heads[longer] * U64(0x9E3779B97F4A7C15) + single[at[places[longer]] + k])
                bucket = (heads % U64(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), names.take(pa.array(chosen[:, 0])), window, pa.array(n, pa.int64())], names=["bucket", "lang", "window", "n"])

    return source.mapInArrow(_spark.freed(projected), "bucket int, windows binary")


def _summed(tables: list[pa.Table]) -> pa.Table:
    """Equal windows once, with the sum of their counts."""
    keys = [c for c in tables[0].column_names if c != "n"]
    return pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"])


def _packed(table: pa.Table) -> pa.RecordBatch:
    table = table.sort_by("bucket").combine_chunks()
    bucket = table.column("bucket").to_numpy()
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    rows, blobs = table.drop_columns(["bucket"]), []
    for low, high in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(rows.slice(low, high - low))
        blobs.append(out.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "windows"])


def _words_of(phrase: str, count: Column) -> Column:
    """The first `count` words of a phrase, or the last for a negative count."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), count)


def grow(packed: DataFrame, longest: int, support: int) -> DataFrame:
    """lang, phrase and n of phrases that a task has `support` times at least, and of all that are shorter than the prefixes that were dealt out, which several tasks have."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("windows"), strict=True):
                if bucket != last and held:
                    yield from _grown(_summed(held).combine_chunks(), longest, support)
                    held = []
                last = bucket
                held.append(pa.ipc.open_stream(blob.as_buffer()).read_all())
                if len(held) > 64:
                    held = [_summed(held)]
        if held:
            yield from _grown(_summed(held).combine_chunks(), longest, support)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_spark.freed(grown), "lang string, phrase string, n long")


def _grown(table: pa.Table, longest: int, support: int) -> Iterator[pa.RecordBatch]:
    lists = pc.split_pattern(table.column("window").combine_chunks(), " ")
    coded = pc.list_flatten(lists).dictionary_encode()
    size, flat = pc.list_value_length(lists).to_numpy(), coded.indices.to_numpy()
    edges = np.cumsum(size) - size
    width = np.arange(longest)
    place = np.minimum(edges[:, None] + width, len(flat) - 1)
    rows = np.where(width < size[:, None], flat[place], -1)
    n = table.column("n").to_numpy()
    langs = table.column("lang").combine_chunks().dictionary_encode()
    lang = langs.indices.to_numpy()
    found: list[tuple[int, int, int]] = []  # a pointer, the prefix's words, its count

    def extend(pointers: np.ndarray, words: int, by: np.ndarray) -> None:
        """Divides a prefix's pointers by the next word and follows those that are frequent, or that other tasks count too."""
        order = np.argsort(by, kind="stable")
        by = by[order]
        first = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
        sums = np.add.reduceat(n[pointers[order]], first)
        lasts = np.append(first[1:], len(by))
        for k in np.flatnonzero((by[first] >= 0) & ((sums >= support) | (words + 1 < PRUNED))).tolist():
            own = pointers[order[first[k] : lasts[k]]]
            found.append((int(own[0]), words + 1, int(sums[k])))
            if words + 1 < longest:
                extend(own, words + 1, rows[own, words + 1])

    if len(n):
        extend(np.arange(len(n)), 0, lang * (int(flat.max()) + 1) + rows[:, 0])
    if found:
        at, words, count = (np.array(x) for x in zip(*found, strict=True))
        chosen = np.where(width < words[:, None], rows[at], -1)
        parts = [coded.dictionary.take(pa.array(chosen[:, k], mask=chosen[:, k] < 0)) for k in range(longest)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" "), null_handling="skip")
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[at])), phrase, pa.array(count, pa.int64())], names=["lang", "phrase", "n"])


def frequent(docs: DataFrame, *, support: int = 100, longest: int = 5, buckets: int = BUCKETS, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of up to `longest` words that occur `support` times or more, and (lang, n)."""
    if support < 1 or longest < 2:
        raise ValueError("support is at least 1, longest at least 2")
    source = _spark.columns(docs, text=text, lang=lang).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    maps: list[np.ndarray] = []
    totals = None
    for _ in range(min(longest, PRUNED)):
        keys = count_keys(source, maps).where(F.col("key").isNull() | (F.col("n") >= support))
        if totals is None:
            keys = _spark.checkpoint(keys)
            totals = keys.where(F.col("key").isNull()).select("lang", "n")
        maps.append(Bitmap(keys.where(F.col("key").isNotNull()).select("key")).bits)
    packed = project(source, maps, longest, max(buckets, _spark.partitions(docs.sparkSession)))
    grown = grow(packed, longest, support).groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= support)
    words = (F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1).cast("int")
    return _spark.checkpoint(grown.select("lang", "phrase", words.alias("words"), "a")), totals


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def score(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n and score of each phrase of two words or more, at its lowest cut."""
    parts = phrases.select("lang", "phrase", F.col("a").alias("count"))
    cuts = phrases.where("words > 1").join(totals, "lang").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    left = cuts.withColumn("part", _words_of("phrase", F.col("k"))).join(parts.select("lang", F.col("phrase").alias("part"), F.col("count").alias("l")), ["lang", "part"]).drop("part")
    both = left.withColumn("part", _words_of("phrase", F.col("k") - F.col("words"))).join(parts.select("lang", F.col("phrase").alias("part"), F.col("count").alias("r")), ["lang", "part"])
    exact = (_exact("a") * _exact("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    scored = both.withColumn("exact", exact).withColumn("chance", _exact("l") * _exact("r")).withColumn("score", F.expr("exact div chance"))
    best = scored.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def held_as_often(phrases: DataFrame) -> DataFrame:
    """lang, phrase and the count of the most frequent phrase that is one word longer and holds it."""
    inner = F.array(_words_of("phrase", F.col("words") - 1), _words_of("phrase", 1 - F.col("words")))
    return phrases.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def mine(docs: DataFrame, *, support: int = 100, longest: int = 5, top: int | None = 2000, buckets: int = BUCKETS, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` collocations (None: all) by score, count and phrase."""
    phrases, totals = frequent(docs, support=support, longest=longest, buckets=buckets, text=text, lang=lang)
    kept = score(phrases, totals).join(held_as_often(phrases), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.lit(True) if top is None else F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
