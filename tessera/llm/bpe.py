"""Byte-level BPE, encoded and decoded by DuckDB queries in each Spark task.

The distinct words of a batch become rows (word, position, token, and the next
row's position and token). A recursive query joins them with the merge table
and in each step contracts every word's leftmost pair of least rank, until no
word has a pair: the right row of the pair takes the new token, the left one
goes, and the row before learns of it. A word's least rank and its place are
one aggregate, so no step sorts. Decoding joins token rows with the vocabulary
and aggregates in order of position.

A word that is itself in the vocabulary is that token, as in tiktoken. The
query's cost grows with the square of a word's length (1 s for 4,096 bytes), so
a word of over PIECE bytes (a run without a break) is contracted in pieces by
the same query. Tokens are the encoding of what they spell if each two
neighbours are the encoding of what these two spell; where two pieces meet and
aren't, the query contracts the tokens around the joint anew, more of them until
their neighbours agree. Pieces of twice the size follow if they never do.

Null and empty texts have no tokens. Rows are independent: repeated rows and
equal or null ids are encoded each for itself. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm import _spark

PIECE = 1024  # bytes of a word that are contracted at once
MOST_PIECE = 1 << 20  # positions take 20 bits
STEP_ROWS = 1_500_000  # bound on a query's word-position rows over all its steps, twice
DECODE_ROWS = 300_000
CACHED_WORDS = 100_000  # of each of two generations

ENCODE = """
WITH RECURSIVE step AS (
  SELECT w, pos, follows, tok, nxt, false AS done FROM tokens
  UNION ALL
  SELECT w, pos,
    CASE WHEN follows = ((best >> 20) & 1048575) THEN (best & 1048575) ELSE follows END,
    CASE WHEN pos = (best & 1048575) THEN best >> 40 ELSE tok END,
    CASE WHEN follows = ((best >> 20) & 1048575) THEN best >> 40 ELSE nxt END,
    best IS NULL
  FROM step JOIN (
    SELECT w, min((m.rank << 40) | (s.pos << 20) | s.follows) AS best
    FROM step s LEFT JOIN merges m ON m.pair = (s.tok << 24) | s.nxt
    WHERE NOT done GROUP BY w) USING (w)
  WHERE NOT done AND (best IS NULL OR pos <> ((best >> 20) & 1048575)))
SELECT w, CAST(tok AS UINTEGER) AS tok FROM step WHERE done ORDER BY w, pos
"""
DECODE = "SELECT part, string_agg(piece, '' ORDER BY pos) AS text FROM ids JOIN vocabulary USING (id) GROUP BY part ORDER BY part"


class Codec:
    """The merge table and the vocabulary, in a DuckDB of one task at a time, with the words that were met."""

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # those met before the present ones; a word met again is kept
        self.pattern = regex.compile(pattern)
        pairs = [(self.ranks[t[:k]] << 24 | self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pieces = {r: t for t, r in self.ranks.items()}
        self.tables = {
            "merges": pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "rank": pa.array([r for _, r in pairs], pa.int64())}),
            "vocabulary": pa.table({"id": pa.array(self.ranks.values(), pa.int64()), "piece": pa.array([t.decode("latin-1") for t in self.ranks], pa.string())}),
        }
        self.db = None

    def __enter__(self) -> Codec:
        """Opens the DuckDB of a task; at the task's end its memory goes back."""
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        for name, rows in self.tables.items():
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        return self

    def __exit__(self, *_: object) -> None:
        self.db.close()
        self.db = None

    def _contract(self, words: list[bytes]) -> list[np.ndarray]:
        """The tokens of each word."""
        sizes = np.array([len(x) for x in words])
        data = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = np.r_[owner[1:] != owner[:-1], True]
        self.db.register("tokens", pa.table({"w": owner, "pos": place, "tok": data, "nxt": pa.array(np.r_[data[1:], 0], mask=last), "follows": pa.array(place + 1, mask=last)}))
        found = self.db.sql(ENCODE).to_arrow_table()
        return np.split(found.column("tok").to_numpy(), np.searchsorted(found.column("w").to_numpy(), np.arange(1, len(words))))

    def _all(self, words: list[bytes]) -> list[np.ndarray]:
        """The tokens of each word, equal ones once, in queries of a bounded size."""
        known: dict[bytes, np.ndarray] = {}
        group, rows = [], 0
        for word in sorted(set(words), key=len):  # a query takes as many steps as its longest word, and each step builds the merge table's index anew
            group.append(word)
            rows += len(word) ** 2
            if rows > STEP_ROWS:
                known |= zip(group, self._contract(group), strict=True)
                group, rows = [], 0
        if group:
            known |= zip(group, self._contract(group), strict=True)
        return [known[w] for w in words]

    def _spelled(self, tokens: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, tokens.tolist()))

    def _agree(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether each two tokens are the encoding of what they spell."""
        found = self._all([self.pieces[a] + self.pieces[b] for a, b in pairs]) if pairs else []
        return [f.tolist() == list(p) for f, p in zip(found, pairs, strict=True)]

    def _long(self, word: bytes, piece: int) -> np.ndarray:
        if len(word) <= piece:
            return self._all([word])[0]
        if piece > MOST_PIECE:
            raise ValueError("no part of a word's tokens stands by itself")
        parts = self._all([word[k : k + piece] for k in range(0, len(word), piece)])
        joints = list(range(len(parts) - 1))
        middle: dict[int, np.ndarray] = {}
        cut = dict.fromkeys(joints, 0)  # tokens on each side of a joint that its middle replaces
        good = self._agree([(int(parts[j][-1]), int(parts[j + 1][0])) for j in joints])
        bad, k = [j for j, g in zip(joints, good, strict=True) if not g], 1
        while bad:
            if any(3 * k > len(parts[j]) for j in bad) or any(3 * k > len(parts[j + 1]) for j in bad):  # middles of neighbouring joints would meet
                return self._long(word, 2 * piece)
            found = self._all([self._spelled(parts[j][-k:]) + self._spelled(parts[j + 1][:k]) for j in bad])
            sides = [(int(parts[j][-k - 1]), int(f[0])) for j, f in zip(bad, found, strict=True)] + [(int(f[-1]), int(parts[j + 1][k])) for j, f in zip(bad, found, strict=True)]
            good = self._agree(sides)
            for n, j in enumerate(bad):
                middle[j], cut[j] = found[n], k
            bad = [j for n, j in enumerate(bad) if not (good[n] and good[n + len(bad)])]
            k *= 2
        out = []
        for j, part in enumerate(parts):
            out.append(part[cut.get(j - 1, 0) : len(part) - cut.get(j, 0)])
            out.append(middle.get(j, part[:0]))
        return np.concatenate(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pattern.findall(t) for t in texts]
        if len(self.words) > CACHED_WORDS:
            self.older, self.words = self.words, {}
        new = {w for ws in split for w in ws if w not in self.words}
        group: list[str] = []
        for word in new:
            raw = word.encode()
            if (known := self.older.get(word)) is not None:
                self.words[word] = known
            elif (rank := self.ranks.get(raw)) is not None:
                self.words[word] = rank.to_bytes(4, "little")
            elif len(raw) > PIECE:
                self.words[word] = self._long(raw, PIECE).astype("<u4").tobytes()
            else:
                group.append(word)
        for word, tokens in zip(group, self._all([w.encode() for w in group]) if group else [], strict=True):
            self.words[word] = tokens.astype("<u4").tobytes()
        return [b"".join(map(self.words.__getitem__, ws)) for ws in split]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
        part = np.repeat(np.arange(len(coded)), [len(x) // 4 for x in coded])
        out: list[list[str]] = [[] for _ in coded]
        for low in range(0, len(ids), DECODE_ROWS):
            at = slice(low, low + DECODE_ROWS)
            self.db.register("ids", pa.table({"id": ids[at], "part": part[at], "pos": np.arange(len(ids[at]))}))
            for k, text in self.db.sql(DECODE).fetchall():
                out[k].append(text)
        return ["".join(x).encode("latin-1") for x in out]


_codecs: dict[tuple[bytes, str], Codec] = {}


def _codec(lines: bytes, pattern: str) -> Codec:
    """One for a Python worker, which runs one task at a time."""
    if (lines, pattern) not in _codecs:
        _codecs.clear()
        _codecs[lines, pattern] = Codec(lines, pattern)
    return _codecs[lines, pattern]


def _groups(texts: Iterator[str], most: int = 2 << 20) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (bytes, decoded from the ids) for every row.

    vocabulary: a file of ranks (base64 token, rank; under 2^23 of them), which the driver reads and sends to the tasks.
    """
    with open(vocabulary, "rb") as f:
        shared = _spark.share(docs.sparkSession, f.read())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(shared.value, pattern) as codec:
            for batch in batches:
                at = 0
                for texts in _groups((x.as_py() or "") for x in batch.column("text")):
                    ids = codec.encode(texts)
                    decoded = codec.decode(ids)
                    sizes = [len(x) // 4 for x in ids]
                    rows = batch.column("doc_id").slice(at, len(texts))
                    at += len(texts)
                    yield pa.RecordBatch.from_arrays([rows, pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    source = _spark.columns(docs, doc_id=id, text=text)
    return source.mapInArrow(_spark.freed(coded), f"doc_id {source.schema[0].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")
