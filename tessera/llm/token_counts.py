"""Word-piece counts by a linear longest-match automaton.

A word's greedy pieces are the longest vocabulary entries from left to right.
The vocabulary's trie gets failure links: where no byte leads on, the link goes
to the node of what is left after the pieces that are certain by then, and how
many those are was counted when the automaton was built. So each byte is read
once and no piece is built.

The vocabulary is one of bytes: entries that begin with a blank begin words, the
others go on in them, and all single bytes are entries, so every word has
pieces. Words are separated by ASCII blanks. Null and empty texts have none.
Rows are counted each for itself, with any or equal ids; an empty table gives
no rows.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import _spark

CACHED_WORDS = 200_000


class Automaton:
    def __init__(self, entries: list[bytes]):
        self.go: dict[int, int] = {}  # node << 8 | byte: node
        is_entry = [False]
        for entry in entries:
            node = 0
            for byte in entry:
                node = self.go.setdefault(node << 8 | byte, len(is_entry))
                if node == len(is_entry):
                    is_entry.append(False)
            is_entry[node] = True
        children: list[list[tuple[int, int]]] = [[] for _ in is_entry]
        for key, node in self.go.items():
            children[key >> 8].append((key & 255, node))
        self.fail, self.pops = [-1] * len(is_entry), [0] * len(is_entry)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent]:
                queue.append(node)
                if is_entry[node]:
                    self.fail[node], self.pops[node] = 0, 1
                    continue
                at, popped = self.fail[parent], self.pops[parent]
                while at >= 0 and at << 8 | byte not in self.go:
                    at, popped = self.fail[at], popped + self.pops[at]
                if at >= 0:
                    self.fail[node], self.pops[node] = self.go[at << 8 | byte], popped

    def count(self, word: bytes) -> int:
        go, fail, pops, node, total = self.go, self.fail, self.pops, 0, 0
        for byte in word:
            while (to := go.get(node << 8 | byte)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    raise ValueError("the vocabulary lacks a byte")
            node = to
        while node:
            total += pops[node]
            node = fail[node]
        return total


_made: dict[bytes, tuple[Automaton, dict[bytes, int]]] = {}


def _automaton(lines: bytes) -> tuple[Automaton, dict[bytes, int]]:
    """One for a Python worker, with the words that it has met."""
    if lines not in _made:
        _made.clear()
        _made[lines] = Automaton([base64.b64decode(x.split()[0]) for x in lines.splitlines() if x]), {}
    return _made[lines]


def count(docs: DataFrame, vocabulary: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens for every row. vocabulary: a file of base64 entries, which the driver reads and sends to the tasks."""
    with open(vocabulary, "rb") as f:
        shared = _spark.share(docs.sparkSession, f.read())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(shared.value)
        for batch in batches:
            n_words, n_tokens = [], []
            for value in batch.column("text"):
                words = (value.as_py() or "").encode().split()
                total = 0
                for word in words:
                    n = known.get(word)
                    if n is None:
                        n = automaton.count(b" " + word)
                        if len(known) >= CACHED_WORDS:
                            known.clear()
                        if len(word) <= 64:
                            known[word] = n
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    source = _spark.columns(docs, doc_id=id, text=text)
    return source.mapInArrow(_spark.freed(counted), f"doc_id {source.schema[0].dataType.simpleString()}, n_words long, n_tokens long")
