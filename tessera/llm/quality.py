"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it. The order of the rules doesn't change
that, only the work: on a sample the cascade measures what share of texts each
rule rejects and the seconds it takes, and then runs the rules by rejections
per second, stopping at a text's first rejection. The sample is taken by a hash
of the row, whole texts, and measured where the rows are; the driver gets three
numbers a rule. With `metrics` all counts are asked for, so there the order
saves nothing but the verdict's own work.

Words and windows are compared as such, not by their hashes. Null and empty texts have no words and are rejected by `few_words`. Repeated
rows and equal ids are judged row by row. An empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _spark, _words

SAMPLE_ROWS = 500

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_LETTERS = np.zeros(256, bool)  # ASCII letters, and bytes of any character beyond ASCII
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BULLETS = (b"-", b"*", "•".encode())
_ELLIPSES = (b"...", "…".encode())


class Text:
    """Counts of one text, each made when a rule first asks for it."""

    def __init__(self, data: np.ndarray, found: _words.Words):
        self.data, self.words, self.chars = data, found, found.chars

    @cached_property
    def n_words(self) -> int:
        return len(self.chars)

    @cached_property
    def word_chars(self) -> int:
        return int(self.chars.sum())

    @cached_property
    def n_symbols(self) -> int:
        return int(np.count_nonzero(_SYMBOLS[self.data]))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.tobytes().split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_letter_words(self) -> int:
        if not self.n_words:
            return 0
        edges = np.stack([self.words.start, self.words.end], 1).ravel()
        return int(np.count_nonzero(np.logical_or.reduceat(np.append(_LETTERS[self.data], False), edges)[::2]))

    @cached_property
    def n_bullets(self) -> int:
        return sum(x.lstrip().startswith(_BULLETS) for x in self.lines)

    @cached_property
    def n_ellipses(self) -> int:
        return sum(x.rstrip().endswith(_ELLIPSES) for x in self.lines)

    @cached_property
    def n_repeat_words(self) -> int:
        keys = _words.windows(self.words.hash, 3)
        order = np.argsort(keys)
        again = keys[order[1:]] == keys[order[:-1]]
        if not again.any():
            return 0
        ids, _ = _words.identify(_words.Bytes(self.data), self.words)
        which = _words.identify_windows(ids, keys, 3)
        starts = np.flatnonzero(np.bincount(which)[which] > 1)
        return int(_words.covered(starts, np.full(len(starts), 3), self.n_words).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]
    base: bool = False


RULES = (
    Rule("few_words", lambda t: t.n_words < 50, base=True),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 50 * t.n_words, base=True),
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("same_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("few_letters", lambda t: 10 * t.n_letter_words < 8 * t.n_words),
    Rule("bullets", lambda t: t.n_bullets > 1 and 10 * t.n_bullets > 9 * len(t.lines)),
    Rule("ellipses", lambda t: t.n_ellipses > 1 and 10 * t.n_ellipses > 3 * len(t.lines)),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
)
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _texts(batch: pa.RecordBatch) -> Iterator[Text]:
    for low, high, data, offsets in _words.text_chunks(batch.column("text")):
        found = _words.words(data, offsets, _words.BLANKS, lower=False, chars=True)
        edges = _words.by_row(found.row, high - low)
        for k in range(high - low):
            at = slice(edges[k], edges[k + 1])
            own = _words.Words(found.row[at], found.hash[at], found.start[at] - offsets[k], found.end[at] - offsets[k], found.chars[at])
            yield Text(data[offsets[k] : offsets[k + 1]], own)


@dataclass(frozen=True)
class Measured:
    rule: str
    seconds: float
    rejected: int
    seen: int


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, id: str = "doc_id", text: str = "text") -> list[Measured]:
    """What each rule costs and rejects on about sample_rows rows, taken by a hash of id and text, so that rows of one id aren't taken or left together."""
    source = _spark.columns(docs, doc_id=id, text=text)
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = source.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for t in _texts(batch):
                seen += 1
                for k, rule in enumerate(rules):
                    own = Text(t.data, t.words)
                    began = time.perf_counter()
                    rejected[k] += bool(rule.rejects(own))
                    seconds[k] += time.perf_counter() - began
        if seen:
            yield pa.RecordBatch.from_pydict({"rule": pa.array(range(len(rules)), pa.int32()), "seconds": seconds, "rejected": rejected, "seen": [seen] * len(rules)})

    found = sample.mapInArrow(_spark.freed(timed), "rule int, seconds double, rejected long, seen long").groupBy("rule").agg(F.sum("seconds"), F.sum("rejected"), F.sum("seen"))
    by_rule = {r[0]: r[1:] for r in found.collect()}
    return [Measured(rule.name, *by_rule.get(k, (0.0, 0, 0))) for k, rule in enumerate(rules)]


def order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, id: str = "doc_id", text: str = "text") -> list[str]:
    """Names of the rules by rejections per second, most first."""
    found = measure(docs, rules, sample_rows, id, text)
    return [m.rule for m in sorted(found, key=lambda m: m.rejected / max(m.seconds, 1e-9), reverse=True)]


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, sample_rows: int = SAMPLE_ROWS, id: str = "doc_id", text: str = "text", metrics: bool = True) -> DataFrame:
    """A row for each row: doc_id, kept, base_failed, then with `metrics` all counts, made after the verdict where no rule needed them.

    base_failed is true if a rule marked `base` rejects. Without `metrics` it is null unless the first rejection shows it.
    """
    by_name = {r.name: r for r in rules}
    ranked = [by_name[n] for n in order(docs, rules, sample_rows, id, text)]
    names = METRICS if metrics else ()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, base, counts = [], [], {n: [] for n in names}
            for t in _texts(batch):
                first = next((r for r in ranked if r.rejects(t)), None)
                kept.append(first is None)
                if first is None or first.base or metrics:
                    base.append(first is not None and (first.base or any(r.rejects(t) for r in rules if r.base)))
                else:
                    base.append(None)
                for n in names:
                    counts[n].append(getattr(t, n))
            arrays = [batch.column("doc_id"), pa.array(kept, pa.bool_()), pa.array(base, pa.bool_()), *(pa.array(counts[n], pa.int64()) for n in names)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "kept", "base_failed", *names])

    source = _spark.columns(docs, doc_id=id, text=text)
    return source.mapInArrow(_spark.freed(judged), ", ".join([f"doc_id {source.schema['doc_id'].dataType.simpleString()}", "kept boolean", "base_failed boolean", *(f"{n} long" for n in names)]))
