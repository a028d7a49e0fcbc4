"""Toxicity: a learned lexicon, matched with misspellings, read in context.

From labelled documents the trainer takes the words and word beginnings whose
documents are marked far more often than others: all that the sample gives
EVIDENCE for, of any length. Words end at ASCII signs and at the punctuation,
symbols and blanks of all scripts; letters count in lower case, full-width ones
as plain ones. A trie of them is intersected with
Levenshtein automata (one edit, of a character, for words of four characters or
more and beginnings of five or more, which match any ending) into one
deterministic automaton, and all words of a batch go through it together, a
character at a time. Each hit gets a context score: within a quotation, however
long, it counts less, beside a second person more; misspellings of words of four
characters are only counted. A logistic regression on sums of these gives the score.

Labels, language, source and id are never part of a score. Null and empty texts
have no hits and get the score of a text without any. Rows are scored each for
itself. Null labels are left out; of several labels of an id the highest holds.
Without labels, or with one class only, the lexicon is empty and every score is
the smoothed share of marked documents. Empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _spark, _words

TRAIN_ROWS = 20_000
EVIDENCE = 10.0  # for EVIDENCE_ROWS training rows; more rows have more terms that stand out by chance
EVIDENCE_ROWS = 400
SHORT = 4  # characters of a word that is only counted when it is misspelled
COUNTED_TERMS = 50_000  # held by a task before it passes them on
STEM = (4, 8)  # characters of a word's beginning
WINDOW = 4  # words on each side of a hit
FEATURES = 7

_MARKS = re.compile("|".join(["[\"'\n]", *"“”„‟«»‘’‚‛‹›「」『』《》〈〉〝〞〟｢｣"]).encode())
_PAIRS = {a.encode(): b.encode() for a, b in ("「」", "『』", "《》", "〈〉", "〝〞", "〝〟", "｢｣")}
_CLOSERS = {c.encode(): [a.encode() for a, b in ("「」", "『』", "《》", "〈〉", "〝〞", "〝〟", "｢｣") if b == c] for c in "」』》〉〞〟｣"}
_SINGLE = frozenset(c.encode() for c in "'‘’‚‛‹›")
_OPENS = frozenset(c.encode() for c in "“„‟‘‚‛")  # an open quotation begins anew with these, but where they close it
_PERSONS = frozenset(b"you your yours u du dich dir dein tu te toi ton vous votre usted ti".split())


_TABLED = 0x20000  # code points beyond have neither punctuation nor capitals worth a table


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it ends a word (beyond ASCII), and the one that it counts as."""
    cuts, folds = np.zeros(_TABLED, bool), np.arange(_TABLED, dtype=np.uint32)
    for c in range(_TABLED):
        kind = unicodedata.category(chr(c))
        cuts[c] = c >= 0x80 and (kind[0] in "PSZ" or kind == "Cc")
        if kind == "Lu":
            lower = chr(c).lower()
            folds[c] = ord(lower) if len(lower) == 1 else c
    wide = np.arange(0xFF01, 0xFF5F)  # full-width forms of ASCII
    folds[wide] = folds[wide - 0xFEE0]
    return cuts, folds


_CUTS, _FOLDS = _tables()


class _Read:
    """The words of a chunk: their places in its bytes, and its characters as they count, with the place of each byte among them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        first = (data & 0xC0) != 0x80
        self.place = np.zeros(len(data) + 1, np.int32)
        np.cumsum(first, out=self.place[1:])
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        low = np.minimum(points, _TABLED - 1)
        self.characters = np.where(points < _TABLED, _FOLDS[low], points)
        bare = data
        if len(points) < len(data):
            cut = (points < _TABLED) & _CUTS[low]
            bare = np.where(cut[np.maximum(self.place[1:] - 1, 0)], np.uint8(32), data)  # all bytes of a mark are blanks
        self.words = _words.words(bare, offsets, _words.NOT_ALNUM, lower=True)
        self.start, self.end = self.place[self.words.start], self.place[self.words.end]

    def term(self, k: int) -> str:
        return self.characters[self.start[k] : self.end[k]].astype("<u4").tobytes().decode("utf-32-le")


# The automaton.


@dataclass
class Matcher:
    """A deterministic automaton over classes of characters. State 0 is dead, 1 the start."""

    terms: list[tuple[str, bool, float]]
    classes: np.ndarray = field(repr=False)
    table: np.ndarray = field(repr=False)
    term: np.ndarray = field(repr=False)
    edits: np.ndarray = field(repr=False)

    def run(self, characters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The state after each word."""
        state = np.ones(len(start), np.int32)
        if not self.terms:
            return np.zeros(len(start), np.int32)
        still, k = np.arange(len(start)), 0
        settled = (self.table == np.arange(len(self.table))[:, None]).all(axis=1)
        while len(still):
            still = still[end[still] - start[still] > k]
            new = self.table[state[still], self.classes[characters[start[still] + k]]]
            state[still] = new
            still = still[~settled[new]]
            k += 1
        return state


def edits_allowed(term: str, stem: bool) -> int:
    return int(len(term) >= (5 if stem else SHORT))


def compile_terms(terms: list[tuple[str, bool, float]]) -> Matcher:
    """terms: (characters, whether any ending may follow, weight)."""
    children: list[dict[int, int]] = [{}]
    allowed, ends = [0], [dict[int, int]()]  # edits allowed below a node; term at a node: its edits
    for number, (word, stem, _) in enumerate(terms):
        edits, node = edits_allowed(word, stem), 0
        allowed[0] = max(allowed[0], edits)
        for character in map(ord, word):
            if character not in children[node]:
                children[node][character] = len(children)
                children.append({})
                allowed.append(0)
                ends.append({})
            node = children[node][character]
            allowed[node] = max(allowed[node], edits)
        ends[node][number] = edits
    alphabet = sorted({c for node in children for c in node})
    classes = np.full(0x110000, len(alphabet), np.uint16)
    classes[alphabet] = np.arange(len(alphabet))
    stems = [[t for t in e if terms[t][1]] for e in ends]

    def closed(places: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With the places that are reached by leaving out characters of a term; (-1 - term, edits) is a beginning that was read."""
        todo, out = list(places), set(places)
        while todo:
            node, edits = todo.pop()
            if node < 0:
                continue
            for t in stems[node]:
                if edits <= ends[node][t]:
                    out.add((-1 - t, edits))
            for child in children[node].values():
                if edits < allowed[child] and (child, edits + 1) not in out:
                    out.add((child, edits + 1))
                    todo.append((child, edits + 1))
        return frozenset(p for p in out if p[1] == 0 or (p[0], p[1] - 1) not in out)

    begin = closed({(0, 0)})
    numbers, states, rows = {frozenset(): 0, begin: 1}, [frozenset(), begin], []
    for state in states:
        over: set[tuple[int, int]] = set()  # where any character leads
        led: dict[int, set[tuple[int, int]]] = {}  # where some lead besides
        for node, edits in state:
            if node < 0:
                over.add((node, edits))
                continue
            if edits < allowed[node]:
                over.add((node, edits + 1))
            for character, child in children[node].items():
                led.setdefault(character, set()).add((child, edits))
                if edits < allowed[child]:
                    over.add((child, edits + 1))
        row = [0] * (len(alphabet) + 1)
        other = closed(over)
        for at, character in enumerate([*alphabet, None]):
            new = closed(over | led[character]) if character in led else other
            if new not in numbers:
                numbers[new] = len(states)
                states.append(new)
            row[at] = numbers[new]
        rows.append(row)
    term, edits = np.full(len(states), -1, np.int32), np.zeros(len(states), np.int32)
    for number, state in enumerate(states):
        hits = [(e, t) for node, e in state if node >= 0 for t, most in ends[node].items() if e <= most]
        hits += [(e, -1 - node) for node, e in state if node < 0]
        if hits:
            edits[number], term[number] = min(hits)
    return Matcher(terms, classes, np.array(rows, np.int32), term, edits)


# Features of texts.


def _quotations(text: bytes) -> list[tuple[int, int]]:
    """Spans within closed quotation marks, from one pass over the text; outer ones hide those they hold.

    Double marks are one kind and single marks another, as languages open and close with different ones of them. A mark
    that may be either is told by whether a word is on its left and right. Straight single marks close on their line.
    """
    spans: list[tuple[int, int]] = []
    double, single, line = -1, -1, False  # where the open quotation begins; whether a straight single mark opened it
    nested: dict[bytes, list[int]] = {c: [] for c in _PAIRS}
    for m in _MARKS.finditer(text):
        mark, low, high = m[0], m.start(), m.end()
        if mark == b"\n":
            if line:
                single, line = -1, False
            continue
        if mark in nested:
            nested[mark].append(high)
            continue
        if mark in _CLOSERS:
            if opened := next((nested[c] for c in _CLOSERS[mark] if nested[c]), None):
                spans.append((opened.pop(), low))
            continue
        before, after = text[low - 1 : low] if low else b" ", text[high : high + 1] or b" "
        left, right = (c.isalnum() or c >= b"\x80" for c in (before, after))
        if mark in _SINGLE:
            if left and right and mark in (b"'", "’".encode()):  # an apostrophe
                continue
            begins = mark in _OPENS or mark in ("‹".encode(), "›".encode()) and single < 0 or mark == b"'" and not left and right
            if single >= 0 and not before.isspace() and not right:
                spans.append((single, low))
                single, line = -1, False
            elif begins:
                single, line = high, mark == b"'"
            elif single >= 0 and mark in ("’".encode(), "‹".encode(), "›".encode()):
                spans.append((single, low))
                single, line = -1, False
        else:
            opening, closing = not left and right, not right and not before.isspace()
            if double < 0:
                if mark != b'"' or not closing or opening or not left:
                    double = high
            elif mark in _OPENS | {b'"'} and opening and not closing:
                double = double if before == b"\n" else high  # each paragraph of a long quotation may open anew
            else:
                spans.append((double, low))
                double = -1
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if not out or low > out[-1][1]:
            out.append((low, high))
        elif high > out[-1][1]:
            out[-1] = out[-1][0], high
    return out


def _person(data: np.ndarray, words: _words.Words, at: int, low: int, high: int) -> bool:
    """Whether a second person is near a hit; its text has words low to high."""
    first, last = max(low, at - WINDOW), min(high - 1, at + WINDOW)
    return any(data[words.start[k] : words.end[k]].tobytes().lower() in _PERSONS for k in range(first, last + 1) if words.end[k] - words.start[k] <= 6)


def features(column: pa.Array, matcher: Matcher) -> np.ndarray:
    """A row for each text: log of summed scores, highest score, logs of exact, misspelled and quoted hits, hits a word, log of misspelled short words."""
    out = np.zeros((len(column), FEATURES))
    weights = np.array([w for _, _, w in matcher.terms])
    short = np.array([len(t) <= SHORT for t, _, _ in matcher.terms], bool)
    for low, high, data, offsets in _words.text_chunks(column):
        read = _Read(data, offsets)
        words = read.words
        state = matcher.run(read.characters, read.start, read.end)
        hits = np.flatnonzero(matcher.term[state] >= 0)
        edges = _words.by_row(words.row, high - low)
        for row in np.unique(words.row[hits]):
            mine = hits[np.searchsorted(hits, edges[row]) : np.searchsorted(hits, edges[row + 1])]
            scores, kinds = [], Counter()
            begin = int(offsets[row])
            spans = _quotations(data[begin : int(offsets[row + 1])].tobytes())
            opened = [a for a, _ in spans]
            for at in mine:
                exact = matcher.edits[state[at]] == 0
                if not exact and short[matcher.term[state[at]]]:
                    kinds["short"] += 1
                    continue
                within = bisect_right(opened, int(words.start[at]) - begin) - 1
                quoted = within >= 0 and int(words.end[at]) - begin <= spans[within][1]
                person = _person(data, words, int(at), int(edges[row]), int(edges[row + 1]))
                scores.append(weights[matcher.term[state[at]]] * (1.0 if exact else 0.6) * (0.4 if quoted else 1.0) * (1.2 if person else 1.0))
                kinds["exact" if exact else "fuzzy"] += 1
                kinds["quoted"] += quoted
            out[low + row] = [np.log1p(sum(scores)), max(scores, default=0.0), np.log1p(kinds["exact"]), np.log1p(kinds["fuzzy"]), np.log1p(kinds["quoted"]), len(scores) / (edges[row + 1] - edges[row]), np.log1p(kinds["short"])]
    return out


# Training.


@dataclass
class Model:
    matcher: Matcher
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((found - self.mean) / self.scale @ self.weights + self.bias, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _counts(train: DataFrame, stems: bool) -> DataFrame:
    """term, stem, marked, clean: documents of either label that have each word or beginning, summed in each task first."""

    def rows(seen: dict[tuple[str, bool], list[int]]) -> pa.RecordBatch:
        columns = [t for t, _ in seen], [s for _, s in seen], [a for a, _ in seen.values()], [b for _, b in seen.values()]
        kinds = pa.string(), pa.bool_(), pa.int64(), pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["term", "stem", "marked", "clean"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            labels = batch.column("toxic").to_pylist()
            for low, high, data, offsets in _words.text_chunks(batch.column("text"), 1 << 20):
                read = _Read(data, offsets)
                edges = _words.by_row(read.words.row, high - low)
                for row in range(high - low):
                    own = {read.term(k) for k in range(edges[row], edges[row + 1])}
                    terms = {(w, False) for w in own} | {(w[:n], True) for w in own for n in range(STEM[0], min(STEM[1] + 1, len(w))) if stems}
                    for t in terms:
                        seen.setdefault(t, [0, 0])[1 - labels[low + row]] += 1
                    if len(seen) >= COUNTED_TERMS:
                        yield rows(seen)
                        seen = {}
        yield rows(seen)

    return train.mapInArrow(_spark.freed(counted), "term string, stem boolean, marked long, clean long").groupBy("term", "stem").agg(F.sum("marked").alias("marked"), F.sum("clean").alias("clean"))


def _lexicon(train: DataFrame, marked: int, clean: int) -> list[tuple[str, bool, float]]:
    """The terms that tell marked documents apart. How many there can be is bounded by the training rows' words."""
    weight = F.log((F.col("marked") + 0.5) / (marked + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    told = _counts(train, stems=True).withColumn("weight", weight)
    base = marked / (marked + clean)
    share = F.col("marked") / (F.col("marked") + F.col("clean"))
    # The log of the likelihood ratio against a term that has nothing to do with the label: among many thousands of terms few reach EVIDENCE by chance.
    gain = F.col("marked") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    evidence = EVIDENCE + float(np.log(max(1.0, (marked + clean) / EVIDENCE_ROWS)))
    rows = told.where((F.col("marked") > 2 * F.col("clean")) & (gain >= evidence)).collect()
    # A beginning that is mostly one word is left to that word.
    words = {r.term: r.marked for r in rows if not r.stem}
    most: dict[str, int] = {}
    for word, n in words.items():
        for size in range(STEM[0], min(STEM[1], len(word)) + 1):
            most[word[:size]] = max(most.get(word[:size], 0), n)
    kept: list[tuple[str, bool, float]] = []
    stems: set[str] = set()
    for r in sorted(rows, key=lambda r: (not r.stem, len(r.term), r.term)):
        if any(r.term[:size] in stems for size in range(STEM[0], STEM[1] + 1)) or r.stem and most.get(r.term, 0) >= 0.6 * r.marked:
            continue
        kept.append((r.term, r.stem, float(r.weight)))
        if r.stem:
            stems.add(r.term)
    return sorted(kept, key=lambda t: (-t[2], t[0], t[1]))


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's steps."""
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * penalty * len(x) / 100
    ridge[-1, -1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, id: str = "doc_id", text: str = "text", label_id: str = "doc_id", toxic: str = "toxic") -> Model:
    """A model of at most about train_rows labelled documents, taken by a hash of their id; none is of the held-out fold.

    The driver gets the lexicon's terms and FEATURES numbers for each of these documents.
    """
    marks = _spark.columns(labels, doc_id=label_id, toxic=toxic).where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id")))
    share = min(1.0, train_rows / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    source = _spark.columns(docs, doc_id=id, text=text)
    rows = _spark.checkpoint(source.join(marks, "doc_id").select("text", "toxic"))
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    marked, clean = sizes.get(1, 0), sizes.get(0, 0)
    matcher = compile_terms(_lexicon(rows, marked, clean) if marked and clean else [])
    zeros, ones = np.zeros(FEATURES), np.ones(FEATURES)
    if not (marked and clean):
        prior = (marked + 0.5) / (marked + clean + 1)
        return Model(matcher, zeros, ones, zeros, float(np.log(prior / (1 - prior))) if marked or clean else 0.0 - 2.0)
    shared = _spark.share(docs.sparkSession, matcher)
    names = [f"x{k}" for k in range(FEATURES)]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, k]) for k in range(FEATURES)), batch.column("toxic").cast(pa.float64())], names=[*names, "y"])

    table = rows.mapInArrow(_spark.freed(seen), ", ".join(f"{n} double" for n in [*names, "y"])).toArrow()
    x, y = np.stack([table.column(n).to_numpy() for n in names], 1), table.column("y").to_numpy()
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    return Model(matcher, mean, scale, *_fit((x - mean) / scale, y))


def score(docs: DataFrame, model: Model, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, hits_a_word for every row."""
    shared = _spark.share(docs.sparkSession, model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features(batch.column("text"), shared.value.matcher)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(found)), pa.array(found[:, 5])], names=["doc_id", "score", "hits_a_word"])

    source = _spark.columns(docs, doc_id=id, text=text)
    return source.mapInArrow(_spark.freed(scored), f"doc_id {source.schema[0].dataType.simpleString()}, score double, hits_a_word double")


def drop_toxic(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    _spark.text_batches(docs.sparkSession)
    shared = _spark.share(docs.sparkSession, model)
    at = docs.columns.index(text)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(features(batch.column(at), shared.value.matcher)) < threshold))

    return docs.mapInArrow(_spark.freed(left), docs.schema)
