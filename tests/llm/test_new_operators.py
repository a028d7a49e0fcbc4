"""Shards, periodic runs and collocations against their laws and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.llm import periodic_runs, phrases, sharding
from tessera.llm._spark import shared_folder
from tests.llm.conftest import prose


def blanks(text):
    return [w.decode() for w in (text or "").encode().split()]  # bytes split at the six ASCII blanks


# ---- shards


def shard_of(spark, docs, shards, **split):
    rows, slot_map = sharding.digest(docs, **split), sharding.SlotMap(spark, shared_folder(spark, "test-map"))
    slot_map.create(shards, **split)
    sharding.rebalance(slot_map, rows, shards)
    return rows, slot_map


def test_shards_are_level_and_slots_gapless(spark, make):
    r = random.Random(5)
    texts = [None, "", *("x" * r.choice([5, 50, 500]) + str(k) for k in range(900)), "x" * 4000]
    rows, slot_map = shard_of(spark, make(list(enumerate(texts))), 8)
    got = sharding.place(rows, slot_map).collect()
    assert sorted((g.doc_id, g.size, g.text_crc32) for g in got) == [(i, len(t or "") + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)]
    load, places = Counter(), defaultdict(list)
    for g in got:
        load[g.shard] += g.size
        places[g.shard].append(g.slot)
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 8
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_a_third_of_equal_rows_is_spread(spark, make, odd_rows):
    rows, slot_map = shard_of(spark, make([(None, "same")] * 600 + [(k, prose(k, 3)) for k in range(1200)]), 6)
    got = sharding.place(rows, slot_map).collect()
    load = Counter()
    for g in got:
        load[g.shard] += g.size
    assert len(got) == 1800 and max(load.values()) <= 1.05 * sum(load.values()) / 6
    assert max(e.pieces for e in slot_map.entries()) > 1


def test_editing_moves_little_and_growing_moves_into_the_new_shard_alone(spark, make):
    rows, slot_map = shard_of(spark, make([(k, prose(k, 1 + k % 40)) for k in range(1500)] + [(None, "same")] * 900), 5)
    before = {(r.doc_id, r.text_crc32, r.slot, r.shard) for r in sharding.place(rows, slot_map).collect()}
    version = slot_map.versions()[-1]
    sharding.rebalance(slot_map, rows, 5)
    assert {e.shard for e in slot_map.entries()} == set(range(5)) and slot_map.entries() == slot_map.entries(version)  # level already
    assert {(r.doc_id, r.text_crc32, r.slot, r.shard) for r in sharding.place(rows, slot_map).collect()} == before
    sharding.grow(slot_map, rows)
    old, new = slot_map.entries(version), slot_map.entries()
    assert [(e.virtual_slot, e.piece) for e in old] == [(e.virtual_slot, e.piece) for e in new]
    assert all(b.shard in (a.shard, 5) for a, b in zip(old, new, strict=True))
    load = Counter()
    for g in sharding.place(rows, slot_map).collect():
        load[g.shard] += g.size
    assert 0.9 * sum(load.values()) / 6 <= load[5] <= 1.02 * sum(load.values()) / 6
    sharding.rebalance(slot_map, rows, 3)  # shards that are no more give all they have
    assert {e.shard for e in slot_map.entries()} == {0, 1, 2} and slot_map.entries(version) == old


def test_shards_of_odd_and_no_rows(spark, make, odd_rows):
    rows, slot_map = shard_of(spark, make(odd_rows), 3)
    got = sharding.place(rows, slot_map).collect()
    assert Counter((g.doc_id, g.text_crc32) for g in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    rows, slot_map = shard_of(spark, make([]), 3)
    assert sharding.place(rows, slot_map).collect() == []


# ---- periodic runs


def brute_runs(words, least=6, exponent=4):
    ids = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    found = {}
    for q in range(1, len(x) // exponent + 1):
        change = np.diff(np.r_[False, x[:-q] == x[q:], False].astype(np.int8))
        for a, b in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True):
            if b - a + q >= max(least, exponent * q):
                found.setdefault((a, b - a + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def periodic(r):
    alphabet = r.choice([1, 2, 3, 30])
    out = []
    for _ in range(r.randint(0, 6)):
        unit = [f"v{r.randrange(alphabet)}" for _ in range(r.randint(1, 9))]
        out += unit * r.randint(1, 9) + unit[: r.randint(0, len(unit))] + [f"w{r.randrange(50)}" for _ in range(r.randint(0, 5))]
    return r.choice([" ", "\n", "\t "]).join(out)


def test_runs_match_brute_force(spark, make):
    r = random.Random(8)
    texts = [periodic(r) for _ in range(400)] + ["é " * 5000, "a b " * 3000 + "a", prose(1, 3000), " ".join(["ab"] * 5), " ".join(["ab"] * 6)]
    got = {x.doc_id: x for x in periodic_runs.find(make(list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        runs = brute_runs(blanks(t))
        assert [tuple(x) for x in got[k].runs] == runs and got[k].collapsed == brute_collapsed(blanks(t), runs)


@pytest.mark.parametrize(("least", "exponent"), [(2, 2), (9, 3), (6, 5)])
def test_other_runs_and_ranges_of_lags(spark, make, least, exponent):
    r = random.Random(least)
    texts = [periodic(r) for _ in range(60)] + ["same " * 700, " ".join([f"w{k}" for k in range(90)] * 7), None, ""]
    docs = make([(k // 2, t) for k, t in enumerate(texts)] + [(None, texts[0])])
    given = {"min_length": least, "min_exponent": exponent}
    whole = sorted((str(x.doc_id), [tuple(y) for y in x.runs], x.collapsed) for x in periodic_runs.find(docs, **given).collect())
    dealt = sorted((str(x.doc_id), [tuple(y) for y in x.runs], x.collapsed) for x in periodic_runs.find(docs, **given, long_bytes=40, lags=7).collect())
    assert whole == dealt
    assert [w[1:] for w in whole] == [w[1:] for w in sorted((str(i), brute_runs(blanks(t), least, exponent), brute_collapsed(blanks(t), brute_runs(blanks(t), least, exponent))) for i, t in [(k // 2, t) for k, t in enumerate(texts)] + [(None, texts[0])])]


def test_runs_of_odd_and_no_rows(spark, make, odd_rows):
    got = sorted((str(r.doc_id), r.collapsed) for r in periodic_runs.find(make(odd_rows)).collect())
    assert got == sorted((str(i), brute_collapsed(blanks(t), brute_runs(blanks(t)))) for i, t in odd_rows)
    assert periodic_runs.find(make([])).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find(make([]), min_exponent=1)


def test_op12_against_brute_force(spark, tmp_path):
    from tessera.llm.queries import op12_periodic_runs

    r = random.Random(3)
    rows = [(k, r.choice([None, "", prose(k, r.randint(1, 200)), periodic(r)])) for k in range(150)] + [(None, prose(7, 40))]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: tuple(x)[1:] for x in op12_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, t in rows:
        words, h = blanks(t), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if i is not None and h % 10 == 0 and n:
            planted += 1
            a, own = g % n, list(words)
            p = 1 + (n - a) // (3 + g % 8)
            words = [own[k] if k < a else own[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        digests = ["".join(f"{s},{m},{q}\n" for s, m, q in runs), brute_collapsed(words, runs)]
        assert got[i] == (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), *(hashlib.sha256(d.encode()).hexdigest() for d in digests))
    assert planted > 5


# ---- collocations

DOCS = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "lang", "phrase", "window", "key", "n", "a", "rank")])


def brute_phrases(rows, support, longest, top):
    count, total = Counter(), Counter()
    for text, lang in rows:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            folded = folded.replace(c, ".")
        lang = "und" if lang is None else lang
        for piece in folded.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for m in range(1, longest + 1):
                count.update((lang, *words[k : k + m]) for k in range(len(words) - m + 1))
    often = {p: a for p, a in count.items() if a >= support}
    out = defaultdict(list)
    for (lang, *w), a in often.items():
        m = len(w)
        if m < 2 or any(q[0] == lang and len(q) - 1 > m and b >= a and any(list(q[1 + k : 1 + k + m]) == w for k in range(len(q) - m)) for q, b in often.items() if b >= a and len(q) - 1 > m):
            continue
        cuts = []
        for k in range(1, m):
            left, right = often[(lang, *w[:k])], often[(lang, *w[k:])]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        s, _, left, right = min(cuts)
        out[lang].append((-s, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, total[lang], -s) for lang, x in out.items() for k, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def written(seed, n):
    r = random.Random(seed)
    common = ["of", "the", "Éa", "new", "York", "city", "x" * 300]
    out = []
    for _ in range(n):
        parts = [r.choice([*common, "new york", "new york city", "the the the the the the", f"w{r.randrange(40)}"]) for _ in range(r.randint(0, 25))]
        text = "".join(p + r.choice([" ", " ", " ", "\t", ", ", ".", "\n", " \x00 "]) for p in parts)
        out.append((r.choice([text, text, None, ""]) if r.random() < 0.1 else text, r.choice(["en", "en", "en", "de", None, ""])))
    return out


@pytest.mark.parametrize(("support", "buckets", "longest", "top"), [(3, 1024, 5, 2000), (3, 2, 5, 40), (2, 7, 3, 2000), (8, 5, 2, 2000)])
def test_collocations_match_brute_force(spark, support, buckets, longest, top):
    rows = written(support, 220)
    docs = spark.createDataFrame([(t, g, *["x"] * 6) for t, g in rows], DOCS)
    got = phrases.mine(docs, support=support, longest=longest, top=top, buckets=buckets)
    assert sorted(tuple(x) for x in got.collect()) == brute_phrases(rows, support, longest, top)


def test_collocations_let_collisions_through(spark, monkeypatch):
    """A bitmap in which everything meets prunes nothing and changes nothing."""
    rows = written(9, 60)
    docs = spark.createDataFrame([(t, g, *["x"] * 6) for t, g in rows], DOCS)
    found = phrases.Bitmap(spark.createDataFrame([(-5,), (2**63 - 1,), (7,)], "key long"))
    assert phrases.Bitmap.has(found.bits, np.array([-5, 2**63 - 1, 7, 8], np.int64).view(np.uint64)).tolist() == [True, True, True, False]

    class Full(phrases.Bitmap):
        def __init__(self, keys):
            self.bits = np.full(phrases.BITS // 8, 255, np.uint8)

    monkeypatch.setattr(phrases, "Bitmap", Full)
    assert sorted(tuple(x) for x in phrases.mine(docs, support=3).collect()) == brute_phrases(rows, 3, 5, 2000)


def test_scores_pass_64_bits(spark):
    a, n = 9 * 10**14, 10**16 + 7
    found = spark.createDataFrame([("l", "x", 1, a + 1), ("l", "y", 1, a + 5), ("l", "x y", 2, a)], "lang string, phrase string, words int, a long")
    got = phrases.score(found, spark.createDataFrame([("l", n)], "lang string, n long")).collect()
    assert [(r.l, r.r, r.score) for r in got] == [(a + 1, a + 5, 1000 * a * n // ((a + 1) * (a + 5)))]


def test_collocations_of_no_rows(spark):
    assert phrases.mine(spark.createDataFrame([], DOCS)).collect() == []
    assert phrases.mine(spark.createDataFrame([(None,) * 8, ("", "en", *["x"] * 6)], DOCS)).collect() == []
    with pytest.raises(ValueError):
        phrases.mine(spark.createDataFrame([], DOCS), longest=1)
