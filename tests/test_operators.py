import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import answers, dictionary, evals, neighbours, postings, relational, resolve, runs, sampling, search, store
from tessera.schemas import TABLES
from tessera.streaming import refresh


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_first_wins(spark):
    d = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert rows(relational.first_wins(d, ["k"], ["o"])) == [("a", 1, "y"), ("b", 3, None)]
    m = d.withColumn("m", F.create_map(F.lit("v"), "v"))
    assert {r.k: r.m["v"] for r in relational.first_wins(m, ["k"], ["o"]).collect()} == {"a": "y", "b": None}


def test_ordered_union_and_coverage(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "id string, rank int")
    b = spark.createDataFrame([("y", 0), ("z", 1)], "id string, rank int")
    assert [r.id for r in relational.ordered_union(a, b).orderBy("place").collect()] == ["x", "y", "z"]
    d = spark.createDataFrame([("retinol and zinc oxide",), ("Retinol",)], "t string")
    got = relational.seed_coverage(d, "t", ("RETINOL", "ZINC OXIDE", "PANTHENOL"), 2).orderBy("seed_order").collect()
    assert [(r.seed, r.n, r.low) for r in got] == [("RETINOL", 2, False), ("ZINC OXIDE", 1, True), ("PANTHENOL", 0, True)]
    hits = spark.createDataFrame([("S", "1"), ("S", "2"), ("T", "2")], "seed string, id string")
    got = relational.hit_coverage(hits, spark.createDataFrame([("2",), ("2",)], "id string"), ("S", "T", "U"), 1).orderBy("seed_order").collect()
    assert [(r.n, r.low) for r in got] == [(1, False), (1, False), (0, True)]
    assert relational.seed_report({"seed:AB": 3, "other": 1, "seed:ABCD": 20}, 10) == [{"seed": "AB", "n": 3, "low": True}, {"seed": "ABCD", "n": 20, "low": False}]


def greedy(items, seeds, quota, limit):
    chosen, count = [], dict.fromkeys(seeds, 0)
    for s in [*seeds, None]:
        for i, own in items:
            if len(chosen) >= limit or (s and count[s] >= quota):
                break
            if i not in chosen and (s is None or s in own):
                chosen.append(i)
                for o in own:
                    count[o] += 1
    return chosen


def test_quota_sample_against_the_whole_input(spark):
    r, seeds = random.Random(4), ("AA", "BB", "CC", "DD")
    for quota, limit in ((2, 9), (3, 5), (1, 100), (0, 4), (5, 0)):
        data = [(k, r.randrange(2), " ".join(s for s in seeds if r.random() < 0.15) or "none") for k in range(70)]
        d = spark.createDataFrame(data, "id int, late int, t string").repartition(5)
        got = sampling.quota_sample(d, seeds, "t", min_per_seed=quota, limit=limit, order=["late", "id"], id="id").orderBy("pick").collect()
        items = [(i, set(t.split()) & set(seeds)) for i, late, t in sorted(data, key=lambda x: (x[1], x[0]))]
        assert [x.id for x in got] == greedy(items, seeds, quota, limit)
        assert sampling.bounded(d, seeds, "t", min_per_seed=quota, limit=limit, order=["late", "id"], id="id").count() <= quota * 4 + limit


PRODUCT = "source string, source_id string, name string, brand string, category string, raw_ingredient_text string"


def product(i, name="n", source="s", brand=None):
    return (source, i, name, brand, "c", "t")


def test_load_upserts_and_prunes_in_one_version(spark, tmp_path):
    st, table = store.Store(spark, str(tmp_path)), TABLES["products"]
    make = lambda *p: spark.createDataFrame(list(p), PRODUCT)
    assert st.read(table).count() == 0
    assert store.load(st, table, make(product("1", brand="b"), product("9", source="other"))) == {"inserted": 2, "updated": 0}
    assert store.load(st, table, make(product("1"), product("2"))) == {"inserted": 1, "updated": 1}
    assert {(r.source_id, r.brand) for r in st.read(table).collect()} == {("1", None), ("2", None), ("9", None)}
    assert all(r.updated_at for r in st.read(table).collect())
    assert store.load(st, table, make(product("2", name="new")), prune_source="s") == {"inserted": 0, "updated": 1, "pruned": 1}
    assert rows(st.read(table).select("source", "source_id", "name")) == [("other", "9", "n"), ("s", "2", "new")]
    assert st.versions(table) == [1, 2, 3] and st.read(table, 2).count() == 3
    assert store.load(st, table, make()) == {"inserted": 0, "updated": 0} and st.versions(table) == [1, 2, 3]
    with pytest.raises(ValueError, match="refusing"):
        store.load(st, table, make(), prune_source="s")
    with pytest.raises(ValueError, match="twice"):
        store.load(st, table, make(product("3"), product("3")))
    with pytest.raises(ValueError, match="null"):
        store.load(st, table, make(product(None)))
    with pytest.raises(ValueError, match="over 64"):
        store.load(st, table, make(product("x" * 65)))
    assert st.versions(table) == [1, 2, 3]


def test_two_writers(spark, tmp_path):
    st, table = store.Store(spark, str(tmp_path)), TABLES["products"]
    rows_ = spark.createDataFrame([product("1")], PRODUCT).withColumn("updated_at", F.current_timestamp())
    assert st.commit(table, rows_) == 1
    with pytest.raises(RuntimeError, match="another writer"):
        st.commit(table, rows_, base=0)
    with pytest.raises(Exception, match="nowhere"):
        st.commit(table, rows_.withColumn("name", F.raise_error(F.lit("nowhere")).cast("string")))
    assert st.versions(table) == [1] and st.commit(table, rows_) == 2
    files, claim = st._path(table.name, "claims", "3")
    files.createNewFile(claim)
    with pytest.raises(RuntimeError):
        st.commit(table, rows_)
    st.release(table)
    assert st.commit(table, rows_) == 3


def written(tmp_path, table, version):
    return sum(f.stat().st_size for kind in "vd" for f in (tmp_path / table.name / f"{kind}{version}").rglob("*.parquet"))


def test_load_writes_in_proportion_to_its_batch(spark, tmp_path):
    st, table = store.Store(spark, str(tmp_path), parts=8), TABLES["products"]
    make = lambda *p: spark.createDataFrame(list(p), PRODUCT)
    r = random.Random(4)
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(40))
    st.load = lambda d, **more: store.load(st, table, d, **more)
    st.load(make(*(product(str(i), name(), source) for i in range(6000) for source in ("s", "other"))))
    assert st.layout(table).base == dict.fromkeys(range(8), 1) and st.layout(table).rows == 12000
    assert st.load(make(*(product(str(i), "new") for i in range(5980, 6040)))) == {"inserted": 40, "updated": 20}
    at = st.layout(table)
    assert at.base == dict.fromkeys(range(8), 1) and [d.rows for d in at.deltas] == [60]  # all parts have a new key, none is written
    assert written(tmp_path, table, 2) < 0.05 * written(tmp_path, table, 1)
    assert st.read(table).count() == 12040 and st.read(table, 1).count() == 12000
    assert st.read(table).where("name = 'new'").count() == 60
    # of a key that several deltas have the last row counts; a key that is gone can come again
    assert st.load(make(product("1", "newer"))) == {"inserted": 0, "updated": 1}
    gone = make(product("1")).selectExpr("*", "cast(null AS timestamp) AS updated_at", "true AS gone__")
    assert st.change(table, gone) == 4 and st.read(table).where("source = 's' and source_id = '1'").count() == 0
    assert st.load(make(product("1", "again"))) == {"inserted": 1, "updated": 0}
    [one] = st.lookup(table, source="s", source_id="1").collect()
    assert one.name == "again" and st.lookup(table, source="s", source_id="no").count() == 0 and st.read(table).count() == 12040
    # a lookup opens its part, and the deltas that concern it
    [part] = st.touched(table, make(product("77")))
    opened = {f.split(str(tmp_path))[1].split("/")[2] + ("/" + f.split("part__=")[1].split("/")[0] if "part__=" in f else "") for f in st.lookup(table, source="s", source_id="77").inputFiles()}
    assert opened == {f"v1/{part}", *(f"d{d.version}" for d in st.layout(table).deltas if part in d.parts)} and f"v1/{part}" in opened


def test_deltas_are_merged_by_size_and_into_the_base(spark, tmp_path):
    st, table, r = store.Store(spark, str(tmp_path), parts=4), TABLES["products"], random.Random(6)
    make = lambda d: spark.createDataFrame([product(i, n) for i, n in d.items()], PRODUCT)
    truth = {str(i): "n" for i in range(400)}
    store.load(st, table, make(truth))
    most, merged = 0, False
    for step in range(12):
        batch = {str(r.randrange(500)): f"n{step}" for _ in range(r.choice([3, 3, 40]))}
        expected = {"inserted": len(batch.keys() - truth.keys()), "updated": len(batch.keys() & truth.keys())}
        assert store.load(st, table, make(batch)) == expected
        truth |= batch
        most, merged = max(most, len(st.layout(table).deltas)), merged or any(d.rows > 40 for d in st.layout(table).deltas)
        if step % 4 == 3:
            assert {x.source_id: x.name for x in st.read(table).collect()} == truth
    assert most <= 6 and merged and any(v > 1 for v in st.layout(table).base.values())
    assert {x.source_id: x.name for x in st.read(table).collect()} == truth
    assert st.expire(table, 1) and {x.source_id: x.name for x in st.read(table).collect()} == truth
    at = st.layout(table)
    kept_folders = {f"v{v}" for v in at.base.values()} | {f"d{d.version}" for d in at.deltas}
    assert {f.name for f in (tmp_path / table.name).glob("[vd][0-9]*")} == kept_folders and st.expire(table) == []


def test_prune_and_new_split(spark, tmp_path):
    st, table = store.Store(spark, str(tmp_path), parts=8), TABLES["products"]
    make = lambda *p: spark.createDataFrame(list(p), PRODUCT)
    store.load(st, table, make(*(product(str(i)) for i in range(60)), *(product(str(i), source="other") for i in range(60))))
    one = make(product("7", name="new"))
    assert store.load(st, table, one, prune_source="s") == {"inserted": 0, "updated": 1, "pruned": 59}
    assert rows(st.read(table).groupBy("source").count()) == [("other", 60), ("s", 1)]
    assert st.commit(table, st.read(table), parts=3) == 3 and st.layout(table).parts == 3
    assert store.load(st, table, make(product("8"))) == {"inserted": 1, "updated": 0} and st.read(table).count() == 62
    # all rows of a table can go
    assert st.commit(table, st.read(table).where("false")) == 5 and st.read(table).count() == 0
    assert store.load(st, table, make(product("1"))) == {"inserted": 1, "updated": 0}


def test_pruned_needs_equal_source(spark):
    d = spark.createDataFrame([("s", "1"), ("s", "2"), ("t", "1"), (None, "3")], "source string, source_id string")
    left = store.pruned(d, "s", spark.createDataFrame([("2",)], "source_id string"))
    assert sorted(map(str, rows(left.fillna("-")))) == ["('-', '3')", "('s', '2')", "('t', '1')"]


def test_runs(spark, tmp_path):
    log = str(tmp_path / "runs")

    def bad(stats):
        raise RuntimeError("why")

    runs.run(spark, log, "good", lambda report: setattr(report, "fetched", 3))
    with pytest.raises(RuntimeError):
        runs.run(spark, log, "bad", bad)
    entries = spark.read.parquet(log)
    assert entries.where("status = 'running' and finished_at is null").count() == 2
    got = {r.dag: r for r in runs.current(entries).collect()}
    assert got["good"].status == "success" and got["good"].counts == {"fetched": 3} and got["good"].finished_at
    assert got["bad"].status == "failed" and got["bad"].errors == ["RuntimeError: why"]
    assert runs.hindrance(True, 0) is None and runs.hindrance(False, 0) and runs.hindrance(True, 1)


def test_token_set_ratio(spark):
    pairs = [("sodium hyaluronate", "hyaluronate sodium", 100), ("water", "water aqua", 100), ("niacinamide", "niacinamid", 90), ("retinol", "zinc oxide", 0), ("", "x", 0)]
    d = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string").select(resolve.token_set_ratio(F.col("a"), F.col("b")).alias("s"))
    got = [r.s for r in d.collect()]
    assert got[0] == got[1] == 100 and 90 <= got[2] < 100 and got[3] < 50 and got[4] == 0


def test_trigram_pairs_are_all_of_them(spark):
    r = random.Random(2)
    names = sorted({" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 3))) for _ in range(60)})
    d = spark.createDataFrame([(n, n) for n in names], "id string, name string")
    got = {(x.left_id, x.right_id) for x in resolve.trigram_pairs(d, d, 0.4).collect()}
    grams = {x.name: set(x.g) for x in d.select("name", text.trigrams(F.col("name")).alias("g")).collect()}
    assert got == {(a, b) for a in names for b in names if len(grams[a] & grams[b]) >= 0.4 * len(grams[a] | grams[b])}


def test_cascade(spark):
    aliases = spark.createDataFrame([("Niacinamide", 1), ("vitamin B3", 1), ("Sodium Hyaluronate", 2), ("Aqua", 3)], "alias string, entity_id long")
    mentions = spark.createDataFrame([(1, "NIACINAMIDE 5%"), (2, "sodium hyaluronates"), (3, "Water/Aqua"), (4, "unobtainium"), (5, None), (6, "vitamin b3 (note)")], "mention_id long, mention string")
    judged = spark.createDataFrame([("water", 3)], "name string, entity_id long")
    got = resolve.cascade(mentions, aliases, judged=judged)
    assert rows(got.select("mention_id", "part", F.coalesce("entity_id", F.lit(-1)), "stage")) == [(1, 0, 1, "exact"), (2, 0, 2, "fuzzy"), (3, 0, 3, "judged"), (3, 1, 3, "exact"), (4, 0, -1, "unresolved"), (6, 0, 1, "exact")]
    assert {r.stage: r.n for r in resolve.stages(got).collect()} == {"exact": 3, "fuzzy": 1, "judged": 1, "unresolved": 1}


def test_subsets_wait_for_a_judge(spark):
    """Words that only hold or are held by an alias say too little: they are candidates, never answers."""
    import pandas as pd

    aliases = spark.createDataFrame([("Glycerin USP vegetable derived pharmaceutical grade", 1), ("zinc", 2), ("acid", 3), ("water", 4)], "alias string, entity_id long")
    said = ["glycerin", "zinc from some far away mine of old", "copper of old", "unheard of botanical acid", "zinc oxide in water", "waters"]
    mentions = spark.createDataFrame(list(enumerate(said, 1)), "mention_id long, mention string")
    got = resolve.cascade(mentions, aliases)
    assert rows(got.select("mention_id", F.coalesce("entity_id", F.lit(-1)), "stage")) == [(n, -1, "unresolved") for n in range(1, 7)]
    assert rows(resolve.review_queue(got)) == sorted((s, 1) for s in said)
    judge = lambda name, names: pd.Series([list(c).index("water") if "water" in list(c) and n == "zinc oxide in water" else None for n, c in zip(name, names, strict=True)], dtype="Int32")
    got = resolve.cascade(mentions, aliases, judge=judge)
    assert rows(got.where("stage <> 'unresolved'").select("mention_id", "entity_id", "stage")) == [(5, 4, "judged")]
    offered = {r.name: list(r.names) for r in resolve.suggested(resolve.mention_parts(mentions), aliases).collect()}
    assert offered["zinc oxide in water"] == ["water", "zinc"] and offered["unheard of botanical acid"] == ["acid"] and "copper of old" not in offered


def test_decisions_become_aliases(spark, tmp_path):
    """What a judge has decided is an exact alias for every later mention, for which no judge is asked."""
    import pandas as pd

    st = store.Store(spark, str(tmp_path))
    known = spark.createDataFrame([("niacinamide", 1, "registry", 1.0)], "alias string, ingredient_id long, source string, confidence double")
    store.load(st, TABLES["ingredient_aliases"], known)
    mentions = spark.createDataFrame([(1, "niacinamide of old"), (2, "gold")], "mention_id long, mention string")
    aliases = lambda: st.read(TABLES["ingredient_aliases"]).select("alias", F.col("ingredient_id").alias("entity_id"))
    judge = lambda name, names: pd.Series([0 if len(c) else None for c in names], dtype="Int32")
    got = resolve.cascade(mentions, aliases(), judge=judge)
    assert store.load(st, TABLES["ingredient_aliases"], resolve.learned(got, "judge", 0.8)) == {"inserted": 1, "updated": 0}
    again = resolve.cascade(mentions, aliases())
    assert rows(again.select("mention_id", F.coalesce("entity_id", F.lit(-1)), "stage")) == [(1, 1, "exact"), (2, -1, "unresolved")]


def test_cascade_is_as_by_hand(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 7)))
    known = {" ".join(word() for _ in range(r.randint(1, 3))): k for k in range(40)}
    said = [" ".join(x[:-1] if r.random() < 0.3 else x for x in r.choice(list(known)).split()) + r.choice(["", "", "s", " x"]) for _ in range(80)]
    got = resolve.cascade(spark.createDataFrame(list(enumerate(said)), "mention_id long, mention string"), spark.createDataFrame(list(known.items()), "alias string, entity_id long"))

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    def ratio(a, b):
        return 100.0 * (1 - lev(a, b) / max(len(a), len(b), 1)) if a or b else 100.0

    def grams(t):
        return {f"  {w} "[k : k + 3] for w in t.split() for k in range(len(w) + 1)}

    def best(name):
        if name in known:
            return known[name], "exact"
        found = []
        for alias, entity in known.items():
            a, b = set(name.split()), set(alias.split())
            near = len(grams(name) & grams(alias)) / len(grams(name) | grams(alias))
            both, left, right = " ".join(sorted(a & b)), " ".join([*sorted(a & b), *sorted(a - b)]), " ".join([*sorted(a & b), *sorted(b - a)])
            score = max(ratio(left, right), *((ratio(both, left), ratio(both, right)) if both else (0.0,)))
            sure = score >= 92 and (not (a < b or b < a) or ratio(" ".join(sorted(a)), " ".join(sorted(b))) >= 92)
            if near >= 0.3 and sure:
                found.append((score, near, -entity))
        return (-max(found)[2], "fuzzy") if found else (-1, "unresolved")

    assert rows(got.select("mention_id", F.coalesce("entity_id", F.lit(-1)), "stage")) == [(k, *best(s)) for k, s in enumerate(said)]


def test_cascade_with_embeddings(spark):
    import pandas as pd

    aliases = spark.createDataFrame([("niacinamide", 1), ("retinol", 2)], "alias string, entity_id long")
    mentions = spark.createDataFrame([(1, "vitamin b3"), (2, "retinol"), (3, "nothing"), (4, "vitamin B3 2%")], "mention_id long, mention string")
    asked = spark.createDataFrame([("vitamin b3", [1.0, 0.1]), ("nothing", [0.0, 1.0]), ("retinol", [1.0, 1.0])], "name string, vector array<double>")
    entities = spark.createDataFrame([(1, "niacinamide", [1.0, 0.0]), (2, "retinol", [0.0, 1.0])], "id long, name string, vector array<double>")
    judge = lambda name, names: pd.Series([0 if n == "vitamin b3" else None for n in name], dtype="Int32")
    run = lambda **more: rows(resolve.cascade(mentions, aliases, mention_vectors=asked, entity_vectors=entities, **more).select("mention_id", F.coalesce("entity_id", F.lit(-1)), "stage"))
    assert run(judge=judge) == [(1, 1, "judged"), (2, 2, "exact"), (3, -1, "unresolved"), (4, 1, "judged")]
    assert run() == [(1, -1, "unresolved"), (2, 2, "exact"), (3, -1, "unresolved"), (4, -1, "unresolved")]


def test_quantile_is_exact(spark):
    r = random.Random(3)
    data = [(g, v) for g in ("a", "b", None) for v in [round(r.gauss(0, 5), 1) for _ in range(r.randint(1, 300))] + [None, 1000.0]] + [("c", 2.0), ("d", None)]
    d = spark.createDataFrame(data, "g string, v double")
    exact = {x.g: x.p for x in d.where("v is not null").groupBy("g").agg(F.percentile("v", F.lit(0.95)).alias("p")).collect()}
    got = {x.g: x.p95 for x in evals.latency(d, "v", "g").collect()}
    assert got.keys() == exact.keys() and all(abs(got[k] - exact[k]) < 1e-9 for k in exact)


@pytest.mark.parametrize("ranked", [evals.RANKED, 3])
def test_quantile_under_heavy_tails(spark, ranked):
    """One outlier, a value that a third of all rows share, and sketches of days: exact, and few values are put in order."""
    d = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS g", "id % 7 AS day", "CASE WHEN id = 17 THEN 1e9 WHEN id % 3 = 1 THEN 5.0 ELSE sqrt(id) END AS v")
    exact = {x.g: x.p for x in d.groupBy("g").agg(F.percentile("v", F.lit(0.95)).alias("p")).collect()}
    daily = evals.sketches(d, "v", "g", "day")
    got = {x.g: x.p95 for x in evals.latency(d, "v", "g", sketched=evals.merged(daily, "g"), ranked=ranked).collect()}
    assert got.keys() == exact.keys() and all(abs(got[k] - exact[k]) < 1e-9 for k in exact)


def test_ablations(spark):
    r = random.Random(2)
    data = [(k, r.choice([None, 1, 2, 2]), r.choice(["exact", "fuzzy"]), r.choice([None, 2, 2, 1])) for k in range(400)]
    data = [(k, p, s if p else None, a) for k, p, s, a in data]
    d = spark.createDataFrame(data, "id int, p int, s string, a int")
    got = {x.left_out: x for x in evals.ablations(d, ["exact", "fuzzy", "judged"], "p", "s", "a", "id", draws=60).collect()}
    assert set(got) == {"", "exact", "fuzzy", "judged"}
    for left, x in got.items():
        rows_ = [(p if s != left else None, a) for _, p, s, a in data]
        tp = sum(p is not None and p == a for p, a in rows_)
        fp, fn = sum(p is not None and p != a for p, a in rows_), sum(a is not None for _, a in rows_) - tp
        assert (x.tp, x.fp, x.fn) == (tp, fp, fn) and abs(x.f1 - 2 * tp / (2 * tp + fp + fn)) < 1e-12
        assert x.f1_low <= x.f1 <= x.f1_high and 0.02 < x.f1_high - x.f1_low < 0.3
    again = {x.left_out: x for x in evals.ablations(d.repartition(7), ["exact", "fuzzy", "judged"], "p", "s", "a", "id", draws=60).collect()}
    assert again == got and got["judged"][1:] == got[""][1:]
    with pytest.raises(ValueError):
        evals.ablations(d, [], "p", "s", "a", "id")


def test_api(spark, tmp_path):
    from tessera.plans import api

    chunks = spark.createDataFrame([(1, "retinol and niacinamide together are fine"), (2, "retinol alone at night"), (3, "water")], "chunk_id long, text string")
    known = spark.createDataFrame([(2, 1, "fine", "small study", True)], "a long, b long, effect string, evidence string, reviewed boolean")
    names = {"retinol": 1, "niacinamide": 2}
    got = api.ask("Can I layer retinol with niacinamide?", chunks, names, known).collect()
    assert [(x.route, x.effect, x.chunk_id, x.rank) for x in got] == [("interaction", "fine", "1", 1)]
    got = api.ask("what is retinol", chunks, names, known).orderBy("rank").collect()
    assert sorted((x.route, x.effect, x.chunk_id) for x in got) == [("info", None, "1"), ("info", None, "2")]
    assert [(x.route, x.chunk_id) for x in api.ask("severe infection", chunks, names, known).collect()] == [("refused", None)]
    positions = spark.createDataFrame([("p", 1), ("q", 2), ("r", 9)], "product_id string, entity_id long")
    assert rows(api.check_routine(["p", "q"], positions, known)) == [(1, 2, "fine", "small study")] and api.check_routine(["p", "r"], positions, known).count() == 0
    st = store.Store(spark, str(tmp_path))
    assert {x.table: x.ready for x in api.ready(st).collect()} == dict.fromkeys(TABLES.keys() - {"ingestion_runs"}, False)
    store.load(st, TABLES["ingredients"], spark.createDataFrame([("7", "AQUA", ["x"])], "cosing_id string, inci_name string, functions array<string>"))
    assert [x.inci_name for x in api.ingredient(st, "7").collect()] == ["AQUA"] and api.ingredient(st, "8").count() == 0


def test_evaluations_are_stored_and_compared(spark, tmp_path):
    st = store.Store(spark, str(tmp_path))
    for day, recall in enumerate([90.0, 88.0, 84.0], 1):
        metrics = spark.createDataFrame([(recall, 12, "text")], "recall double, questions int, note string")
        assert evals.recorded(st, f"run{day}", metrics, dt.datetime(2026, 1, day)) == {"inserted": 2, "updated": 0}
    assert evals.recorded(st, "run3", spark.createDataFrame([(84.5,)], "recall double"), dt.datetime(2026, 1, 3)) == {"inserted": 0, "updated": 1}
    assert [(x.value, x.regressed) for x in evals.regressions(st, "recall").orderBy("started_at").collect()] == [(90.0, False), (88.0, False), (84.5, True)]


def test_evidence_of_a_routine(spark):
    from tessera.plans import api

    positions = spark.createDataFrame([("p", 1), ("q", 2), ("q", 3), ("r", 9)], "product_id string, entity_id long")
    known = spark.createDataFrame([(2, 1, "dry", "small study", True), (2, 3, "fine", "in vitro", True), (1, 9, "no", "x", True)], "a long, b long, effect string, evidence string, reviewed boolean")
    chunks = spark.createDataFrame([("c1", [1, 2], 5), ("c2", [1, 2, 3], 7), ("c3", [2], 9), ("c4", [2, 1, 1], 6), ("c5", None, 1)], "chunk_id string, ingredient_ids array<long>, published int")
    got = api.routine_evidence(["p", "q"], positions, known, chunks, k=2)
    assert rows(got.select("a", "b", "effect", "chunk_id", "rank")) == [(1, 2, "dry", "c2", 1), (1, 2, "dry", "c4", 2), (2, 3, "fine", "c2", 1)]


def test_adjudicate(spark):
    d = spark.createDataFrame([(1, 0, "b", ["a", "b"], [7, 8]), (2, 0, "z", ["a"], [7])], "mention_id long, part int, name string, names array<string>, ids array<long>")
    import pandas as pd

    judge = lambda name, names: pd.Series([list(c).index(n) if n in list(c) else None for n, c in zip(name, names)], dtype="Int32")  # noqa: E731,B905
    assert rows(resolve.adjudicate(d, judge)) == [(1, 0, 8)]
    assert resolve.adjudicate(d).count() == 0


@pytest.mark.parametrize("bytes_", [resolve.QUERY_BYTES, 100])
def test_nearest_is_exact(spark, monkeypatch, bytes_):
    monkeypatch.setattr(resolve, "QUERY_BYTES", bytes_)
    r = random.Random(1)
    data = [(k, [float(r.randint(-2, 2)) for _ in range(3)]) for k in range(80)] + [(80, [0.0, 0.0, 0.0])]
    d = spark.createDataFrame(data, "id long, vector array<float>").repartition(3)
    queries = d.where("id < 9").selectExpr("id AS query_id", "vector")

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 9) if n else 0.0

    expected = sorted((q, i, n) for q, v in data[:9] for n, (_, i) in enumerate(sorted((-cosine(v, w), i) for i, w in data)[:5], 1))
    assert rows(resolve.nearest(queries, d, 5).select("query_id", "id", "rank")) == expected


@pytest.mark.parametrize("kind", ["long", "string"])
def test_best_of_tiles(monkeypatch, kind):
    """Tasks hold a tile and the best alone, whatever the numbers of queries and vectors; equal scores go by id, null ids first."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    g = np.random.default_rng(5)
    units = resolve._unit(list(g.integers(-2, 3, (400, 3)).astype(float)))
    names = [None if k == 77 and kind == "string" else k if kind == "long" else f"é{k}" for k in range(400)]
    monkeypatch.setattr(resolve, "TILE", (37, 11))
    best = resolve.Best(pa.array(range(60)), units[:60], 7)
    for at in range(0, 400, 90):
        best.add(None, units[at : at + 90], pa.array(names[at : at + 90]))
    blank = lambda i: "" if i is None else i
    got = sorted((q, blank(i), round(x, 9)) for b in best.rows(50) for q, i, x in zip(*(c.to_pylist() for c in b.columns), strict=True))
    key = lambda n: (n[0], n[1] is not None, n[1] or 0)
    wanted = [(q, sorted(((-round(float(x), 9), n) for x, n in zip(units[q] @ units.T, names, strict=True)), key=key)[:7]) for q in range(60)]
    assert got == sorted((q, blank(n), -x) for q, most in wanted for x, n in most)
    monkeypatch.undo()
    many = resolve._unit(list(g.normal(size=(20_000, 8))))
    tracemalloc.start()
    best = resolve.Best(pa.array(range(10_000)), many[:10_000], 5)
    best.add(None, many, pa.array(range(20_000)))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20  # all scores are 1,600 MB
    tracemalloc.stop()


def test_retrieval_by_class(spark):
    ranked = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (4, 1, 9), (5, 5, 1), (6, 1, 1)], "question long, id long, rank int")
    items = spark.createDataFrame([(1, "a"), (3, "a"), (2, "b"), (4, "a"), (5, "c"), (6, None)], "id long, class string")
    asked = items.where("id in (1, 4, 5, 6)").withColumnRenamed("id", "question")
    gold = asked.join(items, "class").where("question <> id").select("question", "id")
    found = evals.retrieval_by_class(ranked, asked, items).first()
    assert tuple(found) == tuple(evals.retrieval(ranked, gold).first()) == (0.5, (1 / 2 + 1 / 9) / 2, 2)


def test_search(spark):
    docs = spark.createDataFrame([(1, "zinc oxide sunscreen"), (2, "retinol at night"), (3, "zinc and retinol together"), (4, "")], "id long, text string")
    got = search.bm25(docs, ("zinc", "sunscreen"), 2).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3]
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    assert [r.id for r in search.fuse(a, b).orderBy("rank").collect()] == [2, 1, 3]
    t = search.tagged(docs, {"zinc": 5, "retinol": 4})
    assert {r.id: r.tags for r in t.collect()} == {1: [5], 2: [4], 3: [4, 5], 4: []}
    assert [r.id for r in t.where(search.about(F.col("tags"), [4, 5], every=True)).collect()] == [3]
    c = search.chunks(docs.withColumn("text", F.repeat(F.lit("a b "), 5)).where("id = 1"), 4, 3, id="id")
    assert [len(r.text.split()) for r in c.orderBy("chunk").collect()] == [4, 4, 4]
    assert search.chunks(docs.where("id = 4"), 4, 3, id="id").count() == 0


def test_answers(spark):
    known = spark.createDataFrame([(2, 1, "irritation", "in vitro", True), (1, 3, "x", "y", False)], "a long, b long, effect string, evidence string, reviewed boolean")
    items = spark.createDataFrame([("r", 1), ("r", 2), ("r", 3), ("q", 1), ("q", 1)], "routine string, item long")
    assert rows(answers.routine_check(items, known, "routine", "item")) == [("r", 1, 2, "irritation", "in vitro")]
    assert rows(answers.routine_pairs(items, "routine", "item")) == [("r", 1, 2), ("r", 1, 3), ("r", 2, 3)]
    assert answers.queue(known).count() == 1
    claims = spark.createDataFrame([(1, [1, 2]), (2, [1, 9]), (3, [])], "claim_id long, chunk_ids array<long>")
    assert [r.claim_id for r in answers.valid_claims(claims, spark.createDataFrame([(1,), (2,)], "chunk_id long")).collect()] == [1]
    asked = ["Can I use it while pregnant?", "can I layer retinol with acid", "is it good for oily skin", "check my routine", "what is niacinamide"]
    d = spark.createDataFrame([(q,) for q in asked], "q string").select(answers.route(F.col("q")).alias("r"))
    assert [r.r for r in d.collect()] == ["refused", "interaction", "suitability", "routine_check", "info"]
    s = answers.suitability(spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "p string, i long"), spark.createDataFrame([(2,)], "i long"), "p", "i")
    assert rows(s.drop("flagged")) == [("p", 2, 1, False), ("q", 1, 0, True)]
    listed = spark.createDataFrame([(1, "Aqua (a, b), , Glycerin")], "id long, l string")
    assert rows(answers.ingredient_positions(listed, "id", "l")) == [(1, 1, "Aqua (a, b)"), (1, 3, "Glycerin")]


def test_evals(spark):
    ranked = spark.createDataFrame([(1, 10, 2), (1, 11, 9), (2, 20, 9)], "question long, id long, rank int")
    gold = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "question long, id long")
    r = evals.retrieval(ranked, gold).first()
    assert (round(r.recall_at_k, 6), round(r.mrr, 6), r.questions) == (round(1 / 3, 6), round((1 / 2 + 1 / 9) / 3, 6), 3)
    d = spark.createDataFrame([(1, 90.0), (2, 86.0), (3, 84.0)], "run int, m double")
    assert [x.regressed for x in evals.gate(d, "run", "m").orderBy("run").collect()] == [False, True, False]


def test_stream_refresh(spark, tmp_path):
    st, table = store.Store(spark, str(tmp_path / "store")), TABLES["products"]
    source = str(tmp_path / "in")
    for batch in ([product("1"), product("2")], [product("2", name="other"), product("3")]):
        spark.createDataFrame(batch, PRODUCT).coalesce(1).write.mode("append").parquet(source)
        refresh.keep_fresh(spark.readStream.schema(PRODUCT).parquet(source), st, table, str(tmp_path / "cp")).awaitTermination()
    assert rows(st.read(table).select("source_id", "name")) == [("1", "n"), ("2", "n"), ("3", "n")]


def test_newest_versions_of_a_stream(spark, tmp_path):
    """New and changed papers go on, late and repeated ones don't; a stream that stops in between gives the same; state is forgotten by time."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "source string, source_id string, name string, made timestamp"
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    batches = [
        [("s", "1", "a", day(1)), ("s", "2", "b", day(1)), ("s", "1", "a", day(1)), ("s", "3", "x", None)],
        [("s", "1", "a", day(3)), ("s", "2", "old", day(0)), ("s", "2", "c", day(2)), ("s", "2", "d", day(4))],
        [("s", "2", "c", day(3)), ("s", "4", "e", day(60))],
        [("s", "5", "f", day(61))],
        [("s", "1", "a", day(62))],
    ]

    def run(name, stops):
        source, out = str(tmp_path / name / "in"), str(tmp_path / name / "out")
        for n, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
            if n in stops:
                stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
                found = refresh.newest(stream, "made", ["source", "source_id"], delay="10 days", forget=dt.timedelta(days=20))
                found.writeStream.format("parquet").option("checkpointLocation", f"{source}-cp").trigger(availableNow=True).start(out).awaitTermination()
        return rows(spark.read.parquet(out).select("source_id", "name", "made", "change"))

    expected = sorted([("1", "a", day(1), "new"), ("2", "b", day(1), "new"), ("2", "d", day(4), "changed"), ("4", "e", day(60), "new"), ("5", "f", day(61), "new"), ("1", "a", day(62), "new")])
    assert run("whole", {4}) == expected and run("stopped", {0, 1, 2, 3, 4}) == expected

    st, table = store.Store(spark, str(tmp_path / "store")), TABLES["products"]
    products_ = f"{PRODUCT}, updated_at timestamp"
    source = str(tmp_path / "products")
    for n, name in enumerate(["first", "second"]):
        spark.createDataFrame([(*product("1", name), day(n)), (*product(str(n + 2)), day(n))], products_).coalesce(1).write.mode("append").parquet(source)
        refresh.keep_newest(spark.readStream.schema(products_).parquet(source), st, table, str(tmp_path / "cp")).awaitTermination()
    assert rows(st.read(table).select("source_id", "name")) == [("1", "second"), ("2", "n"), ("3", "n")]


def test_postings_rank_as_a_scan_does(spark, tmp_path):
    r = random.Random(12)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(r.choices(words, [1 / (n + 1) for n in range(60)], k=r.randint(0, 30)))) for k in range(900)] + [(900, None), (901, "W1 w1-w1"), (902, "w59 " * 40)]
    frame = lambda d: spark.createDataFrame(d, "id long, text string")
    index = postings.Postings(spark, str(tmp_path))
    assert index.best(spark.createDataFrame([(1, ["w1"])], "question int, terms array<string>")).count() == 0
    for low, high in ((0, 500), (500, 501), (501, 903)):
        index.add(frame(docs[low:high]))
    questions = [(1, ["w1", "W2", "w2", None]), (2, ["w59"]), (3, ["w0", "w3", "w7", "w40"]), (4, ["none"]), (5, [])]
    asked = spark.createDataFrame(questions, "question int, terms array<string>")
    got = {}
    for x in index.best(asked, 7).orderBy("question", "rank").collect():
        got.setdefault(x.question, []).append((x.id, round(x.score, 9)))
    for q, terms in questions:
        wanted = {t.lower() for t in terms if t}
        exact = [(x.id, round(x.score, 9)) for x in search.bm25(frame([(i, t or "") for i, t in docs]), sorted(wanted), 7).orderBy("rank").collect()] if wanted else []
        assert got.get(q, []) == exact
    # what is opened: the buckets of the terms alone, and of their blocks those that can matter
    rare = spark.createDataFrame([("w59",)], "term string")
    plan = index.of(rare)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "Scan parquet" in x]
    assert len(scans) == 3 and all(re.search(r"PartitionFilters: \[[^]]*bucket", x) and re.search(r"PushedFilters: \[[^]]*term", x) for x in scans)


def test_postings_count_words_in_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(postings, "SLICE_WORDS", 4)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4, 5], "w": [["a", "b", "a"], [], ["c"] * 9, None, ["a", "d"]]})
    got = [b.to_pydict() for b in postings._counted(iter([batch]))]
    assert len(got) == 3 and all(len(g["id"]) <= 4 for g in got)
    flat = sorted(zip(*(sum((g[c] for g in got), []) for c in ("id", "term", "tf", "length")), strict=True))
    assert flat == [(1, "a", 2, 3), (1, "b", 1, 3), (3, "c", 9, 9), (5, "a", 1, 2), (5, "d", 1, 2)]


def test_postings_skip_blocks(spark, tmp_path):
    rows_ = [(k, "common " + ("rare " * 5 if k % 997 == 0 else "filler " * (k % 7))) for k in range(6000)]
    index = postings.Postings(spark, str(tmp_path))
    index.add(spark.createDataFrame(rows_, "id long, text string"))
    asked = spark.createDataFrame([(1, ["common", "rare"])], "question int, terms array<string>")
    opened, there = index.opened(asked, 3)
    exact = [x.id for x in search.bm25(spark.createDataFrame(rows_, "id long, text string"), ["common", "rare"], 3).orderBy("rank").collect()]
    assert [x.id for x in index.best(asked, 3).orderBy("rank").collect()] == exact and opened < there


def test_lists_of_vectors(spark, tmp_path):
    import numpy as np

    g = np.random.default_rng(3)
    middles = g.normal(size=(12, 16))
    data = [(k, [float(x) for x in middles[k % 12] + 0.25 * g.normal(size=16)]) for k in range(1500)] + [(2000, [0.0] * 16), (2001, [0.0] * 16)]
    vectors = spark.createDataFrame(data, "id long, vector array<float>")
    asked = vectors.where("id % 50 = 0").selectExpr("id AS query_id", "vector")
    index = neighbours.Lists(spark, str(tmp_path))
    index.build(vectors, 12, sample=400)
    key = lambda d: sorted((x.query_id, x.rank, x.id) for x in d.collect())
    exact = key(resolve.nearest(asked, vectors, 10))
    assert key(index.nearest(asked, 10, probes=1)) == exact
    near = key(index.probe(asked, 10, probes=3))
    some = {(q, i) for q, _, i in exact if q < 2000}
    assert len(some & {(q, i) for q, _, i in near}) >= 0.9 * len(some)
    assert index.share_read(asked.where("query_id < 2000"), 10, 3, exact=False) < 0.5
    assert index.nearest(asked.where("false"), 3).count() == 0
    index.build(vectors.where("false"), 4)
    assert index.nearest(asked, 3).count() == 0


@pytest.mark.parametrize("block", [dictionary.BLOCK_BYTES, 200])
def test_dictionary_matches_as_patterns_do(spark, block):
    r = random.Random(5)
    names = {"zinc": 1, "zinc oxide": 2, "oxide": 3, "vitamin b-3": 4, "b": 5, "acid.": 6, "é": 7, "\\E": 8} | {"".join(r.choice("ab ") for _ in range(3)).strip() or "x": 20 + k for k in range(12)}
    texts = ["Zinc Oxide", "zincoxide zinc", "vitamin B-3, b", "acid.", "acid.x é", None, "", "x\\Ey \\E", *("".join(r.choice("ab z-") for _ in range(30)) for _ in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    expected = {x.id: sorted(x.tags or []) for x in search.tagged(docs.fillna(""), names).collect()}
    listed = spark.createDataFrame([(v, k) for k, v in names.items()] + [(90, None), (91, "")], "id int, name string")
    got = dictionary.mentioned(docs, listed, block_bytes=block)
    assert {x.id: list(x.tags) for x in got.collect()} == expected and got.columns == ["id", "text", "tags"]


def test_a_hundred_thousand_names_in_one_pass(spark):
    names = spark.range(100_000).selectExpr("id", "concat('name ', id) AS name")
    docs = spark.range(200).selectExpr("id", "concat('a name ', id * 499, ', name ', id, 'x Name ', id + 7) AS text")
    got = {x.id: list(x.tags) for x in dictionary.mentioned(docs, names).collect()}
    assert got == {k: sorted({k * 499, k + 7}) for k in range(200)}


def test_a_routine_of_a_hundred_thousand_items(spark):
    items = spark.range(100_000).selectExpr("0 AS g", "id AS i").union(spark.createDataFrame([(1, 5), (1, 6), (1, 6), (2, 5)], "g int, i long"))
    known = spark.range(2, 60_000).selectExpr("0L AS a", "id AS b", "'x' AS effect", "'e' AS evidence", "true AS reviewed").union(
        spark.createDataFrame([(6, 5, "y", "e", True), (5, 200_000, "z", "e", True), (7, 8, "n", "e", False)], "a long, b long, effect string, evidence string, reviewed boolean")
    )
    got = answers.routine_check(items, known, "g", "i")
    assert got.where("a = 0").count() == 59_998 and rows(got.where("a <> 0")) == [(0, 5, 6, "y", "e"), (1, 5, 6, "y", "e")]


def test_routines_of_all_sizes_find_what_all_pairs_do(spark):
    r = random.Random(7)
    owned = [(g, r.randrange(90)) for g, n in enumerate([0, 1, 2, 5, 31, 32, 33, 34, 60, 200]) for _ in range(n)] + [(None, 1), (None, 2), (3, None), (50, 4), (50, 4), (51, 4), (51, 5)] + [(52, 7)] * 40
    told = [(r.randrange(90), r.randrange(90), r.choice("xyz"), r.choice("ef"), r.random() < 0.8) for _ in range(900)]
    told += [(4, 4, "own", "e", True), (5, 4, "pair", "e", True), (4, 5, "pair", "a", True), (7, 7, "own", "f", True), (7, None, "z", "z", None)]
    known = {}
    for a, b, *said, shown in told:
        if shown:
            known[min(a, b), max(a, b)] = min(known.get((min(a, b), max(a, b)), ("~",)), tuple(said))
    routines = {g: {i for h, i in owned if h == g} for g, _ in owned if g is not None}
    expected = sorted((g, a, b, *said) for g, its in routines.items() for (a, b), said in known.items() if a in its and b in its)
    interactions = spark.createDataFrame(told, "a long, b long, effect string, evidence string, reviewed boolean")
    for kind in ("long", "int", "string"):
        got = answers.routine_check(spark.createDataFrame(owned, "r long, i long").withColumn("i", F.col("i").cast(kind)), interactions, "r", "i")
        assert rows(got) == expected and got.dtypes == [("r", "bigint"), ("a", "bigint"), ("b", "bigint"), ("effect", "string"), ("evidence", "string")]


def test_small_routines_shuffle_no_more_than_their_pairs(spark):
    items = spark.range(20_000).selectExpr("id DIV 8 AS g", "pmod(xxhash64(id), 500) AS i")
    known = spark.range(25_000).selectExpr("pmod(id, 500) AS a", "500 + pmod(xxhash64(id), 400) AS b", "'x' AS effect", "'e' AS evidence", "true AS reviewed")
    known = known.union(spark.createDataFrame([(1, 2, "y", "e", True)], known.schema))
    context, old = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    context.setJobGroup("small routines", "")
    try:
        found = answers.routine_check(items, known, "g", "i").collect()
    finally:
        context._jsc.clearJobGroup()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("small routines") for s in tracker.getJobInfo(j).stageIds}
    moved = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    both = {r.g for r in items.where("i = 1").join(items.where("i = 2").select("g"), "g").collect()}
    assert {(r.g, r.a, r.b) for r in found} == {(g, 1, 2) for g in both}
    assert 0 < moved < 8 * (20_000 + 25_000)  # 27 of 500 interactions for each item, made and shuffled, are 540,000 alone
