"""Every registered query of this library that has SQL gives the same rows as DuckDB does, on generated tables."""

import datetime as dt
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import catalog

WORDS = "the und que les licensed trash and for with red small bolt widget retinol skin acne layer oily".split()


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    r, at = random.Random(1), tmp_path_factory.mktemp("tables")
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(900), microseconds=r.randrange(10**6))
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n)) + r.choice(["", ".\nLicensed under CC BY 4.0.", " x\nLicensed under CC BY-NC 4.0."])
    n = range
    tables = {
        "documents": {"doc_id": list(n(80)), "text": [say(r.randint(1, 120)) for _ in n(80)], "lang": [r.choice(["en", "de", "fr", "es"]) for _ in n(80)], "source": [f"src{r.randrange(5)}" for _ in n(80)], "n_chars": [r.randrange(600) for _ in n(80)]},
        "benchmark": {"item_id": list(n(12)), "text": [None, "", *(say(5) for _ in n(10))]},
        "labels": {"doc_id": list(n(0, 80, 2)), "quality": pa.array([r.randrange(2) for _ in n(40)], pa.int32()), "toxic": pa.array([r.randrange(2) for _ in n(40)], pa.int32())},
        "part": {"p_partkey": list(n(60)), "p_name": [f"{r.choice(WORDS)} {r.choice(WORDS)}" for _ in n(60)], "p_brand": [f"Brand#{r.randrange(30)}" for _ in n(60)], "p_type": [r.choice(["ECONOMY", "PROMO", "SMALL"]) for _ in n(60)], "p_size": pa.array([r.randrange(1, 51) for _ in n(60)], pa.int32()), "p_retailprice": [1.0] * 60},
        "customer": {"c_custkey": list(n(50)), "c_name": ["c"] * 50, "c_nationkey": pa.array([1] * 50, pa.int32()), "c_acctbal": [round(r.uniform(-900, 900), 2) for _ in n(50)], "c_mktsegment": [r.choice(["BUILDING", "AUTO"]) for _ in n(50)]},
        "orders": {"o_orderkey": list(n(200)), "o_custkey": [r.randrange(70) for _ in n(200)], "o_orderstatus": [r.choice("OFP") for _ in n(200)], "o_totalprice": [round(r.uniform(1, 99), 2) for _ in n(200)], "o_orderdate": [day() for _ in n(200)], "o_orderpriority": [r.choice(["1-URGENT", "2-HIGH", "5-LOW"]) for _ in n(200)]},
        "lineitem": {"l_orderkey": [r.randrange(200) for _ in n(600)], "l_partkey": [r.randrange(60) for _ in n(600)], "l_suppkey": [r.randrange(60) for _ in n(600)], "l_linenumber": pa.array([1] * 600, pa.int32()), "l_quantity": [float(r.randrange(30)) for _ in n(600)], "l_returnflag": [r.choice("ARN") for _ in n(600)], "l_linestatus": [r.choice("OF") for _ in n(600)]},
        "events": {"event_id": list(n(300)), "ts": [day() for _ in n(300)], "user_id": [r.randrange(20) for _ in n(300)], "event_type": [r.choice(["view", "click"]) for _ in n(300)], "value": [round(r.uniform(0, 9), 2) for _ in n(300)], "props": ['{"k": %d}' % r.randrange(99) for _ in n(300)]},
        "pages": {"page_id": list(n(20)), "url": [f"https://a.example/{r.choice(['', 'b', 'c/d'])}{r.choice(['', '?x=1', '#top', '?q'])}" for _ in n(20)], "html": ["<p>"] * 20},
        "conversations": {"conv_id": [k // 3 for k in n(60)], "turn": [k % 3 for k in n(60)], "role": [r.choice(["user", "assistant"]) for _ in n(60)], "text": [say(6) for _ in n(60)]},
        "embeddings": {"vec_id": list(n(90)), "embedding": pa.array([[r.uniform(-1, 1) for _ in n(4)] for _ in n(90)], pa.list_(pa.float32())), "label": pa.array([r.randrange(3) for _ in n(90)], pa.int32())},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), at / f"{name}.parquet", coerce_timestamps="us")
    return str(at)


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if isinstance(v, dt.date) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(got.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in got.select(*names).collect()), key=repr)
    with duckdb.connect() as db:
        for t in ("documents", "labels", "part", "customer", "orders", "lineitem", "events", "pages", "conversations", "embeddings", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = db.execute(catalog.SQL[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == names
        other = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert mine == other and mine


def test_entry_has_the_queries_without_the_subpackage():
    import __spark_entry__ as entry

    assert set(entry.queries()) >= set(catalog.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
