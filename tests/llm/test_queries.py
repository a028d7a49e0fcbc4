"""The registered queries: against DuckDB where they have SQL, against brute force elsewhere."""

import hashlib
import random
import zlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.llm import pii
from tessera.llm.queries import QUERIES
from tessera.llm.sql import SQL
from tests.llm.conftest import prose
from tests.llm.test_other_operators import base_spans

SHARED = [prose(900 + k, 30) for k in range(4)]


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory, odd_rows):
    at, r = tmp_path_factory.mktemp("llm"), random.Random(2)
    rows = {i: t for i, t in odd_rows if i is not None and len(t or "") < 10_000}  # the SQL takes the square of a text's length
    for k in range(100, 160):
        lines = [prose(r.randrange(10**6), r.randint(1, 60)) for _ in range(r.randint(1, 3))] + r.sample(SHARED, r.randint(0, 2))
        rows[k] = "\n".join(lines) + r.choice(["", " ## $", " a@b.co +1 (222) 333-4444", " " + lines[0]])
    rows |= {200 + k: rows[100 + k] for k in range(10)} | {220 + k: rows[110 + k].replace("w1", "e1", 1) for k in range(10)}
    ids = list(rows)
    pq.write_table(pa.table({"doc_id": ids, "text": pa.array(rows.values(), pa.string()), "lang": ["en"] * len(ids), "source": ["s"] * len(ids), "n_chars": [0] * len(ids)}), at / "documents.parquet")
    pq.write_table(pa.table({"doc_id": ids, "toxic": pa.array([i % 7 == 0 for i in ids]).cast(pa.int32()), "quality": pa.array([1] * len(ids), pa.int32())}), at / "labels.parquet")
    pq.write_table(pa.table({"item_id": list(range(6)), "text": [*SHARED[:2], "one two", "", None, "W1-w2"]}), at / "benchmark.parquet")
    turns = [(c, t, ["user", "assistant"][t % 2], r.choice([prose(c, 5), None, "", "<|im_end|>\n", "<|\\im_start|>", "é"])) for c in range(30) for t in range(r.randint(1, 5))]
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*turns, strict=True)), strict=True))), at / "conversations.parquet")
    pq.write_table(pa.table({"page_id": [1, 2], "url": ["u", "u"], "html": ["<p>a<p>b", None]}), at / "pages.parquet")
    return str(at), rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir[0])
    names = sorted(got.columns)
    with duckdb.connect() as db:
        for t in ("documents", "benchmark", "conversations"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir[0]}/{t}.parquet'")
        found = db.execute(SQL[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == names
        assert sorted(tuple(r[columns.index(c)] for c in names) for r in found.fetchall()) == sorted(tuple(r) for r in got.select(*names).collect())


def test_op1(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, sf_dir[0]).collect()}
    assert set(got) == set(sf_dir[1])
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_op2_and_op9(spark, sf_dir):
    assert sorted(tuple(r) for r in QUERIES["op2_html_text"](spark, sf_dir[0]).collect()) == [(1, "a\n\nb"), (2, "")]
    assert {r.doc_id: r.n_words for r in QUERIES["op9_token_counts"](spark, sf_dir[0]).collect()} == {i: len((t or "").encode().split()) for i, t in sf_dir[1].items()}


def test_op5(spark, sf_dir):
    got = {r.doc_id: r.decoded_sha256 for r in QUERIES["op5_byte_bpe"](spark, sf_dir[0]).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in sf_dir[1].items()}


def test_op7(spark, sf_dir):
    for r in QUERIES["op7_pii"](spark, sf_dir[0]).collect():
        spans = base_spans(sf_dir[1][r.doc_id] or "")
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans == listed
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)]


def test_all_are_registered():
    import __spark_entry__ as entry

    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
