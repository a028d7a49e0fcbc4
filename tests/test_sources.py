import datetime as dt
import gzip
import json
import re
import urllib.request
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.operators import store
from tessera.plans import jobs
from tessera.schemas import TABLES, create, drop
from tessera.sources import articles, http, products, registry, services


def result(**fields):
    return {"metadata": {"itemType": ["ingredient"]} | fields}


RESULTS = {
    "results": [
        result(substanceId=["1"], inciName=[" AQUA "], functionName=["SOLVENT", ""], casNo=["7732-18-5"], annexNo=[]),
        result(substanceId=["2", "22"], inciName=["RETINOL"], casNo=["68-26-8 / 11103-57-4"], cosmeticRestriction=["0.3 %"], annexNo=["-"]),
        result(substanceId=["3"], inciName=["X"], casNo=[" - / "], functionName="SKIN"),
        {"metadata": {"itemType": ["substance"], "substanceId": ["4"], "inciName": ["no"]}},
        result(inciName=["no id"]),
        {},
    ]
}


def test_registry(spark):
    payloads = [("a", json.dumps(RESULTS)), ("b", '{"error": "x"}'), ("c", "not json"), ("d", '{"results": []}')]
    d = spark.createDataFrame(payloads, "key string, payload string")
    assert [r.v for r in d.orderBy("key").select(registry.valid(F.col("payload")).alias("v")).collect()] == [True, False, False, True]
    got = {r.cosing_id: r for r in registry.parse(d).collect()}
    assert sorted(got) == ["1", "2", "3"]
    assert (got["1"].inci_name, got["1"].functions, got["1"].restrictions, got["1"].cas_number) == ("AQUA", ["SOLVENT"], None, "7732-18-5")
    assert got["2"].restrictions == {"cosmeticRestriction": ["0.3 %"]} and got["2"].cas_number == "68-26-8 / 11103-57-4"
    assert got["3"].cas_number is None and got["3"].functions == ["SKIN"]


RECORDS = [
    {"code": "1", "product_name": "Crème", "product_name_en": " Cream ", "brands": "A , B", "categories_tags": ["en:x", "en:face-creams", "en:sun"], "ingredients_text": "aqua", "lang": "fr", "extra": 1},
    {"code": "1", "product_name": "later", "categories_tags": ["en:face"], "ingredients_text": "b", "lang": "en"},
    {"code": "2", "product_name": None, "categories_tags": ["en:face"], "ingredients_text": "b"},
    {"code": "3", "product_name": "n", "categories_tags": ["en:hair"], "ingredients_text": "b"},
    {"code": "4", "product_name": "n", "categories_tags": ["en:face"], "ingredients_text": "  "},
    {"code": 5, "product_name": "n", "categories_tags": ["en:face"], "ingredients_text": "b"},
    {"code": "6", "product_name": "n", "categories_tags": ["face"], "ingredients_text": "retinol", "ingredients_text_en": "", "lang": "en"},
]


@pytest.fixture
def dump(tmp_path):
    path = tmp_path / "dump.jsonl.gz"
    path.write_bytes(gzip.compress("\n\n".join(json.dumps(r, ensure_ascii=False) for r in RECORDS).encode()))
    return str(path)


def test_products(spark, dump):
    got = products.products(products.prune_columns(products.read_dump(spark, dump)), config.CATEGORIES).orderBy("position").collect()
    assert [(r.source_id, r.name, r.brand, r.category, r.raw_ingredient_text, r.english) for r in got] == [
        ("1", "Cream", "A", "sun", "aqua", True),
        ("1", "later", None, "face", "b", True),
        ("6", "n", None, "face", "retinol", True),
    ]
    other = [config.Products(most=1), config.Products(quota=1), config.Products(english_first=False), config.Products(dump="d"), config.Products(wanted="w")]
    assert len({products.sample_folder(p, ("a",)) for p in (config.Products(), *other)} | {products.sample_folder(config.Products(), ("b",))}) == 7


def article(ids, title="T", license_="https://creativecommons.org/licenses/by/4.0/", dates="", abstract="", ref=""):
    return f"""<article xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:ali="http://www.niso.org/schemas/ali/1.0/"><front><article-meta>{ids}
      <title-group><article-title>{title}</article-title></title-group>{dates}
      <permissions><license xlink:href="{license_}">{ref}</license></permissions>{abstract}</article-meta></front></article>"""


PMC = '<article-id pub-id-type="{}">{}</article-id>'
ARTICLES = f"""<set>
{article(PMC.format("pmid", "77") + PMC.format("pmcid", "pmc1"), "A  <i>nice</i>\n title", dates='<pub-date pub-type="ppub"><year>2019</year></pub-date><pub-date pub-type="epub"><year>2020</year><month>2</month><day>30</day></pub-date>',
  abstract='<abstract abstract-type="graphical"><p>no</p></abstract><abstract><sec><title>Aim</title><p>one</p><sec><p>two</p></sec></sec><sec><p>three</p></sec></abstract>')}
{article(PMC.format("pmc", "2"), license_="https://creativecommons.org/licenses/by-nc/4.0/")}
{article(PMC.format("pmcaid", "3"), license_="", ref="<ali:license_ref>https://creativecommons.org/publicdomain/zero/1.0/</ali:license_ref>", dates='<pub-date><year>2021</year><month>13</month></pub-date>', abstract="<abstract>plain <b>text</b></abstract>")}
{article("", "no id")}
</set>"""


def test_articles(spark):
    d = spark.createDataFrame([("a", ARTICLES), ("b", "<eFetchResult><ERROR>gone</ERROR></eFetchResult>"), ("c", "broken <")], "key string, payload string")
    got = articles.articles(articles.read(d)).orderBy("key", "position").collect()
    assert [(r.key, r.accepted, r.error is None) for r in got] == [("a", True, True), ("a", False, True), ("a", True, True), ("a", False, True), ("b", False, False), ("c", False, False)]
    one, _, three = got[:3]
    assert (one.source_id, one.pmid, one.title, one.license, one.published_at) == ("PMC1", "77", "A nice title", "CC BY 4.0", dt.date(2020, 1, 1))
    assert one.abstract == "Aim: one two\nthree" and one.url.endswith("/PMC1/") and one.full_text is None
    assert (three.source_id, three.license, three.published_at, three.abstract) == ("PMC3", "CC0 1.0", dt.date(2021, 1, 1), "plain text")
    assert {r.key: r.fault is None for r in articles.article_faults(d).collect()} == {"a": True, "b": False, "c": False}
    answers = ["{}", "x", '{"esearchresult": {"ERROR": "e"}}', '{"esearchresult": {"idlist": []}}', '{"esearchresult": 3}', ""]
    judged = articles.search_faults(spark.createDataFrame(list(enumerate(answers)), "key int, payload string")).orderBy("key").collect()
    assert [r.fault is None for r in judged] == [False, False, False, True, False, False] and judged[2].fault.endswith(": e")


def test_query_text():
    plain = articles.query("RETINOL", ("skin",), ("acne", "cosmetic*"))
    assert plain.startswith('"retinol"[tiab] AND (skin[tiab]) AND (acne[tiab] OR cosmetic*[tiab]) AND "open access"[filter]')
    assert articles.query("CERAMIDE NP", ("skin",), ("acne",), synonyms=("ceramide np", "ceramides")).startswith('("ceramide np"[tiab] OR "ceramides"[tiab]) AND')
    with pytest.raises(articles.MissingAddressError):
        articles.caller(config.Papers(), "t")
    assert articles.caller(config.Papers(email="a@b.c", key="k"), "t") == {"tool": "t", "email": "a@b.c", "api_key": "k"}
    assert "api_key" not in articles.caller(config.Papers(email="a@b.c"), "t")


def test_settings():
    got = config.from_environment({"TESSERA_DATA": "/d", "TESSERA_PAPERS_RATE": "3", "TESSERA_PRODUCTS_ENGLISH_FIRST": "no", "TESSERA_REGISTRY_PAGES": "7", "OTHER": "x"})
    assert got == config.Settings(data="/d", papers=config.Papers(rate=3.0), products=config.Products(english_first=False), registry=config.Registry(pages=7))


def test_pace_and_retries():
    now = [0.0]
    pace, waits = http.Pace(2.0, clock=lambda: now[0]), []
    for step in (0, 0, 10.5, 0, 0):
        now[0] += step
        waits.append(round(pace.turn(), 6))
        now[0] += waits[-1]
    assert waits == [0, 0.5, 0, 0.5, 0.5]
    request, slept = urllib.request.Request("http://localhost/"), []

    def asked(answers, tries):
        slept.clear()
        left = iter(answers)
        return http.asking(lambda r: next(left), http.Pace(1e12), tries=tries, first_pause=1.0, sleep=lambda x: slept.append(round(x, 3)) if x > 0.001 else None)(request)

    assert asked([(503, {}, b""), (429, {"Retry-After": "7"}, b""), (503, {}, b""), (200, {}, b"ok")], 5) == b"ok" and slept == [1.0, 7, 4.0]
    with pytest.raises(http.StatusError):
        asked([(500, {}, b"")] * 9, 3)
    assert slept == [1.0, 2.0]
    with pytest.raises(http.StatusError):
        asked([(404, {}, b"")], 3)
    assert slept == []


def test_snapshots(spark, tmp_path):
    root, day = str(tmp_path), dt.date
    none = lambda d: d.select("key", F.lit(None).cast("string").alias("fault"))
    good = lambda d: d.select("key", F.when(F.col("payload") != "good", "bad").alias("fault"))
    held = lambda s: {r.key: r.payload for r in s.read().collect()}

    def answering(**payloads):
        rows = [(k, v if v != "gone" else None, "StatusError: status 404" if v == "gone" else None) for k, v in payloads.items()]
        return lambda keys: spark.createDataFrame([r for r in rows if r[0] in keys], "key string, payload string, error string")

    first = http.Snapshots(spark, root, "s", day=day(2026, 1, 1))
    assert first.gather(["k"], answering(k="one"), none) == {} and first.gather(["k"], answering(k="two"), none) == {} and held(first) == {"k": "one"}
    assert first.used == {"stored": 1, "asked": 1}
    later = http.Snapshots(spark, root, "s", day=day(2026, 1, 5))
    assert later.gather(["k"], answering(k="two"), none) == {} and held(later) == {"k": "one"}
    fresh = http.Snapshots(spark, root, "s", new=True, day=day(2026, 1, 5))
    assert fresh.gather(["k"], answering(k="three"), none) == {} and held(http.Snapshots(spark, root, "s")) == {"k": "three"}
    assert fresh.gather(["n", "k", "m"], answering(n="bad", k="good", m="gone"), good) == {"n": "bad", "m": "StatusError: status 404"}
    assert held(fresh) == {"k": "good"} and fresh.used == {"stored": 0, "asked": 4}


@pytest.fixture
def served():
    """A service on this host: (its address, what was asked, a place for the function that answers (path, body) with a status and a body)."""
    asked, answer = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
            asked.append(self.path)
            status, payload = answer[-1](self.path, body)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(payload)

        do_POST = do_GET  # noqa: N815

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked, answer
    server.shutdown()
    server.server_close()


def terms(body):
    return {k: v for t in json.loads(body.split(b"\r\n\r\n")[1].split(b"\r\n")[0])["bool"]["must"] for k, v in t["term"].items()}


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_registry_as_a_data_source(spark, served):
    url, asked, answer = served
    answer.append(lambda path, body: (200, json.dumps({"asked": terms(body), "page": re.search(r"pageNumber=(\d+)", path)[1]}).encode()))
    d = services.answers(spark, services.RegistryAnswers, url=url, rate=1e9, rows=7, pages=3, key="k")
    active = d.where("item_type = 'ingredient' and status = 'Active'")
    got = {(r.page, r.key): json.loads(r.payload) for r in active.collect()}
    assert got == {(n, f"page-{n:03d}-7.json"): {"asked": {"itemType": "ingredient", "status": "Active"}, "page": str(n)} for n in (1, 2, 3)}
    assert all("apiKey=k" in p and "pageSize=7" in p for p in asked) and len(asked) == 3
    assert not re.search(r"Filter .*(item_type|status)", plan(active))  # the service has filtered
    named = d.where(F.col("inci_name").isin("AQUA", "Zinc Oxide", None)).where("length(payload) > 0")
    assert {r.inci_name: json.loads(r.payload)["asked"] for r in named.collect()} == {n: {"inciName": n} for n in ("AQUA", "Zinc Oxide")}
    assert "Filter" in plan(named) and d.where("page in (5, 2) and page > 3").count() == 1 and d.where("page = 4").first().key == "page-004-7.json"
    two = services.answers(spark, services.RegistryAnswers, url=f"{url},{url}", rate=1e9, pages=5)
    assert two.rdd.getNumPartitions() == 2 and two.count() == 5


def test_failed_answers_are_rows(spark, served):
    url, asked, answer = served
    answer.append(lambda path, body: (503, b"") if "term=a" in path else (404, b"") if "term=b" in path else (200, b"fine"))
    d = services.answers(spark, services.PaperHits, url=url, rate=1e9, tries=2, first_pause=0.001, most=4).where("term in ('a', 'b', 'c')")
    assert {r.term: (r.payload, r.error) for r in d.collect()} == {"a": (None, "StatusError: status 503"), "b": (None, "StatusError: status 404"), "c": ("fine", None)}
    assert sum("term=a" in p for p in asked) == 2 and sum("term=b" in p for p in asked) == 1


def test_options_are_checked_before_anything_is_asked(spark):
    given = {"url": "http://localhost", "rate": 1e9}
    for source, options, why in [
        (services.RegistryAnswers, given | {"colour": "x"}, "colour"),
        (services.RegistryAnswers, given | {"rows": "0"}, "rows"),
        (services.RegistryAnswers, {"url": "ftp://x"}, "http"),
        (services.RegistryAnswers, {}, "either url or recorded"),
        (services.PaperHits, given, "filter has to name the terms"),
        (services.PaperRecords, given, "filter has to name the papers"),
    ]:
        with pytest.raises(Exception, match=why):
            services.answers(spark, source, **options).collect()


def test_recorded_answers(spark, tmp_path):
    rows = [("page-001-100.json", "one"), ("page-002-100.json", "two\nlines"), ("seed-zinc-oxide.json", "named")]
    spark.createDataFrame(rows, "key string, value string").write.partitionBy("key").text(str(tmp_path / "r"))
    d = services.answers(spark, services.RegistryAnswers, recorded=str(tmp_path / "r"), pages=3)
    assert [(r.page, r.payload, r.error) for r in d.orderBy("page").collect()] == [(1, "one", None), (2, "two\nlines", None), (3, None, "nothing is recorded")]
    assert d.where("inci_name = 'ZINC oxide'").first().payload == "named"


@pytest.fixture
def context(spark, tmp_path, dump, served):
    url, asked, answer = served

    def answered(path, body):
        if "registry" in path:
            named = terms(body).get("inciName")
            return 200, json.dumps(RESULTS if named is None else {"results": [result(substanceId=[f"s-{named}"], inciName=[named])]}).encode()
        if "esearch" in path:
            return 200, json.dumps({"esearchresult": {"idlist": ["1", "3", "9"] if "retinol" in path else ["3"]}}).encode()
        if "id=9" in path:
            return 404, b""
        return 200, (ARTICLES if "id=1" in path else article(PMC.format("pmc", "3"))).encode()

    answer.append(answered)
    s = config.Settings(
        data=str(tmp_path / "data"),
        requests=config.Requests(tries=2, first_pause=0.001),
        registry=config.Registry(url=f"{url}/registry", pages=1, rate=1e9),
        papers=config.Papers(url=f"{url}/papers", email="a@b.c", rate=1e9),
        products=config.Products(dump=dump, most=5),
    )
    return jobs.Work(spark, s, store.Store(spark, str(tmp_path / "store")), seeds=("RETINOL", "PANTHENOL"))


def test_ingredients_job(context, served):
    report = jobs.run(context, "ingredients")
    assert report.inserted == 5 and report.network_requests == 3
    names = {r.cosing_id: r.inci_name for r in context.store.read(TABLES["ingredients"]).collect()}
    assert names["1"] == "AQUA" and names["s-PANTHENOL"] == "PANTHENOL"
    again = jobs.run(replace(context, prune=True), "ingredients")
    assert (again.inserted, again.updated, again.cache_hits, len(served[1])) == (0, 5, 3, 3)
    assert again.notes == ["not pruned: ingredients aren't sampled anew"] and again.pruned is None
    assert jobs.run(replace(context, most=2), "ingredients").fetched == 2
    with pytest.raises(ValueError):
        jobs.run(replace(context, most=-1), "ingredients")


def test_products_job(context):
    report = jobs.run(replace(context, prune=True), "products")
    assert (report.fetched, report.inserted, report.pruned, report.english_names) == (2, 2, 0, 2)
    assert report.seeds["RETINOL"] == 1 and report.counts()["seed:RETINOL"] == 1 and "too few products: 0 of PANTHENOL" in report.notes
    assert {r.source_id for r in context.store.read(TABLES["products"]).collect()} == {"1", "6"}


def test_papers_job(context, served):
    report = jobs.run(replace(context, prune=True), "papers")
    assert (report.fetched, report.fetch_errors, report.rejected_license) == (2, 1, 2)
    assert report.seeds == {"RETINOL": 2, "PANTHENOL": 1}
    assert "not pruned: 1 answers are missing" in report.notes and report.pruned is None
    got = {r.source_id: r.title for r in context.store.read(TABLES["documents"]).collect()}
    assert got == {"PMC1": "A nice title", "PMC3": "T"}
    asked = len(served[1])
    again = jobs.run(context, "papers")
    assert again.network_requests == 1 and len(served[1]) == asked + 1 and again.updated == 2  # what failed alone


def test_papers_are_asked_at_the_pace_of_the_key():
    s = config.Settings()
    assert jobs.paper_rate(s) == 2.5 and jobs.paper_rate(replace(s, papers=config.Papers(key="k"))) == 8.0


def test_a_failed_job_leaves_no_rows(context, served):
    served[2].append(lambda path, body: (200, b'{"error": 1}'))
    with pytest.raises(ValueError, match="not a search result"):
        jobs.run(context, "ingredients")
    assert context.store.versions(TABLES["ingredients"]) == []
    from tessera.operators.runs import current, of

    [run] = current(context.spark.read.parquet(f"{context.store.root}/ingestion_runs")).collect()
    assert run.status == "failed" and run.errors
    assert [r.status for r in of(context.spark.read.parquet(f"{context.store.root}/ingestion_runs"), run.run_id).collect()] == ["failed"]


def test_tables(spark):
    for t in TABLES.values():
        create(spark, t, "made")
        assert spark.table(f"made.{t.name}").columns == t.schema.fieldNames()
        drop(spark, t, "made")
    assert jobs.health() == {"status": "ok"}


def test_articles_of_a_batch_are_parsed_in_slices(spark, monkeypatch):
    """Slices hold few bytes or one payload, and rows, errors and other columns are the same whatever they hold."""
    import pyarrow as pa

    payloads = pa.array(["ab", None, "", "abcdefgh", "c", "d"])
    assert list(articles._slices(payloads, 3)) == [(0, 3), (3, 1), (4, 2)] and list(articles._slices(payloads.slice(3), 9)) == [(0, 2), (2, 1)]
    assert list(articles._slices(payloads[:0], 3)) == []
    one = "<article><front><article-meta><article-id pub-id-type='pmc'>{}</article-id></article-meta></front></article>"
    rows = [(n, [n], None if n == 3 else "<x" if n == 4 else f"<set>{one.format(n)}{one.format(n)}</set>") for n in range(40)]
    d = spark.createDataFrame(rows, "k long, l array<long>, payload string")
    whole = sorted(map(str, articles.read(d).collect()))
    monkeypatch.setattr(articles, "SLICE_BYTES", 1)
    assert sorted(map(str, articles.read(d).collect())) == whole and len(whole) == 78


def test_lines_of_one_dump_are_parsed_by_several_tasks(spark, tmp_path):
    import gzip

    (tmp_path / "d.gz").write_bytes(gzip.compress("".join('{"code": "%d"}\n' % n for n in range(500)).encode()))
    read = products.read_dump(spark, str(tmp_path / "d.gz"))
    assert read.rdd.getNumPartitions() > 1
    assert [r.c for r in read.selectExpr("position", "variant_get(record, '$.code', 'string') AS c").orderBy("position").collect()] == [str(n) for n in range(500)]


def test_recorded_pages_are_read_by_several_tasks(spark, tmp_path, monkeypatch):
    from tessera import config
    from tessera.operators import runs, store
    from tessera.plans import jobs

    counts = []

    def gather(self, wanted, fetch, faults):
        counts.append(fetch(list(wanted)).rdd.getNumPartitions())
        return {"x": "stop"}

    monkeypatch.setattr(http.Snapshots, "gather", gather)
    for url in (f"recorded:{tmp_path}", "http://127.0.0.1:9"):
        work = jobs.Work(spark, config.Settings(data=str(tmp_path), registry=config.Registry(url=url, pages=64)), store.Store(spark, str(tmp_path)), seeds=())
        with pytest.raises(ValueError, match="stop"):
            jobs.ingredients(work, runs.Report())
    assert counts == [4, 1]
