"""Queries of the ingestion operators over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import text
from tessera.operators import relational, runs, sampling, shared, store
from tessera.plans import jobs
from tessera.schemas import TABLES
from tessera.sources import articles, products, registry, services

WORDS = ("the", "und", "que", "les", "licensed", "trash")
MIN_PER_SEED, LIMIT = 10, 60


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _match_sql(body: str, word: str) -> str:
    return f"regexp_matches(lower({body}), '(^|[^a-z0-9]){word}($|[^a-z0-9])')"


_SEEDS_SQL = "(VALUES " + ", ".join(f"('{w}', {n})" for n, w in enumerate(WORDS)) + ") s(seed, seed_order)"
_MATCHES_SQL = " UNION ALL ".join(f"SELECT doc_id, '{w}' AS seed FROM documents WHERE {_match_sql('text', w)}" for w in WORDS)


def q01_first_wins_dedup(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.md5("text").alias("k"), "doc_id", "source")
    return relational.first_wins(rows, ["k"], ["doc_id"])


Q01 = "SELECT md5(text) AS k, doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1"


def q02_whole_word_match(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(text.matched(F.col("text"), WORDS)).alias("seed"))


Q02 = _MATCHES_SQL


def q03_seed_coverage(spark, sf_dir):
    return relational.seed_coverage(_table(spark, sf_dir, "documents"), "text", WORDS, 50)


Q03 = f"SELECT seed, seed_order, count(doc_id) AS n, count(doc_id) < 50 AS low FROM {_SEEDS_SQL} LEFT JOIN ({_MATCHES_SQL}) m USING (seed) GROUP BY ALL"


def q04_quota_sample(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("foreign", (F.col("lang") != "en").cast("int"))
    return sampling.quota_sample(docs, WORDS, "text", min_per_seed=MIN_PER_SEED, limit=LIMIT, order=["foreign", "doc_id"], id="doc_id")


def _quota_sql() -> str:
    flags = ", ".join(f"{_match_sql('text', w)} AS m{n}" for n, w in enumerate(WORDS))
    parts = [f"d AS MATERIALIZED (SELECT doc_id, CAST(lang <> 'en' AS INT) AS f, {flags} FROM documents)", "c0 AS (SELECT NULL::BIGINT AS doc_id, NULL::BIGINT AS pick WHERE false)"]
    step = "c{b} AS MATERIALIZED (SELECT * FROM c{a} UNION ALL SELECT doc_id, (SELECT count(*) FROM c{a}) + r - 1 FROM (SELECT doc_id, row_number() OVER (ORDER BY f, doc_id) AS r FROM d WHERE {m} AND doc_id NOT IN (SELECT doc_id FROM c{a})) WHERE r <= {most})"
    left = f"{LIMIT} - (SELECT count(*) FROM c{{a}})"
    for n in range(len(WORDS)):
        own = f"{MIN_PER_SEED} - (SELECT count(*) FROM c{n} JOIN d USING (doc_id) WHERE m{n})"
        parts.append(step.format(a=n, b=n + 1, m=f"m{n}", most=f"least({own}, {left.format(a=n)})"))
    n = len(WORDS)
    parts.append(step.format(a=n, b=n + 1, m="true", most=left.format(a=n)))
    return f"WITH {', '.join(parts)} SELECT doc_id AS id, pick FROM c{n + 1}"


Q04 = _quota_sql()


def q05_topk_per_group(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return relational.top(rows, 3, ["source"], F.desc("n_chars"), F.asc("doc_id")).withColumn("rank", F.col("rank").cast("long"))


Q05 = "SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 3"


def q06_license_gate(spark, sf_dir):
    kind = F.regexp_extract("text", r"Licensed under CC (BY[A-Z-]*) ([0-9.]+)\.", 1)
    version = F.regexp_extract("text", r"Licensed under CC (BY[A-Z-]*) ([0-9.]+)\.", 2)
    own = F.concat(F.lit("https://CreativeCommons.org/licenses/"), F.lower(kind), F.lit("/"), version)
    other = F.when(F.col("lang") == "en", F.lit("http://creativecommons.org/publicdomain/zero/1.0/")).otherwise(F.lit("https://example.com/terms"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", text.first_license(F.array(own, other)).alias("license"))
    return docs.where("license is not null")


Q06 = r"""
WITH u AS (SELECT doc_id, lang, regexp_extract(text, 'Licensed under CC (BY[A-Z-]*) ([0-9.]+)\.', 1) AS k, regexp_extract(text, 'Licensed under CC (BY[A-Z-]*) ([0-9.]+)\.', 2) AS v FROM documents)
SELECT doc_id, CASE WHEN k = 'BY' THEN 'CC BY ' || v ELSE 'CC0 1.0' END AS license FROM u WHERE k = 'BY' OR lang = 'en'
"""


def q07_slug_digest(spark, sf_dir):
    name = F.concat(F.lit(" "), F.col("p_name"), F.lit(" / "), F.col("p_brand"))
    return _table(spark, sf_dir, "part").select("p_partkey", text.slug(name).alias("slug"), text.digest(F.concat_ws("|", "p_name", F.col("p_size").cast("string"))).alias("digest"))


Q07 = "SELECT p_partkey, trim(regexp_replace(lower(' ' || p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, substr(sha1(p_name || '|' || p_size), 1, 8) AS digest FROM part"


def q08_last_category(spark, sf_dir):
    tags = F.array(F.concat(F.lit("en:"), F.lower("p_type")), F.lower("p_name"), F.concat(F.lit("fr:x:"), F.lower("p_brand")))
    return _table(spark, sf_dir, "part").select("p_partkey", text.last_category(tags, "economy|small|brand#1|bolt").alias("category"))


Q08 = """
WITH t AS (SELECT p_partkey, [lower(p_type), lower(p_name), 'x:' || lower(p_brand)] AS l FROM part)
SELECT p_partkey, list_filter(l, lambda x: regexp_matches(x, 'economy|small|brand#1|bolt'))[-1] AS category FROM t
"""


def q09_first_non_blank(spark, sf_dir):
    query = F.regexp_extract("url", r"\?(.*)$", 1)
    last = F.regexp_extract("url", r"/([^/?#]*)(?:[?#].*)?$", 1)
    return _table(spark, sf_dir, "pages").select("page_id", text.first_text(F.concat(F.lit(" \t"), query, F.lit(" ")), last, F.col("url")).alias("value"))


Q09 = r"""
SELECT page_id, coalesce(nullif(trim(regexp_extract(url, '\?(.*)$', 1)), ''), nullif(trim(regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1)), ''), url) AS value FROM pages
"""


def q10_json_values(spark, sf_dir):
    record = F.parse_json(F.regexp_replace("props", r"\}$", ', "l": [" a ", "-", "", "b"], "n": null}'))
    return _table(spark, sf_dir, "events").select("event_id", *(F.array_join(text.variant_values(record, k), "|").alias(k) for k in ("k", "l", "n", "none")))


Q10 = "SELECT event_id, json_extract_string(props, '$.k') AS k, 'a|b' AS l, '' AS n, '' AS none FROM events"


def q11_section_join(spark, sf_dir):
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("s"))
    return turns.select("conv_id", F.array_join(F.transform("s", lambda s: F.concat(s["role"], F.lit(": "), s["text"])), "\n").alias("body"))


Q11 = "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id"


def q12_date_fallback(spark, sf_dir):
    y, m, d = F.year("o_orderdate").cast("string"), (F.col("o_orderkey") % 14).cast("string"), (F.col("o_custkey") % 33).cast("string")
    m = F.when(F.col("o_orderstatus") == "P", "May").otherwise(m)
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.published(y, m, d).alias("published"))


Q12 = """
WITH p AS (SELECT o_orderkey, year(o_orderdate) AS y, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE o_orderkey % 14 END AS m, o_custkey % 33 AS d FROM orders)
SELECT o_orderkey, coalesce(try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE), make_date(y, 1, 1)) AS published FROM p
"""


def _metadata() -> F.Column:
    one = lambda c: F.array(c.cast("string"))
    return F.to_variant_object(
        F.struct(
            F.array(F.when(F.col("p_type") == "PROMO", "substance").otherwise("ingredient")).alias("itemType"),
            one(F.col("p_partkey")).alias("substanceId"),
            one(F.concat(F.lit(" "), F.upper("p_name"))).alias("inciName"),
            F.array(F.when(F.col("p_size") > 25, " / ").otherwise(F.concat(F.lit("50-00-"), F.col("p_size").cast("string")))).alias("casNo"),
            F.array("p_type", F.lit("-"), "p_brand").alias("functionName"),
            F.array(F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise("-")).alias("annexNo"),
        )
    )


def q13_registry_parse(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").withColumn("metadata", _metadata()).select("metadata")
    r = registry.ingredients(rows)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("restrictions")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return r.select("cosing_id", "inci_name", F.array_join("functions", "|").alias("functions"), shown.alias("restrictions"), "cas_number")


Q13 = """
SELECT CAST(p_partkey AS VARCHAR) AS cosing_id, upper(p_name) AS inci_name, p_type || '|' || p_brand AS functions,
  CASE WHEN p_size > 40 THEN 'annexNo=' || p_brand END AS restrictions, CASE WHEN p_size <= 25 THEN '50-00-' || p_size END AS cas_number
FROM part WHERE p_type <> 'PROMO'
"""


def q14_upsert_actions(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("amount"), F.min("o_orderpriority").alias("note"))
    staged = _table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("note"))
    return store.upsert_rows(orders, staged, ["key"], preserve=["note"])


Q14 = """
WITH o AS (SELECT o_custkey AS key, max(o_totalprice) AS amount, min(o_orderpriority) AS note FROM orders GROUP BY 1),
n AS (SELECT c_custkey AS key, c_acctbal AS amount, nullif(c_mktsegment, 'BUILDING') AS note FROM customer WHERE c_acctbal > 0)
SELECT coalesce(n.key, o.key) AS key, coalesce(n.amount, o.amount) AS amount, coalesce(n.note, o.note) AS note,
  CASE WHEN n.key IS NULL THEN 'kept' WHEN o.key IS NULL THEN 'inserted' ELSE 'updated' END AS action
FROM o FULL JOIN n ON o.key = n.key
"""


def q15_prune(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").cast("string").alias("source_id"), "o_totalprice")
    keep = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("source_id"))
    return store.pruned(rows, "1-URGENT", keep)


Q15 = """
SELECT o_orderpriority AS source, CAST(o_orderkey AS VARCHAR) AS source_id, o_totalprice FROM orders
WHERE o_orderpriority <> '1-URGENT' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
"""


def _run_log(spark, sf_dir) -> DataFrame:
    """Events as entries of a run log: of three one hasn't ended."""
    ts = F.col("ts").cast("timestamp")
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.lit("dag").alias("dag"),
        F.timestamp_micros(F.unix_micros(ts) * 100 + F.col("event_id") % 97).alias("started_at"),
        F.col("event_type").alias("status"),
        F.create_map(F.lit("event"), F.col("event_id")).alias("counts"),
        F.when(F.col("event_id") % 3 > 0, F.date_trunc("day", ts)).alias("finished_at"),
    )


_RUN_LOG_SQL = "(SELECT CAST(user_id AS VARCHAR) AS run_id, epoch_us(ts) * 100 + event_id % 97 AS started, event_id, event_type, CASE WHEN event_id % 3 > 0 THEN date_trunc('day', ts) END AS finished FROM events)"


def q16_run_log_latest(spark, sf_dir):
    return runs.current(_run_log(spark, sf_dir)).select("run_id", F.col("counts")["event"].alias("event_id"), F.col("status").alias("event_type"))


Q16 = f"SELECT run_id, event_id, event_type FROM {_RUN_LOG_SQL} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY coalesce(finished, TIMESTAMP '1970-01-01') DESC, started DESC) = 1"


def q48_run_by_id(spark, sf_dir):
    return runs.of(_run_log(spark, sf_dir), "7").select("run_id", F.col("counts")["event"].alias("event_id"))


Q48 = f"SELECT run_id, event_id FROM {_RUN_LOG_SQL} WHERE run_id = '7' ORDER BY coalesce(finished, TIMESTAMP '1970-01-01') DESC, started DESC LIMIT 1"


def _dump(spark, sf_dir, at: str) -> None:
    """A dump as it is published: gzipped lines, blank ones among them."""
    part = _table(spark, sf_dir, "part")
    record = F.to_json(
        F.struct(
            (F.col("p_partkey") % 50).cast("string").alias("code"), F.col("p_name").alias("product_name"), F.array(F.lit("en:face"), F.lower("p_type")).alias("categories_tags"),
            F.when(F.col("p_size") > 5, F.concat_ws(", ", "p_name", "p_type")).alias("ingredients_text"), F.when(F.col("p_size") > 30, "en").otherwise("fr").alias("lang"),
        )
    )
    lines = part.select("p_partkey", record.alias("record")).orderBy("p_partkey").select(F.explode(F.array("record", F.lit("  "))).alias("value"))
    lines.coalesce(1).write.option("compression", "gzip").text(at)


def q49_dump_sample(spark, sf_dir):
    """A dump as it is read: to the first eligible product of each code, then the quota sample."""
    with shared.folder(spark) as at:
        _dump(spark, sf_dir, at)
        eligible = products.products(products.prune_columns(products.read_dump(spark, at)), "face")
        first = relational.first_wins(eligible, ["source_id"], ["position"]).withColumn("late", (~F.col("english")).cast("int"))
        chosen = sampling.quota_sample(first, ("economy", "promo"), "raw_ingredient_text", min_per_seed=3, limit=12, order=["late", "position"], id="source_id")
        return shared.kept(chosen)


Q49 = """
WITH f AS (SELECT p_partkey % 50 AS code, p_partkey, lower(p_type) AS t, CAST(p_size <= 30 AS INT) AS late FROM part WHERE p_size > 5 QUALIFY row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) = 1),
o AS (SELECT *, row_number() OVER (ORDER BY late, p_partkey) AS r FROM f),
a AS (SELECT code, r - r AS list, row_number() OVER (ORDER BY r) AS n FROM o WHERE t LIKE 'economy%' QUALIFY n <= 3),
b AS (SELECT code, 1 AS list, row_number() OVER (ORDER BY r) AS n FROM o WHERE t LIKE 'promo%' QUALIFY n <= 3),
c AS (SELECT code, 2 AS list, row_number() OVER (ORDER BY r) AS n FROM o WHERE code NOT IN (SELECT code FROM a UNION ALL SELECT code FROM b))
SELECT CAST(code AS VARCHAR) AS id, row_number() OVER (ORDER BY list, n) - 1 AS pick FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) QUALIFY pick < 12
"""


def q50_registry_pages(spark, sf_dir):
    """Pages of search results, each row twice over the pages, and an answer that is an error: the first occurrence of an id counts."""
    rows = _table(spark, sf_dir, "part").withColumn("metadata", _metadata())
    rows = rows.select(F.explode(F.array(F.col("p_partkey") % 7, F.col("p_partkey") % 5 + 7)).alias("page"), F.struct("metadata").alias("result"))
    pages = rows.groupBy("page").agg(F.collect_list("result").alias("results")).select("page", F.to_json(F.struct("results")).alias("payload"))
    pages = pages.union(spark.createDataFrame([(99, '{"error": "x"}')], "page long, payload string"))
    return relational.first_wins(registry.parse(pages), ["cosing_id"], ["page", "position"]).select("cosing_id", "page", "inci_name")


Q50 = "SELECT CAST(p_partkey AS VARCHAR) AS cosing_id, p_partkey % 7 AS page, upper(p_name) AS inci_name FROM part WHERE p_type <> 'PROMO'"


def q55_registry_source(spark, sf_dir):
    """Recorded pages of the registry through its data source: every other page of active ingredients."""
    rows = _table(spark, sf_dir, "part").withColumn("metadata", _metadata()).withColumn("page", F.floor(F.col("p_partkey") / 100) + 1)
    pages = rows.groupBy("page").agg(F.to_json(F.struct(F.collect_list(F.struct("metadata")).alias("results"))).alias("value"))
    named = pages.select(F.format_string("page-%03d-100.json", "page").alias("key"), "value")
    with shared.folder(spark) as at:
        named.write.partitionBy("key").text(at)
        most = rows.agg(F.max("page")).first()[0] or 1
        found = services.answers(spark, services.RegistryAnswers, recorded=at, pages=most, rows=100).where("item_type = 'ingredient' and status = 'Active' and page % 2 = 1")
        return shared.kept(relational.first_wins(registry.parse(found.select("page", "payload")), ["cosing_id"], ["page", "position"]).select("cosing_id", "page", "inci_name"))


Q55 = "SELECT CAST(p_partkey AS VARCHAR) AS cosing_id, CAST(p_partkey // 100 + 1 AS INTEGER) AS page, upper(p_name) AS inci_name FROM part WHERE p_type <> 'PROMO' AND (p_partkey // 100 + 1) % 2 = 1"


def q17_counter_map(spark, sf_dir):
    return relational.counter_map(_table(spark, sf_dir, "events"), "event_type").select(F.explode("counts").alias("event_type", "n"))


Q17 = "SELECT event_type, count(*) AS n FROM events GROUP BY 1"


def q18_ordered_union(spark, sf_dir):
    parts = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_partkey").alias("id")).agg(F.min("l_orderkey").alias("rank"))
    lists = [parts.where(F.col("l_returnflag") == flag) for flag in ("R", "A", "N")]
    return relational.ordered_union(*lists).select("id", F.col("place.list").cast("long").alias("list"), "place.rank")


Q18 = """
WITH p AS (SELECT l_partkey AS id, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS list, min(l_orderkey) AS rank FROM lineitem GROUP BY ALL)
SELECT id, CAST(list AS BIGINT) AS list, rank FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY list, rank) = 1
"""


def q19_hit_coverage(spark, sf_dir):
    hits = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("seed"), F.col("l_orderkey").alias("id")).distinct()
    accepted = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return relational.hit_coverage(hits, accepted, ("A", "N", "R", "X"), 10).select("seed", "n", "low")


Q19 = """
WITH h AS (SELECT l_returnflag AS seed, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1)
SELECT seed, coalesce(n, 0) AS n, coalesce(n, 0) < 10 AS low FROM (VALUES ('A'), ('N'), ('R'), ('X')) s(seed) LEFT JOIN h USING (seed)
"""


def q34_unseen(spark, sf_dir):
    from tessera.streaming.refresh import unseen

    return unseen(_table(spark, sf_dir, "documents").select("doc_id", "source"), _table(spark, sf_dir, "labels"), ["doc_id"])


Q34 = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def q35_cas_numbers(spark, sf_dir):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    field = F.concat(F.lpad(key, 5, "1"), F.lit("-"), F.lpad(size.cast("string"), 2, "0"), F.lit("-1 / 7732-18-5 ("), F.col("p_brand"), F.lit(")"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.cas_numbers(field)).alias("at", "cas")).withColumn("at", F.col("at").cast("long"))


Q35 = """
WITH f AS (SELECT p_partkey, regexp_extract_all(lpad(CAST(p_partkey AS VARCHAR), 5, '1') || '-' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-1 / 7732-18-5 (' || p_brand || ')', '(\\d{2,7}-\\d{2}-\\d)', 1) AS l FROM part)
SELECT p_partkey, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS at, unnest(l) AS cas FROM f
""".replace("\\\\", "\\")


def q39_product_parse(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    record = F.to_json(
        F.struct(
            F.when(F.col("p_size") != 7, F.col("p_partkey").cast("string")).alias("code"),
            F.concat(F.lit("  "), F.col("p_name")).alias("product_name"),
            F.when(F.col("p_type") == "PROMO", F.upper("p_name")).alias("product_name_en"),
            F.concat(F.col("p_brand"), F.lit(" , other")).alias("brands"),
            F.array(F.concat(F.lit("en:"), F.lower("p_type")), F.lit("en:face-creams"), F.concat(F.lit("en:"), F.lower("p_name"))).alias("categories_tags"),
            F.when(F.col("p_size") != 9, F.col("p_name")).alias("ingredients_text"),
            F.lit("fr").alias("lang"),
            F.col("p_size").alias("extra"),
        )
    )
    rows = part.select(F.col("p_partkey").alias("position"), F.parse_json(record).alias("record"))
    return products.products(products.prune_columns(rows), "face|widget|economy").drop("source")


Q39 = """
SELECT p_partkey AS position, p_type = 'PROMO' AS english, CAST(p_partkey AS VARCHAR) AS source_id, CASE WHEN p_type = 'PROMO' THEN upper(p_name) ELSE p_name END AS name,
  p_brand AS brand, CASE WHEN regexp_matches(p_name, 'face|widget|economy') THEN p_name ELSE 'face-creams' END AS category, p_name AS raw_ingredient_text
FROM part WHERE p_size NOT IN (7, 9)
"""


def q40_article_parse(spark, sf_dir):
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body, first = esc(F.col("text")), esc(F.split("text", "\n")[0])
    kind = F.when(F.col("lang") == "en", "by/4.0").when(F.col("lang") == "de", "by-nc/4.0").otherwise("by/3.0")
    xml = F.concat(
        F.lit('<set xmlns:xlink="http://www.w3.org/1999/xlink"><article><front><article-meta><article-id pub-id-type="pmcid">'), F.col("doc_id").cast("string"),
        F.lit("</article-id><title-group><article-title>"), first, F.lit("</article-title></title-group><pub-date><year>2020</year><month>"), F.col("source"),
        F.lit('</month></pub-date><permissions><license xlink:href="https://creativecommons.org/licenses/'), kind,
        F.lit('/"/></permissions><abstract abstract-type="graphical"><p>no</p></abstract><abstract><sec><title>S</title><p>'), body, F.lit("</p></sec></abstract></article-meta></front></article></set>"),
    )
    parsed = articles.articles(articles.read(_table(spark, sf_dir, "documents").select(xml.alias("payload"))))
    return parsed.where("accepted").select("source_id", "title", "license", "published_at", F.md5("abstract").alias("abstract_md5"), "url")


Q40 = r"""
WITH d AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body, trim(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g')) AS title FROM documents)
SELECT 'PMC' || doc_id AS source_id, title, CASE WHEN lang = 'en' THEN 'CC BY 4.0' ELSE 'CC BY 3.0' END AS license, DATE '2020-01-01' AS published_at,
  md5('S: ' || body) AS abstract_md5, 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || doc_id || '/' AS url
FROM d WHERE lang <> 'de' AND title <> ''
"""


def q45_relevance(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(articles.relevant(F.col("text"), "the", ("and", "und"), ("for", "licens*"))).select("doc_id")


Q45 = r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\bthe\b') AND regexp_matches(lower(text), '\b(and|und)\b') AND regexp_matches(lower(text), '\bfor\b|\blicens\w*')"

def q62_store_loads(spark, sf_dir):
    """A table after three loads: staged rows come in, others of their keys go, and a prune drops what its sample lacks."""
    part = _table(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 3 == 0, "a").otherwise("b").alias("source"), F.col("p_partkey").cast("string").alias("source_id"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand"), F.col("p_type").alias("category"), F.lit("x").alias("raw_ingredient_text"), "p_size",
    )
    with shared.folder(spark) as at:
        st, table = store.Store(spark, at), TABLES["products"]
        store.load(st, table, part.where("p_size <= 25").drop("p_size"))
        store.load(st, table, part.where("p_size between 20 and 35").withColumn("name", F.upper("name")).withColumn("brand", F.lit(None).cast("string")).drop("p_size"), preserve=["brand"])
        store.load(st, table, part.where("p_size > 15 and source = 'a'").withColumn("category", F.lit("last")).drop("p_size"), prune_source="a")
        return shared.kept(st.read(table).select("source", "source_id", "name", "brand", "category"))


Q62 = """
WITH p AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'b' END AS source FROM part WHERE p_size <= 35 OR p_partkey % 3 = 0)
SELECT source, CAST(p_partkey AS VARCHAR) AS source_id, CASE WHEN source = 'b' AND p_size >= 20 THEN upper(p_name) ELSE p_name END AS name,
  CASE WHEN p_size > 10 AND (source = 'a' OR p_size <= 25) THEN p_brand END AS brand, CASE WHEN source = 'a' THEN 'last' ELSE p_type END AS category
FROM p WHERE source = 'b' OR p_size > 15
"""


def _work(spark, at: str, **given) -> jobs.Work:
    return jobs.Work(spark, config.Settings(data=f"{at}/data", **given.pop("settings")), store.Store(spark, f"{at}/store"), **given)


def q63_load_ingredients(spark, sf_dir):
    """The loader of the registry, from recorded pages to the table, run twice: the second finds its answers stored."""
    rows = _table(spark, sf_dir, "part").withColumn("metadata", _metadata()).withColumn("page", F.floor(F.col("p_partkey") / 100) + 1)
    pages = rows.groupBy("page").agg(F.to_json(F.struct(F.collect_list(F.struct("metadata")).alias("results"))).alias("value"))
    with shared.folder(spark) as at:
        pages.select(F.format_string("page-%03d-100.json", "page").alias("key"), "value").write.partitionBy("key").text(f"{at}/pages")
        most = rows.agg(F.max("page")).first()[0] or 1
        work = _work(spark, at, settings={"registry": config.Registry(url=f"recorded:{at}/pages", pages=most)}, seeds=())
        for _ in range(2):
            jobs.run(work, "ingredients")
        log = runs.current(spark.read.parquet(f"{at}/store/ingestion_runs")).select(F.col("counts").getItem("network_requests").alias("asked"), F.col("counts").getItem("updated").alias("updated"))
        again = log.agg(F.min("asked").alias("asked"), F.max("updated").alias("updated"))
        table = work.store.read(TABLES["ingredients"]).select("cosing_id", "inci_name", "cas_number")
        return shared.kept(table.join(F.broadcast(again)))  # one row


Q63 = """
SELECT CAST(p_partkey AS VARCHAR) AS cosing_id, upper(p_name) AS inci_name, CASE WHEN p_size <= 25 THEN '50-00-' || p_size END AS cas_number, 0 AS asked, count(*) OVER () AS updated
FROM part WHERE p_type <> 'PROMO'
"""


def q64_load_products(spark, sf_dir):
    """The loader of a dump, from gzipped lines over the kept sample to the table."""
    with shared.folder(spark) as at:
        _dump(spark, sf_dir, f"{at}/dump")
        work = _work(spark, at, settings={"products": config.Products(dump=f"{at}/dump", most=12, quota=3, wanted="face"), "few": 3}, seeds=("economy", "promo"))
        jobs.run(work, "products")
        return shared.kept(work.store.read(TABLES["products"]).select("source_id", "name"))


Q64 = f"WITH ids AS ({Q49}) SELECT id AS source_id, p_name AS name FROM ids JOIN (SELECT CAST(p_partkey % 50 AS VARCHAR) AS id, p_name FROM part WHERE p_size > 5 QUALIFY row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) = 1) USING (id)"


def q65_article_dates(spark, sf_dir):
    """Articles with several dates and ids: the electronic date counts, else the first with a year; of the ids the first kind that is there."""
    date = lambda attribute, c, month: F.concat(F.lit(f"<pub-date {attribute}><month>{month}</month><year>"), c, F.lit("</year></pub-date>"))
    year, key = F.year("o_orderdate").cast("string"), F.col("o_orderkey").cast("string")
    dates = F.concat(date('pub-type="ppub"', F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(year), 2), date('pub-type="collection"', F.lit("1999"), 3), F.when(F.col("o_orderkey") % 2 == 0, date('pub-type="epub"', year, 4)).otherwise(""))
    ids = F.concat(F.lit('<article-id pub-id-type="pmc">'), key, F.lit('</article-id><article-id pub-id-type="doi">d</article-id>'), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('<article-id pub-id-type="pmcid">pmc9'), key, F.lit("</article-id>"))).otherwise(""))
    xml = F.concat(
        F.lit('<set xmlns:xlink="http://www.w3.org/1999/xlink"><article><front><article-meta>'), ids, F.lit("<title-group><article-title>t</article-title></title-group>"), dates,
        F.lit('<permissions><license xlink:href="https://creativecommons.org/publicdomain/zero/1.0/"/></permissions></article-meta></front></article></set>'),
    )
    return articles.articles(articles.read(_table(spark, sf_dir, "orders").select(xml.alias("payload")))).where("accepted").select("source_id", "published_at", "license")


Q65 = """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'PMC9' ELSE 'PMC' END || o_orderkey AS source_id, 'CC0 1.0' AS license,
  CASE WHEN o_orderkey % 2 = 0 THEN make_date(year(o_orderdate), 4, 1) WHEN o_orderkey % 5 = 0 THEN DATE '1999-03-01' ELSE make_date(year(o_orderdate), 2, 1) END AS published_at
FROM orders
"""

_OWN = {k: v for k, v in globals().items() if k.startswith("q") and callable(v)}
QUERIES = dict(sorted(_OWN.items()))
SQL = {k: globals()[k[:3].upper()] for k in QUERIES if k[:3].upper() in globals()}
