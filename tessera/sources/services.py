"""Search services as data sources of Spark: spark.read.format("registry_answers"), "paper_hits" and "paper_records".

A row is an answer. What is asked follows from the filters on the columns that name it (pushed down, so they stand in
the plan): pages or exact names of the registry, search terms, ids of papers. Requests of a host are one partition, so
one task keeps the host's pace, wherever it runs; several hosts are several partitions, among which requests are dealt.
A request that fails for good is a row with its error and no payload. Options are checked when a frame is made.

With `recorded`, a folder with answers in key=NAME/ folders of text (as Spark's partitionBy("key") writes them) takes
the service's place.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from tessera.sources import http

_COMMON = {"url", "rate", "tries", "first_pause", "agent", "timeout", "recorded"}
RECORDED = 16  # recorded answers that a task reads, since no host sets a pace
_NUMBERS = ("rate", "tries", "timeout")


@dataclass
class Host(InputPartition):
    """A host and what it is asked: (columns that name the request, key, query, body)."""

    url: str
    asked: list[tuple[tuple, str, dict, dict | None]]


class Answers(DataSourceReader):
    """What the sources share; `columns` name a request, `known` are the options beside the common ones."""

    columns: tuple[str, ...]
    known: frozenset[str] = frozenset()
    path = ""

    def __init__(self, options: dict[str, str]):
        wrong = {o for o in options if o not in _COMMON | self.known}
        if wrong:
            raise ValueError(f"no such options: {', '.join(sorted(wrong))}")
        self.options, self.wanted = dict(options), {}
        self.hosts = [u.strip().rstrip("/") for u in options.get("url", "").split(",") if u.strip()]
        if bool(self.hosts) == ("recorded" in options):
            raise ValueError("either url or recorded has to be given")
        if any(urllib.parse.urlsplit(u).scheme not in ("http", "https") for u in self.hosts):
            raise ValueError("url has to be an address of http or https, or several with commas between")
        for name in (*_NUMBERS, *(k for k in self.known if k in ("pages", "rows", "most"))):
            if name in options and not float(options[name]) > 0:
                raise ValueError(f"{name} has to be more than 0")

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:  # noqa: N802
        """Equality and IN on the columns that name a request say what is asked; a column's second filter is left to Spark, as are all others."""
        left = []
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in self.columns and column not in self.wanted:
                self.wanted[column] = list(dict.fromkeys([f.value] if isinstance(f, EqualTo) else f.value))
            else:
                left.append(f)
        return [f for f in left if not (isinstance(f, IsNotNull) and f.attribute[0] in self.wanted)]  # what is wanted isn't null

    def requests(self) -> list[tuple[tuple, str, dict, dict | None]]:
        raise NotImplementedError

    def partitions(self) -> Sequence[Host]:
        asked = self.requests()
        hosts = self.hosts or [""] * max(1, len(asked) // RECORDED)
        return [Host(h, asked[k :: len(hosts)]) for k, h in enumerate(hosts) if asked[k :: len(hosts)]]

    def read(self, partition: Host) -> Iterator[tuple]:
        o = self.options
        if "recorded" in o:
            for named, key, _, _ in partition.asked:
                payload = _recorded(o["recorded"], key)
                yield *named, key, payload, None if payload is not None else "nothing is recorded"
            return
        pace = http.Pace(float(o.get("rate", 1.0)))
        pace.turn()  # what another task asked just before counts
        ask = http.asking(http.opener(o.get("agent", "tessera"), float(o.get("timeout", 60))), pace, tries=int(o.get("tries", 5)), first_pause=float(o.get("first_pause", 1.0)))
        for named, key, query, body in partition.asked:
            try:
                yield *named, key, ask(_request(f"{partition.url}{self.path}?{urllib.parse.urlencode(query)}", body)).decode("utf-8", "replace"), None
            except (http.StatusError, OSError) as e:
                yield *named, key, None, f"{type(e).__name__}: {e}"


def _request(url: str, body: dict | None) -> urllib.request.Request:
    if body is None:
        return urllib.request.Request(url)
    mark = uuid.uuid4().hex
    head = f'--{mark}\r\nContent-Disposition: form-data; name="query"\r\nContent-Type: application/json\r\n\r\n'
    return urllib.request.Request(url, data=f"{head}{json.dumps(body)}\r\n--{mark}--\r\n".encode(), headers={"Content-Type": f"multipart/form-data; boundary={mark}"})


def _recorded(folder: str, key: str) -> str | None:
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
    found = files.get_file_info(fs.FileSelector(f"{path}/key={urllib.parse.quote(key, safe='-_.')}", allow_not_found=True))
    parts = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
    texts = [files.open_input_stream(p).read().decode() for p in parts]
    return "".join(texts).rstrip("\n") if texts else None


class RegistryReader(Answers):
    columns, known = ("item_type", "status", "inci_name", "page"), frozenset({"key", "rows", "pages"})

    def requests(self) -> list[tuple[tuple, str, dict, dict | None]]:
        """The wanted names, by their own requests, or else the wanted pages, by default the first `pages`."""
        kinds, states = self.wanted.get("item_type", [None]), self.wanted.get("status", [None])
        rows, out = int(self.options.get("rows", 100)), []
        for kind in kinds:
            for state in states:
                must = [{"term": {f: v}} for f, v in (("itemType", kind), ("status", state)) if v is not None]
                if "inci_name" in self.wanted:
                    asked = [(n, 1, 5, f"seed-{http.slug(n)}.json", [*must, {"term": {"inciName": n}}]) for n in self.wanted["inci_name"] if n is not None]
                else:
                    pages = self.wanted.get("page", range(1, int(self.options.get("pages", 1)) + 1))
                    asked = [(None, p, rows, f"page-{p:03d}-{rows}.json", must) for p in pages if p is not None and p > 0]
                for name, page, size, key, terms in asked:
                    out.append(((kind, state, name, page), key, {"apiKey": self.options.get("key", ""), "text": "*", "pageSize": size, "pageNumber": page}, {"bool": {"must": terms}}))
        return out


class HitsReader(Answers):
    columns, known, path = ("term",), frozenset({"most", "tool", "email", "api_key"}), "/esearch.fcgi"

    def requests(self) -> list[tuple[tuple, str, dict, dict | None]]:
        if "term" not in self.wanted:
            raise ValueError("a filter has to name the terms: term = '...' or term IN (...), and filters have to be pushed down")
        most = int(self.options.get("most", 20))
        return [((t,), f"search-{http.digest(t, most)}.json", {**_caller(self.options), "term": t, "retmax": most, "retmode": "json", "sort": "relevance"}, None) for t in self.wanted["term"] if t is not None]


class RecordsReader(Answers):
    columns, known, path = ("id",), frozenset({"tool", "email", "api_key"}), "/efetch.fcgi"

    def requests(self) -> list[tuple[tuple, str, dict, dict | None]]:
        if "id" not in self.wanted:
            raise ValueError("a filter has to name the papers: id = '...' or id IN (...), and filters have to be pushed down")
        return [((i,), f"PMC{i}.xml", {**_caller(self.options), "id": i, "retmode": "xml"}, None) for i in self.wanted["id"] if i is not None]


def _caller(options: dict[str, str]) -> dict[str, str]:
    return {k: options[k] for k in ("tool", "email", "api_key") if options.get(k)} | {"db": "pmc"}


class _Source(DataSource):
    reader_kind: type[Answers]
    kinds: dict[str, str] = {}

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.reader_kind(dict(options))  # checks them

    def schema(self) -> str:
        return ", ".join([*(f"{c} {self.kinds.get(c, 'string')}" for c in self.reader_kind.columns), "key string, payload string, error string"])

    def reader(self, schema: StructType) -> Answers:
        return self.reader_kind(dict(self.options))


class RegistryAnswers(_Source):
    reader_kind, kinds = RegistryReader, {"page": "int"}

    @classmethod
    def name(cls) -> str:
        return "registry_answers"


class PaperHits(_Source):
    reader_kind = HitsReader

    @classmethod
    def name(cls) -> str:
        return "paper_hits"


class PaperRecords(_Source):
    reader_kind = RecordsReader

    @classmethod
    def name(cls) -> str:
        return "paper_records"


def answers(spark: SparkSession, source: type[_Source], **options) -> DataFrame:
    """The answers of a service, with filters pushed down; options that are None or empty aren't given.

    Where a query has two scans with other filters, each needs a frame of its own: scans of one frame share what is pushed down.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items() if v not in (None, "")}).load()
