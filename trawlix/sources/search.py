"""A Python data source for a metasearch server's JSON answers.

``spark.read.format("trawlix_search").option("base_url", ...).option("queries", "a,b")``
reads one partition per query. engines, categories, language, time_range and page
go to the server; ``limit`` keeps the best hits of each query, by score. With
``whole`` each query gives one row of everything the server answered, as
``ranking.explode_responses`` and ``ranking.response_parts`` take it. ``proxy`` is the
address of an HTTP proxy.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trawlix.operators.ranking import category_names, enabled_engines

SCHEMA = "list_id int, query string, pos long, title string, url string, content string, engine string, category string, publishedDate string, thumbnail string, score double"
WHOLE = """list_id int, query string, numberOfResults long,
results array<struct<title:string,url:string,content:string,engine:string,category:string,publishedDate:string,thumbnail:string,score:double>>,
suggestions array<string>, answers array<string>, corrections array<string>, infoboxes array<struct<infobox:string,content:string,engine:string>>,
unresponsiveEngines array<array<string>>"""
TIME_RANGES = {"day", "week", "month", "year", "all"}


class _Query(InputPartition):
    def __init__(self, at: int, query: str):
        super().__init__(at)
        self.query = query


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Query(i, q.strip()) for i, q in enumerate(x for x in self.options["queries"].split(",") if x.strip())]

    def read(self, partition):
        o = self.options
        asked = {"q": partition.query, "format": "json"}
        asked |= {k: o[k] for k in ("engines", "categories", "language") if o.get(k)}
        if o.get("time_range") in TIME_RANGES:
            asked["time_range"] = o["time_range"]
        if int(o.get("page", 1)) > 1:
            asked["pageno"] = o["page"]
        with _open(f"{o['base_url']}/search?{urllib.parse.urlencode(asked)}", int(o.get("timeout_ms", 10_000)), o.get("proxy")) as answer:
            said = json.load(answer)
        hits = said.get("results") or []
        hits.sort(key=lambda h: (h.get("score") is None, -(h.get("score") or 0)))
        limit = int(o.get("limit", 0))
        rows = [_hit(h) for h in (hits[:limit] if limit > 0 else hits)]
        if o.get("whole", "false").lower() != "true":
            for pos, row in enumerate(rows):
                yield (partition.value, partition.query, pos, *row)
            return
        texts = lambda name: [x if isinstance(x, str) else json.dumps(x) for x in said.get(name) or []]
        boxes = [(b.get("infobox"), b.get("content"), b.get("engine")) for b in said.get("infoboxes") or []]
        silent = [[str(x) for x in e] if isinstance(e, list) else [str(e)] for e in said.get("unresponsive_engines") or []]
        yield (partition.value, said.get("query") or partition.query, int(said.get("number_of_results") or 0), rows, texts("suggestions"), texts("answers"), texts("corrections"), boxes, silent)


def _hit(h: dict) -> tuple:
    score = h.get("score")
    return (h.get("title") or "", h.get("url") or "", h.get("content") or h.get("snippet") or "", h.get("engine") or "unknown", h.get("category") or "general", h.get("publishedDate"), h.get("thumbnail"), None if score is None else float(score))


def _open(url: str, timeout_ms: int, proxy: str | None = None):
    ways = [urllib.request.ProxyHandler({"http": proxy, "https": proxy})] if proxy else []
    return urllib.request.build_opener(*ways).open(url, timeout=timeout_ms / 1000)


class SearchSource(DataSource):
    @classmethod
    def name(cls):
        return "trawlix_search"

    def schema(self):
        return WHOLE if self.options.get("whole", "false").lower() == "true" else SCHEMA

    def reader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()})


def health(base_url: str, timeout_ms: int = 5000) -> dict:
    """status and baseUrl of a server, with the names of its enabled engines or what went wrong."""
    try:
        with _open(f"{base_url}/healthz", timeout_ms):
            engines = [e.get("name") for e in _config(base_url, timeout_ms).get("engines") or [] if e.get("enabled")]
            return {"status": "healthy", "baseUrl": base_url, "engines": engines}
    except (OSError, ValueError) as e:
        return {"status": "unhealthy", "baseUrl": base_url, "error": str(e) or type(e).__name__}


def healthy(base_url: str, timeout_ms: int = 5000) -> bool:
    return health(base_url, timeout_ms)["status"] == "healthy"


def _config(base_url: str, timeout_ms: int) -> dict:
    """What the server says of itself; nothing if it does not answer."""
    try:
        with urllib.request.urlopen(f"{base_url}/config", timeout=timeout_ms / 1000) as answer:
            return json.load(answer) or {}
    except (OSError, ValueError):
        return {}


def read_engines(spark: SparkSession, base_url: str, timeout_ms: int = 10_000) -> DataFrame:
    """name of each enabled engine; empty if the server does not answer."""
    rows = [(e.get("name"), bool(e.get("enabled"))) for e in _config(base_url, timeout_ms).get("engines") or []]
    return enabled_engines(spark.createDataFrame(rows, "name string, enabled boolean"))


def read_categories(spark: SparkSession, base_url: str, timeout_ms: int = 10_000) -> DataFrame:
    """name of each category, which the server gives as a text or an object."""
    rows = [(c if isinstance(c, str) else json.dumps(c),) for c in _config(base_url, timeout_ms).get("categories") or []]
    return category_names(spark.createDataFrame(rows, "category string"))
