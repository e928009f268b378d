import json
import shutil
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from trawlix.operators import extract, graph, ranking, session
from trawlix.sources import fetch, literals, session_files
from trawlix.sources.search import SearchSource, health, healthy, read_categories, read_engines
from trawlix.sources.session_store import SessionStore, session_root
from trawlix.streaming import session_stream

ROW = "session_id string, pos long, url string, title string"


class _Server(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/config":
            self._answer(json.dumps({"engines": [{"name": "a", "enabled": True}, {"name": "b", "enabled": False}], "categories": ["news", {"name": "it"}, {"name": ""}, ""]}).encode())
            return
        if self.path.startswith("/page"):
            body = "<html><head><title>T</title></head><body><article><p>" + "Words of an article, and more of them. " * 20 + "</p></article></body></html>"
            self._answer(body.encode(), 404 if self.path == "/page/none" else 200)
            return
        asked = parse_qs(urlparse(self.path).query)
        q = asked.get("q", [""])[0]
        hits = [{"title": f"{q} {i}", "url": f"http://{q}.org/{i}", "score": s, "snippet": "s"} for i, s in enumerate([None, 0.5, 2])]
        rest = {"number_of_results": 7, "suggestions": [f"more {q}"], "infoboxes": [{"infobox": "box"}], "unresponsive_engines": [["slow", "timeout"], "off"]}
        body = json.dumps({"results": hits, "asked": asked, **rest}).encode()
        self._answer(body)

    def _answer(self, body, status=200):
        self.send_response(status)
        self.send_header("content-length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def base_url():
    server = HTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_search_source(spark, base_url):
    spark.dataSource.register(SearchSource)
    df = spark.read.format("trawlix_search").option("base_url", base_url).option("queries", "a, b,").option("limit", 2).load()
    assert sorted((r.list_id, r.pos, r.title, r.content, r.engine) for r in df.collect()) == [(0, 0, "a 2", "s", "unknown"), (0, 1, "a 1", "s", "unknown"), (1, 0, "b 2", "s", "unknown"), (1, 1, "b 1", "s", "unknown")]
    assert healthy(base_url) and not healthy("http://127.0.0.1:9")
    assert health(base_url) == {"status": "healthy", "baseUrl": base_url, "engines": ["a"]}
    bad = health("http://127.0.0.1:9")
    assert bad["status"] == "unhealthy" and bad["error"]
    whole = spark.read.format("trawlix_search").option("base_url", base_url).option("queries", "a,b").option("whole", "true").load()
    assert sorted((r.list_id, r.pos, r.title) for r in ranking.explode_responses(whole).collect()) == [(i, n, f"{q} {2 - n}") for i, q in enumerate("ab") for n in range(3)]
    first = whole.orderBy("list_id").first()
    assert (first.numberOfResults, first.suggestions, first.unresponsiveEngines, first.infoboxes[0].infobox) == (7, ["more a"], [["slow", "timeout"], ["off"]], "box")
    parts = {(r.kind, r.value): (r.first.list_id, r.first.pos) for r in ranking.response_parts(whole).collect()}
    assert parts == {("suggestions", "more a"): (0, 0), ("suggestions", "more b"): (1, 0), ("unresponsive", "slow"): (0, 0), ("unresponsive", "off"): (0, 1)}


def test_files(spark, tmp_path):
    hits = [{"title": "A", "url": "http://a"}, {"title": "no url"}, {"url": ""}, {"url": "http://b", "score": 1}]
    for name, content in (("bare", {"results": hits}), ("enveloped", {"status": "ok", "data": {"results": hits}})):
        (tmp_path / name).write_text(json.dumps(content, indent=1))
        assert [(r.pos, r.url) for r in literals.read_results_file(spark, str(tmp_path / name)).orderBy("pos").collect()] == [(0, "http://a"), (3, "http://b")]
    for name, content in (("none", None), ("broken", '{"results": ['), ("list", "[1, 2]"), ("blank", "")):
        if content is not None:
            (tmp_path / name).write_text(content)
        with pytest.raises(ValueError, match="MERGE_FILE_FAILED"):
            literals.read_results_file(spark, str(tmp_path / name))
        with pytest.raises(ValueError, match="FILE_READ_FAILED"):
            literals.read_urls_file(spark, str(tmp_path / name))
    (tmp_path / "no_results").write_text("{}")
    assert literals.read_results_file(spark, str(tmp_path / "no_results")).count() == 0


def test_graph_files(spark):
    nodes = spark.createDataFrame([("q:a", "query", "a", None, 0.5)], "key string, type string, label string, url string, score double")
    edges = spark.createDataFrame([("q:a", "q:a", "is", 1.0)], "src string, dst string, relation string, weight double")
    back = literals.graph_of(literals.graph_json(nodes, edges))
    assert [(r.key, r.label, r.score) for r in back[0].collect()] == [("q:a", "a", 0.5)] and [tuple(r) for r in back[1].collect()] == [("q:a", "q:a", "is", 1.0)]
    broken = spark.createDataFrame([("{oops",)], "value string")
    assert literals.graph_of(broken, "empty")[0].count() == 0
    with pytest.raises(ValueError, match="GRAPH_READ_FAILED"):
        literals.graph_of(broken)


def test_inline_values(spark):
    data = spark.createDataFrame([('{"entities":[{"label":"T"}],"edges":[{"source":"a","target":"b","relation":"r"}]}',)], "data string")
    got = literals.inline_batch(data)
    assert [(r.pos, r.label) for r in got["entities"].collect()] == [(0, "T")] and got["results"].count() == 0 and [(r.src, r.dst, r.weight) for r in got["edges"].collect()] == [("a", "b", None)]
    assert spark.range(1).select(literals.split_literals(F.lit(" a, ,b ,")).alias("v")).first().v == ["a", "b"]


def test_config(tmp_path):
    (tmp_path / "shared").write_text('{"default_limit": 5, "base_url": "http://shared"}')
    (tmp_path / "local").write_text('{"base_url": "http://local"}')
    c = literals.Config.load(str(tmp_path / "local"), str(tmp_path / "shared"), {"TRAWLIX_ALLOWED_ENGINES": "a, b", "TRAWLIX_USE_PROXY": "true", "TRAWLIX_PROXY_URL": "http://p:1"})
    assert (c.use_proxy, c.proxy_url, literals.Config.load(env={"TRAWLIX_USE_PROXY": "no"}).use_proxy) == (True, "http://p:1", False)
    assert (c.base_url, c.default_limit, c.allowed_engines, c.timeout_ms) == ("http://local", 5, ["a", "b"], 10_000)
    with pytest.raises(ValueError):
        literals.Config.load(env={"TRAWLIX_OUTPUT_FORMAT": "csv"})


def test_store_and_stream(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "store"))
    assert store.read("results", ROW).count() == 0
    rows = [("s", 0, "http://a.org", "A"), ("s", 1, "http://a.org/#x", "dup"), ("t", 0, "http://a.org", "T")]
    spark.createDataFrame(rows, ROW).coalesce(1).write.json(str(tmp_path / "in"))
    for n in range(2):  # the second stream replays the same rows
        stream = spark.readStream.schema(ROW).json(str(tmp_path / "in"))
        session_stream.append_stream(stream, store, ROW, str(tmp_path / f"checkpoint{n}")).awaitTermination()
        assert sorted((r.session_id, r.title) for r in store.read("results", ROW).collect()) == [("s", "A"), ("t", "T")]
    batch = spark.createDataFrame([("s", 0, "http://b.org", "B"), ("u", 0, "http://a.org", "U")], ROW)
    for _ in range(2):
        store.add_round(batch)
    assert sorted(tuple(r) for r in store.rounds().collect()) == [("s", 2), ("u", 2)]
    assert sorted((r.session_id, r.pos, r.title) for r in store.read("results", ROW).collect()) == [("s", 0, "A"), ("s", 1, "B"), ("t", 0, "T"), ("u", 0, "U")]
    with pytest.raises(ValueError):
        store.delete(["../etc"])
    store.delete(["s"])
    assert sorted(r.session_id for r in store.read("results", ROW).collect()) == ["t", "u"] and [r.session_id for r in store.rounds().collect()] == ["u"]


def test_store_of_graphs_and_merges(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "store"))
    full = ROW + ", content string"
    store.add_round(spark.createDataFrame([("s", 0, "http://a.org", "A", "old"), ("t", 0, "http://b.org", "B", "old")], full))
    pages = [(0, "http://a.org/", "text", "", "me", None, 4, None)]
    store.write("rounds", spark.createDataFrame([("t", 0)], "session_id string, rounds long"))
    store.merge(spark.createDataFrame(pages, "pos long, url string, content string, excerpt string, byline string, siteName string, length long, error string"), full)
    assert sorted((r.session_id, r.content) for r in store.read("results", full).collect()) == [("s", "text"), ("t", "old")]
    assert sorted(tuple(r) for r in store.rounds().collect()) == [("s", 1), ("t", 1)]
    entities = spark.createDataFrame([(0, None, "Tokio", None, None), (1, None, "Async", None, None)], "pos long, id string, label string, entityType string, score double")
    results = spark.createDataFrame([(0, "http://a.org", "A", 1)], "pos long, url string, title string, rank long")
    edges = spark.createDataFrame([(0, "e:tokio", "e:async", "like", None), (1, "e:tokio", "e:none", "like", 1.0)], "pos long, src string, dst string, relation string, weight double")
    for name, want in (("s", (3, 1)), ("s", (0, 0)), ("t", (3, 1))):
        delta, skipped = store.graph_add(name, entities, results, edges)
        assert tuple(delta.first()) == want and [tuple(r) for r in skipped.collect()] == [("e:tokio", "e:none", "like")]
    assert [r.key for r in graph.seed_hint(store.graph("s")[0], 2).collect()] == ["e:tokio", "e:async"]
    assert {r.session_id: (r.nodes, r.edges, r.entities) for r in store.read("stats", "").collect()} == {"s": (3, 1, 2), "t": (3, 1, 2)}
    store.upsert_meta(spark.createDataFrame([("s", "me", None, None)], "session_id string, owner string, description string, query string"), F.lit(1000).cast("long"))
    listed = store.sessions().orderBy(*session.newest_first()).collect()
    assert [(r.session_id, r.owner, r.rounds, r.results, r.nodes, r.edges) for r in listed] == [("s", "me", 1, 1, 3, 1), ("t", "", 1, 1, 3, 1)]
    assert store.delete_older(0, F.lit(10**12)) == [] and store.delete_older(1, F.lit(10**12)) == ["s"]
    assert [r.session_id for r in store.sessions().collect()] == ["t"] and store.graph("s")[0].count() == 0
    shutil.rmtree(tmp_path / "store" / "meta" / store.version("meta"))
    assert store.read("meta", "session_id string").count() == 0


def test_session_folders(spark, tmp_path):
    assert session_files.read_sessions(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "file.json").write_text("{}")
    for name in ("a", "b", "c"):
        (tmp_path / name).mkdir()
    assert session_files.read_sessions(spark, str(tmp_path)).count() == 3
    (tmp_path / "a" / "results.json").write_text(json.dumps({"status": "ok", "data": {"rounds": 2, "results": [{"url": "x"}, {"url": "y"}]}}, indent=1))
    (tmp_path / "a" / "meta.json").write_text('{"owner": "me", "createdAt": 7}')
    (tmp_path / "b" / "results.json").write_text("{oops")
    (tmp_path / "b" / "meta.json").write_text('{"updatedAt": 9}')
    (tmp_path / "c" / "graph.json").write_text('{"status": "ok", "data": {"stats": {"nodes": 4, "edges": 3}}}')
    got = session_files.read_sessions(spark, str(tmp_path)).orderBy(*session.newest_first()).collect()
    assert [(r.session_id, r.owner, r.seen, r.rounds, r.results, r.nodes, r.edges) for r in got] == [("b", "", 9, 0, 0, 0, 0), ("a", "me", 7, 2, 2, 0, 0), ("c", "", 0, 0, 0, 4, 3)]


def test_graph_files_by_path_and_name(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    text = json.dumps({"nodes": [{"key": "q:b", "attributes": {"type": "query"}}, {"key": "q:a", "attributes": {"type": "query"}}], "edges": []})
    (tmp_path / "s1" / "graph.json").write_text(text)
    (tmp_path / "alone.json").write_text("[1]")
    home = str(tmp_path)
    for named in ("s1", f"{home}/s1", f"{home}/s1/graph.json"):
        nodes, edges = literals.read_graph_file(spark, named, home)
        assert [r.key for r in graph.seed_hint(nodes).collect()] == ["q:b", "q:a"] and edges.count() == 0
    back = literals.graph_of(literals.graph_json(nodes, spark.createDataFrame([], graph.EDGE_SCHEMA)))
    assert [r.key for r in graph.seed_hint(back[0]).collect()] == ["q:b", "q:a"]
    for named in ("none", f"{home}/alone.json"):
        with pytest.raises(ValueError, match="GRAPH_READ_FAILED"):
            literals.read_graph_file(spark, named, home)
        assert literals.read_graph_file(spark, named, home, "empty")[0].count() == 0


def test_streaming_distinct_and_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "http://a.org/", "k"), ("2024-01-01 00:20:00", "http://A.org#x", "k"), ("2024-01-01 05:00:00", "http://b.org", "k")]
    spark.createDataFrame(rows, "ts string, url string, k string").coalesce(1).write.json(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("ts timestamp, url string, k string").json(str(tmp_path / "in"))
    for name, df, mode in (("distinct", session_stream.distinct_urls(source()), "append"), ("windows", session_stream.counts_by_window(source(), "ts", "k"), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    assert sorted(r.id for r in spark.table("distinct").collect()) == ["http://a.org/", "http://b.org/"]
    assert [r.n for r in spark.table("windows").collect()] == [2]


def test_catalogs(spark, base_url):
    assert [r.name for r in read_engines(spark, base_url).collect()] == ["a"]
    assert sorted(r.name for r in read_categories(spark, base_url).collect()) == ["it", "news"]
    assert read_engines(spark, "http://127.0.0.1:9").count() == read_categories(spark, "http://127.0.0.1:9").count() == 0
    ranking.require_allowed(["x"], [])
    with pytest.raises(ValueError, match="INVALID_ENGINES: x"):
        ranking.require_allowed(["a", "x"], ["a"])


def test_fetch_and_extract(spark, base_url):
    urls = [f"{base_url}/page/1", f"{base_url}/page/none", "http://127.0.0.1:9/x", "mailto:a@b", None]
    fetched = fetch.fetch_pages(spark.createDataFrame(list(enumerate(urls)), "pos long, url string"))
    rows = {r.pos: r for r in extract.extract_fetched(fetched).collect()}
    assert rows[0].error is None and rows[0].content.startswith("Words of an article") and rows[0].title == "T"
    assert rows[1].error == "HTTP 404" and rows[3].error == rows[4].error == "not an http URL" and rows[2].error
    assert fetch.page_of(urls[0], max_bytes=100) == (None, "page over 100 bytes")


def test_sources_of_urls(spark):
    named = lambda *urls: spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "pos long, url string")
    assert [r.url for r in extract.urls_of(["http://a"], named("http://b")).collect()] == ["http://a"]
    assert [r.url for r in extract.urls_of(None, named("", "http://b"), named("http://c")).collect()] == ["http://b"]
    for given, code in (((None, named()), "SESSION_EMPTY"), ((None, named("")), "NO_URLS"), ((None, None, named(None)), "NO_URLS"), ((), "MISSING_INPUT")):
        with pytest.raises(ValueError, match=code):
            extract.urls_of(*given)


def test_session_names():
    assert session_root("a1", "/home/s/") == "/home/s/a1" and session_root("/x/y", "/home") == "/x/y"
    assert session_root("new", "/h") != session_root("new", "/h")
    with pytest.raises(ValueError, match="not a session name"):
        session_root("..", "/h")
