import random

import pytest
from pyspark.sql import functions as F

from trawlix.functions.simhash64 import simhash_text
from trawlix.operators import dedupe, extract, graph, ranking, render, session

ROW = "session_id string, pos long, url string, title string, content string"


def test_fusion(spark):
    lists = spark.createDataFrame([(0, 0, "a"), (0, 1, ""), (0, 2, "b"), (0, 3, "a"), (1, 0, "b"), (1, 1, None), (1, 2, "c")], "list_id int, pos long, id string")
    got = {r.id: (r.score, r.first_list, r.first_pos) for r in ranking.fuse(lists).collect()}
    assert got == {"a": (pytest.approx(1 / 61 + 1 / 64), 0, 0), "b": (pytest.approx(1 / 63 + 1 / 61), 0, 2), "c": (pytest.approx(1 / 63), 1, 2)}
    assert ranking.fuse(lists.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ranking.fuse(lists, 0)
    tied = spark.createDataFrame([(0, 0, "x"), (1, 0, "y"), (2, 0, "w")], "list_id int, pos long, id string")
    assert [r.id for r in ranking.fuse(tied).orderBy(*ranking.fused_order()).collect()] == ["x", "y", "w"]
    hits = lists.withColumn("title", F.concat("id", F.lit("-"), "list_id"))
    pick = lambda last: {r.id: r.title for r in ranking.pick_hits(ranking.fuse(lists), hits, last).collect()}
    assert pick(False) == {"a": "a-0", "b": "b-0", "c": "c-1"} and pick(True) == {"a": "a-0", "b": "b-1", "c": "c-1"}


def test_responses_become_lists(spark):
    hit = "struct<url:string,title:string>"
    df = spark.createDataFrame([(0, "q", [("http://a", "A"), ("http://b", "B")], ["s"]), (1, "r", [("http://a/", "A2")], [])], f"list_id int, query string, results array<{hit}>, corrections array<string>")
    hits = ranking.explode_responses(df)
    assert hits.columns == ["list_id", "query", "pos", "url", "title"]
    shown, total = ranking.merge_searches(hits.drop("query"), limit=1)
    assert [(r.id, r.title) for r in shown.collect()] == [("http://a/", "A")] and total.first().totalResults == 3


def test_scores_without_value_come_last(spark):
    df = spark.createDataFrame([(0, None), (1, 0.5), (2, float("nan")), (3, 2.0), (4, 0.5)], "pos long, score double")
    assert [r.pos for r in df.orderBy(*ranking.by_score(F.col("score"), F.col("pos"))).collect()] == [3, 1, 4, 0, 2]


def plain_greedy(texts, most=9):
    kept = []
    for i, t in enumerate(texts):
        h = simhash_text(" " + t) % 2**64
        if all((h ^ k).bit_count() > most for _, k in kept):
            kept.append((i, h))
    return [i for i, _ in kept]


@pytest.mark.parametrize("block", [4096, 5])
def test_greedy_dedupe(spark, block, monkeypatch):
    monkeypatch.setattr(dedupe, "ROUND", block)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(0, 300))) for _ in range(120)]
    df = spark.createDataFrame([(i, f"http://x.org/{i}", "", t) for i, t in enumerate(texts)], "pos long, url string, title string, content string")
    assert sorted(r.pos for r in dedupe.dedupe_by_simhash(df).collect()) == plain_greedy(texts)
    twice = df.unionByName(df.withColumn("pos", F.col("pos") + 1000).withColumn("url", F.concat("url", F.lit("/#x"))))
    assert sorted(r.pos for r in dedupe.dedupe(twice).collect()) == plain_greedy(texts)


def graph_of(spark):
    rows = [(0, "rust async", 0, "https://tokio.rs/a", "Tokio"), (0, "rust async", 1, "mailto:x@y", "Mail"), (1, "rust", 0, "https://tokio.rs/a", "Other"), (1, "rust", 1, "no url", "None")]
    return graph.structural_graph(spark.createDataFrame(rows, "query_pos int, query string, pos long, url string, title string"))


def test_structural_graph_and_walks(spark):
    nodes, edges = graph_of(spark)
    keys = {r.key: (r.type, r.label, r["rank"]) for r in nodes.collect()}
    assert keys["r:https_tokio_rs_a"] == ("result", "Tokio", 1) and keys["q:rust"] == ("query", "rust", None)
    assert {"d:tokio_rs", "d:no_url", "r:mailto_x_y"} <= set(keys) and len(keys) == 7
    found = {(r.src, r.dst): (r.relation, r.weight) for r in edges.collect()}
    assert found["q:rust_async", "r:mailto_x_y"] == ("yields", 0.5) and found["r:https_tokio_rs_a", "d:tokio_rs"] == ("belongs_to", 1.0) and len(found) == 6
    again = graph.structural_graph(spark.createDataFrame([(0, "rust", 5, "https://tokio.rs/a", "New")], "query_pos int, query string, pos long, url string, title string"), nodes, edges)
    assert (again[0].count(), again[1].count()) == (7, 6)
    seeds = graph.resolve_seeds(nodes, ["q:rust", "TOK", "nothing"])
    assert sorted((r.seed, r.key) for r in seeds.collect()) == [("TOK", "d:tokio_rs"), ("TOK", "r:https_tokio_rs_a"), ("q:rust", "q:rust")]
    reach = lambda d: {r.key: r.level for r in graph.bfs_nodes(nodes, edges, seeds.where("seed = 'q:rust'"), d).collect()}
    assert reach(0) == {"q:rust": 0} and reach(1) == {"q:rust": 0, "r:https_tokio_rs_a": 1, "r:no_url": 1}
    assert set(reach(2)) < set(reach(None)) == set(keys)
    sub = graph.induced(nodes, edges, seeds)
    assert [(r.src, r.dst) for r in sub[1].collect()] in ([("q:rust", "r:https_tokio_rs_a"), ("r:https_tokio_rs_a", "d:tokio_rs")], [("r:https_tokio_rs_a", "d:tokio_rs"), ("q:rust", "r:https_tokio_rs_a")])


def test_graph_batches(spark):
    nodes, edges = graph.empty_graph(spark)
    entities = spark.createDataFrame([(0, None, "Tokio", "lib", None), (1, "e:tokio", "Tokio!", None, 0.5), (2, "", "async-std", None, None)], "pos long, id string, label string, entityType string, score double")
    results = spark.createDataFrame([(0, "http://a.org", "A", 5), (1, "http://a.org", "B", 2), (2, "http://a.org", "C", None)], "pos long, url string, title string, rank long")
    batch = spark.createDataFrame([(0, "e:tokio", "e:async_std", "like", None), (1, "e:tokio", "e:gone", "like", 1.0), (2, "e:tokio", "e:async_std", "beats", 0.7)], "pos long, src string, dst string, relation string, weight double")
    nodes, edges, skipped = graph.add_batch(nodes, edges, entities, results, batch)
    got = {r.key: r for r in nodes.collect()}
    assert (got["e:tokio"].label, got["e:tokio"].entityType, got["e:tokio"].score, got["e:tokio"].type) == ("Tokio!", "lib", 0.5, "entity")
    assert (got["r:http_a_org"].title, got["r:http_a_org"]["rank"]) == ("A", 2)
    assert [tuple(r) for r in edges.collect()] == [("e:tokio", "e:async_std", "beats", 0.7)]
    assert [tuple(r) for r in skipped.collect()] == [("e:tokio", "e:gone", "like")]
    nodes2, _, _ = graph.add_batch(nodes, edges, entities.limit(0), spark.createDataFrame([(0, "http://a.org", "Z", 9)], results.schema), batch.limit(0))
    assert {r.key: r["rank"] for r in nodes2.collect()}["r:http_a_org"] == 2
    delta = graph.graph_delta(graph.graph_stats(*graph.empty_graph(spark)), graph.graph_stats(nodes, edges)).first()
    assert tuple(delta) == (3, 1)


def test_sessions(spark):
    pool = spark.createDataFrame([("s", 0, "http://a.org/", "A", "")], ROW)
    batch = spark.createDataFrame([("s", 0, "http://A.org/#x", "dup", ""), ("s", 1, "http://b.org", "B", ""), ("s", 2, "http://b.org/", "dup", ""), ("t", 4, "http://a.org", "other", "")], ROW)
    after = session.append_results(pool, batch)
    assert sorted((r.session_id, r.pos, r.title) for r in after.collect()) == [("s", 0, "A"), ("s", 1, "B"), ("t", 0, "other")]
    assert session.append_results(after, batch).count() == 3
    assert {r.session_id: (r.added, r.total) for r in session.append_counts(pool, after).collect()} == {"s": (1, 2), "t": (1, 1)}
    pages = [(0, "http://b.org", "text", "", "me", None, 4, None), (1, "http://b.org/#y", "text 2", None, "", None, 0, ""), (2, "http://a.org", "no", "", "", "", 1, "failed")]
    merged = session.merge_content(after, spark.createDataFrame(pages, "pos long, url string, content string, excerpt string, byline string, siteName string, length long, error string"))
    assert {(r.session_id, r.pos): (r.title, r.content, r.byline, r.contentLength) for r in merged.collect()} == {("s", 0): ("A", "", None, None), ("s", 1): ("B", "text 2", "me", 4), ("t", 0): ("other", "", None, None)}


def test_extraction(spark):
    page = "<html><head><title> T </title><meta name=author content=Me></head><body><nav>menu, menu, menu, and more of the menu, long enough</nav><article>" + "".join(f"<p>Sentence {i}, which goes on, and on, for long enough.</p>" for i in range(6)) + "</article><div class=sidebar><p>Some other words, of no matter, here.</p></div></body></html>"
    rows = spark.createDataFrame([(0, "u", page), (1, "u", None), (2, "u", "<p>short"), (3, "u", "<div>" * 3000 + "x")], "pos long, url string, html string")
    got = {r.pos: r for r in extract.extract_pages(rows, ["pos", "url"]).collect()}
    assert got[0].title == "T" and got[0].byline == "Me" and got[0].error is None and "menu" not in got[0].content and "other" not in got[0].content and got[0].content.count("Sentence") == 6
    assert got[1].error == "empty page" and got[2].error == "article too short" and got[3].error
    assert tuple(extract.extraction_stats(extract.extract_pages(rows, ["pos", "url"])).first()) == (4, 1, 3)
    assert extract.succeeded(extract.extract_pages(rows, ["pos", "url"])).count() == 1
    with pytest.raises(ValueError, match="MISSING_INPUT"):
        extract.urls_of()
    with pytest.raises(ValueError, match="SESSION_EMPTY"):
        extract.urls_of(session=rows.limit(0))
    assert [r.url for r in extract.urls_of(urls=["a", "b"], session=rows).orderBy("pos").collect()] == ["a", "b"]


def test_excerpt_is_the_whole_first_paragraph():
    first, more = "A long line, of many words. " * 20, "Another line, of more words than that. " * 5
    page = f"<article><p>{first}</p><p>{more}</p></article>"
    assert extract.article_of(page)["excerpt"] == first.strip() and len(first) > 300
    assert extract.article_of('<meta name="description" content="Told.">' + page)["excerpt"] == "Told."


def test_rendering(spark):
    hits = spark.createDataFrame([(1, "B", "http://b", "text", "e", "c", None, 12.5), (0, "", "", "", "", "", "2020", 0.25)], "pos long, title string, url string, content string, engine string, category string, publishedDate string, score double")
    want = "## Search: q\n\n**2** results\n\n### 1. [No Title](#) [25.0]\n\nEngine: unknown · Published: 2020\n\n### 2. [B](http://b) [12.5]\n\ntext\n\nEngine: e · Category: c\n\n*Unresponsive: slow*\n\n**Suggestions:** x · y\n"
    assert render.markdown(hits, "q", ["x", "y"], ["slow"]).first().text == want
    assert render.markdown(hits.limit(0), "").first().text == "## Search: Unknown\n\nNo results found.\n"
    assert spark.range(1).select(render.error_envelope("X", "m", True).alias("j")).first().j == '{"status":"error","data":null,"error":{"code":"X","message":"m","retryable":true},"hint":null}'
    nodes, edges = graph_of(spark)
    text = render.graph_text(nodes, edges, graph.graph_stats(nodes, edges), ["q:rust"], 2).first().text
    assert text.startswith("Subgraph from seeds: q:rust (depth 2)\nNodes: 7 (0 entities, 3 results, 2 queries, 2 domains)\nEdges: 6\n\nRelationships:\n  [query] rust → (yields, weight=1.00) → [result] Tokio\n")
