"""The directed graph of queries, results, domains and entities as two DataFrames.

nodes: key, type, label, entityType, score, url, rank, title, query, round, domain and
pos, by which they were added: the number of the change, then the order within it.
edges: src, dst, relation, weight; one per (src, dst).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlix.functions.ids import node_id
from trawlix.functions.urls import extract_domain

from .ordering import cut

NODE_SCHEMA = "key string, type string, label string, entityType string, score double, url string, rank long, title string, query string, round long, domain string, pos struct<batch:bigint,query:bigint,place:bigint,step:int>"
EDGE_SCHEMA = "src string, dst string, relation string, weight double"
#: Levels of a walk that are kept apart.
GATHER = 24
_NODE = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
_KIND = dict(x.split() for x in NODE_SCHEMA.split(", "))


def empty_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA)


def _node(**columns: Column) -> Column:
    return F.struct(*[(columns[c] if c in columns else F.lit(None)).cast(_KIND[c]).alias(c) for c in _NODE])


def _pos(query: Column | int, place: Column | int, step: int) -> Column:
    number = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    return F.struct(F.lit(0).cast("long").alias("batch"), number(query).alias("query"), number(place).alias("place"), F.lit(step).alias("step"))


def _behind(new: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """The new nodes as one change more than the nodes have had."""
    if nodes is None or "pos" not in nodes.columns:
        return new
    done = nodes.agg(F.coalesce(F.max("pos.batch") + 1, F.lit(0)).alias("_batch"))  # one row
    return new.join(F.broadcast(done)).withColumn("pos", F.col("pos").withField("batch", F.col("_batch"))).drop("_batch")


def structural_graph(results: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of queries with their results, added to a graph where they are new.

    results: query_pos (a number), query, pos (from 0 per query), url, title and optionally
    rank and round. The first row of a key or of a pair wins, in order of (query_pos, pos).
    """
    has = lambda c: F.col(c) if c in results.columns else F.lit(None)
    domain = extract_domain(F.col("url"))
    q, r, d = node_id("query", F.col("query")), node_id("result", F.col("url")), node_id("domain", domain)
    made = F.array(
        F.struct(F.lit(0).alias("at"), _node(key=q, type=F.lit("query"), label=F.col("query"), query=F.col("query"), round=has("round"), pos=_pos(F.col("query_pos"), F.col("pos"), 0)).alias("node")),
        F.struct(F.lit(1).alias("at"), _node(key=r, type=F.lit("result"), label=F.col("title"), url=F.col("url"), title=F.col("title"), rank=F.coalesce(has("rank"), F.col("pos") + 1), pos=_pos(F.col("query_pos"), F.col("pos"), 1)).alias("node")),
        F.struct(F.lit(2).alias("at"), _node(key=F.when(domain != "", d), type=F.lit("domain"), label=domain, domain=domain, pos=_pos(F.col("query_pos"), F.col("pos"), 2)).alias("node")),
    )
    order = F.struct("query_pos", "pos", "at")
    found = results.select("query_pos", "pos", F.inline(made)).where("node.key is not null")
    new_nodes = found.groupBy("node.key").agg(F.min_by("node", order).alias("node")).select("node.*")
    linked = F.array(
        F.struct(q.alias("src"), r.alias("dst"), F.lit("yields").alias("relation"), (F.lit(1.0) / (F.col("pos") + 1)).alias("weight")),
        F.struct(r.alias("src"), F.when(domain != "", d).alias("dst"), F.lit("belongs_to").alias("relation"), F.lit(1.0).alias("weight")),
    )
    pairs = results.select("query_pos", "pos", F.inline(linked)).where("src is not null and dst is not null")
    new_edges = pairs.groupBy("src", "dst").agg(F.min_by(F.struct("relation", "weight"), F.struct("query_pos", "pos")).alias("e")).select("src", "dst", "e.*")
    if nodes is not None:
        new_nodes = nodes.unionByName(_behind(new_nodes.join(nodes, "key", "left_anti"), nodes), allowMissingColumns=True)
    if edges is not None:
        new_edges = edges.unionByName(new_edges.join(edges, ["src", "dst"], "left_anti"))
    return new_nodes, new_edges


def append_result_nodes(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """The nodes and, where new, a result node per row of results (pos, url, title): no edges, the first row of a key wins."""
    made = results.select(F.col("pos").alias("_pos"), _node(key=node_id("result", F.col("url")), type=F.lit("result"), label=F.col("title"), url=F.col("url"), title=F.col("title"), rank=F.col("pos") + 1, pos=_pos(0, F.col("pos"), 1)).alias("node"))
    first = made.groupBy("node.key").agg(F.min_by("node", "_pos").alias("node")).select("node.*")
    return nodes.unionByName(_behind(first.join(nodes, "key", "left_anti"), nodes), allowMissingColumns=True)


def in_order(nodes: DataFrame) -> list[Column]:
    """The order in which nodes were added."""
    return [*([F.col("pos").asc_nulls_first()] if "pos" in nodes.columns else []), F.col("key").asc()]


def seed_hint(nodes: DataFrame, n: int = 10) -> DataFrame:
    """The first n keys that were added, to show where no seed was found."""
    return nodes.orderBy(*in_order(nodes)).limit(n).select("key")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, entities, results, queries, domains."""
    kinds = {"entities": "entity", "results": "result", "queries": "query", "domains": "domain"}
    counted = nodes.agg(F.count("*").alias("nodes"), *[F.count_if(F.col("type") == t).alias(n) for n, t in kinds.items()])
    return counted.join(edges.agg(F.count("*").alias("edges"))).select("nodes", "edges", *kinds)


def graph_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """nodesAdded and edgesAdded between two graph_stats rows."""
    b = before.select(F.col("nodes").alias("_n"), F.col("edges").alias("_e"))
    return after.join(b).select((F.col("nodes") - F.col("_n")).alias("nodesAdded"), (F.col("edges") - F.col("_e")).alias("edgesAdded"))


def resolve_seeds(nodes: DataFrame, seeds: list[str]) -> DataFrame:
    """(seed, key): the node of that key, else nodes whose key starts with the seed or whose label has it.

    Seeds are a handful of texts that a user names, so they are broadcast to the nodes.
    """
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "seed string")
    exact = wanted.join(nodes.select("key"), F.col("seed") == F.col("key"), "inner").select("seed", "key")
    fuzzy = wanted.join(exact.select("seed").distinct(), "seed", "left_anti")
    low = F.lower("seed")
    fits = F.lower("key").startswith(low) | F.coalesce(F.contains(F.lower("label"), low), F.lit(False))
    return exact.unionByName(nodes.select("key", "label").join(F.broadcast(fuzzy), fits).select("seed", "key"))


def bfs_nodes(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int | None = 2) -> DataFrame:
    """key and level of the nodes within ``depth`` steps of a seed (column key), in either direction.

    One join per level on the new nodes only; None walks until nothing new is found.
    """
    around = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    front = cut(nodes.join(seeds.select("key").distinct(), "key", "left_semi").select("key", F.lit(0).alias("level")))
    levels, level = [front], 0  # each new key is written once; many levels are gathered
    while depth is None or level < depth:
        level += 1
        reached = around.join(front, around.src == front.key, "left_semi").select(F.col("dst").alias("key")).distinct()
        front = cut(reached.join(reduce(DataFrame.unionByName, levels), "key", "left_anti").select("key", F.lit(level).alias("level")))
        if front.isEmpty():
            break
        levels.append(front)
        if len(levels) > GATHER:
            levels = [cut(reduce(DataFrame.unionByName, levels))]
    return reduce(DataFrame.unionByName, levels)


def induced(nodes: DataFrame, edges: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of these keys and the edges with both ends among them."""
    k = keys.select("key").distinct()
    kept = edges.join(k.withColumnRenamed("key", "src"), "src", "left_semi").join(k.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return nodes.join(k, "key", "left_semi"), kept.select("src", "dst", "relation", "weight")


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: list[str], depth: int | None = 2) -> tuple[DataFrame, DataFrame]:
    return induced(nodes, edges, bfs_nodes(nodes, edges, resolve_seeds(nodes, seeds), depth))


def _wide(nodes: DataFrame) -> DataFrame:
    """The nodes with every column of NODE_SCHEMA."""
    return nodes.withColumns({c: F.lit(None).cast(_KIND[c]) for c in _NODE if c not in nodes.columns})


def upsert_entities(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """entities: pos, id, label, entityType, score. The last label stays, the last non-null type and score."""
    keyed = entities.withColumn("key", F.coalesce(F.nullif("id", F.lit("")), node_id("entity", F.col("label"))))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    new = keyed.groupBy("key").agg(F.max_by("label", "pos").alias("label"), last("entityType"), last("score"), F.min("pos").alias("_first"))
    renamed = new.select("key", F.col("label").alias("_label"), F.col("entityType").alias("_entityType"), F.col("score").alias("_score"), F.lit(True).alias("_new"), _pos(0, F.col("_first"), 0).alias("pos"))
    merged = _wide(nodes).join(_behind(renamed, nodes).withColumnRenamed("pos", "_pos"), "key", "full")
    return merged.withColumns({
        "label": F.when(F.col("_new"), F.col("_label")).otherwise(F.col("label")), "entityType": F.coalesce("_entityType", "entityType"), "score": F.coalesce("_score", "score"), "type": F.coalesce("type", F.lit("entity")), "pos": F.coalesce("pos", "_pos"),
    }).select(*_NODE)


def upsert_results(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """results: pos, url, title, rank. New nodes come from the first row, ranks only improve."""
    keyed = results.withColumn("key", node_id("result", F.col("url")))
    new = keyed.groupBy("key").agg(F.min_by(F.struct("url", "title"), "pos").alias("first"), F.min("rank").alias("_rank"), _pos(0, F.min("pos"), 1).alias("pos"))
    merged = _wide(nodes).join(_behind(new, nodes).withColumnRenamed("pos", "_pos"), "key", "full")
    fresh = F.col("type").isNull()
    return merged.withColumns({
        "label": F.when(fresh, F.col("first.title")).otherwise(F.col("label")), "url": F.when(fresh, F.col("first.url")).otherwise(F.col("url")), "title": F.when(fresh, F.col("first.title")).otherwise(F.col("title")),
        "rank": F.least("rank", "_rank"), "type": F.coalesce("type", F.lit("result")), "pos": F.coalesce("pos", "_pos"),
    }).select(*_NODE)


def split_edges(nodes: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the batch (pos, src, dst, relation, weight) with both ends known, and the others."""
    keys = nodes.select("key").distinct()
    known = batch.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return known, batch.join(known.select("pos"), "pos", "left_anti").select("src", "dst", "relation")


def upsert_edges(edges: DataFrame, known: DataFrame) -> DataFrame:
    """The last row of a pair replaces what was there; a weight left out is 1."""
    last = known.groupBy("src", "dst").agg(F.max_by(F.struct("relation", F.coalesce("weight", F.lit(1.0)).alias("weight")), "pos").alias("e")).select("src", "dst", "e.*")
    return edges.join(last, ["src", "dst"], "left_anti").unionByName(last)


def add_batch(nodes: DataFrame, edges: DataFrame, entities: DataFrame, results: DataFrame, batch_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, then results, then edges: the new nodes, edges and the skipped edges."""
    nodes = upsert_results(upsert_entities(nodes, entities), results)
    known, skipped = split_edges(nodes, batch_edges)
    return nodes, upsert_edges(edges, known), skipped


def labelled_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the labels and types of their ends; unknown ends are shown by key."""
    end = lambda side: nodes.select(F.col("key").alias(side), F.col("label").alias(f"{side}_label"), F.col("type").alias(f"{side}_type"))
    out = edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    shown = {f"{s}_label": F.coalesce(F.nullif(f"{s}_label", F.lit("")), s) for s in ("src", "dst")} | {f"{s}_type": F.coalesce(f"{s}_type", F.lit("?")) for s in ("src", "dst")}
    return out.withColumns(shown).select("src", "src_label", "src_type", "relation", "weight", "dst", "dst_label", "dst_type")
