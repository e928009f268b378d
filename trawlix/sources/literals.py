"""Values that a user writes out, and files of search results and graphs."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

HIT = "struct<title:string,url:string,content:string,engine:string,category:string,publishedDate:string,thumbnail:string,score:double>"
BATCH = "struct<entities:array<struct<label:string,entityType:string,score:double,id:string>>,results:array<struct<url:string,title:string,rank:bigint>>,edges:array<struct<source:string,target:string,relation:string,weight:double>>>"
NODE = "struct<key:string,attributes:struct<type:string,label:string,entityType:string,score:double,url:string,rank:bigint,title:string,query:string,round:bigint,domain:string>>"
EDGE = "struct<source:string,target:string,attributes:struct<relation:string,weight:double>>"


def split_literals(text: Column) -> Column:
    """A comma-separated text as an array of trimmed, non-empty texts."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def inline_batch(data: DataFrame, column: str = "data") -> dict[str, DataFrame]:
    """entities, results and edges of graph batches given as JSON, each with pos."""
    parsed = data.select(F.from_json(column, BATCH).alias("b"))
    out = {k: parsed.select(F.posexplode(f"b.{k}").alias("pos", "x")).select("pos", "x.*") for k in ("entities", "results", "edges")}
    out["edges"] = out["edges"].withColumnsRenamed({"source": "src", "target": "dst"})
    return out


def results_of(texts: DataFrame, column: str = "value") -> DataFrame:
    """Hits (pos, ...) of results files, enveloped ({data: {results}}) or bare ({results}); those without a url go."""
    enveloped, bare = F.from_json(column, f"struct<data:struct<results:array<{HIT}>>>")["data"]["results"], F.from_json(column, f"struct<results:array<{HIT}>>")["results"]
    return texts.select(F.posexplode(F.coalesce(enveloped, bare)).alias("pos", "hit")).select("pos", "hit.*").where("url is not null and url <> ''")


def is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def read_results_file(spark: SparkSession, path: str, code: str = "MERGE_FILE_FAILED") -> DataFrame:
    """The hits of a results file; one that is missing or no JSON object is an error of this code."""
    try:
        texts = spark.read.text(path, wholetext=True)
        read = texts.agg(F.count("*").alias("files"), F.count_if(is_object(F.col("value"))).alias("good")).first()
        if read.good < max(1, read.files):
            raise ValueError(code)
    except AnalysisException as e:
        raise ValueError(code) from e
    return results_of(texts)


def read_urls_file(spark: SparkSession, path: str) -> DataFrame:
    """The hits of the results file whose pages are to be extracted."""
    return read_results_file(spark, path, "FILE_READ_FAILED")


def graph_file(spark: SparkSession, named: str, home: str) -> str:
    """Where a graph lies: a bare name is a session under ``home``, and a folder holds ``graph.json``."""
    path = named if re.search(r"[/\\\\]", named) else f"{home.rstrip('/')}/{named}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{path.rstrip('/')}/graph.json" if fs.exists(where) and fs.getFileStatus(where).isDirectory() else path


def read_graph_file(spark: SparkSession, named: str, home: str = ".", mode: str = "error") -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a graph by path or session name; mode ``empty`` reads a missing or broken one as an empty graph."""
    try:
        texts = spark.read.text(graph_file(spark, named, home), wholetext=True)
    except AnalysisException as e:
        if mode == "error":
            raise ValueError("GRAPH_READ_FAILED") from e
        texts = spark.createDataFrame([], "value string")
    return graph_of(texts, mode)


def graph_of(texts: DataFrame, mode: str = "error", column: str = "value") -> tuple[DataFrame, DataFrame]:
    """nodes (with their order as pos) and edges of graph files, enveloped or bare. mode ``empty`` reads a broken file as an empty graph."""
    graph = f"struct<nodes:array<{NODE}>,edges:array<{EDGE}>>"
    found = texts.select(F.coalesce(F.from_json(column, f"struct<data:struct<graph:{graph}>>")["data"]["graph"], F.when(F.get_json_object(column, "$.nodes").isNotNull(), F.from_json(column, graph))).alias("g"))
    if mode == "error" and not found.where("g is null").isEmpty():
        raise ValueError("GRAPH_READ_FAILED")
    zero = F.lit(0).cast("long")
    pos = F.struct(zero.alias("batch"), zero.alias("query"), F.col("at").cast("long").alias("place"), F.lit(0).alias("step")).alias("pos")
    nodes = found.select(F.posexplode("g.nodes").alias("at", "n")).select("n.key", "n.attributes.*", pos)
    return nodes, found.select(F.explode("g.edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.attributes.*")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, value: the graph as its file holds it, nodes as they were added (a file is read whole, so it is small)."""
    attributes = [c for c in nodes.columns if c not in ("key", "pos")]
    node = F.struct("key", F.struct(*attributes).alias("attributes")).alias("node")
    listed = nodes.select(F.struct(*[c for c in ("pos",) if c in nodes.columns], "key", node).alias("x"))
    n = listed.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["node"]).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.struct("relation", "weight").alias("attributes")))).alias("edges"))
    return n.join(e).select(F.to_json(F.struct(F.lit("ok").alias("status"), F.struct(F.struct("nodes", "edges").alias("graph")).alias("data"))).alias("value"))


@dataclass
class Config:
    """Settings; each comes from the environment, else a local file, else a global file, else the default."""

    base_url: str = "http://localhost:8080"
    default_engine: str = ""
    allowed_engines: list[str] = field(default_factory=list)
    default_limit: int = 10
    timeout_ms: int = 10_000
    output_format: str = "json"
    use_proxy: bool = False
    proxy_url: str = ""

    @classmethod
    def load(cls, local: str | None = None, shared: str | None = None, env: dict | None = None, prefix: str = "TRAWLIX_") -> Config:
        env, layers = os.environ if env is None else env, []
        for path in (shared, local):
            if path and os.path.exists(path):
                with open(path) as f:
                    layers.append(json.load(f))
        out = cls()
        for layer in [*layers, {k[len(prefix) :].lower(): v for k, v in env.items() if k.startswith(prefix)}]:
            for name, value in layer.items():
                if hasattr(out, name):
                    kind = type(getattr(out, name))
                    text = isinstance(value, str)
                    value = [x.strip() for x in value.split(",") if x.strip()] if kind is list and text else value in ("true", "1") if kind is bool and text else kind(value)
                    setattr(out, name, value)
        if out.output_format not in ("json", "md"):
            raise ValueError("output_format must be json or md")
        return out
