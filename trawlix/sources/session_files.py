"""A folder of sessions, each a folder of its own with results.json, meta.json and graph.json."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from trawlix.operators.session import shown_sessions

META = "struct<owner:string,description:string,query:string,createdAt:bigint,updatedAt:bigint>"
RESULTS = "struct<status:string,data:struct<rounds:bigint,results:array<struct<url:string>>>>"
GRAPH = "struct<status:string,data:struct<stats:struct<nodes:bigint,edges:bigint>>>"


def sessions_of(files: DataFrame) -> DataFrame:
    """Sessions as they are listed, of files given as path (``.../<session>/<name>.json``) and value (their text).

    A file that is missing, broken or not of status ``ok`` counts as empty.
    """
    folder = lambda depth: F.get(F.split("path", "/"), F.size(F.split("path", "/")) - depth)
    of = lambda name, schema: F.max(F.when(F.col("_name") == f"{name}.json", F.from_json("value", schema))).alias(name)
    named = files.select(folder(2).alias("session_id"), folder(1).alias("_name"), "value")
    read = named.groupBy("session_id").agg(of("meta", META), of("results", RESULTS), of("graph", GRAPH))
    good = lambda name, value: F.when(F.col(f"{name}.status") == "ok", value)
    counts: dict[str, Column] = {
        "rounds": good("results", F.col("results.data.rounds")), "results": good("results", F.coalesce(F.size("results.data.results"), F.lit(0))),
        "nodes": good("graph", F.col("graph.data.stats.nodes")), "edges": good("graph", F.col("graph.data.stats.edges")),
    }
    return shown_sessions(read.select("session_id", "meta.*", *[c.alias(n) for n, c in counts.items()]))


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    """The sessions under ``root``, also those without files; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()] if fs.exists(where) and fs.getFileStatus(where).isDirectory() else []
    files = spark.createDataFrame([(f"{root.rstrip('/')}/{n}/", None) for n in names], "path string, value string")
    if names:
        try:
            texts = spark.read.text(f"{root.rstrip('/')}/*/*.json", wholetext=True)
            files = files.unionByName(texts.select(F.col("_metadata.file_path").alias("path"), "value"))
        except AnalysisException:  # no session has a file
            pass
    return sessions_of(files)
