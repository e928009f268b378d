"""Session tables in a folder: results, rounds, meta, graph nodes, edges and statistics by session.

Spark cannot overwrite what it reads, so a table's new version goes to its own
folder, and a small text file that names the version is written last. New results are
added to the version there is. Results are laid out by a hash of the session, as
sessions are many. Paths may be in any store that Spark reads.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from trawlix.operators import graph, session

TABLES = ("results", "rounds", "meta", "nodes", "edges", "stats")
#: Folders that a table of results is laid out in.
BUCKETS = 64
STATS_SCHEMA = "nodes long, edges long, entities long, results long, queries long, domains long"
_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")


def session_root(named: str, home: str) -> str:
    """Where a session of this name lies: a new one, a plain name under ``home``, or the path as it stands."""
    if named == "new":
        return f"{home.rstrip('/')}/s_{uuid.uuid4().hex[:12]}"
    if re.search(r"[/\\\\]", named):
        return named
    if not _NAME.match(named):
        raise ValueError(f"not a session name: {named}")
    return f"{home.rstrip('/')}/{named}"


class SessionStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self, table: str) -> str | None:
        pointer = f"{self.root}/{table}/current.txt"
        if not self._fs().exists(self._path(pointer)):
            return None
        return self.spark.read.text(pointer).first().value

    def read(self, table: str, schema: str) -> DataFrame:
        """The table, or an empty one if it was never written or its files are gone or broken."""
        version = self.version(table)
        try:
            if version is not None:
                return self.spark.read.parquet(f"{self.root}/{table}/{version}").drop("_bucket")
        except AnalysisException:
            pass
        return self.spark.createDataFrame([], schema)

    def _save(self, table: str, df: DataFrame, version: str, mode: str) -> None:
        if table not in TABLES:
            raise ValueError(f"no such table: {table}")
        if table == "results":
            bucket = F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int")
            df.withColumn("_bucket", bucket).write.mode(mode).partitionBy("_bucket").parquet(f"{self.root}/{table}/{version}")
        else:
            df.write.mode(mode).parquet(f"{self.root}/{table}/{version}")

    def write(self, table: str, df: DataFrame) -> None:
        """A new version; the version before stays until the next write, for readers under way."""
        before, version = self.version(table), uuid.uuid4().hex
        self._save(table, df, version, "errorifexists")
        fs, pointer = self._fs(), self._path(f"{self.root}/{table}/current.txt")
        out = fs.create(pointer, True)
        out.write(bytearray(version.encode()))
        out.close()
        for status in fs.listStatus(self._path(f"{self.root}/{table}")):
            name = status.getPath().getName()
            if name not in (version, before) and name != "current.txt" and not name.startswith((".", "_")):
                fs.delete(status.getPath(), True)

    def append(self, table: str, df: DataFrame) -> None:
        """Rows behind those of the table's version."""
        version = self.version(table)
        if version is None:
            self.write(table, df)
        else:
            self._save(table, df, version, "append")

    def rounds(self) -> DataFrame:
        """session_id and how many rounds it has had (0 where none are known)."""
        return self.read("rounds", "session_id string, rounds long").groupBy("session_id").agg(F.coalesce(F.max("rounds"), F.lit(0)).alias("rounds"))

    def add_round(self, batch: DataFrame) -> None:
        """A round of results (session_id, pos, url, ...): new ones are added, and each session of the batch counts a round."""
        self.append("results", session.added_results(self.read("results", batch.schema), batch))
        self.write("rounds", session.count_round(self.rounds(), batch))

    def merge(self, extracted: DataFrame, schema: str) -> None:
        """Extracted pages' texts in place of the results'; a session without a count of rounds gets one."""
        merged = session.merge_content(self.read("results", schema), extracted)
        self.write("results", merged)
        self.write("rounds", session.rounds_after_merge(self.rounds(), self.read("results", schema)))

    def upsert_meta(self, new: DataFrame, now_ms: Column) -> None:
        old = self.read("meta", "session_id string, owner string, description string, query string, createdAt long, updatedAt long")
        self.write("meta", session.upsert_meta(old, new, now_ms))

    def graph(self, name: str) -> tuple[DataFrame, DataFrame]:
        """The nodes and edges of a session."""
        found = []
        for table, schema in (("nodes", graph.NODE_SCHEMA), ("edges", graph.EDGE_SCHEMA)):
            found.append(self.read(table, f"session_id string, {schema}").where(F.col("session_id") == name).drop("session_id"))
        return found[0], found[1]

    def write_graph(self, name: str, nodes: DataFrame, edges: DataFrame) -> None:
        """A session's graph and its statistics in place of those it had."""
        stats = graph.graph_stats(nodes, edges)
        for table, df, schema in (("nodes", nodes, graph.NODE_SCHEMA), ("edges", edges, graph.EDGE_SCHEMA), ("stats", stats, STATS_SCHEMA)):
            others = self.read(table, f"session_id string, {schema}").where(F.col("session_id") != name)
            self.write(table, others.unionByName(df.withColumn("session_id", F.lit(name)), allowMissingColumns=True))

    def graph_add(self, name: str, entities: DataFrame, results: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Adds a batch to a session's graph: one row of nodesAdded and edgesAdded, and the edges that were skipped."""
        before = self.graph(name)
        nodes, new_edges, skipped = graph.add_batch(*before, entities, results, edges)
        delta = self.spark.createDataFrame(graph.graph_delta(graph.graph_stats(*before), graph.graph_stats(nodes, new_edges)).collect(), "nodesAdded long, edgesAdded long")
        skipped = self.spark.createDataFrame(skipped.collect(), "src string, dst string, relation string")  # rows of the user's own batch
        self.write_graph(name, nodes, new_edges)
        return delta, skipped

    def sessions(self) -> DataFrame:
        """All sessions as they are listed; order by session.newest_first."""
        meta = self.read("meta", "session_id string, owner string, description string, query string, createdAt long, updatedAt long")
        results, nodes, edges = (self.read(t, "session_id string").select("session_id") for t in ("results", "nodes", "edges"))
        every = meta.select("session_id").unionByName(results).unionByName(nodes)
        return session.list_sessions(every, meta, results, nodes, edges, self.rounds())

    def delete(self, names: list[str]) -> list[str]:
        """Drop the sessions of these names with all they have; a name that is no plain folder name is refused."""
        bad = [n for n in names if not _NAME.match(n)]
        if bad:
            raise ValueError(f"not session names: {bad}")
        for table in TABLES:
            df = self.read(table, "session_id string")
            if self.version(table) and "session_id" in df.columns:
                self.write(table, df.where(~F.col("session_id").isin(names)))
        return names

    def delete_older(self, hours: float, now_ms: Column) -> list[str]:
        """Drop the sessions not seen for so many hours; 0 drops none."""
        if not hours:
            return []
        gone = session.older_than(self.sessions().drop("seen"), hours, now_ms)
        return self.delete([r.session_id for r in gone.select("session_id").collect() if _NAME.match(r.session_id)])
