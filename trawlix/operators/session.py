"""Sessions: a pool of results that grows by rounds and never holds a URL twice.

Pool rows have session_id, pos and the result's columns; identity is the
normalised URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlix.functions.urls import normalize_url

from .ordering import prefix_sums, split_join

OPTIONAL = ["excerpt", "byline", "siteName"]


def _with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("_id", normalize_url(F.col("url")))


def new_results(pool: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch (session_id, pos, url, ...) whose URL the session does not have yet, the first of each.

    Places are chosen without the rows' texts; a pos stands once in a session's batch.
    """
    first = _with_id(batch.select("session_id", "pos", "url")).groupBy("session_id", "_id").agg(F.min("pos").alias("pos"))
    known = _with_id(pool.select("session_id", "url")).select("session_id", "_id").distinct()
    new = first.join(known, ["session_id", "_id"], "left_anti").select("session_id", "pos")
    return batch.join(new, ["session_id", "pos"], "left_semi").select(*batch.columns)


def added_results(pool: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's new rows with the positions they get behind the pool's."""
    ends = pool.groupBy("session_id").agg(F.max("pos").alias("_end"))
    ordered = prefix_sums(new_results(pool, batch), [F.col("pos")], {"_at": F.lit(1)}, group=[F.col("session_id")])
    placed = split_join(ordered, ends, ["session_id"], "left", F.col("pos"))
    return placed.withColumn("pos", F.coalesce(F.col("_end") + 1, F.lit(0)) + F.col("_at") - 1).select(*batch.columns)


def append_results(pool: DataFrame, batch: DataFrame) -> DataFrame:
    """The pool with the batch's new rows behind its own, positions counted on."""
    return pool.unionByName(added_results(pool, batch), allowMissingColumns=True)


def count_round(rounds: DataFrame, batch: DataFrame) -> DataFrame:
    """rounds (session_id, rounds) with one round more for each session of the batch, new rows or not."""
    more = batch.select("session_id").distinct().withColumn("_more", F.lit(1))
    return rounds.join(more, "session_id", "full").select("session_id", (F.coalesce("rounds", F.lit(0)) + F.coalesce("_more", F.lit(0))).cast("long").alias("rounds"))


def rounds_after_merge(rounds: DataFrame, pool: DataFrame) -> DataFrame:
    """rounds of the pool's sessions once content is merged: a session without a count gets its number of results."""
    sizes = pool.groupBy("session_id").agg(F.count("*").alias("_n"))
    return sizes.join(rounds, "session_id", "left").select("session_id", F.coalesce(F.nullif("rounds", F.lit(0)), "_n").cast("long").alias("rounds"))


def append_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per session: added and total."""
    old = before.groupBy("session_id").agg(F.count("*").alias("_old"))
    return after.groupBy("session_id").agg(F.count("*").alias("total")).join(old, "session_id", "left").select("session_id", (F.col("total") - F.coalesce("_old", F.lit(0))).alias("added"), "total")


def merge_content(pool: DataFrame, extracted: DataFrame) -> DataFrame:
    """The pool with content (and excerpt, byline, siteName, contentLength where given) of extracted pages.

    extracted: pos, url, content, excerpt, byline, siteName, length, error. Rows with an
    error are left out; the last row of a URL wins; of an optional text the last
    non-empty one; titles stay.
    """
    good = _with_id(extracted.where(F.coalesce("error", F.lit("")) == ""))
    last = lambda c, ok: F.max_by(c, F.when(ok, F.col("pos"))).alias(f"_{c}")
    found = good.groupBy("_id").agg(F.max_by("content", "pos").alias("_content"), *[last(c, F.coalesce(F.col(c), F.lit("")) != "") for c in OPTIONAL], last("length", F.coalesce(F.col("length"), F.lit(0)) != 0), F.lit(True).alias("_found"))
    held = pool
    for c, kind in ((*((c, "string") for c in OPTIONAL), ("contentLength", "long"))):
        held = held if c in held.columns else held.withColumn(c, F.lit(None).cast(kind))
    merged = _with_id(held).join(found, "_id", "left")
    changed = {"content": F.when(F.col("_found"), F.col("_content")).otherwise(F.col("content")), "contentLength": F.coalesce("_length", "contentLength")}
    changed |= {c: F.coalesce(f"_{c}", c) for c in OPTIONAL}
    return merged.withColumns(changed).select(*held.columns)


def upsert_meta(old: DataFrame, new: DataFrame, now_ms: Column) -> DataFrame:
    """Session metadata: new texts where given, else the old, else empty; createdAt is kept.

    Both: session_id, owner, description, query; old also createdAt, updatedAt (ms).
    """
    n = new.select("session_id", *[F.nullif(c, F.lit("")).alias(f"_{c}") for c in ("owner", "description", "query")], F.lit(True).alias("_new"))
    merged = old.join(n, "session_id", "full")
    texts = {c: F.coalesce(F.col(f"_{c}"), F.col(c), F.lit("")) for c in ("owner", "description", "query")}
    times = {"createdAt": F.coalesce("createdAt", now_ms), "updatedAt": F.when(F.col("_new"), now_ms).otherwise(F.col("updatedAt"))}
    return merged.withColumns(texts | times).select("session_id", "owner", "description", "query", "createdAt", "updatedAt")


def list_sessions(sessions: DataFrame, meta: DataFrame, results: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, rounds: DataFrame | None = None) -> DataFrame:
    """Per session: owner, description, query, createdAt, updatedAt, rounds, results, nodes, edges and ``seen``, by which ``newest_first`` orders."""
    out = sessions.select("session_id").distinct().join(meta, "session_id", "left")
    for df, name in ((results, "results"), (nodes, "nodes"), (edges, "edges")):
        out = out.withColumn(name, F.lit(0)) if df is None else out.join(df.groupBy("session_id").agg(F.count("*").alias(name)), "session_id", "left")
    out = out.withColumn("rounds", F.lit(0)) if rounds is None else out.join(rounds.select("session_id", "rounds"), "session_id", "left")
    return shown_sessions(out)


def shown_sessions(found: DataFrame) -> DataFrame:
    """Sessions with empty texts and zeros for what is not known, and when each was last seen."""
    texts = {c: F.coalesce(c, F.lit("")) for c in ("owner", "description", "query")}
    numbers = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("createdAt", "updatedAt", "rounds", "results", "nodes", "edges")}
    return found.withColumns(texts | numbers).select("session_id", *texts, *numbers, _seen(found).alias("seen"))


def _seen(df: DataFrame) -> Column:
    """When a session was updated, else created, else 0."""
    created = [F.nullif("createdAt", F.lit(0))] if "createdAt" in df.columns else []
    return F.coalesce(F.nullif("updatedAt", F.lit(0)), *created, F.lit(0))


def newest_first() -> list[Column]:
    return [F.col("seen").desc(), F.col("session_id").asc()]


def older_than(meta: DataFrame, hours: float, now_ms: Column) -> DataFrame:
    """Sessions last updated, or else created, more than ``hours`` ago; those without a time stay."""
    seen = _seen(meta)
    return meta.where((seen > 0) & (now_ms - seen > hours * 3_600_000))


def without(sessions: DataFrame, gone: DataFrame) -> DataFrame:
    return sessions.join(gone.select("session_id").distinct(), "session_id", "left_anti")
