"""Ranked lists: scores, limits, reciprocal rank fusion and what is shown of it.

Ranked lists are rows of (list_id, pos, id, ...), pos from 0 in each list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import with_positions

#: Fixed value: the fusion constant.
RRF_K = 60


def clean_hits(raw: DataFrame) -> DataFrame:
    """Raw hits with defaults; an empty text is as good as none."""
    text = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    has = lambda n, kind: F.col(n) if n in raw.columns else F.lit(None).cast(kind)
    snippet = ["content", *(["snippet"] if "snippet" in raw.columns else [])]
    shown = {
        "title": F.coalesce(text("title"), F.lit("")), "url": F.coalesce(text("url"), F.lit("")), "content": F.coalesce(text(*snippet), F.lit("")),
        "engine": F.coalesce(text("engine"), F.lit("unknown")), "category": F.coalesce(text("category"), F.lit("general")),
        "publishedDate": has("publishedDate", "string"), "thumbnail": has("thumbnail", "string"), "score": has("score", "double"),
    }
    return raw.withColumns(shown).drop("snippet")


def by_score(score: Column, pos: Column) -> list[Column]:
    """Order by score, highest first, rows without one last, ties by pos."""
    return [F.when(F.isnan(score), F.lit(None)).otherwise(score).desc_nulls_last(), pos.asc()]


def limit_lists(lists: DataFrame, n: int) -> DataFrame:
    """At most n entries of each list, by pos; n of 0 or less keeps all."""
    return lists.where(F.col("pos") < n) if n > 0 else lists


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def fuse(lists: DataFrame, k: float = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: id, score, first_list, first_pos, n_entries.

    Each entry adds 1 / (k + pos + 1), also where an id stands twice in a list.
    Entries without an id keep their place in the list and add nothing.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    known = lists.where(F.col("id").isNotNull() & (F.col("id") != ""))
    first = F.min(F.struct("list_id", "pos"))
    grouped = known.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("pos") + 1)).alias("score"), first.alias("first"), F.count("*").alias("n_entries"))
    return grouped.select("id", "score", F.col("first.list_id").alias("first_list"), F.col("first.pos").alias("first_pos"), "n_entries")


def fused_order() -> list[Column]:
    return [F.col("score").desc(), F.col("first_list").asc(), F.col("first_pos").asc()]


def pick_hits(fused: DataFrame, hits: DataFrame, last: bool = False) -> DataFrame:
    """Each fused id with its original hit, the fused score in place of the hit's own.

    hits: list_id, pos, id and the hit's columns. The first hit of an id is shown, or
    with ``last`` the last one.
    """
    columns = [c for c in hits.columns if c not in ("list_id", "pos", "id", "score")]
    pick = F.max_by if last else F.min_by
    one = hits.groupBy("id").agg(pick(F.struct(*columns), F.struct("list_id", "pos")).alias("hit"))
    return fused.join(one, "id").select("id", *[F.col(f"hit.{c}") for c in columns], "score", "first_list", "first_pos")


def ordered_distinct(values: DataFrame, value: str = "value", order: list[str] | None = None) -> DataFrame:
    """Distinct values with ``first``, the place of their first occurrence."""
    return values.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*(order or ["pos"]))).alias("first"))


def unknown_engines(asked: list[str], engines: DataFrame) -> DataFrame:
    """Asked-for engines that are not enabled; none are if none were asked for."""
    spark = engines.sparkSession
    wanted = spark.createDataFrame([(e,) for e in asked], "name string")
    return wanted.join(enabled_engines(engines), "name", "left_anti")


def require_allowed(asked: list[str], allowed: list[str]) -> None:
    """Refuses engines that are not on the list of allowed ones; an empty list allows all."""
    wrong = [e for e in asked if e not in allowed] if allowed else []
    if wrong:
        raise ValueError(f"INVALID_ENGINES: {', '.join(wrong)}")


def refused(asked: DataFrame, allowed: DataFrame) -> DataFrame:
    """The names asked for (column name) that are not allowed; none is refused if nothing is on the list of allowed ones."""
    some = allowed.where("name is not null").agg((F.count("*") > 0).alias("_some"))
    return asked.select("name").distinct().join(allowed.select("name"), "name", "left_anti").join(F.broadcast(some)).where("_some").select("name")


def enabled_engines(engines: DataFrame) -> DataFrame:
    return engines.where("enabled").select("name")


def category_names(categories: DataFrame, column: str = "category") -> DataFrame:
    """Categories given as a text or as a JSON object with a name; empty ones go."""
    name = F.coalesce(F.get_json_object(column, "$.name"), F.when(~F.col(column).startswith("{"), F.col(column)))
    return categories.select(name.alias("name")).where("name is not null and name <> ''")


#: Time ranges that a search may name, in days (our filter's meaning of them).
TIME_RANGES = {"day": 1, "week": 7, "month": 30, "year": 365}


def within(df: DataFrame, column: str, time_range: str | None, now: Column) -> DataFrame:
    """Rows of the time range before ``now``; an unknown range, or ``all``, keeps every row."""
    days = TIME_RANGES.get(time_range or "")
    return df if days is None else df.where((F.col(column) > now - F.make_dt_interval(F.lit(days))) & (F.col(column) <= now))


def matching(hits: DataFrame, engines: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    for column, wanted in (("engine", engines), ("category", categories)):
        hits = hits.where(F.col(column).isin(wanted)) if wanted else hits
    return hits


def list_positions(rows: DataFrame, list_col: str, order: list[Column]) -> DataFrame:
    """list_id and pos (from 0 in each list); a list of any length is split over tasks. ``order`` must sort ascending, nulls first."""
    return with_positions(rows, order, group=[F.col(list_col)]).withColumnRenamed(list_col, "list_id")


#: Parts of a response that are merged as ordered distinct texts, and those of them that history adds to.
PARTS, OF_HISTORY = ("suggestions", "answers", "unresponsive"), ("suggestions", "answers")


def response_parts(responses: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """kind, value and ``first`` (list_id, pos) of the suggestions, answers and unresponsive engines of searches.

    responses: list_id, suggestions, answers (arrays of texts) and unresponsiveEngines (an
    array of [name, reason]); history counts as the last list and tells of no engines.
    """
    from .render import first_name

    names = F.transform("unresponsiveEngines", first_name)
    parts = [responses.select("list_id", F.lit(kind).alias("kind"), (names if kind == "unresponsive" else F.col(kind)).alias("values")) for kind in PARTS]
    if history is not None:
        parts += [history.select(F.lit(2**31 - 1).alias("list_id"), F.lit(kind).alias("kind"), F.col(kind).alias("values")) for kind in OF_HISTORY]
    found = reduce(DataFrame.unionByName, parts).select("list_id", "kind", F.posexplode("values").alias("pos", "value")).where("value is not null")
    return found.groupBy("kind", "value").agg(F.min(F.struct("list_id", "pos")).alias("first"))


def explode_responses(responses: DataFrame) -> DataFrame:
    """Hits (list_id, query, pos, ...) of search responses: list_id, query, results array; see response_parts for the rest."""
    return responses.select("list_id", "query", F.posexplode("results").alias("pos", "hit")).select("list_id", "query", "pos", "hit.*")


def merge_searches(hits: DataFrame, history: DataFrame | None = None, per_list: int = 0, limit: int = 10, k: float = RRF_K) -> tuple[DataFrame, DataFrame]:
    """The fused page of several searches, and one row with totalResults.

    hits: list_id, pos, url and the hit's columns; history: pos, url, ..., which
    counts as the last list. Lists are cut before they are fused, the page after.
    totalResults counts every hit that took part, before URLs are made distinct.
    """
    from trawlix.functions.urls import normalize_url

    lists = limit_lists(hits, per_list)
    if history is not None:
        lists = lists.unionByName(history.withColumn("list_id", F.lit(2**31 - 1)), allowMissingColumns=True)
    keyed = lists.withColumn("id", normalize_url(F.col("url")))
    shown = pick_hits(fuse(keyed, k), keyed.where("id <> ''"))
    ordered = shown.orderBy(*fused_order())
    return (ordered.limit(limit) if limit > 0 else ordered), lists.agg(F.count("*").alias("totalResults"))
