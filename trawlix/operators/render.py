"""Envelopes and texts that are shown: one row each, made of ordered arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def success_envelope(data: Column, hint: Column | None = None) -> Column:
    """JSON with status, data, error and hint; the last three are written even if null."""
    shown = F.struct(F.lit("ok").alias("status"), data.alias("data"), F.lit(None).cast("string").alias("error"), (F.lit(None).cast("string") if hint is None else hint).alias("hint"))
    return F.to_json(shown, {"ignoreNullFields": "false"})


def error_envelope(code: str | Column, message: str | Column, retryable: bool = False, hint: str | None = None, details: Column | None = None) -> Column:
    """JSON of an error; ``details`` is a struct or map, written only where it is given."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    more = [] if details is None else [details.alias("details")]
    error = F.struct(text(code).alias("code"), text(message).alias("message"), F.lit(retryable).alias("retryable"), *more)
    shown = F.struct(F.lit("error").alias("status"), F.lit(None).cast("string").alias("data"), error.alias("error"), F.lit(hint).cast("string").alias("hint"))
    return F.to_json(shown, {"ignoreNullFields": "false"})


def display_score(score: Column) -> Column:
    """A score over 1 as it is, others times 100, with one decimal."""
    return F.format_string("%.1f", F.when(score > 1, score).otherwise(score * 100))


def first_name(item: Column) -> Column:
    """The name of an unresponsive engine given as [name, reason]."""
    return F.get(item, F.lit(0))


def _filled(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def markdown(hits: DataFrame, query: str, suggestions: list[str] = (), unresponsive: list[str] = ()) -> DataFrame:
    """One row, text: the page of results in ``pos`` order (a page is what a reader sees, so it is small)."""
    dot = F.lit(" · ")
    score = F.when(F.col("score").isNotNull(), F.concat(F.lit(" ["), display_score(F.col("score")), F.lit("]"))).otherwise(F.lit(""))
    head = F.concat(F.lit("["), _filled(F.col("title"), "No Title"), F.lit("]("), _filled(F.col("url"), "#"), F.lit(")"), score)
    body = F.when(_filled(F.col("content"), "") != "", F.concat("content", F.lit("\n\n"))).otherwise(F.lit(""))
    category = F.when(_filled(F.col("category"), "") != "", F.concat(dot, F.lit("Category: "), "category")).otherwise(F.lit(""))
    published = F.when(_filled(F.col("publishedDate"), "") != "", F.concat(dot, F.lit("Published: "), "publishedDate")).otherwise(F.lit(""))
    meta = F.concat(F.lit("Engine: "), _filled(F.col("engine"), "unknown"), category, published)
    entry = F.struct("pos", F.concat(head, F.lit("\n\n"), body, meta, F.lit("\n")).alias("text"))
    listed = hits.agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    entries = F.array_join(F.transform("entries", lambda x, i: F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". "), x["text"])), "\n")
    results = F.when(F.size("entries") > 0, F.concat(F.lit("**"), F.size("entries").cast("string"), F.lit("** results\n\n"), entries, F.lit("\n"))).otherwise(F.lit("No results found.\n\n"))
    tail = (f"*Unresponsive: {', '.join(unresponsive)}*\n\n" if unresponsive else "") + (f"**Suggestions:** {' · '.join(suggestions)}\n\n" if suggestions else "")
    whole = F.concat(F.lit(f"## Search: {query or 'Unknown'}\n\n"), results, F.lit(tail))
    # Lines are joined by \n, so the last of them has none.
    return listed.select(whole.alias("t")).select(F.expr("substring(t, 1, length(t) - 1)").alias("text"))


def edge_line() -> Column:
    """A labelled edge as text."""
    return F.format_string("  [%s] %s → (%s, weight=%.2f) → [%s] %s", "src_type", "src_label", "relation", "weight", "dst_type", "dst_label")


def node_line() -> Column:
    part = lambda c, ok: F.when(ok, F.concat(F.lit(f", {c}="), F.col(c).cast("string"))).otherwise(F.lit(""))
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return F.concat(F.lit("  "), "key", F.lit(": ["), "type", F.lit("] "), F.coalesce("label", F.lit("")), part("url", full("url")), part("entityType", full("entityType")), part("score", F.coalesce("score", F.lit(0.0)) != 0))


def graph_text(nodes: DataFrame, edges: DataFrame, stats: DataFrame, seeds: list[str], depth: int) -> DataFrame:
    """One row, text: header, relationships and nodes of a subgraph (as small as a reader wants it)."""
    from .graph import labelled_edges

    lines = lambda df, line, *order: df.select(F.struct(*order, line.alias("line")).alias("x")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("t"))
    e, n = lines(labelled_edges(nodes, edges), edge_line(), "src", "dst").select(F.col("t").alias("e")), lines(nodes, node_line(), "key").select(F.col("t").alias("n"))
    head = F.format_string(f"Subgraph from seeds: {', '.join(seeds)} (depth {depth})".replace("%", "%%") + "\nNodes: %d (%d entities, %d results, %d queries, %d domains)\nEdges: %d\n\nRelationships:\n", "nodes", "entities", "results", "queries", "domains", "edges")
    return stats.join(e).join(n).select(F.concat(head, "e", F.lit("\n\nNodes:\n"), "n").alias("text"))
