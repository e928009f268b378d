"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a shuffled order (by a hash of doc_id), up to
``REPEATS`` times over. A queued document's virtual finish time is its source's
words so far divided by the source's target. All queued documents are sorted by
finish time over ranges, and the mix is the front of that order, up to a budget
of as many words as there are; the document on the edge is taken in part.

Targets share the budget by weight (1, 2, 3, repeating over the sources by code
point, null last). No target exceeds ``REPEATS`` times its source's words: the
excess is shared again by weight among the others.

All running totals come from ``prefix_sums``, so a source that holds a third of
the rows is split over many tasks. Only one document, the one on the edge of the
budget, and four totals reach the driver.

Defined cases: a null text has size 0; documents of size 0 are returned with
taken 0; repeated rows are separate documents, and of rows with the same doc_id and
size (null doc_ids are shuffled as the text ``null``) any may be taken first; a text of
any length is counted whole and may be taken in part; sources that tie are filled in
order of their names; an empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prefix_sums, split_join

REPEATS = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Words of a text. Each becomes one letter, so that no array of words is made, and all else left is white space."""
    letters = F.translate(F.regexp_replace(text, WORD, "w"), SPACES, "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Per source: _source, source_size, _before (words of the sources before it) and target."""
    sources = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    ranked = prefix_sums(sources, [F.col("_source")], {"_rank": F.lit(1), "_through": F.col("source_size")})
    weighed = ranked.withColumns({"_weight": (F.col("_rank") - 1) % 3 + 1, "_cap": F.col("source_size") * repeats, "_before": F.col("_through") - F.col("source_size")})
    by_ratio = cut(prefix_sums(weighed, [F.col("_cap") / F.col("_weight"), F.col("_source")], {"_caps": F.col("_cap"), "_weights": F.col("_weight")}))
    total, weights = by_ratio.agg(F.sum("source_size"), F.sum("_weight")).first()
    level = (F.lit(total).cast("long") - F.col("_caps") + F.col("_cap")).cast("double") / (F.lit(weights).cast("long") - F.col("_weights") + F.col("_weight")).cast("double")
    leveled = by_ratio.withColumn("_level", level)
    # The first source, by cap over weight, that need not be capped sets the level.
    (fair,) = leveled.where(F.col("_level") <= F.col("_cap") / F.col("_weight")).agg(F.min_by("_level", F.struct(F.col("_cap") / F.col("_weight"), "_source"))).first()
    cap = F.col("_cap").cast("double")
    target = cap if fair is None else F.least(cap, F.col("_weight") * F.lit(fair))
    return leveled.select("_source", "source_size", "_before", target.alias("target"))


def mix(docs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and taken (words that the mix takes)."""
    source = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    shuffled = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{SEED}")))
    # The number tells rows apart that have the same hash and size; it is kept with them.
    number = F.monotonically_increasing_id().alias("_number")
    sizes = cut(docs.select("doc_id", "source", source.alias("_source"), n_words(F.col("text")).alias("size"), shuffled.alias("_shuffled"), number))
    per_source = targets(sizes, repeats)
    queued = prefix_sums(sizes, [F.col("_source"), F.col("_shuffled"), F.col("size"), F.col("_number")], {"_through": F.col("size")})
    queued = cut(split_join(queued, per_source, ["_source"], "inner", F.col("_shuffled")).withColumn("_at", F.col("_through") - F.col("_before")))
    finish = lambda e: (F.col("source_size") * e + F.col("_at")).cast("double") / F.col("target")
    rounds = F.explode(F.array(*[F.struct(finish(F.lit(e)).alias("finish"), F.lit(e).alias("round")) for e in range(repeats)])).alias("r")
    entries = queued.where("size > 0").select(rounds, "_source", "_at", "size").select("r.finish", "r.round", "_source", "_at", "size")
    key = ["finish", "_source", "round", "_at"]
    ordered = prefix_sums(entries, [F.col(c) for c in key], {"_run": F.col("size")})
    (budget,) = sizes.agg(F.sum("size")).first()
    edge = ordered.where(F.col("_run") >= F.lit(budget)).agg(F.min_by(F.struct(*key, "_run", "size"), "_run").alias("edge")).first().edge if budget else None
    taken = F.lit(0).cast("long")
    if edge is not None:
        last = F.struct(F.lit(edge.finish), F.lit(edge._source), F.lit(edge.round), F.lit(edge._at).cast("long"))
        part = edge.size - (edge._run - budget)
        for e in range(repeats):
            mine = F.struct(finish(F.lit(e)), F.col("_source"), F.lit(e), F.col("_at"))
            taken = taken + F.when(mine < last, F.col("size")).when(mine == last, F.lit(part)).otherwise(F.lit(0))
    taken = F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long")
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
