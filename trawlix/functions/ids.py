"""Graph node keys: a prefix and a slug of the raw label or URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The key prefix of each node type, and the slug's length.
PREFIXES = {"entity": "e", "result": "r", "query": "q", "domain": "d"}
SLUG_LENGTH = 60


def slug(text: Column) -> Column:
    """Lower case, each run of other than ASCII word characters one underscore, cut to length."""
    return F.substring(F.regexp_replace(F.lower(text), r"[^\w]+", "_"), 1, SLUG_LENGTH)


def node_id(kind: str, text: Column) -> Column:
    return F.concat(F.lit(PREFIXES[kind] + ":"), slug(text))
