"""Removing exact and near duplicates; the first row in ``pos`` order stays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlix.functions.simhash64 import THRESHOLD, hamming, simhash
from trawlix.functions.urls import normalize_url

from .ordering import cut

#: Distinct hashes that the driver decides on in one round.
ROUND = 4096


def first_per_key(rows: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    """All columns of the first row of each key; the column ``pos`` differs in every row, and the choice is made by it alone."""
    picked = rows.select(key.alias("_key"), pos).groupBy("_key").agg(F.min(pos).alias(pos)).select(pos)
    return rows.join(picked, pos, "left_semi").select(*rows.columns)


def dedupe_by_url(items: DataFrame) -> DataFrame:
    return first_per_key(items, normalize_url(F.col("url")))


def _greedy(hashes: np.ndarray, most: int) -> np.ndarray:
    kept = np.zeros(0, np.uint64)
    for h in hashes:
        if not (np.bitwise_count(kept ^ h) <= most).any():
            kept = np.append(kept, h)
    return kept


def dedupe_by_simhash(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Items (pos, title, content, ...) that are not similar to one kept before them.

    Each item is compared with kept items only, so the result depends on order and is
    no clustering. Equal hashes are collapsed first. Then the earliest ``ROUND``
    hashes left are decided on the driver, the newly kept ones (at most that many)
    strike similar hashes from the rest in parallel, and so on until none is left.
    """
    most = int(np.floor((1 - threshold) * 64 + 1e-9))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    hashed = cut(items.select("pos", simhash(text).alias("hash")))
    left = cut(hashed.groupBy("hash").agg(F.min("pos").alias("pos")))
    kept_rows: list[tuple[int, int]] = []
    while True:
        block = left.orderBy("pos").limit(ROUND).collect()
        if not block:
            break
        signed = np.array([r.hash for r in block], np.int64)
        kept = _greedy(signed.view(np.uint64), most)
        places = {r.hash: r.pos for r in block}
        new = [(int(h), places[int(h)]) for h in kept.view(np.int64)]
        kept_rows += new
        if len(block) < ROUND:
            break
        literal = F.split(F.lit(",".join(str(h) for h, _ in new)), ",").cast("array<bigint>")
        left = cut(left.where((F.col("pos") > block[-1].pos) & ~F.exists(literal, lambda k: hamming(F.col("hash"), k) <= most)))
    kept_df = items.sparkSession.createDataFrame([(p,) for _, p in kept_rows], "pos long")
    return items.join(kept_df, "pos", "left_semi")


def dedupe(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return dedupe_by_simhash(dedupe_by_url(items), threshold)
