"""Near-duplicates by SimHash, found through deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Of two fingerprints with
at most three differing bits, one segment differs by at most one bit. So each
distinct fingerprint is indexed under 64 keys: either segment with one of its bits
wildcarded. Fingerprints that share a key meet in one task, sorted by key, and
are compared whole.

A key may gather many fingerprints of one large group of near copies. Not all of
their pairs are made: within a key a search from fingerprint to fingerprint
compares each with those not yet reached, and yields one link for each reached.
That keeps every connection. The fingerprints of a key with more than ``DIRECT`` are
passed on under finer keys, which add a half of the other segment with one of its bits
wildcarded: that keeps every pair too (of three differing bits, one half has at most
one), spreads the key over tasks, and leaves no more than 2**18 fingerprints a key. So
a task holds ``DIRECT`` fingerprints of the one kind or 2**18 of the other.

Equal fingerprints are one from the start, so exact copies cost nothing here.
Links are contracted to stars per task, then over tasks by large-star and
small-star rounds, until none changes; rounds are checkpointed. The rows of a node
with very many links (and of a fingerprint that very many documents have) are dealt
to ``PARTS`` tasks.

Defined cases: texts without words (null, empty, white space) have fingerprint
zero and link like any other; texts of fewer than three words are one shingle; a text
of any length is read whole; repeated rows each get a row, an empty table gives none;
component_id ignores null ids (null if all are), and keep_one then keeps the row of
the least text_hash; other columns, of whatever names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, binary, chunks, cut, forget

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Fingerprints of one key that are compared without cutting the key again.
DIRECT = 20_000
#: Over how many tasks a node is dealt that holds more than one in HOT of all rows (so at most HOT nodes do).
PARTS, HOT = 16, 500
#: Bytes of text fingerprinted at once; the shingles' bits take about 12 times as much.
FINGERPRINT_BYTES = 1 << 20
_U = np.uint64


def shingle_hashes(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its word shingles' hashes (all texts' in a row), how many those are, and the hash of all its words."""
    hashes: list[int] = []
    sizes, whole = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.translate(LOWER).split()
        n = len(words)
        if n == 0:
            continue
        line = b" ".join(words)
        whole[i] = digest(line, SEED)
        if n < shingle:
            hashes.append(int(whole[i]))
            sizes[i] = 1
            continue
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: n - shingle + 1].tolist()
        hashes += [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        sizes[i] = n - shingle + 1
    return np.array(hashes, dtype=np.uint64), sizes, whole


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """SimHash of each text's word shingles, as unsigned 64-bit numbers."""
    hashes, sizes, _ = shingle_hashes(texts, SHINGLE)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        votes = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        packed = np.packbits(2 * votes > sizes[full][:, None], axis=1)
        out[full] = np.ascontiguousarray(packed).view(">u8").ravel()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches, limit=FINGERPRINT_BYTES):
        names = [n for n in part.schema.names if n != "text"]
        yield pa.record_batch([*[part.column(part.schema.get_field_index(n)) for n in names], pa.array(fingerprints(texts).view(np.int64))], [*names, "fp"])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's bits as a signed long) per row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return binary(hashed, "doc_id", "text_hash").mapInArrow(_fingerprint, f"doc_id {kind}, text_hash long, fp long")


def _reach(fps: np.ndarray) -> list[np.ndarray]:
    """Links [from, to] of a spanning forest of distinct fingerprints under the distance."""
    links, left = [], fps
    while len(left) > 1:
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            for at in queue.pop():
                near = np.bitwise_count(left ^ at) <= DISTANCE
                if near.any():
                    found = left[near]
                    links.append(np.stack([np.full(len(found), at, np.uint64), found]))
                    queue.append(found)
                    left = left[~near]
                    if not len(left):
                        break
    return links


def _finer(key: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The fingerprints of a key of a segment under keys that add a half of the other segment, a bit of it wildcarded."""
    other = 32 * (1 - (key >> 37))
    for half in (0, 1):
        part = (fps >> _U(other + 16 * half)) & _U(0xFFFF)
        for bit in range(16):
            fine = (part & _U(0xFFFF ^ (1 << bit))).astype(np.int64) | (key << 21) | (half << 20) | (bit << 16)
            yield pa.record_batch([pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64()), pa.array(fine)], ["u", "v", "key"])


def contract(pairs: np.ndarray) -> np.ndarray:
    """Links as columns -> [least fingerprint of the component, member], members once."""
    nodes, ends = np.unique(pairs, return_inverse=True)
    ends = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[ends[0]], label[ends[1]])
        new = label.copy()
        np.minimum.at(new, label[ends[0]], low)
        np.minimum.at(new, label[ends[1]], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[label[far]], nodes[far]])


def _links(direct: int | None):
    """Rows (key, fp) sorted by key -> star links (u, v) of the task's components; keys of more than ``direct`` go on as (fp, finer key)."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        count = 0
        held_keys, held, large = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def close(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal found, count
            bounds = np.flatnonzero(np.diff(keys)) + 1
            first = np.concatenate([[0], bounds])
            size = np.diff(np.append(first, len(keys)))
            pairs = np.flatnonzero(size == 2)
            a, b = fps[first[pairs]], fps[first[pairs] + 1]
            near = np.bitwise_count(a ^ b) <= DISTANCE
            found.append(np.stack([a[near], b[near]]))
            for g in np.flatnonzero(size > 2).tolist():
                key, group = int(keys[first[g]]), fps[first[g] : first[g] + size[g]]
                if direct and (len(group) > direct or key == large):
                    yield from _finer(key, group)
                else:
                    found += _reach(group)
            count += len(keys)
            if count > 1_000_000 and found:
                found, count = [contract(np.concatenate(found, axis=1))], 0

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            keys, fps = np.concatenate([held_keys, keys]), np.concatenate([held, fps])
            to = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if to:
                yield from _rest(large, keys[:to], fps[:to], close)
            held_keys, held = keys[to:], fps[to:]
            if direct and len(held) > direct:
                # The key's fingerprints so far need not wait for the others: finer keys hold them all.
                large = int(held_keys[0])
                yield from _finer(large, held)
                held_keys, held = held_keys[:0], held[:0]
        if len(held_keys):
            yield from _rest(large, held_keys, held, close)
        if found:
            stars = contract(np.concatenate(found, axis=1))
            yield pa.record_batch([pa.array(stars[0].view(np.int64)), pa.array(stars[1].view(np.int64)), pa.nulls(stars.shape[1], pa.int64())], ["u", "v", "key"])

    return links


def _rest(large: int | None, keys: np.ndarray, fps: np.ndarray, close) -> Iterator[pa.RecordBatch]:
    """Closes the keys, of which the first may go on with a large one, however few are left of it."""
    to = int(np.searchsorted(keys, keys[0], side="right"))
    if keys[0] == large:
        yield from _finer(large, fps[:to])
        keys, fps = keys[to:], fps[to:]
    if len(keys):
        yield from close(keys, fps)


def links(fps: DataFrame, direct: int = DIRECT) -> DataFrame:
    """Links u, v that connect all fingerprints (column fp, distinct) within the distance."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Bits 32-36 of a key: the wildcarded bit; bit 37: the segment.
    key = "transform(sequence(0, 63), j -> (cast(j as bigint) << 32) | (shiftright(fp, 32 * (j div 32)) & 4294967295L & ~(1L << (j % 32))))"
    search = lambda rows, most: rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_links(most), "u long, v long, key long")
    found = cut(search(fps.select(F.explode(F.expr(key)).alias("key"), "fp"), direct))
    finer = found.where("key is not null").select("key", F.col("u").alias("fp"))
    near = found.where("key is null").select("u", "v")
    return near if finer.isEmpty() else near.unionByName(search(finer, None).select("u", "v"))


def met(rows: DataFrame, small: DataFrame, on: str, spread: str, counts: DataFrame, total: int) -> DataFrame:
    """Inner join of rows to a frame of one row a key; a key with very many rows is dealt to several tasks.

    counts: key and n of ``on``; at most HOT keys have more than total / HOT rows.
    """
    hot = [r[0] for r in counts.where(F.col("n") > max(HOT, total // HOT)).select(on).collect()]
    if not hot:
        return rows.join(small, on)
    parts = F.lit(PARTS)
    dealt = rows.withColumn("_part", F.when(F.col(on).isin(hot), F.pmod(F.xxhash64(spread), parts)).otherwise(F.lit(0)).cast("int"))
    copies = small.withColumn("_part", F.explode(F.when(F.col(on).isin(hot), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [on, "_part"]).drop("_part")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node reachable) for every node with a link u, v."""
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    state = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    before, size = None, state.count()
    while True:
        # Large star: neighbours above a node move to its least neighbour.
        around = both(state)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = met(around.where("v > u"), least.drop("n"), "u", "v", least, size).select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        large = cut(large)
        # Small star: a node and its lesser neighbours move to the least of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        joined = met(large, least.drop("n"), "v", "u", least, size)
        small = joined.select(F.col("m").alias("u"), F.col("u").alias("w")).where("u <> w").select("u", F.col("w").alias("v")).unionByName(least.select(F.col("m").alias("u"), "v"))
        state = cut(small.distinct(), spent=state)
        forget(large)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        size = now[0]
        if now == before:
            break
        before = now
    return state.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(state.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable), text_hash and root.

    root names the component even where all its ids are null.
    """
    rows = cut(with_fingerprint(docs))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    linked = cut(components(links(distinct.select("fp"))))
    return grouped(rows, distinct, linked).withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0"))).select("doc_id", "fingerprint", "component_id", "text_hash", "root")


def grouped(rows: DataFrame, distinct: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, fp) with their fingerprint's root and component_id.

    distinct: fp, its least doc_id and its n rows; linked: node and root of those with links.
    """
    rooted = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    sizes = distinct.agg(F.count("*"), F.sum("n")).first()
    by_fp = met(rooted, smallest.drop("n"), "root", "fp", smallest, sizes[0]).select("fp", "root", "component_id")
    return met(rows, by_fp, "fp", "doc_id", distinct, sizes[1] or 0).select("doc_id", "fp", "component_id", "text_hash", "root")


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One document of each component stays, with all its columns: the one of the least doc_id.

    found: the components, of ``near_duplicates`` unless given.

    Texts are shuffled once, by the join; only rows that stand in the table more than
    once are compared whole.
    """
    found = near_duplicates(docs) if found is None else found
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    kept = cut(first.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "copies")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"), F.col("k.copies").alias("_copies")))

    def rows(of: DataFrame) -> DataFrame:
        return docs.join(of, docs["doc_id"].eqNullSafe(of["_id"]) & (F.xxhash64(docs["text"]) == of["_hash"]), "left_semi")

    return rows(kept.where("_copies = 1")).unionByName(rows(kept.where("_copies > 1")).dropDuplicates(["doc_id", "text"]))
