"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own ``CENTROIDS`` k-means
centroids, so a vector belongs to one cell of a grid of pairs. A query walks the
grid's cells in order of summed squared distance, by a heap over the two sorted
centroid lists, until the cells hold the share of all vectors that it is to see.
Entries of those cells are ranked by their exact distance in double precision; a
matrix product only rules out rows that are farther than k others by more than its
rounding, so no tie is lost.

Centroids are fitted on ``SAMPLE`` vectors at most, chosen by a hash of vec_id, and
every vector is indexed. The share is measured on the same sample: the least at which
walks of ``TRIED`` of its vectors meet ``TARGET`` of their nearest in the sample (in
the whole table the nearest are nearer, and met sooner). Vectors without any structure
(the tested tables) need half of all; clustered ones far less.

Cells are packed into buckets of at most about ``BUCKET_ROWS`` vectors; a larger cell is
split over several. A query goes to the buckets of its cells, with the numbers of
those cells, and meets their vectors there: an equality join on the bucket, in which a
task holds one bucket's vectors while the queries stream by. Neither queries nor vectors
pass through the driver, which sees the sample and the sizes of the cells.

Many rows may hold the same vector. Only its least ``k + 1`` ids can be among a
query's nearest, so the others are left out of the index exactly, by limits on ids and
128-bit hashes of the vectors, applied in parts before any task sees all copies.

Defined cases: null, empty and zero vectors, those of another length than the commonest
(of equally common ones the longest), and those with null or non-finite components take
no part, nor do rows with a null vec_id; vectors may have one component; repeated rows
count once; of several vectors of one vec_id one is taken, by their hashes, whatever the
order of rows; ties go to the smaller vec_id; fewer candidates give fewer rows, and an
empty table or no query gives none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CENTROIDS = 64
SAMPLE = 8192
#: Vectors of the sample that set the share, and the part of their nearest that is to be met.
TRIED = 400
TARGET = 0.96
#: Vectors compared at least, for each one asked for.
LEAST = 8
BUCKET_ROWS = 16_384
K = 10
#: Numbers of a matrix of distances, or of differences, that are held at once.
HELD = 1 << 21
SALTS = 16


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_centroids(half: np.ndarray, n: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    if not half.shape[1]:
        return np.zeros((1, 0))
    rng = np.random.default_rng(seed)
    distinct = np.unique(half, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:n]].copy()
    for _ in range(rounds):
        nearest = half_distances(half, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, half)
        counts = np.bincount(nearest, minlength=len(centroids))
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return centroids


def half_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum(0, (rows**2).sum(1)[:, None] - 2 * rows @ centroids.T + (centroids**2).sum(1))


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, quota: int) -> list[int]:
    """Cells in order of first[i] + second[j] until they hold ``quota`` entries (counts: by cell)."""
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[rows].tolist(), second[columns].tolist()
    n, m = len(a), len(b)
    done = [0] * n  # how many columns of each row were taken
    heap, cells, held = [(a[0] + b[0], 0, 0)], [], 0
    while heap and held < quota:
        _, i, j = heapq.heappop(heap)
        cell = int(rows[i]) * m + int(columns[j])
        if counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
        done[i] = j + 1
        # A pair enters when its neighbours before it, in row and column, were taken.
        if i + 1 < n and done[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < m and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return cells


def cells_of(x: np.ndarray, fitted: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    first, second = fitted
    h = first.shape[1]
    return half_distances(x[:, :h], first).argmin(1) * len(second) + half_distances(x[:, h:], second).argmin(1)


def needed_share(x: np.ndarray, fitted: tuple[np.ndarray, np.ndarray], k: int, target: float = TARGET) -> float:
    """The share of the vectors x that walks must see to meet ``target`` of the k nearest of the first of them."""
    if len(x) < 2:
        return 1.0
    first, second = fitted
    h, cells = first.shape[1], cells_of(x, fitted)
    counts = np.bincount(cells, minlength=len(first) * len(second))
    shares = []
    for at in range(0, min(TRIED, len(x)), 32):
        q = x[at : min(at + 32, TRIED)]
        d = half_distances(q, x)
        d[np.arange(len(q)), at + np.arange(len(q))] = np.inf
        found = np.argpartition(d, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
        sums = (half_distances(q[:, :h], first)[:, :, None] + half_distances(q[:, h:], second)[:, None, :]).reshape(len(q), -1)
        order = np.argsort(sums, axis=1, kind="stable")
        seen = np.empty_like(sums)
        np.put_along_axis(seen, order, np.cumsum(counts[order], axis=1), axis=1)
        shares.append(np.take_along_axis(seen, cells[found], axis=1).ravel() / len(x))
    return float(np.quantile(np.concatenate(shares), target, method="higher"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _cells(shared):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([*batch.columns, pa.array(cells_of(_matrix(batch.column(1)), shared.value).astype(np.int32))], [*batch.schema.names, "cell"])

    return cells


class Buckets:
    """Which buckets hold each cell: number ``first`` and the ``parts - 1`` after it."""

    def __init__(self, counts: np.ndarray, rows: int):
        self.first, self.parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
        bucket, held = 0, 0
        for cell in np.flatnonzero(counts):
            n = int(counts[cell])
            if held and held + n > rows:
                bucket, held = bucket + 1, 0
            self.first[cell], self.parts[cell] = bucket, max(1, -(-n // rows))
            bucket, held = (bucket + self.parts[cell], 0) if n > rows else (bucket, held + n)
        self.total = int(bucket) + 1


def _walks(shared):
    """Queries -> a row for each bucket they go to, with the cells they look at there."""

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        (first, second), buckets = model["centroids"], model["buckets"]
        h = first.shape[1]
        for batch in batches:
            for i in range(batch.num_rows):
                x = _matrix(batch.column(1).slice(i, 1))
                cells = np.array(walk(half_distances(x[:, :h], first)[0], half_distances(x[:, h:], second)[0], model["counts"], model["quota"]), np.int64)
                n = buckets.parts[cells]
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                where, cells = np.repeat(buckets.first[cells], n) + at, np.repeat(cells, n)
                order = np.argsort(where, kind="stable")
                go, begin = np.unique(where[order], return_index=True)
                looked = [c.astype(np.int32).tobytes() for c in np.split(cells[order], begin[1:])]
                yield pa.record_batch(
                    [pa.array(go), pa.array(np.repeat(batch.column(0).slice(i, 1).to_numpy(), len(go))), pa.array([batch.column(1)[i].as_py()] * len(go), batch.schema.field(1).type), pa.array(looked, pa.binary())],
                    ["bucket", "vec_id", "embedding", "cells"],
                )

    return walks


def _near(q: np.ndarray, x: np.ndarray, free: np.ndarray, k: int) -> np.ndarray:
    """Which rows of x may be among the k nearest free ones of each q.

    Squared distances come from a matrix product; ``off`` is over what rounding can make
    of them and of the exact ones. Only rows that are surely farther than k others go.
    """
    size = (q**2).sum(1)[:, None] + (x**2).sum(1)
    with np.errstate(over="ignore", invalid="ignore"):
        d = size - 2 * q @ x.T
        off = 4 * (x.shape[1] + 8) * np.finfo(np.float64).eps * size + np.finfo(np.float64).tiny
        if k >= d.shape[1]:
            return free
        limit = np.partition(np.where(free, d + off, np.inf), k - 1, axis=1)[:, k - 1]
        # Numbers whose squares overflow compare as false and stay.
        return free & ~(d - off > limit[:, None])


def _best(ids: np.ndarray, q: np.ndarray, looks: np.ndarray, row_ids: np.ndarray, x: np.ndarray, cell: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id and distance of each query's k nearest in the cells it looks at (looks: by query and row)."""
    free = looks & (ids[:, None] != row_ids)
    who, which = np.nonzero(_near(q, x, free, k))
    exact = np.empty(len(who))
    step = max(1, HELD // x.shape[1])
    for i in range(0, len(who), step):
        exact[i : i + step] = np.sqrt(((x[which[i : i + step]] - q[who[i : i + step]]) ** 2).sum(1))
    order = np.lexsort((row_ids[which], exact, who))
    begin = np.searchsorted(who[order], np.arange(len(ids)))
    top = order[np.arange(len(order)) - begin[who[order]] < k]
    return ids[who[top]], row_ids[which[top]], exact[top]


def _search(n_cells: int, k: int):
    """Rows sorted by bucket and kind (vectors, then queries) -> the queries' nearest in the bucket."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, table = None, [], None
        for batch in batches:
            buckets, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((np.diff(buckets) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *change], [*change, len(buckets)], strict=True):
                if a == b:
                    continue
                if buckets[a] != now:
                    now, held, table = buckets[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append((part.column(2).to_numpy(), _matrix(part.column(3)), part.column(4).to_numpy()))
                    continue
                if table is None:
                    if not held:
                        continue
                    table, held = [np.concatenate(c) for c in zip(*held, strict=True)], []
                row_ids, x, cell = table
                step = max(1, HELD // len(x))
                for i in range(0, b - a, step):
                    asks = part.slice(i, step)
                    looks = np.zeros((asks.num_rows, n_cells), bool)
                    for j, cells in enumerate(asks.column(5)):
                        looks[j, np.frombuffer(cells.as_buffer(), np.int32)] = True
                    found = _best(asks.column(2).to_numpy(), _matrix(asks.column(3)), looks[:, cell], row_ids, x, cell, k)
                    yield pa.record_batch([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = K, centroids: int = CENTROIDS, probe: float | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of each query's k nearest other vectors.

    vectors: vec_id long, embedding array; is_query: which of them are queries; probe:
    the share of the vectors a query sees (None: measured on the sample).
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    plain = plain.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = plain.groupBy(F.size("embedding").alias("n")).count().agg(F.max(F.struct("count", "n")).alias("top")).first().top
    if sizes is None:
        return spark.createDataFrame([], schema)
    # -0.0 and 0.0 are one vector.
    same = plain.where(F.size("embedding") == sizes.n).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    hashed = same.withColumn("h", F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), F.col("embedding")).alias("b")))
    sample = hashed.select("vec_id", "h", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id", "h").limit(SAMPLE).select("embedding").toArrow()
    x = _matrix(sample["embedding"].combine_chunks())
    half = (x.shape[1] + 1) // 2
    fitted = fit_centroids(x[:, :half], centroids), fit_centroids(x[:, half:], centroids)
    share = needed_share(x, fitted, k) if probe is None else probe
    # Ids and hashes only: one vector an id, and which ids of a vector that many hold are indexed.
    ids = hashed.groupBy("vec_id").agg(F.min("h").alias("h"), F.max("asks").alias("asks"))
    salted = Window.partitionBy("h", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id")
    few = ids.withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= k + 1)
    few = few.withColumn("_n", F.row_number().over(Window.partitionBy("h").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    kept = few.select("vec_id", "h", "asks", F.lit(True).alias("indexed")).unionByName(ids.where("asks").withColumn("indexed", F.lit(False)))
    kept = kept.groupBy("vec_id", "h", "asks").agg(F.max("indexed").alias("indexed"))
    rows = hashed.select("vec_id", "h", "embedding").join(kept, ["vec_id", "h"]).groupBy("vec_id").agg(F.first("embedding").alias("embedding"), F.first("asks").alias("asks"), F.first("indexed").alias("indexed"))
    index = cut(rows.mapInArrow(_cells(spark.sparkContext.broadcast(fitted)), "vec_id long, embedding array<double>, asks boolean, indexed boolean, cell int"))
    counts = np.zeros(len(fitted[0]) * len(fitted[1]), np.int64)
    for r in index.where("indexed").groupBy("cell").count().collect():  # at most one row a cell
        counts[r.cell] = r["count"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = Buckets(counts, int(min(bucket_rows, max(1024, -(-int(counts.sum()) // tasks)))))
    plan = spark.sparkContext.broadcast({"centroids": fitted, "counts": counts, "buckets": buckets, "quota": max(int(np.ceil(share * counts.sum())), LEAST * (k + 1))})
    # A literal of two numbers a cell.
    of_cell = lambda numbers: F.get(F.lit(numbers.tolist()).cast("array<bigint>"), F.col("cell"))
    bucket = of_cell(buckets.first) + F.pmod(F.xxhash64("vec_id"), of_cell(buckets.parts))
    held = index.where("indexed").select(bucket.alias("bucket"), F.lit(0).alias("kind"), "vec_id", "embedding", "cell", F.lit(None).cast("binary").alias("cells"))
    asked = index.where("asks").select("vec_id", "embedding").mapInArrow(_walks(plan), "bucket long, vec_id long, embedding array<double>, cells binary")
    asked = asked.select("bucket", F.lit(1).alias("kind"), "vec_id", "embedding", F.lit(None).cast("int").alias("cell"), "cells")
    met = held.unionByName(asked).repartition(max(tasks, buckets.total), "bucket").sortWithinPartitions("bucket", "kind")
    found = met.mapInArrow(_search(len(counts), k), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
