import numpy as np
from pyspark.sql import functions as F

from trawlix.llm import multi_index as mi


def test_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[300:700] = x[300]  # a vector that many rows hold
    rows = [(int(i), [float(v) for v in x[i]], 0.0) for i in range(900)]
    rows += [rows[10], rows[300], (2000, None, 0.0), (2001, [0.0] * 16, 0.0), (2002, [float("nan")] * 16, 0.0), (2003, [1.0, None] * 8, 0.0), (2004, [float("inf")] * 16, 0.0), (2005, [1.0] * 3, 0.0), (None, [1.0] * 16, 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double").repartition(7)
    got = mi.nearest(df, F.col("vec_id") % 50 == 0, centroids=8).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 900, 50))
    xd, hits = x.astype(np.float64), 0
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 11))
        d = np.sqrt(((xd - xd[q]) ** 2).sum(1))
        assert np.allclose([r.score for r in found], d[[r.vec_id for r in found]], rtol=0, atol=1e-12)
        assert sorted(found, key=lambda r: (r.score, r.vec_id)) == found and q not in {r.vec_id for r in found}
        d[q] = np.inf
        hits += len({int(v) for v in np.lexsort((np.arange(900), d))[:10]} & {r.vec_id for r in found})
    assert hits / (10 * len(by)) >= 0.9
    assert [r.vec_id for r in by[350]] == [i for i in range(300, 311) if i != 350][:10]


def test_all_of_the_index_is_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (60, 4)).astype(np.float64)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x) if r.any()], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mi.nearest(df, F.lit(True), k=3, centroids=4, probe=1.0).collect()}
    for q in range(60):
        if x[q].any():
            d = sorted((float(np.sqrt(((x[q] - x[i]) ** 2).sum())), i) for i in range(60) if i != q and x[i].any())
            assert [got[q, n + 1][0] for n in range(3)] == [i for _, i in d[:3]]


def nearest_by_all_pairs(x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    return [int(i) for i in np.lexsort((np.arange(len(x)), d))[:k]]


def test_many_ties_and_a_large_offset(spark):
    rng = np.random.default_rng(7)
    flipped = [[1.0 - (j in (a, b)) for j in range(32)] for a in range(32) for b in range(a)]
    ties = np.array([[1.0] * 32, *[flipped[i] for i in rng.permutation(len(flipped))]])
    for x in (ties, 1e8 + rng.integers(0, 5, (400, 8))):
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
        got = mi.nearest(df, F.col("vec_id") % 25 == 0, centroids=4, probe=1.0).orderBy("query_id", "rank").collect()
        by = {q: [r.vec_id for r in got if r.query_id == q] for q in range(0, len(x), 25)}
        assert by == {q: nearest_by_all_pairs(x, q, 10) for q in by}


def test_the_ties_of_one_distance_go_by_id(spark):
    rows = [(i, [float(i == j) for j in range(80)]) for i in range(80)]
    got = mi.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, probe=1.0, bucket_rows=9).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 11))


def test_one_component_and_ids_of_several_vectors(spark):
    rows = [(i, [float((i * 37) % 101 + 1)]) for i in range(60)]
    got = mi.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=4, probe=1.0).orderBy("query_id", "rank").collect()
    x = np.array([r[1] for r in rows])
    for q in range(0, 60, 10):
        assert [r.vec_id for r in got if r.query_id == q] == nearest_by_all_pairs(x, q, 4)
    twice = [(0, [1.0, 1.0]), (1, [5.0, 5.0]), (1, [2.0, 2.0]), (1, [5.0, 5.0]), (2, [9.0, 9.0])]
    ways = [mi.nearest(spark.createDataFrame(x, "vec_id long, embedding array<double>").repartition(n), F.lit(True)).orderBy("query_id", "rank").collect() for x, n in ((twice, 1), (twice[::-1], 3))]
    assert ways[0] == ways[1] and [(r.query_id, r["rank"]) for r in ways[0]] == [(q, n) for q in (0, 1, 2) for n in (1, 2)]


def test_buckets_hold_all_cells_in_bounds():
    counts = np.array([3, 0, 4, 9, 1, 25, 2])
    b = mi.Buckets(counts, 10)
    assert b.parts.tolist() == [1, 1, 1, 1, 1, 3, 1] and b.total == len({int(f) + i for f, n, c in zip(b.first, b.parts, counts, strict=True) if c for i in range(n)})
    whole = {int(f) for f, n in zip(b.first, b.parts, strict=True) if n == 1}
    assert all(sum(int(c) for f, n, c in zip(b.first, b.parts, counts, strict=True) if n == 1 and f == w) <= 10 for w in whole)


def test_share_follows_the_structure():
    rng = np.random.default_rng(9)
    loose = rng.standard_normal((1500, 16))
    tight = rng.standard_normal((12, 16))[rng.integers(0, 12, 1500)] * 8 + rng.standard_normal((1500, 16)) * 0.1
    shares = [mi.needed_share(x, (mi.fit_centroids(x[:, :8], 16), mi.fit_centroids(x[:, 8:], 16)), 10) for x in (loose, tight)]
    assert shares[1] < 0.2 < shares[0] <= 1


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in mi.nearest(df, F.col("vec_id") == 0).collect()] == [(0, 5, 2.0)]
    assert mi.nearest(df.limit(0), F.lit(True)).count() == 0
    assert mi.nearest(df, F.lit(False)).count() == 0


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(6)
    a, b, counts = rng.random(9), rng.random(7), rng.integers(0, 3, 63)
    order = sorted(range(63), key=lambda c: a[c // 7] + b[c % 7])
    assert mi.walk(a, b, counts, int(counts.sum())) == [c for c in order if counts[c]][: len(mi.walk(a, b, counts, int(counts.sum())))]
    assert counts[mi.walk(a, b, counts, 10)].sum() >= 10
