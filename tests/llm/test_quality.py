import random

import numpy as np
from pyspark.sql import functions as F

from trawlix.llm import quality


def test_held_out_and_defined_cases(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = [word() for _ in range(rng.randint(10, 80))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + rng.choice(["!!", "%%%", "$"]) for w in words), "x"))
        labels.append((i, int(good)))
    labels += [(3, None), (None, 1), (labels[5][0], labels[5][1])]
    rows += [(700, None, "x"), (701, "", "x"), (702, "w " * 100_000, "x"), (None, "a b", "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    for keep in (["doc_id"], ["doc_id", "text"]):
        got = quality.score(docs, lab, F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 4, keep).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        by = {r.doc_id: r.score for r in got}
        held = [(by[i], y) for i, y in labels if i is not None and y is not None and i % 5 == 0]
        good, bad = [s for s, y in held if y], [s for s, y in held if not y]
        assert np.mean([a > b for a in good for b in bad]) > 0.98


def test_against_normal_equations_in_one_piece(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdeXY!") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 50))) for _ in range(240)]
    y = {i: int(rng.random() < 0.3 + 0.5 * (texts[i].count("!") < 15)) for i in range(240)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame(list(y.items()), "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, labels, F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 4, ["doc_id"]).collect()}
    stats = quality.statistics([t.encode() for t in texts])
    ridge, held = [i for i in y if i % 5 in (1, 2, 3)], [i for i in y if i % 5 == 4]
    kernel = quality.Kernel(stats[ridge].mean(axis=0), stats[ridge].std(axis=0))
    x = kernel(stats)
    weights = np.linalg.solve(x[ridge].T @ x[ridge] + quality.RIDGE * len(ridge) / 10 * np.eye(x.shape[1]), x[ridge].T @ np.array([y[i] for i in ridge]))
    at = ((np.clip((x[held] @ weights + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1))).astype(int)
    n, good = np.bincount(at, minlength=quality.BINS).astype(float), np.bincount(at, [y[i] for i in held], quality.BINS)
    # Isotonic regression as the max over starts of the min over ends of means, then shrunk to the prior by one count a block.
    full = np.flatnonzero(n)
    rise = np.round([max(min(good[full[a : b + 1]].sum() / n[full[a : b + 1]].sum() for b in range(i, len(full))) for a in range(i + 1)) for i in range(len(full))], 12)
    prior = (good.sum() + 0.5) / (n.sum() + 1)
    blocks = [full[rise == v] for v in sorted(set(rise))]
    knots = [(n[b] * b).sum() / n[b].sum() + 0.5 for b in blocks]
    shares = [(good[b].sum() + prior) / (n[b].sum() + 1) for b in blocks]
    want = np.interp(np.clip((x @ weights + 0.5) / 2 * quality.BINS, 0, quality.BINS), knots, shares)
    assert np.allclose([got[i] for i in range(240)], want, atol=1e-6)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, none, F.lit(True), F.lit(False), ["doc_id"]).collect()] == [0.5]
    assert quality.score(docs.limit(0), none, F.lit(True), F.lit(False), ["doc_id"]).count() == 0


def test_isotonic_rises_and_matches_a_plain_fit():
    rng = np.random.default_rng(0)
    n = rng.integers(0, 9, 50).astype(float)
    good = np.minimum(n, rng.integers(0, 9, 50))
    knots, shares = quality.isotonic(n, good)
    assert (np.diff(knots) > 0).all()
    # A block's mean is max over starts of min over ends of means.
    at = np.flatnonzero(n)
    plain = [max(min(good[at[a : b + 1]].sum() / n[at[a : b + 1]].sum() for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    assert len(set(np.round(plain, 9))) == len(knots)


def test_kernel_approximates_a_gaussian():
    rng = np.random.default_rng(1)
    kernel = quality.Kernel(np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)), features=4001)
    x = rng.standard_normal((2, len(quality.STATS)))
    f = kernel(x)[:, :-1]
    want = np.exp(-((x[0] - x[1]) ** 2).sum() / 2 / len(quality.STATS))
    assert abs(f[0] @ f[1] - want) < 0.06
