import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawlix.llm import decontaminate as dec


def plain(docs, bench, window=10):
    phrases = {}
    for item, text in bench:
        w = dec.words_of((text or "").encode())
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for _, text in docs:
        w = dec.words_of((text or "").encode())
        hit, items = set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in phrases:
                    hit |= set(range(i, i + n))
                    items |= phrases[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(items)))
    return out


def cases(seed):
    rng = random.Random(seed)
    words = ["the", "of", "Été", "a1", "zz", "run", "cat", "dog"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, text(rng.choice([0, 6, 12, 25]))) for i in range(12)] + [(20, None), (21, "run, run; run-RUN run run run run run run run"), (22, "solo")]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(bench)[1] or "", rng.choice(["", "other", text(3)])]
        docs.append((i, "! ".join(parts)))
    return docs + [(60, None), (61, ""), (62, "run " * 400), (62, "run " * 400), (63, "solo")], bench


@pytest.mark.parametrize("block_bytes", [dec.BLOCK_BYTES, 150])
def test_matches_plain_search(spark, block_bytes):
    docs, bench = cases(block_bytes)
    found = dec.find_spans(spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=block_bytes)
    got = sorted((r.doc_id, r.n_words, r.n, sorted(r["items"])) for r in found.withColumn("n", dec.hits(F.col("spans"))).collect())
    assert got == sorted((d[0], *w) for d, w in zip(docs, plain(docs, bench)))


def test_spans_cut_words_out(spark):
    docs, bench = cases(5)
    for r in dec.find_spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect():
        text = (dict(docs)[r.doc_id] or "").encode()
        words = dec.words_of(text)
        spans = [(s["first"], s["last"]) for s in r.spans]
        left = [w for i, w in enumerate(words) if not any(a <= i < b for a, b in spans)]
        assert dec.words_of(dec.excise(text, spans)) == left


def test_index_counts_and_places():
    rng = np.random.default_rng(1)
    for _ in range(30):
        seq = np.append(rng.integers(0, 5, rng.integers(1, 80)), 0)
        index = dec.FMIndex(seq)
        phrases = rng.integers(1, 7, (20, 3))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(len(seq) - 2) if (seq[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [(r.n_words, r.spans, r["items"]) for r in dec.find_spans(one, none).collect()] == [(3, [], [])]
    assert dec.find_spans(one.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
