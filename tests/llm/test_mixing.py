import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trawlix.llm import mixing


def plain(docs):
    """Targets by pouring, and words taken by one sorted list."""
    sizes = {}
    for _, source, size in docs:
        sizes[source] = sizes.get(source, 0) + size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total = sum(sizes.values())
    capped, free = {}, set(order)
    while True:
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s]] if w else []
        if not over:
            break
        for s in over:
            capped[s] = 3 * sizes[s]
            free.discard(s)
    target = {s: capped.get(s, left * weight[s] / w if w else 0) for s in order}
    return sizes, target, total


CASES = [(i, random.Random(i).choice([None, "a", "b", "ü", "hot", "hot", "hot"]), random.Random(i + 999).choice([0, 1, 5, 40, 300])) for i in range(300)]
CASES += [(7, "tiny", 3), (7, "tiny", 3), (None, "b", 9), (400, "zero", 0)]


def test_against_plain_mix(spark):
    rows = [(i, s, " \t".join(["wörd"] * n) if n or i != 400 else None, "x", 1) for i, s, n in CASES]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, target string, size int")
    got = mixing.mix(df).collect()
    sizes, target, total = plain(CASES)
    assert len(got) == len(CASES)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert sum(taken.values()) == total
    assert all(abs(taken[s] - target[s]) <= 300 for s in sizes)
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_order_is_by_virtual_finish_time(spark):
    rows = [(i, "a" if i < 20 else "b", "w " * (i % 7 + 1)) for i in range(40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    entries = []
    for s in "ab":
        mine = sorted((r for r in got if r.source == s), key=lambda r: hashlib.md5(f"{r.doc_id}:{mixing.SEED}".encode()).hexdigest())
        for e in range(3):
            through = 0
            for r in mine:
                through += r["size"]
                entries.append(((e * r.source_size + through) / r.target, s, r.doc_id, r["size"]))
    left, want = sum(r["size"] for r in got), {}
    for _, _, i, n in sorted(entries):
        want[i] = want.get(i, 0) + min(n, left)
        left -= min(n, left)
    assert {r.doc_id: r.taken for r in got} == {i: want.get(i, 0) for i in range(40)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(df).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string")
    assert [(r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(one).collect()] == [(0, 0, 0.0, 0)]


def test_words_of_any_text(spark):
    import re

    texts = [None, "", " \t\n\x0b\x0c\r ", "a", " a  b\tc\n", "w ww www", "$1 \\ \\w", "é ü x y", "\U0001f600 \U0001f601\U0001f602", "x" * 100_000, "w " * 50_000, "\x1c\x85 ​"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", mixing.n_words(F.col("text")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
