import numpy as np
import pyarrow as pa
import xxhash

from trawlix.llm import simhash


def plain_fingerprint(text):
    words = simhash.LOWER and (text or "").encode().translate(simhash.LOWER).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    texts = ["A b c d", "a b", "", None, " \t ", "one", "a b c a b c a b c", "Straße über é è", "w " * 5000, "x" * 9000]
    got = simhash.fingerprints([(t or "").encode() for t in texts])
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


def near(rng, base, n, flips):
    out = []
    for _ in range(n):
        x = base
        for b in rng.choice(64, rng.integers(0, flips + 1), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return out


def test_components_match_all_pairs(spark):
    rng = np.random.default_rng(7)
    fps = [int(x) for x in rng.integers(0, 2**63, 300)] + near(rng, 0, 60, 2) + near(rng, 2**64 - 1, 150, 4) + near(rng, 0x1234567890ABCDEF, 40, 6)
    # A chain in which each differs from the next by three bits.
    x = 0xF0F0F0F0F0F0F0F0
    for i in range(0, 60, 3):
        x ^= 7 << i
        fps.append(x)
    rng.shuffle(fps)
    distinct = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in distinct], "fp long")
    got = {np.int64(r.node).view(np.uint64): np.int64(r.root).view(np.uint64) for r in simhash.components(simhash.links(df)).collect()}
    want = plain_components(distinct)
    groups = {}
    for i, w in enumerate(want):
        groups.setdefault(w, set()).add(distinct[i])
    found = {}
    for v in distinct:
        found.setdefault(int(got.get(np.uint64(v), np.uint64(v))), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_a_key_that_is_cut_again_loses_no_link(spark):
    rng = np.random.default_rng(3)
    # All share segment 0 but for a bit, so all meet under one key.
    fps = np.unique(np.array([(int(h) << 32) | (5 ^ int(rng.integers(0, 2))) for h in near(rng, 0xABCDEF01, 500, 5)], dtype=object) & (2**64 - 1)).astype(np.uint64)
    df = spark.createDataFrame([(int(f.view(np.int64)),) for f in fps], "fp long")
    want = plain_components(fps.tolist())
    for direct in (10, 100, len(fps)):
        got = simhash.links(df, direct).collect()
        pairs = np.array([[r.u for r in got], [r.v for r in got]], np.int64).view(np.uint64)
        stars = simhash.contract(pairs)
        root = dict(zip(stars[1].tolist(), stars[0].tolist(), strict=True))
        assert [root.get(int(f), int(f)) for f in fps] == [int(fps[w]) for w in want]


def test_a_large_key_over_many_batches():
    fps = np.arange(1, 400, dtype=np.uint64)
    rows = [(3, 5), *[(9, int(f)) for f in fps], (12, 1), (12, 2)]
    for size in (1, 7, 50, 1000):
        batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], ["key", "fp"]) for i in range(0, len(rows), size)]
        out = [b for b in simhash._links(20)(iter(batches))]
        finer = [(k, u) for b in out for u, k in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True) if k is not None]
        assert len(finer) == 32 * len(fps) == len(set(finer)) and {k >> 21 for k, _ in finer} == {9}
        assert [(b.column(0)[0].as_py(), b.column(1)[0].as_py()) for b in out if b.column(2).null_count] == [(1, 2)]


def test_a_hub_and_a_fingerprint_of_many_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 8)
    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(1000, 1001), (1001, 1002), (2000, 5)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(300)}, 2000: 0, 1000: 1000, 1001: 1000, 1002: 1000}
    rows = [(i, "the same words in very many documents here") for i in range(200, 0, -1)] + [(0, "other words are in this one alone")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(0, 0), *[(i, 1) for i in range(1, 201)]]


def test_documents(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from here"
    rows = [(5, text, "extra"), (3, text.upper(), None), (9, None, "x"), (7, "", "x"), (7, "", "x"), (2, "entirely other words stand in this text", "x"), (None, "alone here", "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    out = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1) for r in got.collect())
    assert out == [(-1, -1), (2, 2), (3, 3), (5, 3), (7, 7), (7, 7), (9, 7)]
    assert {r.fingerprint for r in got.where("doc_id = 7").collect()} == {"0" * 16}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_keeps_columns_of_any_name(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from here"
    rows = [(5, text, 1, 2, 3), (3, text.upper(), 4, 5, 6), (2, "entirely other words stand in this text", 7, 8, 9), (2, "entirely other words stand in this text", 7, 8, 9)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _id int, _hash int, root int"))
    assert sorted(map(tuple, kept.collect())) == [rows[2], rows[1]]
