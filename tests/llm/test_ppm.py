import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawlix.llm import ppm
from trawlix.llm.common import fold

TEXTS = ["The cat sat on the mat.", "the  cat\tRAN", "", None, "a dog ran on the mat", "Été à la plage", "cat cat cat cat", "the cat sat on the mat.", "zzz qqq 123", "x" * 3000 + " y"]


def plain_ppm(train, texts):
    """Dictionary PPM: contexts of up to ORDER bytes, END as start padding."""
    counts = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    tokens = Counter()
    n_docs = len(train)
    pad = [ppm.END] * ppm.ORDER
    for t in train:
        c = b" ".join((t or "").encode().lower().split()) if not t or t.isascii() else ppm.canonical(t.encode())
        tokens.update(c.split())
        s = pad + list(c) + [ppm.END]
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                counts[k][tuple(s[i - k : i])][s[i]] += 1
    n, v = sum(tokens.values()) + n_docs, len(tokens) + (n_docs > 0)
    out = []
    for t in texts:
        c = ppm.canonical((t or "").encode())
        s = pad + list(c) + [ppm.END]
        total = 0.0
        for i in range(ppm.ORDER, len(s)):
            gone = set()
            for k in range(ppm.ORDER, -1, -1):
                seen = {x: y for x, y in counts[k].get(tuple(s[i - k : i]), {}).items() if x not in gone}
                if not seen:
                    continue
                mass = sum(seen.values())
                if s[i] in seen:
                    total += math.log10((seen[s[i]] - 0.5) / mass)
                    break
                total += math.log10(0.5 * len(seen) / mass)
                gone |= set(seen)
            else:
                total -= math.log10(256 - len(gone))
        words = c.split()
        base = sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words) + math.log10((n_docs + 0.5) / (n + 0.5 * (v + 1)))
        out.append((len(words) + 1, sum(tokens[w] > 0 for w in words) + (n_docs > 0), n, base, total))
    return out


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, score string, held_out int")


@pytest.mark.parametrize("group_bytes, slots, split", [(ppm.GROUP_BYTES, None, ppm.SPLIT), (30, 3, 0.1), (1, 50, 0.5)])
def test_matches_plain_ppm(spark, monkeypatch, group_bytes, slots, split):
    monkeypatch.setattr(ppm, "SPLIT", split)
    held = [3, 5, 8]
    df = docs(spark, TEXTS)
    got = {r.doc_id: r for r in ppm.score_documents(df, F.col("doc_id").isin(held), group_bytes, slots).collect()}
    want = plain_ppm([t for i, t in enumerate(TEXTS) if i not in held], TEXTS)
    assert len(got) == len(TEXTS)
    for i, (n_tokens, n_known, n, base, score) in enumerate(want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n_tokens, n_known, n, i in held)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_probabilities_sum_to_one():
    packed = ppm.Packed([ppm.canonical(t.encode()) for t in TEXTS if t])
    keys, pad = packed.grams(ppm.ORDER, packed.stop)
    k, n = ppm.summed(keys[~pad])
    low, m = ppm.summed(k & np.uint64(0xFFFF), n)
    trie = ppm.Trie(k, n, low, m)
    for context in (b"he ca", b"qqqqq", b"\xff" * 5, b"x the"):
        base = int.from_bytes(context, "big") << 8
        assert np.exp(trie.logs(np.array([base + s for s in range(256)], dtype=np.uint64))).sum() == pytest.approx(1.0)


def test_nothing_to_learn_from_and_no_rows(spark):
    got = ppm.score_documents(docs(spark, ["ab", None]), F.lit(True)).collect()
    assert sorted(round(r.score, 6) for r in got) == sorted(round(-n * math.log10(256), 6) for n in (3, 1))
    assert ppm.score_documents(docs(spark, ["a"]).limit(0), F.lit(False)).count() == 0


def test_repeated_rows_and_null_ids_each_get_a_row(spark):
    texts = ["a cat", "a cat", None, "a cat", "a dog"]
    df = spark.createDataFrame([(7, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[3]), (8, texts[4])], "doc_id long, text string")
    got = sorted((r.score, r.n_tokens) for r in ppm.score_documents(df, F.lit(False), 4, 5).collect())
    want = sorted((score, n) for n, _, _, _, score in plain_ppm(texts, texts))
    assert [n for _, n in got] == [n for _, n in want] and [s for s, _ in got] == pytest.approx([s for s, _ in want])


def test_slots_follow_the_root_of_the_size():
    assert [ppm.slots_for(n) for n in (0, 10**6, 5 * 10**8, 10**14)] == [8, 8, 256, 1 << 14]


def test_slices_do_not_change_scores(spark, monkeypatch):
    packed = ppm.Packed([b" ".join([b"some words that are cut into slices"] * 30), b"", b"more"])
    whole = [packed.words(ppm.ORDER, packed.stop)[1]]
    monkeypatch.setattr(ppm, "SLICE", 64)
    parts = [packed.words(a, b)[1] for a, b in packed.slices()]
    assert len(parts) > 3 and np.array_equal(np.concatenate(parts), whole[0])


def test_fold_is_crc32(spark):
    import zlib

    got = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)
