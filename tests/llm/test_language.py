import random

import numpy as np
from pyspark.sql import functions as F

from trawlix.llm import language

SYLLABLES = {"en": "the th er ing on and".split(), "fr": "le que eau é ou ai".split(), "de": "der sch ung ich ü ei".split(), "ja": "の は を し た に".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_defined_cases(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randint(5, 60)), lang, 0.5) for i, lang in enumerate(sorted(SYLLABLES) * 60)]
    rows += [(1000, None, "en", 0.1), (1001, "", "fr", 0.1), (1002, "123 !!! 45", None, 0.1), (1003, "é", None, 0.1), (1004, text(rng, "de", 30_000), None, 0.1), (1004, "\u00b7\u2026", None, 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = language.identify(df, F.col("doc_id") % 5 != 2, ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.doc_id < 1000 and r.doc_id % 5 == 2]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id, r.text): r.lang_pred for r in got}
    assert [by[(i, t)] for i, t in ((1000, None), (1001, ""), (1002, "123 !!! 45"), (1004, "\u00b7\u2026"))] == ["und"] * 4
    assert by[(1003, "é")] != "und" and by[(1004, rows[-2][1])] == "de"


def plain_features(text):
    line = " ".join("".join(c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in text.translate({b: b + 32 for b in range(65, 91)})).split())
    raw = f" {line} ".encode()
    counts = np.zeros(language.BUCKETS)
    for n in (1, 2, 3):
        for at in range(len(raw) - n + 1):
            code = sum(int(language._CODES[j][raw[at + j]]) for j in range(n))
            counts[((code * 0x9E3779B1) >> 20) % language.BUCKETS] += 1
    return np.sqrt(counts) / np.sqrt(counts.sum())


def plain_decode(model, x):
    bits = [sum(float(a) * float(b) for a, b in zip(x, w, strict=True)) + bias for w, bias in zip(model["weights"].T, model["bias"], strict=True)]
    loss = [sum(t * np.log1p(np.exp(-language.SHARPNESS * b * w)) for t, b, w in zip(trust, bits, word, strict=True)) for trust, word in zip(model["trust"], model["code"], strict=True)]
    share = [np.exp(-language.SHARPNESS * (v - min(loss))) for v in loss]
    return model["languages"][int(np.argmin(loss))], max(share) / sum(share)


TEXTS = ["the cat sat", "Zebra crossing", "", "a", "été 12 là-bas", "xylophone " * 300, "the cat sat", "日本 の は"]


def test_features_are_those_of_the_text_alone():
    together = language.features([t.encode() for t in TEXTS])
    for t, row in zip(TEXTS, together, strict=True):
        assert np.array_equal(language.features([t.encode()])[0], row)
        assert np.allclose(plain_features(t), row, atol=1e-6)


def test_against_plain_decoding_under_any_order(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, lang, rng.randint(1, 30)), lang) for i, lang in enumerate(sorted(SYLLABLES) * 20)]
    schema = "doc_id long, text string, lang string"
    learn = F.col("doc_id") % 4 != 2
    got = [{r.doc_id: (r.lang_pred, r.score, r.ambiguous) for r in language.identify(spark.createDataFrame(x, schema).repartition(n), learn, ["doc_id"]).collect()} for x, n in ((rows, 1), (rows[::-1], 1), (rows, 7))]
    assert got[0] == got[1] == got[2]
    model = language.train(spark.createDataFrame(rows, schema), learn)
    for i, t, _ in rows[:30]:
        name, score = plain_decode(model, plain_features(t))
        assert got[0][i][0] == name and abs(got[0][i][1] - score) < 1e-4


def test_languages_that_tie():
    model = {"languages": ["aa", "bb"], "code": language.codewords(2), "weights": np.zeros((language.BUCKETS, 1)), "bias": np.zeros(1), "trust": np.ones((2, 1))}
    best, score, lead = language.decode(model, language.features([b"x"]))
    assert (best[0], score[0], lead[0]) == (0, 0.5, 0.0)


def test_nothing_learned_and_one_language(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, "a", "xx")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(df, F.lit(False), ["doc_id"]).collect()} == {"und"}
    assert {(r.lang_pred, r.score) for r in language.identify(df, F.lit(True), ["doc_id"]).collect()} == {("xx", 1.0)}
    assert language.identify(df.limit(0), F.lit(True), ["doc_id"]).count() == 0


def test_codes_correct_errors():
    for n in (2, 3, 4, 7, 12):
        code = language.codewords(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= (1 if n == 2 else 2)
    assert min((language.codewords(4)[i] != language.codewords(4)[j]).sum() for i in range(4) for j in range(i)) == 4
