"""Language identification by error-correcting output codes.

Each learned language has a codeword. For every bit of the words, a binary linear
classifier over hashed byte n-grams predicts the bit of a text's language. Decoding
sums a logistic loss per bit, weighted by how well that bit's classifier did on
each language in training, and takes the language of least loss. The score is the
share of that language among exp(-loss); texts whose two best languages are closer
than ``MARGIN`` are flagged as ambiguous.

Up to seven languages get the exhaustive code; more get a random code, the best of
many by least distance. Classifiers are ridge regressions on at most
``TRAIN_ROWS`` labelled texts, the same number per language, chosen by a hash of
doc_id and text. N-grams are counted over whole texts.

Defined cases: a null text or one without a letter is ``und`` with score 0; with
no labelled text all are ``und``; with one language all texts with letters get it;
of languages that tie the first by code point wins, and the text is ambiguous. A
text's result depends on no other row of its table beyond the fit: repeated rows are
predicted alike, rows with null or equal doc_ids each get a row, a text of any length
is read whole (its memory follows its length), and an empty table gives no rows. A
null lang is not learned from. Other columns are ignored, whatever their names; of
the columns to keep none may be named lang_pred, score or ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, binary, chunks

#: Hashed n-gram features.
BUCKETS = 2048
#: Labelled texts the classifiers are fitted on, over all languages.
TRAIN_ROWS = 4000
#: Parts of a language that offer training texts, each the same number.
SALTS = 250
RIDGE = 0.02
SHARPNESS = 4.0
MARGIN = 0.05
UNDETERMINED = "und"
#: Letters stay, lower-cased; bytes above ASCII are parts of letters; all else is a space.
LETTERS = bytes(LOWER[b] if chr(LOWER[b]) in "abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else 0x20 for b in range(256))
_CODES = np.random.default_rng(5).integers(1, 2**31, (3, 256), dtype=np.int64)


def has_letter(text: bytes) -> bool:
    ascii_part = text.translate(LETTERS).replace(b" ", b"")
    if not ascii_part:
        return False
    if not ascii_part.isascii() and not any(b < 0x80 for b in ascii_part):
        return any(c.isalpha() for c in text.decode("utf-8", "replace"))
    return True


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text: square roots of hashed 1-, 2- and 3-gram counts, of length one."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    cleaned = [b" " + b" ".join(t.translate(LETTERS).split()) + b" " for t in texts]
    at = 0
    while at < len(cleaned):
        to, size = at, 0
        while to < len(cleaned) and (to == at or (size + len(cleaned[to]) <= 1 << 20 and to - at < 512)):
            size += len(cleaned[to])
            to += 1
        raw = np.frombuffer(b"".join(cleaned[at:to]), np.uint8)
        sizes = np.array([len(c) for c in cleaned[at:to]])
        base = np.repeat(np.arange(to - at, dtype=np.int64) * BUCKETS, sizes)
        ends = np.cumsum(sizes)
        counts = np.zeros((to - at) * BUCKETS, np.float32)
        code = np.zeros(len(raw), np.int64)
        for n in range(3):
            code[: len(raw) - n] += _CODES[n][raw[n:]]
            bucket = base + ((code * 0x9E3779B1) >> 20) % BUCKETS
            counts += np.bincount(bucket, minlength=len(counts))
            # A gram lies in one text: those that begin in the last n bytes of a text (each has two or more) run over its end.
            np.subtract.at(counts, bucket[(ends[:, None] - np.arange(1, n + 1)).ravel()], 1)
        out[at:to] = np.sqrt(counts.reshape(-1, BUCKETS))
        at = to
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        columns = np.arange(1, 2 ** (n - 1))
        bits = (columns[None, :] >> np.arange(n - 1)[:, None]) & 1
        return np.vstack([np.ones((1, len(columns))), 1 - 2 * bits]).astype(float)
    rng, width, best, far = np.random.default_rng(n), 10 * int(np.ceil(np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        gap = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * width).min()
        if gap > far:
            best, far = code, gap
    return best


def fit(x: np.ndarray, labels: list[str]) -> dict:
    languages = sorted(set(labels), key=lambda s: s.encode())
    which = np.array([languages.index(s) for s in labels])
    code = codewords(len(languages))
    if len(languages) < 2:
        return {"languages": languages, "code": code}
    share = 1.0 / np.bincount(which)[which]
    share /= share.mean()
    mean = np.average(x, axis=0, weights=share)
    y = code[which]
    bias = np.average(y, axis=0, weights=share)
    gram = RIDGE * len(x) / x.shape[1] * np.eye(x.shape[1])
    moment = np.zeros((x.shape[1], y.shape[1]))
    for at in range(0, len(x), 256):
        block = (x[at : at + 256] - mean) * np.sqrt(share[at : at + 256, None])
        gram += block.T @ block
        moment += block.T @ ((y[at : at + 256] - bias) * np.sqrt(share[at : at + 256, None]))
    weights = np.linalg.solve(gram, moment)
    right = ((x @ weights + (bias - mean @ weights)) * y > 0).astype(float)
    trust = np.stack([(right[which == i].sum(axis=0) + 0.5) / ((which == i).sum() + 1) for i in range(len(languages))])
    trust /= trust.sum(axis=1, keepdims=True)
    return {"languages": languages, "code": code, "weights": weights, "bias": bias - mean @ weights, "trust": trust}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language (number), its score, and the lead over the second best."""
    if len(model["languages"]) < 2:
        return np.zeros(len(x), np.int64), np.ones(len(x)), np.ones(len(x))
    bits = x @ model["weights"] + model["bias"]
    loss = np.stack([np.logaddexp(0, -SHARPNESS * bits * word) @ trust for word, trust in zip(model["code"], model["trust"], strict=True)], axis=1)
    p = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
    # Rounded, as the last digits of a matrix product depend on the rows beside it.
    p = np.round(p / p.sum(axis=1, keepdims=True), 9)
    order = np.sort(p, axis=1)
    return p.argmax(axis=1), order[:, -1], order[:, -1] - order[:, -2]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches):
        yield pa.record_batch([part.column(0), pa.array(list(features(texts)), pa.list_(pa.float32()))], ["lang", "x"])


def _identify(shared, keep: list[str]):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model["languages"], UNDETERMINED], dtype=object)
        for part, texts in chunks(batches):
            kept = [part.column(part.schema.get_field_index(name)) for name in keep]
            letters = np.array([has_letter(t) for t in texts])
            if model["languages"]:
                best, score, lead = decode(model, features(texts))
            else:
                best, score, lead = (np.zeros(len(texts), np.int64) for _ in range(3))
            known = letters & (len(model["languages"]) > 0)
            best = np.where(known, best, len(names) - 1)
            added = [pa.array(names[best].tolist(), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(known & (lead < MARGIN))]
            yield pa.record_batch([*kept, *added], [*keep, "lang_pred", "score", "ambiguous"])

    return identify


def train(docs: DataFrame, learn: Column, rows: int = TRAIN_ROWS) -> dict:
    """A model from the texts and non-null langs of the rows where ``learn`` holds."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = labelled.select("lang").distinct().count()
    if not n:
        return {"languages": []}
    # Each of SALTS parts of a language gives its share, so that no task ranks a whole language.
    chosen = Window.partitionBy("lang", F.pmod("_pick", F.lit(SALTS))).orderBy("_pick", "doc_id")
    share = -(-max(20, rows // n) // SALTS)
    # The choice is made without the texts; they are read again for the chosen rows only.
    keyed = labelled.select("doc_id", "lang", F.xxhash64(F.col("doc_id"), F.length("text"), F.lit(7)).alias("_pick"))
    picks = keyed.withColumn("_n", F.row_number().over(chosen)).where(F.col("_n") <= share).select("doc_id", "lang", "_pick").distinct()
    full = labelled.withColumn("_pick", F.xxhash64(F.col("doc_id"), F.length("text"), F.lit(7)))
    # At most TRAIN_ROWS rows of ids.
    texts = full.join(F.broadcast(picks), ["doc_id", "lang", "_pick"], "left_semi")
    found = binary(texts, "lang").mapInArrow(_features, "lang string, x array<float>").toArrow()
    names = found["lang"].to_pylist()
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, BUCKETS)
    order = np.lexsort((x[:, :8].sum(axis=1), np.array(names)))
    return fit(x[order], [names[i] for i in order])


def identify(docs: DataFrame, learn: Column, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each document, and lang_pred, score and ambiguous.

    docs: doc_id, text, lang and others. learn: boolean, the rows to learn from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, learn))
    types = ", ".join(f"`{c}` {'binary' if c == 'text' else docs.schema[c].dataType.simpleString()}" for c in keep)
    others = [c for c in keep if c != "text"]
    found = binary(docs, *others).mapInArrow(_identify(shared, keep), f"{types}, lang_pred string, score double, ambiguous boolean")
    return found.withColumn("text", F.col("text").cast("string")) if "text" in keep else found
