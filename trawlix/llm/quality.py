"""Quality classification by random Fourier features and ridge regression.

Statistics of each whole text (shares of kinds of characters, word and line lengths,
repetition, entropy) are standardised and mapped to ``FEATURES`` random cosines,
whose products approximate a Gaussian kernel. Ridge scores come from the normal
equations: each partition sums its part, a layer of tasks sums the parts, and the
driver adds the few that are left and solves. Training rows that the ridge did not
see set an isotonic calibration, over ``BINS`` bins of the score, that turns
scores into probabilities of a good document.

Defined cases: null and empty texts have all-zero statistics and get a score;
several labels of one document are averaged and null labels are left out; with no
label to learn from, every score is 0.5; with one class it is that class's share
under the calibration's prior. Scores that tie stay tied: a raw score decides alone.
Repeated rows are scored alike, rows with null or equal doc_ids each get a row (a null
doc_id has no label), a text of any length is read whole, and an empty table gives no
rows. Other columns are ignored, whatever their names; of the columns to keep none may
be named stats or score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, chunks, cut

FEATURES = 256
BINS = 400
RIDGE = 1e-3
#: A text is called good from this score on.
THRESHOLD = 0.3
STATS = [
    "log_bytes", "log_words", "word_length", "long_words", "digits", "upper", "lower", "space", "wide", "newline",
    "stops", "commas", "hashes", "percent", "dollar", "ampersand", "star", "bang", "pipe", "quotes", "other_marks",
    "capital_words", "marked_words", "distinct_words", "distinct_lines", "line_words", "byte_entropy", "top_word", "single_words",
]
_KIND = np.zeros(256, np.int64)
for _i, _set in enumerate((b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b" \t\r\x0b\x0c", bytes(range(128, 256)), b"\n", b".;:", b",", b"#", b"%", b"$", b"&", b"*", b"!?", b"|", b"\"'()"), 1):
    _KIND[list(_set)] = _i
N_KINDS = 17
_CAPITAL = bytes(1 if 65 <= b <= 90 else (2 if 97 <= b <= 122 or b >= 128 else 0) for b in range(256))


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATS per text."""
    out = np.zeros((len(texts), len(STATS)))
    for i, text in enumerate(texts):
        if not text:
            continue
        n = len(text)
        by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        kinds = np.bincount(_KIND, by_byte, N_KINDS) / n
        share = by_byte[by_byte > 0] / n
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        w, ln = max(1, len(words)), max(1, len(lines))
        counts: dict[bytes, int] = {}
        for word in words:
            counts[word] = counts.get(word, 0) + 1
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = b"".join([x[-1:] for x in words])
        marked = sum(ends.count(m) for m in (b"#", b"%", b"$", b"&", b"*", b"!", b"|"))
        capital = sum(c for x, c in counts.items() if len(x) > 1 and x.isupper())
        single = sum(1 for c in counts.values() if c == 1)
        out[i] = [
            np.log1p(n), np.log1p(len(words)), sizes.mean() if len(sizes) else 0, (sizes > 12).mean() if len(sizes) else 0,
            *kinds[1:7], *kinds[7:17], kinds[0],
            capital / w, marked / w, len(counts) / w, len(set(lines)) / ln, np.log1p(w / ln), -(share * np.log(share)).sum(), max(counts.values(), default=0) / w, single / w,
        ]
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches):
        names = [n for n in part.schema.names if n != "text"]
        yield pa.record_batch([*[part.column(part.schema.get_field_index(n)) for n in names], pa.array(list(statistics(texts)), pa.list_(pa.float64()))], [*names, "stats"])


class Kernel:
    """Standardises statistics and maps them to random cosines."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        width = np.sqrt(len(mean))
        self.directions = rng.standard_normal((len(mean), features - 1)) / width
        self.shift = rng.uniform(0, 2 * np.pi, features - 1)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.deviation, -8, 8)
        cosines = np.cos(z @ self.directions + self.shift) * np.sqrt(2 / self.directions.shape[1])
        return np.hstack([cosines, np.ones((len(z), 1))])


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().reshape(-1, len(STATS))


def _equations(shared):
    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, total = shared.value, 0
        for batch in batches:
            if batch.num_rows:
                x, y = kernel(_rows(batch, "stats")), batch.column(batch.schema.get_field_index("y")).to_numpy()
                total = total + x.T @ np.hstack([x, y[:, None]])
        if not np.isscalar(total):
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["part"])

    return equations


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for part in batch.column(0):
            m = np.frombuffer(part.as_buffer(), np.float64)
            total = m.copy() if total is None else total + m
    if total is not None:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["part"])


def _binned(shared):
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, weights = shared.value
        n, good = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if batch.num_rows:
                at = bin_of(kernel(_rows(batch, "stats")) @ weights)
                n += np.bincount(at, minlength=BINS)
                good += np.bincount(at, batch.column(batch.schema.get_field_index("y")).to_numpy(), BINS)
        yield pa.record_batch([pa.array(np.arange(BINS)), pa.array(n), pa.array(good)], ["bin", "n", "good"])

    return binned


def bin_of(raw: np.ndarray) -> np.ndarray:
    """Bins of equal width over raw scores from -0.5 to 1.5."""
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def isotonic(n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: bin centres and non-decreasing shares, one knot per pooled block."""
    prior = (good.sum() + 0.5) / (n.sum() + 1)
    blocks: list[list[float]] = []  # weight, sum, weighted bins
    for at in np.flatnonzero(n):
        blocks.append([n[at], good[at], n[at] * at])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    if not blocks:
        return np.array([0.0]), np.array([prior])
    return np.array([b[2] / b[0] for b in blocks]), np.array([(b[1] + prior) / (b[0] + 1) for b in blocks])


def apply(model: tuple | None, stats: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(stats), 0.5)
    kernel, weights, knots, shares = model
    at = np.clip((kernel(stats) @ weights + 0.5) / 2 * BINS, 0, BINS)
    return np.clip(np.interp(at, knots, shares), 0.0, 1.0)


def _score_texts(shared, keep: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            p = apply(shared.value, statistics(texts))
            yield pa.record_batch([*[part.column(part.schema.get_field_index(n)) for n in keep], pa.array(p)], [*keep, "score"])

    return score


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            p = apply(model, _rows(batch, "stats"))
            names = [n for n in batch.schema.names if n != "stats"]
            yield pa.record_batch([*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(p)], [*names, "score"])

    return score


def fit(labelled: DataFrame) -> tuple | None:
    """A model from rows of stats, y and calibrate (boolean: kept from the ridge for the calibration)."""
    spark = labelled.sparkSession
    ridge = labelled.where("not calibrate")
    moments = [f(F.get("stats", F.lit(i))).alias(f"{k}{i}") for i in range(len(STATS)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    sums = ridge.agg(F.count("*").alias("n"), *moments).first()
    if not sums.n:
        return None
    kernel = Kernel(np.array([sums[f"m{i}"] for i in range(len(STATS))]), np.array([sums[f"s{i}"] for i in range(len(STATS))]))
    shared = spark.sparkContext.broadcast(kernel)
    parts = ridge.select("stats", "y").mapInArrow(_equations(shared), "part binary")
    # Partition sums are summed by about as many tasks as the root of their number.
    layer = max(1, int(np.sqrt(ridge.rdd.getNumPartitions())))
    totals = parts.repartition(layer).mapInArrow(_add, "part binary").toArrow()["part"]
    total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in totals).reshape(FEATURES, FEATURES + 1)
    gram, right = total[:, :-1], total[:, -1]
    weights = np.linalg.solve(gram + RIDGE * sums.n / 10 * np.eye(FEATURES), right)
    fitted = spark.sparkContext.broadcast((kernel, weights))
    binned = labelled.where("calibrate").select("stats", "y").mapInArrow(_binned(fitted), "bin long, n double, good double")
    bins = binned.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect()
    n, good = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        n[r.bin], good[r.bin] = r.n, r.good
    knots, shares = isotonic(n, good)
    return kernel, weights, knots + 0.5, shares


def _joined(stats: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y")).select(F.col("doc_id").alias("_id"), "y")
    return cut(stats.where("_learn").select("_id", "stats", F.col("_calibrate").alias("calibrate")).join(known, "_id"))


def score(docs: DataFrame, labels: DataFrame, learn: Column, calibrate: Column, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each document and its score.

    docs: doc_id, text. labels: doc_id, quality (0 or 1). learn: rows to learn from;
    calibrate: those of them that set the calibration. Statistics are kept between
    learning and scoring, but with ``text`` among ``keep`` they are found twice, so
    that texts need not be kept with them.
    """
    others = [c for c in keep if c != "text"]
    types = ", ".join(f"`{c}` {'binary' if c == 'text' else docs.schema[c].dataType.simpleString()}" for c in keep)
    plain = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    source = docs.select(*others, learn.alias("_learn"), calibrate.alias("_calibrate"), F.col("doc_id").alias("_id"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = lambda s: binary(s, *[c for c in s.columns if c != "text"])
    own = f"_learn boolean, _calibrate boolean, _id {id_type}, stats array<double>"
    if "text" in keep:
        learned = source.where("_learn").select("_learn", "_calibrate", "_id", "text")
        labelled = _joined(found(learned).mapInArrow(_statistics, own), labels)
        shared = docs.sparkSession.sparkContext.broadcast(fit(labelled))
        scored = binary(docs, *others).mapInArrow(_score_texts(shared, keep), f"{types}, score double")
        return scored.withColumn("text", F.col("text").cast("string"))
    stats = cut(found(source).mapInArrow(_statistics, plain + own))
    shared = docs.sparkSession.sparkContext.broadcast(fit(_joined(stats, labels)))
    return stats.select(*others, "stats").mapInArrow(_score(shared), f"{plain}score double")
