"""Benchmark decontamination by an FM-index of each shard of the documents.

A shard is a few megabytes of whole documents. Its words become numbers; words
that no test item has can never lie in a match, so they only end a run, and runs
shorter than the shortest test phrase are left out. The shard's suffixes are
sorted, and the Burrows-Wheeler transform is kept as a wavelet matrix, whose ranks
answer how often a word occurs before a row. Backward search narrows each test
phrase, last word first, to its rows; steps back through the transform to the
nearest sampled suffix position locate the occurrences; their spans are merged.

The benchmark reaches the workers in blocks of at most ``BLOCK_BYTES`` of text, in
one block if it is smaller. With more, the documents are kept with a number, read once
a block, and each block's spans are merged by that number.

Defined cases: null or empty texts have no words and no hits; items without words
have no phrase; an item with a null id marks words but is not listed; repeated
items and rows change nothing but the repeated rows' own results, and rows with equal or
null doc_ids each get a row; a text of any length is indexed whole (about 100 bytes for
each of its words that some item has); an empty table gives no rows, an empty benchmark
no hits. Other columns are ignored, whatever their names; of the columns to keep none may
be named n_words, spans or items.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, binary, chunks, cut

#: Words of a test phrase.
WINDOW = 10
#: Bytes of test items handled at once: about so many words / 6 phrases of 100 bytes, so 150 MB.
BLOCK_BYTES = 8 << 20
#: Every so many suffix positions is kept.
SAMPLE = 8
#: a-z, 0-9 and every byte above ASCII are parts of words; all else separates.
WORDS = bytes(LOWER[b] if chr(LOWER[b]) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def phrases_of(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> dict:
    """The test phrases as rows of word numbers (by length), with the items that have each.

    Phrases are arrays, about 100 bytes each; ``items`` are the ids as texts, sorted, and
    those of phrase p are ``which[first[p] : first[p + 1]]``.
    """
    vocabulary: dict[bytes, int] = {}
    numbers = [np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)), np.int32) for _, text in items]
    ids = sorted({item for item, _ in items if item is not None})
    place = {item: i for i, item in enumerate(ids)}
    lengths = sorted({min(window, len(x)) for x in numbers if len(x)})
    found, pairs, base = [], [], 0
    for n in lengths:
        mine = [i for i, x in enumerate(numbers) if min(window, len(x)) == n]
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(numbers[i], n) for i in mine])
        owner = np.repeat([place.get(items[i][0], -1) for i in mine], [len(numbers[i]) - n + 1 for i in mine])
        order = np.lexsort(rows.T[::-1])
        rows, owner = rows[order], owner[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
        found.append(rows[new])
        pairs.append(np.unique(np.stack([base + np.cumsum(new) - 1, owner])[:, owner >= 0], axis=1))
        base += len(found[-1])
    pairs = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    return {
        "id": uuid.uuid4().hex, "vocabulary": vocabulary, "shortest": min(lengths, default=0), "phrases": found,
        "items": ids, "which": pairs[1].astype(np.int32), "first": np.searchsorted(pairs[0], np.arange(base + 1)),
    }


class WaveletMatrix:
    """Ranks of any symbol in a sequence of symbols below 2 ** bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        start, at = np.zeros_like(at), at
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            ones, zeros = self.ones[level], self.zeros[level]
            start = np.where(one, zeros + ones[start], start - ones[start])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - start


class FMIndex:
    """Index of a sequence of word numbers in which 0 separates runs (and ends the sequence)."""

    def __init__(self, sequence: np.ndarray):
        n = len(sequence)
        gaps = np.flatnonzero(sequence == 0)
        # Separators differ from each other, so that a comparison ends at the first.
        rank = sequence + len(gaps)
        rank[gaps] = np.arange(len(gaps))
        size = 1
        order = np.argsort(rank, kind="stable")
        while True:
            ordered = rank[order]
            new = np.concatenate([[0], np.cumsum((ordered[1:] != ordered[:-1]))])
            rank[order] = new
            if new[-1] == n - 1:
                break
            after = np.concatenate([rank[size:], np.full(min(size, n), -1)])[:n]
            combined = rank * (n + 1) + after + 1
            order = np.argsort(combined, kind="stable")
            rank = combined
            size *= 2
        self.suffixes = order
        self.sequence = sequence
        last = sequence[order - 1]
        self.bits = max(1, int(sequence.max()).bit_length())
        self.transform = last
        self.tree = WaveletMatrix(last, self.bits)
        self.first = np.searchsorted(sequence[order], np.arange((1 << self.bits) + 1))
        # A position is sampled at the start of each run and every SAMPLE words of the sequence.
        positions = order
        starts = np.concatenate([[True], sequence[:-1] == 0])
        self.sampled = starts[positions] | (positions % SAMPLE == 0)
        self.sample = np.where(self.sampled, positions, -1)[self.sampled]
        self.sample_at = np.cumsum(self.sampled) - 1
        del self.suffixes

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows low..high-1 of each phrase (a row of word numbers)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.sequence), np.int64)
        live = np.flatnonzero((phrases < (1 << self.bits)).all(axis=1))
        gone = np.ones(len(phrases), bool)
        gone[live] = False
        high[gone] = 0
        for at in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, at]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at these rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        left = np.flatnonzero(~self.sampled[rows])
        while len(left):
            symbol = self.transform[rows[left]]
            rows[left] = self.first[symbol] + self.tree.rank(symbol, rows[left])
            steps[left] += 1
            left = left[~self.sampled[rows[left]]]
        return self.sample[self.sample_at[rows]] + steps


def _runs(ids: np.ndarray, doc_ends: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of known words of at least ``shortest`` in one document: first and last + 1."""
    known = np.zeros(len(ids) + 1, np.int8)
    known[:-1] = ids > 0
    edge = np.diff(known, prepend=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Split runs at the ends of documents.
    inside = doc_ends[(doc_ends > 0) & (doc_ends < len(ids))]
    inside = inside[(ids[inside] > 0) & (ids[inside - 1] > 0)]
    first, last = np.sort(np.concatenate([first, inside])), np.sort(np.concatenate([last, inside]))
    long = last - first >= shortest
    return first[long], last[long]


def _matches(texts: list[bytes], bench: dict) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """Per text: number of words, merged spans (flat: first, last + 1, ...) and items."""
    words: list[bytes] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        mine = words_of(text)
        lengths[i] = len(mine)
        words += mine
    spans: list[list[int]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    ends = np.cumsum(lengths)
    if not bench["shortest"] or not words:
        return lengths, spans, items
    ids = np.fromiter(map(bench["vocabulary"].get, words, repeat(0)), np.int64, len(words))
    del words
    first, last = _runs(ids, np.unique(ends), bench["shortest"])
    if not len(first):
        return lengths, spans, items
    size = last - first
    # The kept runs, each followed by a separator, and where each kept word was.
    new_start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    total = int((size + 1).sum())
    place = np.arange(total) - np.repeat(new_start, size + 1) + np.repeat(first, size + 1)
    sequence = np.where(np.arange(total) == np.repeat(new_start + size, size + 1), 0, ids[np.minimum(place, len(ids) - 1)])
    index = FMIndex(sequence)
    marks = np.zeros(len(ids) + 1, np.int64)
    base, pairs = 0, []
    for phrases in bench["phrases"]:
        low, high = index.search(phrases)
        hit = np.flatnonzero(high > low)
        n = high[hit] - low[hit]
        rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[hit], n)
        at = place[index.locate(rows)] if len(rows) else rows
        np.add.at(marks, at, 1)
        np.add.at(marks, at + phrases.shape[1], -1)
        doc = np.searchsorted(ends, at, side="right")
        pairs.append(np.unique(doc * (1 << 32) + np.repeat(hit + base, n)))
        base += len(phrases)
    covered = np.zeros(len(ids) + 1, np.int8)
    covered[:-1] = np.cumsum(marks)[:-1] > 0
    begins = ends - lengths
    edge = np.diff(covered, prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inside = np.unique(ends[(ends > 0) & (ends < len(ids))])
    inside = inside[(covered[inside] > 0) & (covered[inside - 1] > 0)]
    starts, stops = np.sort(np.concatenate([starts, inside])), np.sort(np.concatenate([stops, inside]))
    for a, b, d in zip(starts.tolist(), stops.tolist(), np.searchsorted(ends, starts, side="right").tolist(), strict=True):
        spans[d] += [a - int(begins[d]), b - int(begins[d])]
    which: list[set[int]] = [set() for _ in texts]
    for pair in np.concatenate(pairs).tolist():
        phrase = pair & 0xFFFFFFFF
        which[pair >> 32].update(bench["which"][bench["first"][phrase] : bench["first"][phrase + 1]].tolist())
    return lengths, spans, [[bench["items"][i] for i in sorted(x)] for x in which]


def _finder(shared, keep: list[str]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for part, texts in chunks(batches):
            lengths, spans, items = _matches(texts, bench)
            columns = [pa.array(lengths), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.record_batch([*[part.column(part.schema.get_field_index(n)) for n in keep], *columns], [*keep, "n_words", "spans", "items"])

    return find


def _merged(spans: Column) -> Column:
    """Union of (first, last) structs as the same structs, in order."""
    start = F.array().cast("array<struct<first:bigint,last:bigint>>")

    def step(done, x):
        top = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (x["first"] <= top["last"])
        both = F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"))
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), start, step)


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Per document: the columns ``keep`` (doc_id), n_words, spans (words first..last-1, merged) and items (ids as text, sorted).

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored.
    """
    keep = keep or ["doc_id"]
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length(F.col("text")) + 24)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    if blocks > 1:
        # Kept with the rows, which are read once a block: a row that is computed again keeps its number.
        rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    carried = keep if blocks == 1 else ["_row"]
    types = ", ".join(f"`{c}` {'binary' if c == 'text' else rows.schema[c].dataType.simpleString()}" for c in carried)
    parts = []
    for block in range(blocks):
        # An item's text stays whole, so a block may exceed the bound by one item.
        mine = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = [(r.item, bytes(r.text)) for r in mine.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).distinct().collect()]
        shared = spark.sparkContext.broadcast(phrases_of(items, window))
        parts.append(binary(rows, *[c for c in carried if c != "text"]).mapInArrow(_finder(shared, carried), f"{types}, n_words long, spans array<bigint>, items array<string>"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans").cast("int") - 2, F.lit(2)), lambda i: F.struct(F.get("spans", i).alias("first"), F.get("spans", i + 1).alias("last")))
    pairs = F.when(F.size("spans") > 0, pairs).otherwise(F.array().cast("array<struct<first:bigint,last:bigint>>"))
    if blocks == 1:
        found = parts[0].withColumn("spans", pairs)
        return found.withColumn("text", F.col("text").cast("string")) if "text" in keep else found
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.withColumn("spans", pairs).groupBy("_row").agg(F.first("n_words").alias("n_words"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.select(*keep, "_row").join(merged, "_row").select(*keep, "n_words", "spans", "items")


def hits(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])


def excise(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of these spans and what stands between them."""
    marked = text.translate(WORDS)
    out, at, word, i = [], 0, 0, 0
    cuts = iter([*spans, None])
    cut = next(cuts)
    begin = None
    for piece in marked.split(b" "):
        if piece:
            if cut and word == cut[0]:
                begin = i
            word += 1
            if cut and word == cut[1]:
                out.append(text[at:begin])
                at, cut = i + len(piece), next(cuts)
        i += len(piece) + 1
    return b"".join([*out, text[at:]])
