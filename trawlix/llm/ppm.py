"""Language-model scoring by prediction by partial matching (PPM).

The model is a trie of byte contexts up to ``ORDER`` bytes. A symbol's
probability comes from the longest context that has seen it; each context that
has not seen it costs an escape (half a count per distinct symbol), and symbols
that the longer context offered are excluded from the shorter ones. Order -1
spreads the rest evenly over symbols never seen. The code length of a text is
the sum over its bytes and one end symbol, so scores are log probabilities of
the whole text: its lower-cased words joined by single spaces, then the end.

No task and no worker ever holds the model. Texts are dealt to groups of about
``GROUP_BYTES`` where they are read, and kept (checkpointed) with their group's
number, packed in runs. Each group lists its distinct byte windows and words with their training
counts, packed (steps of the sorted keys, compressed) by slot: a slot is a hash of a window's last two context bytes, or
of a word. Counts are merged by slot in two layers, so that a slot with rows of
very many groups is split. Each slot's table then meets the groups' windows of
that slot, its rows copied over as many parts as the windows outnumber the table,
and answers them with log probabilities; the answers meet the texts by group.
Shuffles follow the input, whatever the size of the model: the texts once and each
group's distinct windows three times. Only the counts of byte pairs (at most 65,536)
reach the driver. A task holds one slot's table or one group's answers.

Defined cases: a null or empty text is the end symbol alone; an empty training
set predicts every symbol by 1/256; an empty table gives no rows; repeated rows
each get their own row, as do rows with equal or null doc_ids (a null doc_id counts
as a training row); a text of any length is scored whole, and one longer than
``GROUP_BYTES`` is a group of its own; other columns, of whatever names, are ignored.
Words are known by a 64-bit hash. There are no ties to settle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, binary, chunks, cut

ORDER = 5
#: Bytes of text that share one list of windows.
GROUP_BYTES = 16 << 20
#: How often a group's windows may outnumber a slot's table before the slot is split.
SPLIT = 4
#: Tasks of a shuffle at most; beyond as many groups, a task holds several, one after the other.
MOST_TASKS = 100_000
#: Kinds of packed rows: byte windows, words, training documents, listed windows; texts.
WINDOW, WORD, DOCS, LISTED, TEXT = range(5)
#: Never occurs in UTF-8: pads contexts before a text and ends it.
END = 0xFF
#: Positions scored at once, and distinct windows that a counting task holds before it merges them.
SLICE = 1 << 18
HELD = 1_500_000

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_BASE = _U(0xD6E8FEB86659FD93)
_BASE_INV = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BREAK = re.compile(rb"[\x20\xff]")
_BYTES = np.random.default_rng(42).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def canonical(text: bytes) -> bytes:
    return b" ".join(text.translate(LOWER).split())


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE + 4096)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


class Packed:
    """Canonical texts laid end to end, ORDER end bytes before and after each."""

    def __init__(self, docs: list[bytes]):
        pad = bytes([END]) * ORDER
        self.buf = pad + b"".join(d + pad for d in docs) + b"\xff" * 8
        self.lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        self.starts = ORDER + np.concatenate([[0], np.cumsum(self.lengths + ORDER)[:-1]]) if docs else np.zeros(0, np.int64)
        self.stop = len(self.buf) - 8

    def slices(self, size: int = 0) -> Iterator[tuple[int, int]]:
        """Spans of the buffer that end at a separator, so that no word is cut."""
        at = ORDER
        while at < self.stop:
            to = min(at + (size or SLICE), self.stop)
            if to < self.stop:
                to = min(_BREAK.search(self.buf, to).end(), self.stop)
            yield at, to
            at = to

    def grams(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """For positions a..b-1: the ORDER bytes before and the byte itself as one number; which positions are padding."""
        view = np.ndarray((b - a,), ">u8", self.buf, offset=a - ORDER, strides=(1,))
        keys = view.astype(np.uint64) >> _U(8 * (7 - ORDER))
        both = keys & _U(0xFFFF)
        padding = both == _U(0xFFFF)
        empty = self.starts[(self.lengths == 0) & (self.starts >= a) & (self.starts < b)]
        padding[empty - a] = False
        return keys, padding

    def words(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and hashes of the words that lie in a..b-1."""
        raw = np.frombuffer(self.buf, np.uint8, b - a, a)
        inner = (raw != 32) & (raw != END)
        edge = np.diff(inner.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _power(b - a + 1)
        total = np.empty(b - a + 1, np.uint64)
        total[0] = 0
        np.add.accumulate(_BYTES[raw] * up[: b - a], out=total[1:])
        hashes = (total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)
        hashes ^= hashes >> _U(29)
        return first + a, hashes * _MULT


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their summed counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Tally:
    """Distinct keys and their summed counts, merged as they come."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.rows += len(keys)
        if self.rows > HELD and len(self.parts) > 1:
            self.parts = [self.total()]
            self.rows = min(len(self.parts[0][0]), HELD // 2)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts])) if len(self.parts) > 1 else self.parts[0]


def _grouped(group_bytes: int):
    """Rows of doc_id, held_out and text -> runs of them, in the order they are read: their group, ids, marks and packed canonical texts."""

    def run(g: int, part: pa.RecordBatch, docs: list[bytes]) -> pa.RecordBatch:
        ends = pa.array([0, len(docs)], pa.int32())
        ids, held = (pa.ListArray.from_arrays(ends, part.column(i)) for i in (0, 1))
        sizes = pa.ListArray.from_arrays(ends, pa.array([len(d) for d in docs], pa.int64()))
        return pa.record_batch([pa.array([g], pa.int64()), ids, held, sizes, pa.array([zstandard.compress(b"".join(docs), 1)], pa.binary())], ["g", "ids", "held", "sizes", "text"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        for part, texts in chunks(batches):
            docs = [canonical(t) for t in texts]
            begin = 0
            for i, d in enumerate(docs):
                if size and size + len(d) > group_bytes:
                    if i > begin:
                        yield run(number, part.slice(begin, i - begin), docs[begin:i])
                    number, size, begin = number + 1, 0, i
                size += len(d) + 1
            yield run(number, part.slice(begin), docs[begin:])

    return group


def _texts(sizes: list[int], packed: bytes) -> list[bytes]:
    whole, ends = zstandard.decompress(packed), np.cumsum([0, *sizes]).tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _slots(kind: int, keys: np.ndarray, slots: int) -> np.ndarray:
    mixed = ((keys >> _U(8)) & _U(0xFFFF)) * _MULT >> _U(40) if kind == WINDOW else keys
    return (mixed % _U(slots)).astype(np.int64)


PACKED = "kind int, slot int, g long, keys binary, counts binary"


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes: all first bytes, then all second bytes, and so on."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def unpack(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as their steps, which take few bytes each."""
    return pack(np.diff(keys, prepend=_U(0)))


def unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, np.uint64), dtype=np.uint64)


def _packed(rows: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    kind, slot, g, keys, counts = zip(*rows, strict=True)
    return pa.record_batch(
        [pa.array(kind, pa.int32()), pa.array(slot, pa.int32()), pa.array(g, pa.int64()), pa.array(map(pack_keys, keys), pa.binary()), pa.array(map(pack, counts), pa.binary())],
        ["kind", "slot", "g", "keys", "counts"],
    )


def _list(slots: int):
    """Runs of one group after the other -> the group's packed windows and words, with training counts."""

    def close(g: int, tallies: tuple[_Tally, _Tally], docs: int) -> pa.RecordBatch:
        rows = []
        for kind, tally in zip((WINDOW, WORD), tallies, strict=True):
            keys, counts = tally.total()
            slot = _slots(kind, keys, slots)
            order = np.argsort(slot, kind="stable")
            keys, counts, slot = keys[order], counts[order].astype(np.int64), slot[order]
            bounds = np.flatnonzero(np.diff(slot)) + 1
            for k, c, at in zip(np.split(keys, bounds), np.split(counts, bounds), np.concatenate([[0], bounds]), strict=True):
                if len(k):
                    rows.append((kind, int(slot[at]), g, k, c))
            if kind == WINDOW:
                rows.append((LISTED, 0, g, np.zeros(1, np.uint64), np.array([len(keys)])))
        rows.append((DOCS, 0, g, np.zeros(1, np.uint64), np.array([docs])))
        return _packed(rows)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tallies, docs = None, (_Tally(), _Tally()), 0
        for batch in batches:
            for g, held, sizes, packed_texts in zip(*(batch.column(i) for i in range(4)), strict=True):
                g = g.as_py()
                if now is not None and g != now:
                    yield close(now, tallies, docs)
                    tallies, docs = (_Tally(), _Tally()), 0
                now = g
                held, texts = held.as_py(), _texts(sizes.as_py(), packed_texts.as_buffer())
                for learn in (True, False):
                    mine = [t for t, h in zip(texts, held, strict=True) if bool(h) != learn]
                    if not mine:
                        continue
                    docs += learn * len(mine)
                    packed = Packed(mine)
                    for a, b in packed.slices(2 * SLICE):
                        keys, padding = packed.grams(a, b)
                        for tally, found in zip(tallies, (keys[~padding], packed.words(a, b)[1]), strict=True):
                            distinct, counts = np.unique(found, return_counts=True)
                            tally.add(distinct, counts * learn)
        if now is not None:
            yield close(now, tallies, docs)

    return listed


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by kind and slot -> one row each, of keys that occur in training."""
    now, tally = None, _Tally()
    for batch in batches:
        kinds, slots, packed_keys, packed_counts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4)
        for i, here in enumerate(zip(kinds, slots, strict=True)):
            if here != now:
                if now is not None:
                    yield _packed([(*now, -1, *tally.total())])
                now, tally = here, _Tally()
            counts = unpack(packed_counts[i].as_buffer(), np.int64)
            seen = counts > 0
            tally.add(unpack_keys(packed_keys[i].as_buffer())[seen], counts[seen])
    if now is not None:
        yield _packed([(*now, -1, *tally.total())])


def _low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed windows -> counts of their last two bytes."""
    totals = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for k, c in zip(batch.column(0), batch.column(1), strict=True):
            np.add.at(totals, (unpack_keys(k.as_buffer()) & _U(0xFFFF)).astype(np.int64), unpack(c.as_buffer(), np.int64))
    pairs = np.flatnonzero(totals)
    yield pa.record_batch([pa.array(pairs), pa.array(totals[pairs])], ["pair", "n"])


class Index:
    """A static map from 64-bit keys to positions, by buckets of their hashes."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, int(len(keys)).bit_length())
        self.shift = _U(64 - bits)
        slot = (keys * _MULT) >> self.shift
        self.order = np.argsort(slot, kind="stable")
        slot = slot[self.order]
        self.first = np.searchsorted(slot, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.keys = np.append(keys[self.order], _U(2**64 - 1))

    def find(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions among the ordered keys, and which queries were found."""
        slot = ((q * _MULT) >> self.shift).astype(np.int32)
        at = self.first[slot]
        hit = self.keys[at] == q
        hit &= at < len(self.keys) - 1
        left = np.flatnonzero(~hit)
        if len(left):
            end = self.first[slot[left] + 1]
            at_left, q_left = at[left] + 1, q[left]
            while True:
                more = at_left < end
                left, end, at_left, q_left = left[more], end[more], at_left[more], q_left[more]
                if not len(left):
                    break
                same = self.keys[at_left] == q_left
                at[left[same]] = at_left[same]
                hit[left[same]] = True
                at_left = np.where(same, end, at_left + 1)
        return at, hit


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], first


class Trie:
    """Escape and symbol probabilities (natural logs) of one block of contexts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low_keys: np.ndarray, low_counts: np.ndarray):
        """keys: windows of ORDER + 1 bytes of this block; low_keys: all windows of two bytes."""
        levels: dict[int, tuple[np.ndarray, np.ndarray]] = {1: summed(low_keys, low_counts)}
        levels[0] = summed(levels[1][0] & _U(0xFF), levels[1][1])
        levels[ORDER] = summed(keys, counts)
        for k in range(ORDER - 1, 1, -1):
            levels[k] = summed(levels[k + 1][0] & _U((1 << (8 * (k + 1))) - 1), levels[k + 1][1])
        symbol_keys, plain, raw, context_keys, escape, below, below_escape = [], [], [], [], [], [], []
        seen = len(levels[0][0])
        for k in range(ORDER + 1):
            grams, n = levels[k]
            n = n.astype(np.float64)
            contexts, first = _runs(grams >> _U(8))
            size = np.diff(np.append(first, len(grams)))
            total = np.add.reduceat(n, first) if len(first) else np.zeros(0)
            tag = _U(k << 56)
            symbol_keys.append(grams | tag)
            raw.append(np.log(n - 0.5).astype(np.float32))
            plain.append((np.log(n - 0.5) - np.repeat(np.log(total), size)).astype(np.float32))
            context_keys.append(contexts | tag)
            escape.append(np.log(0.5 * size / total).astype(np.float32))
            if k == 0:
                # Below order 0 is order -1: the symbols never seen share it evenly.
                below.append(np.full(len(contexts), np.log(max(1, 256 - seen)), np.float32))
                below_escape.append(np.zeros(len(contexts), np.float32))
                continue
            lower, m = levels[k - 1]
            lower_contexts, lower_first = _runs(lower >> _U(8))
            lower_total = np.add.reduceat(m.astype(np.float64), lower_first) if len(lower_first) else np.zeros(0)
            lower_size = np.diff(np.append(lower_first, len(lower)))
            offered = m[np.searchsorted(lower, grams & _U((1 << (8 * k)) - 1))].astype(np.float64) if len(grams) else np.zeros(0)
            at = np.searchsorted(lower_contexts, contexts & _U((1 << (8 * (k - 1))) - 1))
            rest = lower_total[at] - (np.add.reduceat(offered, first) if len(first) else 0) if len(contexts) else np.zeros(0)
            rest_size = lower_size[at] - size if len(contexts) else np.zeros(0)
            some = rest_size > 0
            below.append(np.log(np.where(some, rest, 1.0)).astype(np.float32))
            below_escape.append(np.where(some, np.log(0.5 * np.where(some, rest_size, 1) / np.where(some, rest, 1.0)), 0.0).astype(np.float32))
        del levels, grams, n
        none = np.zeros(1, np.float32)
        self.symbols = Index(np.concatenate(symbol_keys))
        del symbol_keys
        self.plain, self.raw = (np.append(np.concatenate(x)[self.symbols.order], none) for x in (plain, raw))
        del plain, raw
        self.contexts = Index(np.concatenate(context_keys))
        self.escape, self.below, self.below_escape = (np.append(np.concatenate(x)[self.contexts.order], none) for x in (escape, below, below_escape))
        self.symbols.order = self.contexts.order = None

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """Natural log probability of each window's last byte after its context."""
        at, hit = self.symbols.find(keys | _U(ORDER << 56))
        out = np.where(hit, self.plain[at], 0.0)
        left = np.flatnonzero(~hit)
        excluded = np.zeros(len(left), bool)
        share, leave = np.zeros(len(left)), np.zeros(len(left))
        for k in range(ORDER, -1, -1):
            q = keys[left] & _U((1 << (8 * (k + 1))) - 1)
            if k < ORDER:
                at, hit = self.symbols.find(q | _U(k << 56))
                out[left[hit]] += np.where(excluded[hit], self.raw[at[hit]] - share[hit], self.plain[at[hit]])
                left, q, excluded, leave, share = left[~hit], q[~hit], excluded[~hit], leave[~hit], share[~hit]
            at, hit = self.contexts.find((q >> _U(8)) | _U(k << 56))
            out[left] += np.where(excluded, leave, np.where(hit, self.escape[at], 0.0))
            excluded = hit
            share, leave = self.below[at], self.below_escape[at]
        out[left] -= np.where(excluded, share, np.log(256.0))
        return out


def _answer(shared):
    """Rows sorted by kind, slot and group, each slot's table (g: -1) first -> values of each group's keys."""

    def values(kind: int, table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, low: tuple[np.ndarray, np.ndarray], built: list) -> np.ndarray:
        if kind == WINDOW:
            if not built:
                built.append(Trie(*table, *low))
            return built[0].logs(keys).astype(np.float32)
        if not len(table[0]):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return np.where(table[0][at] == keys, table[1][at], 0).astype(np.float64)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = shared.value
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        now, table, built = None, none, []
        for batch in batches:
            kinds, slots, groups = (batch.column(i).to_pylist() for i in range(3))
            packed_keys, packed_counts = batch.column(3), batch.column(4)
            at, out = 0, []
            while at < len(kinds):
                here = kinds[at], slots[at]
                if here != now:
                    now, table, built = here, none, []
                if groups[at] == -1:
                    table, built = (unpack_keys(packed_keys[at].as_buffer()), unpack(packed_counts[at].as_buffer(), np.int64)), []
                    at += 1
                    continue
                to = at
                while to < len(kinds) and (kinds[to], slots[to]) == here and groups[to] != -1:
                    to += 1
                keys = [unpack_keys(packed_keys[i].as_buffer()) for i in range(at, to)]
                found = values(here[0], table, np.concatenate(keys), low, built)
                parts = np.split(found, np.cumsum([len(k) for k in keys])[:-1])
                out += [(groups[at + i], here[0], packed_keys[at + i].as_py(), pack(parts[i])) for i in range(to - at)]
                at = to
            if out:
                g, kind, k, v = zip(*out, strict=True)
                yield pa.record_batch([pa.array(g, pa.int64()), pa.array(kind, pa.int32()), pa.array(k, pa.binary()), pa.array(v, pa.binary())], ["g", "kind", "text", "counts"])

    return answer


class _Answers:
    """The values of one group's keys of one kind."""

    def __init__(self, rows: list[tuple[bytes, bytes]], kind: type):
        self.index = Index(np.concatenate([unpack_keys(k) for k, _ in rows] or [np.zeros(0, np.uint64)]))
        self.values = np.append(np.concatenate([unpack(v, kind) for _, v in rows] or [np.zeros(0, kind)])[self.index.order], kind(0))
        self.index.order = None

    def of(self, keys: np.ndarray) -> np.ndarray:
        at, hit = self.index.find(keys)
        if not hit.all():
            raise RuntimeError("a text's windows and its group's list differ")
        return self.values[at]


def _score(docs: list[bytes], logs: _Answers, counts: _Answers) -> tuple[np.ndarray, ...]:
    """Per text: words, known words, sum of log10(count + 0.5) over words, natural log probability."""
    packed = Packed(docs)
    score, base, known = (np.zeros(len(docs)) for _ in range(3))
    n_words = np.zeros(len(docs), np.int64)
    for a, b in packed.slices():
        keys, padding = packed.grams(a, b)
        found = np.zeros(b - a)
        found[~padding] = logs.of(keys[~padding])
        d0 = max(0, int(np.searchsorted(packed.starts, a, side="right")) - 1)
        d1 = int(np.searchsorted(packed.starts, b))
        score[d0:d1] += np.add.reduceat(found, np.maximum(packed.starts[d0:d1], a) - a)
        starts, hashes = packed.words(a, b)
        doc = np.searchsorted(packed.starts, starts, side="right") - 1
        n_words += np.bincount(doc, minlength=len(docs))
        n = counts.of(hashes)
        base += np.bincount(doc, np.log10(n + 0.5), len(docs))
        known += np.bincount(doc, n > 0, len(docs))
    return n_words, known, base, score


def _finish(tokens: int, distinct: int, docs: int):
    """Rows sorted by group and kind (answers, then texts) -> scores."""
    floor = tokens + 0.5 * (distinct + 1)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, answers = None, {WINDOW: [], WORD: []}, None
        for batch in batches:
            packed, values = batch.column(5), batch.column(6)
            for i, (g, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if g != now:
                    now, rows, answers = g, {WINDOW: [], WORD: []}, None
                if kind != TEXT:
                    rows[kind].append((packed[i].as_py(), values[i].as_py()))
                    continue
                if answers is None:
                    answers = _Answers(rows[WINDOW], np.float32), _Answers(rows[WORD], np.float64)
                    rows = {WINDOW: [], WORD: []}
                n_words, known, base, score = _score(_texts(batch.column(4)[i].as_py(), packed[i].as_buffer()), *answers)
                base += np.log10(docs + 0.5) - (n_words + 1) * np.log10(floor)
                yield pa.record_batch(
                    [batch.column(2).slice(i, 1).flatten(), batch.column(3).slice(i, 1).flatten(), pa.array(n_words + 1), pa.array((known + (docs > 0)).astype(np.int64)), pa.array(np.full(len(n_words), tokens, np.int64)), pa.array(base), pa.array(score / np.log(10.0))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return finish


def slots_for(size: int) -> int:
    """Slots for so many bytes of text: a power of two that grows with their root, from 8 to 16,384."""
    return min(1 << 14, max(8, 1 << math.ceil(math.log2(max(1.0, math.sqrt(size) / 128)))))


def score_documents(docs: DataFrame, held_out: Column, group_bytes: int = GROUP_BYTES, slots: int | None = None) -> DataFrame:
    """Score every text by PPM and by the add-half unigram baseline.

    docs: doc_id, text and any others, which are ignored. held_out: boolean, rows
    not learned from. Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    if slots is None:
        slots = slots_for(int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0))
    texts = cut(binary(rows, "doc_id", "held_out").mapInArrow(_grouped(group_bytes), f"g long, ids array<{id_type}>, held array<boolean>, sizes array<bigint>, text binary"))
    lists = cut(texts.select("g", "held", "sizes", "text").mapInArrow(_list(slots), PACKED))
    groups = lists.where(F.col("kind") == DOCS).count()
    # As many tasks as groups, so that a task's share does not grow with the input.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(groups, MOST_TASKS))
    # Two layers of about the root of the number of groups each.
    salt = F.pmod(F.xxhash64("g"), F.lit(max(1, math.isqrt(groups))))
    merged = lists.repartition(n, "kind", "slot", salt).sortWithinPartitions("kind", "slot").mapInArrow(_merge, PACKED)
    tables = cut(merged.repartition(n, "kind", "slot").sortWithinPartitions("kind", "slot").mapInArrow(_merge, PACKED))
    # At most 65,536 pairs of bytes.
    low = tables.where(F.col("kind") == WINDOW).select("keys", "counts").mapInArrow(_low, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").toArrow()
    sums = tables.select("kind", "counts").mapInArrow(_sums, "kind int, keys long, total long").groupBy("kind").agg(F.sum("keys").alias("keys"), F.sum("total").alias("total"))
    size = {r.kind: (r["keys"], r.total) for r in sums.collect()}
    train_docs, listed = (int(size.get(k, (0, 0))[1]) for k in (DOCS, LISTED))
    (windows, _), (words, word_total) = (size.get(k, (0, 0)) for k in (WINDOW, WORD))
    parts = max(1, math.ceil(listed / (SPLIT * max(1, windows))))
    shared = spark.sparkContext.broadcast((low["pair"].to_numpy().astype(np.uint64), low["n"].to_numpy()))
    questions = lists.where(F.col("kind") <= WORD).withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts)).cast("int")).withColumn("counts", F.lit(None).cast("binary"))
    copies = tables.where(F.col("kind") <= WORD).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = copies.unionByName(questions).repartition(n, "kind", "slot", "part").sortWithinPartitions("kind", "slot", "part", "g")
    answers = met.drop("part").mapInArrow(_answer(shared), "g long, kind int, text binary, counts binary")
    both = answers.unionByName(texts.withColumn("kind", F.lit(TEXT)), allowMissingColumns=True).select("g", "kind", "ids", "held", "sizes", "text", "counts")
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    finish = _finish(int(word_total) + train_docs, int(words) + (train_docs > 0), train_docs)
    return both.repartition(n, "g").sortWithinPartitions("g", "kind").mapInArrow(finish, schema)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows -> their numbers of keys and summed counts."""
    for batch in batches:
        counts = [unpack(c.as_buffer(), np.int64) for c in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array([len(c) for c in counts], pa.int64()), pa.array([int(c.sum()) for c in counts], pa.int64())], ["kind", "keys", "total"])
