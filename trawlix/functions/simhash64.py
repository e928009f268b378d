"""64-bit SimHash of white-space tokens under a polynomial string hash.

A token's hash is its UTF-16 code units as digits in base 31, modulo 2 ** 64. Both
steps run in numpy on many texts laid end to end, since a lambda per character is slow
in the JVM and a call per text in Python.
Values are the hash's bits as signed longs: compare them by
``hamming`` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

#: White space as ECMAScript has it.
SPACES = "".join(map(chr, [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: Two texts are near-duplicates from this similarity on: at most 9 of 64 bits differ.
THRESHOLD = 0.85
_IS_SPACE = np.zeros(1 << 16, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_BASE, _INVERSE = np.uint64(31), np.uint64(pow(31, -1, 1 << 64))


#: Code units worked on at once (or one longer text).
SPAN = 1 << 18
_steps: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    if int(base) not in _steps or len(_steps[int(base)]) < n:
        steps = np.full(max(n, SPAN + 1), base, np.uint64)
        steps[0] = 1
        _steps[int(base)] = np.multiply.accumulate(steps)
    return _steps[int(base)][:n]


def _spans(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The lower-cased texts as UTF-16, in runs of about SPAN code units."""
    run, size = [], 0
    for text in texts:
        units = (text or "").lower().encode("utf-16-le", "surrogatepass")
        if run and size + len(units) > 2 * SPAN:
            yield run
            run, size = [], 0
        run.append(units)
        size += len(units) + 2
    if run:
        yield run


def _hashed(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of more than one code unit, in order, and how many each text has."""
    units = np.frombuffer(b" \0".join(run), np.uint16)
    n = len(units)
    edge = np.diff((~_IS_SPACE[units]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first > 1
    first, last = first[long], last[long]
    starts = np.cumsum([0, *(len(x) // 2 + 1 for x in run[:-1])])
    sizes = np.bincount(np.searchsorted(starts, first, side="right") - 1, minlength=len(run))
    total = np.concatenate([[np.uint64(0)], np.add.accumulate(units * _powers(_INVERSE, n))])
    return (total[last] - total[first]) * _powers(_BASE, n)[last - 1], sizes


def token_hashes(text: str) -> np.ndarray:
    return _hashed(next(_spans([text])))[0]


def simhashes(texts: list[str | None]) -> np.ndarray:
    """The SimHash of each text, as signed longs."""
    out = []
    for run in _spans(texts):
        hashes, sizes = _hashed(run)
        values, full = np.zeros(len(run), np.int64), np.flatnonzero(sizes)
        if len(full):
            bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            votes = np.add.reduceat(bits, np.cumsum(sizes[full]) - sizes[full], axis=0, dtype=np.int64)
            packed = np.packbits(2 * votes > sizes[full][:, None], axis=1)
            values[full] = np.ascontiguousarray(packed).view(">u8").ravel().astype(np.uint64).view(np.int64)
        out.append(values)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def simhash_text(text: str | None) -> int:
    return int(simhashes([text])[0])


@pandas_udf(LongType())
def simhash(text: pd.Series) -> pd.Series:
    return pd.Series(simhashes([None if pd.isna(t) else t for t in text]), dtype="int64")


@pandas_udf(ArrayType(LongType()))
def string_hashes(text: pd.Series) -> pd.Series:
    found = []
    for run in _spans([None if pd.isna(t) else t for t in text]):
        hashes, sizes = _hashed(run)
        found += np.split(hashes.view(np.int64), np.cumsum(sizes)[:-1])
    return pd.Series(found, dtype="object")


def tokens(text: Column) -> Column:
    """Lower-cased tokens of more than one character."""
    spaces = "[" + "".join(f"\\u{ord(c):04x}" for c in SPACES) + "]+"
    return F.filter(F.split(F.lower(text), spaces), lambda x: F.length(x) > 1)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - hamming(a, b) / F.lit(64.0)


def is_duplicate(a: Column, b: Column, threshold: float = THRESHOLD) -> Column:
    return similarity(a, b) >= threshold
