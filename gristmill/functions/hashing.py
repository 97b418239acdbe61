"""Hashes, MinHash signatures, bands, content hashes, time-ordered ids."""

from __future__ import annotations

import uuid
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels

PRIME, HASHES, BANDS, ROWS, SEED = 2**31 - 1, 128, 16, 8, 0x5EED1234
EMPTY = 2**31 - 1
UNIT = "\u001f"
_OFFSET, _FACTOR, _WORD = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a, unsigned."""
    h = _OFFSET
    for b in data:
        h = ((h ^ b) * _FACTOR) & _WORD
    return h


@F.arrow_udf(T.LongType())
def fnv1a64(texts: pa.Array) -> pa.Array:
    """64-bit FNV-1a of the UTF-8 bytes, as a signed long."""
    out = np.empty(len(texts), np.int64)
    for at, end, data, offsets in kernels.pieces(texts):
        out[at:end] = kernels.fnv1a(data, offsets[:-1], offsets[1:]).view(np.int64)
    return pa.array(out, mask=texts.is_null().to_numpy(zero_copy_only=False))


@cache
def coefficients(count: int = HASHES, seed: int = SEED) -> tuple[tuple[int, int], ...]:
    """The multipliers and offsets of the permutations, drawn in turns from the documented 48-bit linear congruential
    generator (multiplier 0x5DEECE66D, increment 11), two 32-bit draws to a signed 64-bit number."""
    state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits32() -> int:
        nonlocal state
        state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        x = state >> 16
        return x - (1 << 32) if x >= 1 << 31 else x

    def number() -> int:
        x = ((bits32() << 32) + bits32()) & _WORD
        return x - (1 << 64) if x >= 1 << 63 else x

    return tuple((1 + number() % (PRIME - 1), number() % PRIME) for _ in range(count))


def minhash(hashes: Column, count: int = HASHES, seed: int = SEED) -> Column:
    """A signature of minima of ``(a * x + b) mod p`` over an array of 64-bit hashes; an empty array gives all EMPTY.

    Products stay below 2^62, so nothing overflows. ``minhash_words`` is the faster form for texts.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in coefficients(count, seed)])
    reduced = F.transform(hashes, lambda h: F.pmod(h, F.lit(PRIME)))
    return F.transform(pairs, lambda c: F.coalesce(F.array_min(F.transform(reduced, lambda x: (c["a"] * x + c["b"]) % PRIME)), F.lit(EMPTY)).cast("int"))


def _signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of minima for each run of ``sizes`` hashes; of no hashes, EMPTY. The prime is 2^31 - 1, so remainders are folds
    of shifts."""
    out = np.full((len(sizes), HASHES), EMPTY, np.int32)
    full = np.flatnonzero(sizes)
    if len(full):
        p, shift = np.uint64(PRIME), np.uint64(31)
        x = np.mod(hashes.view(np.int64), PRIME).astype(np.uint64)
        edges = np.r_[0, np.cumsum(sizes[full])[:-1]]
        for j, (a, b) in enumerate(coefficients()):
            v = x * np.uint64(a) + np.uint64(b)
            v = (v & p) + (v >> shift)
            v = (v & p) + (v >> shift)
            out[full, j] = np.minimum.reduceat(np.minimum(v, v - p), edges)
    return out


@cache
def minhash_words(k: int = 3):
    """A UDF of texts of words joined by single blanks, as of ``tokens``: signatures of their sets of k-word shingles, by
    FNV-1a. A shingle is a slice of the text, so none is made as a string; repeated ones don't change a minimum. Fewer
    words make one shingle; null and empty texts have none."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def signatures(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, np.int32)]
        for _, _, data, offsets in kernels.pieces(texts):
            starts, ends, sizes = kernels.shingle_spans(data, offsets, k)
            out.append(_signatures(kernels.fnv1a(data, starts, ends), sizes).ravel())
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * HASHES, np.concatenate(out))

    return signatures


def agreement(a: Column, b: Column) -> Column:
    """The share of places where two signatures agree: an estimate of the Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def bands(signature: Column, count: int = BANDS, rows: int = ROWS) -> Column:
    """The bands of a signature as structs of number and slice: equal exactly where the slices are."""
    if count * rows != HASHES:
        raise ValueError(f"{count} bands of {rows} don't make {HASHES}")
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(i.alias("band"), F.slice(signature, i * rows + 1, rows).alias("key")))


def band_threshold(count: int = BANDS, rows: int = ROWS) -> float:
    return (1 / count) ** (1 / rows)


def retrieval_probability(similarity: Column, count: int = BANDS, rows: int = ROWS) -> Column:
    return 1 - F.pow(1 - F.pow(similarity, F.lit(rows)), F.lit(count))


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def posting_fingerprint(external_id: Column, title: Column, location: Column, remote: Column, description: Column) -> Column:
    """What decides whether a posting changed, of canonical texts: not its department, links or dates."""
    return F.concat_ws(UNIT, external_id, title, location, remote.cast("string"), description)


def ordered_digest(keyed: Column) -> Column:
    """Of an array of (key, fingerprint) structs: a digest that doesn't depend on their order."""
    return sha256(F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat(x["fingerprint"], F.lit(UNIT))), ""))


@F.pandas_udf(T.StringType())
def uuid7(millis: pd.Series) -> pd.Series:
    """Time-ordered ids (version 7) whose first 48 bits are the given epoch milliseconds."""
    def one(ms):
        tail = uuid.uuid4().int
        return str(uuid.UUID(int=(int(ms) << 80) | (7 << 76) | ((tail >> 64 & 0xFFF) << 64) | (2 << 62) | (tail & ((1 << 62) - 1))))

    return millis.map(one, na_action="ignore")


def uuid7_millis(text: Column) -> Column:
    return F.conv(F.replace(text, F.lit("-"), F.lit("")).substr(1, 12), 16, 10).cast("long")
