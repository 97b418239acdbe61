"""Operator 4: token counts of byte-level BPE by a two-tier lookup, without a shuffle of pre-tokens.

Method. Texts are cut into pre-tokens on arrays of code points, with the tokenizer's own classes of letters, numbers and
white space. A compact hash table (slot: 64-bit hash and length in tokens) of the most frequent pre-tokens is broadcast;
``TABLE`` entries at most. Misses are encoded by the library once per worker and kept in the worker's cache, which
starts anew at ``CACHE`` entries. The table is filled from counts over all texts: each task sends one bounded summary of
its most frequent pre-tokens, and summaries are merged in a tree of 32 to one. So what is shuffled is a row per task. The
table decides speed alone; every count is exact with any table.

Texts that hold the string of an added token go through the library whole, as it looks for those first.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .shared import table

TABLE, SUMMARY, FAN_IN, CACHE, LIMIT = 65_536, 16_384, 32, 2_000_000, 1024
_BITS = 19
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = LETTER
        elif kind == "N":
            out[i] = NUMBER
    for lo, hi in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[lo : hi + 1] = SPACE
    return out


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _added(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f)["added_tokens"])


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]


def pre_tokens(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: runs of a class, with one blank before them; of white space before something else, the last
    character stands alone or goes with what follows; and the contractions after an apostrophe."""
    n = len(points)
    kind = _classes()[points]
    begins = np.ones(n + 1, bool)
    begins[1:n] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins |= edge
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n]) if n else np.zeros(0, np.int64)
    begins[last] = True
    begins[last[points[last] == 32] + 1] = False
    mark = np.flatnonzero((points == 39) & begins[:n])
    if len(mark):
        at = lambda j: np.where((mark + j < n), points[np.minimum(mark + j, n - 1)], 0)
        free = lambda j: ~edge[np.minimum(mark + j, n)]
        a, b = at(1), at(2)
        one = free(1) & np.isin(a, [ord(c) for c in "stmd"])
        two = free(1) & free(2) & (((b == ord("e")) & np.isin(a, [ord("r"), ord("v")])) | ((a == ord("l")) & (b == ord("l"))))
        for which, length in ((one, 2), (two, 3)):
            for j in range(1, length):
                begins[mark[which] + j] = False
            begins[mark[which] + length] = True
    return np.flatnonzero(begins[:n])


def _hashes(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.r_[starts[1:], len(points)]
    return V.word_hashes(points, starts, ends), ends


def _text(points: np.ndarray, a: int, b: int) -> str:
    return points[a:b].tobytes().decode("utf-32-le")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for _, _, data, offsets in V.slices(batch.column(0)):
            points, at = code_points(data, offsets)
            starts = pre_tokens(points, at)
            hashes, ends = _hashes(points, starts)
            _, first, count = np.unique(hashes, return_index=True, return_counts=True)
            top = np.flatnonzero(count > 1)
            top = top[np.argsort(-count[top], kind="stable")[:SUMMARY]]
            for i, c in zip(first[top].tolist(), count[top].tolist()):
                seen[_text(points, starts[i], ends[i])] += c
            if len(seen) > 4 * SUMMARY:
                seen = Counter(dict(seen.most_common(SUMMARY)))
    top = seen.most_common(SUMMARY)
    node = pa.array([TaskContext.get().partitionId()], pa.int64())
    yield pa.RecordBatch.from_arrays([node, pa.array([[w for w, _ in top]], pa.list_(pa.string())), pa.array([[c for _, c in top]], pa.list_(pa.int64()))], ["node", "words", "counts"])


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    total: Counter = Counter()
    for words, counts in zip(rows["words"], rows["counts"]):
        for word, count in zip(words, counts):
            total[word] += int(count)
    top = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:TABLE]
    return pd.DataFrame({"node": [int(rows["node"].iloc[0]) // FAN_IN], "words": [[w for w, _ in top]], "counts": [[c for _, c in top]]})


def frequent(texts: DataFrame) -> list[str]:
    """The most frequent pre-tokens over all rows of the one string column of ``texts``, TABLE at most, by way of bounded
    summaries; exact for those that are among the most frequent of every task."""
    schema = "node long, words array<string>, counts array<long>"
    rows = texts.mapInArrow(_summaries, schema)
    parts = 1 << 20
    while parts > 1:
        rows = rows.groupBy((F.col("node") / FAN_IN).cast("long").alias("group")).applyInPandas(_merge, schema)
        parts = -(-parts // FAN_IN)
    found = rows.collect()
    return list(found[0]["words"]) if found else []


def lengths(words: list[str], path: str) -> np.ndarray:
    return np.array([len(e) for e in _tokenizer(path).encode_batch(words, add_special_tokens=False)], np.int64) if words else np.zeros(0, np.int64)


def hash_table(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of hashes and lengths. Of words that share a slot the first stays."""
    keys, values = np.zeros(1 << _BITS, np.uint64), np.zeros(1 << _BITS, np.uint16)
    sizes = lengths(words, path)
    for word, size in zip(words[::-1], sizes[::-1]):
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        if len(points) and size < 1 << 16:
            h = V.word_hashes(points, np.array([0]), np.array([len(points)]))[0]
            keys[h >> np.uint64(64 - _BITS)], values[h >> np.uint64(64 - _BITS)] = h, size
    return keys, values


_CACHES: dict[str, dict[int, int]] = {}


def count_slice(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, values: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each text, none of which holds an added token's string."""
    points, at = code_points(data, offsets)
    starts = pre_tokens(points, at)
    hashes, ends = _hashes(points, starts)
    slot = hashes >> np.uint64(64 - _BITS)
    sizes = values[slot].astype(np.int64)
    missed = np.flatnonzero(keys[slot] != hashes)
    if len(missed):
        known = _CACHES.setdefault(path, {})
        names, first, index = np.unique(hashes[missed], return_index=True, return_inverse=True)
        got = [known.get(h) for h in names.tolist()]
        new = [i for i, x in enumerate(got) if x is None]
        if new:
            for a in range(0, len(new), 4096):
                part = new[a : a + 4096]
                own = missed[first[part]]
                for i, size in zip(part, lengths([_text(points, starts[j], ends[j]) for j in own.tolist()], path).tolist()):
                    got[i] = size
            if len(known) + len(new) > CACHE:
                known.clear()
            known.update((h, got[i]) for i, h in zip(new, names[new].tolist()))
        sizes[missed] = np.array(got, np.int64)[index]
    return np.diff(np.r_[0, np.cumsum(sizes)][np.searchsorted(starts, at)])


def _count_rows(keys: np.ndarray, values: np.ndarray, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in V.slices(batch.column(1)):
                raw = data.tobytes()
                if any(x.encode() in raw for x in _added(path)):
                    counts = np.array([len(_tokenizer(path).encode(raw[a:b].decode("utf-8"), add_special_tokens=False)) for a, b in zip(offsets[:-1], offsets[1:])], np.int64)
                else:
                    counts = count_slice(data, offsets, keys, values, path)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets).astype(np.int64)), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, a row for each row of ``docs``, as the library's tokenizer file at
    ``path`` (byte-level BPE; a path that exists on every executor) counts whole texts.

    A null text is empty and has no tokens. Rows with null or repeated ids have their rows; an empty table gives none.
    Columns other than the two named are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = frequent(docs.select("text"))
    rows = docs.mapInArrow(_count_rows(*hash_table(words, path), path), "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


ORACLE: dict[str, str] = {}
