"""Text columns: markup, canonical form, tokens, shingles, set similarity."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels

# Named entities and what they stand for. ``&amp;`` is decoded last, so nothing is decoded twice.
ENTITIES = [("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("rsquo", "'"), ("ndash", "-"), ("mdash", "-"), ("amp", "&")]

# Words that say nothing about a posting.
STOPWORDS = (
    "a an and are as at be but by for from has have in is it its of on or our that the this to we will with you your "
    "job role position opportunity candidate candidates applicant responsibilities requirements qualifications preferred "
    "required experience team teams work working company please apply equal employer opportunityemployer benefits salary location"
).split()

SCRIPT = r"(?is)<(script|style)[^>]*>.*?</\1>"
BLOCK = r"(?i)</?(p|br|div|li|ul|ol|h[1-6]|tr|td|table|section)[^>]*>"
TAG = r"<[^>]+>"
NOT_KEPT = r"[^a-z0-9+#./-]+"
#: The bytes that ``NOT_KEPT`` leaves.
_KEPT = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789+#./-"))


def decode_entities(text: Column) -> Column:
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(f"&{name};"), F.lit(value))
    return text


def _without_markup(html: Column, decode_first: bool = False) -> Column:
    text = F.coalesce(html, F.lit(""))
    if decode_first:
        text = decode_entities(text)
    text = F.regexp_replace(text, SCRIPT, " ")
    text = F.regexp_replace(text, BLOCK, "\n")
    return decode_entities(F.regexp_replace(text, TAG, " "))


def strip_html(html: Column, decode_first: bool = False) -> Column:
    """Text without markup; null is empty. ``decode_first`` is for feeds whose markup is itself escaped."""
    return F.trim(F.regexp_replace(_without_markup(html, decode_first), r"\s+", " "))


@F.arrow_udf(T.StringType())
def _without_marks(texts: pa.Array) -> pa.Array:
    """Texts without accents and else as they are; ``canonical`` has its own step. Pieces of ASCII go back as they came; only texts that aren't are decoded, a piece at a time, so that a large batch isn't
    Python objects as a whole."""

    def one(text):
        return text if text is None or text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not "\u0300" <= c <= "\u036f")

    out = [texts.slice(0, 0)]
    for at, end, data, _ in kernels.pieces(texts):
        piece = texts.slice(at, end - at)
        out.append(piece if data.max(initial=0) < 128 else pa.array([one(t) for t in piece.to_pylist()], texts.type))
    return pa.concat_arrays(out)


def _plain(texts: pa.Array) -> pa.Array:
    """Texts decomposed, without marks, and with one blank for each run of what isn't kept. Only texts that aren't ASCII
    become Python objects, a piece at a time; the rest is done on bytes."""
    out = [pa.array([], pa.string())]
    for at, end, data, offsets in kernels.pieces(texts):
        if data.max(initial=0) >= 128:
            form = [t if t is None or t.isascii() else unicodedata.normalize("NFKD", t) for t in texts.slice(at, end - at).to_pylist()]
            ((_, _, data, offsets),) = kernels.pieces(pa.array(form, pa.large_string()), 1 << 62)
        data, offsets = kernels.spaced(data, offsets, _KEPT)
        out.append(pa.StringArray.from_buffers(end - at, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)))
    return pa.concat_arrays(out)


@F.arrow_udf(T.StringType())
def _plain_texts(texts: pa.Array) -> pa.Array:
    return _plain(texts)


def canonical(raw: Column) -> Column:
    """The form that texts are compared in: no markup, case, accents or punctuation but ``+ # . / -``; null is empty.

    Spark has no Unicode decomposition, so lower-cased texts pass through one UDF on Arrow batches; nothing before it is
    made twice. ``NOT_KEPT`` is applied to their bytes there: as a regular expression it took most of the time.
    """
    return _plain_texts(F.lower(_without_markup(raw)))


def tokens(canonical_text: Column) -> Column:
    """Words of two letters or more that aren't stop words, in order, repeats kept."""
    return F.filter(F.split(F.coalesce(canonical_text, F.lit("")), " "), lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))


def shingles(words: Column, k: int = 3) -> Column:
    """Distinct runs of k words; fewer words make one run, none make none."""
    if k < 1:
        raise ValueError("k must be positive")
    # The words shifted against themselves: nothing but the row of k words is in the lambda, so the work is linear.
    count = F.greatest(F.size(words) - k + 1, F.lit(0))
    shifted = F.arrays_zip(*[F.slice(words, i + 1, count).alias(f"w{i}") for i in range(k)])
    runs = F.transform(shifted, lambda w: F.concat_ws(" ", *[w[f"w{i}"] for i in range(k)]))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) < k, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; both empty: 1, one empty: 0."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def set_jaccard(a: Column, b: Column) -> Column:
    """``jaccard`` of arrays without repeats, such as shingles: no union is made."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def stack_jaccard(a: Column, b: Column) -> Column:
    """Of two lists of technologies, trimmed and case-folded, blanks dropped; any empty: 0."""
    clean = lambda x: F.array_distinct(F.filter(F.transform(x, lambda t: F.trim(F.lower(t))), lambda t: t != ""))
    a, b = clean(a), clean(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
