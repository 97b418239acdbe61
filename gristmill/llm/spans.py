"""Places of matches in a text, from the lengths of what stands between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def bound(value: Column, use) -> Column:
    """``use(value)``, where the value is reckoned once however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _sums(xs: Column) -> Column:
    """0 and the running sums of a short array; each step copies what is there."""
    return F.aggregate(xs, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))


def running(sizes: Column) -> Column:
    """Running sums of an array: in chunks of ``CHUNK``, then of the chunks' sums, so that no long array is copied at each
    step. A null array gives null."""

    def whole(chunks: Column) -> Column:
        before = _sums(F.transform(chunks, lambda c: F.element_at(c, -1)))
        return F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), lambda c, b: F.transform(F.slice(c, F.lit(2), F.size(c) - 1), lambda x: x + b)))

    def chunked(xs: Column) -> Column:
        count = F.ceil(F.size(xs) / CHUNK).cast("int")
        return F.when(count > 0, bound(F.transform(F.sequence(F.lit(1), count), lambda i: _sums(F.slice(xs, (i - 1) * CHUNK + 1, F.lit(CHUNK)))), whole)).otherwise(F.expr("cast(array() as array<int>)"))

    return bound(sizes, chunked)
