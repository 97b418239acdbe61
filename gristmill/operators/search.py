"""Hybrid search: a BM25 leg and a vector leg over the same filters, fused by rank, with bounded freshness."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import embedding, scores
from ..functions.text import canonical, strip_html, tokens
from .staging import staged

K1, B = 1.2, 0.75
# The fields of the lexical leg and their boosts.
BOOSTS = {"title": 3.0, "specialization": 2.0, "company_name": 1.5, "concepts": 2.0, "description": 1.0, "location": 1.0}


@dataclass(frozen=True)
class Request:
    """A search; a blank query matches everything. Levels are upper-cased; ``remote`` None doesn't filter."""

    query: str = ""
    location: str = ""
    levels: tuple[str, ...] = ()
    remote: bool | None = None
    company: str = ""
    size: int = 20
    offset: int = 0

    def page(self) -> tuple[int, int]:
        return self.offset, max(1, min(self.size, 100))


@dataclass(frozen=True)
class Ranking:
    depth: int = 200
    k: int = 60
    lexical: float = 1.0
    vector: float = 1.0
    half_life_days: float = 14.0
    penalty: float = 0.4
    furthest: int = 1000
    blank_query: str = "software engineer"
    boosts: dict = field(default_factory=lambda: dict(BOOSTS))


def filters(request: Request) -> Column:
    """The one predicate for both legs, applied before either is cut to its depth."""
    out = F.lit(True)
    if request.remote is not None:
        out = out & (F.col("remote") == request.remote)
    if request.levels:
        out = out & F.col("level").isin([x.upper() for x in request.levels])
    if request.company:
        out = out & (F.col("company_slug") == request.company)
    if request.location.strip():
        out = out & F.arrays_overlap(tokens(canonical(F.col("location"))), tokens(canonical(F.lit(request.location))))
    return out


def documents(jobs: DataFrame, companies: DataFrame, lexicon: dict[str, list[str]] = embedding.LEXICON, dimensions: int = embedding.DIMENSIONS) -> DataFrame:
    """What is indexed of canonical jobs ``(job_id, company_id, title, description_html, specialization, role, level,
    location, remote, first_seen_at, source_count)`` and ``companies(company_id, slug, name)``.

    The embedded text is title, specialization, role and location before the plain description; concepts are those of
    the same text. Jobs without their company aren't indexed.
    """
    if dimensions != embedding.DIMENSIONS:
        raise ValueError(f"the model makes {embedding.DIMENSIONS} dimensions, not {dimensions}")
    rows = jobs.join(companies.select("company_id", F.col("slug").alias("company_slug"), F.col("name").alias("company_name")), "company_id")
    rows = rows.withColumn("description", strip_html(F.col("description_html"))).drop("description_html")
    rows = rows.withColumn("__c", canonical(F.concat_ws(" ", "title", "specialization", "role", "location", "description")))
    return rows.withColumn("concepts", embedding.concepts(F.col("__c"), lexicon)).withColumn("embedding", embedding.embedder(lexicon)("__c")).withColumn("model_id", F.lit(embedding.MODEL)).drop("__c")


def postings(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, term, tf, length), a row per text and term."""
    rows = docs.select(key, words.alias("__w")).select(key, F.size("__w").alias("length"), F.explode("__w").alias("term"))
    return rows.groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def _bm25_score(tf: list[Column], df: list[Column], length: Column, mean: Column, n: Column, k1: float, b: float) -> Column:
    score = F.lit(0.0)
    for t, d in zip(tf, df):
        score = score + F.log(1 + (n - d + 0.5) / (d + 0.5)) * t * (k1 + 1) / (t + k1 * (1 - b + b * length / mean))
    return score


def bm25(docs: DataFrame, key: str, words: Column, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of the texts with at least one of the terms. Texts are scanned once: a row of length and frequencies
    for each is staged, of which statistics and scores are made."""
    terms = sorted(set(terms))
    rows = docs.select(F.col(key), words.alias("__w"))
    rows = rows.select(key, F.size("__w").alias("length"), F.filter("__w", lambda w: w.isin(*terms)).alias("__w"))
    counts = [F.size(F.filter("__w", (lambda t: lambda w: w == t)(t))).alias(f"tf_{i}") for i, t in enumerate(terms)]
    rows = staged(rows.select(key, "length", *counts))
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))])
    tf, df = ([F.col(f"{x}_{i}") for i in range(len(terms))] for x in ("tf", "df"))
    found = " or ".join(f"tf_{i} > 0" for i in range(len(terms))) or "false"
    return rows.where(found).join(F.broadcast(stats)).select(key, _bm25_score(tf, df, F.col("length"), F.col("mean"), F.col("n"), k1, b).alias("score"))


def edits_allowed(term: str) -> int:
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def fuzzy_terms(vocabulary: DataFrame, term: str, column: str = "term") -> DataFrame:
    """The vocabulary's terms within the edits that the query term's length allows, with their distance."""
    most = edits_allowed(term)
    near = vocabulary.where(F.abs(F.length(column) - len(term)) <= most)
    return near.select(column, F.levenshtein(F.col(column), F.lit(term), most).alias("edits")).where("edits >= 0")


def fuzzy_frequency(words: Column, term: str) -> Column:
    """How often the term is among the words; one within the edits that the term's length allows counts 1 less the edits'
    share of the shorter of the two."""
    most = edits_allowed(term)
    exact = lambda w: F.when(w == term, F.lit(1.0))
    if not most:
        return F.aggregate(words, F.lit(0.0), lambda s, w: s + exact(w).otherwise(0.0))
    close = lambda w: (F.abs(F.length(w) - len(term)) <= most) & (F.levenshtein(w, F.lit(term), most) >= 0)
    part = lambda w: 1 - F.levenshtein(w, F.lit(term), most) / F.least(F.length(w), F.lit(len(term)))
    return F.aggregate(words, F.lit(0.0), lambda s, w: s + exact(w).when(close(w), F.greatest(part(w), F.lit(0.0))).otherwise(0.0))


def _field_columns(columns: list[str], words: list[str], query: str, ranking: Ranking) -> tuple[list[str], list[Column]]:
    """The leg's fields of words, and what a row keeps of all its fields: lengths, frequencies, whether the concept is had."""
    fields = [f for f in ranking.boosts if f in columns and f != "concepts"]
    out = [F.array_contains("concepts", query.strip()).alias("has_concept")] if "concepts" in columns and "concepts" in ranking.boosts else []
    for f in fields:
        out.append(F.size(f"__w_{f}").alias(f"length_{f}"))
        out += [fuzzy_frequency(F.col(f"__w_{f}"), w).alias(f"tf_{f}_{i}") for i, w in enumerate(words)]
    return fields, out


def _best_field(rows: DataFrame, fields: list[str], count: int, ranking: Ranking) -> DataFrame:
    """``rows`` of at least one match with their ``score``, the boosted BM25 of the best field. A field's statistics are over
    all rows; they are one row."""
    stats = [F.count("*").alias("__n")]
    for f in fields:
        stats += [F.avg(f"length_{f}").alias(f"__mean_{f}"), *[F.count_if(F.col(f"tf_{f}_{i}") > 0).alias(f"__df_{f}_{i}") for i in range(count)]]
    scored = [F.when(F.col("has_concept"), F.lit(float(ranking.boosts["concepts"])))] if "has_concept" in rows.columns else []
    for f in fields:
        tf, df = ([F.col(f"{x}_{f}_{i}") for i in range(count)] for x in ("tf", "__df"))
        found = F.greatest(*tf, F.lit(0.0)) > 0
        scored.append(F.when(found, ranking.boosts[f] * _bm25_score(tf, df, F.col(f"length_{f}"), F.col(f"__mean_{f}"), F.col("__n"), K1, B)))
    best = F.greatest(*scored, F.lit(None).cast("double"))
    return rows.crossJoin(F.broadcast(rows.agg(*stats))).withColumn("score", best).where("score is not null")


def _worded(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """Words of each field: canonical, without accents or stop words."""
    fields = [f for f in ranking.boosts if f in docs.columns and f != "concepts"]
    docs = docs.select("*", *[canonical(F.col(f)).alias(f"__c_{f}") for f in fields])
    return docs.select("*", *[tokens(F.col(f"__c_{f}")).alias(f"__w_{f}") for f in fields])


def lexical_leg(docs: DataFrame, query: str, ranking: Ranking = Ranking(), key: str = "id") -> DataFrame:
    """The best field's boosted BM25, for each document with a query term in a field, or a word within its edits; all
    documents if it is blank. Texts are scanned once."""
    words = canonical_words(docs.sparkSession, query)
    if not words:
        return docs.select(key, F.lit(1.0).alias("score"))
    fields, columns = _field_columns(docs.columns, words, query, ranking)
    return _best_field(staged(_worded(docs, ranking).select(key, *columns)), fields, len(words), ranking).select(key, "score")


def canonical_words(spark: SparkSession, text: str) -> list[str]:
    return spark.range(1).select(tokens(canonical(F.lit(text))).alias("w")).first()["w"]


def vector_leg(docs: DataFrame, vector: list[float], key: str = "id", column: str = "embedding") -> DataFrame:
    """Exact similarity with the query's unit vector: a scan without a shuffle."""
    return docs.select(key, embedding.dot(F.col(column), F.array(*[F.lit(float(x)) for x in vector])).alias("score"))


#: Queries and rows of one block, and products of one piece of it: what a task holds at once, whatever the tables' size.
QUERY_BLOCK, ROW_BLOCK, PRODUCTS = 4096, 16384, 1 << 22


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of doubles; a null vector, or one with a null in it, is a row of NaN."""
    found = np.concatenate([c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in vectors.chunks])
    out = np.full((len(vectors), len(found) // max(len(vectors) - vectors.null_count, 1)), np.nan)
    out[vectors.is_valid().to_numpy()] = found.reshape(-1, out.shape[1])
    return out


def _sums(products: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right, as ``embedding.dot`` makes them."""
    return np.add.accumulate(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def _block_best(k: int) -> Callable:
    """(q, vec_id, c): the ``k`` best of a block's rows for each of its queries. A product of matrices finds what may be among
    them, a sum in the stated order decides."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, ids, scored = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if queries.num_rows and rows.num_rows:
            asked, known = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
            a, b = _matrix(queries["embedding"]), _matrix(rows["embedding"])
            long_a, long_b = np.sqrt(_sums(a * a)), np.sqrt(_sums(b * b))
            with np.errstate(divide="ignore", invalid="ignore"):
                unit_a, unit_b = a / long_a[:, None], (b / long_b[:, None]).T.copy()
                for at in range(0, len(a), max(1, PRODUCTS // len(b))):
                    piece = slice(at, at + max(1, PRODUCTS // len(b)))
                    near = np.nan_to_num(unit_a[piece] @ unit_b, nan=-2.0)
                    near[asked[piece][:, None] == known[None, :]] = -3.0
                    bars = np.partition(near, -k, axis=1)[:, -k] if len(b) > k else np.full(len(near), -2.0)
                    for i, (row, bar) in enumerate(zip(near, bars), at):
                        few = np.flatnonzero((row >= bar - 1e-9) & (row > -3.0))
                        c = _sums(a[i] * b[few]) / (long_a[i] * long_b[few])
                        best = few[order := np.lexsort((known[few], -np.nan_to_num(c, nan=-2.0)))[:k]]
                        q.append(np.full(len(best), asked[i]))
                        ids.append(known[best])
                        scored.append(c[order])
        c = np.concatenate(scored)
        return pa.table({"q": np.concatenate(q), "vec_id": np.concatenate(ids), "c": pa.array(c, mask=np.isnan(c))})

    return run


def exact_nearest(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(q, vec_id, n)``: for each of ``queries(vec_id, embedding)`` the ``k`` of ``rows(vec_id, embedding)`` with another id and
    the best cosine, equals by id. What has no cosine (null, zero or a null within) comes last. All vectors have one length.

    Every query meets every row, in blocks of bounded size whose pairs Spark deals over the tasks. Of equal vectors only the
    ``k`` + 1 with the smallest ids meet queries, as no other can be among the ``k`` best beside a query itself.
    """
    same = Window.partitionBy("embedding").orderBy("vec_id")
    rows = staged(rows.select("vec_id", "embedding").withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).drop("place"))
    queries = staged(queries.select("vec_id", "embedding"))
    n_q, n_r = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (rows, ROW_BLOCK)))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "embedding", block(n_q).alias("qb"), every(n_r).alias("rb"))
    right = rows.select("vec_id", "embedding", every(n_q).alias("qb"), block(n_r).alias("rb"))
    pairs = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(_block_best(k), "q long, vec_id long, c double")
    best = Window.partitionBy("q").orderBy(F.desc("c"), "vec_id")
    return pairs.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("q", "vec_id", "n")


def ranked(leg: DataFrame, depth: int, key: str = "id", name: str = "rank") -> DataFrame:
    """Places 1 to ``depth``; cut before it is numbered, so one task numbers ``depth`` rows at most."""
    top = leg.orderBy(F.desc("score"), key).limit(depth)
    return top.withColumn(name, F.row_number().over(Window.orderBy(F.desc("score"), key))).select(key, name)


def fuse(lists: list[tuple[DataFrame, float]], k: int = 60, key: str = "id") -> DataFrame:
    """(key, rank_0, rank_1, ..., fused) of lists with (key, rank)."""
    out = None
    for i, (ranks, _) in enumerate(lists):
        ranks = ranks.select(key, F.col("rank").alias(f"rank_{i}"))
        out = ranks if out is None else out.join(ranks, key, "full_outer")
    return out.withColumn("fused", scores.rrf([(F.col(f"rank_{i}"), weight) for i, (_, weight) in enumerate(lists)], k))


def search(docs: DataFrame, request: Request, now: datetime, ranking: Ranking = Ranking(), key: str = "id") -> DataFrame:
    """A page of (key, score, fused, multiplier, rank_0, rank_1, total). ``docs`` has the fields of ``BOOSTS`` that it can,
    ``embedding``, ``posted_at`` and what the filters need; it should be stored or staged, not made on the way."""
    offset, size = request.page()
    depth = max(ranking.depth, offset + size)
    docs = docs.where(filters(request))
    text = request.query.strip() or ranking.blank_query
    form = docs.sparkSession.range(1).select(canonical(F.lit(text)).alias("t")).select(embedding.concepts(F.col("t")).alias("c"), tokens(F.col("t")).alias("w")).first()
    vector = embedding.embed_words(form["c"], form["w"]).tolist()
    words = canonical_words(docs.sparkSession, request.query)
    # One scan of the texts for both legs: what is staged of a document is some numbers.
    fields, columns = _field_columns(docs.columns, words, request.query, ranking) if words else ([], [])
    near = embedding.dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])).alias("similarity")
    rows = staged((_worded(docs, ranking) if words else docs).select(key, "posted_at", near, *columns))
    lexical = _best_field(rows, fields, len(words), ranking) if words else rows.withColumn("score", F.lit(1.0))
    legs = [(ranked(lexical, depth, key), ranking.lexical), (ranked(rows.select(key, F.col("similarity").alias("score")), depth, key), ranking.vector)]
    fused = fuse(legs, ranking.k, key)
    fused = fused.withColumn("total", F.count("*").over(Window.partitionBy()))
    rows = rows.select(key, "posted_at").join(F.broadcast(fused), key)  # two legs of ``depth`` rows at most
    multiplier = scores.bounded_freshness(scores.freshness(F.col("posted_at"), F.lit(now), ranking.half_life_days), ranking.penalty)
    rows = rows.withColumn("multiplier", multiplier).withColumn("score", F.col("fused") * F.col("multiplier"))
    return rows.select(key, "score", "fused", "multiplier", "rank_0", "rank_1", "total").orderBy(F.desc("score"), key).offset(offset).limit(size)


def query_hash(request: Request) -> str:
    parts = [request.query, request.location, ",".join(sorted(request.levels)), str(request.remote), request.company, str(request.size)]
    return hashlib.sha256("\u001f".join(parts).encode()).hexdigest()[:16]


def encode_cursor(offset: int, digest: str) -> str:
    return base64.urlsafe_b64encode(f"{offset}:{digest}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str, digest: str, furthest: int = Ranking.furthest) -> int:
    """The offset; an error for a malformed cursor, one of another query, or one out of range."""
    try:
        offset, found = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode().split(":")
        place = int(offset)
    except ValueError as error:
        raise ValueError("malformed cursor") from error
    if found != digest or not 0 <= place <= furthest:
        raise ValueError("the cursor belongs to another query or is out of range")
    return place


def next_cursor(request: Request, total: int, furthest: int = Ranking.furthest) -> str | None:
    offset, size = request.page()
    place = offset + size
    return None if place >= total or place > furthest else encode_cursor(place, query_hash(request))
