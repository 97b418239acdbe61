"""Queries of retrieval, fusion and dedup."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..functions import embedding
from ..functions import text as T
from ..operators import dedup, search, vectors
from ..operators.index import Index
from ..operators.staging import folder, staged, stored
from .base import query, spread, table
from .text_queries import _TOKENS, canonical_sql, shingles_sql, tokens_sql

TERMS = ["the", "idiot", "with", "und"]
_TF = ", ".join(f"len(list_filter(t, lambda w: w = '{x}')) as tf_{i}" for i, x in enumerate(sorted(TERMS)))
_BM = " + ".join(f"ln(1 + (n - df_{i} + 0.5) / (df_{i} + 0.5)) * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(TERMS)))


@query(f"""with t as ({_TOKENS[1:-1]}), c as (select doc_id, len(t) as len, {_TF} from t), s as (select count(*)::double as n, avg(len) as mean, {', '.join(f'count(*) filter (tf_{i} > 0) as df_{i}' for i in range(len(TERMS)))} from c)
select doc_id, round({_BM}, 6) as score from c, s where {' or '.join(f'tf_{i} > 0' for i in range(len(TERMS)))} order by {_BM} desc, doc_id limit 200""")
def bm25_topk(spark, sf_dir):
    rows = search.bm25(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", T.tokens(T.canonical(F.col("text"))), TERMS)
    return rows.orderBy(F.desc("score"), "doc_id").limit(200).select("doc_id", F.round("score", 6).alias("score"))


# What the index holds at last: every seventh document deleted, every 21st of them brought back with another text.
_INDEXED = "select doc_id, case when doc_id % 21 = 0 then source when doc_id % 20 = 0 then text || ' idiot with idiot' else text end as text from documents where doc_id % 21 = 0 or doc_id % 7 <> 0"


@query(f"""with e as ({_INDEXED}), t as ({_TOKENS[1:-1].replace('from documents', 'from e')}), c as (select doc_id, len(t) as len, {_TF} from t), s as (select count(*)::double as n, avg(len) as mean, {', '.join(f'count(*) filter (tf_{i} > 0) as df_{i}' for i in range(len(TERMS)))} from c)
select doc_id, round({_BM}, 6) as score from c, s where {' or '.join(f'tf_{i} > 0' for i in range(len(TERMS)))}""")
def index_search(spark, sf_dir):
    """Scores read from an inverted index after upserts, deletes, a merge and further upserts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    index = Index(spark, f"{folder(spark)}/index-{uuid.uuid4().hex}", {"text": 1.0}, key="doc_id", stems=False)
    index.write(0, docs)
    changed = docs.where("doc_id % 20 = 0").select("doc_id", F.concat("text", F.lit(" idiot with idiot")).alias("text"), F.lit("upsert").alias("op"), F.lit(1).alias("seq"))
    index.bulk(1, changed.union(docs.where("doc_id % 7 = 0").select("doc_id", F.lit(None).cast("string"), F.lit("delete"), F.lit(2))))
    index.merge(1)
    index.write(2, docs.where("doc_id % 21 = 0").select("doc_id", F.col("source").alias("text")))
    return index.scores(TERMS).select(F.col("key").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"select t as term, levenshtein(t, 'widget') as edits from (select distinct unnest({tokens_sql(canonical_sql('p_name'))}) as t from part) where levenshtein(t, 'widget') <= 2 union all select t, levenshtein(t, 'rind') from (select distinct unnest({tokens_sql(canonical_sql('p_name'))}) as t from part) where levenshtein(t, 'rind') <= 1")
def fuzzy_terms(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(T.tokens(T.canonical(F.col("p_name")))).alias("term")).distinct()
    rows = search.fuzzy_terms(words, "widget").union(search.fuzzy_terms(words, "rind"))
    return rows.select("term", F.col("edits").cast("long").alias("edits"))


@query("""with q as (select vec_id as q, embedding as e from embeddings where vec_id % 20 = 0), s as (select q, vec_id, list_cosine_similarity(q.e::double[], d.embedding::double[]) as c from q, embeddings d where d.vec_id <> q.q)
select q, vec_id from (select *, row_number() over (partition by q order by c desc, vec_id) as n from s) where n <= 10""")
def cosine_topk(spark, sf_dir):
    """Exact neighbours of the stated queries, those whose id is divisible by 20, against all vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.exact_nearest(rows, rows.where("vec_id % 20 = 0")).select("q", "vec_id")


@query()
def ann_topk(spark, sf_dir):
    """The neighbours that ``cosine_topk`` finds, by an index of lists and codes of all vectors: at least nine of ten."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index, model = vectors.build(rows, f"{folder(spark)}/vectors-{uuid.uuid4().hex}")
    found = vectors.nearest(index, rows, rows.where("vec_id % 20 = 0"), model)
    return found.select("q", F.col("id").alias("vec_id"), "place")


@query("""with a as (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as r from orders qualify r <= 200), b as (select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) as r from orders qualify r <= 200)
select coalesce(a.o_orderkey, b.o_orderkey) as id, a.r as rank_0, b.r as rank_1, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(0.5 / (60 + b.r), 0), 8)::double as fused from a full join b on a.o_orderkey = b.o_orderkey""")
def rrf_fuse(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    by = lambda c: search.ranked(orders.select(F.col("o_orderkey").alias("id"), c.alias("score")), 200)
    rows = search.fuse([(by(F.col("o_totalprice")), 1.0), (by(F.expr("unix_millis(cast(o_orderdate as timestamp))")), 0.5)])
    return rows.select("id", F.col("rank_0").cast("long").alias("rank_0"), F.col("rank_1").cast("long").alias("rank_1"), F.round("fused", 8).alias("fused"))


def _corpus(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("company_slug"), F.col("source").alias("location"), F.substring_index("text", " ", 6).alias("title"), F.col("text").alias("description"), F.lit("MID").alias("level"), (F.col("doc_id") % 2 == 0).alias("remote"), F.timestamp_millis(F.lit(1704067200000) - F.col("doc_id") * 3600000).alias("posted_at"))
    rows = rows.withColumn("c", T.canonical(F.concat_ws(" ", "title", "description")))
    return rows.withColumn("concepts", embedding.concepts(F.col("c"))).withColumn("embedding", embedding.embedder()("c")).drop("c")


@query()
def hybrid_search(spark, sf_dir):
    # The index as it is stored: its documents are made once and not again by each leg.
    return search.search(staged(_corpus(spark, sf_dir)), search.Request("the idiot with loser", size=50), datetime(2024, 1, 10))


@query(f"select doc_id as id from documents where doc_id % 2 = 0 and lang = 'en' and list_contains(['src1', 'src8'], {canonical_sql('source')})")
def filtered_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("company_slug"), F.col("source").alias("location"), (F.col("doc_id") % 2 == 0).alias("remote"), F.lit("MID").alias("level"))
    return docs.where(search.filters(search.Request(remote=True, company="en", location="src1 or src8", levels=("mid",)))).select("id")


def posting_columns(docs):
    return docs.select(F.col("doc_id").alias("posting_id"), F.col("lang").alias("company"), F.substring_index("text", " ", 6).alias("title"), F.col("text").alias("description"), F.lit("").alias("location"), F.lit(False).alias("remote"))


def _postings(spark, sf_dir):
    return posting_columns(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")))


def _prints(spark, sf_dir):
    # Shingles are told by 64 bits, and only read again where postings are scored.
    return stored(dedup.fingerprints(_postings(spark, sf_dir)).withColumn("shingles", F.transform("shingles", lambda s: F.xxhash64(s))))


def _scored_classes(spark, sf_dir):
    """Pairs between the first postings of classes of equal fingerprints, all that share a band, with the number of postings
    in each, and the membership: a pair of each further copy with its class's first."""
    prints = _prints(spark, sf_dir)
    members = dedup.classes(prints)
    sizes = members.groupBy("class_id").agg(F.count("*").alias("copies"))
    heads = prints.join(sizes.select(F.col("class_id").alias("posting_id")), "posting_id", "left_semi")
    own = sizes.where("copies > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.lit(16).cast("long").alias("matched_bands"))
    rows = dedup.scored(staged(dedup.candidates(heads, None).unionByName(own)), prints)
    for x in "ab":
        rows = rows.join(sizes.select(F.col("class_id").alias(x), F.col("copies").alias(f"copies_{x}")), x)
    copies = members.where("posting_id <> class_id").select(F.col("posting_id").alias("a"), F.col("class_id").alias("b"))
    return rows.where("a <> b").unionByName(rows.where("a = b").drop("a").join(copies, "b"))


def near_duplicate_pairs(spark, sf_dir):
    """The flagship: candidates by bands, scored and gated, from the threshold up."""
    return _scored_classes(spark, sf_dir).where("is_duplicate").select("a", "b", "copies_a", "copies_b", "matched_bands", "jaccard", "title", "score")


# Bands of five widths: neighbours share some, and the last band's buckets hold more of a company than a posting keeps.
_BANDED = "select event_id, user_id % 5 as company, list_transform(range(0, 16), lambda b: case when b = 15 then event_id // 1100 else event_id // (1 + b % 5) end) as s from events"


@query(f"""with r as (select event_id, company, b, s[b + 1] as k from (select event_id, company, s, unnest(range(0, 16)) as b from ({_BANDED}))), p as (
select x.event_id as a, y.event_id as b, count(*) as matched_bands from r x join r y on x.company = y.company and x.b = y.b and x.k = y.k and x.event_id > y.event_id group by 1, 2)
select a, b, matched_bands from p qualify row_number() over (partition by a order by matched_bands desc, b) <= 200""")
def lsh_candidates(spark, sf_dir):
    bands = F.expr("transform(sequence(0, 127), j -> cast(case when j div 8 = 15 then event_id div 1100 else event_id div (1 + j div 8 % 5) end as int))")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("posting_id"), (F.col("user_id") % 5).alias("company"), bands.alias("signature"), F.array(F.lit("x")).alias("shingles"))
    return dedup.candidates(rows)


@query()
def score_pairs(spark, sf_dir):
    return _scored_classes(spark, sf_dir).select("a", "b", "copies_a", "copies_b", "matched_bands", "jaccard", "title", "location", "score", "is_duplicate")


@query("select o_custkey, o_orderkey as best from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey) as n from orders) where n = 1")
def best_match(spark, sf_dir):
    """The best of each group, the first of equals."""
    from ..operators.ingest import latest

    return latest(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderpriority"), F.col("o_orderkey")).select("o_custkey", F.col("o_orderkey").alias("best"))


@query()
def canonicalize(spark, sf_dir):
    return dedup.canonicalize(_prints(spark, sf_dir))


@query(f"""with t as ({_TOKENS[1:-1]}), s as (select doc_id, {shingles_sql('t')} as s from t), p as (select md5(text) as m, doc_id from documents)
select count(*) filter (j >= 0.8 and same) as true_pos, count(*) filter (j >= 0.8 and not same) as false_pos, count(*) filter (j < 0.8 and same) as false_neg
from (select len(list_intersect(x.s, y.s)) / greatest(len(list_distinct(list_concat(x.s, y.s))), 1)::double as j, p.m = q.m as same from s x join s y on y.doc_id = x.doc_id + 1 join p on p.doc_id = x.doc_id join p q on q.doc_id = y.doc_id)""")
def dedup_quality(spark, sf_dir):
    """Neighbouring documents as labelled pairs: equal texts are duplicates, the decision is by shingles."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("m"), T.canonical(F.col("text")).alias("c"))
    rows = rows.select("doc_id", "m", T.shingles(T.tokens(F.col("c"))).alias("s"))
    other = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("m").alias("m2"), F.col("s").alias("s2"))
    pairs = rows.join(other, "doc_id").select((F.size(F.array_intersect("s", "s2")) / F.greatest(F.size(F.array_union("s", "s2")), F.lit(1))).alias("j"), (F.col("m") == F.col("m2")).alias("same"))
    return pairs.agg(F.count_if((F.col("j") >= 0.8) & F.col("same")).alias("true_pos"), F.count_if((F.col("j") >= 0.8) & ~F.col("same")).alias("false_pos"), F.count_if((F.col("j") < 0.8) & F.col("same")).alias("false_neg"))


