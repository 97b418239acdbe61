"""Queries of text, hashing and title functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import embedding, hashing, people, scores, titles
from ..functions import text as T
from ..sources import feeds
from ..operators.staging import staged
from .base import query, spread, table, values

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def canonical_sql(column: str) -> str:
    """For texts without markup and entities."""
    return rf"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({column}, ''))), '[^a-z0-9+#./ -]', ' ', 'g'), '\s+', ' ', 'g'))"


def tokens_sql(column: str) -> str:
    return f"list_filter(string_split({column}, ' '), lambda w: length(w) >= 2 and not list_contains([{STOP}], w))"


def shingles_sql(tokens: str) -> str:
    return f"case when len({tokens}) = 0 then [] when len({tokens}) < 3 then [array_to_string({tokens}, ' ')] else list_distinct(list_transform(range(1, len({tokens}) - 1), lambda i: array_to_string({tokens}[i:i+2], ' '))) end"


def concepts_sql(canonical: str) -> str:
    """The lexicon's concepts with a form between blanks of a canonical text, in the lexicon's order."""
    each = ", ".join("case when " + " or ".join(f"contains(' ' || {canonical} || ' ', ' {form} ')" for form in forms) + f" then '{name}' end" for name, forms in embedding.LEXICON.items())
    return f"list_filter([{each}], lambda x: x is not null)"


_SCRIPTS = r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
_STRIPPED = rf"regexp_replace(regexp_replace({_SCRIPTS}, '(?i)</?(p|br|div|li|ul|ol|h[1-6]|tr|td|table|section)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
for _name, _value in T.ENTITIES:
    _STRIPPED = f"replace({_STRIPPED}, '&{_name};', '{_value.replace(chr(39), chr(39) * 2)}')"


@query(rf"select page_id, trim(regexp_replace({_STRIPPED}, '\s+', ' ', 'g')) as plain from pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


@query(f"select doc_id, {canonical_sql('text')} as canonical from documents")
def canonical_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.canonical(F.col("text")).alias("canonical"))


def _tokens(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.canonical(F.col("text")).alias("c")).select("doc_id", T.tokens(F.col("c")).alias("t"))


_TOKENS = f"(select doc_id, {tokens_sql('c')} as t from (select doc_id, {canonical_sql('text')} as c from documents))"


@query(f"select doc_id, len(t)::bigint as n_tokens, array_to_string(t, ' ') as tokens from {_TOKENS}")
def tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(f"select doc_id, s as shingle from (select doc_id, unnest({shingles_sql('t')}) as s from {_TOKENS})")
def shingles(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", F.explode(T.shingles(F.col("t"))).alias("shingle"))


@query(f"select count(*) as n, count(distinct s) as n_distinct from (select unnest({shingles_sql('t')}) as s from {_TOKENS})")
def shingle_distinct(spark, sf_dir):
    return _tokens(spark, sf_dir).select(F.explode(T.shingles(F.col("t"))).alias("s")).agg(F.count("*").alias("n"), F.count_distinct("s").alias("n_distinct"))


@query()
def fnv_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashing.fnv1a64("p_name").alias("h"))


@query()
def minhash_signature(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", hashing.minhash_words()(F.array_join("t", " ")).alias("signature"))


@query()
def minhash_estimate(spark, sf_dir):
    """Neighbouring documents' estimated and exact similarity."""
    # Signed once and staged as texts; sets of shingles are made behind the join, so that they are never shuffled.
    rows = staged(_tokens(spark, sf_dir).select("doc_id", F.array_join("t", " ").alias("w")).select("doc_id", "w", hashing.minhash_words()("w").alias("signature")))
    other = rows.select((F.col("doc_id") + 1).alias("doc_id"), F.col("w").alias("w2"), F.col("signature").alias("signature2"))
    sets = [T.shingles(F.filter(F.split(w, " "), lambda x: x != "")).alias(s) for w, s in (("w", "s"), ("w2", "s2"))]
    pairs = rows.join(other, "doc_id").select("doc_id", hashing.agreement(F.col("signature"), F.col("signature2")).alias("estimate"), *sets)
    return pairs.select("doc_id", "estimate", T.set_jaccard(F.col("s"), F.col("s2")).alias("exact"))


_BAND_ROWS = "select event_id, list_transform(range(0, 128), lambda j: (event_id * (j + 3) + user_id * (j // 4)) % 97) as s from events"


@query(f"select event_id, b::integer as band, array_to_string(s[b*8+1:b*8+8], ',') as band_key from (select event_id, s, unnest(range(0, 16)) as b from ({_BAND_ROWS}))")
def lsh_bands(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("transform(sequence(0, 127), j -> cast((event_id * (j + 3) + user_id * (j div 4)) % 97 as int))").alias("s"))
    return rows.select("event_id", F.explode(hashing.bands(F.col("s"))).alias("b")).select("event_id", "b.band", F.array_join(F.transform("b.key", lambda x: x.cast("string")), ",").alias("band_key"))


@query("select i::bigint as percent, round(1 - pow(1 - pow(i / 100.0, 8), 16), 6) as probability, round(pow(1 / 16.0, 1 / 8.0), 6) as threshold from range(0, 101) t(i)")
def banding_curve(spark, sf_dir):
    return spark.range(101).select(F.col("id").alias("percent"), F.round(hashing.retrieval_probability(F.col("id") / 100), 6).alias("probability"), F.round(F.lit(hashing.band_threshold()), 6).alias("threshold"))


@query(rf"""select o_orderkey, sha256(o_orderkey::varchar || chr(31) || {canonical_sql('o_orderpriority')} || chr(31) || lower(o_orderstatus) || chr(31) || (o_totalprice > 100000)::varchar || chr(31) || {canonical_sql("o_orderpriority || ' for ' || o_custkey")}) as fingerprint from orders""")
def content_hash(spark, sf_dir):
    text = F.concat("o_orderpriority", F.lit(" for "), F.col("o_custkey").cast("string"))
    print_ = hashing.posting_fingerprint(F.col("o_orderkey").cast("string"), T.canonical(F.col("o_orderpriority")), T.canonical(F.col("o_orderstatus")), F.col("o_totalprice") > 100000, T.canonical(text))
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.sha256(print_).alias("fingerprint"))


@query("select o_custkey, sha256(string_agg(o_orderkey::varchar || ':' || o_orderstatus || chr(31), '' order by o_orderkey)) as digest from orders group by 1")
def board_semantic_hash(spark, sf_dir):
    keyed = F.struct("o_orderkey", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("fingerprint"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(hashing.ordered_digest(F.collect_list(keyed)).alias("digest"))


@query("select vec_id % 50 as salt, vec_id as code, sha256((vec_id % 50)::varchar || vec_id::varchar) as salted from embeddings")
def salted_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("salt"), F.col("vec_id").alias("code"))
    return rows.withColumn("salted", people.salted(F.col("salt").cast("string"), F.col("code").cast("string")))


@query("select event_id, (epoch_us(ts) // 1000)::bigint as ms from events")
def uuid7_ts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.expr("cast(ts as timestamp)")).alias("at"))
    rows = rows.select("event_id", hashing.uuid7("at").alias("uuid"))
    return rows.where(F.col("uuid").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab]")).select("event_id", hashing.uuid7_millis(F.col("uuid")).alias("ms"))


TITLES = [
    "Senior Software Engineer, Payments", "Sr. Backend Engineer", "Staff Site Reliability Engineer", "SDE-1", "SDE-2", "SDE III", "Software Engineer II", "Software Engineer I",
    "Member of Technical Staff", "Senior Member of Technical Staff", "SMTS", "Principal Engineer - Search", "Engineering Manager, Platform", "Product Manager", "Senior Product Manager, Growth",
    "Technical Program Manager", "VP Engineering", "Vice President of Product", "Director of Engineering", "Head of Data", "Machine Learning Engineer", "ML Engineer II", "Research Scientist",
    "Data Scientist", "Senior Data Engineer (Remote)", "Business Analyst", "Security Engineer", "SDET", "Android Developer", "iOS Engineer", "Front-End Developer", "Full Stack Engineer",
    "UX Designer", "Solutions Architect", "Junior Developer", "New Grad Software Engineer", "Software Engineering Intern", "Co-op Engineer", "Tech Lead", "Lead Engineer | Billing", "Level 3 Support",
    "Distinguished Engineer", "Chef", "", "DevOps Engineer req #1234", "Backend Engineer jr #77", "Platform Engineer / Infrastructure", "Analyst 2", "Designer i", "Fellow", "Office Manager", "QA Engineer 3",
]
_TITLE_ROWS = values([(i, t) for i, t in enumerate(TITLES)], "id, title")
_CANON = canonical_sql("title")
_PREPARED = rf"trim(regexp_replace(regexp_replace(regexp_replace({_CANON}, '{titles.REQUISITION}', ' ', 'g'), '{titles.SEPARATOR}', ' ', 'g'), '\s+', ' ', 'g'))"
_PREPARED_ROWS = f"(select id, title, {_PREPARED} as t from {_TITLE_ROWS})"
_LEVEL = titles.rules_sql("t", titles.LEVELS, f"'{titles.UNSPECIFIED}'")
_ROLE = titles.rules_sql("t", titles.ROLES, "case when t = '' then 'unknown' else t end")
_SPECIAL = rf"trim(regexp_replace(regexp_replace({titles.replaced_sql('t', [*[p for p, _ in titles.ROLES], *[p for p, _ in titles.LEVELS], titles.RUNGS, titles.GENERIC])}, '[^a-z0-9+# ]', ' ', 'g'), '\s+', ' ', 'g'))"


def _titles(spark):
    rows = spark.sql(f"select cast(id as long) as id, title from {_TITLE_ROWS}")
    return rows.withColumn("t", titles.prepared(T.canonical(F.col("title"))))


@query(f"select id::bigint as id, t as prepared, {_ROLE} as role, {_LEVEL} as level, {_SPECIAL} as specialization from {_PREPARED_ROWS}")
def title_normalize(spark, sf_dir):
    t = F.col("t")
    return _titles(spark).select("id", t.alias("prepared"), titles.role(t).alias("role"), titles.level(t).alias("level"), titles.specialization(t).alias("specialization"))


@query(f"select {_LEVEL} as level, count(*) as n from {_PREPARED_ROWS} group by 1")
def title_level(spark, sf_dir):
    return _titles(spark).groupBy(titles.level(F.col("t")).alias("level")).agg(F.count("*").alias("n"))


@query(f"select {_ROLE} as role, count(*) as n from {_PREPARED_ROWS} group by 1")
def title_role(spark, sf_dir):
    return _titles(spark).groupBy(titles.role(F.col("t")).alias("role")).agg(F.count("*").alias("n"))


@query(f"select id::bigint as id, {_SPECIAL} as specialization from {_PREPARED_ROWS}")
def title_specialization(spark, sf_dir):
    return _titles(spark).select("id", titles.specialization(F.col("t")).alias("specialization"))


@query(f"select id::bigint as id, lower({_LEVEL}) || '|' || {_ROLE} as title_key from {_PREPARED_ROWS}")
def title_key(spark, sf_dir):
    return _titles(spark).select("id", titles.key(titles.level(F.col("t")), titles.role(F.col("t"))).alias("title_key"))


_LADDER = [(i, x) for i, x in enumerate(titles.LADDER)] + [(None, titles.UNSPECIFIED)]
_RUNGS = f"(select * from {values(_LADDER, 'rung, level')})"


def _level_pairs(spark):
    rows = spark.sql(f"select * from {_RUNGS}").select("level")
    return rows.select(F.col("level").alias("a")).crossJoin(rows.select(F.col("level").alias("b")))  # ten levels


@query(f"select x.level as a, y.level as b, coalesce(abs(x.rung - y.rung), 0)::integer as distance, coalesce(x.rung <= 5, false) as contributor from {_RUNGS} x, {_RUNGS} y")
def ladder_distance(spark, sf_dir):
    return _level_pairs(spark).select("a", "b", titles.ladder_distance(F.col("a"), F.col("b")).alias("distance"), titles.is_contributor(F.col("a")).alias("contributor"))


@query(f"""select x.level as a, y.level as b, case when x.rung is null or y.rung is null then 1.0::double when (x.rung <= 5) <> (y.rung <= 5) then 0.0 when x.rung = y.rung then 1.0
  when abs(x.rung - y.rung) = 1 then 0.85 when abs(x.rung - y.rung) = 2 then 0.35 else 0.0 end::double as gate from {_RUNGS} x, {_RUNGS} y""")
def level_gate_matrix(spark, sf_dir):
    return _level_pairs(spark).select("a", "b", scores.level_gate(F.col("a"), F.col("b")).alias("gate"))


@query(f"""select x.level as a, y.level as b, case when x.rung is null or y.rung is null then 0.5 when y.rung - x.rung < 0 then greatest(0, 0.5 + 0.25 * (y.rung - x.rung))
  when y.rung - x.rung <= 1 then 1 when y.rung - x.rung = 2 then 0.75 when y.rung - x.rung = 3 then 0.5 else 0.25 end::double as fit from {_RUNGS} x, {_RUNGS} y""")
def seniority_fit(spark, sf_dir):
    return _level_pairs(spark).select("a", "b", scores.seniority_fit(F.col("a"), F.col("b")).alias("fit"))


def _jaccard_sql(a: str, b: str) -> str:
    return f"case when len({a}) = 0 and len({b}) = 0 then 1.0 when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::double end"


_TITLE_PARTS = f"(select id, {_ROLE} as role, {_SPECIAL} as special, {_LEVEL} as level from {_PREPARED_ROWS})"
_WITH_WORDS = f"(select p.*, r.rung, list_distinct({tokens_sql('role')}) as rw, list_distinct({tokens_sql('special')}) as sw from {_TITLE_PARTS} p join {_RUNGS} r on r.level = p.level)"


@query(f"""with w as materialized (select * from {_WITH_WORDS}) select x.id::bigint as a, y.id::bigint as b, round(0.5 * (case when x.role = y.role then 1.0 else {_jaccard_sql('x.rw', 'y.rw')} end) + 0.3 * (1 - least(coalesce(abs(x.rung - y.rung), 0), 3) / 3.0)
  + 0.2 * (case when x.special = '' and y.special = '' then 1.0 else {_jaccard_sql('x.sw', 'y.sw')} end), 6) as score from w x, w y where x.id < y.id""")
def title_score_pairs(spark, sf_dir):
    t = F.col("t")
    rows = _titles(spark).select("id", F.struct(titles.role(t).alias("role"), titles.level(t).alias("level"), titles.specialization(t).alias("specialization")).alias("p"))
    pairs = rows.select(F.col("id").alias("a"), F.col("p").alias("x")).crossJoin(F.broadcast(rows.select(F.col("id").alias("b"), F.col("p").alias("y")))).where("a < b")  # the literal titles above
    side = lambda s: {c: F.col(f"{s}.{c}") for c in ("role", "level", "specialization")}
    return pairs.select("a", "b", F.round(titles.title_score(side("x"), side("y")), 6).alias("score"))


PLACES = [("", False), ("", True), ("san francisco", False), ("san francisco ca united states", False), ("san diego ca", False), ("remote us", True), ("berlin germany", False), ("berlin", False), ("munich germany", False)]
_PLACES = f"(select id, loc, remote, list_distinct({tokens_sql('loc')}) as w from {values([(i, a, r) for i, (a, r) in enumerate(PLACES)], 'id, loc, remote')})"
_PLACE_SCORE = f"""case when x.remote and y.remote then 1.0 when x.loc = '' and y.loc = '' then 0.5 when x.loc = '' or y.loc = '' then 0.3 when x.loc = y.loc then 1.0
  when contains(x.loc, y.loc) or contains(y.loc, x.loc) then 0.8 when len(list_intersect(x.w, y.w)) > 0 then 0.4 + 0.4 * {_jaccard_sql('x.w', 'y.w')} when x.remote <> y.remote then 0.0 else 0.1 end"""


@query(f"""select a, b, round(score, 6)::double as score, case when xr <> yr then 0.0 when score >= 0.8 then 1.0 when xl = '' or yl = '' then 0.9 when score >= 0.4 then 0.85 else 0.25 end::double as gate
  from (select x.id::bigint as a, y.id::bigint as b, ({_PLACE_SCORE})::double as score, x.loc as xl, y.loc as yl, x.remote as xr, y.remote as yr from {_PLACES} x, {_PLACES} y)""")
def location_score_pairs(spark, sf_dir):
    rows = spark.sql(f"select cast(id as long) as id, loc, remote from {values([(i, a, r) for i, (a, r) in enumerate(PLACES)], 'id, loc, remote')}")
    pairs = rows.select(F.col("id").alias("a"), F.struct("loc", "remote").alias("x")).crossJoin(F.broadcast(rows.select(F.col("id").alias("b"), F.struct("loc", "remote").alias("y"))))  # nine places
    place = [F.col("x.loc"), F.col("y.loc"), F.col("x.remote"), F.col("y.remote")]
    pairs = pairs.withColumn("score", scores.location_score(*place))
    return pairs.select("a", "b", F.round("score", 6).alias("score"), scores.location_gate(*place, F.col("score")).alias("gate"))


JOB_TEXTS = [
    "We need a senior Site Reliability Engineer with Kubernetes and Terraform. On call rotation.", "Backend engineer for payments: ledger, Postgres, Kafka and Java", "Machine learning on PyTorch; recommendation and ranking",
    "React front end with TypeScript, accessible and fast", "Golang microservices on AWS and gRPC for google cloud", "Office manager", "", "Data pipeline work in Spark, Airflow and SQL; remote from anywhere",
]
_JOB_ROWS = f"(select id, {canonical_sql('text')} as c from {values(list(enumerate(JOB_TEXTS)), 'id, text')})"
_CONCEPTS = " union all ".join(f"select id, {i} as n, '{name}' as concept from j where " + " or ".join(f"contains(' ' || c || ' ', ' {f} ')" for f in forms) for i, (name, forms) in enumerate(embedding.LEXICON.items()))


def _jobs(spark):
    return spark.sql(f"select cast(id as long) as id, text from {values(list(enumerate(JOB_TEXTS)), 'id, text')}").withColumn("c", T.canonical(F.col("text")))


@query(f"with j as (select * from {_JOB_ROWS}) select j.id::bigint as id, coalesce(string_agg(k.concept, ',' order by k.n), '') as concepts from j left join ({_CONCEPTS}) k on k.id = j.id group by 1")
def concepts(spark, sf_dir):
    return _jobs(spark).select("id", F.array_join(embedding.concepts(F.col("c")), ",").alias("concepts"))


@query(f"select id::bigint as id, array_to_string(list_sort(list_filter([{', '.join(repr(t) for t in embedding.TECHNOLOGIES)}], lambda t: contains(c, t))), ',') as stack from {_JOB_ROWS}")
def tech_stack(spark, sf_dir):
    return _jobs(spark).select("id", F.array_join(embedding.tech_stack(F.col("c")), ",").alias("stack"))


@query()
def embed_text(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.canonical(F.col("text")).alias("c"))
    return docs.select("doc_id", F.lit(embedding.MODEL).alias("model_id"), embedding.embedder()("c").alias("embedding"))


@query(f"""with t as ({_TOKENS[1:-1]}), s as (select doc_id, {shingles_sql('t')} as s from t)
select a.doc_id as a, b.doc_id as b, round({_jaccard_sql('a.s', 'b.s')}, 6)::double as jaccard from s a join s b on b.doc_id = a.doc_id + 1""")
def jaccard_pairs(spark, sf_dir):
    rows = _tokens(spark, sf_dir).select("doc_id", T.shingles(F.col("t")).alias("s"))
    other = rows.select(F.col("doc_id").alias("b"), (F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("s2"))
    return rows.join(other, "doc_id").select(F.col("doc_id").alias("a"), "b", F.round(T.jaccard(F.col("s"), F.col("s2")), 6).alias("jaccard"))


@query("""with p as (select p_partkey, list_distinct(list_filter(list_transform(string_split(p_name || ' ' || p_type, ' '), lambda x: trim(lower(x))), lambda x: x <> '')) as s from part)
select a.p_partkey as a, b.p_partkey as b, round(case when len(a.s) = 0 or len(b.s) = 0 then 0.0 else len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::double end, 6)::double as jaccard from p a join p b on b.p_partkey = a.p_partkey + 7""")
def stack_jaccard(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("s"))
    other = rows.select(F.col("p_partkey").alias("b"), (F.col("p_partkey") - 7).alias("p_partkey"), F.col("s").alias("s2"))
    return rows.join(other, "p_partkey").select(F.col("p_partkey").alias("a"), "b", F.round(T.stack_jaccard(F.col("s"), F.col("s2")), 6).alias("jaccard"))


@query(f"select doc_id, regexp_matches({canonical_sql('text')}, 'remote|anywhere|distributed|idiot') as remote from documents")
def infer_remote(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", feeds.is_remote(F.col("text"), F.lit(""), [*feeds.REMOTE, "idiot"]).alias("remote"))


@query("select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from pages")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", feeds.rate_limit_host(F.col("url")).alias("host"))


EMAILS = [("a@acme.com", "acme.com"), ("a@eu.acme.com", "acme.com"), ("a@notacme.com", "acme.com"), ("a@acme.com.evil.net", "acme.com"), ("x@gmail.com", "gmail.com"), ("bad", "acme.com"), ("A.B+c@Acme.COM", " ACME.com "), ("a@acme.com", ""), (None, "acme.com")]
_EMAILS = values([(i, a, b) for i, (a, b) in enumerate(EMAILS)], "id, email, company")


@query(rf"""select id::bigint as id, ok as well_formed, d as domain, coalesce(ok and c <> '' and not list_contains([{', '.join(repr(d) for d in people.CONSUMER)}], d) and (d = c or ends_with(d, '.' || c)), false) as at_company from (
  select id, coalesce(regexp_matches(email, '{people.EMAIL}'), false) as ok, case when regexp_matches(email, '{people.EMAIL}') then lower(split_part(email, '@', 2)) end as d, lower(trim(company)) as c from {_EMAILS})""")
def work_email(spark, sf_dir):
    rows = spark.sql(f"select cast(id as long) as id, email, company from {_EMAILS}")
    return rows.select("id", people.well_formed(F.col("email")).alias("well_formed"), people.domain(F.col("email")).alias("domain"), people.at_company(F.col("email"), F.col("company")).alias("at_company"))


@query(r"select c_custkey, regexp_matches(lower(c_mktsegment), '^[a-z0-9-]{2,64}$') as slug_ok, c_mktsegment in ('BUILDING', 'MACHINERY') as source_ok, regexp_matches(lpad((c_custkey % 2000000)::varchar, 6, '0'), '^[0-9]{6}$') as code_ok from customer")
def validate_input(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", F.lower("c_mktsegment").rlike("^[a-z0-9-]{2,64}$").alias("slug_ok"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("source_ok"), F.lpad((F.col("c_custkey") % 2000000).cast("string"), 6, "0").rlike("^[0-9]{6}$").alias("code_ok"))


@query("select event_id, user_id, event_type, (props->>'$.k')::bigint as k from events")
def json_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type", "props", F.lit(1).alias("unknown"))).alias("j"))
    rows = rows.select(F.from_json("j", "event_id long, user_id long, event_type string, props string").alias("r")).select("r.*")
    return rows.select("event_id", "user_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))


@query("select event_id, (epoch_us(date_trunc('day', ts)) // 1000)::bigint as day_ms, (epoch_us(ts) // 1000)::bigint as ms, ((epoch_us(timestamp '2024-02-01 00:00:00') // 1000) - (epoch_us(ts) // 1000))::bigint as age_ms, (epoch_us(ts + interval 90 day) // 1000)::bigint as lease_ms from events")
def date_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    ms = lambda c: F.expr(f"unix_millis(cast({c} as timestamp))")
    return rows.select("event_id", ms("date_trunc('day', ts)").alias("day_ms"), ms("ts").alias("ms"), (ms("timestamp_ntz '2024-02-01 00:00:00'") - ms("ts")).alias("age_ms"), ms("ts + interval 90 days").alias("lease_ms"))
