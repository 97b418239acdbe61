"""Concept-hashing embeddings of job texts, and similarity of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .hashing import fnv1a
from .text import STOPWORDS

DIMENSIONS, CONCEPT_WEIGHT, TOKEN_WEIGHT, MODEL = 256, 4.0, 1.0, "concept-hash-256"
# The default lexicon, concept by concept, with the usual surface forms. Pass another for more.
LEXICON = {
    "software-engineering": ["software engineer", "software developer", "programmer", "sde", "swe", "engineer"],
    "reliability": ["site reliability engineer", "production engineering", "devops", "sre", "on call"],
    "kubernetes": ["container orchestration", "kubernetes", "k8s", "helm"],
    "containers": ["docker", "containerd"],
    "machine-learning": ["machine learning", "deep learning", "ml", "pytorch", "tensorflow"],
    "ranking": ["learning to rank", "recommendation", "recsys"],
    "search": ["information retrieval", "full text search", "bm25", "elasticsearch", "opensearch"],
    "data-engineering": ["data pipeline", "etl", "data warehouse", "spark", "airflow"],
    "streaming": ["stream processing", "event streaming", "kafka", "flink"],
    "payments": ["payment processing", "money movement", "ledger", "billing", "fintech"],
    "frontend": ["front end", "frontend", "react", "typescript", "javascript"],
    "backend": ["back end", "backend", "microservices", "distributed systems"],
    "mobile": ["ios", "android", "swift", "mobile app"],
    "security": ["application security", "appsec", "cryptography"],
    "cloud": ["aws", "azure", "gcp", "cloud native", "serverless"],
    "iac": ["infrastructure as code", "terraform", "ansible"],
    "observability": ["monitoring", "prometheus", "grafana", "opentelemetry"],
    "ci-cd": ["continuous integration", "continuous delivery", "jenkins"],
    "database": ["postgres", "postgresql", "mysql", "sql"],
    "nosql": ["cassandra", "dynamodb", "mongodb"],
    "caching": ["redis", "memcached"],
    "java": ["java", "jvm", "spring boot"],
    "go": ["golang"],
    "python": ["python", "django", "pandas"],
    "remote-work": ["remote", "work from home", "anywhere"],
    "seniority-senior": ["senior", "sr"],
    "seniority-staff": ["staff", "tech lead", "principal"],
    "seniority-entry": ["junior", "graduate", "intern"],
    "management": ["engineering manager", "people manager"],
    "product": ["product manager", "product owner", "roadmap"],
    "testing": ["quality assurance", "test automation", "sdet"],
}
# Technologies that are looked for in free text.
TECHNOLOGIES = (
    "java kotlin go golang python typescript javascript react kubernetes k8s docker terraform aws gcp azure kafka postgres "
    "postgresql redis spark flink opensearch elasticsearch grpc graphql rust scala swift pytorch"
).split()


def concepts(canonical_text: Column, lexicon: dict[str, list[str]] = LEXICON) -> Column:
    """The concepts of which a form stands in the text between blanks, in the lexicon's order."""
    text = F.concat(F.lit(" "), canonical_text, F.lit(" "))
    entries = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[F.lit(f" {form} ") for form in forms]).alias("forms")) for name, forms in lexicon.items()])
    return F.transform(F.filter(entries, lambda e: F.exists(e["forms"], lambda form: F.contains(text, form))), lambda e: e["name"])


def tech_stack(canonical_text: Column) -> Column:
    """Known technologies that the text contains, as parts of words too, sorted."""
    return F.array_sort(F.filter(F.array(*[F.lit(t) for t in TECHNOLOGIES]), lambda t: F.contains(canonical_text, t)))


def _spread(h: int) -> int:
    h ^= h >> 33
    h = (h * 0xFF51AFD7ED558CCD) & ((1 << 64) - 1)
    return h ^ (h >> 33)


def embed_words(names: list[str], words: list[str]) -> np.ndarray:
    """A unit vector: each concept and each word adds its weight, with a sign, at its bucket. No words: the first axis."""
    out = np.zeros(DIMENSIONS, np.float32)
    for weight, terms in ((CONCEPT_WEIGHT, [f"concept:{n}" for n in names]), (TOKEN_WEIGHT, [f"token:{w}" for w in words])):
        for term in terms:
            h = _spread(fnv1a(term.encode()))
            out[h % DIMENSIONS] += weight if h >> 63 == 0 else -weight
    norm = np.sqrt((out * out).sum(dtype=np.float32))
    if norm == 0:
        out[0] = 1
        return out
    return out / norm


def embedder(lexicon: dict[str, list[str]] = LEXICON):
    """A vectorised UDF of canonical texts; terms are hashed once per worker."""
    known: dict[str, tuple[int, float]] = {}
    stop = set(STOPWORDS)

    def place(term: str) -> tuple[int, float]:
        if term not in known:
            if len(known) > 100_000:
                known.clear()
            h = _spread(fnv1a(term.encode()))
            known[term] = (h % DIMENSIONS, 1.0 if h >> 63 == 0 else -1.0)
        return known[term]

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pa.Array) -> pa.Array:
        vectors = np.zeros((len(texts), DIMENSIONS), np.float32)
        for lo, hi, _, _ in kernels.pieces(texts):
            for vector, text in zip(vectors[lo:hi], texts.slice(lo, hi - lo).to_pylist()):
                text = text or ""
                padded = f" {text} "
                terms = [(f"concept:{n}", CONCEPT_WEIGHT) for n, forms in lexicon.items() if any(f" {f} " in padded for f in forms)]
                terms += [(f"token:{w}", TOKEN_WEIGHT) for w in text.split(" ") if len(w) >= 2 and w not in stop]
                for term, weight in terms:
                    at, sign = place(term)
                    vector[at] += weight * sign
                norm = np.sqrt((vector * vector).sum(dtype=np.float32))
                if norm == 0:
                    vector[0] = norm = np.float32(1)
                vector /= norm
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * DIMENSIONS, vectors.ravel())

    return embed


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
