"""Parsers of three JSON feeds to one relation of postings, and the decision of a conditional fetch.

A parser takes a DataFrame with ``board_id`` and ``body`` and returns a row per posting. Bodies that aren't JSON, or lack
the array of postings, are errors of their board (``parse_errors``), never an empty board.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical

_FEED_A = "struct<jobs: array<struct<id: string, title: string, updated_at: string, absolute_url: string, content: string, location: struct<name: string>, departments: array<struct<name: string>>>>>"
_FEED_B = "array<struct<id: string, text: string, hostedUrl: string, createdAt: string, workplaceType: string, description: string, categories: struct<location: string, team: string>>>"
_FEED_C = "struct<jobs: array<struct<id: string, title: string, department: string, location: string, isRemote: string, publishedAt: string, jobUrl: string, descriptionHtml: string>>>"
# Words that say that a posting is remote.
REMOTE = ["remote", "anywhere", "distributed"]


def is_remote(location: Column, title: Column, words: list[str] = REMOTE) -> Column:
    text = canonical(F.concat_ws(" ", F.coalesce(location, F.lit("")), F.coalesce(title, F.lit(""))))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def instant(text: Column) -> Column:
    """An ISO instant or offset date-time; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(text))


def _postings(rows: DataFrame, source: str, title: str, **columns: Column) -> DataFrame:
    rows = rows.where(F.col("j.id").isNotNull() & F.col(f"j.{title}").isNotNull())
    out = {"external_id": F.col("j.id"), "title": F.col(f"j.{title}"), **columns}
    texts = ("description_html", "location", "department", "apply_url")
    return rows.select("board_id", F.lit(source).alias("source"), *[(F.coalesce(c, F.lit("")) if n in texts else c).alias(n) for n, c in out.items()], F.to_json("j").alias("raw_json"))


def parse_greenhouse(pages: DataFrame) -> DataFrame:
    rows = pages.select("board_id", F.explode(F.from_json("body", _FEED_A)["jobs"]).alias("j"))
    place = F.col("j.location.name")
    return _postings(rows, "greenhouse", "title", description_html=F.col("j.content"), location=place, remote=is_remote(place, F.col("j.title")), department=F.get(F.col("j.departments"), F.lit(0))["name"], apply_url=F.col("j.absolute_url"), posted_at=instant(F.col("j.updated_at")))


def parse_lever(pages: DataFrame) -> DataFrame:
    rows = pages.select("board_id", F.explode(F.from_json("body", _FEED_B)).alias("j"))
    place = F.col("j.categories.location")
    millis = F.when(F.col("j.createdAt").rlike(r"^-?\d+$"), F.col("j.createdAt").try_cast("long"))
    remote = F.coalesce(F.lower("j.workplaceType") == "remote", F.lit(False)) | is_remote(place, F.col("j.text"))
    return _postings(rows, "lever", "text", description_html=F.col("j.description"), location=place, remote=remote, department=F.col("j.categories.team"), apply_url=F.col("j.hostedUrl"), posted_at=F.timestamp_millis(millis))


def parse_ashby(pages: DataFrame) -> DataFrame:
    rows = pages.select("board_id", F.explode(F.from_json("body", _FEED_C)["jobs"]).alias("j"))
    place = F.col("j.location")
    stated = F.when(F.col("j.isRemote") == "true", F.lit(True)).when(F.col("j.isRemote") == "false", F.lit(False))
    return _postings(rows, "ashby", "title", description_html=F.col("j.descriptionHtml"), location=place, remote=F.coalesce(stated, is_remote(place, F.col("j.title"))), department=F.col("j.department"), apply_url=F.col("j.jobUrl"), posted_at=instant(F.col("j.publishedAt")))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"greenhouse": parse_greenhouse, "lever": parse_lever, "ashby": parse_ashby}
_SHAPES = {"greenhouse": _FEED_A, "lever": _FEED_B, "ashby": _FEED_C}


def parser(source: str) -> Callable[[DataFrame], DataFrame]:
    if source not in PARSERS:
        raise ValueError(f"unknown source {source!r}; known are {', '.join(sorted(PARSERS))}")
    return PARSERS[source]


def parse_all(pages: DataFrame) -> DataFrame:
    """Postings of ``pages(board_id, source, body)``, each by its source's parser."""
    return reduce(DataFrame.unionByName, [parse(pages.where(F.col("source") == name)) for name, parse in PARSERS.items()])


def parse_errors(pages: DataFrame) -> DataFrame:
    """(board_id, source, error) of bodies without the array that their source has."""
    found = [F.when(F.col("source") == name, F.from_json("body", shape)["jobs"].isNotNull() if shape.startswith("struct") else F.col("body").rlike(r"^\s*\[") & F.from_json("body", shape).isNotNull()) for name, shape in _SHAPES.items()]
    return pages.where(~F.coalesce(*found, F.lit(False))).select("board_id", "source", F.concat(F.lit("no postings in "), F.col("source")).alias("error"))


def board_url(source: Column, token: Column) -> Column:
    return (
        F.when(source == "greenhouse", F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), token, F.lit("/jobs?content=true")))
        .when(source == "lever", F.concat(F.lit("https://api.lever.co/v0/postings/"), token, F.lit("?mode=json")))
        .when(source == "ashby", F.concat(F.lit("https://api.ashbyhq.com/posting-api/job-board/"), token))
    )


def rate_limit_host(url: Column) -> Column:
    return F.parse_url(url, F.lit("HOST"))


def fetch_outcome(status: Column) -> Column:
    """304: nothing new. 400 and above, or no status (an exception): failed. Else: fetched."""
    return F.when(status.isNull() | (status == 0) | (status >= 400), "FAILED").when(status == 304, "NOT_MODIFIED").otherwise("FETCHED")
