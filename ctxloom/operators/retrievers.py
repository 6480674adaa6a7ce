"""Retrievers: functions from a table of requests to scored candidates.

Each takes (requests, tables) with requests(request_id, session_id, task, ...) and returns
candidates(request_id, block_id, score float, source), the best limit of each request, or all of them where limit
is None. Scores are single precision, as ranking and ties depend on it.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import timestamp_ms
from ..functions.text import body_text, each_term, f32, ratio32, terms
from ..plans.models import RETRIEVAL_LIMIT
from ..sources.tables import Tables

Retriever = Callable[[DataFrame, Tables], DataFrame]
CANDIDATES = ["request_id", "block_id", "score", "source"]


def _clamp(score: Column) -> Column:
    return f32(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def _best(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """The first limit rows of each request, or all rows where there is no limit. Spark also cuts each partition to them
    before the shuffle, for limits up to a threshold, which is raised to this one."""
    if limit is None:
        return df
    conf, key = df.sparkSession.conf, "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(conf.get(key)) < limit:
        conf.set(key, str(limit))
    w = Window.partitionBy("request_id").orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= limit).drop("__rank")


def _members(requests: DataFrame, tables: Tables, *columns: str) -> DataFrame:
    return requests.select("request_id", "session_id", *columns).join(tables.session_blocks, "session_id")


@dataclass(frozen=True)
class Session:
    """Every block of the session at one score; beyond the limit the oldest stay."""

    score: float = 0.5
    limit: int | None = RETRIEVAL_LIMIT
    name: str = "session"

    def __call__(self, requests: DataFrame, tables: Tables) -> DataFrame:
        out = _best(_members(requests, tables), self.limit, F.col("block_id"))
        return out.select("request_id", "block_id", _clamp(F.lit(self.score)).alias("score"), F.lit(self.name).alias("source"))


@dataclass(frozen=True)
class Recency:
    """By the time inside the id: linear over the session's span, or halved every half_life_s seconds. Reads no bodies."""

    half_life_s: float | None = None
    limit: int | None = RETRIEVAL_LIMIT
    name: str = "recency"

    def __call__(self, requests: DataFrame, tables: Tables) -> DataFrame:
        m = tables.session_blocks.join(requests.select("session_id").distinct(), "session_id", "left_semi").withColumn("ts", timestamp_ms(F.col("block_id")))
        span = m.groupBy("session_id").agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
        rows = requests.select("request_id", "session_id").join(m, "session_id").join(span, "session_id")
        if self.half_life_s is None:
            score = ratio32(F.col("ts") - F.col("low"), F.greatest(F.col("high") - F.col("low"), F.lit(1)))
        else:
            half = max(max(self.half_life_s, 0.0) * 1000.0, 1.0)
            score = F.pow(F.lit(2.0), -ratio32(F.col("high") - F.col("ts"), F.lit(half)))
        rows = rows.select("request_id", "block_id", _clamp(score).alias("score"))
        return _best(rows, self.limit, F.desc("score"), F.col("block_id")).withColumn("source", F.lit(self.name))


def _texts(requests: DataFrame, tables: Tables) -> DataFrame:
    """(session_id, block_id, text) of the requests' sessions; bodies that are not UTF-8 are left out."""
    m = tables.session_blocks.join(requests.select("session_id").distinct(), "session_id", "left_semi")
    return m.join(tables.blocks.select("block_id", body_text(F.col("body")).alias("text")), "block_id").filter("text is not null")


@dataclass(frozen=True)
class Lexical:
    """Shared terms over the block's terms, both as sets."""

    min_word_len: int = 3
    limit: int | None = RETRIEVAL_LIMIT
    name: str = "lexical"

    def __call__(self, requests: DataFrame, tables: Tables) -> DataFrame:
        asks = requests.select("request_id", "session_id", F.array_distinct(terms(F.coalesce("task", F.lit("")), self.min_word_len)).alias("asked")).filter(F.size("asked") > 0)
        docs = _texts(asks, tables).select("session_id", "block_id", F.array_distinct(terms(F.col("text"), self.min_word_len)).alias("has"))
        both = asks.join(docs, "session_id").withColumn("n", F.size(F.array_intersect("asked", "has"))).filter("n > 0")
        rows = both.select("request_id", "block_id", ratio32(F.col("n"), F.size("has")).alias("score"))
        return _best(rows, self.limit, F.desc("score"), F.col("block_id")).withColumn("source", F.lit(self.name))


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, to be broadcast if it has no more than rows: counted first, up to that many."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@dataclass(frozen=True)
class Bm25:
    """Okapi over the session, the query as a set of terms, divided by the best score of the request.

    Words are counted by block and term where the term is one of the session's queries, by block alone where it
    is not, before anything is shuffled. Sums run in term order in double precision.
    """

    k1: float = 1.2
    b: float = 0.75
    min_word_len: int = 2
    limit: int | None = RETRIEVAL_LIMIT
    name: str = "bm25"

    def __call__(self, requests: DataFrame, tables: Tables) -> DataFrame:
        asks = requests.select("request_id", "session_id", F.sort_array(F.array_distinct(terms(F.coalesce("task", F.lit("")), self.min_word_len))).alias("asked")).filter(F.size("asked") > 0)
        words = each_term(_texts(asks, tables), "text", self.min_word_len)
        hits = small(asks.select("session_id", F.explode("asked").alias("term")).distinct().withColumn("asked", F.lit(True)))
        counts = words.join(hits, ["session_id", "term"], "left").groupBy("session_id", "block_id", F.when(F.col("asked"), F.col("term")).alias("term")).agg(F.count(F.lit(1)).alias("n"))
        # a map has one entry at most for each term of the session's queries
        entry = F.when(F.col("term").isNotNull(), F.struct("term", "n"))
        docs = counts.groupBy("session_id", "block_id").agg(F.sum("n").alias("dl"), F.map_from_entries(F.collect_list(entry)).alias("tf"))
        # by session, in one aggregate: blocks and their mean length under no term, blocks that have it under each term
        every = docs.select("session_id", F.least("dl", F.lit(65535)).alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.map_keys("tf"))).alias("term"))
        every = every.groupBy("session_id", "term").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
        whole = F.col("term").isNull()
        stats = every.groupBy("session_id").agg(F.max(F.when(whole, F.col("n"))).alias("n"), F.max(F.when(whole, F.col("avgdl"))).alias("avgdl"), F.map_from_entries(F.collect_list(entry)).alias("df"))
        rows = asks.join(docs.filter(F.size("tf") > 0), "session_id").join(stats, "session_id")
        idf = lambda t: F.log((F.col("n") - F.element_at("df", t) + 0.5) / (F.element_at("df", t) + 0.5) + 1.0)
        length = self.k1 * (1 - self.b + self.b * F.col("dl") / F.col("avgdl"))
        part = lambda t, f: F.when(f > 0, idf(t) * f * (self.k1 + 1) / (f + length)).otherwise(0.0)
        raw = F.aggregate("asked", F.lit(0.0), lambda s, t: s + part(t, F.try_element_at("tf", t)))
        raw = rows.select("request_id", "block_id", raw.alias("raw")).filter("raw > 0")
        scored = raw.join(raw.groupBy("request_id").agg(F.max("raw").alias("top")), "request_id").select("request_id", "block_id", _clamp(F.col("raw") / F.col("top")).alias("score"))
        return _best(scored, self.limit, F.desc("score"), F.col("block_id")).withColumn("source", F.lit(self.name))


@dataclass(frozen=True)
class Pinned:
    """Fixed ids at score 1, the first limit of them."""

    ids: tuple[str, ...] = ()
    limit: int | None = RETRIEVAL_LIMIT
    name: str = "pinned"

    def __call__(self, requests: DataFrame, tables: Tables) -> DataFrame:
        ids = F.array(*[F.lit(i) for i in self.ids[: self.limit]]).cast("array<string>")
        return requests.select("request_id", F.explode(ids).alias("block_id"), f32(F.lit(1.0)).alias("score"), F.lit(self.name).alias("source"))


@dataclass(frozen=True)
class Shared:
    """Blocks of another session, such as global facts, offered to every request."""

    session_id: str
    score: float = 0.5
    limit: int | None = RETRIEVAL_LIMIT
    name: str = "shared"

    def __call__(self, requests: DataFrame, tables: Tables) -> DataFrame:
        ids = requests.select("request_id", F.lit(self.session_id).alias("session_id"))
        return Session(self.score, self.limit, self.name)(ids, tables)


class PythonRetriever:
    """An object with name and retrieve(session, task, limit) -> [(32 hex digits, score)], asked once for each request in an Arrow batch.
    limit is None where all are asked for."""

    def __init__(self, inner, limit: int | None = RETRIEVAL_LIMIT):
        self.inner, self.limit, self.name = inner, limit, inner.name

    def __call__(self, requests: DataFrame, tables: Tables) -> DataFrame:
        inner, limit = self.inner, self.limit

        def run(batches):
            import re

            import pandas as pd

            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    for item in list(inner.retrieve(int(r.session_id, 16), r.task or "", limit))[:limit]:
                        block, score = item
                        if not re.fullmatch("[0-9a-fA-F]{32}", block):
                            raise ValueError(f"{inner.name}: not a block id: {block!r}")
                        rows.append((r.request_id, block.lower(), min(1.0, max(0.0, float(score)))))
                yield pd.DataFrame(rows, columns=["request_id", "block_id", "score"])

        out = requests.select("request_id", "session_id", "task").mapInPandas(run, "request_id string, block_id string, score float")
        return out.withColumn("source", F.lit(self.name))


def merge(requests: DataFrame, tables: Tables, retrievers: Iterable[Retriever]) -> DataFrame:
    """(request_id, block_id, score): the best score that any retriever gives a block."""
    out = None
    for r in retrievers:
        c = r(requests, tables).select("request_id", "block_id", "score")
        out = c if out is None else out.unionByName(c)
    if out is None:
        out = requests.sparkSession.createDataFrame([], "request_id string, block_id string, score float")
    return out.groupBy("request_id", "block_id").agg(F.max("score").alias("score"))


#: What a configuration may name.
KINDS = {"session": Session, "recency": Recency, "lexical": Lexical, "bm25": Bm25}


def from_config(kind: str, **options) -> Retriever:
    if kind not in KINDS:
        raise ValueError(f"unknown retriever {kind!r}; known: {', '.join(sorted(KINDS))}")
    try:
        return KINDS[kind](**options)
    except TypeError as e:
        raise ValueError(f"retriever {kind!r}: {e}") from e
