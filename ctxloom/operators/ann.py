"""Vector retrieval: exact cosine within a session, and a signature index for approximate search."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import body_text, f32
from ..functions.vectors import cosine, dot, norm
from ..plans.models import RETRIEVAL_LIMIT
from ..sources.tables import Tables
from .retrievers import _best


@dataclass(frozen=True)
class Embedder:
    """name, dimensions, and embed_batch(list of texts) -> list of vectors, called on executors."""

    name: str
    dimensions: int
    embed_batch: Callable[[list[str]], list[list[float]]]

    def column(self):
        inner, n = self.embed_batch, self.dimensions

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                got = inner(s.tolist()) if len(s) else []
                if any(len(v) != n for v in got) or len(got) != len(s):
                    raise ValueError("an embedder must return one vector of its dimensions for each text")
                yield pd.Series([list(map(float, v)) for v in got])

        return embed


def latest(cache: DataFrame) -> DataFrame:
    """The last version of each (embedder, content_hash)."""
    return cache.groupBy("embedder", "content_hash").agg(F.max_by("vector", "version").alias("vector"))


def embed_missing(blocks: DataFrame, cache: DataFrame, embedder: Embedder, version: int) -> DataFrame:
    """New cache rows for the distinct bodies that the cache lacks; bodies that are not UTF-8 are left out."""
    have = cache.filter(F.col("embedder") == embedder.name).select("content_hash")
    texts = blocks.select("content_hash", body_text(F.col("body")).alias("text")).filter("text is not null").dropDuplicates(["content_hash"]).join(have, "content_hash", "left_anti")
    return texts.select(F.lit(embedder.name).alias("embedder"), "content_hash", F.lit(embedder.dimensions).alias("dim"), embedder.column()(F.col("text")).alias("vector"), F.lit(version).cast("long").alias("version"))


@dataclass(frozen=True)
class AnnExact:
    """Cosine of the request's task_vector with each block of its session that the cache knows; zero scores go."""

    cache: DataFrame
    embedder: str
    limit: int | None = RETRIEVAL_LIMIT
    name: str = "ann-linear"

    def __call__(self, requests: DataFrame, tables: Tables) -> DataFrame:
        asks = requests.select("request_id", "session_id", "task_vector").filter(F.col("task_vector").isNotNull()).withColumn("qn", norm(F.col("task_vector")))
        vectors = latest(self.cache.filter(F.col("embedder") == self.embedder)).select("content_hash", "vector").withColumn("vn", norm(F.col("vector")))
        docs = tables.session_blocks.join(asks.select("session_id").distinct(), "session_id", "left_semi").join(tables.blocks.select("block_id", "content_hash"), "block_id").join(vectors, "content_hash")
        rows = asks.join(docs, "session_id").select("request_id", "block_id", f32(cosine(F.col("task_vector"), F.col("vector"), F.col("qn"), F.col("vn"))).alias("score")).filter("score > 0")
        return _best(rows, self.limit, F.desc("score"), F.col("block_id")).withColumn("source", F.lit(self.name))


def planes(dim: int, bits: int, seed: int = 11) -> list[list[float]]:
    import numpy as np

    return np.random.default_rng(seed).standard_normal((bits, dim)).round(6).tolist()


def signatures(df: DataFrame, vector: str, dim: int, bands: int, bits: int) -> DataFrame:
    """One row for each band, with the band's sign bits."""
    keys = []
    for band in range(bands):
        key = F.lit(0).cast("long")
        for i, p in enumerate(planes(dim, bits, 100 + band)):
            key = key + F.when(dot(F.col(vector), F.array(*[F.lit(x) for x in p])) >= 0, F.lit(1 << i)).otherwise(0)
        keys.append(key + F.lit(band << 32))
    return df.withColumn("__key", F.explode(F.array(*keys)))


def sure_cosine(bands: int, bits: int, recall: float) -> float:
    """The least cosine at which two vectors share a band of sign bits with a probability of recall or more."""
    agree = (1 - (1 - recall) ** (1 / bands)) ** (1 / bits)
    return math.cos(math.pi * (1 - agree))


def _keyed(df: DataFrame, dim: int, bands: int, bits: int) -> DataFrame:
    """signatures() of the column vector, with the same sums, for many rows at once."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    every = np.array([x for band in range(bands) for x in planes(dim, bits, 100 + band)])
    columns, at = df.columns, df.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, n = _matrix(b.column(at))
            sums, fit = np.full((len(m), len(every)), -1.0), n == dim
            sums[fit] = 0
            for d in range(dim if fit.any() else 0):
                sums[fit] += m[fit, d, None] * every[None, :, d]
            keys = (~(sums < 0).reshape(len(m), bands, bits) << np.arange(bits)).sum(axis=2) + (np.arange(bands) << 32)
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * bands, pa.int32()), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, own], [*columns, "__keys"])

    made = df.mapInArrow(run, StructType([*df.schema.fields, StructField("__keys", ArrayType(LongType()))]))
    return made.select(*columns, F.explode("__keys").alias("__key"))


def _blocks(df: DataFrame, id_col: str, keys: list[str], blocks) -> DataFrame:
    """(keys, no, ids, vectors): the rows of equal keys in id order, dealt over so many blocks."""
    g = df.withColumn("no", F.pmod(F.xxhash64(id_col), blocks).cast("int")).groupBy(*keys, "no")
    g = g.agg(F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("id"), "vector"))).alias("rows"))
    return g.select(*keys, "no", F.col("rows.id").alias("ids"), F.col("rows.vector").alias("vectors"))


def _matrix(vectors) -> tuple:
    """An Arrow array of vectors as rows of doubles, short ones filled up with zeros, and their lengths."""
    import numpy as np
    import pyarrow.compute as pc

    n = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), n.max(initial=0)))
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out, n


def _best_pairs(qi: list, qv, pi: list, pv, k: int) -> tuple:
    """(query rows, point rows, scores) of the k best points of each query. A matrix product leaves those that are as near as
    the k-th or may be by rounding; these alone are summed in the order of cosine()."""
    import numpy as np

    (x, nq), (y, n_p) = _matrix(qv), _matrix(pv)
    dims = min(x.shape[1], y.shape[1])
    square = lambda m: np.sqrt(np.add.accumulate(m * m, axis=1)[:, -1]) if m.shape[1] else np.zeros(len(m))  # in order
    nx, ny = square(x), square(y)

    def cosines(dot, denom, sound):
        return np.where(sound, np.clip(dot / np.where(sound, denom, 1), 0, 1), 0)

    denom = nx[:, None] * ny[None, :]
    sound = (nq[:, None] == n_p[None, :]) & (nq[:, None] > 0) & (denom >= 1.1920929e-07)
    near = np.nan_to_num(cosines(x[:, :dims] @ y[:, :dims].T, denom, sound), nan=-1.0)
    at = {p: j for j, p in enumerate(pi)}
    for a, q in enumerate(qi):
        if q in at:  # itself
            near[a, at[q]] = -2
    least = np.partition(near, len(pi) - k, axis=1)[:, len(pi) - k] if len(pi) > k else np.full(len(qi), -1.0)
    i, j = np.nonzero(near >= np.maximum(least - 1e-9, -1.0)[:, None])
    dot = np.zeros(len(i))
    for d in range(dims):
        dot += x[i, d] * y[j, d]
    score = cosines(dot, denom[i, j], sound[i, j])
    order = np.lexsort((j, -score, i))  # points are in id order
    i, j, score = i[order], j[order], score[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], score[kept]


def _nearest(queries: DataFrame, points: DataFrame, keys: list[str], k: int, rows: int) -> DataFrame:
    """(query_id, point_id, score): for each block of points of equal keys its k best for each query, the query itself left out.

    Blocks of queries are sent to each block of points, so that the work spreads by blocks, not by keys.
    """
    import pyarrow as pa

    n = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("blocks"))
    q = _blocks(queries, "query_id", keys, F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / rows))
    p = _blocks(points.join(n, keys), "point_id", keys, F.col("blocks"))
    sent = q.select(*keys, F.col("ids").alias("qi"), F.col("vectors").alias("qv")).join(n, keys).withColumn("no", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = sent.join(p.select(*keys, "no", F.col("ids").alias("pi"), F.col("vectors").alias("pv")), [*keys, "no"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                qi, qv, pi, pv = (b.column(c)[r].values for c in range(4))
                i, j, score = _best_pairs(qi.to_pylist(), qv, pi.to_pylist(), pv, k)
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(i)).cast(pa.string()), pi.take(pa.array(j)).cast(pa.string()), pa.array(score)], ["query_id", "point_id", "score"])

    return pairs.select("qi", "qv", "pi", "pv").mapInArrow(run, "query_id string, point_id string, score double")


def nearest_exact(queries: DataFrame, points: DataFrame, k: int, rows: int = 1024) -> DataFrame:
    """The k points of each query's session with the largest cosine, as (query_id, point_id, score): blocks of queries meet
    blocks of points, so that no row is made for a pair that is not among the k best of its block. Scores equal cosine()."""
    q, p = queries.dropDuplicates(["session_id", "query_id"]), points.dropDuplicates(["session_id", "point_id"])
    return _nearest(q, p, ["session_id"], k, rows)


def nearest_lsh(queries: DataFrame, points: DataFrame, dim: int, k: int, bands: int = 12, bits: int = 6, recall: float = 0.99) -> DataFrame:
    """queries(query_id, session_id, vector), points(session_id, point_id, vector) -> (query_id, point_id, score, rank).

    Candidates share a session and one band of sign bits, and meet in blocks; scores are exact. A point that is missed is nearer than the
    k-th found, so a query whose k-th score is at least sure_cosine has its neighbours with a probability of recall each;
    the other queries are held against their whole session. Tests measure recall on the embeddings table.
    """
    q = queries.select("query_id", "session_id", "vector").dropDuplicates(["session_id", "query_id"])
    p = points.select("session_id", "point_id", "vector").dropDuplicates(["session_id", "point_id"])
    scored = _nearest(_keyed(q, dim, bands, bits), _keyed(p, dim, bands, bits), ["session_id", "__key"], k, 1024)
    scored = scored.dropDuplicates(["query_id", "point_id"])  # a pair may share many bands
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id"))
    last = F.max(F.when(F.col("rank") == k, F.col("score"))).over(Window.partitionBy("query_id"))
    found = scored.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("last", last).filter(F.col("last") >= sure_cosine(bands, bits, recall)).drop("last")
    sure = found.select("query_id").distinct()
    rest = nearest_exact(q.join(sure, "query_id", "left_anti"), p, k)
    rest = rest.dropDuplicates(["query_id", "point_id"]).withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.unionByName(rest)


@dataclass(frozen=True)
class AnnLsh:
    """Approximate cosine: only blocks of the session that share a band of sign bits with the request are scored.

    index is a table from build_index; it serves what was indexed until it is built again. Zero scores stay.
    """

    index: DataFrame
    dim: int
    bands: int = 12
    bits: int = 6
    limit: int | None = RETRIEVAL_LIMIT
    name: str = "ann-lsh"

    def __call__(self, requests: DataFrame, tables: Tables) -> DataFrame:
        asks = requests.select("request_id", "session_id", "task_vector").filter(F.col("task_vector").isNotNull())
        keyed = signatures(asks, "task_vector", self.dim, self.bands, self.bits)
        pairs = keyed.join(self.index, ["session_id", "__key"]).dropDuplicates(["request_id", "block_id"])
        rows = pairs.select("request_id", "block_id", f32(cosine(F.col("task_vector"), F.col("vector"))).alias("score"))
        return _best(rows, self.limit, F.desc("score"), F.col("block_id")).withColumn("source", F.lit(self.name))


def build_index(tables: Tables, cache: DataFrame, embedder: str, dim: int, bands: int = 12, bits: int = 6) -> DataFrame:
    """(session_id, block_id, vector, __key) of every cached block; write it partitioned by session for reuse."""
    vectors = latest(cache.filter(F.col("embedder") == embedder)).select("content_hash", "vector")
    rows = tables.session_blocks.join(tables.blocks.select("block_id", "content_hash"), "block_id").join(vectors, "content_hash").select("session_id", "block_id", "vector")
    return signatures(rows, "vector", dim, bands, bits)
