"""Exact top-k inner products by columnar branch-and-bound.

Vectors are packed into tiles in vertical layout (one row of numbers for each dimension), which are files in
the shared folder; only their names are shuffled. A tile of queries meets tiles of candidates; scores grow dimension block by dimension block, and after each
block a candidate stays only if its score so far plus the Cauchy-Schwarz bound of what remains can
still reach the query's k-th best score. Survivors are compacted before the next block.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, partitions, path_prefix, read_all, spill

#: Squared norms from which a score might not fit 64 bits.
LARGEST = 9.2e18


def _matrix(col: pa.Array, scale: float) -> np.ndarray:
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
    return np.floor(flat * scale).reshape(len(col), -1)


def _tails(vertical: np.ndarray, block: int) -> np.ndarray:
    """Norms of what remains after each block, for each column."""
    vertical = vertical.astype(np.float64, copy=False)
    sums = np.add.reduceat(vertical * vertical, np.arange(0, len(vertical), block), axis=0)
    return np.sqrt(np.vstack([sums[::-1].cumsum(0)[::-1][1:], np.zeros((1, vertical.shape[1]))]))


def search_tile(queries: np.ndarray, own: np.ndarray, vertical: np.ndarray, ids: np.ndarray, uids: np.ndarray, best: list, k: int, block: int, floors: np.ndarray) -> None:
    """Holds each query against a tile; best[i] is query i's list of (-score, id, uid), least first, k at most. Scores
    under floors need not be found."""
    tails, heads = _tails(vertical, block), _tails(np.ascontiguousarray(queries.T), block)
    starts = range(0, len(vertical), block)
    opening = queries[:, :block] @ vertical[:block]
    for i, q in enumerate(queries):
        if len(best[i]) < k:  # the first candidates seed the bound
            seed = min(len(ids), k + 1)
            s = q @ vertical[:, :seed]
            floor = np.sort(s[uids[:seed] != own[i]])[::-1]
            floor = floor[k - 1] if len(floor) >= k else -np.inf
        else:
            floor = -best[i][-1][0]
        floor = max(floor, floors[i])
        score, alive = opening[i], None
        for n, at in enumerate(starts):
            if n:
                part = vertical[at : at + block] if alive is None else vertical[at : at + block, alive]
                score = score + q[at : at + block] @ part
            tail = tails[n] if alive is None else tails[n][alive]
            limit = heads[n, i] * tail
            stay = score + limit * (1 + 1e-9) + (np.abs(score) + abs(floor) if np.isfinite(floor) else 0) * 1e-15 + 1e-6 >= floor
            if not stay.all():
                alive = np.flatnonzero(stay) if alive is None else alive[stay]
                score = score[stay]
            if not len(score):
                break
        alive = np.arange(len(ids)) if alive is None else alive
        found = [(-s, ids[j], uids[j]) for s, j in zip(score.tolist(), alive.tolist()) if uids[j] != own[i]] if len(alive) <= 4 * k else None
        if found is None:
            mine = uids[alive] != own[i]
            score, alive = score[mine], alive[mine]
            o = np.lexsort((uids[alive], ids[alive], -score))[:k]
            found = [(-s, ids[j], uids[j]) for s, j in zip(score[o].tolist(), alive[o].tolist())]
        if found:
            best[i] = sorted([*best[i], *found])[:k]


#: What a file of a tile is described by: its vectors' length, its place, how many they are, the largest squared norm among them.
TILE = "dim int, slot long, path string, rows long, most double"
#: Most tiles that one unit of work holds a tile of queries against.
GROUP = 64


def write_tile(folder: str, ids: np.ndarray, uids: np.ndarray, cells: np.ndarray) -> str:
    """A tile as a file: its shape, ids, uids and numbers, those as 32-bit integers if they fit."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = f"{root}/{uuid.uuid4().hex}.tile"
    narrow = bool(len(cells) and np.abs(cells).max() < 1 << 31)
    with store.open_output_stream(name, compression=None) as f:
        f.write(np.array([*cells.shape, narrow], np.int64).tobytes() + ids.tobytes() + uids.tobytes() + cells.astype(np.int32 if narrow else np.float64).tobytes())
    return path_prefix(folder) + name


def read_tile(path: str, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, uids, numbers) of a tile; numbers as 64-bit integers if exact, else as doubles."""
    raw = read_all(path)
    dim, n, narrow = np.frombuffer(raw, np.int64, 3).tolist()
    ids, uids = np.frombuffer(raw, np.int64, n, 24), np.frombuffer(raw, np.int64, n, 24 + 8 * n)
    cells = np.frombuffer(raw, np.int32 if narrow else np.float64, dim * n, 24 + 16 * n).reshape(dim, n)
    return ids, uids, cells.astype(np.int64 if exact else np.float64)


def exact_topk(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", tile: int = 4096, query_tile: int = 1024, block: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by every.

    Components become floor(scale * x); ties go to the smaller id. Rows whose id or vector is null, and
    vectors that are empty or hold null or non-finite components take no part; vectors of different length
    are never compared. Of rows with the same id each is a row of its own, and only the query's very row
    is not its candidate. Fewer than k candidates: all. An empty table gives an empty result.

    Scores are exact: where a largest squared norm, which bounds them, is 2**53 or more, they are summed as
    64-bit integers; where it is 2**63 or more, a score might not fit its type, and that is an error.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    points = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & sound)
    points = spill(points.withColumn("uid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "topk-points")
    is_query = F.col("id") % every == 0
    counts = points.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"), F.ceil(F.count_if(is_query) / query_tile).alias("qtiles")).filter("qtiles > 0")
    placed = points.join(counts, "dim").withColumn("h", F.xxhash64("uid"))
    folder = new_path(spark, "topk")

    def pack(t: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            m = np.ascontiguousarray(_matrix(t.column("v").combine_chunks(), scale).T)
            most = float((m * m).sum(0).max())
        path = write_tile(folder, np.asarray(t.column("id"), np.int64), np.asarray(t.column("uid"), np.int64), m) if most < LARGEST else ""
        return pa.table({"dim": t.column("dim")[:1], "slot": t.column("slot")[:1], "path": [path], "rows": pa.array([t.num_rows], pa.int64()), "most": [most]})

    tiles = spill(placed.select("dim", F.pmod("h", "tiles").alias("slot"), "id", "uid", "v").groupBy("dim", "slot").applyInArrow(pack, TILE), "topk-tiles")
    asks = spill(placed.filter(is_query).select("dim", F.pmod("h", "qtiles").alias("slot"), "id", "uid", "v").groupBy("dim", "slot").applyInArrow(pack, TILE), "topk-queries")
    dims = tiles.groupBy("dim").agg(F.max("most").alias("most"), F.count(F.lit(1)).alias("tiles")).join(asks.groupBy("dim").agg(F.count(F.lit(1)).alias("asks")), "dim")
    largest, pairs = dims.agg(F.coalesce(F.max("most"), F.lit(0.0)), F.coalesce(F.sum(F.col("tiles") * F.col("asks")), F.lit(0))).first()
    if largest >= LARGEST:
        raise OverflowError(f"a squared norm of {largest:.3g}: scores of such vectors might not fit 64 bits")
    group = max(1, min(GROUP, pairs // (4 * partitions(spark))))

    # each tile of queries against one tile first: its k-th scores are where the others' bounds begin
    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            floors = []
            for path, other, most in zip(*(b.column(n).to_pylist() for n in ("path", "other", "most"))):
                best = _search(path, [other], most >= 1 << 53, np.full(1, -np.inf), k, block)[2]
                floors.append(np.array([-x[k - 1][0] if len(x) >= k else -np.inf for x in best], np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("dim"), b.column("path"), pa.array(floors, pa.binary())], ["dim", "ask", "floors"])

    first = tiles.select("dim", F.col("slot").alias("other_slot"), F.col("path").alias("other"))
    seeded = asks.drop("most").join(dims.select("dim", "most", "tiles"), "dim").withColumn("other_slot", F.pmod("slot", "tiles")).join(first, ["dim", "other_slot"])
    seeded = spill(seeded.select("dim", "path", "other", "most").mapInArrow(seed, "dim int, ask string, floors binary"), "topk-seeds")
    groups = tiles.groupBy("dim", F.floor(F.col("slot") / group).alias("group")).agg(F.collect_list("path").alias("paths")).join(dims.select("dim", "most"), "dim")
    # a unit of work has the names of files, and a number for each query; how many there are follows the blocks of queries and candidates
    units = groups.join(seeded, "dim").select("ask", "floors", "paths", "most").repartition(int(max(1, min(-(-pairs // group), 100_000))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ask, floors, paths, most in zip(*(b.column(n).to_pylist() for n in ("ask", "floors", "paths", "most"))):
                qids, own, best = _search(ask, paths, most >= 1 << 53, np.frombuffer(floors, np.float64), k, block)
                rows = [(int(q), int(u), int(i), int(-s), int(c)) for q, u, found in zip(qids, own, best) for s, i, c in found]
                for at in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[at : at + 50_000])], ["query_id", "query_uid", "vec_id", "score", "uid"])

    found = units.mapInArrow(run, "query_id long, query_uid long, vec_id long, score long, uid long")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(ask: str, paths: list[str], exact: bool, floors: np.ndarray, k: int, block: int) -> tuple[np.ndarray, np.ndarray, list]:
    """(ids, uids, best) of a tile of queries held against tiles of candidates."""
    qids, own, cells = read_tile(ask, exact)
    q = np.ascontiguousarray(cells.T)
    best: list = [[] for _ in own]
    for path in paths:
        ids, uids, vertical = read_tile(path, exact)
        search_tile(q, own, vertical, ids, uids, best, k, block, np.broadcast_to(floors, len(own)))
    return qids, own, best
