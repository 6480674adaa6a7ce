"""Store operations as functions from tables to tables: no row is touched by the driver."""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import content_hash
from ..plans.models import edge_code


@dataclass(frozen=True)
class Tables:
    blocks: DataFrame
    session_blocks: DataFrame
    edges: DataFrame
    hash_index: DataFrame


def among(big: DataFrame, small: DataFrame, *columns: str) -> DataFrame:
    """The rows of big whose columns are in small: what is left to join is as small as small."""
    return big.join(small.select(*columns).distinct(), list(columns), "left_semi")


def put_rows(tables: Tables, incoming: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """What put adds to each table, and the ids (block_id) of stored blocks that new ones replace.

    Of equal bodies the first stays, with its kind, priority and provenance; later ones only join their
    session to it. Aggregates carry ids, not bodies, so a body that a third of all rows share is combined
    before the shuffle; stored tables are only reduced to what incoming names.
    """
    rows = incoming.withColumn("content_hash", content_hash(F.col("body")))
    known = among(tables.hash_index, rows, "content_hash").select("content_hash", F.col("block_id").alias("old_id"))
    first = rows.groupBy("content_hash").agg(F.min(F.struct("seq", "block_id")).alias("f"))
    owner = first.join(known, "content_hash", "left").select("content_hash", F.col("f.seq").alias("first_seq"), "old_id", F.coalesce("old_id", "f.block_id").alias("owner"))
    fresh = owner.filter("old_id is null")
    new = rows.join(fresh.select("content_hash", F.col("first_seq").alias("seq")), ["content_hash", "seq"], "left_semi").dropDuplicates(["content_hash"])
    links = rows.select("session_id", "content_hash").distinct().join(owner, "content_hash").select("session_id", F.col("owner").alias("block_id")).distinct()
    links = links.join(among(tables.session_blocks, links, "session_id", "block_id"), ["session_id", "block_id"], "left_anti")
    add = {"blocks": new.select(*tables.blocks.columns), "session_blocks": links, "hash_index": fresh.select("content_hash", F.col("owner").alias("block_id"))}
    return add, among(tables.blocks.select("block_id"), new, "block_id")


def put(tables: Tables, incoming: DataFrame) -> Tables:
    """Adds blocks: incoming has the columns of blocks, session_id and seq (the order of arrival). See put_rows."""
    add, replaced = put_rows(tables, incoming)
    return replace(
        tables,
        blocks=tables.blocks.join(replaced, "block_id", "left_anti").select(*tables.blocks.columns).unionByName(add["blocks"]),
        session_blocks=tables.session_blocks.unionByName(add["session_blocks"]),
        hash_index=tables.hash_index.unionByName(add["hash_index"]),
    )


def get(tables: Tables, block_id: str) -> DataFrame:
    return tables.blocks.filter(F.col("block_id") == block_id)


def list_session(tables: Tables, session_id: str) -> DataFrame:
    return tables.session_blocks.filter(F.col("session_id") == session_id).select("block_id").orderBy("block_id")


def list_sessions(tables: Tables) -> DataFrame:
    return tables.session_blocks.select("session_id").distinct().orderBy("session_id")


def lookup_hash(tables: Tables, hashes: DataFrame) -> DataFrame:
    """(content_hash, block_id) of those that are stored."""
    return tables.hash_index.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")


def edge_rows(tables: Tables, edges: DataFrame) -> DataFrame:
    """Those of edges that are not stored, once each."""
    new = edges.select("from_id", "to_id", "kind").distinct()
    return new.join(among(tables.edges, new, *new.columns), new.columns, "left_anti")


def put_edges(tables: Tables, edges: DataFrame) -> Tables:
    return replace(tables, edges=tables.edges.unionByName(edge_rows(tables, edges)))


def edges_from(tables: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Outgoing edges with their order by kind code, then target."""
    e = tables.edges if ids is None else tables.edges.join(ids.select(F.col("block_id").alias("from_id")), "from_id", "left_semi")
    return e.withColumn("code", edge_code(F.col("kind"))).orderBy("from_id", "code", "to_id")


def edges_to(tables: Tables, ids: DataFrame | None = None) -> DataFrame:
    e = tables.edges if ids is None else tables.edges.join(ids.select(F.col("block_id").alias("to_id")), "to_id", "left_semi")
    return e.withColumn("code", edge_code(F.col("kind"))).orderBy("to_id", "code", "from_id")


def delete(tables: Tables, ids: DataFrame) -> Tables:
    """Removes blocks (block_id) from every table, edges in both directions."""
    gone = ids.select("block_id").distinct()
    drop = lambda df, key: df.join(gone.withColumnRenamed("block_id", key), key, "left_anti").select(*df.columns)
    return Tables(drop(tables.blocks, "block_id"), drop(tables.session_blocks, "block_id"), drop(drop(tables.edges, "from_id"), "to_id"), drop(tables.hash_index, "block_id"))


def existed(tables: Tables, ids: DataFrame) -> DataFrame:
    """(block_id) of ids that a block or a membership names, as delete reports them."""
    there = tables.blocks.select("block_id").unionByName(tables.session_blocks.select("block_id"))
    return ids.select("block_id").distinct().join(there, "block_id", "left_semi")


def purged(tables: Tables, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of sessions that are dropped: the blocks (block_id) that no other session keeps, and (session_id, removed)."""
    gone = sessions.select("session_id").distinct()
    removed = tables.session_blocks.join(gone, "session_id", "left_semi")
    ids = removed.select("block_id").distinct()
    kept = among(tables.session_blocks, ids, "block_id").join(gone, "session_id", "left_anti")
    return ids.join(kept, "block_id", "left_anti"), removed.groupBy("session_id").agg(F.count(F.lit(1)).alias("removed"))


def purge_sessions(tables: Tables, sessions: DataFrame) -> tuple[Tables, DataFrame]:
    """Drops the sessions' memberships and the blocks that no session keeps; also (session_id, removed)."""
    orphans, removed = purged(tables, sessions)
    kept = tables.session_blocks.join(sessions.select("session_id").distinct(), "session_id", "left_anti").select("session_id", "block_id")
    return delete(replace(tables, session_blocks=kept), orphans), removed


def verify_rows(tables: Tables) -> DataFrame:
    """(problem, block_id): hash-mismatch, missing-index, wrong-index, orphan-membership, no-session."""
    b = tables.blocks.select("block_id", "content_hash", (content_hash(F.col("body")) != F.col("content_hash")).alias("bad"))
    index = tables.hash_index.select("content_hash", F.col("block_id").alias("named"))
    indexed = b.join(index, "content_hash", "left")
    tag = lambda df, name: df.select(F.lit(name).alias("problem"), "block_id")
    ids, member = tables.blocks.select("block_id"), tables.session_blocks.select("block_id")
    return (
        tag(b.filter("bad"), "hash-mismatch")
        .unionByName(tag(indexed.filter("named is null"), "missing-index"))
        .unionByName(tag(indexed.filter("named <> block_id"), "wrong-index"))
        .unionByName(tag(member.join(ids, "block_id", "left_anti"), "orphan-membership"))
        .unionByName(tag(ids.join(member, "block_id", "left_anti"), "no-session"))
    )


def verify(tables: Tables) -> DataFrame:
    """One row: blocks_checked, a count of each problem, is_clean (blocks without a session do no harm)."""
    names = ("hash-mismatch", "missing-index", "wrong-index", "orphan-membership", "no-session")
    p = verify_rows(tables).agg(*[F.count_if(F.col("problem") == n).alias(n.replace("-", "_")) for n in names])
    out = tables.blocks.agg(F.count(F.lit(1)).alias("blocks_checked")).crossJoin(F.broadcast(p))  # one row each
    return out.withColumn("is_clean", (F.col("hash_mismatch") + F.col("missing_index") + F.col("wrong_index") + F.col("orphan_membership")) == 0)


def repair(tables: Tables) -> tuple[Tables, DataFrame]:
    """Rebuilds the hash index from stored hashes (of equal ones the larger id), drops orphan memberships;
    also the blocks whose body does not match their hash, which stay untouched."""
    index = tables.blocks.groupBy("content_hash").agg(F.max("block_id").alias("block_id"))
    member = tables.session_blocks.join(tables.blocks.select("block_id"), "block_id", "left_semi").select("session_id", "block_id")
    quarantined = tables.blocks.filter(content_hash(F.col("body")) != F.col("content_hash")).select("block_id")
    return replace(tables, hash_index=index, session_blocks=member), quarantined
