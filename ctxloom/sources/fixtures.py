"""The driver's tables as entities of the engine."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import block_id, content_hash, hex_of
from ..plans.models import case
from .tables import Tables

EPOCH = 1704067200000
ROLE_KIND = {"system": "System", "user": "UserMessage", "assistant": "AssistantMessage"}
DOC_KINDS = ("Fact", "DocumentChunk", "Plan", "State", "ToolResult")
EDGE_KINDS = ("Parent", "DerivedFrom", "Supports", "Contradicts", "ToolInvocation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _entity(df: DataFrame, session, ts, block, kind, text, priority, seq, parents=None) -> DataFrame:
    body = text.cast("binary")
    none = F.array().cast("array<string>")
    return df.select(
        session.alias("session_id"), block.alias("block_id"), kind.alias("kind"), body.alias("body"), F.create_map().cast("map<string,bigint>").alias("token_counts"), priority.cast("float").alias("priority"),
        ts.alias("created_at_ms"), ts.alias("updated_at_ms"), F.struct(F.lit(None).cast("string").alias("source"), (none if parents is None else parents).alias("parents"), none.alias("labels")).alias("provenance"), content_hash(body).alias("content_hash"), seq.alias("seq"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each conversation, a block for each turn."""
    c = table(spark, sf_dir, "conversations")
    ts = F.lit(EPOCH) + F.col("conv_id") * 3600000 + F.col("turn") * 60000
    seq = F.col("conv_id") * 1000 + F.col("turn")
    return _entity(c, hex_of(F.col("conv_id"), 32), ts, block_id(ts, seq), case(F.col("role"), ROLE_KIND), F.col("text"), (F.col("turn") % 5) / F.lit(4.0), seq)


def documents(spark: SparkSession, sf_dir: str, session: str = "source", parents: bool = False) -> DataFrame:
    """A session for each source (or other column), kinds in turn."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", session)
    ts = F.lit(EPOCH) + F.col("doc_id") * 1000
    half = F.floor(F.col("doc_id") / 2).cast("long")
    up = F.when(F.lit(parents) & (F.col("doc_id") % 7 == 0) & (F.col("doc_id") > 0), F.array(doc_block(half))).otherwise(F.array().cast("array<string>"))
    return _entity(d, F.md5(F.col(session)), ts, block_id(ts, F.col("doc_id")), _pick(DOC_KINDS, F.col("doc_id") % 5), F.col("text"), F.lit(0.0), F.col("doc_id"), up)


def doc_block(doc_id) -> F.Column:
    return block_id(F.lit(EPOCH) + doc_id * 1000, doc_id)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block i to block i div 2, kinds in turn."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.select(doc_block(F.col("doc_id")).alias("from_id"), doc_block(F.floor(F.col("doc_id") / 2).cast("long")).alias("to_id"), _pick(EDGE_KINDS, F.col("doc_id") % 5).alias("kind"))


def plain_tables(blocks: DataFrame, edges: DataFrame | None = None) -> Tables:
    """Tables of blocks taken as they are, without deduplication."""
    spark = blocks.sparkSession
    e = edges if edges is not None else spark.createDataFrame([], "from_id string, to_id string, kind string")
    return Tables(blocks.drop("session_id", "seq"), blocks.select("session_id", "block_id"), e, blocks.select("content_hash", "block_id"))


def empty_tables(spark: SparkSession) -> Tables:
    from .schemas import BLOCKS, EDGES, HASH_INDEX, SESSION_BLOCKS

    return Tables(*(spark.createDataFrame([], s) for s in (BLOCKS, SESSION_BLOCKS, EDGES, HASH_INDEX)))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, block_id, content_hash, vector): a session for each label."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(hex_of(F.col("label"), 32).alias("session_id"), hex_of(F.col("vec_id"), 32).alias("block_id"), F.sha2(F.col("vec_id").cast("string").cast("binary"), 256).alias("content_hash"), F.col("embedding").alias("vector"), "vec_id")
