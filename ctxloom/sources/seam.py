"""What a store must offer to be paged from, and what it may leave out."""
from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession

from .schemas import TABLES
from .tables import Tables


class Unsupported(NotImplementedError):
    """An operation that this store does not have."""


class BlockStore(ABC):
    """A store needs blocks and memberships; without more it has no edges, lists no sessions and deletes nothing."""

    spark: SparkSession

    @abstractmethod
    def table(self, name: str) -> DataFrame:
        """The rows of blocks and session_blocks, at least."""

    @abstractmethod
    def put(self, incoming: DataFrame) -> BlockStore:
        """Adds rows with the columns of blocks, session_id and seq."""

    def none(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[name])

    def edges(self) -> DataFrame:
        return self.none("edges")

    def hash_index(self) -> DataFrame:
        """Of equal hashes the least id, unless the store keeps an index."""
        return self.table("blocks").groupBy("content_hash").agg({"block_id": "min"}).toDF("content_hash", "block_id")

    @property
    def tables(self) -> Tables:
        return Tables(self.table("blocks"), self.table("session_blocks"), self.edges(), self.hash_index())

    def list_sessions(self) -> DataFrame:
        return self.none("session_blocks").select("session_id")

    def delete(self, ids: DataFrame) -> BlockStore:
        raise Unsupported("this store does not delete")

    def purge(self, sessions: DataFrame) -> BlockStore:
        raise Unsupported("this store does not purge sessions")

    def put_edges(self, edges: DataFrame) -> BlockStore:
        raise Unsupported("this store keeps no edges")
