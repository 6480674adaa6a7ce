"""Plans, prompts and blocks as JSON rows, one for each request or block."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import body_text


def plan_json(selected: DataFrame, omitted: DataFrame, summary: DataFrame) -> DataFrame:
    """(request_id, json) with selected and omitted in order, estimated_tokens and error. A plan's arrays are bounded by the retrieval limit."""
    item = F.struct("pos", "block_id", "score", "reason")
    bare = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<pos:int,block_id:string,score:float,reason:string>>")), lambda x: F.struct(x["block_id"].alias("block_id"), x["score"].alias("score"), x["reason"].alias("reason")))
    a = selected.groupBy("request_id").agg(F.sort_array(F.collect_list(item)).alias("a"))
    b = omitted.groupBy("request_id").agg(F.sort_array(F.collect_list(item)).alias("b"))
    rows = summary.join(a, "request_id", "left").join(b, "request_id", "left")
    return rows.select("request_id", F.to_json(F.struct("request_id", bare(F.col("a")).alias("selected"), bare(F.col("b")).alias("omitted"), "estimated_tokens", "error")).alias("json"))


def chat_json(messages: DataFrame, prompts: DataFrame) -> DataFrame:
    """(request_id, json) with messages in order, input_tokens, cache_boundary and error."""
    m = messages.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("idx", "role", "content", "section"))).alias("m"))
    rows = prompts.join(m, "request_id", "left")
    each = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["section"].alias("section")))
    return rows.select("request_id", F.to_json(F.struct("request_id", "model", each.alias("messages"), "input_tokens", "cache_boundary", "error")).alias("json"))


def block_json(blocks: DataFrame, head: int = 256) -> DataFrame:
    """(block_id, json); a body that is not UTF-8 is given as the hex of its first bytes."""
    body = F.coalesce(body_text(F.col("body")), F.lower(F.hex(F.substring("body", 1, head))))
    return blocks.select("block_id", F.to_json(F.struct("block_id", "kind", body.alias("body"), "priority", "created_at_ms", "updated_at_ms", "provenance", "content_hash")).alias("json"))
