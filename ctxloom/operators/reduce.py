"""Reducers from model outputs to blocks and edges, and summarizers."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import content_hash, hex_of
from ..functions.text import strict_text
from ..plans.models import case

# Event names and their kinds; what is mixed into the first byte of an id's low half.
EVENT_KIND = {"fact": "Fact", "plan": "Plan", "summary": "Summary", "documentchunk": "DocumentChunk"}
KIND_MASK = {"State": 0xFE, "Fact": 1, "Plan": 2, "Summary": 3, "DocumentChunk": 4}
# Labels of the truncating summarizer.
LABELS = {"System": "system", "UserMessage": "user", "AssistantMessage": "assistant", "ToolResult": "tool", "Summary": "summary", "Fact": "fact", "DocumentChunk": "document", "Plan": "plan", "State": "state", "Trace": "trace"}


def _block(kind: Column, text: Column, low: Column, parents: Column) -> list[Column]:
    body = text.cast("binary")
    return [
        F.concat(hex_of(F.col("now_ms"), 12), F.lit("0000"), low).alias("block_id"), kind.alias("kind"), body.alias("body"), F.create_map().cast("map<string,bigint>").alias("token_counts"), F.lit(0.0).cast("float").alias("priority"),
        F.col("now_ms").cast("long").alias("created_at_ms"), F.col("now_ms").cast("long").alias("updated_at_ms"),
        F.struct(F.lit("model-output").alias("source"), parents.alias("parents"), F.array().cast("array<string>").alias("labels")).alias("provenance"), content_hash(body).alias("content_hash"),
    ]


def identity(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    blocks, edges = append_output(outputs)
    return blocks.limit(0), edges.limit(0)


def append_output(outputs: DataFrame, link_to_state: bool = True) -> tuple[DataFrame, DataFrame]:
    """outputs(call_id, output, now_ms, state_id or null) -> blocks (with call_id) and edges; empty outputs make nothing."""
    rows = outputs.filter(F.coalesce("output", F.lit("")) != "")
    linked = F.col("state_id").isNotNull() & F.lit(link_to_state)
    parents = F.when(linked, F.array("state_id")).otherwise(F.array().cast("array<string>"))
    low = F.substring(content_hash(F.col("output").cast("binary")), 1, 16)
    blocks = rows.select("call_id", "state_id", *_block(F.lit("AssistantMessage"), F.col("output"), low, parents))
    edges = blocks.filter(linked).select(F.col("block_id").alias("from_id"), F.col("state_id").alias("to_id"), F.lit("Parent").alias("kind"))
    return blocks.drop("state_id"), edges


def json_events(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """outputs(call_id, output, now_ms, state_id) -> (blocks with call_id, is_state, ord; errors(call_id, error)).

    An output that is not an envelope, or has an event of an unknown kind or without a body, is an error as a whole.
    """
    text = F.regexp_replace(F.regexp_replace("output", r"(?U)^\s+", ""), r"(?U)\s+$", "")
    # an unparsable or ill-typed envelope parses to null or sets the corrupt column
    env = F.from_json(text, "state string, events array<struct<kind:string,body:string>>, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = outputs.withColumn("e", env)
    known = F.coalesce(F.forall("e.events", lambda x: x.isNotNull() & x["kind"].isin(*EVENT_KIND) & x["body"].isNotNull()), F.lit(True))
    fine = F.coalesce(F.col("e._bad").isNull() & F.startswith(text, F.lit("{")) & known, F.lit(False))
    errors = rows.filter(~fine).select("call_id", F.lit("InvalidOutput").alias("error"))
    parents = F.when(F.col("state_id").isNotNull(), F.array("state_id")).otherwise(F.array().cast("array<string>"))
    state = F.array(F.struct(F.lit("State").alias("kind"), F.col("e.state").alias("body")))
    events = F.coalesce(F.transform("e.events", lambda x: F.struct(case(x["kind"], EVENT_KIND).alias("kind"), x["body"].alias("body"))), F.array().cast("array<struct<kind:string,body:string>>"))
    each = rows.filter(fine).select("call_id", "now_ms", "state_id", parents.alias("parents"), F.posexplode(F.concat(state, events)).alias("ord", "x")).filter(F.coalesce("x.body", F.lit("")) != "")
    digest = content_hash(F.col("x.body").cast("binary"))
    first = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int").bitwiseXOR(case(F.col("x.kind"), KIND_MASK).cast("int"))
    low = F.concat(hex_of(first, 2), F.substring(digest, 3, 14))
    return each.select("call_id", (F.col("ord") == 0).alias("is_state"), "ord", *_block(F.col("x.kind"), F.col("x.body"), low, F.col("parents"))), errors


# -- summarizers: blocks(group, block_id, kind, body) -> (group, summary)
def last_n(blocks: DataFrame, n: int, key: str = "session_id") -> DataFrame:
    """The n most recent blocks of each group."""
    w = Window.partitionBy(key).orderBy(F.desc("block_id"))
    return blocks.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def noop(blocks: DataFrame, key: str = "session_id") -> DataFrame:
    return blocks.groupBy(key).agg(F.format_string("[summary of %d block(s) elided]", F.count(F.lit(1))).alias("summary"))


def truncating(blocks: DataFrame, max_chars: int = 80, key: str = "session_id") -> DataFrame:
    """A bullet for each block in id order, white space collapsed, cut by code points."""
    text = F.array_join(F.filter(F.split(strict_text(F.col("body")), r"(?U)\s+"), lambda w: w != ""), " ")
    cut = F.when(F.char_length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("…"))).otherwise(text)
    line = F.concat(F.lit("- "), case(F.col("kind"), LABELS), F.lit(": "), cut, F.lit("\n"))
    rows = blocks.select(key, "block_id", line.alias("line"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_id", "line"))), lambda x: x["line"]), "").alias("summary"))


def external_prompt(blocks: DataFrame, key: str = "session_id") -> DataFrame:
    """What an external summarizer is asked: numbered blocks with their kinds."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("block_id"))
    rows = blocks.select(key, n.alias("n"), F.concat(F.lit("--- block "), n.cast("string"), F.lit(" ("), "kind", F.lit(") ---\n"), strict_text(F.col("body")), F.lit("\n\n")).alias("part"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "").alias("prompt"))


def external(blocks: DataFrame, ask: Callable[[str], str], key: str = "session_id") -> DataFrame:
    """A summary by a callable that is given the prompt on an executor; an answer without text is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [ask(p) if p else "" for p in pdf["prompt"]]
            if any(p and not g for p, g in zip(pdf["prompt"], got)):
                raise RuntimeError("the summarizer returned no text")
            yield pd.DataFrame({key: pdf[key], "summary": got})

    return external_prompt(blocks, key).mapInPandas(run, f"{key} string, summary string")


def summary_blocks(summaries: DataFrame, sources: DataFrame, name: str, now_ms: int, key: str = "session_id") -> DataFrame:
    """Summary blocks whose parents are the summarized ids."""
    ids = sources.groupBy(key).agg(F.sort_array(F.collect_list("block_id")).alias("parents"))
    rows = summaries.join(ids, key).withColumn("now_ms", F.lit(now_ms).cast("long"))
    low = F.substring(content_hash(F.col("summary").cast("binary")), 1, 16)
    out = rows.select(key, *_block(F.lit("Summary"), F.col("summary"), low, F.col("parents")))
    return out.withColumn("provenance", F.col("provenance").withField("source", F.lit(f"summarize:{name}")))
