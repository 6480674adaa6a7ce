"""Call traces, and differences between plans."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class UnknownCall(LookupError):
    pass


def record(traces: DataFrame, new: DataFrame) -> DataFrame:
    return traces.unionByName(new.select(*traces.columns))


def latest(traces: DataFrame) -> DataFrame:
    """The last version of each call."""
    rest = [c for c in traces.columns if c != "call_id"]
    last = traces.groupBy("call_id").agg(F.max_by(F.struct(*rest), "version").alias("t"))
    return last.select("call_id", *[F.col(f"t.{c}").alias(c) for c in rest]).select(*traces.columns)


def output_rows(traces: DataFrame, outputs: DataFrame) -> DataFrame:
    """The next version, with output and output_tokens, of each call of outputs(call_id, output, output_tokens).

    Unknown calls have none: see unknown_calls.
    """
    new = outputs.select("call_id", F.col("output").alias("__o"), F.col("output_tokens").cast("long").alias("__n"))
    mine = latest(traces.join(new.select("call_id"), "call_id", "left_semi"))
    fresh = mine.join(new, "call_id").withColumn("output", F.col("__o")).withColumn("output_tokens", F.col("__n")).withColumn("version", F.col("version") + 1)
    return fresh.select(*traces.columns)


def update_output(traces: DataFrame, outputs: DataFrame) -> DataFrame:
    """Appends output_rows."""
    return traces.unionByName(output_rows(traces, outputs))


def unknown_calls(traces: DataFrame, outputs: DataFrame) -> DataFrame:
    return outputs.join(traces.select("call_id"), "call_id", "left_anti")


def plan_reasons(plan: DataFrame, key: str) -> DataFrame:
    """(key, block_id, reason), one row for each block; of a block chosen twice the last reason counts."""
    return plan.groupBy(key, "block_id").agg(F.max_by(F.coalesce("reason", F.lit("HighRelevance")), "pos").alias("reason"))


def diff(prev: DataFrame, next: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, block_id, change, reason_prev, reason_next, reason_changed) of two plans' selected rows."""
    a = plan_reasons(prev, key).withColumnRenamed("reason", "reason_prev")
    b = plan_reasons(next, key).withColumnRenamed("reason", "reason_next")
    both = a.join(b, [key, "block_id"], "full_outer")
    change = F.when(F.col("reason_prev").isNull(), "added").when(F.col("reason_next").isNull(), "removed").otherwise("kept")
    return both.select(key, "block_id", change.alias("change"), "reason_prev", "reason_next", ((change == "kept") & (F.col("reason_prev") != F.col("reason_next"))).alias("reason_changed"))


def diff_summary(rows: DataFrame, tokens: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, added, removed, changed, token_delta, is_noop, summary); tokens(key, prev_tokens, next_tokens)."""
    n = rows.groupBy(key).agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"), F.count_if("reason_changed").alias("changed"))
    out = tokens.join(n, key, "left").fillna(0, ["added", "removed", "changed"]).withColumn("token_delta", F.col("next_tokens") - F.col("prev_tokens"))
    out = out.withColumn("is_noop", (F.col("added") + F.col("removed") + F.col("changed")) == 0)
    return out.select(key, "added", "removed", "changed", "token_delta", "is_noop", F.format_string("+%d -%d ~%d (%+d tokens)", "added", "removed", "changed", "token_delta").alias("summary"))


def consecutive(traces: DataFrame) -> DataFrame:
    """(session_id, call_id, prev_call_id, token_delta) of each call and the one before it in its session."""
    w = Window.partitionBy("session_id").orderBy("started_at_ms", "call_id")
    out = traces.select("session_id", "call_id", F.lag("call_id").over(w).alias("prev_call_id"), (F.col("estimated_tokens") - F.lag("estimated_tokens").over(w)).alias("token_delta"))
    return out.filter(F.col("prev_call_id").isNotNull())


def from_plans(requests: DataFrame, selected: DataFrame, summary: DataFrame, prompts: DataFrame, tokenizer: str, started_at_ms: int, duration_ms: int = 0) -> DataFrame:
    """Trace rows for planned and rendered requests(request_id, session_id, model), the request id being the call id.

    prompts(request_id, rendered, tokens); requests with an error have none. The array of a request's
    selections is bounded by its budget.
    """
    picked = selected.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("pos", "block_id", F.col("score").cast("double").alias("score"), "reason"))).alias("s"))
    rows = requests.select("request_id", "session_id", "model").join(summary.filter("error is null"), "request_id").join(prompts.select("request_id", "rendered", "tokens"), "request_id").join(picked, "request_id", "left")
    chosen = F.coalesce(F.transform("s", lambda x: F.struct(x["block_id"].alias("block_id"), x["score"].alias("score"), x["reason"].alias("reason"))), F.array().cast("array<struct<block_id:string,score:double,reason:string>>"))
    whole = lambda x: F.lit(x).cast("long")
    return rows.select(
        F.col("request_id").alias("call_id"), "session_id", "model", chosen.alias("selected"), "estimated_tokens", F.col("tokens").cast("long").alias("prompt_tokens"), F.sha2(F.col("rendered").cast("binary"), 256).alias("prompt_hash"),
        whole(started_at_ms).alias("started_at_ms"), whole(duration_ms).alias("duration_ms"), F.lit("").alias("model_version"), F.lit(tokenizer).alias("tokenizer_version"), F.lit(None).cast("string").alias("output"), whole(None).alias("output_tokens"), whole(1).alias("version"),
    )
