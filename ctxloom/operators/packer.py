"""Rendering of plans: one string, or chat messages with a cacheable prefix."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import iso8601, strict_text, trim_end
from ..functions.tokenizers import Tokenizer, word_level
from ..plans.models import case, section_of, section_order
from ..sources.tables import Tables

SYSTEM_SIDE = ("System", "State", "Plan", "Retrieved", "Background")
#: Stable sections may only be among these, by their configured names.
STABLE_NAMES = {s.lower(): s for s in SYSTEM_SIDE}


class PackerError(RuntimeError):
    pass


@dataclass(frozen=True)
class Packer:
    tokenizer: Tokenizer = field(default_factory=word_level)
    now_ms: int | None = None  # timestamps are rendered when set
    stable: tuple[str, ...] = ("System", "Background")

    def _blocks(self, selected: DataFrame, tables: Tables) -> DataFrame:
        """Selected blocks with section and text; a block chosen twice is rendered twice, a missing one has no text."""
        b = tables.blocks.select("block_id", "kind", "created_at_ms", strict_text(F.col("body")).alias("text"))
        rows = selected.select("request_id", "pos", "block_id").join(b, "block_id", "left")
        return rows.withColumn("section", section_of(F.col("kind")))

    def _stamped(self) -> Column:
        if self.now_ms is None:
            return F.col("text")
        return F.concat(F.lit("["), iso8601(F.col("created_at_ms")), F.lit("] "), F.col("text"))

    def _tasks(self, requests: DataFrame) -> DataFrame:
        now = F.lit("") if self.now_ms is None else F.concat(F.lit("Current time: "), iso8601(F.lit(self.now_ms)), F.lit("\n\n"))
        return requests.filter(F.coalesce("task", F.lit("")) != "").select("request_id", F.concat(now, "task").alias("text"))

    def manifest(self, selected: DataFrame, tables: Tables) -> DataFrame:
        """(request_id, block_id, section, tokens, score): tokens counted anew, score always 0."""
        rows = self._blocks(selected, tables)
        return rows.select("request_id", "pos", "block_id", "section", self.tokenizer.count(F.col("text")).alias("tokens"), F.lit(0.0).cast("float").alias("score"))

    def pack(self, requests: DataFrame, selected: DataFrame, tables: Tables, profiles: DataFrame) -> DataFrame:
        """requests(request_id, task, model) -> request_id, model, rendered, tokens, input_budget, error.

        An array holds one request's blocks, which the input budget bounds. error: MissingBlock or BudgetExceeded.
        """
        rows = self._blocks(selected, tables)
        missing = rows.filter("text is null").select("request_id").distinct().withColumn("__missing", F.lit(True))
        parts = rows.filter("text is not null").select("request_id", "section", "block_id", "pos", F.concat(self._stamped(), F.lit("\n\n")).alias("piece"))
        tasks = self._tasks(requests).select("request_id", F.lit("Task").alias("section"), F.lit("").alias("block_id"), F.lit(0).alias("pos"), F.concat("text", F.lit("\n\n")).alias("piece"))
        sections = parts.unionByName(tasks).groupBy("request_id", "section").agg(F.sort_array(F.collect_list(F.struct("block_id", "pos", "piece"))).alias("p"))
        sections = sections.select("request_id", section_order(F.col("section")).alias("ord"), F.concat(F.lit("## "), "section", F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["piece"]), "")).alias("text"))
        whole = sections.groupBy("request_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("rendered"))
        out = requests.select("request_id", "model").join(whole, "request_id", "left").join(missing, "request_id", "left")
        out = out.join(F.broadcast(profiles.select(F.col("name").alias("model"), "input_budget")), "model").withColumn("rendered", F.coalesce("rendered", F.lit("")))
        out = out.withColumn("tokens", self.tokenizer.count(F.col("rendered")))
        error = F.when(F.col("__missing"), F.lit("MissingBlock")).when(F.col("tokens") > F.col("input_budget"), F.lit("BudgetExceeded"))
        return out.select("request_id", "model", "rendered", "tokens", "input_budget", error.alias("error"))

    def messages(self, requests: DataFrame, selected: DataFrame, tables: Tables, profiles: DataFrame) -> DataFrame:
        """(request_id, idx, role, content, section) in order: stable sections, other system-side ones, conversation, tools, task."""
        rows = self._blocks(selected, tables).filter("text is not null")
        asks = requests.select("request_id", "model").join(F.broadcast(profiles.select(F.col("name").alias("model"), "supports_system_role")), "model")
        order = {s: i for i, s in enumerate([*[s for s in SYSTEM_SIDE if s in self.stable], *[s for s in SYSTEM_SIDE if s not in self.stable]])}
        side = rows.filter(F.col("section").isin(*SYSTEM_SIDE)).select("request_id", "section", "block_id", "pos", F.concat(self._stamped(), F.lit("\n\n")).alias("piece"))
        side = side.groupBy("request_id", "section").agg(F.sort_array(F.collect_list(F.struct("block_id", "pos", "piece"))).alias("p"))
        content = trim_end(F.concat(F.lit("## "), "section", F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["piece"]), "")))
        side = side.select("request_id", case(F.col("section"), order).alias("a"), F.lit("").alias("b"), F.lit(0).alias("c"), F.lit("system").alias("role"), content.alias("content"), "section")
        talk = rows.filter(F.col("section").isin("Recent", "Tools"))
        role = F.when(F.col("section") == "Tools", "tool").when(F.col("kind") == "AssistantMessage", "assistant").otherwise("user")
        text = F.when(F.col("kind") == "AssistantMessage", F.col("text")).otherwise(self._stamped())
        talk = talk.select("request_id", F.when(F.col("section") == "Recent", 10).otherwise(11).alias("a"), F.col("block_id").alias("b"), F.col("pos").alias("c"), role.alias("role"), text.alias("content"), "section")
        task = self._tasks(requests).select("request_id", F.lit(12).alias("a"), F.lit("").alias("b"), F.lit(0).alias("c"), F.lit("user").alias("role"), F.col("text").alias("content"), F.lit("Task").alias("section"))
        every = side.unionByName(talk).unionByName(task).join(asks.select("request_id", "supports_system_role"), "request_id")
        idx = F.row_number().over(Window.partitionBy("request_id").orderBy("a", "b", "c")) - 1
        role = F.when((F.col("role") == "system") & ~F.col("supports_system_role"), F.lit("user")).otherwise(F.col("role"))
        return every.withColumn("idx", idx).select("request_id", "idx", role.alias("role"), "content", "section")

    def pack_chat(self, requests: DataFrame, selected: DataFrame, tables: Tables, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(messages, prompts(request_id, model, input_tokens, cache_boundary, input_budget, error))."""
        messages = self.messages(requests, selected, tables, profiles)
        stable = F.count_if(F.col("section").isin(*self.stable) & F.col("section").isin(*SYSTEM_SIDE))
        sums = messages.groupBy("request_id").agg(F.sum(self.tokenizer.count(F.col("content"))).alias("n"), stable.alias("stable"))
        prompts = requests.select("request_id", "model").join(F.broadcast(profiles.select(F.col("name").alias("model"), "input_budget")), "model").join(sums, "request_id", "left")
        n = F.coalesce("n", F.lit(0)).cast("long")
        return messages, prompts.select("request_id", "model", n.alias("input_tokens"), F.when(F.col("stable") > 0, F.col("stable") - 1).cast("long").alias("cache_boundary"), "input_budget", F.when(n > F.col("input_budget"), F.lit("BudgetExceeded")).alias("error"))

    def pack_for_models(self, requests: DataFrame, selected: DataFrame, tables: Tables, profiles: DataFrame, models: DataFrame) -> DataFrame:
        """One plan rendered for every model of models (a few rows): over budget is an error of that row."""
        once = self.pack(requests, selected, tables, profiles).select("request_id", "rendered", "tokens", F.col("error").alias("first"))
        each = once.crossJoin(F.broadcast(models.select(F.col("name").alias("model")).join(profiles.select(F.col("name").alias("model"), "input_budget"), "model")))
        error = F.when(F.col("first") == "MissingBlock", F.col("first")).when(F.col("tokens") > F.col("input_budget"), F.lit("BudgetExceeded"))
        return each.select("request_id", "model", "rendered", "tokens", "input_budget", error.alias("error"))


def stable_sections(names: list[str]) -> tuple[str, ...]:
    bad = [n for n in names if n.lower() not in STABLE_NAMES]
    if bad:
        raise ValueError(f"not a section that can be stable: {', '.join(bad)}; known: {', '.join(STABLE_NAMES)}")
    return tuple(STABLE_NAMES[n.lower()] for n in names)
