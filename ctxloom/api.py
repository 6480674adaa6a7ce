"""Single-request ergonomics over the batch engine."""
from __future__ import annotations

import random
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ids import content_hash, make_block_id, parse_id
from .functions.tokenizers import count_blocks
from .operators import reduce, traces
from .operators.packer import Packer, PackerError
from .operators.pager import Pager, PagerError
from .operators.retrievers import PythonRetriever, Recency
from .plans.config import Config
from .plans.models import EDGE_BY_NAME, KIND_BY_NAME
from .sources import tables as st
from .sources.schemas import TRACES
from .sources.store import ContextStore


class ContextError(RuntimeError):
    """Whatever goes wrong with a request."""


@dataclass(frozen=True)
class PageResult:
    selected: list[tuple[str, float, str]]
    omitted: list[tuple[str, float, str]]
    estimated_tokens: int


@dataclass(frozen=True)
class PackResult:
    plan: PageResult
    rendered: str | None
    messages: list[dict] | None
    tokens: int
    cache_boundary: int | None
    call_id: str | None


class Store:
    """A store on disk with one-call methods; every answer is collected, so use the batch operators for many requests."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, now_ms=lambda: int(time.time() * 1000), rand=lambda: random.getrandbits(62)):
        self.spark, self.disk, self.config, self._now, self._rand = spark, ContextStore(spark, path), config or Config(), now_ms, rand
        self._python: list[PythonRetriever] = []

    # -- blocks
    def put(self, session, kind: str, body: str | bytes, priority: float = 0.0, parents=(), labels=(), source: str | None = None) -> str:
        if kind not in KIND_BY_NAME:
            raise ContextError(f"unknown kind {kind!r}")
        raw = body.encode() if isinstance(body, str) else bytes(body)
        now = self._now()
        row = (parse_id(session), make_block_id(now, self._rand()), KIND_BY_NAME[kind], bytearray(raw), {}, float(priority), now, now, (source, list(parents), list(labels)), "", 0)
        schema = "session_id string, block_id string, kind string, body binary, token_counts map<string,bigint>, priority float, created_at_ms bigint, updated_at_ms bigint, provenance struct<source:string,parents:array<string>,labels:array<string>>, content_hash string, seq bigint"
        self.disk.put(self.spark.createDataFrame([row], schema))
        wanted = self.spark.createDataFrame([(bytearray(raw),)], "body binary").select(content_hash(F.col("body")).alias("content_hash"))
        return st.lookup_hash(self.disk.tables, wanted).first()["block_id"]

    def put_batch(self, blocks: DataFrame) -> None:
        """blocks has the columns of the blocks table, session_id and seq."""
        self.disk.put(blocks)

    def show(self, block_id) -> dict | None:
        row = st.get(self.disk.tables, parse_id(block_id)).first()
        return row.asDict(recursive=True) if row else None

    def list_sessions(self) -> list[str]:
        return [r[0] for r in st.list_sessions(self.disk.tables).collect()]

    def list_session(self, session) -> list[str]:
        return [r[0] for r in st.list_session(self.disk.tables, parse_id(session)).collect()]

    def delete(self, block_id) -> bool:
        ids = self.spark.createDataFrame([(parse_id(block_id),)], "block_id string")
        there = not st.existed(self.disk.tables, ids).isEmpty()
        self.disk.delete(ids)
        return there

    def purge_session(self, session) -> int:
        gone = self.spark.createDataFrame([(parse_id(session),)], "session_id string")
        n = st.purged(self.disk.tables, gone)[1].agg(F.sum("removed")).first()[0] or 0
        self.disk.purge(gone)
        return n

    def verify(self) -> dict:
        return st.verify(self.disk.tables).first().asDict()

    def repair(self) -> list[str]:
        fixed, quarantined = st.repair(self.disk.tables)
        ids = [r[0] for r in quarantined.collect()]
        self.disk.commit({"hash_index": fixed.hash_index, "session_blocks": fixed.session_blocks})
        return ids

    # -- edges
    def add_edge(self, source, target, kind: str) -> None:
        if kind not in EDGE_BY_NAME:
            raise ContextError(f"unknown edge kind {kind!r}")
        row = self.spark.createDataFrame([(parse_id(source), parse_id(target), EDGE_BY_NAME[kind])], "from_id string, to_id string, kind string")
        self.disk.put_edges(row)

    def edges_from(self, block_id) -> list[tuple[str, str]]:
        ids = self.spark.createDataFrame([(parse_id(block_id),)], "block_id string")
        return [(r.kind, r.to_id) for r in st.edges_from(self.disk.tables, ids).collect()]

    def edges_to(self, block_id) -> list[tuple[str, str]]:
        ids = self.spark.createDataFrame([(parse_id(block_id),)], "block_id string")
        return [(r.kind, r.from_id) for r in st.edges_to(self.disk.tables, ids).collect()]

    # -- requests
    def add_python_retriever(self, retriever) -> None:
        self._python.append(PythonRetriever(retriever))

    def clear_python_retrievers(self) -> None:
        self._python.clear()

    def _bind(self, session, model: str, task: str, required=(), timestamps: bool | None = None):
        profile = self.config.models.get(model)
        if profile is None:
            raise ContextError(f"unknown model {model!r}; known: {', '.join(self.config.models.names())}")
        tokenizer = self.config.tokenizers.require(profile.tokenizer)
        # retrievers of objects replace the default; configured ones stay beside them
        chosen = (*self.config.retrievers, *self._python) or (Recency(),)
        pager = Pager(tokenizer, chosen)
        if self.config.budgets is not None:
            pager = pager.with_budgets(self.config.budgets)
        asks = self.spark.createDataFrame([("0", parse_id(session), task, model, [parse_id(i) for i in required])], "request_id string, session_id string, task string, model string, required array<string>")
        return pager, Packer(tokenizer, self._now() if (self.config.include_timestamps if timestamps is None else timestamps) else None, self.config.stable_sections), asks, self.config.models.table(self.spark)

    def page(self, session, model: str, task: str = "", required=()) -> PageResult:
        pager, _, asks, profiles = self._bind(session, model, task, required)
        return self._result(pager.page(asks, self.disk.tables, profiles))

    @staticmethod
    def _result(plan) -> PageResult:
        s = plan.summary.first()
        if s is None or s.error:
            raise PagerError(s.error if s else "no plan")
        rows = lambda df: [(r.block_id, r.score, r.reason) for r in df.orderBy("pos").collect()]
        return PageResult(rows(plan.selected), rows(plan.omitted), s.estimated_tokens)

    def _selected(self, plan: PageResult) -> DataFrame:
        return self.spark.createDataFrame([("0", i, b) for i, (b, _, _) in enumerate(plan.selected)], "request_id string, pos int, block_id string")

    def pack(self, session, model: str, task: str = "", required=(), chat: bool = False, trace: bool = False, timestamps: bool | None = None) -> PackResult:
        """timestamps: whether to render them, unless the configuration is to say."""
        return self._pack(self.page(session, model, task, required), session, model, task, chat, trace, timestamps)

    def pack_with_plan(self, plan: PageResult, session, model: str, task: str = "", chat: bool = False, trace: bool = False, timestamps: bool | None = None) -> PackResult:
        """Renders an earlier plan's blocks for another model; reasons are not carried over."""
        bare = PageResult([(b, 0.0, None) for b, _, _ in plan.selected], [], plan.estimated_tokens)
        return self._pack(bare, session, model, task, chat, trace, timestamps)

    def _pack(self, plan, session, model, task, chat, trace, timestamps) -> PackResult:
        _, packer, asks, profiles = self._bind(session, model, task, (), timestamps)
        selected, t, started = self._selected(plan), self.disk.tables, self._now()
        rendered, messages, boundary = None, None, None
        if chat:
            rows, prompts = packer.pack_chat(asks, selected, t, profiles)
            head = prompts.first()
            messages, tokens, boundary = [r.asDict() for r in rows.orderBy("idx").select("role", "content", "section").collect()], head.input_tokens, head.cache_boundary
        else:
            head = packer.pack(asks, selected, t, profiles).first()
            rendered, tokens = head.rendered, head.tokens
        if head.error:
            raise PackerError(f"{head.error}: {tokens} tokens, budget {head.input_budget}")
        call = None
        if trace:
            call = make_block_id(started, self._rand())
            text = rendered if rendered is not None else "".join(m["content"] for m in messages)
            row = (call, parse_id(session), model, [(b, float(s), r) for b, s, r in plan.selected if r], plan.estimated_tokens, tokens, None, started, self._now() - started, "", packer.tokenizer.id, None, None, 1)
            new = self.spark.createDataFrame([row], TRACES).withColumn("prompt_hash", F.sha2(F.lit(text).cast("binary"), 256))
            self.disk.change({"traces": new})
        return PackResult(plan, rendered, messages, tokens, boundary, call)

    # -- traces, summaries
    def trace(self, call_id) -> dict | None:
        row = traces.latest(self.disk.table("traces").filter(F.col("call_id") == parse_id(call_id))).first()
        return row.asDict(recursive=True) if row else None

    def update_output(self, call_id, output: str, output_tokens: int) -> None:
        t = self.disk.table("traces")
        new = self.spark.createDataFrame([(parse_id(call_id), output, output_tokens)], "call_id string, output string, output_tokens long")
        if not traces.unknown_calls(t, new).isEmpty():
            raise traces.UnknownCall(f"no trace of call {call_id}")
        self.disk.change({"traces": traces.output_rows(t, new)})

    def diff(self, prev_call, next_call) -> tuple[list[dict], str]:
        t = traces.latest(self.disk.table("traces"))
        def plan(call):
            row = t.filter(F.col("call_id") == parse_id(call))
            return row.select(F.lit("0").alias("request_id"), F.posexplode("selected").alias("pos", "s")).select("request_id", "pos", "s.block_id", "s.reason"), row.first()
        (a, ra), (b, rb) = plan(prev_call), plan(next_call)
        if ra is None or rb is None:
            raise traces.UnknownCall("no trace of one of the calls")
        rows = traces.diff(a, b)
        tokens = self.spark.createDataFrame([("0", ra.estimated_tokens, rb.estimated_tokens)], "request_id string, prev_tokens long, next_tokens long")
        return [r.asDict() for r in rows.orderBy("change", "block_id").collect()], traces.diff_summary(rows, tokens).first()["summary"]

    def summarize(self, session, last: int | None = None, max_chars: int = 80, store: bool = False, summarizer: str = "truncating", ask=None) -> str:
        """summarizer: truncating, noop, or external, which gives the prompt to ask(prompt) -> text on an executor."""
        makers = {"truncating": lambda b: reduce.truncating(b, max_chars), "noop": reduce.noop, "external": lambda b: reduce.external(b, ask)}
        if summarizer not in makers or (summarizer == "external" and ask is None):
            raise ContextError(f"no summarizer {summarizer!r}; known: {', '.join(makers)} (external needs ask)")
        t = self.disk.tables
        b = t.session_blocks.filter(F.col("session_id") == parse_id(session)).join(t.blocks, "block_id")
        b = b if last is None else reduce.last_n(b, last)
        text = makers[summarizer](b)
        row = text.first()
        if row is None:
            return ""
        if store:
            text = self.spark.createDataFrame([row], text.schema)  # an external answer is asked for once
            made = reduce.summary_blocks(text, b, summarizer, self._now()).withColumn("seq", F.lit(0).cast("long"))
            self.disk.put(made)
        return row["summary"]

    def list_models(self) -> list[dict]:
        return [r.asDict() for r in self.config.models.table(self.spark).orderBy("name").collect()]

    def count_tokens(self, tokenizer: str) -> DataFrame:
        return count_blocks(self.disk.tables.blocks, self.config.tokenizers.require(tokenizer), live=True).select("block_id", "tokens")
