import pytest
from helpers import asks, profiles, tables

from ctxloom.functions.ids import make_block_id
from ctxloom.operators.packer import Packer, stable_sections
from ctxloom.operators.traces import diff, diff_summary

ROWS = [(1, 1, 1, "System", "SYS"), (1, 2, 2, "UserMessage", "USR"), (1, 3, 3, "AssistantMessage", "AST"), (1, 4, 4, "ToolResult", "TOOL"), (1, 5, 5, "DocumentChunk", "DOC"), (1, 6, 6, "State", "STATE"), (1, 7, 7, "Plan", "PLN")]
ALL = [make_block_id(i, i) for i in range(1, 8)]


def picked(spark, ids):
    return spark.createDataFrame([(f"{1:032x}", i, b) for i, b in enumerate(ids)], "request_id string, pos int, block_id string")


def pack(spark, ids, task="", budget=1000, packer=Packer(), system=True, rows=ROWS):
    return packer.pack(asks(spark, [1], budget, task), picked(spark, ids), tables(spark, rows), profiles(spark, budget, system=system)).first()


def chat(spark, ids, task="", budget=1000, packer=Packer(), system=True):
    m, p = packer.pack_chat(asks(spark, [1], budget, task), picked(spark, ids), tables(spark, ROWS), profiles(spark, budget, system=system))
    return [(r.role, r.content, r.section) for r in m.orderBy("idx").collect()], p.first()


def test_order_and_bytes(spark):
    r = pack(spark, ALL[::-1], "TASKBODY")
    assert r.rendered == "## System\n\nSYS\n\n## Task\n\nTASKBODY\n\n## State\n\nSTATE\n\n## Plan\n\nPLN\n\n## Tools\n\nTOOL\n\n## Recent\n\nUSR\n\nAST\n\n## Background\n\nDOC\n\n"
    assert pack(spark, ALL, "TASKBODY").rendered == r.rendered
    assert pack(spark, [], "answer the user").rendered == "## Task\n\nanswer the user\n\n" and pack(spark, []).rendered == ""


def test_twice_chosen_is_rendered_twice(spark):
    assert pack(spark, [ALL[6], ALL[6]]).rendered == "## Plan\n\nPLN\n\nPLN\n\n"


def test_errors(spark):
    assert pack(spark, ALL[:1], budget=2).error == "BudgetExceeded"
    assert pack(spark, ["f" * 32]).error == "MissingBlock"
    with pytest.raises(ValueError):
        stable_sections(["recent"])
    assert stable_sections(["state"]) == ("State",)


def test_timestamps(spark):
    p = Packer(now_ms=1700000000000)
    rows = [(1, 1500000000000, 1, "Fact", "important fact")]
    r = pack(spark, [make_block_id(1500000000000, 1)], "go", packer=p, rows=rows)
    assert "[2017-07-14T02:40:00Z] important fact" in r.rendered and "Current time: 2023-11-14T22:13:20Z\n\ngo" in r.rendered
    m, _ = chat(spark, ALL[1:4], packer=p)
    assert [c for _, c, _ in m] == ["[1970-01-01T00:00:00Z] USR", "AST", "[1970-01-01T00:00:00Z] TOOL"]


def test_chat(spark):
    m, p = chat(spark, ALL, "T")
    assert m == [
        ("system", "## System\n\nSYS", "System"), ("system", "## Background\n\nDOC", "Background"), ("system", "## State\n\nSTATE", "State"), ("system", "## Plan\n\nPLN", "Plan"),
        ("user", "USR", "Recent"), ("assistant", "AST", "Recent"), ("tool", "TOOL", "Tools"), ("user", "T", "Task"),
    ]
    assert p.cache_boundary == 1 and p.error is None
    m, _ = chat(spark, ALL, system=False)
    assert {r for r, _, _ in m} == {"user", "assistant", "tool"}
    assert chat(spark, [ALL[5], ALL[1]])[1].cache_boundary is None
    m, p = chat(spark, [ALL[0], ALL[5]], packer=Packer(stable=("State",)))
    assert m[0][2] == "State" and p.cache_boundary == 0
    assert chat(spark, ALL, budget=3)[1].error == "BudgetExceeded"


def test_manifest_counts_anew(spark):
    rows = Packer().manifest(picked(spark, ALL[:2]), tables(spark, ROWS)).orderBy("pos").collect()
    assert [(r.section, r.tokens, r.score) for r in rows] == [("System", 1, 0.0), ("Recent", 1, 0.0)]


def test_diff(spark):
    plan = lambda rows: spark.createDataFrame([("r", i, b, x) for i, (b, x) in enumerate(rows)], "request_id string, pos int, block_id string, reason string")
    rows = diff(plan([("1", "Pinned")]), plan([("1", "HighRelevance"), ("2", "Recency")]))
    tokens = spark.createDataFrame([("r", 10, 22)], "request_id string, prev_tokens long, next_tokens long")
    s = diff_summary(rows, tokens).first()
    assert s.summary == "+1 -0 ~1 (+12 tokens)" and not s.is_noop
    old = diff(plan([("1", None), ("2", None)]), plan([("2", None), ("3", None)]))
    assert {r.block_id: r.change for r in old.collect()} == {"1": "removed", "2": "kept", "3": "added"}
    same = diff(plan([("1", "Pinned")]), plan([("1", "Pinned")]))
    assert diff_summary(same, spark.createDataFrame([("r", 5, 3)], "request_id string, prev_tokens long, next_tokens long")).first()["summary"] == "+0 -0 ~0 (-2 tokens)"


def test_traces_of_many_requests(spark):
    from helpers import blocks

    from ctxloom.operators.pager import Pager
    from ctxloom.operators.traces import from_plans, latest
    from ctxloom.sources import fixtures as fx
    from ctxloom.sources.schemas import TRACES

    t = fx.plain_tables(blocks(spark, [(1, 1, 1, "Fact", "a b"), (2, 2, 2, "Fact", "c")]))
    q, p = asks(spark, [1, 2, 3], 100, "t"), profiles(spark, 100)
    plan = Pager().page(q, t, p)
    rows = from_plans(q, plan.selected, plan.summary, Packer().pack(q, plan.selected, t, p), "word-level", 5)
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], TRACES).schema]
    got = {r.call_id[-1]: (len(r.selected), r.estimated_tokens) for r in latest(rows).collect()}
    assert got == {"1": (1, 2), "2": (1, 1), "3": (0, 0)}
