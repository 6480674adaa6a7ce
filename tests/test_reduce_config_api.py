import io
import json

import pytest
from helpers import blocks, sid

from ctxloom.api import ContextError, Store
from ctxloom.cli import main
from ctxloom.functions.ids import make_block_id
from ctxloom.operators import reduce, traces
from ctxloom.operators.packer import PackerError
from ctxloom.operators.pager import PagerError
from ctxloom.plans.config import Config, ConfigError, loads
from ctxloom.plans.models import ModelProfile


def outputs(spark, *rows):
    return spark.createDataFrame([(str(i), o, 100 + i, s) for i, (o, s) in enumerate(rows)], "call_id string, output string, now_ms long, state_id string")


def test_append(spark):
    state = make_block_id(100, 1)
    b, e = reduce.append_output(outputs(spark, ("hello there", state), ("", None), ("solo", None)))
    rows = {r.call_id: r for r in b.collect()}
    assert set(rows) == {"0", "2"} and rows["0"].kind == "AssistantMessage" and rows["0"].provenance.parents == [state]
    assert [(r.to_id, r.kind) for r in e.collect()] == [(state, "Parent")] and len(rows["0"].block_id) == 32
    assert reduce.append_output(outputs(spark, ("hello there", state)), link_to_state=False)[1].isEmpty()
    assert reduce.identity(outputs(spark, ("x", None)))[0].isEmpty()


def test_json_events(spark):
    env = json.dumps({"state": "S", "events": [{"kind": "fact", "body": "F"}, {"kind": "plan", "body": "P"}, {"kind": "fact", "body": ""}]})
    bad = json.dumps({"events": [{"kind": "document-chunk", "body": "x"}]})
    b, err = reduce.json_events(outputs(spark, ("  " + env + "\n", "a" * 32), ('{"events": []}', None), ("not json", None), (bad, None), (json.dumps({"events": [{"kind": "fact"}]}), None), (json.dumps({"state": ""}), None)))
    got = sorted((r.call_id, r.kind, bytes(r.body).decode(), r.is_state) for r in b.collect())
    assert got == [("0", "Fact", "F", False), ("0", "Plan", "P", False), ("0", "State", "S", True)]
    assert sorted(r.call_id for r in err.collect()) == ["2", "3", "4"]
    same = reduce.json_events(outputs(spark, (json.dumps({"events": [{"kind": "fact", "body": "B"}, {"kind": "plan", "body": "B"}]}), None)))[0].collect()
    assert len({r.block_id for r in same}) == 2


def test_summarizers(spark):
    b = blocks(spark, [(1, 1, 1, "Fact", "x" * 200), (1, 2, 2, "UserMessage", "a\n  b\tc")])
    assert reduce.truncating(b, 20).first()["summary"] == "- fact: " + "x" * 20 + "…\n- user: a b c\n"
    assert reduce.noop(b).first()["summary"] == "[summary of 2 block(s) elided]"
    assert reduce.external(b, lambda p: p.split("\n")[0].upper()).first()["summary"] == "--- BLOCK 1 (FACT) ---"
    made = reduce.summary_blocks(reduce.noop(b), b, "noop", 9).first()
    assert made.kind == "Summary" and made.provenance.source == "summarize:noop" and made.provenance.parents == [make_block_id(1, 1), make_block_id(2, 2)]


CONFIG = """
[[profile]]
name = "tiny"
max_context = 100
reserved_output = 10
tokenizer = "word-level"
[[retriever]]
kind = "bm25"
k1 = 1.5
[[retriever]]
kind = "recency"
half_life_secs = 60.0
[section_budgets]
recent = 0.5
retrieved = 0.5
[packer]
include_timestamps = false
[cache]
stable_sections = ["system"]
"""


def test_config():
    c = loads(CONFIG)
    assert c.models.get("tiny").input_budget == 90 and [r.name for r in c.retrievers] == ["bm25", "recency"] and c.stable_sections == ("System",)
    assert c.budgets.fractions == {"Recent": 0.5, "Retrieved": 0.5}
    for bad in ('[[profile]]\nname = "x"', '[[retriever]]\nkind = "magic"', '[cache]\nstable_sections = ["recent"]', "[nonsense]", "= 3", '[[retriever]]\nkind = "bm25"\nk9 = 1'):
        with pytest.raises(ConfigError):
            loads(bad)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    ticks, rands = iter(range(1_000_000, 9_000_000, 1000)), iter(range(1, 1000))
    config = Config()
    for name, budget in (("tiny", 60), ("wide", 5000)):
        config.models.register(ModelProfile(name, budget, 0, 0, "word-level"))
    return Store(spark, str(tmp_path_factory.mktemp("store") / "s"), config, lambda: next(ticks), lambda: next(rands))


def test_store_facade(store):
    a = store.put(1, "user-message", "what is the capital of australia")
    b = store.put(1, "Fact", "canberra is the capital of australia")
    assert store.put(2, "Fact", "canberra is the capital of australia") == b
    assert store.list_sessions() == [sid(1), sid(2)] and store.list_session(1) == [a, b]
    assert bytes(store.show(b)["body"]) == b"canberra is the capital of australia" and store.show("f" * 32) is None
    store.add_edge(a, b, "supports")
    assert store.edges_from(a) == [("Supports", b)] and store.edges_to(b) == [("Supports", a)]
    assert store.verify()["is_clean"]
    p = store.page(1, "wide", "capital")
    assert {x[0] for x in p.selected} == {a, b}
    r = store.pack(1, "wide", "capital", trace=True)
    assert r.rendered.startswith("## Task\n\ncapital\n\n## Retrieved") and store.trace(r.call_id)["estimated_tokens"] == p.estimated_tokens
    c = store.pack(1, "wide", "capital", chat=True, trace=True)
    assert [m["role"] for m in c.messages] == ["system", "user", "user"]
    store.update_output(r.call_id, "the answer is 42", 5)
    assert store.trace(r.call_id)["output"] == "the answer is 42"
    with pytest.raises(traces.UnknownCall):
        store.update_output(404, "x", 1)
    assert store.diff(r.call_id, c.call_id)[1] == "+0 -0 ~0 (+0 tokens)"
    again = store.pack_with_plan(p, 1, "wide", "capital")
    assert again.rendered == r.rendered
    assert store.summarize(1, last=1, store=True) == "- fact: canberra is the capital of australia\n"
    with pytest.raises(ContextError):
        store.page(1, "nope")
    with pytest.raises(PagerError):
        store.page(1, "wide", required=["e" * 32])
    with pytest.raises(PackerError):
        store.pack_with_plan(p, 1, "tiny", "word " * 100)
    with pytest.raises(ContextError):
        store.put(1, "nonsense", "x")
    assert store.purge_session(2) == 1 and store.show(b) is not None
    assert store.delete(a) and not store.delete(a)


def test_cli(spark, tmp_path):
    def run(*args):
        out = io.StringIO()
        code = main(["--store", str(tmp_path / "c"), *args], spark, out)
        return code, out.getvalue().strip()

    (tmp_path / "f.txt").write_text("hello from a file")
    assert run("init")[0] == 0
    code, block = run("put", "1", "fact", str(tmp_path / "f.txt"))
    assert code == 0 and len(block) == 32
    assert run("show", block)[1].endswith("hello from a file") and run("show", "f" * 32)[0] == 1
    assert run("list-sessions")[1] == sid(1)
    assert run("verify")[0] == 0
    assert run("repair")[0] == 2 and run("purge", "--yes")[0] == 2
    assert "gpt-4.1 1015552" in run("list-models")[1]
    assert run("summarize", "1")[1] == "- fact: hello from a file" and run("summarize", "1", "--max-chars", "5")[1] == "- fact: hello…"
    assert run("summarize", "1", "--summarizer", "noop")[1] == "[summary of 1 block(s) elided]" and run("summarize", "1", "--summarizer", "external")[0] == 2
    (tmp_path / "say.py").write_text("import json, sys; b = json.load(sys.stdin); print(json.dumps({'content': [{'type': 'text', 'text': f\"{b['model']} {b['max_tokens']}\"}]}))")
    import sys

    assert run("summarize", "1", "--summarizer", "external", "--command", f"{sys.executable} {tmp_path / 'say.py'}", "--model", "m1", "--max-tokens", "9")[1] == "m1 9"
    (tmp_path / "c.toml").write_text('[[profile]]\nname = "w"\nmax_context = 1000\nreserved_output = 1\ntokenizer = "word-level"\n')
    code, other = run("put", "1", "fact", str(tmp_path / "c.toml"))
    run("add-edge", block, other, "supports")
    assert run("edges", block, "--outgoing")[1] == f"-> Supports {other}" and run("edges", block, "--incoming")[1] == "" and run("edges", other)[1] == f"<- Supports {block}"
    pack = lambda *more: run("--config", str(tmp_path / "c.toml"), "pack", "1", "w", "--task", "go", *more)[1]
    assert pack("--prompt-only").startswith("## Task\n\ngo") and not pack("--prompt-only").endswith("tokens]") and pack().endswith("tokens]") and pack("--prompt-only", "--timestamps").startswith("## Task\n\nCurrent time: ")
    assert run("purge", "--block", other, "--yes")[1] == "True"
    assert run("purge", "--session", "1", "--yes")[1] == "1"
