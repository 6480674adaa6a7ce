import json

from helpers import asks, profiles, sid
from pyspark.sql import functions as F

from ctxloom.functions.ids import content_hash
from ctxloom.operators.packer import Packer
from ctxloom.operators.pager import Pager
from ctxloom.sources import fixtures as fx
from ctxloom.sources import readers, sinks
from ctxloom.sources.tables import put


def test_files_to_prompts(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"alpha notes")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe raw")
    (tmp_path / "c.txt").write_bytes(b"left out")
    rows = readers.from_files(spark, str(tmp_path), sid(1), "document-chunk", "*.md")
    t = put(fx.empty_tables(spark), rows)
    assert sorted(bytes(r.body) for r in t.blocks.collect()) == [b"alpha notes", b"\xff\xfe raw"]
    shown = {json.loads(r.json)["body"] for r in sinks.block_json(t.blocks).collect()}
    assert shown == {"alpha notes", "fffe20726177"}


def test_table_and_json(spark):
    df = spark.createDataFrame([(1, "one", 1000), (2, "two", 2000), (3, "one", 3000)], "id long, note string, ms long")
    t = put(fx.empty_tables(spark), readers.from_table(df, F.lit(sid(1)), "fact", "note", "ms", "id"))
    assert t.blocks.count() == 2 and t.blocks.filter(F.col("content_hash") == content_hash(F.lit("one").cast("binary"))).first()["created_at_ms"] == 1000
    q, p = asks(spark, [1, 2], 100, "go"), profiles(spark, 100)
    plan = Pager().page(q, t, p)
    got = {r.request_id: json.loads(r.json) for r in sinks.plan_json(plan.selected, plan.omitted, plan.summary).collect()}
    assert len(got[sid(1)]["selected"]) == 2 and got[sid(1)]["estimated_tokens"] == 2 and got[sid(2)]["selected"] == []
    chat = {r.request_id: json.loads(r.json) for r in sinks.chat_json(*Packer().pack_chat(q, plan.selected, t, p)).collect()}
    assert [m["role"] for m in chat[sid(1)]["messages"]] == ["system", "user"] and chat[sid(2)]["messages"][0]["content"] == "go"
