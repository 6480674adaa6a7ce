import pytest
from helpers import blocks, sid
from pyspark.sql import functions as F

from ctxloom.functions.ids import make_block_id
from ctxloom.sources import fixtures as fx
from ctxloom.sources import tables as st
from ctxloom.sources.seam import BlockStore, Unsupported
from ctxloom.sources.store import ContextStore, SchemaMismatch, StoreError


def ids(df, col="block_id"):
    return sorted(r[col] for r in df.collect())


def stored(spark, rows):
    return st.put(fx.empty_tables(spark), blocks(spark, rows))


def frame(spark, *values, name="block_id"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_put_keeps_the_first(spark):
    t = stored(spark, [(7, 1, 1, "Fact", "same", 0.5), (8, 2, 2, "Plan", "same"), (7, 3, 3, "Fact", "other")])
    a, c = make_block_id(1, 1), make_block_id(3, 3)
    assert ids(t.blocks) == [a, c]
    assert t.blocks.filter(F.col("block_id") == a).first()["kind"] == "Fact"
    assert sorted((r.session_id, r.block_id) for r in t.session_blocks.collect()) == sorted([(sid(7), a), (sid(8), a), (sid(7), c)])
    again = st.put(t, blocks(spark, [(9, 9, 9, "State", "same")]))
    assert ids(again.blocks) == [a, c] and (sid(9), a) in {(r.session_id, r.block_id) for r in again.session_blocks.collect()}


def test_sessions_and_lookup(spark):
    t = stored(spark, [(7, 1, 1, "Fact", "a"), (7, 2, 2, "Fact", "b"), (3, 3, 3, "Fact", "c"), (11, 4, 4, "Fact", "d")])
    assert [r[0] for r in st.list_sessions(t).collect()] == [sid(3), sid(7), sid(11)]
    assert [r[0] for r in st.list_session(t, sid(7)).collect()] == [make_block_id(1, 1), make_block_id(2, 2)]
    h = t.blocks.filter(F.col("block_id") == make_block_id(3, 3)).first()["content_hash"]
    assert ids(st.lookup_hash(t, frame(spark, h, "x", name="content_hash"))) == [make_block_id(3, 3)]
    assert st.get(t, "f" * 32).isEmpty()


def test_delete_scrubs_everything(spark):
    a, b, c = (make_block_id(i, i) for i in (1, 2, 3))
    t = stored(spark, [(1, 1, 1, "Fact", "a"), (2, 1, 1, "Fact", "a"), (1, 2, 2, "Fact", "b"), (1, 3, 3, "Fact", "c")])
    t = st.put_edges(t, spark.createDataFrame([(a, b, "Supports"), (a, c, "DerivedFrom"), (a, b, "Supports"), (b, a, "Parent")], "from_id string, to_id string, kind string"))
    assert t.edges.count() == 3
    assert [(r.kind, r.to_id) for r in st.edges_from(t, frame(spark, a)).collect()] == [("DerivedFrom", c), ("Supports", b)]
    assert [(r.kind, r.from_id) for r in st.edges_to(t, frame(spark, b)).collect()] == [("Supports", a)]
    t = st.delete(t, frame(spark, a))
    assert ids(t.blocks) == [b, c] and t.edges.isEmpty() and ids(t.session_blocks) == [b, c] and ids(t.hash_index) == [b, c]


def test_purge_keeps_shared(spark):
    t = stored(spark, [(1, 1, 1, "Fact", "shared"), (2, 1, 1, "Fact", "shared"), (1, 2, 2, "Fact", "solo")])
    after, removed = st.purge_sessions(t, frame(spark, sid(1), name="session_id"))
    assert removed.first()["removed"] == 2
    assert ids(after.blocks) == [make_block_id(1, 1)] and after.session_blocks.count() == 1


def test_verify_and_repair(spark):
    t = stored(spark, [(1, 1, 1, "Fact", "a"), (1, 2, 2, "Fact", "b")])
    v = st.verify(t).first()
    assert v.is_clean and v.blocks_checked == 2
    from dataclasses import replace

    broken = replace(t, hash_index=t.hash_index.limit(0), session_blocks=t.session_blocks.unionByName(spark.createDataFrame([(sid(5), "e" * 32)], "session_id string, block_id string")), blocks=t.blocks.withColumn("body", F.when(F.col("block_id") == make_block_id(2, 2), F.lit(bytearray(b"z"))).otherwise(F.col("body"))))
    v = st.verify(broken).first()
    assert (v.hash_mismatch, v.missing_index, v.orphan_membership, v.is_clean) == (1, 2, 1, False)
    fixed, quarantined = st.repair(broken)
    assert ids(quarantined) == [make_block_id(2, 2)]
    v = st.verify(fixed).first()
    assert (v.hash_mismatch, v.missing_index, v.orphan_membership) == (1, 0, 0) and fixed.hash_index.count() == 2


def test_snapshots(spark, tmp_path):
    s = ContextStore(spark, str(tmp_path / "s"))
    assert s.tables.blocks.isEmpty()
    old = s.version
    s.commit(st.put(s.tables, blocks(spark, [(1, 1, 1, "Fact", "a")])))
    assert s.version != old and ContextStore(spark, s.path).tables.blocks.count() == 1
    (tmp_path / "s" / "_current").write_text('{"schema_version": 99, "snapshot": "x"}')
    for crc in (tmp_path / "s").glob("._current.crc"):
        crc.unlink()
    with pytest.raises(SchemaMismatch):
        ContextStore(spark, s.path)


def test_a_broken_commit_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    s = ContextStore(spark, path).put(blocks(spark, [(1, 1, 1, "Fact", "a"), (2, 2, 2, "Fact", "b")]))

    def stop(*_):
        raise KeyboardInterrupt

    for step in ("_write", "_publish"):
        for change in (lambda x: x.put(blocks(spark, [(1, 3, 3, "Fact", "c")])), lambda x: x.delete(frame(spark, make_block_id(1, 1)))):
            broken = ContextStore(spark, path)
            monkeypatch.setattr(broken, step, stop)
            with pytest.raises(KeyboardInterrupt):
                change(broken)
            assert ids(ContextStore(spark, path).tables.blocks) == [make_block_id(1, 1), make_block_id(2, 2)]
    # also between writing a version and naming it
    class NoRename:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return stop if name == "rename" else getattr(self.fs, name)

    broken = ContextStore(spark, path)
    broken.fs = NoRename(broken.fs)
    with pytest.raises(KeyboardInterrupt):
        broken.put(blocks(spark, [(1, 3, 3, "Fact", "c")]))
    assert ContextStore(spark, path).tables.blocks.count() == 2


def test_only_changes_are_written(spark, tmp_path):
    path = tmp_path / "s"
    s = ContextStore(spark, str(path)).put(blocks(spark, [(1, i, i, "Fact", f"text {i}") for i in range(1, 200)]))
    first = {f: f.stat().st_size for f in path.rglob("*.parquet")}
    s.put(blocks(spark, [(1, 500, 500, "Fact", "new"), (2, 501, 501, "Fact", "text 7")]))
    s.put_edges(spark.createDataFrame([(make_block_id(1, 1), make_block_id(2, 2), "Supports")] * 2, "from_id string, to_id string, kind string"))
    s.delete(frame(spark, make_block_id(3, 3)))
    new = {f: f.stat().st_size for f in path.rglob("*.parquet") if f not in first}
    assert all(f.exists() for f in first) and sum(spark.read.parquet(str(f)).count() for f in new if "gone" not in str(f)) == 1 + 2 + 1 + 1
    t = ContextStore(spark, str(path)).tables
    assert t.blocks.count() == 199 and t.session_blocks.count() == 200 and t.hash_index.count() == 199 and t.edges.count() == 1
    s.put_edges(spark.createDataFrame([(make_block_id(1, 1), make_block_id(2, 2), "Supports")], "from_id string, to_id string, kind string"))
    assert s.tables.edges.count() == 1
    s.delete(frame(spark, make_block_id(2, 2)))
    assert s.tables.edges.isEmpty()
    s.purge(frame(spark, sid(1), name="session_id"))
    assert ids(s.tables.blocks) == [make_block_id(7, 7)] and s.tables.session_blocks.count() == 1
    old = ContextStore(spark, str(path))
    s.compact()
    assert max(len(p) for p in s.parts.values()) == 1 and ids(s.tables.blocks) == [make_block_id(7, 7)] == ids(old.tables.blocks)
    assert s.vacuum() and ids(ContextStore(spark, str(path)).tables.blocks) == [make_block_id(7, 7)] and not any(f.exists() for f in first)
    # a block that was deleted may come back
    assert s.put(blocks(spark, [(1, 3, 3, "Fact", "text 3")])).tables.blocks.count() == 2


def test_folders_that_are_no_store(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "data.txt").write_text("something else")
    with pytest.raises(StoreError):
        ContextStore(spark, str(tmp_path / "x"))
    s = ContextStore(spark, str(tmp_path / "s"))
    other = ContextStore(spark, s.path)
    s.put(blocks(spark, [(1, 1, 1, "Fact", "a")]))
    with pytest.raises(StoreError):  # of two writers the later one fails
        other.put(blocks(spark, [(1, 2, 2, "Fact", "b")]))
    (tmp_path / "s" / "_versions" / "v9.json").write_text('{"schema_version": 99, "tables": {}}')
    with pytest.raises(SchemaMismatch):
        ContextStore(spark, s.path)


def test_a_store_of_ones_own(spark):
    class Mine(BlockStore):
        def __init__(self):
            self.spark, self.rows = spark, blocks(spark, [(1, 1, 1, "Fact", "a"), (1, 2, 2, "Fact", "a")])

        def table(self, name):
            return self.rows.select("session_id", "block_id") if name == "session_blocks" else self.rows.drop("session_id", "seq")

        def put(self, incoming):
            raise Unsupported

    m = Mine()
    assert m.tables.edges.isEmpty() and m.list_sessions().isEmpty() and [r.block_id for r in m.tables.hash_index.collect()] == [make_block_id(1, 1)]
    for call in (m.delete, m.purge, m.put_edges):
        with pytest.raises(NotImplementedError):
            call(None)
