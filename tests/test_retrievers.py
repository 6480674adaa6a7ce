import pytest
from helpers import asks, sid, tables
from pyspark.sql import functions as F

from ctxloom.functions.ids import make_block_id
from ctxloom.operators import ann, retrievers


def found(df):
    return [(r.block_id, r.score) for r in df.orderBy(F.desc("score"), "block_id").collect()]


FACTS = [(1, 1, 1, "Fact", "canberra is the capital of australia"), (1, 2, 2, "Fact", "the moon is a satellite of earth"), (1, 3, 3, "Fact", "nothing useful here")]


def test_session_takes_the_oldest(spark):
    t = tables(spark, [(1, i, i, "Fact", f"b{i}") for i in range(1, 11)])
    assert [b for b, _ in found(retrievers.Session(limit=3)(asks(spark, [1], 9), t))] == [make_block_id(i, i) for i in (1, 2, 3)]


def test_recency(spark):
    t = tables(spark, [(1, 1000, 1, "Fact", "old"), (1, 5000, 2, "Fact", "mid"), (1, 9000, 3, "Fact", "new"), (2, 7, 7, "Fact", "only")])
    got = found(retrievers.Recency()(asks(spark, [1], 9), t))
    assert got == [(make_block_id(9000, 3), 1.0), (make_block_id(5000, 2), 0.5), (make_block_id(1000, 1), 0.0)]
    assert found(retrievers.Recency()(asks(spark, [2], 9), t)) == [(make_block_id(7, 7), 0.0)]


def test_half_life(spark):
    t = tables(spark, [(1, 1_000_000 - d, d + 1, "Fact", f"x{d}") for d in (0, 60_000, 120_000)])
    assert [s for _, s in found(retrievers.Recency(half_life_s=60.0)(asks(spark, [1], 9), t))] == pytest.approx([1, 0.5, 0.25], abs=1e-3)


def test_lexical_and_bm25(spark):
    t = tables(spark, FACTS)
    q = asks(spark, [1], 9, "what is the capital of australia")
    for r in (retrievers.Lexical(), retrievers.Bm25()):
        got = found(r(q, t))
        assert got[0][0] == make_block_id(1, 1) and all(0 <= s <= 1 for _, s in got)
        assert r(asks(spark, [1], 9, ""), t).isEmpty()
    assert found(retrievers.Bm25()(q, t))[0][1] == 1.0
    assert len(found(retrievers.Bm25()(asks(spark, [1], 9, "australia"), t))) == 1
    many = tables(spark, [(1, i, i, "Fact", f"relevant relevant block {i}") for i in range(1, 11)])
    assert len(found(retrievers.Bm25(limit=3)(asks(spark, [1], 9, "relevant"), many))) == 3


def test_bodies_that_are_not_text_are_left_out(spark):
    t = tables(spark, FACTS)
    from dataclasses import replace

    t = replace(t, blocks=t.blocks.withColumn("body", F.when(F.col("block_id") == make_block_id(1, 1), F.lit(bytearray(b"\xff"))).otherwise(F.col("body"))))
    assert make_block_id(1, 1) not in dict(found(retrievers.Lexical()(asks(spark, [1], 9, "the capital moon"), t)))


def test_merge_pinned_shared_python(spark):
    t = tables(spark, [*FACTS, (2, 9, 9, "Fact", "global")])
    q = asks(spark, [1], 9, "moon")

    class Mine:
        name = "mine"

        def retrieve(self, session, task, limit):
            assert session == 1 and task == "moon"
            return [(make_block_id(9, 9), 7.0)]

    got = dict(found(retrievers.merge(q, t, [retrievers.Session(0.25), retrievers.Pinned((make_block_id(2, 2),)), retrievers.Shared(sid(2)), retrievers.PythonRetriever(Mine())]).withColumn("source", F.lit(""))))
    assert got == {make_block_id(1, 1): 0.25, make_block_id(2, 2): 1.0, make_block_id(3, 3): 0.25, make_block_id(9, 9): 1.0}
    with pytest.raises(AttributeError):
        retrievers.PythonRetriever(object())
    with pytest.raises(ValueError, match="known"):
        retrievers.from_config("magic")


def embed(texts):
    return [[float(t[:1] == c) for c in "abc"] + [float(t[:1] not in ("a", "b", "c"))] for t in texts]


def test_ann_exact(spark):
    t = tables(spark, [(1, 1, 1, "Fact", "alpha block"), (1, 2, 2, "Fact", "beta block"), (1, 3, 3, "Fact", "canberra capital")])
    toy = ann.Embedder("toy", 4, embed)
    empty = spark.createDataFrame([], "embedder string, content_hash string, dim int, vector array<float>, version bigint")
    cache = ann.embed_missing(t.blocks, empty, toy, 1)
    assert cache.count() == 3 and ann.embed_missing(t.blocks, cache, toy, 2).isEmpty()
    for task, want in (("capital query", 3), ("anything goes", 1), ("blocks here", 2)):
        q = asks(spark, [1], 9, task).withColumn("task_vector", toy.column()(F.col("task")))
        got = found(ann.AnnExact(cache, "toy")(q, t))
        assert got == [(make_block_id(want, want), 1.0)]


def test_lsh_recall(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.standard_normal((20, 16))
    rows = [("s", f"p{i:03d}", [float(x) for x in base[i % 20] + 0.05 * rng.standard_normal(16)]) for i in range(200)]
    p = spark.createDataFrame(rows, "session_id string, point_id string, vector array<float>")
    q = p.limit(20).withColumnRenamed("point_id", "query_id")
    got = {(r.query_id, r.point_id) for r in ann.nearest_lsh(q, p, 16, 5).collect()}
    m = np.array([r[2] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for r in q.collect():
        i = int(r.query_id[1:])
        s = m @ m[i]
        s[i] = -9
        want |= {(r.query_id, f"p{j:03d}") for j in np.argsort(-s)[:5]}
    assert len(got & want) / len(want) >= 0.9


def test_lsh_recall_on_embeddings(spark):
    """Against brute force on the driver's own vectors, whose neighbours are far from each other."""
    import os

    import numpy as np
    import pytest

    from ctxloom.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no driver tables")
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    ids, labels, m = np.array([r.vec_id for r in v]), np.array([r.label for r in v]), np.array([r.embedding for r in v], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        s = np.where((labels == labels[i]) & (ids != ids[i]), m @ m[i], -9)
        want |= {(int(ids[i]), int(ids[j])) for j in np.argsort(-s)[:5] if s[j] > -9}
    rows = QUERIES["retrieve_ann_lsh"](spark, sf).collect()
    got = {(int(r.query_id, 16), int(r.point_id, 16)) for r in rows}
    assert len(got) == len(rows) and len(got & want) / len(want) >= 0.9


def test_exact_fallback_scores_as_cosine(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in rng.standard_normal(8)] for _ in range(60)] + [[0.0] * 8, [], [1.0, 2.0], [1.0, 2.0]]
    p = spark.createDataFrame([("s", f"p{i:02d}", v) for i, v in enumerate(vectors)], "session_id string, point_id string, vector array<float>")
    q = p.withColumnRenamed("point_id", "query_id")
    pairs = q.alias("q").join(p.alias("p"), "session_id").filter("query_id <> point_id").select("query_id", "point_id", ann.cosine(F.col("q.vector"), F.col("p.vector")).alias("score")).collect()
    for rows in (7, 1024):
        got = {(r.query_id, r.point_id): r.score for r in ann.nearest_exact(q, p, 64, rows).collect()}
        assert got == {(r.query_id, r.point_id): r.score for r in pairs}


def test_recency_does_not_read_bodies(spark, tmp_path):
    t = tables(spark, FACTS)
    t.blocks.write.parquet(str(tmp_path / "b"))
    t.session_blocks.write.parquet(str(tmp_path / "m"))
    from dataclasses import replace

    disk = replace(t, blocks=spark.read.parquet(str(tmp_path / "b")), session_blocks=spark.read.parquet(str(tmp_path / "m")))
    plan = retrievers.Recency(limit=500)(asks(spark, [1], 9), disk)._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "WindowGroupLimit" in plan


def test_ann_lsh_retriever(spark):
    t = tables(spark, [(1, 1, 1, "Fact", "alpha block"), (1, 2, 2, "Fact", "beta block"), (2, 3, 3, "Fact", "alpha other")])
    toy = ann.Embedder("toy", 4, embed)
    empty = spark.createDataFrame([], "embedder string, content_hash string, dim int, vector array<float>, version bigint")
    index = ann.build_index(t, ann.embed_missing(t.blocks, empty, toy, 1), "toy", 4)
    q = asks(spark, [1], 9, "anything").withColumn("task_vector", toy.column()(F.col("task")))
    assert found(ann.AnnLsh(index, 4)(q, t))[0] == (make_block_id(1, 1), 1.0)


def test_remote_services():
    from ctxloom.operators import remote

    sent = []

    def send(body):
        sent.append(body)
        return {"data": [{"index": i, "embedding": [i, 0]} for i in reversed(range(len(body["input"])))]}

    e = remote.remote_embedder("r", "m", 2, send)
    assert e.embed_batch(["a", "b"]) == [[0.0, 0.0], [1.0, 0.0]] and e.embed_batch([]) == [] and len(sent) == 1
    with pytest.raises(remote.RemoteError):
        remote.read_embeddings({"data": [{"index": 1, "embedding": [1]}]}, 1)
    ask = remote.remote_summarizer("m", lambda body: {"content": [{"type": "text", "text": body["messages"][0]["content"].upper()}]})
    assert ask("x") == "X" and ask("") == ""
    with pytest.raises(remote.RemoteError):
        remote.read_summary({"content": []})


@pytest.fixture
def large(spark, tmp_path):
    """One source with more documents than any default limit."""
    from ctxloom.plans.models import RETRIEVAL_LIMIT

    n = 2 * RETRIEVAL_LIMIT
    text = F.concat(F.lit("the password work "), F.repeat(F.lit("filler "), (F.col("id") % 3).cast("int")))
    spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src").alias("source")).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), n


def test_merge_of_a_session_beyond_the_default_limit(spark, large):
    from ctxloom.plans.catalog import QUERIES

    sf, n = large
    rows = {int(r.block_id[12:], 16): r.score for r in QUERIES["merge_max"](spark, sf).collect()}
    lexical = 3 / 4  # of every document, or 1 for those without filler
    assert len(rows) == n and all(rows[i] == pytest.approx(max(i / (n - 1), 1.0 if i % 3 == 0 else lexical), abs=1e-6) for i in range(n))


def test_no_limit_gives_every_candidate(spark):
    t = tables(spark, [(1, i, i, "Fact", f"moon {i}") for i in range(1, 7)])
    q = asks(spark, [1], 9, "moon")
    for r in (retrievers.Session, retrievers.Recency, retrievers.Lexical, retrievers.Bm25):
        assert len(found(r(limit=2)(q, t))) == 2 and len(found(r(limit=None)(q, t))) == 6


def test_text_retrievers_beyond_the_default_limit(spark, large):
    from ctxloom.plans.catalog import QUERIES

    sf, n = large
    for name in ("retrieve_bm25", "retrieve_lexical"):
        assert QUERIES[name](spark, sf).select("block_id").distinct().count() == n


def test_lsh_scores_blocks_and_not_rows(spark):
    """No row is made for a pair that shares a band; keys are those of signatures()."""
    import numpy as np

    rng = np.random.default_rng(8)
    p = spark.createDataFrame([("s", f"p{i:03d}", [float(x) for x in rng.standard_normal(8)]) for i in range(60)] + [("s", "short", [1.0]), ("s", "none", None)], "session_id string, point_id string, vector array<float>")
    plan = ann.nearest_lsh(p.withColumnRenamed("point_id", "query_id"), p, 8, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan
    keys = lambda df: sorted((r.point_id, r["__key"]) for r in df.select("point_id", "__key").collect())
    assert keys(ann._keyed(p, 8, 12, 6)) == keys(ann.signatures(p, "vector", 8, 12, 6))
