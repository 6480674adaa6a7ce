import pytest
from pyspark.sql import functions as F

from ctxloom.functions import ids, text, tokenizers, vectors
from ctxloom.plans.models import BUDGET_TABLES, ModelProfile, ModelRegistry, SectionBudgets, kebab


def one(spark, col):
    return spark.range(1).select(col).first()[0]


def test_ids():
    b = ids.make_block_id(1700000000000, 0xDEADBEEFCAFEBABEF00D)
    assert len(b) == 32 and int(b[:12], 16) == 1700000000000
    assert ids.make_block_id(2**64 - 1, 0)[:12] == "f" * 12
    assert ids.make_block_id(1000, 2**80 - 1) < ids.make_block_id(2000, 0)
    assert ids.parse_id("42") == f"{42:032x}" and ids.parse_id("0xff") == ids.parse_id("0XFF") == f"{255:032x}" and ids.parse_id(b) == b
    for bad in ("g" * 32, "a" * 31, "a" * 33, "-1", ""):
        with pytest.raises(ValueError):
            ids.parse_id(bad)


def test_id_columns(spark):
    assert one(spark, ids.timestamp_ms(ids.block_id(F.lit(1700000000000), F.lit(7)))) == 1700000000000
    assert one(spark, ids.is_id(F.lit("a" * 32))) and not one(spark, ids.is_id(F.lit("a" * 31)))


@pytest.mark.parametrize("ms,want", [(0, "1970-01-01T00:00:00Z"), (1000, "1970-01-01T00:00:01Z"), (86400000, "1970-01-02T00:00:00Z"), (946684800000, "2000-01-01T00:00:00Z"), (1709164800999, "2024-02-29T00:00:00Z"), (1500000000000, "2017-07-14T02:40:00Z"), (1700000000000, "2023-11-14T22:13:20Z"), (-1, "1969-12-31T23:59:59Z")])
def test_iso8601(spark, ms, want):
    assert one(spark, text.iso8601(F.lit(ms))) == want


def test_terms_measure_bytes_before_lower_case(spark):
    assert one(spark, text.terms(F.lit("É a the_cat, Straße 42"), 2)) == ["é", "the", "cat", "straße", "42"]
    assert one(spark, text.word_set(F.lit(" The the CAT "))) == ["the", "cat"]
    assert one(spark, text.word_set(F.lit(None).cast("string"))) == []
    assert one(spark, text.trim_end(F.lit("a b \n　"))) == "a b"


def test_utf8(spark):
    raw = F.lit(bytearray(b"\xff\xfe"))
    assert one(spark, text.body_text(raw)) is None
    with pytest.raises(Exception, match="UTF"):
        one(spark, text.strict_text(raw))


def test_word_level(spark):
    count = tokenizers.word_level().count
    assert [one(spark, count(F.lit(t))) for t in ("hello world", "", "a, b!!", None)] == [2, 0, 4, 0]


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x]).cast("array<float>")
    got = [one(spark, vectors.cosine(a, b)) for a, b in ((v(1, 0), v(1, 0)), (v(1, 0), v(0, 1)), (v(), v()), (v(1, 0), v(1, 0, 0)), (v(0, 0), v(1, 0)), (v(-1, 0), v(1, 0)))]
    assert got == pytest.approx([1, 0, 0, 0, 0, 0])


def test_registry_and_profiles(spark):
    r = tokenizers.TokenizerRegistry()
    with pytest.raises(tokenizers.UnknownTokenizer):
        r.require("llama-3")
    assert r.ids() == ["cl100k_base", "o200k_base", "word-level"] and r.require("o200k_base").python
    assert ModelProfile("a", 128000, 4000, 1000).input_budget == 123000 and ModelProfile("b", 1000, 4000).input_budget == 0
    m = ModelRegistry().register(ModelProfile("o1", 10, 1))
    assert m.get("o1").input_budget == 9 and len(m.names()) == 10
    assert {x.name: x.input_budget for x in m.table(spark).collect()}["gpt-4.1"] == 1015552
    assert kebab("DocumentChunk") == "document-chunk"


def test_budgets(spark):
    alloc = lambda b, s, n=1000: one(spark, b.allocation(s, F.lit(n)))
    d = SectionBudgets()
    assert [alloc(d, s) for s in ("State", "Plan", "Recent", "Retrieved", "Tools", "Background", "Slack", "System", "Task")] == [100, 50, 200, 400, 150, 50, 50, 0, 0]
    two = SectionBudgets.empty().set("Recent", 0.75).set("Retrieved", 0.75)
    assert alloc(two, "Recent") == alloc(two, "Retrieved") == 500
    assert SectionBudgets.empty().set("Recent", 5.0).fractions == {"Recent": 1.0} and SectionBudgets.empty().set("Recent", -1.0).fractions == {"Recent": 0.0}
    assert alloc(SectionBudgets.empty().set("System", 0.5).set("Task", 0.5), "System") == 0
    assert set(BUDGET_TABLES) == {"default", "chat-loop", "focused-qa", "rag-heavy"}


def test_stored_counts(spark):
    from helpers import tables

    t = tables(spark, [(1, 1, 1, "Fact", "one two"), (1, 2, 2, "Fact", "one")])
    got = tokenizers.with_token_counts(t.blocks, tokenizers.word_level())
    assert sorted(r.token_counts["word-level"] for r in got.collect()) == [1, 2]
    lied = t.blocks.withColumn("token_counts", F.create_map(F.lit("word-level"), F.lit(999).cast("long")))
    assert {r.tokens for r in tokenizers.count_blocks(lied, tokenizers.word_level()).collect()} == {999}
    assert {r.tokens for r in tokenizers.count_blocks(lied, tokenizers.word_level(), live=True).collect()} == {1, 2}


def test_tokenizers_hold_few_tokens(spark):
    """What a worker holds at once does not grow with the Arrow batch."""
    import pandas as pd

    from ctxloom.functions import tokenizers

    alive = most = 0

    class Tokens(list):
        def __init__(self, n):
            nonlocal alive, most
            super().__init__(range(n))
            self.ids = range(n)
            alive += n
            most = max(most, alive)

        def __del__(self):
            nonlocal alive
            alive -= len(self)

    class Stub:
        def encode_ordinary(self, text):
            return Tokens(len(text))

        def encode_ordinary_batch(self, texts, **_):
            return [Tokens(len(t)) for t in texts]

        def encode_batch_fast(self, texts, **_):
            return [Tokens(len(t)) for t in texts]

    texts = pd.Series(["x" * (i % 5 * 100_000) for i in range(100)] + [None])
    tokenizers._loaded["stub"] = Stub()
    try:
        for made, bound in ((tokenizers._tiktoken("t", "stub", Stub), 800_000), (tokenizers.hugging_face("h", "stub"), 2_500_000)):
            most = 0
            got = made.count.__wrapped__ if hasattr(made.count, "__wrapped__") else made.count.func
            assert got(texts).tolist() == texts.fillna("").str.len().tolist() and alive == 0 and most <= bound
    finally:
        del tokenizers._loaded["stub"]


def test_single_precision_of_large_integers(spark):
    import numpy as np

    from ctxloom.functions.text import ratio32

    pairs = [(98_594_000, 256_409_000), (104_715_000, 256_409_000), (33_554_435, 67_108_867), (1, 3)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a long, b long").select(ratio32(F.col("a"), F.col("b"))).collect()]
    assert got == [float(np.float32(a) / np.float32(b)) for a, b in pairs]
