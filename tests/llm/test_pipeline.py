"""The pipeline's stages over the smallest driver tables, each against what its operator says of its input."""
import hashlib
import os
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ctxloom.llm import mixing, quality, simhash, suffix
from ctxloom.llm.common import spill
from ctxloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def test_stages(spark):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    columns = before.columns
    for name, stage in corpus_pipeline.STAGES:
        after = spill(stage(spark, before, SF), "test-stage")
        if name == "quality":
            want = {r.doc_id for r in quality.score_quality(before).filter("kept").collect()}
            assert {r.doc_id for r in after.collect()} == want
        if name == "simhash":
            found = simhash.near_duplicates(before).collect()
            assert {r.doc_id for r in after.collect()} == {r.component_id for r in found}
        if name == "suffix":
            cut = {r.doc_id: r.n_removed for r in suffix.find_repeats(before).collect()}
            old = {r.doc_id: r.text for r in before.collect()}
            for r in after.collect():
                assert (r.text == old[r.doc_id]) == (cut[r.doc_id] == 0)
            assert set(old) == set(cut) == {r.doc_id for r in after.collect()}
        if name == "mixing":  # as many copies of each source and size as the operator says
            size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("size")
            copies = mixing.mix_sources(before).join(before.select("doc_id", "source"), "doc_id").groupBy("source", "size").agg(F.sum("copies").alias("n")).filter("n > 0")
            assert {(r.source, r.size): r.n for r in copies.collect()} == {(r.source, r.size): r["count"] for r in after.select("source", size).groupBy("source", "size").count().collect()}
            assert {(r.doc_id, r.text) for r in after.collect()} <= {(r.doc_id, r.text) for r in before.collect()}
        if name == "bpe":
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            ids = {r.doc_id: lib.encode(r.text or "", add_special_tokens=False).ids for r in before.collect()}
            for r in after.collect():
                assert list(r.ids) == ids[r.doc_id] and r.n_tokens == len(r.ids)
                assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(lib.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()
        if name != "bpe":
            assert after.columns == columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]
        else:
            assert after.count() == before.count()
        before = after


CLASHES = ("block", "part", "h", "row", "id", "keep_id", "keep_hash", "size", "key", "n", "fp", "root", "word", "path", "at")
PROSE = "This is a calm sentence about nothing in particular, and it ends quite well after all of these words. "
ROWS = [
    (1, PROSE * 2, "a"), (2, None, "a"), (3, "", "b"), (4, " \t\n", "b"), (5, PROSE + "One more, different from the others in what it says at length here and there.", None), (5, "Another text with the id of the one before it, long enough to be judged by its words alone.", "a"),
    (6, "Twin text, in two rows that are alike in all but their ids, and long enough to be kept as well.", "b"), (7, "Twin text, in two rows that are alike in all but their ids, and long enough to be kept as well.", "b"), (7, "Twin text, in two rows that are alike in all but their ids, and long enough to be kept as well.", "b"),
    (None, "No id here, but a sentence that is as good as any other one of its length and its kind.", "a"), (8, " ".join(f"word{i} goes on." for i in range(20000)), "c"),
]


def awkward(spark, rows=ROWS):
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHES])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_with_awkward_tables(spark, name, stage):
    before = awkward(spark)
    after = stage(spark, before, SF)
    got = after.collect()
    if name != "bpe":
        assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]
        assert all(r[c] == f"clash {c}" for r in got for c in CLASHES)
    none = stage(spark, before.filter("doc_id < -1"), SF)
    assert none.columns == after.columns and none.isEmpty()
    texts = Counter((r.doc_id, r.text) for r in got) if name != "bpe" else None
    if name == "quality":  # null, empty and wordless texts are rejected; rows that repeat are judged one by one
        want = Counter((i, quality.judge(t)[7]) for i, t, _ in ROWS if quality.judge(t)[6])
        assert texts == want and 2 not in {r.doc_id for r in got} and len(got) >= 6
    if name == "simhash":  # null and wordless texts are one group; of equal texts the least id stays, a null id last
        assert texts[2, None] == 1 and not {3, 4, 7} & {r.doc_id for r in got} and texts[6, ROWS[6][1]] == 1 and texts[None, ROWS[9][1]] == 1 and len(got) == 7
    if name == "suffix":  # no row goes; null ids and null texts stay as they are
        assert len(got) == len(ROWS) and texts[2, None] == 1 and texts[None, ROWS[9][1]] == 1 and texts[8, ROWS[10][1]] == 1 and texts[7, ""] == 2 and texts[6, ROWS[6][1]] == 1
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    if name == "mixing":  # without words nothing is taken
        assert not {2, 3, 4} & {r.doc_id for r in got} and set(texts) <= {(i, t) for i, t, _ in ROWS} and max(texts.values()) <= 6
    if name == "bpe":
        assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in ROWS) and all(r.n_tokens == 0 for r in got if r.doc_id in (2, 3, 4))


def test_run_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    from ctxloom.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] in ("quality", "mixing", "bpe")])
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["pipeline-mixing"]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "suffix", "mixing", "bpe"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twins(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    r = c.execute(ORACLE[name])
    cols = sorted(d[0] for d in r.description)
    at = [d[0] for d in r.description]
    assert cols == sorted(df.columns)
    assert sorted(repr([x[c] for c in cols]) for x in df.collect()) == sorted(repr([x[at.index(c)] for c in cols]) for x in r.fetchall())
