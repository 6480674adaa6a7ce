"""Each operator on small tables with every awkward case, against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark import TaskContext, cloudpickle
from pyspark.sql import functions as F

from ctxloom.llm import bpe, hmm, langid, mixing, quality, rans, simhash, suffix, topk, warc
from ctxloom.llm.common import spill_to
from ctxloom.llm.graph import components

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")

LONG = " ".join(f"w{i % 911} x{i % 37}." for i in range(30000))
TEXTS = [
    None, "", "   ", "one", "a b c", "The quick brown fox. " * 30, "the quick brown fox. " * 30, "same text here for all of us to see", "same text here for all of us to see",
    "Zürich déjà vu ñandú ß. " * 12, "line one is here.\nline two is there.\nline one is here.\n| a | b | c | d |\nread more", "x" * 3000, LONG, "tab\tand\x0bfeed\x0cand nbsp é", "<|endoftext|> inside <|startoftext|>", "日本語のテキスト 日本語",
]
SOURCES = ["b", None, "a", "b", "b", "c", "c", "a", None, "c", "b", "a", "a", "z", "z", "z"]


def docs(spark, texts=TEXTS, extra=True):
    rows = [(i, t, SOURCES[i % len(SOURCES)], ["en", "de", None, "fr"][i % 4]) for i, t in enumerate(texts)]
    rows += [(None, "null id text, long enough to count for something here", "a", "en"), (3, "one", "b", "fr"), (3, "one", "b", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    # names that operators might use inside
    return df.select("*", F.lit("clash").alias("size"), F.lit("clash").alias("key"), F.lit("clash").alias("n"), F.lit("clash").alias("fp"), F.lit("clash").alias("rank"), F.lit("clash").alias("h")) if extra else df


@pytest.fixture(scope="module")
def table(spark):
    return docs(spark).cache()


@pytest.fixture(scope="module")
def rows(table):
    return [(r.doc_id, r.text, r.source, r.lang) for r in table.collect()]


def empty(table):
    return table.filter("doc_id < -1")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# -- 1
def waterfill(sizes, cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float((1, 2, 3)[i % 3]) for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(table, rows):
    got = mixing.mix_sources(table).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(words(t))
    want = waterfill(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(words(t))) for i, t, _, _ in rows)
    by_size = {(i, len(words(t))): s for i, t, s, _ in rows}
    taken = Counter()
    for r in got:
        s = by_size[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(table.repartition(5)).collect()), key=repr)
    assert mixing.mix_sources(empty(table)).isEmpty()


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    data = [(i, " ".join(["w"] * int(rng.lognormvariate(4, 1))), f"s{i % 7}" if i % 3 else "hot") for i in range(1500)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size"))
    want = waterfill({r.source: r.size for r in got.collect()})
    for r in got.collect():
        assert r.target == pytest.approx(want[r.source]) and abs(r.taken - r.target) <= 0.02 * r.target + 5
    # rates are the exponential tilt: the mean rate of the tilted source falls or rises with size
    rates = {r.doc_id: r.copies for r in mixing.mix_sources(df).collect()}
    assert max(rates.values()) <= 3 and len(set(rates.values())) > 1


def test_tilt_is_the_entropy_optimum(spark):
    """The rates meet each target, equal those of a bisection, and no feasible change is nearer to one copy each."""
    rng = random.Random(7)
    bins = {x: [(size, rng.randint(1, 9)) for size in rng.sample(range(1, 400), 12)] for x in "abcd"}
    ratio = {"a": 0.3, "b": 1.0, "c": 2.2, "d": 2.999}
    hist = spark.createDataFrame([(x, x, size, n) for x, b in bins.items() for size, n in b], "key string, source string, size long, n long")
    words_of = {x: sum(size * n for size, n in b) for x, b in bins.items()}
    targets = spark.createDataFrame([(x, words_of[x], min(size for size, _ in b), sum(n for _, n in b), ratio[x] * words_of[x]) for x, b in bins.items()], "key string, source_size long, least long, docs long, target double")
    for r in mixing.tilt(hist, targets, 3.0).collect():
        b, t = bins[r.key], ratio[r.key] * words_of[r.key]
        rate = lambda lam: [min(3.0, math.exp(min(lam * size / r.mean, 50))) for size, _ in b]  # noqa: B023, E731
        got = lambda lam: sum(x * size * n for x, (size, n) in zip(rate(lam), b))  # noqa: B023, E731
        lo, hi = -1000.0, 1000.0
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if got((lo + hi) / 2) < t else (lo, (lo + hi) / 2)
        assert got(r.lam) == pytest.approx(t, rel=1e-6) and rate(r.lam) == pytest.approx(rate(lo), rel=1e-4)
        far = lambda x: sum(n * (y * math.log(y) - y) for y, (_, n) in zip(x, b))  # noqa: B023, E731
        best = rate(r.lam)
        for _ in range(200):  # moves that keep the words
            i, j = rng.sample(range(len(b)), 2)
            d = rng.choice([-1, 1]) * 0.01 * min(best[i], best[j])
            x = list(best)
            x[i] += d / (b[i][0] * b[i][1])
            x[j] -= d / (b[j][0] * b[j][1])
            if 0 < min(x) and max(x) <= 3:
                assert far(x) >= far(best) - 1e-7


def test_take_mix(table):
    d = table.select("doc_id", "text", "source", "lang")
    mix = mixing.take_mix(d)
    assert mix.columns == d.columns
    want = mixing.mix_sources(d).agg(F.sum("taken")).first()[0]
    got = sum(len(words(r.text)) for r in mix.collect())
    assert abs(got - want) <= 0.1 * want
    assert mixing.take_mix(d.filter("doc_id < -1")).isEmpty()


# -- 2
def pages(spark):
    big = "<p>é</p>" * 400
    rows = [(1, "http://a/ b\n", big), (2, None, big), (9, "u", big), (9, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "z" * 700_001), (8, "u", "WARC/1.1\r\n\r\n" * 200)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("bytes", F.lit("clash"))


def test_warc(spark):
    p = pages(spark)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(p).collect())
    want = Counter()
    for r in p.collect():
        raw = (r.html or "").encode()
        revisit = raw == ("<p>é</p>" * 400).encode() and r.page_id != 9
        want[r.page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None] += 1
    assert got == want
    assert warc.round_trip(p.filter("page_id < 0")).isEmpty()


def test_warc_of_many_repeated_payloads(spark):
    """As above where too many payloads repeat for a broadcast; every record has an id of its own."""
    p = pages(spark)
    rows = lambda most: Counter((r.page_id, r.url, r.digest, r.bytes, r.refers_to, r.again) for r in warc.label_revisits(p, most=most, salts=3).collect())
    assert rows(0) == rows(100_000) and sum(rows(0).values()) == 11
    folder = f"{warc.new_path(spark, 'warc-test')}"
    made = warc.write_archives(warc.label_revisits(p), folder)
    heads = [r.record_id for r in warc.read_archives(made, data=False).filter("payload_digest is not null").collect()]
    assert len(heads) == 11 == len(set(heads))


def test_warc_chunks_carry_payloads(spark, tmp_path):
    p = pages(spark)
    made = warc.write_archives(warc.label_revisits(p), f"file://{tmp_path}/w", chunk=1000)
    manifest = spark.createDataFrame(made.collect(), made.schema)
    chunks = warc.read_archives(manifest, chunk=700).collect()
    whole = {}
    for r in sorted(chunks, key=lambda r: r.chunk_no):
        assert len(r.data) <= 700
        if r.record_id == "<urn:page:7>":
            whole.setdefault(r.record_id, b"")
            whole[r.record_id] += bytes(r.data)
            assert r.bytes_so_far == len(whole[r.record_id])
    assert whole["<urn:page:7>"] == b"z" * 700_001
    assert manifest.agg(F.sum("records")).first()[0] == 11
    f = next((tmp_path / "w").iterdir())
    f.write_bytes(f.read_bytes()[:-30])
    with pytest.raises(Exception, match=r"EOF|archive ends|incomplete"):
        warc.read_archives(manifest).count()


# -- 3
def test_topk(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([0.5, -0.25, 0.0, 1.0]) for _ in range(12)]) for i in range(301)]
    rows += [(350, None), (400, [1.0, None] + [0.0] * 10), (450, [math.nan] * 12), (500, [math.inf] * 12), (None, [1.0] * 12), (7, rows[8][1]), (550, [1.0, 2.0]), (551, [3.0, 1.0]), (600, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).withColumn("uid", F.lit("clash"))
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for a, (i, v) in enumerate(sound):
        if i % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(sound) if b != a and len(w) == len(v))[:5]
            want |= {(i, k + 1, j, -x) for k, (x, j) in enumerate(s)}
    for opts in ({}, {"tile": 16, "query_tile": 2, "block": 3}):
        got = topk.exact_topk(df, **opts).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.exact_topk(df.filter("vec_id < 0")).isEmpty()


def test_topk_of_large_numbers(spark):
    """Scores beyond what doubles hold exactly are whole; what might not fit 64 bits is an error."""
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-(10**6), 10**6)) + rng.choice([0.0, 0.25]) for _ in range(9)]) for i in range(120)]
    rows += [(200 + i, [x + rng.choice([0.0, 1 / 256]) for x in rows[0][1]]) for i in range(30)]  # scores that differ in their last digits
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = set()
    for i, v in whole:
        if i % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(v, w)), j) for j, w in whole if j != i)[:5]
            want |= {(i, k + 1, j, -x) for k, (x, j) in enumerate(s)}
    assert max(x for *_, x in want) > 1 << 53
    for opts in ({}, {"tile": 16, "query_tile": 2, "block": 4}):
        assert {tuple(r) for r in topk.exact_topk(df, **opts).collect()} == want
    for big in (1e18, 1e200, 1e308):
        with pytest.raises(OverflowError):
            topk.exact_topk(spark.createDataFrame([(0, [big, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>"))


# -- 4
def test_bpe(table, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD_BPE)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in bpe.encode_decode(table, WORD_BPE, with_ids=True, group_chars=500).collect())
    want = Counter()
    for i, t, _, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), tuple(ids)] += 1
    assert got == want
    assert bpe.encode_decode(empty(table), WORD_BPE).isEmpty()


def test_bpe_random_texts_and_small_cache():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(WORD_BPE), bpe.PairIndexBpe(WORD_BPE, most_cached=50)
    rng = random.Random(0)
    alphabet = "aabbcdefgh  ÀéßñΏ̧日<|>'1²\t\x1f İΣ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["ab" * 2000, "don't WE'LL <|endoftext|>x"]
    for at in range(0, len(texts), 40):
        for t, (n, ids, text, _) in zip(texts[at : at + 40], own.encode_texts(texts[at : at + 40])):
            e = lib.encode(t, add_special_tokens=False).ids
            assert (n, ids, text) == (len(e), " ".join(map(str, e)), lib.decode(e, skip_special_tokens=False)), t


# -- 5
def slow_fingerprint(t):
    w = words(lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, pairs):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in pairs:
        at[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_simhash(table, rows):
    fp = [slow_fingerprint(t) if t is None or len(t) < 10000 else simhash.fingerprint(t) for _, t, _, _ in rows]
    root = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4])
    least = {}
    for (i, *_), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = Counter((i, f"{f:016x}", least.get(r)) for (i, *_), f, r in zip(rows, fp, root))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table).collect()) == want
    assert simhash.near_duplicates(empty(table)).isEmpty()


def test_simhash_links_are_complete(spark):
    """Chains and dense groups at every distance up to four, against all pairs."""
    rng = random.Random(2)
    fps = set()
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([2, 6, 25])):
            fps.add(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 4, 5])):
                f ^= 1 << b
    base = rng.getrandbits(64)
    for _ in range(150):
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), 2)))
    fps = sorted(fps)
    root = union(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    hot = [((f >> shift) & ((1 << width) - 1) & ~(1 << bit)) + ((shift + bit) << 32) for f in (base, fps[3], fps[40]) for shift, width in simhash.SEGMENTS for bit in range(0, width, 2)]
    for rounds, keys in ((0, []), (3, None), (0, hot), (3, hot)):
        got = {r.fp % (1 << 64): r.root for r in simhash.link(nodes, rounds=rounds, hot=keys, block=7).collect()}
        assert len({(root[i], got[f]) for i, f in enumerate(fps)}) == len(set(root)) == len(set(got.values()))


def test_keep_one(table):
    d = table.select("doc_id", "text", "source", "lang")
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    n = simhash.near_duplicates(d).select("component_root").distinct().count()
    assert kept.count() == n


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500)]
    df = spark.createDataFrame(pairs, "a long, b long")
    root = union(600, pairs)
    least = {}
    for i in range(600):
        least.setdefault(root[i], i)
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {x: least[root[x]] for x in nodes}
    assert components(df.filter("a < 0")).isEmpty()


# -- 6
def test_langid(spark, table):
    base = {"en": "the cat and the dog were there with the others in that house ", "de": "der hund und die katze waren dort mit den anderen in dem haus ", "es": "el perro y el gato estaban allí con los otros en esa casa "}
    rng = random.Random(3)
    rows = []
    for i in range(240):
        lang = rng.choice(list(base))
        w = base[lang].split()
        rows.append((i, " ".join(rng.choice(w) for _ in range(40)), lang))
    rows += [(1000, None, "en"), (1001, "123 456", "en"), (1002, base["de"] * 30 + base["es"] * 10, None), (None, base["es"] * 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    for i, t, lang in rows[:240]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].lang_pred == lang and 0 <= got[i].score <= 1
    assert got[1000].lang_pred == got[1001].lang_pred == "und"
    assert got[1002].lang_pred == "de" and set(got[1002].languages) == {"de", "es"} and 0.6 < got[1002].score < 0.9
    assert got[None].lang_pred == "es"
    assert langid.identify(empty(table)).isEmpty()
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(table).count() == table.count()


def slow_infer(text, counts, langs):
    """EM and the choice of languages by their definitions, a trigram at a time."""
    grams = Counter(langid.trigrams(text).tolist())
    n = sum(grams.values())
    total = {x: sum(counts[x].values()) for x in langs}
    p = {x: {g: (counts[x][g] + 0.5) / (total[x] + 0.5 * langid.BUCKETS) for g in grams} for x in langs}

    def fit(share):
        for _ in range(50):
            new = dict.fromkeys(share, 0.0)
            for g, c in grams.items():
                whole = sum(share[x] * p[x][g] for x in share)
                for x in share:
                    new[x] += c * share[x] * p[x][g] / whole / n
            done = max(abs(new[x] - share[x]) for x in share) < 1e-4
            share = new
            if done:
                break
        return share, sum(c * math.log(sum(share[x] * p[x][g] for x in share)) for g, c in grams.items())

    share, best = fit({x: 1 / len(langs) for x in langs})
    while len(share) > 1:
        least = min(share, key=lambda x: (share[x], x))
        rest = {x: y for x, y in share.items() if x != least}
        less, worse = fit({x: y / sum(rest.values()) for x, y in rest.items()})
        if worse < best - 0.5 * math.log(n + 1):
            break
        share, best = less, worse
    return share


def test_langid_against_brute_force(spark):
    rng = random.Random(12)
    vocabulary = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(40)] for x, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "klmnopqr"))}
    text = lambda *langs: " ".join(rng.choice(vocabulary[x]) for x in langs for _ in range(rng.randint(3, 30)))
    rows = [(i, text(x), x) for i, x in enumerate("aa bb cc".split() * 20)] + [(100 + i, text(*rng.sample(sorted(vocabulary), 2)), None) for i in range(30)] + [(200 + i, text(*sorted(vocabulary)), None) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {x: Counter(g for i, t, y in rows if y == x and zlib.crc32(str(i).encode()) % 4 != 2 for g in langid.trigrams(t).tolist()) for x in vocabulary}
    for r in langid.identify(df).collect():
        want = slow_infer(next(t for i, t, _ in rows if i == r.doc_id), counts, sorted(vocabulary))
        assert set(r.languages) == set(want) and r.lang_pred == max(sorted(want), key=want.get) and r.score == pytest.approx(max(want.values()), abs=1e-6)
    with pytest.raises(langid.TooManyLanguages):
        langid.identify(spark.range(600).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.col("id").cast("string").alias("lang")))


# -- 7
def test_rans(table, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE_BPE)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, Counter()
    for i, t, _, _ in order:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), tuple(ids)] += 1
        at += len(ids)
    got = rans.round_trip(table, BYTE_BPE, with_ids=True)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in got.collect()) == want
    assert rans.round_trip(empty(table), BYTE_BPE).isEmpty()


def test_rans_coder():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1023, 2048, 2049, 50_000):
        ids = (rng.zipf(1.2, n) % 50_000).astype(np.uint16)
        coder = rans.Coder(rans.frequencies(np.bincount(ids)))
        raw = rans.pack_block(coder, ids, np.arange(2), np.zeros(2, np.uint8), np.array([n - 1, 1]))
        assert (rans.unpack_block(coder, raw)[0] == ids).all()
        with pytest.raises(ValueError):
            rans.unpack_block(coder, raw[:-1] + bytes([raw[-1] ^ 1]))
    assert rans.frequencies(np.ones(60_000, np.int64)).sum() == 1 << rans.BITS
    with pytest.raises(ValueError):
        rans.frequencies(np.ones((1 << rans.BITS) + 1, np.int64))
    skewed = rans.frequencies(np.concatenate([[10**12], np.ones(50_000, np.int64)]))
    assert skewed.sum() == 1 << rans.BITS and skewed.min() == 1


def test_rans_encoder():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(BYTE_BPE), rans.BatchEncoder(BYTE_BPE)
    rng = random.Random(1)
    texts = ["", " ", "a", " a", "a ", "a  b", "x\ny z", "\na b", "a\n", "a b\n\nc", "x a.\nB, c.\nD", "<|endoftext|>hi", "a b", "a 　", "don't you'll a.\n b"]
    texts += ["".join(rng.choice("ab é1.,'\n  st<|") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    small = rans.BatchEncoder(BYTE_BPE, most_held=100)
    for enc, step in ((own, 5000), (own, 400), (small, 300)):  # what is remembered, and what no longer fits
        for at in range(0, len(texts), step):
            for t, ids in zip(texts[at : at + step], enc.encode(texts[at : at + step])):
                assert ids == lib.encode(t, add_special_tokens=False).ids, repr(t)
    assert own.encode([]) == []


# -- 8
def brute_base(rows):
    train = [(i, t) for i, t, *_ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    c = Counter(w for _, t in train for w in words(lower(t)))
    return c, sum(c.values()) + len(train), len(c) + 1, len(train)


@pytest.mark.parametrize("block, pairs", [(1500, 40), (hmm.BLOCK, hmm.PAIRS)])
def test_hmm(spark, table, rows, block, pairs):
    got = hmm.score_texts(table, block=block, pairs=pairs, states=3, passes=2).collect()
    every = [r for r in rows]
    train = [(i, t) for i, t, *_ in every if zlib.crc32(str(i or "" if i is None else i).encode()) % 10]
    c = Counter(w for _, t in train for w in words(lower(t)))
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = Counter()
    for i, t, *_ in every:
        cs = [c[w] for w in words(lower(t))] + [len(train)]
        want[i, zlib.crc32(str("" if i is None else i).encode()) % 10 == 0, len(cs), sum(x > 0 for x in cs), n, round(sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in cs), 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert hmm.score_texts(empty(table)).isEmpty()


def test_hmm_states_learn_every_word(spark):
    """Two topics of words: order within a topic is likelier than a mix of both."""
    rng = random.Random(4)
    topic = lambda k: " ".join(f"t{k}w{rng.randint(0, 40)}" for _ in range(60))
    texts = [topic(i % 2) for i in range(300)]
    a, b = topic(0).split(), topic(1).split()
    mixed = [x for pair in zip(a, b) for x in pair]
    texts += [" ".join(a + b), " ".join(mixed)]
    ids = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 10][:300] + [i for i in range(5000, 9000) if not zlib.crc32(str(i).encode()) % 10][:2]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in hmm.score_texts(df, states=2, passes=8).collect()}
    assert got[ids[-2]] > got[ids[-1]] + 1
    # how words are dealt to blocks and parts changes nothing
    cut = {r.doc_id: r.score for r in hmm.score_texts(df.repartition(3), states=2, passes=8, block=3000, pairs=20).collect()}
    assert cut == pytest.approx(got, rel=1e-3)


def slow_hmm(rows, states, passes):
    """Baum-Welch over the full vocabulary, one text and one word at a time, in double precision."""
    seq = [[*words(lower(t)), ""] for _, t, *_ in rows]
    train = [x for x, (i, *_) in zip(seq, rows) if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    c = Counter(w for x in train for w in x)
    n = sum(c.values())
    share = {w: (z := hmm.noise(np.array([xxhash.xxh64_intdigest(w)], np.uint64), states)[0]) / z.sum() for w in c}
    start, move = np.full(states, 1 / states), np.full((states, states), 0.05 / (states - 1)) + (0.95 - 0.05 / (states - 1)) * np.eye(states)

    def emit(w):
        totals = sum(c[x] * share[x] for x in c)
        return (c[w] * share.get(w, 0) + hmm.PRIOR * (c[w] or hmm.ADD) / (n + hmm.ADD)) / (totals + hmm.PRIOR)

    def forward(x, e):
        a = [start * e[x[0]]]
        for w in x[1:]:
            a.append(a[-1] @ move * e[w])
        return np.array(a)

    every = {w for x in seq for w in x}
    for _ in range(passes):
        e = {w: emit(w) for w in every}
        s, m, k = np.zeros(states), np.zeros((states, states)), {w: np.zeros(states) for w in c}
        for x in train:
            a, b = forward(x, e), [np.ones(states)]
            for w in x[:0:-1]:
                b.insert(0, move @ (e[w] * b[0]))
            p = a[-1].sum()
            for t, w in enumerate(x):
                k[w] += a[t] * b[t] / p
                if t:
                    m += np.outer(a[t - 1], e[w] * b[t]) * move / p
            s += a[0] * b[0] / p
        share = {w: k[w] / c[w] for w in c}
        start, move = (s + 0.1) / (s + 0.1).sum(), (m + 0.1) / (m + 0.1).sum(1, keepdims=True)
    e = {w: emit(w) for w in every}
    return [math.log10(forward(x, e)[-1].sum()) for x in seq]


def test_hmm_against_brute_force(spark):
    """Whole scores, words that occur once included, with words dealt to many blocks and parts, and messages held for a few steps at a time."""
    rng = random.Random(6)
    texts = [None, "", "once"] + [" ".join(rng.choice("a b c d e f") + (str(rng.randint(0, 400)) if rng.random() < 0.3 else "") for _ in range(rng.randint(1, 45))) for _ in range(70)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = dict(enumerate(slow_hmm(rows, 3, 3)))
    for opts in ({}, {"block": 300, "pairs": 30, "cells": 16}):
        got = {r.doc_id: r.score for r in hmm.score_texts(df, states=3, passes=3, **opts).collect()}
        assert got == pytest.approx(want, rel=2e-3)


def test_hmm_learns_from_whole_texts(spark):
    """A text starts once: batches hold texts whole, and each adds one start and its length less one of moves."""
    texts = [np.arange(n, dtype=np.uint32) % 5 for n in (1, 700, 3, 2000, 300, 257)]
    got = [(obs, sizes) for obs, sizes in hmm.batches_of(texts, 2500)]
    assert sorted(n for _, sizes in got for n in sizes) == sorted(map(len, texts)) and len(got) > 1
    assert all((obs[:n, k] == np.arange(n) % 5).all() for obs, sizes in got for k, n in enumerate(sizes))
    m = hmm.Hmm.begin(np.full(5, 0.2), 3)
    counts = [m.expect(obs, sizes) for obs, sizes in got]
    assert sum(c[0].sum() for c in counts) == pytest.approx(len(texts), rel=1e-4)
    assert sum(c[1].sum() for c in counts) == pytest.approx(sum(len(x) - 1 for x in texts), rel=1e-4)


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    m = hmm.Hmm(rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.dirichlet(np.ones(4), 2).T)
    from itertools import product

    seqs = [rng.integers(0, 4, n).astype(np.uint16) for n in (1, 3, 6, 2)]
    for seq, got in zip(seqs, m.score(seqs)):
        total = sum(m.start[z[0]] * np.prod([m.move[a, b] for a, b in zip(z, z[1:])]) * np.prod([m.emit[o, s] for o, s in zip(seq, z)]) for z in product(range(2), repeat=len(seq)))
        assert got == pytest.approx(math.log(total))
    # all sequences of one length have probability one together
    assert sum(np.exp(m.score([np.array(s, np.uint16) for s in product(range(4), repeat=3)]))) == pytest.approx(1)


def test_baum_welch_climbs():
    rng = np.random.default_rng(2)
    seqs = [np.array([(k + j) % 6 if rng.random() < 0.9 else rng.integers(0, 6) for j in range(40)], np.uint16) for k in range(30)]
    uni = np.bincount(np.concatenate(seqs), minlength=6) / 1200
    m, last = hmm.Hmm.begin(uni, 3), -1e9
    for _ in range(6):
        now = m.score(seqs).sum()
        assert now >= last - 1e-2 * abs(now)
        last = now
        m = hmm.Hmm.of(*m.expect(np.stack(seqs, 1), np.array([40] * 30)), uni)
    assert last > 1200 * (uni * np.log(uni)).sum()


# -- 9
def test_quality(table, rows):
    got = {}
    for r in quality.score_quality(table, clean=True).collect():
        got.setdefault(r.doc_id, r)
    for i, t, *_ in rows:
        r, w = got[i], words(t)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert got[10].clean_text == "line one is here.\nline two is there."
    assert quality.score_quality(empty(table)).isEmpty()
    kept = quality.keep_good(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_quality_verdict():
    prose = "This is a calm sentence about nothing in particular, and it ends well.\n"
    assert quality.judge(prose * 1 + "Another line that says something else entirely, as lines do.")[6]
    menu = "\n".join(f"Home | News | About {i} | Contact" for i in range(9))
    assert not quality.judge(prose + menu)[6] and quality.judge(prose + menu)[7] == prose.rstrip("\n")


# -- 10
def brute_repeats(rows):
    order = sorted((i, t) for i, t, *_ in rows if i is not None)
    first = {}
    for i, t in order:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < i:
                    gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()] += 1
    return out


def repeating(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh é\0") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(4)] + ["ab" * 60, "\0" * 80, "z" * 120]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 25)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(20, len(p))], word()]
        rows.append((i, " ".join(parts), "s", "en"))
    rows += [(i + 200, rows[i][1], "s", "en") for i in range(0, 40, 3)] + [(5, rows[60][1], "s", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), rows


@pytest.mark.parametrize("hot, block, part", [(4096, suffix.BLOCK, suffix.PART), (2, suffix.BLOCK, suffix.PART), (4096, 1500, 900), (2, 1500, 900)])
def test_suffix(spark, table, rows, hot, block, part):
    for df, data in ((table, rows), repeating(spark)):
        got = Counter(tuple(r) for r in suffix.find_repeats(df, hot=hot, block=block, part=part).collect())
        assert got == brute_repeats(data)
    assert suffix.find_repeats(empty(table)).isEmpty()


def test_remove_repeats(spark, table):
    d = table.select("doc_id", "text", "source", "lang", F.char_length("text").alias("n_chars"))
    out = suffix.remove_repeats(d)
    assert out.columns == d.columns and out.count() == d.count()
    by_id = {r.doc_id: r for r in out.filter("doc_id is not null").collect()}
    assert by_id[0].text is None and by_id[1].text == "" and by_id[12].text == LONG and by_id[6].n_chars == len(by_id[6].text)


def test_difference_cover():
    rng = random.Random(3)
    for _ in range(300):
        s = np.array([rng.randint(0, rng.choice([1, 2, 255])) for _ in range(rng.randint(0, 50))], np.int64)
        assert suffix.dc3(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_rows_of_a_block_follow_its_grams():
    """A block sends one row for each part that its grams fall into, in order, however many parts there are."""
    grams = np.unique(np.random.default_rng(5).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    for parts in (1, 255, 15_000, 1 << 30):
        where = suffix.deal(grams, parts)
        sent = suffix.runs(where)
        assert 0 <= where.min() and where.max() < parts and len(sent) <= min(parts, len(grams))
        assert [x for _, a, b in sent for x in range(a, b)] == list(range(len(grams))) and all((where[a:b] == p).all() for p, a, b in sent)
    assert suffix.runs(np.zeros(0, np.int64)) == []


def test_same_bytes():
    data = np.frombuffer(b"x" * 30 + b"abcdefghijk" * 3 + b"abcdefghijk" * 2 + b"abcdefghijK" + b"tail" * 5, np.uint8)
    got = suffix.same_bytes(suffix._windows(data), np.array([30, 30, 30, 0]), np.array([63, 63, 74, 1]), np.array([33, 32, 22, 29]))
    assert got.tolist() == [False, True, False, True]


def test_least_owner():
    rng = random.Random(8)
    data = np.array([rng.choice(b"ab") for _ in range(50)] * 4 + [rng.randint(97, 99) for _ in range(300)], np.uint8)
    starts = np.array(sorted(rng.sample(range(len(data) - 50), 200)))
    owner = np.array([rng.randint(0, 9) for _ in starts])
    got = suffix.least_owner(data, starts, owner)
    for k, s in enumerate(starts):
        assert got[k] == min(o for t, o in zip(starts, owner) if (data[t : t + 50] == data[s : s + 50]).all())


def test_token_files_are_read_by_their_own_table(spark, tmp_path):
    freq = rans.frequencies(np.array([5, 0, 90, 1]))
    path = rans.write_table(freq, f"file://{tmp_path}/t")
    assert (rans.read_table(path) == freq).all()
    raw = open(path, "rb").read()
    open(path, "wb").write(raw[:-1] + bytes([raw[-1] ^ 1]))
    with pytest.raises(ValueError):
        rans.read_table(path)


def test_arrow_slices_of_text():
    """Encoders read columns that are slices of longer ones."""
    col = pa.array(["skip", "a b", "c\nd", "skip"]).slice(1, 2)
    enc = rans.BatchEncoder(BYTE_BPE)
    batch = enc.compile(col)
    assert np.split(batch.tokens(0, 2), np.cumsum(batch.counts)[:-1])[1].tolist() == enc.encode(["c\nd"])[0]


def test_rans_encoder_is_loaded_once_a_worker(table, monkeypatch):
    """Tasks are pickled apart from each other, and yet share what their worker has loaded and remembers."""
    monkeypatch.setattr(type(table), "mapInArrow", lambda self, f, schema: f)
    run, loads, init = rans.token_blocks(table, BYTE_BPE, 2, "doc_id", "text"), [], rans.BatchEncoder.__init__
    monkeypatch.setattr(rans, "_loaded", {})
    monkeypatch.setattr(rans.BatchEncoder, "__init__", lambda self, path: (loads.append(path), init(self, path))[1])
    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch, raw = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b", "c"])], ["doc_id", "text"]), cloudpickle.dumps(run)
    got = [list(cloudpickle.loads(raw)(iter([batch])))[0].column("tokens")[0].as_py() for _ in range(3)]
    assert loads == [BYTE_BPE] and got[0] == got[1] == got[2]


def test_rans_lookup_takes_memory_by_the_batch():
    enc = rans.BatchEncoder(BYTE_BPE)
    held = pa.array([f" word{i}" for i in range(400_000)])
    enc.held = (held, np.zeros(400_000, enc.dtype), np.ones(400_000, np.int64))
    before, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    try:
        flat, sizes, which = enc._recall(pa.array([" new", " word7", " other"]))
    finally:
        pa.set_memory_pool(before)
    assert which.tolist() == [400_000, 7, 400_001] and pool.max_memory() < 12e6


def test_rans_blocks_are_spilled_in_small_row_groups(spark, tmp_path):
    blocks = spark.range(0, 80, 1, 1).select("id", F.expr("to_binary(repeat(sha2(cast(id as string), 512), 4000), 'hex')").alias("tokens"))
    back = spill_to(blocks, f"file://{tmp_path}/b", "lz4", rans.SPILL)
    (name,) = tmp_path.glob("b/*.parquet")
    meta = pq.ParquetFile(name).metadata
    assert max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 10e6
    assert back.select(F.sum(F.length("tokens"))).first()[0] == 80 * 256_000
