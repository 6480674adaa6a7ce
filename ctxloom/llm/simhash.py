"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments; of two fingerprints that differ in at most four bits,
one segment differs in at most one. So each fingerprint is indexed under every segment with one bit
wild (64 keys), equal keys meet in equality joins, and the full distance is verified. Links inside a
bucket are found without listing all pairs of a group: every member is held against a few hubs of its
bucket, which joins what is dense; then, exactly, the members outside their bucket's largest component are
held against the rest of the bucket. Keys that many rows have (a bucket's, a component's, a fingerprint's) are
joined to a broadcast of fewer than a thousand rows, and such buckets are cut into blocks.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_split, often, spill
from .graph import components

#: (shift, width) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 of all word shingles; fewer words make one shingle, none give 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    h, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    last = ends[width - 1 :] if len(words) >= width else [len(flat) + 1]
    for at in range(0, len(last), 1 << 16):
        part = np.array([h(flat[s : e - 1], seed) for s, e in zip(starts[at : at + (1 << 16)], last[at : at + (1 << 16)])], ">u8")
        total += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(last)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp) of each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width, seed) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _variants(fp: F.Column) -> F.Column:
    keys = []
    for shift, width in SEGMENTS:
        part = F.shiftrightunsigned(fp, shift)
        for bit in range(width):
            keys.append(part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit))) + F.lit((shift + bit) << 32))
    return F.explode(F.array(*keys))


def _hot_keys(nodes: DataFrame, part: int = 16) -> list:
    """Keys that over a thousandth of all variants have, as far as every part-th fingerprint shows: they are joined in
    another way, with the same result."""
    some = nodes.filter(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(part)) == 0).select(_variants(F.col("fp")).alias("key"))
    counts = some.groupBy("key").agg((F.count(F.lit(1)) * part).alias("n"))
    return often(counts, "key", nodes.count() * 64)


def link(nodes: DataFrame, most: int = 4, rounds: int = 3, block: int = 1000, hot: list | None = None) -> DataFrame:
    """(fp, root) for every distinct fingerprint: the components of all pairs that differ in at most most bits (4 or fewer)."""
    if not 0 <= most <= 4:
        raise ValueError("three segments serve distances up to 4")
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= most
    hot = _hot_keys(nodes) if hot is None else hot
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    roots = nodes.select("fp", F.col("fp").alias("root"))
    # each member of a bucket against a few hubs: a group of copies falls together without a comparison of all its pairs
    if rounds:
        every = nodes.select("fp", _variants(F.col("fp")).alias("key"))
        names = [f"h{i}" for i in range(rounds)]
        order = lambda i: F.xxhash64("fp", F.lit(i)) if i else F.col("fp")
        hubs = every.groupBy("key").agg(*[F.min(F.struct(order(i).alias("o"), "fp"))["fp"].alias(n) for i, n in enumerate(names)], F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", *names)
        # verified inside the join: chance meetings never become rows; by a merge, as hubs grow with the corpus and are not to be gathered
        at = lambda left, right: left.join(right.withColumnRenamed("key", "hub_key"), (F.col("key") == F.col("hub_key")) & _any([(F.col(n) != F.col("fp")) & near("fp", n) for n in names]))
        found = at(every.filter(~is_hot), hubs.filter(~is_hot).hint("merge")).unionByName(at(every.filter(is_hot), F.broadcast(hubs.filter(is_hot)))) if hot else at(every, hubs.hint("merge"))
        edges = found.select(F.col("fp").alias("a"), F.explode(F.array(*[F.when((F.col(n) != F.col("fp")) & near("fp", n), F.col(n)) for n in names])).alias("b")).filter("b is not null")
        roots = _merge(roots, edges)
    # what is still apart, exactly: members outside their bucket's largest component against the bucket
    every = roots.select("fp", "root", _variants(F.col("fp")).alias("key"))
    bucket, part = Window.partitionBy("key"), Window.partitionBy("key", "root")
    apart = every.filter(~is_hot).withColumn("n", F.count(F.lit(1)).over(part)).withColumn("main", F.max(F.struct("n", "root")).over(bucket)["root"])
    apart = apart.withColumn("least", F.min("root").over(bucket)).withColumn("largest", F.max("root").over(bucket)).filter("least <> largest")
    x = apart.filter("root <> main").select("key", F.col("fp").alias("xf"), F.col("root").alias("xr"))
    y = apart.select(F.col("key").alias("y_key"), F.col("fp").alias("yf"), F.col("root").alias("yr"), (F.col("root") == F.col("main")).alias("ym"))
    on = (F.col("key") == F.col("y_key")) & (F.col("xr") != F.col("yr")) & (F.col("ym") | (F.col("xf") < F.col("yf"))) & near("xf", "yf")
    edges = x.join(y.hint("merge"), on).select(F.col("xr").alias("a"), F.col("yr").alias("b"))
    if hot:
        # the same for hot keys, whose members are counted by root before they meet, and meet in blocks
        every = every.filter(is_hot)
        sizes = every.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
        mixed = sizes.groupBy("key").agg(F.max(F.struct("m", "root"))["root"].alias("main"), F.ceil(F.sum("m") / block).alias("blocks"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts")
        apart = every.join(F.broadcast(mixed), "key")
        x = apart.filter("root <> main").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("fp").alias("xf"), F.col("root").alias("xr"))
        y = apart.select(F.col("key").alias("y_key"), F.pmod(F.xxhash64("fp"), "blocks").alias("y_block"), F.col("fp").alias("yf"), F.col("root").alias("yr"), (F.col("root") == F.col("main")).alias("ym"))
        edges = edges.unionByName(x.join(y, on & (F.col("block") == F.col("y_block"))).select(F.col("xr").alias("a"), F.col("yr").alias("b")))
    return _merge(roots, edges)


def _any(conditions: list) -> F.Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _merge(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots after joining the components that edges between roots connect."""
    found = spill(components(edges).select(F.col("node").alias("root"), F.col("root").alias("top")), "simhash-merge")
    sizes = roots.join(found.select("root"), "root", "left_semi").groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    joined = join_split(roots, found, "root", often(sizes, "root", roots.count()), "left")
    return spill(joined.select("fp", F.coalesce("top", "root").alias("root")), "simhash-roots")


def near_duplicates(docs: DataFrame, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id reachable over links of at most most differing bits. Null and
    wordless texts have fingerprint zero and link like others; a null id takes part but is never the
    least unless all of its component are null; repeated rows each get their row. An empty table gives
    an empty result. Other columns are not read.
    """
    rows = spill(fingerprints(docs, id_col, text_col), "simhash-rows")
    nodes = spill(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "simhash-nodes")
    rooted = spill(nodes.join(link(nodes, most), "fp"), "simhash-rooted")
    ids = spill(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-ids")
    by_fp = join_split(rooted.select("fp", "root", "copies"), ids.drop("n"), "root", often(ids, "root", rooted.count()))
    copies = often(nodes.select("fp", F.col("copies").alias("n")), "fp", rows.count())
    return join_split(rows, by_fp.select("fp", "root", "component_id"), "fp", copies).select("doc_id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("root").alias("component_root"))


def keep_one(docs: DataFrame, most: int = 4) -> DataFrame:
    """The rows of docs that stay when each group of near-duplicates keeps the one with the least
    doc_id (null last; then by a hash of the text). Of repeated rows that tie in both, one stays.

    Null and wordless texts are one group (and link to fingerprints near zero), as in near_duplicates. An
    empty table gives an empty result. Columns, their order and types are those of docs, whatever their names."""
    found = near_duplicates(docs, most)
    least = found.groupBy("component_root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
    keep = spill(least.select(F.col("k.doc_id").alias("keep_id"), F.col("k.text_hash").alias("keep_hash")), "simhash-keep")
    # the columns travel as one struct, so that no name of theirs clashes
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    stay = rows.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_hash")), "left_semi")
    return stay.dropDuplicates(["id", "h"]).select("row.*")
