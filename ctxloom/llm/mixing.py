"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Every document of source s gets the rate min(cap, exp(lambda_s * size / mean size of s)): the
exponential tilt that stays nearest to one copy each while the source's expected words meet its
target. The lambdas solve the convex dual, one distributed aggregate for each guarded Newton step.
Rates then become whole copies: cumulative rounding from long to short documents, and a few
rounds that move the rest of a source's error to the longest documents that fit it.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, spill


def word_count(col) -> F.Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_targets(hist: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Targets by source: weights repeat by code point (null last); what exceeds cap times a source's
    size is shared again by weight. One row for each source, so that the unpartitioned windows see
    sources, not documents."""
    src = hist.groupBy("key", "source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
        F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs"),
    )
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    src = src.withColumn("w", w).withColumn("ratio", cap * F.col("source_size") / F.col("w"))
    order = Window.orderBy("ratio", "key")
    before = F.coalesce(F.sum(cap * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
    level = F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "key"))).over(everything)
    target = F.least(cap * F.col("source_size"), F.coalesce(level, F.lit(math.inf)) * F.col("w"))
    return src.withColumn("t", target).select("key", "source_size", "least", "docs", F.col("t").cast("double").alias("target"))


class NotBalanced(ArithmeticError):
    """The dual was not solved in the steps allowed."""


def tilt(hist: DataFrame, targets: DataFrame, cap: float, steps: int = 200, tolerance: float = 1e-7) -> DataFrame:
    """Newton's method on the dual, kept inside a bracket by source; every step is one aggregate over
    (source, size) bins. Returns key, mean, lam. A source is done when its words meet its target, or when its
    bracket is as narrow as numbers are; not to be done after all steps is an error."""
    mean = F.col("source_size") / F.greatest(F.col("docs"), F.lit(1))
    hi = math.log(cap) * F.col("mean") / F.col("least")
    lo = F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size"))) * F.col("mean") / F.col("least")
    state = (
        targets.filter("source_size > 0 and target > 0").withColumn("mean", mean)
        .select("key", "source_size", "target", "mean", (lo - 1).alias("lo"), (hi + 1e-9).alias("hi"), F.lit(0.0).alias("lam"), F.lit(math.inf).alias("err"))
    )
    state = spill(state, "mix-state")
    for _ in range(steps):
        u = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("lam") * u, F.lit(math.log(cap) + 1)))
        words = F.col("n") * F.col("size")
        sums = hist.filter("size > 0").join(state, "key").groupBy("key", "source_size", "target", "mean", "lo", "hi", "lam").agg(
            F.sum(words * F.least(raw, F.lit(cap))).alias("got"),
            F.sum(F.when(raw < cap, words * u * raw).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("got") - F.col("target")
        sums = sums.withColumn("gap", gap).withColumn("lo", F.when(F.col("gap") <= 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("gap") >= 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.col("gap") / F.when(F.col("slope") > 0, F.col("slope"))
        middle = (F.col("lo") + F.col("hi")) / 2
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        narrow = F.col("hi") - F.col("lo") <= 1e-13 * F.greatest(F.abs("lo"), F.abs("hi"))
        err = F.when(narrow, 0.0).otherwise(F.abs(F.col("gap")) / F.greatest(F.col("target"), F.lit(1.0)))
        done = err <= tolerance
        state = spill(sums.select("key", "source_size", "target", "mean", "lo", "hi", F.when(done, F.col("lam")).when(inside, newton).otherwise(middle).alias("lam"), err.alias("err")), "mix-state")
        if (state.agg(F.max("err")).first()[0] or 0.0) <= tolerance:
            return state.select("key", "mean", "lam")
    raise NotBalanced(f"after {steps} steps some source is off its target")


def round_copies(hist: DataFrame, targets: DataFrame, lam: DataFrame, cap: int, rounds: int = 64) -> DataFrame:
    """Whole copies for each (source, size) bin. The rest of each source's error goes to its longest documents that
    fit it, round by round until none fits or it is gone; rounds bounds them, and what is left then is less
    than the shortest document that was moved last."""
    rate = F.coalesce(F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(cap) + 1))), F.lit(float(cap))), F.lit(0.0))
    bins = hist.join(lam, "key", "left").select("key", "size", "n", (F.col("n") * rate).alias("x"), F.floor(F.sqrt("size")).alias("b"))
    # prefix sums in two levels, so that no window holds more than about the square root of a source's sizes
    upper = bins.groupBy("key", "b").agg(F.sum("x").alias("bx"))
    upper = upper.withColumn("before", F.coalesce(F.sum("bx").over(Window.partitionBy("key").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    bins = bins.join(upper.select("key", "b", "before"), ["key", "b"])
    inner = Window.partitionBy("key", "b").orderBy(F.desc("size"))
    upto = F.col("before") + F.sum("x").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    prior = F.col("before") + F.coalesce(F.sum("x").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    k = F.floor(upto + 0.5) - F.floor(prior + 0.5)
    bins = spill(bins.select("key", "size", "n", F.least(F.greatest(k, F.lit(0)), cap * F.col("n")).cast("long").alias("k")), "mix-bins")
    for _ in range(rounds):
        off = bins.groupBy("key").agg(F.sum(F.col("k") * F.col("size")).alias("got")).join(targets.select("key", "target"), "key")
        off = off.select("key", (F.col("target") - F.col("got")).alias("off"))
        room = F.when(F.col("off") > 0, cap * F.col("n") - F.col("k")).otherwise(F.col("k"))
        fit = bins.join(off, "key").filter((F.col("size") > 0) & (F.col("size") <= F.abs("off")) & (room > 0))
        pick = fit.groupBy("key").agg(F.max(F.struct("size", F.least(room, F.floor(F.abs("off") / F.col("size"))).alias("c"), F.signum("off").alias("sign"))).alias("p"))
        pick = spill(pick.select("key", F.col("p.size").alias("size"), (F.col("p.c") * F.col("p.sign")).cast("long").alias("d")).filter("d <> 0"), "mix-picks")
        if pick.isEmpty():
            break
        bins = spill(bins.join(pick, ["key", "size"], "left").select("key", "size", "n", (F.col("k") + F.coalesce("d", F.lit(0))).alias("k")), "mix-bins")
    return bins


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, copies.

    Null text has size 0; a null source is a source of its own, last in order; a null or repeated id
    is a row like others (rows alike in source, size and id may exchange their copies). Size 0 takes
    nothing. Documents of a source and size share its copies evenly, ties by a hash of the id. A text of any
    length counts by its words alone. An empty table gives an empty result. Other columns are not read.
    """
    return _mix(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), weights, cap)


def _mix(sized: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    sized = spill(sized.withColumn("key", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))), "mix-sized")
    hist = spill(sized.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    targets = spill(source_targets(hist, weights, float(cap)), "mix-targets")
    bins = round_copies(hist, targets, tilt(hist, targets, float(cap)), cap)
    # documents of a bin share its copies evenly; who gets one more goes by a hash of the id, ranked in
    # two levels so that a bin of any number of documents is spread over many groups
    h = F.xxhash64("doc_id")
    rows = sized.join(bins, ["key", "size"]).withColumn("h", h).withColumn("sub", F.pmod(h, F.ceil(F.sqrt("n"))))
    subs = rows.groupBy("key", "size", "sub").agg(F.count(F.lit(1)).alias("m"))
    subs = subs.withColumn("first", F.coalesce(F.sum("m").over(Window.partitionBy("key", "size").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(subs.select("key", "size", "sub", "first"), ["key", "size", "sub"])
    rank = F.col("first") + F.row_number().over(Window.partitionBy("key", "size", "sub").orderBy("h", "doc_id")) - 1
    base = F.floor(F.col("k") / F.col("n"))
    rows = rows.withColumn("copies", (base + F.when(rank < F.col("k") - base * F.col("n"), 1).otherwise(0)).cast("long"))
    rows = rows.withColumn("copies", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("copies")).cast("long"))
    return rows.join(targets.select("key", "source_size", "target"), "key").select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies"
    )


def take_mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken. Columns are those of docs.

    Rows are known by two 64-bit hashes over all their columns, so ids may be null or repeat; rows alike in
    every column are taken together. Null and empty texts have no words and are not taken. An empty table gives
    an empty result. Names of columns may be any but __row, __times and __copy.
    """
    row = F.concat_ws(":", F.xxhash64(*docs.columns), F.xxhash64(F.lit("second"), *docs.columns))
    keyed = docs.withColumn("__row", row)
    times = mix_sources(keyed, weights, cap, id_col="__row").groupBy("doc_id").agg(F.sum("copies").alias("__times")).filter("__times > 0")
    times = spill(times.withColumnRenamed("doc_id", "__row"), "mix-times")
    taken = keyed.dropDuplicates(["__row"]).join(times, "__row")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
