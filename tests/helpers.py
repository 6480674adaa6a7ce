"""Small blocks for tests, and an executable model of the fill."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ctxloom.functions.ids import content_hash, make_block_id
from ctxloom.plans.models import SECTION_OF_KIND, ModelProfile, ModelRegistry
from ctxloom.sources import fixtures as fx

SCHEMA = "session_id string, block_id string, kind string, text string, priority float, parents array<string>, seq bigint"
FILLED = ("State", "Plan", "Retrieved", "Tools", "Recent", "Background")


def sid(n: int) -> str:
    return f"{n:032x}"


def blocks(spark, rows):
    """rows: (session, ts_ms, rnd, kind, text[, priority[, parents]]) -> blocks with session_id and seq."""
    full = [(sid(r[0]), make_block_id(r[1], r[2]), r[3], r[4], float(r[5]) if len(r) > 5 else 0.0, list(r[6]) if len(r) > 6 else [], i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, SCHEMA)
    ts = F.conv(F.substring("block_id", 1, 12), 16, 10).cast("long")
    body = F.col("text").cast("binary")
    return df.select(
        "session_id", "block_id", "kind", body.alias("body"), F.create_map().cast("map<string,bigint>").alias("token_counts"), "priority", ts.alias("created_at_ms"), ts.alias("updated_at_ms"),
        F.struct(F.lit(None).cast("string").alias("source"), F.col("parents"), F.array().cast("array<string>").alias("labels")).alias("provenance"), content_hash(body).alias("content_hash"), "seq",
    )


def tables(spark, rows, edges=None):
    e = spark.createDataFrame(edges, "from_id string, to_id string, kind string") if edges else None
    return fx.plain_tables(blocks(spark, rows), e)


def profiles(spark, *budgets: int, tokenizer="word-level", system=True):
    r = ModelRegistry(defaults=False)
    for b in budgets:
        r.register(ModelProfile(f"m{b}", b, 0, 0, tokenizer, system))
    return r.table(spark)


def asks(spark, sessions, budget: int, task: str = "", required=()):
    return spark.createDataFrame([(sid(s), sid(s), task, f"m{budget}", list(required)) for s in sessions], "request_id string, session_id string, task string, model string, required array<string>")


def tokens_of(text: str) -> int:
    import re

    return len(re.findall(r"\w+|[^\w\s]+", text))


def model_fill(rows, scores: dict, budget: int, base: int, shares: dict, redundancy=None, summaries=None):
    """rows: {id: (kind, text, priority)}; -> (selected ids in order, {id: omission reason})."""
    f = np.float32
    cands = []
    for i, (kind, text, priority) in rows.items():
        if i not in scores:
            continue
        score = f(f(scores[i]) + f(f(0.5) * f(min(1, max(0, priority)))))
        n = tokens_of(text)
        cands.append((f(score / f(max(n, 1))), score, i, SECTION_OF_KIND[kind], n, set(text.lower().split())))
    cands.sort(key=lambda c: (c[0], c[1], c[2]), reverse=True)
    total, picked, out, used_summary = base, [], {}, set()
    for _, _, i, s, n, _ in cands:
        if s == "System":
            if total + n <= budget:
                total += n
                picked.append(i)
            else:
                out[i] = "Budget"
    variable = max(0, budget - total)
    for section in FILLED:
        fraction, scale = shares[section]
        room, used, sets = int(variable * fraction * scale), 0, []
        for _, _, i, s, n, words in cands:
            if s != section:
                continue
            if redundancy is not None and any(len(words & w) / len(words | w) >= redundancy for w in sets if words | w):
                out[i] = "Redundant"
            elif used + n <= room and total + n <= budget:
                used, total = used + n, total + n
                sets.append(words)
                picked.append(i)
            elif summaries and i in summaries:
                sm = summaries[i]
                m = tokens_of(rows[sm][1])
                if sm in used_summary:
                    out[i] = "Compressed"
                elif used + m <= room and total + m <= budget:
                    used, total = used + m, total + m
                    used_summary.add(sm)
                    picked.append(sm)
                    out[i] = "Compressed"
                else:
                    out[i] = "Budget"
            else:
                out[i] = "Budget"
    return picked, out
