"""Language identification by multilingual mixture inference.

Each language has a smoothed distribution of hashed letter trigrams, counted over all training documents.
A document is a mixture of languages: expectation-maximisation estimates its proportions from the trigram
likelihoods, and the set of languages is chosen by likelihood less half a logarithm of the trigrams for
each language, dropping the least one while that helps.
"""
from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: Trigrams fall into this many buckets; the model has one row of them for each language, and no more languages than this.
BUCKETS, MOST_LANGUAGES = 1 << 16, 256


@cache
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the letter trigrams of a text in lower case, runs of other characters counting as a space; empty without a letter."""
    a = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4").copy()
    letter = _letters()[a]
    if not letter.any():
        return np.zeros(0, np.uint16)
    a[~letter] = 32
    a = a[letter | np.concatenate([[True], letter[:-1]])]
    h = a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA6B) ^ a[2:] * np.uint32(0xC2B2AE35)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.uint16)


class TooManyLanguages(ValueError):
    """The model of so many language tags is too large to be sent to every executor."""


def train(docs: DataFrame, text_col: str, lang_col: str, use: F.Column, most: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages in order and their trigram probabilities (buckets x languages), counted over all rows that use names.
    More than most languages are an error, found before anything is gathered: tags have to be cleaned first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1)):
                got = np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
                total[key] = total[key] + got if (key := lang.as_py()) in total else got
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.filter(use & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    tags = rows.select("lang").distinct().limit(most + 1).count()
    if tags > most:
        raise TooManyLanguages(f"more than {most} different languages")
    # at most BUCKETS rows for each of most languages
    counts = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    n = np.zeros((BUCKETS, len(langs)))
    n[counts["bucket"].to_numpy(int), np.searchsorted(langs, counts["lang"]) if langs else np.zeros(0, int)] = counts["n"]
    return langs, (n + 0.5) / (n.sum(0) + 0.5 * BUCKETS)


def _fit(p: np.ndarray, c: np.ndarray, n: float, start: np.ndarray, steps: int = 50) -> tuple[np.ndarray, float]:
    share = start
    for _ in range(steps):
        new = share * (p.T @ (c / (p @ share))) / n
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(c @ np.log(p @ share))


def infer(grams: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Proportions of the languages, zero for those outside the chosen set."""
    u, c = np.unique(grams, return_counts=True)
    p, c, n = model[u], c.astype(float), float(len(grams))
    kept = np.arange(model.shape[1])
    share, fit = _fit(p, c, n, np.full(len(kept), 1 / len(kept)))
    cost = 0.5 * np.log(n + 1)
    while len(kept) > 1:
        stay = np.arange(len(kept)) != share.argmin()
        q = p[:, stay]
        less, less_fit = _fit(q, c, n, share[stay] / share[stay].sum() if share[stay].sum() > 0 else np.full(stay.sum(), 1 / stay.sum()))
        if less_fit < fit - cost:
            break
        kept, p, share, fit = kept[stay], q, less, less_fit
    out = np.zeros(model.shape[1])
    out[kept] = share
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, lang_pred, score, languages (those of its mixture).

    Learns from text and lang of rows whose lang is not null and whose crc32(doc_id) modulo folds is not
    held (a null id counts as empty text). lang_pred is the language of the largest proportion, of equal ones
    the first by name, score that proportion; und and 0 for texts that are null or have no letter, or if no
    language was learned. A text of any length counts whole, as a table of its trigrams. Repeated rows each get
    their row and count each time. An empty table gives an empty result. Other columns are not read. More than
    MOST_LANGUAGES languages are an error.
    """
    mod = crc_mod(F.col(id_col), folds)
    langs, model = train(docs, text_col, lang_col, mod != held)
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))  # languages x BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, model = shared.value
        for b in batches:
            pred, score, every = [], [], []
            for t in b.column(2):
                grams = trigrams(t.as_py())
                if not len(grams) or not langs:
                    found = ("und", 0.0, [])
                else:
                    share = infer(grams, model)
                    top = int(share.argmax())
                    found = (langs[top], float(min(1.0, share[top])), [langs[i] for i in np.flatnonzero(share)])
                pred.append(found[0])
                score.append(found[1])
                every.append(found[2])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(every, pa.list_(pa.string()))], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (mod == held).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>")
