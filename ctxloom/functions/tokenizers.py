"""Tokenizers by id. Each gives a Column of token counts; only file-based ones leave the JVM."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text


class UnknownTokenizer(LookupError):
    """No adapter is registered for a tokenizer id."""


@dataclass(frozen=True)
class Tokenizer:
    id: str
    count: Callable[[Column], Column]  # of a text column
    python: bool = False  # whether counting leaves the JVM


def word_level(id: str = "word-level") -> Tokenizer:
    return Tokenizer(id, text.word_level_count)


_loaded: dict = {}


def _groups(texts: Iterable[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in order, in groups of about so many characters: a worker holds the tokens of one group, not of an Arrow batch."""
    group, n = [], 0
    for t in texts:
        if group and n + len(t) > chars:
            yield group
            group, n = [], 0
        group.append(t)
        n += len(t)
    if group:
        yield group


def hugging_face(id: str, path: str) -> Tokenizer:
    """A tokenizers-library file; special tokens are not added. The file is loaded once in each worker."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        if path not in _loaded:
            from tokenizers import Tokenizer as Lib

            _loaded[path] = Lib.from_file(path)
        lib = _loaded[path]
        return pd.Series([len(e.ids) for g in _groups(s.fillna("")) for e in lib.encode_batch_fast(g, add_special_tokens=False)], dtype="int64")

    return Tokenizer(id, count, True)


def _tiktoken(id: str, key: str, load: Callable[[], object]) -> Tokenizer:
    """Strings of special tokens are ordinary text; an encoding is loaded once in each worker, which holds the tokens of
    one text at a time."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        if key not in _loaded:
            _loaded[key] = load()
        return pd.Series([len(_loaded[key].encode_ordinary(x)) for x in s.fillna("")], dtype="int64")

    return Tokenizer(id, count, True)


def tiktoken_ranks(id: str, path: str, pattern: str) -> Tokenizer:
    """A rank file and the pattern that cuts texts."""

    def load():
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(id, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return _tiktoken(id, path, load)


def tiktoken_named(id: str) -> Tokenizer:
    """An encoding that the tiktoken package knows by name; it reads its file from its cache folder or the network,
    and where neither has it, counting is an error."""

    def load():
        import tiktoken

        try:
            return tiktoken.get_encoding(id)
        except Exception as e:
            raise RuntimeError(f"tokenizer {id!r}: its file could not be read; name one in the configuration ([[tiktoken]] id, path, pattern)") from e

    return _tiktoken(id, f"named:{id}", load)


# Encodings that are registered from the start.
NAMED = ("cl100k_base", "o200k_base")


@dataclass
class TokenizerRegistry:
    """A later registration under an id replaces the earlier one."""

    by_id: dict[str, Tokenizer] = field(default_factory=lambda: {t.id: t for t in (word_level(), *map(tiktoken_named, NAMED))})

    def register(self, tokenizer: Tokenizer) -> TokenizerRegistry:
        self.by_id[tokenizer.id] = tokenizer
        return self

    def get(self, id: str) -> Tokenizer | None:
        return self.by_id.get(id)

    def require(self, id: str) -> Tokenizer:
        if id not in self.by_id:
            raise UnknownTokenizer(f"no tokenizer adapter for {id!r}; registered: {', '.join(self.ids())}")
        return self.by_id[id]

    def ids(self) -> list[str]:
        return sorted(self.by_id)


def count_blocks(blocks: DataFrame, tokenizer: Tokenizer, live: bool = False, lenient: bool = False) -> DataFrame:
    """Adds tokens: the stored count for the tokenizer unless live, else the count of the body. Bodies that are
    not UTF-8 are an error, or have no tokens if lenient. A tokenizer that leaves the JVM is sent the rows alone
    that have no stored count."""
    stored = F.lit(None).cast("long") if live else F.try_element_at("token_counts", F.lit(tokenizer.id))
    if lenient:
        counted = F.when(F.is_valid_utf8(F.col("body").cast("string")), tokenizer.count(text.body_text(F.col("body"))))
    else:
        counted = tokenizer.count(text.strict_text(F.col("body")))
    if live or not tokenizer.python:
        return blocks.withColumn("tokens", F.coalesce(stored, counted).cast("long"))
    had, lacked = blocks.filter(stored.isNotNull()), blocks.filter(stored.isNull())
    return had.withColumn("tokens", stored.cast("long")).unionByName(lacked.withColumn("tokens", counted.cast("long")))


def with_token_counts(blocks: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Stores a tokenizer's counts in token_counts, each distinct body counted once."""
    once = blocks.select("content_hash", "body").dropDuplicates(["content_hash"])
    once = once.select("content_hash", tokenizer.count(text.strict_text(F.col("body"))).alias("__n"))
    out = blocks.join(once, "content_hash")
    kept = F.map_filter("token_counts", lambda k, _: k != tokenizer.id)
    return out.withColumn("token_counts", F.map_concat(kept, F.create_map(F.lit(tokenizer.id), F.col("__n")))).select(*blocks.columns)
