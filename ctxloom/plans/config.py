"""Configuration from TOML: profiles, tokenizer files, retrievers, budgets, packer, cache."""
from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from ..functions.tokenizers import TokenizerRegistry, hugging_face, tiktoken_ranks
from ..operators import packer, retrievers
from .models import SECTIONS, ModelProfile, ModelRegistry, SectionBudgets


class ConfigError(ValueError):
    pass


_KEYS = {"profile", "hf_tokenizer", "tiktoken", "retriever", "section_budgets", "packer", "cache"}


@dataclass
class Config:
    models: ModelRegistry = field(default_factory=ModelRegistry)
    tokenizers: TokenizerRegistry = field(default_factory=TokenizerRegistry)
    retrievers: tuple = ()
    budgets: SectionBudgets | None = None
    include_timestamps: bool = False
    stable_sections: tuple[str, ...] = ("System", "Background")


def _need(table: dict, name: str, *keys: str) -> None:
    for k in keys:
        if k not in table:
            raise ConfigError(f"[[{name}]]: missing field {k!r}")


def loads(text: str) -> Config:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    if unknown := set(raw) - _KEYS:
        raise ConfigError(f"unknown tables: {', '.join(sorted(unknown))}")
    out = Config()
    for p in raw.get("profile", ()):
        _need(p, "profile", "name", "max_context", "reserved_output", "tokenizer")
        try:
            out.models.register(ModelProfile(**p))
        except TypeError as e:
            raise ConfigError(f"[[profile]]: {e}") from e
    for t in raw.get("hf_tokenizer", ()):
        _need(t, "hf_tokenizer", "id", "path")
        out.tokenizers.register(hugging_face(t["id"], t["path"]))
    for t in raw.get("tiktoken", ()):
        _need(t, "tiktoken", "id", "path", "pattern")
        out.tokenizers.register(tiktoken_ranks(t["id"], t["path"], t["pattern"]))
    made = []
    for r in raw.get("retriever", ()):
        _need(r, "retriever", "kind")
        options = {k: v for k, v in r.items() if k != "kind"}
        if "half_life_secs" in options:
            options["half_life_s"] = options.pop("half_life_secs")
        try:
            made.append(retrievers.from_config(r["kind"], **options))
        except ValueError as e:
            raise ConfigError(str(e)) from e
    out.retrievers = tuple(made)
    if "section_budgets" in raw:  # omitted sections have nothing
        names = {s.lower(): s for s in SECTIONS}
        budgets = SectionBudgets.empty()
        for k, v in raw["section_budgets"].items():
            if k not in names:
                raise ConfigError(f"[section_budgets]: unknown section {k!r}")
            budgets = budgets.set(names[k], float(v))
        out.budgets = budgets
    out.include_timestamps = bool(raw.get("packer", {}).get("include_timestamps", False))
    if "stable_sections" in raw.get("cache", {}):
        try:
            out.stable_sections = packer.stable_sections(raw["cache"]["stable_sections"])
        except ValueError as e:
            raise ConfigError(f"[cache]: {e}") from e
    return out
