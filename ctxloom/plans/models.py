"""Fixed tables of the engine: block kinds, sections, model profiles, section budgets."""
from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds and the section each belongs to.
SECTION_OF_KIND = {
    "System": "System",
    "UserMessage": "Recent",
    "AssistantMessage": "Recent",
    "ToolResult": "Tools",
    "Summary": "Retrieved",
    "Fact": "Retrieved",
    "DocumentChunk": "Background",
    "Plan": "Plan",
    "State": "State",
    "Trace": "Background",
}
# Sections in canonical order.
SECTIONS = ("System", "Task", "State", "Plan", "Retrieved", "Tools", "Recent", "Background", "Slack")
# Edge kinds and their sort codes.
EDGE_CODE = {"Parent": 1, "DerivedFrom": 2, "Supports": 3, "Contradicts": 4, "ToolInvocation": 5}
RETRIEVAL_LIMIT = 4096


def kebab(name: str) -> str:
    return "".join(f"-{c.lower()}" if c.isupper() and i else c.lower() for i, c in enumerate(name))


KIND_BY_NAME = {k: k for k in SECTION_OF_KIND} | {kebab(k): k for k in SECTION_OF_KIND}
EDGE_BY_NAME = {k: k for k in EDGE_CODE} | {kebab(k): k for k in EDGE_CODE}


def case(column: Column, table: dict, default=None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(column == k, F.lit(v)) if out is None else out.when(column == k, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def section_of(kind: Column) -> Column:
    return case(kind, SECTION_OF_KIND)


def section_order(section: Column) -> Column:
    return case(section, {s: i for i, s in enumerate(SECTIONS)})


def edge_code(kind: Column) -> Column:
    return case(kind, EDGE_CODE)


@dataclass(frozen=True)
class ModelProfile:
    name: str
    max_context: int
    reserved_output: int
    safety_margin: int = 0
    tokenizer: str = "word-level"
    supports_system_role: bool = True
    supports_tools: bool = True

    @property
    def input_budget(self) -> int:
        return max(0, max(0, self.max_context - self.reserved_output) - self.safety_margin)


# Name, context, reserved output, margin, tokenizer, system role.
_PROFILES = (
    ("gpt-4.1", 1048576, 32768, 256, "o200k_base", True),
    ("gpt-4o", 128000, 16384, 256, "o200k_base", True),
    ("gpt-4o-mini", 128000, 16384, 256, "o200k_base", True),
    ("o1", 200000, 100000, 256, "o200k_base", False),
    ("o3", 200000, 100000, 256, "o200k_base", True),
    ("claude-opus-4-7", 200000, 8192, 4096, "cl100k_base", True),
    ("claude-sonnet-4-6", 200000, 8192, 4096, "cl100k_base", True),
    ("claude-haiku-4-5", 200000, 8192, 4096, "cl100k_base", True),
    ("llama-3.1-70b", 128000, 4096, 512, "llama-3", True),
    ("qwen-2.5-72b", 128000, 4096, 512, "qwen-2.5", True),
)


class ModelRegistry:
    """Profiles by name; registering a name again replaces it."""

    def __init__(self, defaults: bool = True):
        self._by_name = {p[0]: ModelProfile(*p) for p in _PROFILES} if defaults else {}

    def register(self, profile: ModelProfile) -> ModelRegistry:
        self._by_name[profile.name] = profile
        return self

    def get(self, name: str) -> ModelProfile | None:
        return self._by_name.get(name)

    def names(self) -> list[str]:
        return sorted(self._by_name)

    def profiles(self) -> list[ModelProfile]:
        return [self._by_name[n] for n in self.names()]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p.name, p.max_context, p.reserved_output, p.safety_margin, p.tokenizer, p.supports_system_role, p.supports_tools) for p in self.profiles()]
        df = spark.createDataFrame(rows, "name string, max_context long, reserved_output long, safety_margin long, tokenizer string, supports_system_role boolean, supports_tools boolean")
        return df.withColumn("input_budget", input_budget())


def input_budget() -> Column:
    zero = F.lit(0).cast("long")
    return F.greatest(F.greatest(F.col("max_context") - F.col("reserved_output"), zero) - F.col("safety_margin"), zero)


# Fractions of the variable budget.
BUDGET_TABLES = {
    "default": {"State": 0.10, "Plan": 0.05, "Recent": 0.20, "Retrieved": 0.40, "Tools": 0.15, "Background": 0.05, "Slack": 0.05},
    "chat-loop": {"State": 0.10, "Plan": 0.05, "Recent": 0.30, "Retrieved": 0.30, "Tools": 0.15, "Background": 0.05, "Slack": 0.05},
    "focused-qa": {"State": 0.05, "Plan": 0.0, "Recent": 0.05, "Retrieved": 0.50, "Tools": 0.10, "Background": 0.0, "Slack": 0.30},
    "rag-heavy": {"State": 0.05, "Plan": 0.0, "Recent": 0.10, "Retrieved": 0.60, "Tools": 0.05, "Background": 0.15, "Slack": 0.05},
}


@dataclass(frozen=True)
class SectionBudgets:
    """Fractions by section, each clamped to [0, 1]; System and Task have none."""

    fractions: dict[str, float] = field(default_factory=lambda: dict(BUDGET_TABLES["default"]))

    def set(self, section: str, fraction: float) -> SectionBudgets:
        return replace(self, fractions=self.fractions | {section: min(1.0, max(0.0, fraction))})

    @staticmethod
    def empty() -> SectionBudgets:
        return SectionBudgets({})

    def share(self, section: str) -> tuple[float, float]:
        """(fraction, scale) in single precision."""
        import numpy as np

        total = np.float32(0)
        for s in SECTIONS:
            if s not in ("System", "Task"):
                total = np.float32(total + np.float32(self.fractions.get(s, 0.0)))
        scale = np.float32(1) / total if total > 1 else np.float32(1)
        own = 0.0 if section in ("System", "Task") else self.fractions.get(section, 0.0)
        return float(np.float32(own)), float(scale)

    def allocation(self, section: str, variable: Column) -> Column:
        fraction, scale = self.share(section)
        return F.floor(variable.cast("double") * F.lit(fraction) * F.lit(scale)).cast("long")
