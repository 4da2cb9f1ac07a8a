"""Run parameters and their rules."""

from dataclasses import dataclass, field


def split_list(text):
    """``"a, b,,c"`` becomes ``["a", "b", "c"]``."""
    return [part.strip() for part in text.split(",") if part.strip()]


def require(**values):
    missing = [name for name, value in values.items() if not value]
    if missing:
        raise ValueError(f"missing parameters: {', '.join(missing)}")


def require_three_parts(**names):
    for label, name in names.items():
        if name.count(".") != 2:
            raise ValueError(f"{label} must look like catalog.schema.table, got {name!r}")


@dataclass(frozen=True)
class GenerationConfig:
    scope_table: str
    catalog_column: str = "catalog_name"
    schema_column: str = "schema_name"
    table_column: str = "table_name"
    sampling: bool = False
    sampling_pct: int = 10
    max_context_chars: int = 30_000
    seed: int = 42

    def __post_init__(self):
        require(scope_table=self.scope_table, catalog_column=self.catalog_column,
                schema_column=self.schema_column, table_column=self.table_column)
        if not 1 <= self.sampling_pct <= 100:
            raise ValueError("sampling_pct must lie between 1 and 100")
        if self.max_context_chars < 1:
            raise ValueError("max_context_chars must be positive")


@dataclass(frozen=True)
class AuditConfig:
    execution_id: str = ""
    only_approved: bool = False
    manifests: tuple = ()


@dataclass(frozen=True)
class EvaluationConfig:
    candidates: tuple
    judge: str
    temperature: float = 0.0
    runs: int = 3
    max_comment_chars: int = 500
    prices: dict = field(default_factory=dict)
    catalog_product: str = "un catálogo de datos"

    def __post_init__(self):
        if isinstance(self.candidates, str):
            object.__setattr__(self, "candidates", tuple(split_list(self.candidates)))
        require(candidates=self.candidates, judge=self.judge)
        if self.judge in self.candidates:
            raise ValueError(f"the judge {self.judge!r} must not be one of the candidates")
        if not 0.0 <= float(self.temperature) <= 2.0:
            raise ValueError("temperature must lie between 0 and 2")
        if int(self.runs) < 1:
            raise ValueError("runs must be at least 1")
        if int(self.max_comment_chars) < 1:
            raise ValueError("max_comment_chars must be at least 1")
