"""Run settings as a dataclass, from JSON (or YAML where that library is there)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class MiningSettings:
    population: int = 20
    rounds: int = 2
    budget: int = 15
    folds: int = 5
    embargo: int = 5
    lambda_std: float = 0.5
    lambda_complexity: float = 0.001
    lambda_size: float = 0.5
    size_limit: float = 0.7
    buy_cost: float = 0.0005
    sell_cost: float = 0.0015
    top: int = 50
    drop: int = 5
    seed: int = 42

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of(cls, values: dict) -> MiningSettings:
        """Known keys only; what is missing keeps its default."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known and v is not None})

    @classmethod
    def load(cls, text: str) -> MiningSettings:
        """From JSON or YAML text; YAML needs that library."""
        try:
            values = json.loads(text)
        except json.JSONDecodeError:
            import yaml

            values = yaml.safe_load(text)
        if not isinstance(values, dict):
            raise ValueError("settings are a mapping")
        return cls.of(values.get("mining", values))
