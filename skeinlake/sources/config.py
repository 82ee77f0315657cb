"""The engine's settings from TOML or JSON, checked on the driver."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

#: Least and greatest value of each numeric setting.
RANGES = {"temperature": (0.0, 2.0), "timeout_seconds": (1, 86_400), "top_k": (1, 100_000), "radius": (0, 10), "budget_tokens": (0, 1_000_000), "damping": (0.0, 1.0)}


@dataclass(frozen=True)
class Settings:
    temperature: float = 0.3
    timeout_seconds: int = 300
    top_k: int = 200
    radius: int = 2
    budget_tokens: int = 3000
    damping: float = 0.85

    def __post_init__(self):
        for name, (least, most) in RANGES.items():
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not least <= value <= most:
                raise ValueError(f"{name} is {value!r}; it must be a number from {least} to {most}")


def load(path: str, section: str | None = None) -> Settings:
    """Settings of a file, of one section if named; what the file doesn't give keeps its default, unknown keys are ignored."""
    text = Path(path).read_text()
    values = json.loads(text) if path.endswith(".json") else tomllib.loads(text)
    values = values.get(section, {}) if section else values
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in values.items() if k in known})
