"""Settings from a TOML file and the environment; the environment wins."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass
class Settings:
    store: str = "graph-store"
    project: str | None = None
    allow_index: bool = False
    row_cap: int = 500
    token_cap: int = 8000
    embedding_dim: int = 64
    exclude: list[str] = field(default_factory=list)
    unignore: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
        """A missing file means the defaults; unknown keys are ignored, a broken file is an error."""
        values: dict[str, object] = {}
        if path and Path(path).exists():
            values |= tomllib.loads(Path(path).read_text())
        env = os.environ if environment is None else environment
        for f in fields(cls):
            raw = env.get(f"GRAPHLODE_{f.name.upper()}")
            if raw is None:
                continue
            default = getattr(cls(), f.name)
            values[f.name] = raw.lower() in ("1", "true", "yes") if isinstance(default, bool) else int(raw) if isinstance(default, int) else raw.split(",") if isinstance(default, list) else raw
        return cls(**{k: v for k, v in values.items() if k in {f.name for f in fields(cls)}})

    def save(self, path: str) -> None:
        lines = []
        for k, v in asdict(self).items():
            if v is None:
                continue
            text = str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "[" + ", ".join(f'"{x}"' for x in v) + "]" if isinstance(v, list) else f'"{v}"'
            lines.append(f"{k} = {text}")
        Path(path).write_text("\n".join(lines) + "\n")
