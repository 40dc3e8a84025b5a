"""Settings in layers: given values over environment over file over defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    x_bucket: float = 8.0
    y_bucket: float = 15.0
    max_spans: int = 0  # 0: no cap
    parallel_docs: int = 0  # 0: left to the cluster
    batch_size: int = 100
    precompile: bool = False
    cache_dir: str = "layouts"
    max_compile_attempts: int = 5
    max_extraction_attempts: int = 3
    max_cents_per_layout: int = 50
    anchor_keywords: tuple[str, ...] = ()
    anchor_patterns: tuple[str, ...] = ()


def _cast(name: str, value):
    kind = type(getattr(Settings, name))
    if kind is bool:
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if kind is tuple:
        return tuple(value) if isinstance(value, (list, tuple)) else tuple(x.strip() for x in str(value).split(",") if x.strip())
    return kind(value)


def load(path: str | None = None, env: dict[str, str] | None = None, **given) -> Settings:
    """Unknown keys and values that don't fit are ignored; a missing or broken file counts as empty."""
    layers: list[dict] = []
    if path and os.path.exists(path):
        try:
            with open(path, "rb") as f:
                data = tomllib.load(f)
            layers.append({k: v for part in (data, *(x for x in data.values() if isinstance(x, dict))) for k, v in part.items() if not isinstance(v, dict)})
        except (OSError, tomllib.TOMLDecodeError):
            pass
    env = os.environ if env is None else env
    layers.append({f.name: env[f"FOLIOSCOPE_{f.name.upper()}"] for f in fields(Settings) if f"FOLIOSCOPE_{f.name.upper()}" in env})
    layers.append({k: v for k, v in given.items() if v is not None})
    out = Settings()
    for layer in layers:
        for f in fields(Settings):
            if f.name in layer:
                try:
                    out = replace(out, **{f.name: _cast(f.name, layer[f.name])})
                except (TypeError, ValueError):
                    continue
    return out
