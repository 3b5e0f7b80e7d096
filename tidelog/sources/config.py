"""Configuration of a run: defaults, a preset, the environment and overrides, the later before the earlier."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class RunConfig:
    task: str = "qa"
    subset: str = "tiny"
    fps: float = 1.0
    proactive_window_s: float = 5.0
    qa_window_s: float = 10.0
    window_boundary: str = "half_open"
    pacing: str = "logical"
    max_width: int | None = None
    jpeg_quality: int = 90
    judge_mode: str = "auto"
    checkpoint_every: int = 10
    scoring_profile: str = "legacy"
    output: str | None = None
    resume: bool = False

    def __post_init__(self) -> None:
        rules = {
            "task": self.task in ("qa", "proactive"),
            "subset": self.subset in ("tiny", "full", "all", "standard"),
            "fps": self.fps == 1.0,
            "proactive_window_s": self.proactive_window_s in (5.0, 10.0),
            "qa_window_s": self.qa_window_s > 0,
            "window_boundary": self.window_boundary in ("half_open", "inclusive"),
            "pacing": self.pacing in ("logical", "wall_clock"),
            "max_width": self.max_width is None or self.max_width > 0,
            "jpeg_quality": 1 <= self.jpeg_quality <= 100,
            "judge_mode": self.judge_mode in ("auto", "exact", "vlm"),
            "checkpoint_every": self.checkpoint_every > 0,
            "scoring_profile": self.scoring_profile in ("legacy", "paper-v1"),
        }
        if wrong := [name for name, fine in rules.items() if not fine]:
            raise ValueError(f"invalid: {', '.join(f'{n}={getattr(self, n)!r}' for n in wrong)}")


def _from_text(value: str, like: Any) -> Any:
    if isinstance(like, bool):
        return value.strip().lower() in ("1", "true", "yes")
    if isinstance(like, int):
        return int(value)
    if isinstance(like, float):
        return float(value)
    return value


def resolve(preset: Mapping[str, Any] | None = None, overrides: Mapping[str, Any] | None = None, environment: Mapping[str, str] | None = None, prefix: str = "TIDELOG_") -> RunConfig:
    """Values that are None don't count; unknown names are an error."""
    env = os.environ if environment is None else environment
    base = RunConfig()
    known = {f.name for f in fields(RunConfig)}
    if foreign := ({*(preset or {})} | {*(overrides or {})}) - known:
        raise ValueError(f"unknown settings: {sorted(foreign)}")
    told = {n: _from_text(env[f"{prefix}{n.upper()}"], getattr(base, n)) for n in known if f"{prefix}{n.upper()}" in env}
    layers = [{k: v for k, v in (layer or {}).items() if v is not None} for layer in (preset, told, overrides)]
    return RunConfig(**(layers[0] | layers[1] | layers[2]))
