"""Settings: weights, thresholds and rules, with the defaults (fixed values) and a YAML reader."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Weights:
    style: float = 0.45
    position: float = 0.2
    pattern: float = 0.25
    semantic: float = 0.1


@dataclass(frozen=True)
class Thresholds:
    high: float = 0.68
    text_ratio_high: float = 0.8
    text_ratio_low: float = 0.2
    min_text_chars_per_page: int = 20
    max_level_jump: int = 1


@dataclass(frozen=True)
class Rules:
    min_line_chars: int = 2
    max_line_chars: int = 120
    min_style_candidate: float = 0.35
    min_pattern_candidate: float = 0.5
    min_semantic_candidate: float = 0.5
    max_candidates_per_page: int = 80


@dataclass(frozen=True)
class Config:
    score_weights: Weights = field(default_factory=Weights)
    thresholds: Thresholds = field(default_factory=Thresholds)
    rules: Rules = field(default_factory=Rules)


DEFAULT = Config()


def _checked(part, given: dict):
    known = {f.name: f.type for f in fields(part)}
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    for name, value in given.items():
        if isinstance(value, bool) or not isinstance(value, int if known[name] == "int" else (int, float)):
            raise ValueError(f"{name} must be {'an integer' if known[name] == 'int' else 'a number'}")
    return replace(part, **given)


def load(path: str | None = None) -> Config:
    """A YAML file's settings over the defaults. A path that doesn't exist is an error; no path gives the defaults."""
    if path is None:
        return DEFAULT
    import yaml

    given = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    return replace(DEFAULT, **{name: _checked(getattr(DEFAULT, name), given.get(name) or {}) for name in ("score_weights", "thresholds", "rules")})


def env_flag(environ, name: str) -> bool:
    return environ.get(name, "").strip().lower() in ("1", "true", "yes", "on")


def _number(environ, name: str, default, pattern: str, kind):
    """The number that the variable begins with, else the default."""
    found = re.match(pattern, environ.get(name, "").strip())
    return kind(found[0]) if found else default


def env_int(environ, name: str, default: int) -> int:
    return _number(environ, name, default, r"[+-]?[0-9]+", int)


def env_float(environ, name: str, default: float) -> float:
    return _number(environ, name, default, r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", float)


STRATEGIES = ("toc-guided", "full-page")


@dataclass(frozen=True)
class Options:
    """How a job uses OCR. ``limits``: pages that the guided strategy's steps read: front, probe, tail, and the window around an entry's page."""

    enable_ocr: bool = False
    force_ocr: bool = False
    strategy: str = "toc-guided"
    parallelism: int = 1
    lang: str = "zh"
    fallback: bool = True
    scale: float = 2.0
    front: int = 60
    probe: int = 80
    window: int = 0
    tail: int = 8

    @staticmethod
    def of(environ, **given) -> Options:
        """From variables beginning with FOLIOSCOPE_, under what is given. An unknown strategy is the guided one; the scale is held to 0.25 to 4."""
        name = (given.pop("strategy", None) or environ.get("FOLIOSCOPE_OCR_STRATEGY") or STRATEGIES[0]).strip().lower().replace("_", "-")
        told = {k: env_int(environ, f"FOLIOSCOPE_{v}", d) for k, v, d in (("front", "MAX_FRONT_SCAN", 60), ("probe", "OFFSET_PROBE_PAGES", 80), ("window", "CONFIRM_WINDOW", 0), ("tail", "TAIL_SCAN_PAGES", 8))}
        told["scale"] = max(0.25, min(4.0, env_float(environ, "FOLIOSCOPE_OCR_RENDER_SCALE", 2.0)))
        told["fallback"] = not env_flag(environ, "FOLIOSCOPE_DISABLE_FALLBACK")
        out = Options(strategy=name if name in STRATEGIES else STRATEGIES[0], **{**told, **given})
        return replace(out, force_ocr=out.force_ocr or (out.enable_ocr and env_flag(environ, "FOLIOSCOPE_FORCE_OCR")), parallelism=max(1, int(out.parallelism)))
