"""Parameters of the pipeline: an explicit argument wins over the configuration, which wins over the default."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml

#: Acquisition methods by label.
METHOD_CODES = {"GPS": [1, 2], "IMAGERY": [3, 4]}
DEFAULT_METHODS = [1, 2, 3, 4]


@dataclass(frozen=True)
class Params:
    min_year: int = 2000
    max_year: int = 2024
    min_acres: float = 10.0
    max_acres: float = 1_000_000.0
    bounds: tuple[float, float, float, float] = (-124.5, 32.5, -114.0, 42.0)
    variables: tuple[str, ...] = ("tmmx", "tmmn", "pr", "vs", "erc", "bi")
    summed: tuple[str, ...] = ("pr",)
    windows: tuple[int, ...] = (7, 14, 30)
    completeness: float = 0.9
    coverage_start: str = "1979-01-01"
    default_ndvi: float = 0.5
    default_ndmi: float = 0.3
    pseudo_ratio: float = 1.0
    pseudo_distance_km: float = 2.0
    pseudo_attempts: int = 500
    seed: int = 42
    groups: int = 10
    folds: int = 5
    separation_km: float = 30.0
    holdout_year: int = 2024
    trees: int = 100
    depth: int = 20
    leaf: int = 20


def load_config(path: str) -> dict[str, Any]:
    """The YAML document; an empty one is {}; a missing file raises FileNotFoundError."""
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    return yaml.safe_load(Path(path).read_text()) or {}


def params(config: dict[str, Any] | None = None, **explicit: Any) -> Params:
    """Params of a configuration's leaves by name, and explicit arguments that aren't None."""
    names = {f.name for f in dataclasses.fields(Params)}
    found: dict[str, Any] = {}

    def walk(node: Any) -> None:
        for key, value in (node or {}).items():
            if isinstance(value, dict):
                walk(value)
            elif key in names:
                found[key] = tuple(value) if isinstance(value, list) else value

    walk(config)
    return Params(**found | {k: v for k, v in explicit.items() if v is not None})


def method_codes(wanted: list[Any] | None) -> list[int]:
    """Numeric codes of labels, digit strings and numbers; unknown labels are left out, and nothing means the default."""
    out: list[int] = []
    for x in wanted or []:
        if isinstance(x, int):
            out.append(x)
        elif str(x).upper() in METHOD_CODES:
            out += METHOD_CODES[str(x).upper()]
        elif str(x).isdigit():
            out.append(int(x))
    return sorted(set(out)) or list(DEFAULT_METHODS)
