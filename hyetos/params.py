"""All tunable values, passed explicitly. `load` reads them from YAML or JSON, with path templates filled in."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Params:
    wet_day: float = 1.0  # mm; quantile mapping takes values above it as wet, metrics those at or above it
    missing: float = 8888.0
    min_valid_days: int = 30
    min_events: int = 10
    thresholds: tuple[float, ...] = (1.0, 5.0, 10.0, 20.0, 50.0, 100.0, 150.0)
    supported_threshold: float = 50.0
    quality_weights: tuple[float, float, float] = (0.4, 0.3, 0.3)
    categories: tuple[float, float, float] = (0.4, 0.6, 0.8)
    gpd_percentile: float = 0.8
    cap_percentile: float = 0.999
    blend_alpha: float = 0.7
    saturation: float = 2.0
    sigma: float = 1.0
    main_dir: str = "."
    input_dir: str = "{main_dir}/input"
    output_dir: str = "{main_dir}/output"
    corrected_dir: str = "{output_dir}/{method}"

    def path(self, name: str, **values: str) -> str:
        """The path template `name` with every placeholder filled in, from this object or from `values`."""
        text, before = getattr(self, name), None
        while text != before:
            before, text = text, text.format_map(_Keep({f.name: getattr(self, f.name) for f in fields(self)} | values))
        return text


class _Keep(dict):
    def __missing__(self, key: str) -> str:
        return "{" + key + "}"


def load(path: str) -> Params:
    """Parameters from a YAML (where PyYAML is installed) or JSON file; unknown names are an error."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        values = json.loads(text)
    else:
        import yaml

        values = yaml.safe_load(text) or {}
    unknown = set(values) - {f.name for f in fields(Params)}
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    return replace(Params(), **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
