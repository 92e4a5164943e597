"""Run configuration: settings of the two experiment families, read from and written to YAML or JSON.

The file keeps a ``type`` key ('euclidean' or 'gsea') that selects the family.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

try:
    import yaml
except ImportError:  # YAML support is optional; JSON always works
    yaml = None


class _Settings:
    """Dictionary round trip shared by all settings classes; unknown keys are errors."""

    def to_dict(self) -> dict:
        def plain(value):
            if isinstance(value, _Settings):
                return value.to_dict()
            if isinstance(value, dict):
                return {k: plain(v) for k, v in value.items()}
            return list(value) if isinstance(value, tuple) else value

        return {f.name: plain(getattr(self, f.name)) for f in fields(self)}

    @classmethod
    def from_dict(cls, values: dict):
        known = {f.name for f in fields(cls)}
        if extra := set(values) - known:
            raise ValueError(f"unknown settings {sorted(extra)}")
        return cls(**values)


@dataclass
class DesignSettings(_Settings):
    """One dataset: rows per cluster and background (or one total), cluster search, kernel width, signal strength."""

    n_total: int | list[int] = 450
    n_clusters: int = 2
    min_cluster_size: int = 30
    candidate_pool: int = 10000
    sigma_factor: float = 1.0
    cluster_corruption: float = 0.2
    effect_strength: str = "medium"


# Default dataset names with their smallest cluster size and kernel-width factor.
DATASETS = {
    "33_skin": (30, 1.0),
    "19_landsat": (30, 1.0),
    "31_satimage-2": (30, 0.5),
    "30_satellite": (50, 1.0),
    "41_Waveform": (30, 0.5),
    "25_musk": (30, 1.0),
    "4_breastw": (20, 0.5),
    "45_wine": (20, 0.5),
    "15_Hepatitis": (20, 0.5),
}


def default_designs() -> dict[str, DesignSettings]:
    return {n: DesignSettings([50, 200, 200], min_cluster_size=m, sigma_factor=s) for n, (m, s) in DATASETS.items()}


@dataclass
class EuclideanSettings(_Settings):
    datasets: list[str] = field(default_factory=lambda: list(DATASETS))
    dataset_configs: dict[str, DesignSettings] = field(default_factory=dict)
    benchmark_filter: list[str] | None = None
    optimizer: str = "vanilla"
    learning_rate: float = 0.0005
    lambda_reg: float = 10.0
    lambda_bound: float = 500.0
    max_iter: int = 5000
    lambda_sparse: float = 0.001
    sigma_grid: list[float] = field(default_factory=lambda: [0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.5, 2.0])
    n_folds: int = 5
    random_state: int = 42
    n_seeds: int = 1
    results_dir: str = "results"

    def __post_init__(self):
        self.dataset_configs = {
            k: DesignSettings.from_dict(v) if isinstance(v, dict) else v for k, v in self.dataset_configs.items()
        }

    def design_for(self, dataset: str) -> DesignSettings:
        return self.dataset_configs.get(dataset, DesignSettings())


def log_grid(lo: float = -15.0, hi: float = 20.0, n: int = 15) -> list[float]:
    return [10.0 ** (lo + (hi - lo) * i / (n - 1)) for i in range(n)]


@dataclass
class GraphSettings(_Settings):
    data_path: str = "data/bundle"
    benchmarks: list[str] | None = None
    max_datasets_per_benchmark: int = 10
    subsample_tuning: int = 1000
    subsample_main: int = 5000
    n_bins_tuning: int = 50
    n_bins_main: int = 100
    beta_grid: list[float] = field(default_factory=lambda: [2])
    lambda_grid: list[float] = field(default_factory=list)
    learning_rate: float = 0.05
    lambda_reg: float = 10.0
    lambda_bound: float = 500.0
    max_iter: int = 15000
    n_folds: int = 3
    random_state: int = 42
    validate_structure: bool = True
    validate_alignment: bool = True

    def __post_init__(self):
        self.lambda_grid = list(self.lambda_grid) or log_grid()

    def runs(self, benchmark: str) -> bool:
        return self.benchmarks is None or benchmark in self.benchmarks


FAMILIES = {"euclidean": EuclideanSettings, "gsea": GraphSettings}
# What each named preset changes against the defaults.
PRESET_CHANGES = {
    "euclidean": {
        "default": {},
        "quick_test": {"datasets": ["33_skin", "4_breastw"], "max_iter": 1000, "n_seeds": 1},
        "full_evaluation": {"n_seeds": 5, "max_iter": 10000},
    },
    "gsea": {
        "default": {},
        "tgca_only": {"benchmarks": ["TGCA"], "max_datasets_per_benchmark": 10},
        "quick_test": {
            "benchmarks": ["TGCA"], "max_datasets_per_benchmark": 2, "subsample_tuning": 500, "subsample_main": 2000, "max_iter": 5000,
        },
        "full_evaluation": {"max_datasets_per_benchmark": 20, "max_iter": 20000},
    },
}


def from_preset(name: str, family: str = "euclidean", **overrides):
    """Preset settings with overrides of known fields."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}")
    if name not in PRESET_CHANGES[family]:
        raise ValueError(f"unknown preset {name!r}; one of {sorted(PRESET_CHANGES[family])}")
    base = EuclideanSettings(dataset_configs=default_designs()) if family == "euclidean" else GraphSettings()
    return replace(base, **PRESET_CHANGES[family][name], **overrides)


def _family_of(settings) -> str:
    return next(name for name, cls in FAMILIES.items() if isinstance(settings, cls))


def load_settings(path: str | Path):
    path = Path(path)
    if path.suffix == ".json":
        values = json.loads(path.read_text())
    elif path.suffix in (".yaml", ".yml"):
        if yaml is None:
            raise RuntimeError("install a YAML reader or use JSON")
        values = yaml.safe_load(path.read_text())
    else:
        raise ValueError(f"unknown settings format {path.suffix!r}")
    return FAMILIES[values.pop("type", "euclidean")].from_dict(values)


def save_settings(settings, path: str | Path, fmt: str = "yaml") -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    values = {"type": _family_of(settings), **settings.to_dict()}
    if fmt == "json":
        path.write_text(json.dumps(values, indent=2))
    elif fmt == "yaml" and yaml is not None:
        path.write_text(yaml.safe_dump(values, sort_keys=False))
    else:
        raise ValueError(f"unknown settings format {fmt!r}")
