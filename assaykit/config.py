"""Settings of a run, from defaults, discovered files, or one named file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

DISCOVERED = ".assaykit.config.json"


@dataclass(frozen=True)
class Config:
    sample_size: int = 5
    pii_sample_size: int | None = 5
    random_review_sample: int = 25
    review_seed: int = 0
    min_trivial_chars: int = 3
    max_file_size_gb: float = 1.0
    declared_labels: tuple[str, ...] | None = None
    classification_majority_minority_warning_ratio: float = 10.0
    preference_length_bias_warning_ratio: float = 0.35
    length_windows: tuple[int, ...] = (4_000, 8_000, 32_000, 128_000, 200_000)
    #: How texts are cut before bytes are merged: cl100k_base, gpt2, r50k_base or p50k_base.
    token_encoding: str = "cl100k_base"
    #: The encoding's file of ranks (.tiktoken), which nothing downloads; without one, tokens are estimated as characters / 4.
    token_ranks: str | None = None
    near_duplicate_threshold: float = 0.85
    #: "exact" joins shingle sets; "lsh" is the approximate MinHash join with near_duplicate_num_perm functions.
    near_duplicate_method: str = "exact"
    near_duplicate_num_perm: int = 128
    #: Limits that only bind in parity mode; the engine itself needs none.
    parity_limits: bool = False
    near_duplicate_max_records: int = 250_000
    near_duplicate_fallback_max_records: int = 5_000
    split_near_leakage_max_records_per_split: int = 50_000

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=2, sort_keys=True)


def _overlay(config: Config, loaded: object) -> Config:
    if not isinstance(loaded, dict):
        raise ValueError("a configuration must be an object")
    known = {f.name for f in fields(Config)}
    return replace(config, **{k: tuple(v) if isinstance(v, list) else v for k, v in loaded.items() if k in known})


def _parse(path: Path) -> object:
    text = path.read_text(encoding="utf-8")
    if path.suffix.lower() in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("a YAML configuration needs PyYAML; use JSON") from error
        return yaml.safe_load(text) or {}
    return json.loads(text or "{}")


def load_config(path: str | None = None, home: Path | None = None, here: Path | None = None) -> Config:
    """path replaces discovery; else the home folder's file, overlaid by the working folder's."""
    if path:
        if not Path(path).exists():
            raise FileNotFoundError(f"no configuration at {path}")
        return _overlay(Config(), _parse(Path(path)))
    config = Config()
    for folder in (home or Path.home(), here or Path.cwd()):
        if (folder / DISCOVERED).exists():
            config = _overlay(config, _parse(folder / DISCOVERED))
    return config
