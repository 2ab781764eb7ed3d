"""What identifies a run, and the datasets' default sets."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, fields

from strandline.functions.text import sanitized

METHODS = ("vector", "bm25", "fuzzy")
#: Original set and variant sets of each dataset (fixed values).
DATASETS: dict[str, tuple[str, tuple[str, ...]]] = {
    "krapivin": ("krapivin_original", ("krapivin_original_dipper_lex60_order60_s42",)),
    "par3": ("par3_gt_split", ("par3_human_t1_split",)),
    "casimir_raw": ("casimir_raw_v1_only", ("casimir_raw_latest_only",)),
    "casimir_dedup": ("casimir_dedup_v1_only", ("casimir_dedup_latest_only",)),
}


def _fingerprint(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()[:8]


@dataclass(frozen=True)
class RunConfig:
    """One experiment; unset sets are the dataset's defaults."""

    dataset: str
    method: str = "vector"
    prepared_dir: str = "data/prepared"
    splits_dir: str = "data/splits"
    artifacts_dir: str = "artifacts"
    original_set: str | None = None
    variant_sets: tuple[str, ...] | None = None
    split_seed: int = 42
    split_ratio: float = 0.5
    method_params: dict = field(default_factory=dict)
    include_original_as_positive: bool = False

    def __post_init__(self) -> None:
        for value, known in ((self.dataset, DATASETS), (self.method, METHODS)):
            if value not in known:
                raise ValueError(f"{value!r} is none of {list(known)}")
        if self.variant_sets is not None:
            object.__setattr__(self, "variant_sets", tuple(self.variant_sets))

    @property
    def original(self) -> str:
        return self.original_set or DATASETS[self.dataset][0]

    @property
    def variants(self) -> tuple[str, ...]:
        return DATASETS[self.dataset][1] if self.variant_sets is None else self.variant_sets

    def ident(self, method: str | None = None) -> str:
        """First level of a run's folder: method, original set, seed, and whatever of the rest is not the default.

        Runs that differ in anything that changes their result have different names.
        """
        marks = {
            f"__r{self.split_ratio:g}": self.split_ratio != 0.5,
            f"__var{_fingerprint('|'.join(self.variants))}": self.variants != DATASETS[self.dataset][1],
            f"__par{_fingerprint(json.dumps(self.method_params, sort_keys=True, default=str))}": bool(self.method_params),
            "__inclorig": self.include_original_as_positive,
        }
        return sanitized("__".join((method or self.method, self.original, f"s{self.split_seed}")) + "".join(m for m, on in marks.items() if on))

    def folder(self, tag: str = "") -> str:
        return f"{self.artifacts_dir}/runs/{self.ident()}/{sanitized(tag) if tag else 'default'}"

    def as_dict(self) -> dict:
        """All fields, and what they stand for."""
        resolved = dict(original_set=self.original, variant_sets=[*self.variants], run_ident=self.ident())
        return {f.name: getattr(self, f.name) for f in fields(self)} | {"_resolved": resolved}


def configs(spec: dict) -> list[RunConfig]:
    """Runs of a specification: shared keys, and `runs` with their own."""
    shared = {k: v for k, v in spec.items() if k != "runs"}
    return [RunConfig(**(shared | (own or {}))) for own in spec.get("runs") or [{}]]
