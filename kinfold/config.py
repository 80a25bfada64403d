"""Sketch configuration and its validity rules."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from enum import Enum

from .functions.measures import Measure


class Space(str, Enum):
    SET = "set"
    MULTISET = "multiset"
    PROBABILITY = "probability"
    EDIT = "edit"


class Kind(str, Enum):
    ONE_PERMUTATION = "oneperm"
    FULL = "full"
    EXACT_SET = "exact_set"
    EXACT_COUNTS = "exact_counts"
    SEQUENCE = "sequence"


@dataclass(frozen=True)
class SketchConfig:
    """Everything a sketch depends on. ``checked`` gives the valid configuration."""

    k: int
    size: int = 1024
    window: int = 0
    space: Space = Space.SET
    kind: Kind = Kind.ONE_PERMUTATION
    alphabet: str = "dna"
    canonical: bool = True
    seed: str | None = None
    min_count: int = 1
    fraction: float = 1.0
    spacing: str | None = None

    def checked(self) -> SketchConfig:
        if self.k < 1 or self.size < 1 or self.min_count < 0 or not 0 < self.fraction <= 1:
            raise ValueError("k and size must be positive, the fraction in (0, 1]")
        fix = {}
        if self.space in (Space.MULTISET, Space.PROBABILITY, Space.EDIT) and self.kind is Kind.ONE_PERMUTATION:
            fix["kind"] = Kind.FULL  # weighted and ordered spaces have no one-permutation form
        if self.canonical and (self.alphabet != "dna" or self.spacing):
            fix["canonical"] = False
        return SketchConfig(**{**self.__dict__, **fix})

    def allows(self, measure: Measure) -> None:
        """Raise where a measure has no meaning in the space."""
        sizes = (Measure.INTERSECTION, Measure.UNION, Measure.CONTAINMENT, Measure.SYMMETRIC_CONTAINMENT)
        if self.space in (Space.PROBABILITY, Space.EDIT) and measure in sizes:
            raise ValueError(f"{measure.value} is not defined in {self.space.value} space")
        if measure is Measure.EDIT_DISTANCE and self.space is not Space.EDIT:
            raise ValueError("edit distance needs the edit space")

    def key(self) -> str:
        """A short name of the configuration, equal for equal configurations."""
        text = json.dumps(asdict(self), sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()[:16]
