"""Configuration: detectors to leave out, detectors to add, own confusables."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from .operators.detectors import DEFAULT, Detector, custom
from .operators.domains import lookalike


@dataclass(frozen=True)
class Config:
    disable: frozenset[str] = frozenset()
    custom_detectors: tuple[Detector, ...] = ()
    typosquat_max_distance: int = 1
    confusables: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, data: Mapping) -> Config:
        own = [custom(c["label"], c["pattern"], c.get("category", "organisation"), c.get("confidence", "medium")) for c in data.get("custom_detectors") or ()]
        return cls(frozenset(data.get("disable") or ()), tuple(own), int(data.get("typosquat_max_distance", 1)), dict(data.get("confusables") or {}))

    @staticmethod
    def from_file(name: str | os.PathLike) -> Config:
        with open(name, encoding="utf-8") as f:
            return Config.from_dict(json.load(f))

    def detectors(self, watchlist: Sequence[str] = ()) -> list[Detector]:
        """The default detectors but the disabled ones, then the custom ones, which can't be disabled; with a watchlist also
        those of lookalike domains."""
        own = lookalike(watchlist, **self.domain_options()) if watchlist else []
        return [*(d for d in (*DEFAULT, *own) if d.name not in self.disable), *self.custom_detectors]

    def domain_options(self) -> dict:
        """What ``analysed``, ``suspicious`` and ``lookalike`` take."""
        return {"max_distance": self.typosquat_max_distance, "confusables": dict(self.confusables)}
