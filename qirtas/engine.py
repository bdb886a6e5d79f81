"""A set of detectors to keep, for tables and for single texts on the driver; and the same as recognizers of another tool."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .operators.detectors import NAME, SAUDI, Detector, defaults
from .operators.domains import lookalike
from .operators.redact import redact_text
from .operators.scan import findings, scan_text, with_findings
from .schema import EXTERNAL_NAMES, EXTERNAL_SCORES


@dataclass(frozen=True)
class Engine:
    """Detectors and whether text is normalized first."""

    detectors: tuple[Detector, ...] = field(default_factory=lambda: tuple(defaults()))
    normalize: bool = True

    def with_findings(self, df: DataFrame, column: str = "text", name: str = "findings") -> DataFrame:
        return with_findings(df, column, self.detectors, normalize=self.normalize, name=name)

    def findings(self, df: DataFrame, keys: Sequence[str], column: str = "text") -> DataFrame:
        return findings(df, keys, column, self.detectors, normalize=self.normalize)

    def scan(self, text: str) -> list[dict]:
        """The findings of one text, without Spark; not for detectors that are expressions."""
        out = []
        for start, end, k, value, kind in scan_text(text, self.detectors, self.normalize):
            d = self.detectors[k]
            out.append({"entity_type": kind, "category": d.category, "confidence": d.confidence, "start": start, "end": end, "value": value, "detector": d.name, "notes": d.notes, "label": d.label})
        return out

    def redact(self, text: str, mode: str = "mask", **options) -> tuple[str, list[tuple], dict[str, str]]:
        """The text redacted, its items and the vault."""
        return redact_text(text, self.scan(text), mode, **options)


#: Which types a detector gives, where it isn't its name.
_TYPES = {"saudi_national_id": ("saudi_national_id", "saudi_iqama"), "lookalike_domain": ("suspicious_domain",)}


class Recognizer:
    """Detectors under the names and scores of another tool: ``analyze`` as its recognizers have it."""

    def __init__(self, detectors: Sequence[Detector], name: str, language: str = "en"):
        self.engine, self.name, self.supported_language = Engine(tuple(detectors)), name, language
        kinds = {t for d in detectors for t in _TYPES.get(d.name, (d.name,))}
        self.supported_entities = sorted({EXTERNAL_NAMES[t] for t in kinds if t in EXTERNAL_NAMES})

    def load(self) -> None:
        """There is nothing to load."""

    def analyze(self, text: str, entities: Sequence[str] = (), nlp_artifacts=None) -> list[dict]:
        """Findings of ``entities``, or of all that have a name."""
        out = []
        for m in self.engine.scan(text):
            name = EXTERNAL_NAMES.get(m["entity_type"])
            if name and (not entities or name in entities):
                meta = {"recognizer_name": self.name, **{k: m[k] for k in ("confidence", "category", "notes")}}
                out.append({"entity_type": name, "start": m["start"], "end": m["end"], "score": EXTERNAL_SCORES[m["confidence"]], "recognition_metadata": meta})
        return out


class SaudiRecognizer(Recognizer):
    """The Saudi identifiers and Arabic names, without the detectors of mail addresses, cards and IP addresses."""

    def __init__(self, language: str = "en"):
        super().__init__((*SAUDI, NAME), "QirtasSaudiRecognizer", language)


class LookalikeDomainRecognizer(Recognizer):
    def __init__(self, watchlist: Sequence[str] = (), language: str = "en"):
        super().__init__(lookalike(watchlist), "QirtasLookalikeDomainRecognizer", language)


def recognizers(language: str = "en", watchlist: Sequence[str] = ()) -> list[Recognizer]:
    return [SaudiRecognizer(language), *([LookalikeDomainRecognizer(watchlist, language)] if watchlist else [])]


def register_recognizers(target, language: str = "en", watchlist: Sequence[str] = ()) -> None:
    """Add them to a registry, or to what has one as ``registry``."""
    for r in recognizers(language, watchlist):
        getattr(target, "registry", target).add_recognizer(r)
