"""Personal data in text columns: found, validated, classified and redacted with Spark."""

from __future__ import annotations

from .config import Config
from .engine import Engine, LookalikeDomainRecognizer, Recognizer, SaudiRecognizer, recognizers, register_recognizers
from .operators.classify import counted, display_name, external, has_health, has_personal, highest_level, level_counts, level_of, macro_average, quality, summary
from .operators.detectors import Detector, custom, discover, from_function, register, registered, unregister_all
from .operators.domains import analysed, domains, lookalike, suspicious
from .operators.guard import AuditLog, Guard, audit_rows, host_of, is_in_kingdom, write_audit
from .operators.redact import MODES, highlighted, redacted, restored
from .operators.scan import chunk_findings, chunked_findings, filtered, findings, scan_text, with_findings
from .providers import ProviderAdapter, register_adapter, resolve_adapter
from .schema import CATEGORIES, CONFIDENCE_RANK, ENTITY_TYPES, LEVELS
from .vault import decrypt_vault, encrypt_vault, load_vault, save_vault


def scan_and_redact(df, column: str = "text", mode: str = "mask", detectors=None, **options):
    """``df`` with ``findings`` and their ``redaction``."""
    return redacted(with_findings(df, column, detectors), column, "findings", mode, **options)


__version__ = "0.1.0"
