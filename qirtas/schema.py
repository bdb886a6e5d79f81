"""The finding row, its vocabularies and their ranks."""

from __future__ import annotations

FINDING = "struct<entity_type:string,category:string,confidence:string,start:int,end:int,value:string,detector:string,notes:string,label:string>"
FINDINGS = f"array<{FINDING}>"

CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
CATEGORIES = ("national_identifier", "financial", "contact", "organisation", "sensitive_health", "network", "person", "threat")
ENTITY_TYPES = (
    "saudi_national_id", "saudi_iqama", "saudi_iban", "saudi_mobile", "saudi_landline", "saudi_cr", "saudi_vat", "saudi_passport",
    "saudi_border_number", "saudi_national_address", "saudi_unified_number", "medical_record_number", "email", "credit_card",
    "ip_address", "arabic_name", "suspicious_domain", "custom",
)

LEVELS = ("public", "confidential", "secret", "top_secret")
LEVEL_LABELS_AR = {"public": "عام", "confidential": "سري/مقيّد", "secret": "سري", "top_secret": "سري للغاية"}
LEVEL_OF_CATEGORY = {"sensitive_health": "secret", "organisation": "public", "network": "public", "threat": "public"} | dict.fromkeys(("national_identifier", "financial", "contact", "person"), "confidential")
PERSONAL = ("national_identifier", "financial", "contact", "sensitive_health", "person")

#: Names that another personal-data tool uses for the same types; types without one aren't passed on.
EXTERNAL_NAMES = {
    "saudi_national_id": "SA_NATIONAL_ID", "saudi_iqama": "SA_IQAMA", "saudi_iban": "SA_IBAN", "saudi_mobile": "SA_PHONE_NUMBER", "saudi_landline": "SA_PHONE_NUMBER",
    "saudi_cr": "SA_CR", "saudi_vat": "SA_VAT", "saudi_passport": "SA_PASSPORT", "saudi_border_number": "SA_BORDER_NUMBER",
    "saudi_national_address": "SA_NATIONAL_ADDRESS", "saudi_unified_number": "SA_UNIFIED_NUMBER", "medical_record_number": "MEDICAL_RECORD_NUMBER",
    "arabic_name": "PERSON", "suspicious_domain": "SUSPICIOUS_DOMAIN",
}
EXTERNAL_SCORES = {"high": 0.95, "medium": 0.6, "low": 0.4}

#: What people call a type, where its own name in capitals and blanks won't do.
_CALLED = (
    ("Unified Number (700)", "unified_number"), ("Border / Visa Number", "border_number"), ("National Address", "national_address"), ("Passport", "passport"), ("VAT / Tax Number", "vat"),
    ("Commercial Registration", "cr"), ("Saudi Landline", "landline"), ("Saudi Mobile", "mobile"), ("Saudi IBAN", "iban"), ("Saudi Iqama", "iqama"), ("Saudi National ID", "national_id"),
)
DISPLAY_NAMES = {f"saudi_{kind}": said for said, kind in _CALLED} | {"ip_address": "IP Address"}
