"""Declarative detectors: what to look for, how to check it and what to call it.

A ``Detector`` has a pattern (Python's syntax), perhaps near a keyword. ``find`` gives its matches in normalized text;
it runs inside the one Arrow UDF of a scan. Most patterns begin a fixed way from a run of digits, so they are tried there
only: the runs of a text are found once for all detectors. Order matters: it breaks ties between equal findings.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache

from pyspark.sql import Column

from ..functions import plain

#: A keyword counts if it ends or starts at most so many characters from the number's other edge.
REACH = 40

RAW = "array<struct<start:int,end:int,value:string,type:string>>"

Match = tuple[int, int, str, str]  # start, end, value, type


@lru_cache(maxsize=512)
def compiled(pattern: str):
    """``pattern`` for searching; one that names Unicode properties needs the ``regex`` package."""
    if "\\p{" in pattern or "\\P{" in pattern:
        import regex

        return regex.compile(pattern)
    return re.compile(pattern)


_DIGITS = re.compile(r"\d+")
_MOST = 63


class Text:
    """A normalized text and what several detectors ask of it, found when first asked for."""

    def __init__(self, text: str, folded: str):
        self.text, self.folded = text, folded

    @cached_property
    def runs(self) -> list[tuple[int, int]]:
        """The runs of digits: start and length."""
        return [(m.start(), m.end() - m.start()) for m in _DIGITS.finditer(self.text)]

    @cached_property
    def lengths(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for s, n in self.runs:
            out.setdefault(n, []).append(s)
        return out

    def starts(self, least: int, most: int) -> list[int]:
        """Where runs of so many digits start, in order."""
        some = [x for n, x in self.lengths.items() if least <= n <= most]
        return some[0] if len(some) == 1 else sorted(s for x in some for s in x)

    @cached_property
    def sizes(self) -> int:
        """A bit for each length that a run has, the last for longer ones too."""
        out = 0
        for _, n in self.runs:
            out |= 1 << (n if n < _MOST else _MOST)
        return out

    def joined(self, digits: int, most: int) -> list[int]:
        """Where runs of at most ``most`` digits start that are in a row of so many digits, one space or hyphen between runs."""
        out: list[int] = []
        row: list[int] = []
        total, end = 0, -2
        for s, n in self.runs:
            if s != end + 1 or self.text[end] not in " -":
                if total >= digits:
                    out += row
                row, total = [], 0
            if n <= most:
                row.append(s)
            total, end = total + n, s + n
        return out + row if total >= digits else out

    @cached_property
    def caseless(self) -> str:
        return self.folded.casefold()


@dataclass(frozen=True)
class Detector:
    name: str
    category: str
    confidence: str
    pattern: str
    type: str | None = None  # the name, if not given
    keyword: str | None = None
    hints: tuple[str, ...] = ()  # of which any text with a keyword has one, whatever the case
    words: tuple[str, ...] = ()  # of which any text with a match has one, whatever the case
    runs: tuple[int, int] | None = None  # a match begins before or at a run of at least and at most so many digits,
    unless: str | None = None  # but for texts in which this is found
    before: tuple[int, ...] = (0,)  # how many characters before it, the most first
    digits: int = 0  # so many digits are in a match, in runs with one space or hyphen between
    marks: tuple[tuple[str, int], ...] = ()  # of which any match has one so many times
    seen: str | None = None  # a Java pattern that any ASCII text with a match has; rows without any detector's stay in the JVM
    group: int = 0
    fold_digits: bool = False
    value: Callable[[str], str] | None = None  # from the matched text
    valid: Callable[[str], bool] | None = None  # of the value
    type_of: Callable[[str], str] | None = None
    python: Callable[[str], Iterable[Match]] | None = None  # the whole search, for what one pattern can't say
    custom: Callable[[Column], Column] | None = None  # the same as an expression over normalized text, an array like RAW
    label: str = ""
    notes: str = ""

    @cached_property
    def _rx(self):
        return compiled(self.pattern)

    @cached_property
    def sizes(self) -> int:
        """Of the bits of ``Text.sizes`` any text with a match has one of these; 0 if none is needed."""
        if self.runs is None or self.unless or self.python is not None:
            return 0
        return sum(1 << n for n in range(self.runs[0], min(self.runs[1], _MOST) + 1))

    def _barred(self, text: Text, t: str) -> bool:
        """Whether a few cheap looks tell that there is nothing."""
        if self.marks and not any(t.count(c) >= n for c, n in self.marks):
            return True
        if self.words and not any(w in text.caseless for w in self.words):
            return True
        return bool(self.keyword and self.hints) and not any(h in text.caseless for h in self.hints)

    def _matches(self, text: Text, t: str) -> Iterable[re.Match]:
        if self.runs is None or self.unless and compiled(self.unless).search(t):
            return self._rx.finditer(t)
        out, end, match = [], 0, self._rx.match
        for s in text.joined(self.digits, self.runs[1]) if self.digits else text.starts(*self.runs):
            for k in self.before:
                if s - k >= end and (m := match(t, s - k)):
                    end = m.end()
                    out.append(m)
                    break
        return out

    def find(self, text: Text) -> Iterable[Match]:
        """What there is in a text; one without any of ``sizes`` has nothing."""
        if self.python is not None:
            return self.python(text.text)
        t = text.folded if self.fold_digits else text.text
        if self._barred(text, t):
            return ()
        found = self._matches(text, t)
        if self.keyword:
            found = list(found)
            if not found:
                return ()
            near = [m.span() for m in compiled(self.keyword).finditer(t)]
            if not near:
                return ()
            starts, ends = [s for s, _ in near], [e for _, e in near]

            def close(sorted_: list[int], at: int) -> bool:
                i = bisect_left(sorted_, at - REACH)
                return i < len(sorted_) and sorted_[i] <= at + REACH

            found = (m for m in found if close(ends, m.start()) or close(starts, m.end()))
        kind = self.type or self.name
        out = []
        for m in found:
            v = m.group(self.group)
            if self.value:
                v = self.value(v)
            if self.valid is None or self.valid(v):
                out.append((*m.span(self.group), v, self.type_of(v) if self.type_of else kind))
        return out


_SPACE = re.compile(r"\s")


def _compact(v: str) -> str:
    return _SPACE.sub("", v).upper()


_LETTERS = "A-Za-z"


def _apart(inner: str, edge: str = r"\d") -> str:
    """``inner`` between characters that aren't of the class ``edge``."""
    return f"(?<![{edge}]){inner}(?![{edge}])"


def _phrases(*some: str) -> str:
    """Any of some phrases in any case; ``_`` stands for white space and ``~`` for white space or nothing."""
    return "(?i)(?:" + "|".join(x.replace("_", r"\s+").replace("~", r"\s*") for x in some) + ")"


_TEN = _apart(r"\d{10}")
_PHONE = r"(?:0|(?:\+|00)?966)"
_WORD_EDGE = f"{_LETTERS}0-9"

NATIONAL_ID = Detector(
    "saudi_national_id", "national_identifier", "high", _apart(r"[12]\d{9}"), runs=(10, 10), seen="[0-9]{10}", fold_digits=True,
    valid=plain.national_id, type_of=lambda v: "saudi_iqama" if v[0] == "2" else "saudi_national_id",
    notes="check digit holds; no registry was asked",
)
IBAN = Detector(
    "saudi_iban", "financial", "high", "(?i)" + _apart(r"SA\d\d" + r"(?:\s?[\dA-Z])".replace(r"\d", "0-9") + "{20}", "0-9A-Z"), runs=(2, 10**9), before=(2,), words=("sa",), seen="[aA][0-9]{2}",
    value=_compact, valid=lambda v: len(v) == 24 and plain.iban(v), notes="mod-97 check holds",
)
MOBILE = Detector("saudi_mobile", "contact", "medium", _apart(_PHONE + r"5\d{8}"), runs=(10, 14), before=(1, 0), seen="[0-9]{10}", fold_digits=True, notes="by format alone; mobile numbers have no check digit")
LANDLINE = Detector("saudi_landline", "contact", "medium", _apart(_PHONE + r"1[1-7]\d{7}"), runs=(10, 14), before=(1, 0), seen="[0-9]{10}", fold_digits=True, notes="by format alone; landlines have no check digit")
CR = Detector(
    "saudi_cr", "organisation", "low", _TEN, runs=(10, 10), seen="[0-9]{10}", fold_digits=True, hints=("cr", "c.r", "commercial", "سجل", "س.ت", "ست"),
    keyword=_phrases(r"C\.?R\.?", "commercial_registration", "سجل~تجاري", r"س\.?ت\.?"), notes="by format and keyword; no check digit is public",
)
VAT = Detector(
    "saudi_vat", "financial", "medium", _apart(r"\d{15}"), runs=(15, 15), seen="[0-9]{15}", fold_digits=True, hints=("vat", "trn", "tax", "الضريبي", "ضريب"),
    keyword=_phrases("VAT", "TRN", "tax_id", "tax_number", "tax_registration", "الرقم~الضريبي", "ضريب"), notes="by format and keyword; tax numbers have no public check digit",
)
PASSPORT = Detector(
    "saudi_passport", "national_identifier", "low", _apart(rf"[{_LETTERS}]\d{{8}}", _WORD_EDGE), runs=(8, 8), before=(1,), seen="[0-9]{8}", hints=("passport", "جواز"),
    keyword=_phrases("passport", "جواز~سفر", "جواز", "رقم~الجواز"), notes="by format and keyword; passports have no public check digit",
)
BORDER = Detector(
    "saudi_border_number", "national_identifier", "low", _TEN, runs=(10, 10), seen="[0-9]{10}", fold_digits=True, hints=("border", "visa", "الحدود", "تأشير"),
    keyword=_phrases("border~no", "border~number", "رقم~الحدود", "تأشير", "visa~no", "visa~number"), notes="by format and keyword; given to visitors",
)
ADDRESS = Detector(
    "saudi_national_address", "contact", "low", _apart(rf"[{_LETTERS}]{{4}}\d{{4}}", _WORD_EDGE), runs=(4, 4), before=(4,), seen="[A-Za-z]{4}[0-9]{4}", hints=("national", "short", "العنوان", "الرمز", "رمز"),
    keyword=_phrases("national~address", "short~address", "العنوان~الوطني", "الرمز~البريدي", "رمز~المبنى"), notes="by format and keyword; a postal short address",
)
UNIFIED = Detector(
    "saudi_unified_number", "organisation", "low", _apart(r"7\d{9}"), runs=(10, 10), seen="7[0-9]{9}", fold_digits=True, hints=("unified", "الرقم", "700"),
    keyword=_phrases("unified~national~number", "unified~number", "الرقم~الموحد", _apart("700", r"\w")), notes="by format and keyword; an establishment's number",
)
MRN = Detector(
    "medical_record_number", "sensitive_health", "low",
    _phrases("MRN", r"medical_record(?:_no|_number)?\.?", "رقم~(?:ال)?(?:سجل|ملف)(?:~(?:ال)?طبي)?", "(?:ال)?سجل~(?:ال)?طبي") + rf"\s*[\-#:]?\s*([\-{_WORD_EDGE}]{{4,20}})",
    group=1, words=("mrn", "medical", "رقم", "سجل"), seen="[mM](?:[rR][nN]|[eE][dD][iI][cC][aA][lL])", notes="by keyword alone; record numbers have no common format, and this is health data",
)
_LOCAL, _HEX = r"A-Za-z0-9._%+\-", "0-9A-Fa-f:"
EMAIL = Detector("email", "contact", "medium", rf"(?<![{_LOCAL}])[{_LOCAL}]+@[\-.{_WORD_EDGE}]+[.][{_LETTERS}]{{2,}}", words=("@",), seen="@")
CARD = Detector(
    "credit_card", "financial", "high", _apart(r"(?:\d[\- ]?){12,18}\d"), runs=(1, 19), digits=13, seen="(?:[0-9][ \\-]?){12}[0-9]",
    value=lambda v: v.replace(" ", "").replace("-", ""), valid=lambda v: 13 <= len(v) <= 19 and plain.luhn(v), notes="Luhn check holds",
)
IP = Detector("ip_address", "network", "medium", _apart(r"(?:\d{1,3}(?:[.]\d{1,3}){3}" + f"|[{_HEX}]{{2,}}:[{_HEX}]*)", r".\w"), runs=(1, 3), unless=":[0-9A-Fa-f]{0,4}:", marks=((".", 3), (":", 2)), seen=r"[0-9]\.[0-9]+\.[0-9]|:[0-9A-Fa-f]{0,4}:", valid=plain.ip)

SAUDI = (NATIONAL_ID, IBAN, MOBILE, LANDLINE, CR, VAT, PASSPORT, BORDER, ADDRESS, UNIFIED, MRN)
GENERIC = (EMAIL, CARD, IP)

# Arabic names

_AR = "\u0621-\u063a\u0640-\u064a\u0671-\u06d3\u0750-\u077f\u08a0-\u08ff"
_TOKEN = f"[{_AR}]{{2,}}"
_STOP = frozenset((
    "أمس أو إلى اسم الآيبان الإقامة الاقامة الايبان التاريخ التي الجنسية الجوال الحساب الدكتور "
    "الدكتورة الذي الرقم السجل السيد السيدة الطبيب العنوان العيادة القسم المراجع المريض "
    "المستشفى الملف الموظف الموعد الهوية الى اليوم اليومين او بعد تم تمت ثم حضر حيث راجع راجعنا "
    "رقم طبيب على عن غادر غدا في قام قبل قد كان مع من هذا هذه وصل"
).split())
_TRIGGER = (
    # The alternatives begin differently, so their order doesn't matter.
    rf"(?:name|patient\s+name|د\.\s*|ال(?:دكتورة?|سيدة?|طبيب|مراجع|مريض)|طبيب|اسم\s*(?:ال(?:موظف|مراجع|مريض))?)"
    rf"\s*[:：\-]?\s*((?:{_TOKEN}\s+){{0,3}}{_TOKEN})"
)
_PARTICLES = rf"((?:{_TOKEN}\s+)?(?:آل|ابن|أبو|أم|بنت?|عبد\s*[{_AR}]+)(?:\s+{_TOKEN}){{1,3}})"
_ANY_ARABIC, _WORD = re.compile(f"[{_AR}]"), re.compile(r"\S+")
#: Of which any match of the two patterns has one.
_SIGNS = ("name", "د.", "دكتور", "سيد", "طبيب", "مراجع", "مريض", "اسم"), ("آل", "ابن", "أبو", "أم", "بن", "عبد")


def _names(text: str) -> list[Match]:
    """Names behind a trigger, then runs with a particle; stop words at both ends are cut off.

    A run is dropped if it starts inside a name found before it.
    """
    if not _ANY_ARABIC.search(text):
        return []
    taken, out = bytearray(len(text)), []
    for pattern, signs in zip((_TRIGGER, _PARTICLES), _SIGNS):
        if not any(x in text for x in signs):
            continue
        for m in compiled(pattern).finditer(text):
            words = [w.span() for w in _WORD.finditer(text, *m.span(1))]
            while words and text[slice(*words[-1])] in _STOP:
                words.pop()
            lead = 0
            while lead < len(words) and text[slice(*words[lead])] in _STOP:
                lead += 1
            if lead < len(words) and not taken[s := words[lead][0]]:
                e = words[-1][1]
                taken[s:e] = b"\1" * (e - s)
                out.append((s, e, text[s:e], "arabic_name"))
    return out


NAME = Detector("arabic_name", "person", "low", "", python=_names, seen=r"[^\x00-\x7f]", notes="a heuristic on triggers and particles, not a model")

DEFAULT = (*SAUDI, *GENERIC, NAME)


def custom(label: str, pattern: str, category: str = "national_identifier", confidence: str = "medium", notes: str = "") -> Detector:
    """A detector of the user's own pattern (Python's syntax; it must not match the empty string)."""
    from ..schema import CATEGORIES, CONFIDENCE_RANK

    if category not in CATEGORIES or confidence not in CONFIDENCE_RANK:
        raise ValueError(f"no such category or confidence: {category}, {confidence}")
    if compiled(pattern).match(""):
        raise ValueError("the pattern matches the empty string")
    return Detector(f"custom:{label}", category, confidence, pattern, type="custom", label=label, notes=notes or "matched a configured pattern")


_REGISTERED: list[Detector] = []


def register(detector: Detector) -> Detector:
    """Add a detector behind the default ones, for scans built from now on."""
    if not isinstance(detector, Detector):
        raise TypeError("a Detector is needed")
    _REGISTERED.append(detector)
    return detector


def registered() -> list[Detector]:
    return list(_REGISTERED)


def unregister_all() -> None:
    _REGISTERED.clear()


def defaults(disable: tuple[str, ...] | set[str] = ()) -> list[Detector]:
    return [d for d in (*DEFAULT, *_REGISTERED) if d.name not in disable]


def discover(group: str = "qirtas.detectors") -> int:
    """Register the detectors that installed packages offer; only when asked."""
    from importlib.metadata import entry_points

    found = [e.load() for e in entry_points(group=group)]
    for d in found:
        register(d)
    return len(found)


def from_function(name: str, function, type_: str = "custom", category: str = "national_identifier", confidence: str = "medium", label: str = "", notes: str = "") -> Detector:
    """A detector in Python: ``function(text)`` gives (start, end, value) triples; it runs where the built-in ones do."""
    return Detector(name, category, confidence, "", type=type_, label=label, notes=notes, python=lambda text: [(s, e, v, type_) for s, e, v in function(text)])


def relabelled(detector: Detector, **changes) -> Detector:
    return replace(detector, **changes)
