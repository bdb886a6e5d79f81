"""The checks of ``checks`` for Python values, and folding with a map back: what detection calls match by match."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from functools import cache

from .unicode_fold import ARABIC_DIGITS, tables

_TWICE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(x: str) -> bool:
    """False for anything but one digit or more, of any script."""
    if not x.isdecimal():
        return False
    digits = [int(c) for c in x] if not x.isascii() else [b - 48 for b in x.encode()]
    return (sum(digits[-1::-2]) + sum([_TWICE[d] for d in digits[-2::-2]])) % 10 == 0


def national_id(x: str) -> bool:
    return len(x) == 10 and x[0] in "12" and luhn(x)


_IBAN = re.compile(r"[A-Z]{2}\d{2}[\dA-Z]+")
_VALUES = {c: str(c - 55) for c in range(65, 91)}  # A = 10


def iban(x: str) -> bool:
    """Mod-97 check of an IBAN of any country, with or without spaces."""
    c = x.replace(" ", "").upper()
    return _IBAN.fullmatch(c) is not None and mod97(c[4:] + c[:4]) == 1


def mod97(x: str) -> int | None:
    """The remainder by 97 of digits and capital letters (A = 10); None where there is anything else."""
    number = x.translate(_VALUES)
    return int(number) % 97 if number.isdecimal() else None


def ip(x: str) -> bool:
    try:
        ipaddress.ip_address(x)
    except ValueError:
        return False
    return "%" not in x and not (":" in x and "." in x)


@cache
def _folds() -> tuple[frozenset[str], frozenset[str], dict[int, str | None], dict[str, int]]:
    """What any fold touches, what moves offsets, the translation, and the lengths that aren't 1."""
    src, to, strip, expand = tables()
    table = str.maketrans(src, to, strip) | {ord(c): n for c, n in expand.items()}
    return frozenset(src) | frozenset(strip) | frozenset(expand), frozenset(strip) | frozenset(expand), table, dict.fromkeys(strip, 0) | {c: len(n) for c, n in expand.items()}


def _places(text: str, c: str) -> Iterator[int]:
    at = text.find(c)
    while at >= 0:
        yield at
        at = text.find(c, at + 1)


def fold(text: str) -> tuple[str, list[int] | None]:
    """The folded text, and the original index of each of its characters (None: its own)."""
    if text.isascii():
        return text, None
    touched, moved, table, size = _folds()
    chars = set(text)
    if touched.isdisjoint(chars):
        return text, None
    out = text.translate(table)
    if moved.isdisjoint(chars):
        return out, None
    src: list[int] = []
    at = 0
    for i in sorted(i for c in moved & chars for i in _places(text, c)):
        src += range(at, i)
        src += [i] * size[text[i]]
        at = i + 1
    src += range(at, len(text))
    return out, src


_ARABIC = str.maketrans(ARABIC_DIGITS, "0123456789")


def fold_arabic(text: str) -> str:
    return text if text.isascii() else text.translate(_ARABIC)
