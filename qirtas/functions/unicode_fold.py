"""Normalization against evasion, with a map back to the offsets of the original.

Rows of ASCII alone are left as they are. One-to-one folds (digits, compatibility forms) can't move an offset; only for
texts that hold a character to strip or to expand ``src`` has the original index of every character left.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ARABIC_DIGITS = "".join(chr(c) for c in range(0x660, 0x66A))
PERSIAN_DIGITS = "".join(chr(c) for c in range(0x6F0, 0x6FA))


@cache
def tables() -> tuple[str, str, str, dict[str, str]]:
    """From and to of the one-to-one folds, the characters to strip, and the expansions."""
    src, to, strip, expand = [], [], ["­", "᠎"], {}
    for c in map(chr, range(sys.maxunicode + 1)):
        kind = unicodedata.category(c)
        if kind == "Cs":
            continue
        if kind == "Cf":
            strip.append(c)
        elif c in ARABIC_DIGITS or c in PERSIAN_DIGITS:
            src.append(c)
            to.append(str(unicodedata.digit(c)))
        elif c > "\x7f" and (n := unicodedata.normalize("NFKC", c)) != c:
            if len(n) == 1:
                src.append(c)
                to.append(n)
            elif n:
                expand[c] = n
            else:
                strip.append(c)
    return "".join(src), "".join(to), "".join(dict.fromkeys(strip)), expand


@cache
def other_digits() -> tuple[str, str]:
    """Decimal digits of all scripts but ASCII, and their values."""
    found = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def ascii_digits(x: Column) -> Column:
    return F.translate(x, *other_digits())


def fold_arabic_digits(x: Column) -> Column:
    return F.translate(x, ARABIC_DIGITS, "0123456789")


def normalized(text: Column) -> Column:
    """struct(text, src): the folded text, and the original index of each of its characters (null: its own)."""
    foreign = text.rlike("[^\\x00-\\x7f]")  # all other rows stay as they are
    own = F.struct(text.alias("text"), F.lit(None).cast("array<int>").alias("src"))
    return F.when(foreign, F.arrow_udf(_fold_all, "struct<text:string,src:array<int>>")(F.when(foreign, text))).otherwise(own)


def _fold_all(text: pa.Array) -> pa.Array:
    from .plain import fold

    done = [(None, None) if t is None else fold(t) for t in text.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([t for t, _ in done], pa.string()), pa.array([src for _, src in done], pa.list_(pa.int32()))], names=["text", "src"])


def original_start(src: Column, start: Column) -> Column:
    return F.when(src.isNull(), start).otherwise(F.get(src, start))


def original_end(src: Column, start: Column, end: Column) -> Column:
    """End of a span in the original: behind the source of the last character; for an empty span its start."""
    return F.when(src.isNull(), end).when(end > start, F.get(src, end - 1) + 1).otherwise(F.get(src, start))
