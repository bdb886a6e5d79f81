"""Lookalike domains: hosts in text, confusable skeletons, mixed scripts, and joins with a watchlist.

Skeletons are joined on equality. For typing errors both sides are joined on what is left after deleting up to
``k`` characters, which two strings within distance ``k`` always have in common, and the pairs are then measured:
an equi-join in place of comparing every host with every watched name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import S, W, spans
from .detectors import Detector

_IN = f"[^{S}/@:]"
#: One dot is enough in the pattern: the class before it holds dots too.
DOMAIN = f"(?<![{W}@.\\-])(?:https?://)?{_IN}+\\.[^{S}/@:.]{{2,}}"

#: What looks like each character.
_LOOKS_LIKE = {
    "a": "аαａ", "b": "вｂ8٨۸", "c": "сｃ", "d": "ԁｄ", "e": "еεｅ", "g": "ɡｇ", "h": "н", "i": "іιｉ", "j": "јｊ", "k": "кκ", "l": "ӏӀⅼｌ1|I١۱", "m": "мｍ", "n": "ｎ",
    "o": "оοｏ0٠۰", "p": "рρｐ", "r": "ｒ", "s": "ѕｓ5٥۵", "t": "тτｔ", "u": "υｕ", "v": "ν", "x": "хχｘ", "y": "у",
    "2": "٢۲", "3": "٣۳", "4": "٤۴", "6": "٦۶", "7": "٧۷", "9": "٩۹",
}
CONFUSABLES = {c: to for to, many in _LOOKS_LIKE.items() for c in many}

SCRIPTS = {
    "Arabic": "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿", "Cyrillic": "Ѐ-ԯ", "Greek": "Ͱ-Ͽἀ-῿",
    "Han": "一-鿿", "Hebrew": "֐-׿", "Kana": "぀-ヿ", "Latin": "A-Za-zÀ-ɏ",
}


def skeleton(x: Column, confusables: Mapping[str, str] | None = None) -> Column:
    """Lower case, with every character as the one it looks like. Own mappings are added, and win."""
    table = CONFUSABLES | dict(confusables or {})
    one = {k: v for k, v in table.items() if len(k) == 1 and len(v) == 1}
    out = F.translate(F.lower(x), "".join(one), "".join(one.values()))
    for k, v in table.items():
        if k not in one:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def scripts_in(x: Column) -> Column:
    """The scripts of a string, by name; digits and punctuation have none."""
    return F.filter(F.array(*[F.when(x.rlike(f"[{c}]"), n) for n, c in SCRIPTS.items()]), lambda s: s.isNotNull())


def is_mixed(label: Column) -> Column:
    return F.size(scripts_in(label)) >= 2


def script_of(c: Column) -> Column:
    out = F.when(c.rlike(f"^[{SCRIPTS['Arabic']}]"), "Arabic")
    for n, chars in SCRIPTS.items():
        out = out.when(c.rlike(f"^[{chars}]"), n)
    return out.otherwise("Common")


def decoded(host: Column) -> Column:
    """Punycode labels as Unicode, as far as they can be read."""
    return F.when(F.lower(host).contains("xn--"), F.java_method(F.lit("java.net.IDN"), F.lit("toUnicode"), host, F.lit(1))).otherwise(host)


def distance(a: Column, b: Column) -> Column:
    """Optimal string alignment distance: Levenshtein's and swaps of neighbours."""
    return F.arrow_udf(_apart_all, "int")(a, b)


def _apart_all(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else _apart(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def within(a: Column, b: Column, k: int) -> Column:
    """Whether the distance is at most ``k``; the plain distance with its threshold decides most pairs."""
    close = F.levenshtein(a, b, k) >= 0
    open_ = ~close & (F.abs(F.length(a) - F.length(b)) <= k) & (F.levenshtein(a, b, 2 * k) >= 0)
    return F.when(a.isNotNull() & b.isNotNull(), close | F.coalesce(distance(F.when(open_, a), F.when(open_, b)) <= k, F.lit(False)))


def deletions(x: Column, k: int) -> Column:
    """What is left of a string after deleting up to ``k`` characters."""
    out = level = F.array(x)
    for _ in range(k):
        level = F.array_distinct(F.flatten(F.transform(level, lambda v: F.when(F.length(v) > 0, F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1)))).otherwise(F.array(v)))))
        out = F.array_union(out, level)
    return out


def domains_in(text: Column) -> Column:
    """array<struct<start, end, value>> of the hosts in a text, without their scheme."""
    found = spans(text, DOMAIN, 0, text.contains("."))
    bare = F.transform(found, lambda m: F.struct(m["end"].alias("end"), F.regexp_replace(m["value"], "^(?i)https?://", "").alias("value")))
    return F.transform(bare, lambda m: F.struct((m["end"] - F.length(m["value"])).alias("start"), m["end"].alias("end"), m["value"].alias("value")))


def domains(df: DataFrame, keys: Sequence[str], column: str = "text") -> DataFrame:
    """The key columns, domain, start and end of every host in ``column``."""
    return df.select(*keys, F.inline(domains_in(F.col(column)))).select(*keys, F.col("value").alias("domain"), "start", "end")


def analysed(hosts: DataFrame, watchlist: DataFrame | None = None, *, max_distance: int = 1, confusables: Mapping[str, str] | None = None) -> DataFrame:
    """domain, reason, confidence, target, detail for every distinct ``domain`` of ``hosts`` that has a finding.

    ``watchlist`` has a column ``target``. A host that is a watched name (in either form) isn't held against it.
    """
    one = hosts.select("domain").where("domain is not null").distinct().withColumn("_d", decoded(F.col("domain")))
    one = one.withColumn("_skel", skeleton(F.col("_d"), confusables))
    mixed = F.filter(F.split("_d", r"\."), is_mixed)
    mixing = one.where(F.size(mixed) > 0).select("domain", F.lit("mixed_script").alias("reason"), F.lit("medium").alias("confidence"), F.lit(None).cast("string").alias("target"), F.get(mixed, F.lit(0)).alias("_l"))
    mixing = mixing.select("domain", "reason", "confidence", "target", F.concat(F.lit("label '"), F.col("_l"), F.lit("' is in "), F.array_join(scripts_in(F.col("_l")), " and ")).alias("detail"))
    if watchlist is None:
        return mixing
    watch = watchlist.select("target").where("target is not null").distinct().withColumn("_tskel", skeleton(decoded(F.col("target")), confusables))
    own = (F.lower("target") == F.lower("_d")) | (F.lower("target") == F.lower("domain"))
    same = one.join(watch, F.col("_skel") == F.col("_tskel")).where(~own)
    same = same.select("domain", F.lit("impersonation").alias("reason"), F.lit("high").alias("confidence"), "target", F.concat(F.lit("looks the same as "), F.col("target")).alias("detail"))
    near = one.withColumn("_v", F.explode(deletions(F.col("_skel"), max_distance))).join(watch.withColumn("_v", F.explode(deletions(F.col("_tskel"), max_distance))), "_v")
    near = near.where((F.col("_skel") != F.col("_tskel")) & ~own).select("domain", "target", "_skel", "_tskel").distinct().where(within(F.col("_skel"), F.col("_tskel"), max_distance))
    near = near.select("domain", F.lit("typosquat").alias("reason"), F.lit("medium").alias("confidence"), "target", F.concat(F.lit(f"at most {max_distance} edits from "), F.col("target")).alias("detail"))
    return same.unionByName(near).unionByName(mixing.join(same.select("domain").distinct(), "domain", "left_anti"))


def suspicious(df: DataFrame, keys: Sequence[str], column: str = "text", watchlist: DataFrame | None = None, **options) -> DataFrame:
    """Every suspicious host in ``column`` with its place: distinct hosts are analysed once and joined back."""
    found = domains(df, keys, column)
    return found.join(analysed(found, watchlist, **options), "domain").select(*keys, "domain", "reason", "confidence", "target", "detail", "start", "end")


_FOUND = re.compile(r"(?<![\w@.\-])(?:https?://)?[^\s/@:]+\.[^\s/@:.]{2,}")
_SCHEME = re.compile("(?i)https?://")
_SCRIPTS = {n: re.compile(f"[{c}]") for n, c in SCRIPTS.items()}


def _bare(host: str) -> str:
    """What ``decoded`` does to a column."""
    if "xn--" not in host.lower():
        return host
    labels = []
    for x in host.split("."):
        try:
            own = x.lower().startswith("xn--")
            labels.append(bytes(x[4:], "ascii").decode("punycode") if own else x)
        except UnicodeError:
            labels.append(x)
    return ".".join(labels)


def _skeletons(confusables: Mapping[str, str] | None = None) -> Callable[[str], str]:
    """What ``skeleton`` does to a column."""
    table = CONFUSABLES | dict(confusables or {})
    one = {ord(k): v for k, v in table.items() if len(k) == 1 and len(v) == 1}
    more = [(k, v) for k, v in table.items() if len(k) != 1 or len(v) != 1]

    def skeleton_of(x: str) -> str:
        out = x.lower().translate(one)
        for k, v in more:
            out = out.replace(k, v)
        return out

    return skeleton_of


def _left(x: str, k: int) -> set[str]:
    """What is left of a string after deleting up to ``k`` characters."""
    out = level = {x}
    for _ in range(k):
        level = {v[:i] + v[i + 1 :] for v in level for i in range(len(v))}
        out = out | level
    return out


def _apart(a: str, b: str) -> int:
    """What ``distance`` is for columns: the matrix of differences a row at a time, its cells the bits of numbers (Hyyrö 2003)."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last, d = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down, zero, before = full, 0, 0, 0  # where a cell is one more or less than that above, or as much as that above and left
    for y in b:
        same = places.get(y, 0)
        swap = ((~zero & same) << 1) & before
        zero = ((((same & up) + up) ^ up) | same | down | swap) & full
        right, left = down | (full & ~(zero | up)), zero & up
        d += bool(right & last) - bool(left & last)
        right, left = right << 1 | 1, left << 1
        up, down, before = (left | ~(zero | right)) & full, right & zero, same
    return d


#: Hosts whose verdict is kept.
_KNOWN = 1 << 14


def lookalike(watchlist: Sequence[str] = (), *, max_distance: int = 1, confusables: Mapping[str, str] | None = None) -> list[Detector]:
    """Detectors for a scan, with a watchlist of a modest size: first what looks the same, then what is merely near or mixed.

    Names are found by skeleton and, for typing errors, by what is left of it after deletions: one look-up each.
    """
    skeleton_of = _skeletons(confusables)
    skeletons: dict[str, list[str]] = {}
    pieces: dict[str, list[tuple[str, str]]] = {}
    for w in dict.fromkeys(watchlist):
        s = skeleton_of(_bare(w))
        skeletons.setdefault(s, []).append(w.lower())
        for x in _left(s, max_distance):
            pieces.setdefault(x, []).append((w.lower(), s))

    def same(own: tuple[str, str], plain: str, skel: str) -> bool:
        return any(w not in own for w in skeletons.get(skel, ()))

    def near(own: tuple[str, str], plain: str, skel: str) -> bool:
        if not plain.isascii() and any(sum(bool(c.search(label)) for c in _SCRIPTS.values()) > 1 for label in plain.split(".")):
            return True
        close = {c for x in _left(skel, max_distance) for c in pieces.get(x, ())} if pieces else ()
        return any(w not in own and _apart(s, skel) <= max_distance for w, s in close)

    def finder(test):
        known: dict[str, bool] = {}  # hosts come again and again

        def suspected(host: str) -> bool:
            if host not in known:
                if len(known) >= _KNOWN:
                    known.clear()
                plain = _bare(host)
                known[host] = test((plain.lower(), host.lower()), plain, skeleton_of(plain))
            return known[host]

        def find(text: str) -> list[tuple[int, int, str, str]]:
            if "." not in text:
                return []
            out = []
            for m in _FOUND.finditer(text):
                host = _SCHEME.sub("", m.group(), count=1) if _SCHEME.match(m.group()) else m.group()
                if suspected(host):
                    out.append((m.end() - len(host), m.end(), host, "suspicious_domain"))
            return out

        return find

    return [
        Detector("lookalike_domain", "threat", confidence, "", python=finder(test), seen=r"[.]", notes=notes)
        for confidence, test, notes in (("high", same, "looks the same as a watched domain"), ("medium", near, "near a watched domain, or of mixed scripts"))
    ]
