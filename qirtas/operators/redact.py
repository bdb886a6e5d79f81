"""Redaction: five modes over resolved findings, and the way back from tokens. One row at a time, no shuffle."""

from __future__ import annotations

import hashlib
import hmac
import html
import itertools
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("hash", "mask", "partial", "remove", "tokenize")


def label_of(m: Column) -> Column:
    """What a finding is called: its label, if it has one, else its type."""
    return F.coalesce(F.nullif(m["label"], F.lit("")), m["entity_type"])


def hashed(value: Column, salt: str, length: int = 12) -> Column:
    """``[HASH:...]`` with the first ``length`` hex digits of HMAC-SHA256 under ``salt``."""
    if not salt:
        raise ValueError("hashing needs a salt: short identifiers could be found by trying them all")
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)
    return F.concat(F.lit("[HASH:"), F.substring(digest, 1, length), F.lit("]"))


def partly(value: Column, keep_last: int = 4, fill: str = "*") -> Column:
    """All but the last characters filled. With nothing to fill, the value as it is."""
    n = F.length(value)
    if keep_last <= 0:
        return F.repeat(F.lit(fill), n)
    return F.when(n <= keep_last, value).otherwise(F.concat(F.repeat(F.lit(fill), n - keep_last), F.right(value, F.lit(keep_last))))


Item = tuple[str, str, str, str, str, int, int]  # type, category, confidence, original, replacement, start, end


def redact_text(text: str, found: list[dict], mode: str, salt: str = "", hash_length: int = 12, keep_last: int = 4, fill: str = "*") -> tuple[str, list[Item], dict[str, str]]:
    """The text with every finding replaced, the items by start, and the vault (empty but for tokens): one pass over both."""
    safe, end = [], -1
    for m in sorted(found, key=lambda m: m["start"]):
        if m["start"] >= end:
            safe.append(m)
            end = m["end"]
    name = lambda m: m["label"] or m["entity_type"]
    tokens: dict[tuple[str, str], str] = {}
    vault: dict[str, str] = {}
    if mode == "tokenize":  # one for each name and original, numbered from the right
        count: dict[str, int] = {}
        for m in reversed(safe):
            key = (name(m), text[m["start"] : m["end"]])
            if key not in tokens:
                count[key[0]] = n = count.get(key[0], 0) + 1
                tokens[key] = f"<{key[0].upper()}_{n}>"
                vault[tokens[key]] = key[1]
    out, items, at = [], [], 0
    for m in safe:
        start, end = m["start"], m["end"]
        original, value = text[start:end], m["value"]
        if mode == "mask":
            new = f"[{name(m).upper()}]"
        elif mode == "remove":
            new = ""
        elif mode == "hash":
            new = f"[HASH:{hmac.new(salt.encode(), value.encode('utf-8', 'replace'), hashlib.sha256).hexdigest()[:hash_length]}]"
        elif mode == "partial":
            shown = value[max(0, len(value) - keep_last) :] if keep_last > 0 else ""
            new = shown.rjust(len(value), fill) if len(fill) == 1 else fill * (len(value) - len(shown)) + shown
        else:
            new = tokens[name(m), original]
        out += [text[at:start], new]
        items.append((m["entity_type"], m["category"], m["confidence"], original, new, start, end))
        at = end
    return "".join([*out, text[at:]]), items, vault


_ITEMS = "array<struct<entity_type:string,category:string,confidence:string,original:string,replacement:string,start:int,end:int>>"
_AT_ONCE = 512


def _rows_of(found: pa.Array) -> list[list[dict] | None]:
    """The findings of each row; column by column, since nested values are slow to convert one by one."""
    flat = found.flatten()
    names = [f.name for f in flat.type]
    every = iter([dict(zip(names, v)) for v in zip(*(c.to_pylist() for c in flat.flatten()))])
    return [None if n is None else list(itertools.islice(every, n)) for n in pc.list_value_length(found).to_pylist()]


def _redactor(**options):
    kinds = [pa.string()] * 5 + [pa.int32()] * 2
    item = pa.struct(list(zip(("entity_type", "category", "confidence", "original", "replacement", "start", "end"), kinds)))

    def redact(text: pa.Array, found: pa.Array) -> pa.Array:
        parts = []
        for lo in range(0, max(1, len(text)), _AT_ONCE):
            rows = [("", [], {}) if t is None else redact_text(t, f or [], **options) for t, f in zip(text.slice(lo, _AT_ONCE).to_pylist(), _rows_of(found.slice(lo, _AT_ONCE)))]
            flat = list(zip(*(i for _, items, _ in rows for i in items))) or [()] * 7
            offsets = [0]
            for _, items, _ in rows:
                offsets.append(offsets[-1] + len(items))
            structs = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds)], fields=list(item))
            vault = pa.array([list(v.items()) for _, _, v in rows], pa.map_(pa.string(), pa.string()))
            parts.append(pa.StructArray.from_arrays([pa.array([t for t, _, _ in rows], pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), vault], names=["text", "items", "vault"]))
        return pa.concat_arrays(parts)

    return F.arrow_udf(redact, f"struct<text:string,items:{_ITEMS},vault:map<string,string>>")


def redacted(
    df: DataFrame, column: str = "text", found: str = "findings", mode: str = "mask", *, salt: str = "", hash_length: int = 12, keep_last: int = 4, fill: str = "*", name: str = "redaction"
) -> DataFrame:
    """``df`` with a struct of the redacted text, the items (by start), the vault (empty but for tokens) and the count of items.

    Items carry the original span; hashing and partial masking work on the normalized value.
    """
    out = parts(df, column, found, mode, salt=salt, hash_length=hash_length, keep_last=keep_last, fill=fill, name="_qirtas_r")
    made = F.struct(*[F.col(f"_qirtas_r_{x}").alias(x) for x in ("text", "items", "vault")], F.size("_qirtas_r_items").alias("count"))
    return out.withColumn(name, made).drop("_qirtas_r_text", "_qirtas_r_items", "_qirtas_r_vault")


def parts(df: DataFrame, column: str, found: str, mode: str, *, salt: str = "", hash_length: int = 12, keep_last: int = 4, fill: str = "*", name: str) -> DataFrame:
    """As ``redacted``, in columns of their own: ``name`` with _text, _items and _vault."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if mode == "hash" and not salt:
        hashed(F.lit(""), salt)
    text, given = F.col(column), F.col(found)
    some = F.size(given) > 0  # all other rows stay in the JVM
    made = _redactor(mode=mode, salt=salt, hash_length=hash_length, keep_last=keep_last, fill=fill)(F.when(some, text), F.when(some, given))
    out = df.withColumn("_qirtas_made", made)
    new = F.col("_qirtas_made")
    items, vault = F.array().cast(_ITEMS), F.create_map().cast("map<string,string>")
    made = {f"{name}_text": F.when(some, new["text"]).otherwise(text), f"{name}_vault": F.when(some, new["vault"]).otherwise(vault), f"{name}_items": F.when(some, new["items"]).when(given.isNotNull(), items)}
    return out.withColumns(made).drop("_qirtas_made")


def restore_text(text: str, vault: dict[str, str]) -> str:
    """Tokens replaced by what the vault has for them, the longest first."""
    if all(_TOKEN.fullmatch(k) for k in vault) and not any("<" in v or ">" in v for v in vault.values()):
        return _TOKEN.sub(lambda m: vault.get(m.group(), m.group()), text)  # then the order doesn't matter, and one pass does
    for k in sorted(vault, key=len, reverse=True):
        text = text.replace(k, vault[k])
    return text


_TOKEN = re.compile("<[^<>]*>")


def _restore(text: pa.Array, vault: pa.Array) -> pa.Array:
    return pa.array([None if t is None or v is None else restore_text(t, dict(v)) for t, v in zip(text.to_pylist(), vault.to_pylist())], pa.string())


def restored(text: Column, vault: Column) -> Column:
    some = F.size(vault) > 0
    return F.when(some, F.arrow_udf(_restore, "string")(F.when(some, text), F.when(some, vault))).when(vault.isNotNull(), text)


def highlight_text(text: str, found: list[dict]) -> str:
    out, at = [], 0
    for m in sorted(found, key=lambda m: m["start"]):
        if m["start"] >= at:
            out += [html.escape(text[at : m["start"]]), '<mark title="', html.escape(m["label"] or m["entity_type"]), '">', html.escape(text[m["start"] : m["end"]]), "</mark>"]
            at = m["end"]
    return "".join([*out, html.escape(text[at:])]).replace("\n", "<br>")


def _highlight(text: pa.Array, found: pa.Array) -> pa.Array:
    return pa.array([None if t is None or f is None else highlight_text(t, f) for t, f in zip(text.to_pylist(), _rows_of(found))], pa.string())


def highlighted(text: Column, found: Column) -> Column:
    """HTML of the text with every finding in a ``<mark>`` that names its type."""
    return F.arrow_udf(_highlight, "string")(text, found)
