"""Detection: normalize, detect, project back to the original offsets, resolve overlaps. No shuffle, one row at a time.

Rows in which no detector can match stay in the JVM: one regular expression tells. The others go through one Arrow UDF
that runs all detectors over a text and accepts findings in order of rank, each by a binary search among those accepted:
work is in proportion to the text, and the plan has one node whatever the number of detectors.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plain import fold, fold_arabic
from ..functions.unicode_fold import normalized
from ..schema import CONFIDENCE_RANK, FINDINGS
from .detectors import RAW, Detector, Text, defaults

#: Texts that become Python objects at once.
_AT_ONCE = 512

Finding = tuple[int, int, int, str, str]  # start, end, number of the detector, value, type


def resolve(found: list[tuple]) -> list[tuple]:
    """Drop overlaps: higher confidence wins, then length, then the earlier start, then the earlier detector.

    ``found`` has tuples that begin with the sort key (negated rank, negated length, start, detector, sequence) and go on
    with the end; the winners come back by start.
    """
    found.sort()
    starts: list[int] = []
    kept: list[tuple] = []
    for x in found:
        start, end = x[2], x[5]
        i = bisect_right(starts, start)
        if (i and kept[i - 1][5] > start) or (i < len(kept) and starts[i] < end):
            continue
        starts.insert(i, start)
        kept.insert(i, x)
    return kept


def scan_text(text: str, detectors: Sequence[Detector], normalize: bool = True, given: dict[int, list] | None = None, overlaps: bool = False) -> list[Finding]:
    """The resolved findings of a text, or all with ``overlaps``; ``given`` has what expressions found, by number of detector."""
    t, src = fold(text) if normalize else (text, None)
    seen = Text(t, t if normalize else fold_arabic(t))
    found = []
    for k, d in enumerate(detectors):
        if given and k in given:
            some = given[k]
        elif d.sizes and not seen.sizes & d.sizes or not (some := d.find(seen)):
            continue
        rank = -CONFIDENCE_RANK[d.confidence]
        for i, (start, end, value, kind) in enumerate(some):
            if src is not None:  # an end lies behind the source of the last character
                start, end = src[start], src[end - 1] + 1 if end > start else src[start]
            found.append((rank, start - end, start, k, i, end, value, kind))
    return [(x[2], x[5], x[3], x[6], x[7]) for x in (resolve(found) if len(found) > 1 and not overlaps else found)]


def _columns(rows: list[list[Finding] | None], detectors: Sequence[Detector]) -> pa.Array:
    flat = [f for r in rows if r for f in r]
    offsets, at = [], 0
    for r in rows:
        offsets.append(at)
        at += len(r or ())
    start, end, number, value, kind = zip(*flat) if flat else ((),) * 5
    number = pa.array(number, pa.int32())
    said = lambda x: pa.array([getattr(d, x) for d in detectors], pa.string()).take(number)
    parts = [pa.array(kind, pa.string()), said("category"), said("confidence"), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(value, pa.string()), said("name"), said("notes"), said("label")]
    items = pa.StructArray.from_arrays(parts, names=["entity_type", "category", "confidence", "start", "end", "value", "detector", "notes", "label"])
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), items, mask=pa.array([r is None for r in rows], pa.bool_()))


def _udf(detectors: Sequence[Detector], normalize: bool, overlaps: bool = False) -> Callable[..., Column]:
    # What an expression has found comes with the row; the expression itself stays here.
    inside = [d if d.custom is None else replace(d, custom=None, python=None, pattern="") for d in detectors]
    outside = [k for k, d in enumerate(detectors) if d.custom is not None]

    def scan(text: pa.Array, *raw: pa.Array) -> pa.Array:
        parts = []
        for lo in range(0, max(1, len(text)), _AT_ONCE):
            given = [x.slice(lo, _AT_ONCE).to_pylist() for x in raw]
            rows: list[list[Finding] | None] = []
            for i, t in enumerate(text.slice(lo, _AT_ONCE).to_pylist()):
                if t is None:
                    rows.append(None)
                    continue
                own = {k: [(m["start"], m["end"], m["value"], m["type"]) for m in x[i] or ()] for k, x in zip(outside, given)}
                rows.append(scan_text(t, inside, normalize, own, overlaps))
            parts.append(_columns(rows, inside))
        return pa.concat_arrays(parts)

    # Typed per number of arguments, since an Arrow UDF says its types in its signature.
    if not outside:
        return F.arrow_udf(lambda text: scan(text), FINDINGS)
    return F.arrow_udf(lambda text, *raw: scan(text, *raw), FINDINGS)


def with_findings(df: DataFrame, column: str = "text", detectors: Sequence[Detector] | None = None, *, normalize: bool = True, overlaps: bool = False, name: str = "findings") -> DataFrame:
    """``df`` with an array of resolved findings in ``column``, or with ``overlaps`` of all that each detector finds for itself. A null text has a null array."""
    detectors = list(detectors) if detectors is not None else defaults()
    text, none = F.col(column), F.array().cast(FINDINGS)
    if not detectors:
        return df.withColumn(name, F.when(text.isNotNull(), none))
    own = [d.custom for d in detectors if d.custom is not None]
    if own:
        norm = normalized(text)["text"] if normalize else text
        out = _staged(df, "_qirtas_norm", norm)
        names = [f"_qirtas_own{k}" for k in range(len(own))]
        for n, c in zip(names, own):
            out = _staged(out, n, c(F.col("_qirtas_norm")).cast(RAW))
        return out.withColumn(name, _udf(detectors, normalize, overlaps)(text, *names)).drop("_qirtas_norm", *names)
    if any(d.seen is None for d in detectors):
        return df.withColumn(name, _udf(detectors, normalize, overlaps)(text))
    gate = text.rlike("|".join(dict.fromkeys(["[^\\x00-\\x7f]", *(d.seen for d in detectors)])))
    return df.withColumn(name, F.coalesce(_udf(detectors, normalize, overlaps)(F.when(gate, text)), F.when(text.isNotNull(), none)))


def _staged(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with one more column that is computed exactly once.

    The optimizer would paste the expression into every place that uses it, detector by detector; a generator of
    one row stops it at no cost but a copy of the row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def findings(df: DataFrame, keys: Sequence[str], column: str = "text", detectors: Sequence[Detector] | None = None, **options) -> DataFrame:
    """One row per finding: the key columns and the finding's nine fields."""
    out = with_findings(df.select(*keys, column), column, detectors, name="_qirtas_f", **options)
    # Of a mere column the optimizer would ask first whether it is empty, and for that scan each text a second time.
    return out.select(*keys, F.inline(F.coalesce("_qirtas_f", F.array().cast(FINDINGS))))


def filtered(found: Column, *, min_confidence: str = "low", only: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Filter resolved findings; a winner that is filtered out still suppresses what it overlapped."""
    floor = CONFIDENCE_RANK[min_confidence]
    levels = [c for c, r in CONFIDENCE_RANK.items() if r >= floor]

    def keep(m: Column) -> Column:
        ok = m["confidence"].isin(levels)
        ok = ok & m["entity_type"].isin(list(only)) if only else ok
        return ok & ~m["entity_type"].isin(list(exclude)) if exclude else ok

    return F.filter(found, keep)


def _chunks(keys: int, chunk: int, margin: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts texts into chunks with their numbers and first characters, in one pass."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(keys)):
                text = text.as_py()
                row = batch.slice(i, 1)
                for k in range(-(-len(text) // chunk)):
                    lo = max(k * chunk - margin, 0)
                    part = pa.array([text[lo : (k + 1) * chunk + margin]], pa.string())
                    yield pa.RecordBatch.from_arrays([*row.columns[:keys], part, pa.array([k], pa.int32()), pa.array([lo], pa.int64())], names=[*batch.schema.names, "_qirtas_k", "_qirtas_lo"])

    return cut


def chunked_findings(df: DataFrame, keys: Sequence[str], column: str = "text", detectors: Sequence[Detector] | None = None, *, chunk: int = 1 << 16, margin: int = 512, **options) -> DataFrame:
    """Findings of very long texts, cut into chunks that are scanned apart, with margins on both sides.

    A finding belongs to the chunk in which it starts. Equal to ``findings`` as long as no finding with its keyword
    is longer than ``margin`` and no chain of overlaps is longer than that. Texts of one chunk are scanned where they lie;
    the chunks of longer ones are dealt to all tasks.
    """
    if not 0 < margin < chunk:
        raise ValueError("margin must be less than chunk")
    rows = df.select(*keys, column)
    long = rows.where(F.length(column) > chunk)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    cut = long.mapInArrow(_chunks(len(keys), chunk, margin), f"{kinds}, _qirtas_k int, _qirtas_lo long").repartition(*keys, "_qirtas_k")
    whole = findings(rows.where(F.length(column) <= chunk), keys, column, detectors, **options)
    return whole.withColumns({x: F.col(x).cast("long") for x in ("start", "end")}).union(chunk_findings(cut, keys, column, detectors, chunk=chunk, **options))


def chunk_findings(cut: DataFrame, keys: Sequence[str], column: str = "text", detectors: Sequence[Detector] | None = None, *, chunk: int, **options) -> DataFrame:
    """Findings of chunks of ``chunk`` characters (with their number ``_qirtas_k`` and first character ``_qirtas_lo``), in the
    offsets of the whole (64 bits, since a file may be longer than a row)."""
    out = findings(cut, [*keys, "_qirtas_k", "_qirtas_lo"], column, detectors, **options)
    out = out.withColumn("start", F.col("start") + F.col("_qirtas_lo")).withColumn("end", F.col("end") + F.col("_qirtas_lo"))
    return out.where(F.floor(F.col("start") / chunk) == F.col("_qirtas_k")).drop("_qirtas_k", "_qirtas_lo")
