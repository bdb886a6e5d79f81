"""WARC revisit resolution (ISO 28500).

Only headers are shuffled by digest: every archive is parsed where it lies, and (digest, kind, date, place) of its
records go by payload digest. The earliest response of a digest is its original; ties go to the smaller (archive, part,
position). A later response with the same digest becomes a revisit record without its payload; a revisit record
is joined to the original of its digest. The decisions then go back to the archives, which are written anew with
fresh headers: record ids, lengths, block digests, and the ``WARC-Refers-To*`` fields of revisits, of which
``WARC-Refers-To`` is the id that the original gets in its new archive. Which archives a decision changes is told to the
tasks as a bitmap; the others are written where they lie and not shuffled. ``save`` writes them as files.

Payload digests of responses are computed, never trusted; a revisit has no payload, so its stated digest counts.

Cases: a null or empty archive gives an archive without records. A revisit without a digest, or whose digest no
response has, is kept as it is and counted as unresolved. Records of other kinds are kept. What can't be read as
a record (no header end, no or bad length, cut short) is passed over up to the next ``WARC/1.`` line and counted.
Members compressed with gzip and plain records are both read. Rows that repeat (archive, part) are
one archive and are written alike. Extra columns are left alone.

The tables given have no archives. ``captured`` makes them from ``pages``: every page is captured, and two of
three again later, half of these as revisit records and half as full responses; the revisit of every seventeenth
page refers to a payload that nobody has.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, discard, holds, sliced, table, written

PAGES_PER_ARCHIVE = 1024
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        name = name.lower()
        return next((v for k, v in self.headers if k.lower() == name), None)

    @property
    def payload(self) -> bytes:
        """The HTTP body of a response, else the block."""
        if not self.block.startswith(b"HTTP/"):
            return self.block
        return self.block.partition(b"\r\n\r\n")[2]


_GZIP = b"\x1f\x8b"


def _members(raw: bytes, at: int) -> tuple[bytes, int, bool]:
    """The gzip members from ``at`` on as plain bytes, where they end, and whether all are sound; of a damaged one what can be read."""
    out = []
    while raw.startswith(_GZIP, at):
        d, to = zlib.decompressobj(31), at
        try:
            while not d.eof and to < len(raw):
                out.append(d.decompress(raw[to : to + 65536]))
                to += 65536
        except zlib.error:
            pass
        if not d.eof:
            return b"".join(out), at + 2, False
        at = min(to, len(raw)) - len(d.unused_data)
    return b"".join(out), at, True


def _next(raw: bytes, at: int, members: bool) -> int:
    """Where the next record begins, plain or (with ``members``) as a gzip member; -1 if there is none."""
    plain = raw.find(b"WARC/1.", at)
    while members and (at := raw.find(_GZIP + b"\x08", at, plain if plain >= 0 else len(raw))) >= 0:
        try:
            if zlib.decompressobj(31).decompress(raw[at : at + 4096], 7) == b"WARC/1.":
                return at
        except zlib.error:
            pass
        at += 1
    return plain


def _records(raw: bytes, at: int, members: bool) -> tuple[list[Record], int, int]:
    """The plain records from ``at`` up to a gzip member, the number of unreadable places, and where it ended."""
    records, bad = [], 0
    while at < len(raw):
        if not raw.startswith(b"WARC/1.", at):
            nxt = _next(raw, at, members)
            bad += bool(raw[at : nxt if nxt >= 0 else None].strip(b"\0 \t\r\n\v\f"))
            if nxt < 0:
                break
            at = nxt
            if raw.startswith(_GZIP, at):
                return records, bad, at
        end = raw.find(b"\r\n\r\n", at)
        size = ""
        if end >= 0:
            lines = raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            r = Record([(k.strip(), v.strip()) for k, s, v in (x.partition(":") for x in lines) if s], b"")
            size = r.get("Content-Length") or ""
        if not size.isdecimal() or end + 4 + int(size) > len(raw):
            bad += 1
            nxt = _next(raw, at + 7, members)
            if nxt < 0 or end < 0 and not raw.startswith(_GZIP, nxt):
                break
            at = nxt
            if raw.startswith(_GZIP, at):
                return records, bad, at
            continue
        r.block = raw[end + 4 : end + 4 + int(size)]
        records.append(r)
        at = end + 4 + int(size)
        while raw.startswith(b"\r\n", at):
            at += 2
        if members and raw.startswith(_GZIP, at):
            return records, bad, at
    return records, bad, len(raw)


def parse(raw: bytes) -> tuple[list[Record], int]:
    """The records of an archive and the number of places that couldn't be read."""
    records, bad, at = [], 0, 0
    while at < len(raw):
        if raw.startswith(_GZIP, at):
            plain, at, sound = _members(raw, at)
            got, n, _ = _records(plain, 0, False)
            # A record that the damage cut short is the damaged place itself.
            n = n if sound else max(n, 1)
            if not sound:
                nxt = _next(raw, at, True)
                at = nxt if nxt >= 0 else len(raw)
        else:
            got, n, at = _records(raw, at, True)
        records += got
        bad += n
    return records, bad


def render(r: Record) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in r.headers if k.lower() != "content-length")
    return b"WARC/1.0\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(r.block) + r.block + b"\r\n\r\n"


def _record(kind: str, url: str, date: str, key: str, block: bytes, payload_digest: str, profile: bool = False) -> Record:
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, key)}>"), ("WARC-Date", date), ("WARC-Target-URI", url)]
    headers += [("WARC-Payload-Digest", payload_digest), ("Content-Type", "application/http; msgtype=response")]
    return Record(headers + ([("WARC-Profile", PROFILE)] if profile else []), block)


def capture(page_id: int, url: str | None, html: str | None) -> bytes:
    """The records of a page's one or two captures."""
    url = url or f"urn:page:{page_id}"
    body = (html or "").encode("utf-8", "replace")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    out = [_record("response", url, f"2024-01-{page_id % 28 + 1:02d}T00:00:00Z", f"{page_id}/1", http + body, digest(body))]
    second = f"2024-06-{page_id % 28 + 1:02d}T00:00:00Z"
    if page_id % 3 == 0:
        stated = digest(b"nobody has this %d" % page_id) if page_id % 17 == 0 else digest(body)
        out.append(_record("revisit", url, second, f"{page_id}/2", http, stated, True))
    elif page_id % 3 == 1:
        out.append(_record("response", url, second, f"{page_id}/2", http + body, digest(body)))
    return b"".join(map(render, out))


def captured(pages: DataFrame) -> DataFrame:
    """archive, part, warc: the captures of every page; an archive is the concatenation of its parts."""

    def make(page_id: pa.Array, url: pa.Array, html: pa.Array) -> pa.Array:
        return pa.array([capture(p or 0, u, h) for p, u, h in zip(page_id.to_pylist(), url.to_pylist(), html.to_pylist())], pa.binary())

    warc = F.arrow_udf(make, "binary")("page_id", "url", "html")
    return pages.select(F.floor(F.col("page_id") / PAGES_PER_ARCHIVE).alias("archive"), F.col("page_id").alias("part"), warc.alias("warc"))


def _raw(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The bytes of each archive of a batch: its column ``warc``, or the file at its ``path``."""
    if "warc" in batch.schema.names:
        for raw in batch.column("warc"):
            yield raw.as_py() or b""
        return
    from pyarrow import fs

    for path in batch.column("path").to_pylist():
        where, at = fs.FileSystem.from_uri(path)
        with where.open_input_stream(at, compression=None) as f:
            yield f.read()


def _source(archives: DataFrame) -> str:
    """What stands for an archive's bytes; with a path only that is shuffled."""
    return "path" if "path" in archives.columns else "warc"


def headers(archives: DataFrame) -> DataFrame:
    """archive, part, position, kind, uri, date, digest, record_id of every record."""
    names = ["position", "kind", "uri", "date", "digest", "record_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows, owner = [], []
            for i, raw in enumerate(_raw(batch)):
                for at, r in enumerate(parse(raw)[0]):
                    kind = r.get("WARC-Type")
                    d = digest(r.payload) if kind == "response" else r.get("WARC-Payload-Digest") if kind == "revisit" else None
                    rows.append((at, kind, r.get("WARC-Target-URI"), r.get("WARC-Date"), d, r.get("WARC-Record-ID")))
                    owner.append(i)
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int32(), *[pa.string()] * 5]
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("archive").take(take), batch.column("part").take(take), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["archive", "part", *names])

    place = ", ".join(f"{c} {archives.schema[c].dataType.simpleString()}" for c in ("archive", "part"))
    return archives.select("archive", "part", _source(archives)).mapInArrow(read, f"{place}, position int, kind string, uri string, date string, digest string, record_id string")


def new_id(archive, part, position: int, old: str | None) -> str:
    """A record's id in the deduplicated archive, known from its place alone."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{archive}/{part}/{position}/{old}/deduplicated')}>"


def rewrite(raw: bytes, place: tuple, refers: dict[int, tuple], compress: bool) -> tuple[bytes, int, int, int, int]:
    """The archive at ``place`` (archive, part) written anew; ``refers`` has for each position the original's (uri, date, new record id)."""
    records, bad = parse(raw)
    out, revisits, unresolved = [], 0, 0
    for at, r in enumerate(records):
        kind, old = r.get("WARC-Type"), r.get("WARC-Record-ID")
        head = [("WARC-Type", kind or "unknown"), ("WARC-Record-ID", new_id(*place, at, old))]
        to = refers.get(at)
        stated = digest(r.payload) if kind == "response" else r.get("WARC-Payload-Digest")
        if to:
            if kind == "response":
                r.block = r.block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n" if r.block.startswith(b"HTTP/") else b""
            head[0] = ("WARC-Type", "revisit")
            head += [("WARC-Profile", PROFILE), *((k, v) for k, v in zip(("WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Refers-To"), to) if v)]
        revisits += bool(to) or kind == "revisit"
        unresolved += kind == "revisit" and not to
        skip = {"warc-type", "warc-record-id", "warc-payload-digest", "warc-block-digest", "content-length"} | ({"warc-profile", "warc-refers-to", "warc-refers-to-target-uri", "warc-refers-to-date"} if to else set())
        r.headers = head + [(k, v) for k, v in r.headers if k.lower() not in skip] + ([("WARC-Payload-Digest", stated)] if stated else []) + [("WARC-Block-Digest", digest(r.block))]
        raw_record = render(r)
        out.append(gzip.compress(raw_record, 6, mtime=0) if compress else raw_record)
    return b"".join(out), len(records), revisits, unresolved, bad


def resolved(archives: DataFrame, compress: bool = True) -> DataFrame:
    """archive, part, warc, n_records, n_revisits, n_unresolved, n_bad: the deduplicated archives.

    ``archives`` has (archive, part) and the bytes as ``warc``, or a ``path`` to them that all executors can open.
    """
    found = written(headers(archives), "warc-headers")
    known = found.where("digest is not null and kind in ('response', 'revisit')")
    place = F.struct(F.col("date"), "archive", "part", "position")
    # A partial aggregate by digest: a payload captured a million times costs one row per task here.
    first = known.where("kind = 'response'").groupBy("digest").agg(F.min_by(F.struct("archive", "part", "position", "uri", F.col("date"), "record_id"), place).alias("f"))
    later = known.select("digest", "archive", "part", "position").join(first, "digest")
    later = later.where("not (archive <=> f.archive and part <=> f.part and position = f.position)")
    refers = later.groupBy("archive", "part").agg(F.collect_list(F.struct("position", F.col("f.archive").alias("to_archive"), F.col("f.part").alias("to_part"), F.col("f.position").alias("to"), "f.uri", "f.date", "f.record_id")).alias("refers"))
    refers = written(refers, "warc-refers")
    discard(found)
    bits = archives.sparkSession.sparkContext.broadcast(bitmap(refers.select(F.xxhash64("archive", "part").alias("bit"))))
    own = _source(archives)
    one = archives.select("archive", "part", own).withColumnsRenamed({"archive": "in_archive", "part": "in_part"})
    touched = F.arrow_udf(lambda k: pa.array(holds(bits.value, k.to_numpy())), "boolean")(F.xxhash64("in_archive", "in_part"))
    joined = one.where(touched).join(refers, one["in_archive"].eqNullSafe(refers["archive"]) & one["in_part"].eqNullSafe(refers["part"]), "left").select("in_archive", "in_part", own, "refers")
    joined = one.where(~touched).select("in_archive", "in_part", own, F.lit(None).cast(refers.schema["refers"].dataType).alias("refers")).union(joined)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for a, p, raw, refers in zip(batch.column("in_archive").to_pylist(), batch.column("in_part").to_pylist(), _raw(batch), batch.column("refers").to_pylist()):
                to = {r["position"]: (r["uri"], r["date"], new_id(r["to_archive"], r["to_part"], r["to"], r["record_id"])) for r in refers or ()}
                out.append(rewrite(raw, (a, p), to, compress))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("in_archive"), batch.column("in_part"), pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int32()) for c in cols[1:])], names=["archive", "part", "warc", "n_records", "n_revisits", "n_unresolved", "n_bad"])

    kinds = ", ".join(f"{c} {archives.schema[c].dataType.simpleString()}" for c in ("archive", "part"))
    return joined.mapInArrow(write, f"{kinds}, warc binary, n_records int, n_revisits int, n_unresolved int, n_bad int")


def save(archives: DataFrame, folder: str, suffix: str = ".warc.gz") -> DataFrame:
    """archive, part, path: every archive as a file of its own in ``folder``, which all executors share.

    A file is written under another name and then renamed, so a task that runs twice leaves whole files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        to, base = fs.FileSystem.from_uri(folder)
        to.create_dir(base, recursive=True)
        for batch in sliced(batches):
            paths = []
            for a, p, raw in zip(*(batch.column(x).to_pylist() for x in ("archive", "part", "warc"))):
                paths.append(f"{base}/{a}-{p}{suffix}")
                unfinished = f"{paths[-1]}.{uuid.uuid4().hex}"
                with to.open_output_stream(unfinished, compression=None) as f:
                    f.write(raw or b"")
                to.move(unfinished, paths[-1])
            yield pa.RecordBatch.from_arrays([batch.column("archive"), batch.column("part"), pa.array(paths, pa.string())], names=["archive", "part", "path"])

    kinds = ", ".join(f"{c} {archives.schema[c].dataType.simpleString()}" for c in ("archive", "part"))
    return archives.mapInArrow(write, f"{kinds}, path string")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(captured(table(spark, sf_dir, "pages")))
