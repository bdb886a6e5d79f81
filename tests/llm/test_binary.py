"""Ogg, WARC, chat formatting, exact top-k."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qirtas.llm import chat, ogg, topk, warc


def slow_crc(page):
    crc = 0
    for b in page:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
    return crc


@given(st.binary(max_size=300))
def test_checksum_is_the_bitwise_one(raw):
    assert ogg.checksum(raw) == slow_crc(raw)


@settings(deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=10), st.integers(0, 1200).map(lambda n: bytes(n))), max_size=20), st.integers(1, 2000))
def test_packets_survive_paging(packets, page_bytes):
    w = ogg.Writer(9, page_bytes)
    for i, p in enumerate(packets):
        w.packet(p, i)
    w.flush(0, True)
    got = ogg.demux(b"".join(w.pages))
    assert [p[-1] for p in got.packets] == packets and not got.damaged
    assert got.pages == len(w.pages)


def test_streams_are_kept_apart_and_timed():
    text = "\n".join(f"line {i}" * (i % 200) for i in range(400))
    got = ogg.demux(ogg.file_of(3, text))
    a = [p for p in got.packets if p[0] == 6]
    assert [p[-1].decode() for p in a[2:]] == text.split("\n") and {p[1] for p in a} == {"opus"}
    assert {p[1] for p in got.packets if p[0] == 7} == {"vorbis"}
    # Every packet ends where the packets up to it end, whatever page it is on.
    end = 312
    for p in a[2:]:
        end += opus_duration(p[-1])
        assert p[3] == end and p[4] == pytest.approx((end - 312) / 48000)
    assert [p[3:5] for p in a[:2]] == [(0, 0.0)] * 2
    assert {p[3] for p in got.packets if p[0] == 7} > {None}


def opus_duration(packet):
    """Samples of an Opus packet from the tables of RFC 6716 in milliseconds."""
    if not packet:
        return 0
    config, code = divmod(packet[0], 8)[0], packet[0] % 4
    ms = (10, 20, 40, 60)[config % 4] if config < 12 else (10, 20)[config % 2] if config < 16 else (2.5, 5, 10, 20)[config % 4]
    return int(48 * ms * {0: 1, 1: 2, 2: 2}.get(code, packet[1] % 64 if len(packet) > 1 else 0))


def test_positions_of_packets():
    w = ogg.Writer(1, 10**6)
    w.packet(b"OpusHead\x01\x01" + struct.pack("<HIhB", 312, 48000, 0, 0), 0, True)
    w.packet(b"OpusTags" + bytes(8), 0, True)
    w.packet(b"\x08a", 0)  # 20 ms
    w.packet(b"\x18b", 312 + 960 + 2880, True)  # 60 ms
    w.packet(b"\x08c", 0)
    w.packet(b"\x08d", 312 + 3840 + 960 + 100)  # the end is trimmed
    w.flush(0, True)
    got = ogg.demux(b"".join(w.pages))
    assert [p[3] for p in got.packets[2:]] == [1272, 4152, 5112, 5212]
    # Speex: 4 frames of 160 samples in each packet. Vorbis packets don't say how long they are.
    for head, want in ((b"Speex   " + bytes(28) + struct.pack("<I", 8000) + bytes(16) + struct.pack("<III", 160, 0, 4) + bytes(12), [640, 1280]), (b"\x01vorbis" + struct.pack("<IBI", 0, 1, 8000) + bytes(14), [None, 1280])):
        w = ogg.Writer(1, 10**6)
        w.packet(head, 0, True)
        w.packet(b"comment", 0, True)
        w.packet(b"x", 0)
        w.packet(b"y", 1280, True)
        got = ogg.demux(b"".join(w.pages)).packets
        assert [p[3] for p in got[2:]] == want and [p[4] for p in got[2:]] == [None if x is None else x / 8000 for x in want]


def test_damage_loses_only_what_it_touches():
    text = "\n".join("x%06d" % i * 30 for i in range(300))
    whole, hurt = ogg.demux(ogg.file_of(1, text)), ogg.demux(ogg.file_of(1, text, damage=True))
    assert hurt.damaged == 1 and hurt.pages == whole.pages - 1
    want, got = [p[-1] for p in whole.packets], [p[-1] for p in hurt.packets]
    assert len(got) < len(want) and set(got) <= set(want)
    raw = ogg.file_of(1, text)
    assert ogg.demux(b"junk OggS" + raw).packets == whole.packets
    assert ogg.demux(raw[:-5]).damaged == 1
    lacking = ogg.demux(b"OggS" + raw.split(b"OggS", 6)[6])
    assert set(p[-1] for p in lacking.packets) <= set(want)
    assert ogg.demux(b"").packets == []
    assert ogg.Stream(rate=44100).seconds(-1) is None


def test_ogg_operator(spark, docs_of, awkward):
    rows = ogg.demuxed(ogg.muxed(docs_of([*awkward, (57, "with\ndamage")]))).collect()
    lines = [r for r in rows if r.doc_id == 4 and r.codec == "opus"]
    assert bytes(lines[-1].data).decode() == "word " * 60_000
    assert {r.damaged for r in rows if r.doc_id == 57} == {1}
    assert len([r for r in rows if r.doc_id == 7 and bytes(r.data) == b"twice the same"]) == 2
    assert not [r for r in rows if r.doc_id == 1]
    empty = spark.createDataFrame([(1, None), (2, b""), (3, b"no ogg")], "doc_id long, media binary")
    assert ogg.demuxed(empty).count() == 0 and ogg.demuxed(empty.limit(0)).count() == 0


def test_whole_table_of_ogg(spark, sf):
    from qirtas.llm.common import table

    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = {}
    for r in ogg.op3_ogg(spark, sf).collect():
        if r.codec == "opus" and r.doc_id % 50 != 7:
            got.setdefault(r.doc_id, []).append((r.packet, bytes(r.data)))
    for k, v in got.items():
        assert b"\n".join(t for _, t in sorted(v)[2:]).decode() == texts[k]
    assert len(got) == sum(k % 50 != 7 for k in texts)


@given(st.lists(st.tuples(st.text(max_size=8), st.one_of(st.text(max_size=30), st.lists(st.sampled_from([chat.START, chat.END, "<", "\\", "|", "<|", "<\\|", "\n", "a"]), max_size=8).map("".join))), max_size=6))
def test_chat_round_trip(turns):
    text, n = chat.formatted(turns)
    assert chat.parse(text) == (turns, True)
    assert n == sum(chat.START in t or chat.END in t or bool(chat._ESCAPED.search(t)) for _, t in turns)


def test_chat_parser_rejects():
    ok = chat.render([("user", "hi")], set())
    for bad in (ok[:-1], ok[1:], ok[: len(chat.START) + 2], ok + "x", ok.replace("hi", "h" + chat.START)):
        assert not chat.parse(bad)[1]


def test_chat_operator(spark, sf):
    rows = [(1, 2, "user", "b", 0), (1, 1, "system", None, 0), (1, 2, None, "b", 0), (1, 2, "user", "b", 0), (None, 1, "user", "x" * 100_000, 0), (2, None, "user", chat.END, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r.conv_id: r for r in chat.chats(df).collect()}
    assert chat.parse(got[1].rendered)[0] == [("system", ""), ("", "b"), ("user", "b"), ("user", "b")] and got[1].n_turns == 4
    assert len(got[None].rendered) > 100_000 and got[2].n_escaped == 1
    assert chat.chats(df.limit(0)).count() == 0
    for r in chat.op8_chat_format(spark, sf).collect():
        turns, fine = chat.parse(r.rendered)
        assert fine and len(turns) == r.n_turns


def brute(ids, x, k):
    s = x @ x.T
    return {(int(i), rank + 1): (int(ids[j]), s[a, j]) for a, i in enumerate(ids) for rank, j in enumerate([j for j in sorted(range(len(ids)), key=lambda j: (-s[a, j], ids[j])) if j != a][:k])}


@pytest.mark.parametrize("block", [7, 20, 1000])
@pytest.mark.parametrize("every", [1, 3])
def test_topk_is_exact_with_ties(spark, block, every):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (60, 4)).astype(float)
    x[20:30] = x[0]
    ids = rng.permutation(1000)[:60]
    df = spark.createDataFrame([(int(i), [float(v) for v in r], "b") for i, r in zip(ids, x)], "vec_id long, embedding array<float>, part string")
    got = {(r.vec_id, r.rank): (r.neighbour, r.score) for r in topk.nearest(df, 5, queries=F.col("vec_id") % every == 0, query_bytes=block * 32, shard_bytes=block * 16).collect()}
    assert got == {k: (n, pytest.approx(s)) for k, (n, s) in brute(ids, x, 5).items() if k[0] % every == 0}


def test_topk_awkward(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0]), (3, None), (4, []), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.rank, r.neighbour) for r in topk.nearest(df, 3).collect())
    assert got == [(1, 1, 2), (2, 1, 1)] and topk.left_out(df).first().n == 6
    assert topk.nearest(df.limit(0)).count() == 0
    assert topk.nearest(df.where("vec_id = 2")).count() == 0
    hot = spark.createDataFrame([(1, [float(i % 7), 1.0]) for i in range(3000)] + [(2, [1.0, 1.0]), (3, [0.0, 2.0])], df.schema)
    assert sorted((r.vec_id, r.neighbour, r.score) for r in topk.nearest(hot, 2).collect()) == [(1, 2, 1.0), (1, 3, 2.0), (2, 1, 1.0), (2, 3, 2.0), (3, 1, 2.0), (3, 2, 2.0)]
    # Vectors of another length search among themselves; doubles aren't narrowed.
    more = spark.createDataFrame([(9, [2.0]), (10, [1.0 + 1e-12, 0.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.rank, r.neighbour) for r in topk.nearest(df.union(more), 1).collect())
    assert got == [(1, 1, 2), (2, 1, 1), (5, 1, 9), (9, 1, 5), (10, 1, 11), (11, 1, 10), (12, 1, 10)]


def test_warc_round_trip_and_junk():
    r = warc.Record([("WARC-Type", "metadata")], b"block\r\n\r\nWARC/1.0")
    raw = warc.render(r) * 3
    got, bad = warc.parse(raw)
    assert [x.block for x in got] == [r.block] * 3 and bad == 0
    import gzip

    assert len(warc.parse(gzip.compress(raw[: len(raw) // 3]) * 2)[0]) == 2
    assert warc.parse(b"")[0] == [] and warc.parse(b"junk\r\n" + raw)[1] == 1
    assert len(warc.parse(raw[:-20])[0]) == 2
    assert warc.parse(b"WARC/1.0\r\nContent-Length: x\r\n\r\n" + raw)[1] == 1


def test_warc_goes_on_after_a_damaged_member():
    import gzip

    one = [warc.render(warc.Record([("WARC-Type", "metadata")], b"block %d " % i * 50)) for i in range(4)]
    a, b, c, d = (gzip.compress(x) for x in one)
    hurt = b[:20] + bytes(x ^ 255 for x in b[20:40]) + b[40:]
    blocks = lambda raw: ([x.block[:7] for x in warc.parse(raw)[0]], warc.parse(raw)[1])
    assert blocks(a + hurt + c + d) == ([b"block 0", b"block 2", b"block 3"], 1)
    assert blocks(a + hurt + one[2] + d) == ([b"block 0", b"block 2", b"block 3"], 1)
    assert blocks(a + bytes(16) + b + b"\r\n" + c) == ([b"block 0", b"block 1", b"block 2"], 0)
    assert blocks(a + one[1] + c + one[3]) == ([b"block 0", b"block 1", b"block 2", b"block 3"], 0)
    assert blocks(a + b"junk" + b) == ([b"block 0", b"block 1"], 1)


def brute_warc(archives):
    """Kind of every record after resolution, by (archive, part, position)."""
    recs = [(a, p, i, r) for a, p, raw in archives for i, r in enumerate(warc.parse(raw)[0])]
    first = {}
    for a, p, i, r in recs:
        if r.get("WARC-Type") == "response":
            d = warc.digest(r.payload)
            first[d] = min(first.get(d, ("~",)), (r.get("WARC-Date"), a, p, i))
    out = {}
    for a, p, i, r in recs:
        kind = r.get("WARC-Type")
        d = warc.digest(r.payload) if kind == "response" else r.get("WARC-Payload-Digest")
        out[a, p, i] = "response" if kind == "response" and first[d][1:] == (a, p, i) else "resolved" if d in first and kind in ("response", "revisit") else kind
    return out


def plain_records(raw):
    """The records of a sound archive, without the operator's parser: (headers, block)."""
    import gzip

    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    out = []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.0"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        out.append((fields, rest[:n]))
        raw = rest[n + 4 :]
    return out


def check_references(archives):
    """Every reference names an original that is there, of the same payload; ids are given once. Returns how many."""
    import base64
    import hashlib

    records = [r for raw in archives for r in plain_records(raw)]
    ids = {f["WARC-Record-ID"]: (f, b) for f, b in records}
    assert len(ids) == len(records)
    n = 0
    for f, b in records:
        assert f["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        if "WARC-Refers-To" in f:
            to, block = ids[f["WARC-Refers-To"]]
            body = block.partition(b"\r\n\r\n")[2]
            assert f["WARC-Type"] == "revisit" and to["WARC-Type"] == "response" and to["WARC-Date"] == f["WARC-Refers-To-Date"] and to["WARC-Target-URI"] == f["WARC-Refers-To-Target-URI"]
            assert f["WARC-Payload-Digest"] == to["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
            n += 1
    return n


def test_warc_references_name_records_that_are_there(spark, sf):
    assert check_references([bytes(r.warc) for r in warc.op10_warc(spark, sf).collect()]) > 10


def test_warc_files(spark, sf, tmp_path):
    from qirtas.llm.common import table

    made = warc.captured(table(spark, sf, "pages"))
    files = warc.save(made, f"file://{tmp_path}/in").collect()
    assert len(files) == made.count()
    rows = spark.createDataFrame([(r.archive, r.part, f"file://{r.path}") for r in files], "archive long, part long, path string")
    written = warc.save(warc.resolved(rows), f"file://{tmp_path}/out").collect()
    got = {(r.archive, r.part): open(r.path, "rb").read() for r in written}
    want = {(r.archive, r.part): bytes(r.warc) for r in warc.resolved(made).collect()}
    assert got == want and check_references(got.values()) > 10
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{a}-{p}.warc.gz" for a, p in want)


def test_warc_operator(spark, sf):
    from qirtas.llm.common import table

    made = warc.captured(table(spark, sf, "pages")).collect()
    want = brute_warc([(r.archive, r.part, bytes(r.warc)) for r in made])
    got, payloads = {}, set()
    for r in warc.op10_warc(spark, sf).collect():
        records, bad = warc.parse(bytes(r.warc))
        assert r.n_bad == bad == 0 and r.n_records == len(records)
        for i, x in enumerate(records):
            kind = x.get("WARC-Type")
            got[r.archive, r.part, i] = "resolved" if x.get("WARC-Refers-To-Date") else kind
            assert x.get("WARC-Block-Digest") == warc.digest(x.block)
            if kind == "response":
                assert x.get("WARC-Payload-Digest") == warc.digest(x.payload) not in payloads
                payloads.add(warc.digest(x.payload))
            else:
                assert x.payload == b""
    assert got == want and "resolved" in want.values() and "revisit" in want.values()


def test_warc_awkward(spark):
    same = b"".join(warc.render(warc._record("response", f"http://x/{i}", "2024-01-01T00:00:00Z", str(i), b"HTTP/1.1 200 OK\r\n\r\nbody", "sha1:wrong")) for i in range(3))
    bare = warc.render(warc.Record([("WARC-Type", "revisit")], b"")) + warc.render(warc.Record([], b"q"))
    df = spark.createDataFrame([(1, 1, bytearray(same), "x"), (1, 2, None, "x"), (None, 3, bytearray(same), "x"), (2, 1, bytearray(b""), "x"), (2, 2, bytearray(bare), "x"), (2, 2, bytearray(bare), "x")], "archive long, part long, warc binary, refers string")
    got = {(r.archive, r.part): r for r in warc.resolved(df).collect()}
    # Equal dates: the null archive comes first in order.
    assert [r.get("WARC-Type") for r in warc.parse(bytes(got[None, 3].warc))[0]] == ["response", "revisit", "revisit"]
    assert got[1, 1].n_revisits == 3 and got[1, 2].n_records == got[2, 1].n_records == 0
    assert got[2, 2].n_unresolved == 1 and got[2, 2].n_records == 2
    assert warc.resolved(df).count() == 6 and warc.resolved(df.limit(0)).count() == 0
