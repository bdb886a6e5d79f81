import hashlib
import hmac
import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import qirtas as q
from qirtas import cli
from qirtas.operators import domains as D
from qirtas.operators.redact import hashed, partly
from qirtas.streaming import scan as S
from qirtas.vault import sealed, unsealed
from tests.made import national_id

ID = national_id("110203040")
MAIL = "a@b.example"


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, f"{ID} and {MAIL}, {MAIL}"), (2, "clean"), (3, None), (4, ""), (5, f"MRN: QX-777 {ID[:4]}\u200b{ID[4:]} {ID}")]
    return q.with_findings(spark.createDataFrame(rows, "id int, text string")).persist()


def redactions(texts, mode, **options):
    return {r.id: r.redaction for r in q.redacted(texts, mode=mode, **options).collect()}


def test_modes(texts):
    got = redactions(texts, "mask")
    assert got[1].text == "[SAUDI_NATIONAL_ID] and [EMAIL], [EMAIL]" and [i.original for i in got[1]["items"]] == [ID, MAIL, MAIL]
    assert got[2].text == "clean" and got[3].text is None and got[4].text == ""
    assert redactions(texts, "remove")[1].text == " and , "
    assert redactions(texts, "partial", keep_last=2)[5].text == f"MRN: ****77 {'*' * 8}{ID[-2:]} {'*' * 8}{ID[-2:]}"
    token = hmac.new(b"key", ID.encode(), hashlib.sha256).hexdigest()[:8]
    assert redactions(texts, "hash", salt="key", hash_length=8)[1].text.startswith(f"[HASH:{token}] and")
    for bad in ({"mode": "hash"}, {"mode": "none"}):
        with pytest.raises(ValueError):
            q.redacted(texts, **bad)


def test_tokens_and_back(texts):
    got = redactions(texts, "tokenize")
    assert got[1].text == "<SAUDI_NATIONAL_ID_1> and <EMAIL_1>, <EMAIL_1>" and got[1].vault == {"<SAUDI_NATIONAL_ID_1>": ID, "<EMAIL_1>": MAIL}
    # Numbered from the right; another spelling is another token.
    assert got[5].text == "MRN: <MEDICAL_RECORD_NUMBER_1> <SAUDI_NATIONAL_ID_2> <SAUDI_NATIONAL_ID_1>"
    back = q.redacted(texts, mode="tokenize").select("id", "text", q.restored(F.col("redaction.text"), F.col("redaction.vault")).alias("back")).collect()
    assert all(r.text == r.back for r in back)


def test_long_keys_and_short_values(spark):
    key = "k" * 100
    r = spark.range(1).select(hashed(F.lit("v"), key, 64).alias("h"), partly(F.lit("abc"), 0).alias("a"), partly(F.lit("abc"), 3).alias("b"), partly(F.lit("abcd"), 3).alias("c")).first()
    assert r.h == f"[HASH:{hmac.new(key.encode(), b'v', hashlib.sha256).hexdigest()}]" and (r.a, r.b, r.c) == ("***", "abc", "*bcd")


def test_levels_and_measures(spark, texts):
    f = F.col("findings")
    got = {r.id: r for r in texts.select("id", q.highest_level(f).alias("h"), q.level_counts(f).alias("n"), q.external(f).alias("x"), q.highlighted(F.col("text"), f).alias("m")).collect()}
    assert got[1].h == "confidential" and got[1].n == {"confidential": 3} and got[2].h is None and got[5].h == "secret"
    assert [(x.entity_type, x.score) for x in got[5].x] == [("MEDICAL_RECORD_NUMBER", 0.4), ("SA_NATIONAL_ID", 0.95), ("SA_NATIONAL_ID", 0.95)]
    assert got[1].m.startswith(f'<mark title="saudi_national_id">{ID}</mark> and') and got[1].x[0].score == 0.95
    truth = spark.createDataFrame([(1, "email"), (2, "email"), (9, "x")], "id int, entity_type string")
    found = spark.createDataFrame([(1, "email"), (3, "email")], "id int, entity_type string")
    assert {(r.entity_type, r.tp, r.fp, r.fn, r.f1) for r in q.quality(truth, found, ["id"]).collect()} == {("email", 1, 1, 1, 0.5), ("x", 0, 0, 1, 0.0)}


def test_hosts(spark):
    want = {
        "https://User:pw@API.Example.com:8443/x?y": ("api.example.com", False), "moh.gov.sa/path": ("moh.gov.sa", True), "sa": ("sa", True), "https://x.ally.example": ("x.ally.example", True),
        "notally.example": ("notally.example", False), "http://[::1]:80/": ("::1", False), "": (None, None), None: (None, None), "a/b://c": (None, None),
    }
    df = spark.createDataFrame([(k,) for k in want], "d string")
    for r in df.select("d", q.host_of(F.col("d")).alias("h"), q.is_in_kingdom(F.col("d"), ["Ally.example"]).alias("k")).collect():
        assert (r.h, r.k) == want[r.d], r.d


def test_guard(spark, texts):
    df = texts.select("id", "text")
    got = {r.id: r for r in q.Guard(mode="tokenize", block_categories=("sensitive_health",), record_values=True).protect(df, destination="https://api.example").collect()}
    assert got[5].blocked and got[5].vault == {} and got[5].safe_text.startswith("MRN: [MEDICAL") and not got[5].audit.redacted
    assert got[1].audit.action == "redact" and got[1].audit.cross_border_transfer and got[1].audit["values"] == [ID, MAIL, MAIL]
    assert got[1].audit.entity_summary == {"saudi_national_id": 1, "email": 2} and got[1].vault["<EMAIL_1>"] == MAIL
    assert got[2].audit.action == "allow" and got[2].safe_text == "clean" and not got[2].audit.cross_border_transfer and got[3].safe_text is None
    assert {r.id for r in q.Guard(block_cross_border=True).protect(df, destination="").where("blocked").collect()} == {1, 5}
    assert not q.Guard(block_cross_border=True).protect(df).where("blocked").count() and not q.Guard(block_cross_border=True).protect(df, destination="x.sa").where("blocked").count()


def test_conversations_and_clients(spark):
    rows = [(1, 2, "user", f"then {MAIL}"), (1, 1, "system", f"first {ID}"), (2, 1, "user", None)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r for r in q.Guard(mode="tokenize").protect_conversations(df).collect()}
    assert [m.text for m in got[1].messages] == ["first <SAUDI_NATIONAL_ID_1>", "then <EMAIL_1>"] and [m.role for m in got[1].messages] == ["system", "user"]
    assert [(v.turn, v.original) for v in got[1].vault] == [(1, ID), (2, MAIL)] and not got[2].blocked

    class Messages:
        def create(self, **k):
            self.got = k
            return SimpleNamespace(content=[{"text": "answer <EMAIL_1>"}])

    client = SimpleNamespace(messages=Messages())
    wrapped = q.Guard(mode="tokenize").wrap(spark, client, restore_response=True)
    sent = [{"content": [{"text": f"p {ID}"}, {"image": 1}], "role": "user"}, {"content": None, "role": "user"}]
    answer = wrapped.create(system=f"s {MAIL}", messages=sent)
    assert answer.content == [{"text": f"answer {MAIL}"}] and client.messages.got["system"] == "s <EMAIL_1>"
    assert client.messages.got["messages"][0]["content"] == [{"text": "p <SAUDI_NATIONAL_ID_1>"}, {"image": 1}]
    with pytest.raises(PermissionError):
        q.Guard(block_categories=("contact",)).wrap(spark, client).create(messages=[{"content": MAIL}])
    for bad in ({"client": object()}, {"client": client, "provider": "nobody"}):
        with pytest.raises(ValueError):
            q.resolve_adapter(**bad)


def osa(a, b):
    d = [[i + j if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_distance(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))) for _ in range(300)]
    a, b = F.col("a"), F.col("b")
    shared = F.size(F.array_intersect(D.deletions(a, 2), D.deletions(b, 2))) > 0
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", D.distance(a, b).alias("d"), D.within(a, b, 1).alias("w1"), D.within(a, b, 2).alias("w2"), shared.alias("s")).collect():
        d = osa(r.a, r.b)
        assert (r.d, r.w1, r.w2) == (d, d <= 1, d <= 2) and (d > 2 or r.s), r


def test_domains(spark):
    rows = [(1, "see https://Example.com/x, exаmple.com examp1e.com exmaple.com xn--exmple-4nf.com other.org ...... mail@x.example p\u0430ypal.net"), (2, None), (3, "example.com.")]
    df = spark.createDataFrame(rows, "id int, text string")
    watch = spark.createDataFrame([("example.com",), ("Other.org",)], "target string")
    hosts = [r.domain for r in D.domains(df, ["id"]).where("id = 1").orderBy("start").collect()]
    assert hosts[:2] == ["Example.com", "exаmple.com"] and "mail@x.example" not in hosts
    for r in D.domains(df, ["id"]).collect():
        assert rows[r.id - 1][1][r.start : r.end] == r.domain
    got = {(r.domain, r.reason, r.target) for r in D.suspicious(df, ["id"], "text", watch).collect()}
    assert {("exаmple.com", "impersonation", "example.com"), ("examp1e.com", "impersonation", "example.com"), ("exmaple.com", "typosquat", "example.com"), ("p\u0430ypal.net", "mixed_script", None)} <= got
    assert not {d for d, *_ in got} & {"Example.com", "other.org"} and ("exаmple.com", "mixed_script", None) not in got
    assert ("xn--exmple-4nf.com", "impersonation", "example.com") in got
    found = q.with_findings(df, detectors=q.lookalike(["example.com"]), normalize=False).where("id = 1").first().findings
    assert [(f.value, f.confidence) for f in found if f.value == "exаmple.com"] == [("exаmple.com", "high")] and {f.entity_type for f in found} == {"suspicious_domain"}
    chars = spark.createDataFrame([(c,) for c in "aя٣中あאά1-"], "c string").select(D.script_of(F.col("c")).alias("s")).collect()
    assert [r.s for r in chars] == ["Latin", "Cyrillic", "Arabic", "Han", "Kana", "Hebrew", "Greek", "Common", "Common"]


def test_vault(spark):
    key = F.lit(b"0" * 16)
    m = F.create_map(F.lit("<A_1>"), F.lit("x"))
    assert spark.range(1).select(unsealed(sealed(m, key), key).alias("v")).first().v == {"<A_1>": "x"}
    with pytest.raises(ValueError):
        q.encrypt_vault({}, "")
    with pytest.raises(ValueError):
        q.decrypt_vault(b"{}", "p")


def test_vault_with_a_password(tmp_path):
    pytest.importorskip("cryptography")
    q.save_vault({"a": "b"}, str(tmp_path / "v"), "p", 1000)
    assert q.load_vault(str(tmp_path / "v"), "p") == {"a": "b"}
    with pytest.raises(ValueError):
        q.load_vault(str(tmp_path / "v"), "other")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.TXT").write_bytes(f"x\r\n{ID} \xff".encode("latin-1"))
    (tmp_path / "b.bin").write_text(MAIL)
    (tmp_path / "w.list").write_text("# none\n example.com \n\n")
    run = lambda *a: (cli.main(list(a), spark), capsys.readouterr().out)
    code, out = run("scan", str(tmp_path), "--fail-on-find")
    assert code == 1 and out.strip().split("\t")[1:] == ["saudi_national_id", "high", "national_identifier", ID] and ":2-12" in out
    assert run("scan", str(tmp_path), "--stream", "--no-values") == (0, out.rsplit("\t", 1)[0] + "\n")
    assert json.loads(run("scan", str(tmp_path / "b.bin"), "--json")[1])["matches"][0]["value"] == MAIL
    assert run("redact", str(tmp_path / "b.bin"), "--mode", "partial", "--keep-last", "3")[1] == "*" * (len(MAIL) - 3) + MAIL[-3:] + "\n"
    assert json.loads(run("redact", str(tmp_path / "b.bin"), "--json", "--mode", "tokenize")[1])["vault"] == {"<EMAIL_1>": MAIL}
    assert cli.main(["redact", "--mode", "hash", "x"], spark) == 2
    (tmp_path / "d.txt").write_text("go to examp1e.com now")
    code, out = run("domains", str(tmp_path / "d.txt"), "--watchlist", str(tmp_path / "w.list"), "--fail-on-find")
    assert code == 1 and "impersonation\thigh\t-> example.com" in out
    capsys.readouterr()
    assert cli.main(["scan", str(tmp_path / "absent")], spark) == 0 and "can't read" in capsys.readouterr().err


def test_streams_give_what_batches_give(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = S.stream_findings(S.read_stream(docs, str(tmp_path / "in"), maxFilesPerTrigger=1), ["doc_id"])
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    place = ["doc_id", "start", "end", "entity_type"]
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select(*place).collect()) == sorted(q.findings(docs, ["doc_id"]).select(*place).collect())
    seen = []
    S.guarded(S.read_stream(docs, str(tmp_path / "in")), q.Guard(block_categories=("financial",)), str(tmp_path / "audit"), lambda b, n: seen.append(b.count()), str(tmp_path / "c2")).awaitTermination()
    audit = spark.read.json(str(tmp_path / "audit"))
    assert audit.count() == docs.count() and sum(seen) == audit.where("not blocked").count()


def test_a_stream_takes_a_file_and_a_folder_by_the_same_path(spark, sf, tmp_path):
    from qirtas.plans.queries import QUERIES

    for t in ("documents", "events"):
        spark.read.parquet(f"{sf}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("stream_scan", "stream_without_replays"):
        assert (n := QUERIES[name](spark, sf).count()) and QUERIES[name](spark, str(tmp_path)).count() == n
