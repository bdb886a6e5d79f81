"""Files of any size, configuration of domains, audit log, recognizers, the engine, linear work."""

import random
import time
import warnings
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import qirtas as q
from qirtas.cli import main
from qirtas.operators.redact import highlight_text, redact_text, restore_text
from qirtas.operators.scan import resolve, scan_text
from qirtas.sources import files
from tests.made import iban, national_id

ID = national_id("110203040")


def test_pieces_are_those_of_the_whole():
    import io

    rng = random.Random(1)
    for n in (0, 1, 9, 10, 11, 19, 20, 21, 22, 100):
        text = "".join(rng.choice("abc") for _ in range(n))
        for margin in (1, 3, 9):
            got = list(files._pieces(io.StringIO(text).read, 10, margin))
            want = [(k, max(k * 10 - margin, 0), text[max(k * 10 - margin, 0) : (k + 1) * 10 + margin]) for k in range(-(-n // 10))]
            assert got == want, (n, margin)


def test_files_in_chunks(spark, tmp_path, capsys, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", f"id {ID}\r\n", "é​ ", "a@b.example, "]) for _ in range(4000))
    (tmp_path / "A.TXT").write_bytes(text.encode() + b"\xff end")
    (tmp_path / "b.iso").write_bytes(b"a@b.example")
    place = ["source", "start", "end", "entity_type", "value"]
    whole = sorted(q.findings(files.read_texts(spark, [str(tmp_path)]), ["source"]).select(*place).collect())
    cut = files.read_chunks(spark, [str(tmp_path)], chunk=1000, margin=200)
    assert {r.source for r in cut.collect()} == {str(tmp_path / "A.TXT")}
    got = sorted(q.chunk_findings(cut, ["source"], chunk=1000).select(*place).collect())
    assert len(whole) > 500 and [tuple(r) for r in got] == [tuple(r) for r in whole]
    assert main(["scan", "--stream", "--fail-on-find", str(tmp_path)], spark) == 1
    assert len(capsys.readouterr().out.splitlines()) == len(whole)
    monkeypatch.setattr(files, "MOST", 100)
    assert files.read_texts(spark, [str(tmp_path)]).count() == 0 and "too long" in capsys.readouterr().err


def test_watchlist_and_domain_configuration(spark, tmp_path, capsys):
    (tmp_path / "w").write_text("# none\n\texample.com\t\n\n  other.org\n")
    assert {r.target for r in files.watchlist(spark, str(tmp_path / "w")).collect()} == {"example.com", "other.org"}
    (tmp_path / "t.txt").write_text("see ex@mple.com and ex%mple.com and exmapel.com")
    (tmp_path / "c.json").write_text('{"confusables": {"%": "a"}, "typosquat_max_distance": 2}')
    main(["domains", "--watchlist", str(tmp_path / "w"), str(tmp_path / "t.txt")], spark)
    assert "ex%mple.com\timpersonation" not in capsys.readouterr().out
    main(["domains", "--watchlist", str(tmp_path / "w"), "--config", str(tmp_path / "c.json"), str(tmp_path / "t.txt")], spark)
    out = capsys.readouterr().out
    assert "ex%mple.com\timpersonation" in out and "exmapel.com\ttyposquat" in out
    own = q.Config.from_file(tmp_path / "c.json").detectors(["example.com"])
    got = q.Engine(tuple(own)).scan("see ex%mple.com")
    assert [(m["entity_type"], m["confidence"]) for m in got] == [("suspicious_domain", "high")]


def test_audit_log_and_older_proxy(spark, tmp_path):
    seen = []
    log = q.AuditLog(str(tmp_path / "a.jsonl"), seen.append)
    sent = []
    client = SimpleNamespace(chat=SimpleNamespace(completions=SimpleNamespace(create=lambda **k: sent.append(k) or SimpleNamespace(choices=[]))))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        proxy = q.Guard(audit_log=log).guard_openai(spark, client, destination="https://x.example")
    assert [w.category for w in said] == [DeprecationWarning]
    proxy.chat.completions.create(model="m", messages=[{"role": "user", "content": f"id {ID}"}])
    assert sent[0]["messages"][0]["content"] == "id [SAUDI_NATIONAL_ID]" and sent[0]["model"] == "m"
    assert len(log.records) == len(seen) == len((tmp_path / "a.jsonl").read_text().splitlines()) == 1
    assert log.records[0]["cross_border_transfer"] and log.records[0]["entity_summary"] == {"saudi_national_id": 1}


def test_recognizers():
    saudi, domain = q.recognizers(watchlist=["example.com"])
    assert "SA_IQAMA" in saudi.supported_entities and "PERSON" in saudi.supported_entities and domain.supported_entities == ["SUSPICIOUS_DOMAIN"]
    text = f"id {ID} a@b.example mobile 0512345678 at examp1e.com"
    assert [(m["entity_type"], m["score"]) for m in saudi.analyze(text)] == [("SA_NATIONAL_ID", 0.95), ("SA_PHONE_NUMBER", 0.6)]
    assert [m["entity_type"] for m in saudi.analyze(text, ["SA_PHONE_NUMBER"])] == ["SA_PHONE_NUMBER"]
    assert [text[m["start"] : m["end"]] for m in domain.analyze(text)] == ["examp1e.com"]
    got = []
    q.register_recognizers(SimpleNamespace(registry=SimpleNamespace(add_recognizer=got.append)))
    assert [r.name for r in got] == ["QirtasSaudiRecognizer"]


def test_names_for_people_and_external_filter(spark):
    df = q.with_findings(spark.createDataFrame([(f"id {ID} call 0512345678",)], "text string"))
    shown = F.transform("findings", lambda m: q.display_name(m["entity_type"]))
    r = df.select(shown.alias("s"), q.external(F.col("findings"), ["SA_PHONE_NUMBER"]).alias("x")).first()
    assert r.s == ["Saudi National ID", "Saudi Mobile"] and [x.entity_type for x in r.x] == ["SA_PHONE_NUMBER"]
    assert q.scan_and_redact(df.select("text")).first().redaction["count"] == 2


def test_macro_average(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, entity_type string")
    found = spark.createDataFrame([(1, "a"), (3, "b"), (4, "b"), (5, "c")], "k int, entity_type string")
    got = q.quality(truth, found, ["k"])
    by = {r.entity_type: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in got.collect()}
    assert by == {"a": (1, 0, 1, 1.0, 0.5), "b": (1, 1, 0, 0.5, 1.0), "c": (0, 1, 0, 0.0, 1.0)}
    assert q.macro_average(got).first().recall == pytest.approx(2.5 / 3)


def test_accepting_by_search_is_accepting_by_looking_at_all():
    rng = random.Random(3)
    for _ in range(200):
        rows = []
        for i in range(rng.randint(0, 30)):
            start, size = rng.randint(0, 60), rng.randint(1, 9)
            rows.append((-rng.randint(1, 3), -size, start, rng.randint(0, 3), i, start + size))
        kept = []
        for x in sorted(rows):
            if not any(k[2] < x[5] and x[2] < k[5] for k in kept):
                kept.append(x)
        assert resolve(list(rows)) == sorted(kept, key=lambda x: x[2])


def dense(rng, size):
    filler = "the patient came to the clinic and a report was filed for review by the physician on duty "
    out, n = [], 0
    while n < size:
        out.append(filler + f"id {national_id('1%08d' % rng.randrange(10**8))} iban {iban('%020d' % rng.randrange(10**20))} mob +9665{rng.randrange(10**8):08d} ")
        n += len(out[-1])
    return "".join(out)


def test_work_is_in_proportion_to_the_text():
    rng, detectors, took = random.Random(4), q.Engine().detectors, {}
    scan_text(dense(rng, 50_000), detectors)
    for size in (200_000, 1_600_000):
        text = dense(rng, size)
        began = time.process_time()
        found = scan_text(text, detectors)
        items = [{"start": s, "end": e, "value": v, "entity_type": k, "label": "", "category": "", "confidence": ""} for s, e, _, v, k in found]
        safe, _, vault = redact_text(text, items, "tokenize")
        assert restore_text(safe, vault) == text and len(found) == 3 * text.count("id 1")
        took[size] = time.process_time() - began
    assert took[1_600_000] < 8 * took[200_000] * 2.5, took


def test_restoring_in_one_pass_or_in_turn():
    assert restore_text("a <X_1> b <X_11> <Y_1>", {"<X_1>": "one", "<X_11>": "eleven"}) == "a one b eleven <Y_1>"
    # What stands for a token may hold another token: then the longest goes first, as it always did.
    assert restore_text("<X_10>", {"<X_10>": "<X_1>", "<X_1>": "z"}) == "z"
    found = [{"start": 2, "end": 3, "label": "", "entity_type": "t"}, {"start": 0, "end": 1, "label": "<l>", "entity_type": "t"}]
    assert highlight_text("a\n&<", found) == '<mark title="&lt;l&gt;">a</mark><br><mark title="t">&amp;</mark>&lt;'


def test_entry_says_why_the_rest_is_absent(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "qirtas", tmp_path / "qirtas")
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.rmtree(tmp_path / "qirtas/llm", ignore_errors=True)
    (tmp_path / "qirtas/llm").mkdir()
    (tmp_path / "qirtas/llm/__init__.py").write_text("")
    (tmp_path / "qirtas/llm/queries.py").write_text("import a_package_that_nobody_has\n")
    code = "import __spark_entry__ as e; assert 'a_package_that_nobody_has' in e.ABSENT[0] and 'detect_email' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
