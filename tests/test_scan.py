import ipaddress
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from qirtas import Config, chunked_findings, custom, filtered, findings, from_function, register, registered, unregister_all, with_findings
from qirtas.functions import checks
from qirtas.functions.unicode_fold import normalized
from qirtas.operators.detectors import CR, DEFAULT, MRN
from tests.made import iban, luhn_digit, luhn_ok, national_id

ID, IQAMA, IBAN, CARD = national_id("110203040"), national_id("245566778"), iban("44000000608010167519"[:20]), "411111111111111" + luhn_digit("411111111111111")
VAT = next(x for x in (f"3101122334455{k:02d}" for k in range(99)) if not luhn_ok(x))
CARDLIKE = next(x for x in (f"3101122334455{k:02d}" for k in range(99)) if luhn_ok(x))

#: text, then (type, value, start, end) of all findings
CASES = [
    (f"file of {ID}, closed", [("saudi_national_id", ID, 8, 18)]),
    (f"permit {IQAMA}", [("saudi_iqama", IQAMA, 7, 17)]),
    (f"1{ID} {ID[:-1]}{(int(ID[-1]) + 1) % 10}", []),
    (f"pay {IBAN[:4]} {IBAN[4:8]} {IBAN[8:].lower()}.", [("saudi_iban", IBAN, 4, 30)]),
    (f"card {CARD[:4]}-{CARD[4:8]}-{CARD[8:12]}-{CARD[12:]}", [("credit_card", CARD, 5, 24)]),
    ("call +966512345678 or 0512345678", [("saudi_mobile", "+966512345678", 5, 18), ("saudi_mobile", "0512345678", 22, 32)]),
    ("desk 00966112345678", [("saudi_landline", "00966112345678", 5, 19)]),
    ("to x.y+z@mail.example, from 10.1.2.3 and fe80::1", [("email", "x.y+z@mail.example", 3, 21), ("ip_address", "10.1.2.3", 28, 36), ("ip_address", "fe80::1", 41, 48)]),
    ("256.1.1.1 and 01.2.3.4 and 1.2.3.4.5", []),
    (f"VAT {VAT}", [("saudi_vat", VAT, 4, 19)]),
    (f"parcel {VAT}", []),
    (f"VAT {CARDLIKE}", [("credit_card", CARDLIKE, 4, 19)]),
    ("passport K12345678", [("saudi_passport", "K12345678", 9, 18)]),
    ("short address ABCD1234", [("saudi_national_address", "ABCD1234", 14, 22)]),
    ("الرقم الموحد 7012345678", [("saudi_unified_number", "7012345678", 13, 23)]),
    ("C.R. 4030123456", [("saudi_cr", "4030123456", 5, 15)]),
    ("border no 3012345678", [("saudi_border_number", "3012345678", 10, 20)]),
    ("C.R." + " " * 40 + "4030123456", [("saudi_cr", "4030123456", 44, 54)]),
    ("C.R." + " " * 41 + "4030123456", []),
    ("MRN: AB-1234 stable", [("medical_record_number", "AB-1234", 5, 12)]),
    ("medical record filed", [("medical_record_number", "filed", 15, 20)]),
    ("المريض خالد العتيبي اليوم", [("arabic_name", "خالد العتيبي", 7, 19)]),
    ("حضر عبدالله بن سالم أمس", [("arabic_name", "عبدالله بن سالم", 4, 19)]),
    (f"🙂 {ID[:5]}\u200b{ID[5:]}", [("saudi_national_id", ID, 2, 13)]),
    ("id " + ID.translate({48 + k: 0x660 + k for k in range(10)}), [("saudi_national_id", ID, 3, 13)]),
    ("id " + ID.translate({48 + k: 0xFF10 + k for k in range(10)}) + " ﬁn", [("saudi_national_id", ID, 3, 13)]),
    ("nothing to see here", []),
    ("", []),
]


def spans_of(row):
    return [(f.entity_type, f.value, f.start, f.end) for f in row]


def test_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(-1, None)], "i int, text string")
    got = {r.i: r.findings for r in with_findings(df).collect()}
    assert got.pop(-1) is None
    for i, (text, want) in enumerate(CASES):
        assert spans_of(got[i]) == want, text


def test_without_normalization(spark):
    df = spark.createDataFrame([(ID.translate({48 + k: 0x660 + k for k in range(10)}),), (ID[:3] + "\u200b" + ID[3:],)], "text string")
    assert [spans_of(r.findings) for r in with_findings(df, normalize=False).collect()] == [[("saudi_national_id", ID, 0, 10)], []]


def test_checksums(spark):
    rng = random.Random(1)
    rows = ["".join(rng.choice("0123456789") for _ in range(rng.choice([1, 9, 10, 10, 10, 16]))) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in [*rows, "", "x", "١٢٣"]], "x string")
    df = df.select("x", checks.luhn_is_valid(F.col("x")).alias("l"), checks.national_id_is_valid(F.col("x")).alias("n"), checks.luhn_check_digit(F.col("x")).alias("d"))
    for r in df.collect():
        digits = r.x.isascii() and r.x.isdigit()
        if digits:
            assert r.l == luhn_ok(r.x) and r.d == int(luhn_digit(r.x)) and r.n == (len(r.x) == 10 and r.x[0] in "12" and luhn_ok(r.x))
    bbans = ["".join(rng.choice("0123456789ABCXYZ") for _ in range(20)) for _ in range(300)]
    df = spark.createDataFrame([(iban(b), iban(b)[:9] + " " + iban(b)[9:], b) for b in bbans] + [("GB82WEST12345698765432", "SA", "x")], "a string, b string, c string")
    for r in df.select("a", "c", checks.iban_is_valid(F.col("a")).alias("x"), checks.iban_is_valid(F.col("b")).alias("y"), checks.iban_check_digits(F.lit("SA"), F.col("c")).alias("d")).collect():
        assert r.x and (r.c == "x" or (r.y and r.d == r.a[2:4]))


def test_ip_like_the_standard_library(spark):
    rng = random.Random(2)
    some = ["::", "1::", "::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1::2::3", ":1", "1:", "1:2", "12345::", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7", "1.2.3.4", "1.2.3", "1.2.3.400", "a:b:c:d:e:f:0:1"]
    some += [":".join(rng.choice(["", "1", "ab", "ffff", "0"]) for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def ok(x):
        try:
            return bool(ipaddress.ip_address(x))
        except ValueError:
            return False

    for r in spark.createDataFrame([(x,) for x in some], "x string").select("x", checks.ip_is_valid(F.col("x")).alias("v")).collect():
        assert r.v == ok(r.x), r.x


def test_normalization_and_offsets(spark):
    rng = random.Random(3)
    pool = "ab1 \u200b\u00ad\u180eﬁ①½٣۴Ａ🙂é\u0301ﷺ\u2066"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", normalized(F.col("text")).alias("n"))
    for r in df.collect():
        out, src = "", []
        for i, c in enumerate(r.text):
            if unicodedata.category(c) == "Cf" or c in "\u00ad\u180e":
                continue
            d = str(unicodedata.digit(c)) if "\u0660" <= c <= "\u0669" or "\u06f0" <= c <= "\u06f9" else unicodedata.normalize("NFKC", c)
            out += d
            src += [i] * len(d)
        assert r.n.text == out and (r.n.src or list(range(len(out)))) == src


def test_filters_come_after_resolution(spark):
    df = with_findings(spark.createDataFrame([(f"VAT {CARDLIKE} a@b.example",)], "text string"))
    one = lambda **k: [f.entity_type for f in df.select(filtered(F.col("findings"), **k).alias("f")).first().f]
    assert one() == ["credit_card", "email"] and one(min_confidence="high") == ["credit_card"]
    assert one(only=["saudi_vat"]) == [] and one(exclude=["email"]) == ["credit_card"]


def test_ties_go_to_the_earlier_detector(spark):
    df = spark.createDataFrame([("C.R. and border no 3012345678",)], "text string")
    assert [f.entity_type for f in with_findings(df).first().findings] == ["saudi_cr"]
    assert [f.entity_type for f in with_findings(df, detectors=[d for d in DEFAULT if d is not CR]).first().findings] == ["saudi_border_number"]


def test_custom_and_plugins(spark):
    df = spark.createDataFrame([("ticket TK-42 and 7",), (None,)], "text string")
    config = Config.from_dict({"disable": ["email"], "custom_detectors": [{"label": "ticket", "pattern": "TK-[0-9]+", "category": "organisation", "confidence": "high"}]})
    got = with_findings(df, detectors=config.detectors()).collect()
    assert [(f.entity_type, f.label, f.value, f.detector) for f in got[0].findings] == [("custom", "ticket", "TK-42", "custom:ticket")] and got[1].findings is None
    assert "email" not in {d.name for d in config.detectors()}
    with pytest.raises(ValueError):
        custom("x", "a*")
    with pytest.raises(TypeError):
        register("no detector")
    register(from_function("seven", lambda t: [(t.index("7"), t.index("7") + 1, "7")] if "7" in t else []))
    try:
        assert [f.value for f in with_findings(df).collect()[0].findings] == ["7"] and len(registered()) == 1
    finally:
        unregister_all()


def test_chunks_give_what_the_whole_gives(spark):
    rng = random.Random(4)
    words = ["word", ID, CARD, "a@b.example", "C.R. 4030123456", "10.0.0.1", "text"]
    text = " ".join(rng.choice(words) for _ in range(1500))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    place = ["id", "start", "end", "entity_type", "value"]
    whole = sorted(findings(df, ["id"]).select(*place).collect())
    assert whole and whole == sorted(chunked_findings(df, ["id"], chunk=700, margin=150).select(*place).collect())
    with pytest.raises(ValueError):
        chunked_findings(df, ["id"], chunk=10, margin=10)


def test_no_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = with_findings(df.select("doc_id", "text"), detectors=[MRN])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
