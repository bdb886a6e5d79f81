"""The rest of the catalogue: helpers, sinks, sources, policy and streams, each with its SQL."""

from __future__ import annotations

import json
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..engine import Engine, SaudiRecognizer
from ..functions import checks
from ..functions.unicode_fold import fold_arabic_digits
from ..operators import classify as C
from ..operators import domains as D
from ..operators.detectors import DEFAULT
from ..operators.guard import Guard, audit_rows, write_audit
from ..operators.redact import highlighted, redacted, restored
from ..operators.scan import filtered, findings, with_findings
from ..schema import FINDINGS
from ..sources import files
from ..sources.scratch import scratch
from ..streaming.scan import read_stream, windowed_counts, without_replays
from .queries import _CALL, _CUSTOMERS, _HOST, _ID, _KIND, _LETTER, _LEVEL, _MAIL, _MIXED, _TO, _hosts, _luhn, _made, _table, query

# Helpers


@query("luhn_check_digit", f"""WITH c AS (SELECT c_custkey AS k, CAST(c_custkey * 7919 AS STRING) AS x FROM customer), d AS (SELECT k, x, unnest(range(10)) AS digit FROM c)
SELECT k, CAST(digit AS INT) AS digit FROM (SELECT *, x || digit AS n FROM d) WHERE {_luhn("n")}""")
def _luhn_digit(spark, sf):
    return _made(spark, sf, "customer", k="c_custkey", x="CAST(c_custkey * 7919 AS STRING)").select("k", checks.luhn_check_digit(F.col("x")).cast("int").alias("digit"))


_CHARS = ["a", "я", "٣", "中", "あ", "א", "ά", "1", "-", "é"]
_SCRIPT = ["Latin", "Cyrillic", "Arabic", "Han", "Kana", "Hebrew", "Greek", "Common", "Common", "Latin"]


def _pick(values, key: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query("script_of", f"SELECT c_custkey AS k, {_pick(_SCRIPT, 'c_custkey')} AS script FROM customer")
def _script(spark, sf):
    return _made(spark, sf, "customer", k="c_custkey", c=_pick(_CHARS, "c_custkey")).select("k", D.script_of(F.col("c")).alias("script"))


@query("scripts_in", f"SELECT c_custkey AS k, {_pick(['Arabic,Latin', 'Cyrillic,Latin', 'Latin', 'Greek,Latin'], 'c_custkey')} AS scripts, c_custkey % 4 <> 2 AS mixed FROM customer")
def _scripts(spark, sf):
    df = _made(spark, sf, "customer", k="c_custkey", label="'x' || " + _pick(["ب", "я", "-", "α"], "c_custkey"))
    return df.select("k", F.array_join(F.array_sort(D.scripts_in(F.col("label"))), ",").alias("scripts"), D.is_mixed(F.col("label")).alias("mixed"))


@query("idna", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'bücher.h' || c_custkey || '.example' ELSE 'plain.h' || c_custkey || '.example' END AS host FROM customer")
def _idna(spark, sf):
    df = _made(spark, sf, "customer", k="c_custkey", host="CASE WHEN c_custkey % 2 = 0 THEN 'xn--bcher-kva' ELSE 'plain' END || '.h' || c_custkey || '.example'")
    return df.select("k", D.decoded(F.col("host")).alias("host"))


@query("own_confusables", "SELECT c_custkey AS k, 'shop' || translate(CAST(c_custkey AS STRING), '0158', 'olsb') AS skeleton FROM customer")
def _own_confusables(spark, sf):
    config = Config.from_dict({"confusables": {"$": "s", "@": "o"}})
    return _made(spark, sf, "customer", k="c_custkey", x="'$h@p' || c_custkey").select("k", D.skeleton(F.col("x"), config.domain_options()["confusables"]).alias("skeleton"))


_TWO = "substr({0}, 2, 1) || substr({0}, 1, 1) || substr({0}, 3, length({0}) - 3)"


@query("osa_distance", f"SELECT c_custkey AS k, CAST(damerau_levenshtein(c_name, {_TWO.format('c_name')}) AS INT) AS d FROM customer")
def _osa(spark, sf):
    return _made(spark, sf, "customer", k="c_custkey", a="c_name", b=_TWO.format("c_name")).select("k", D.distance(F.col("a"), F.col("b")).cast("int").alias("d"))


@query("fold_digits_only", f"WITH c AS ({_CUSTOMERS}) SELECT k, 'ﬁ ' || id AS folded FROM c")
def _fold_digits(spark, sf):
    return _made(spark, sf, "customer", k="c_custkey", x=f"'ﬁ ' || translate({_ID}, '0123456789', '٠١٢٣٤٥٦٧٨٩')").select("k", fold_arabic_digits(F.col("x")).alias("folded"))


@query("without_normalization", f"""WITH c AS ({_CUSTOMERS}) SELECT k, {_KIND} AS entity_type, id AS value FROM c WHERE {_luhn("id")} AND k % 2 = 0""")
def _unnormalized(spark, sf):
    text = f"CASE WHEN c_custkey % 2 = 0 THEN translate({_ID}, '0123456789', '٠١٢٣٤٥٦٧٨٩') ELSE substr({_ID}, 1, 4) || '​' || substr({_ID}, 5) END"
    return findings(_made(spark, sf, "customer", k="c_custkey", text=text), ["k"], normalize=False).select("k", "entity_type", "value")


# Detectors


@query("detect_ipv6", """SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN '2001:db8::' || lower(to_hex(p_partkey % 65536)) ELSE '1:2:3:4:5:6:7:' || lower(to_hex(p_partkey % 65536)) END AS value FROM part WHERE p_partkey % 3 <> 2""")
def _ipv6(spark, sf):
    text = "'from ' || CASE p_partkey % 3 WHEN 0 THEN '2001:db8::' WHEN 1 THEN '1:2:3:4:5:6:7:' ELSE '1:2:3:4:5:6:7:8:' END || lower(hex(p_partkey % 65536)) || ' on'"
    return findings(_made(spark, sf, "part", k="p_partkey", text=text), ["k"]).where("entity_type = 'ip_address'").select("k", "value")


_GIVEN, _FATHER = ["خالد", "سارة", "نورة", "فهد"], ["سالم", "محمد", "ناصر"]


@query("arabic_particles", f"""SELECT c_custkey AS k, {_pick(_GIVEN, 'c_custkey')} || ' بن ' || {_pick(_FATHER, 'c_custkey')} AS value, CAST(4 AS INT) AS start FROM customer WHERE c_custkey % 5 <> 0""")
def _particles(spark, sf):
    text = f"'حضر ' || {_pick(_GIVEN, 'c_custkey')} || CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE ' بن ' END || {_pick(_FATHER, 'c_custkey')} || ' أمس'"
    return findings(_made(spark, sf, "customer", k="c_custkey", text=text), ["k"]).select("k", "value", "start")


@query("arabic_name_once", f"""SELECT c_custkey AS k, {_pick(_GIVEN, 'c_custkey')} || ' بن ' || {_pick(_FATHER, 'c_custkey')} AS value FROM customer""")
def _once(spark, sf):
    text = f"'المريض ' || {_pick(_GIVEN, 'c_custkey')} || ' بن ' || {_pick(_FATHER, 'c_custkey')} || ' اليوم'"
    return findings(_made(spark, sf, "customer", k="c_custkey", text=text), ["k"]).select("k", "value")


@query("config_detectors", f"""SELECT c_custkey AS k, 'custom' AS entity_type, 'TK-' || c_custkey AS value, 'ticket' AS label FROM customer UNION ALL SELECT c_custkey, 'saudi_mobile', {_CALL}, '' FROM customer""")
def _config(spark, sf):
    config = Config.from_dict({"disable": ["email"], "custom_detectors": [{"label": "ticket", "pattern": "TK-[0-9]+", "category": "organisation", "confidence": "high"}]})
    df = _made(spark, sf, "customer", k="c_custkey", text=f"'ticket TK-' || c_custkey || ' by ' || {_MAIL} || ' call ' || {_CALL}")
    return findings(df, ["k"], "text", config.detectors()).select("k", "entity_type", "value", "label")


@query("disable_detectors", "SELECT c_custkey AS k, 'email' AS entity_type FROM customer")
def _disabled(spark, sf):
    return findings(_made(spark, sf, "customer", k="c_custkey", text=_LETTER), ["k"], "text", [d for d in DEFAULT if d.name != "saudi_mobile"]).select("k", "entity_type").distinct()


@query("lookalike_in_scan", f"""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'exаmple.com' WHEN 1 THEN 'exmaple.com' WHEN 2 THEN 'pаypal.net' END AS value, CASE WHEN c_custkey % 4 = 0 THEN 'high' ELSE 'medium' END AS confidence FROM customer WHERE c_custkey % 4 <> 3""")
def _lookalike(spark, sf):
    text = "'see ' || " + _pick(["exаmple.com", "exmaple.com", "pаypal.net", "example.com"], "c_custkey")
    return findings(_made(spark, sf, "customer", k="c_custkey", text=text), ["k"], "text", D.lookalike(["example.com"])).select("k", "value", "confidence")


# Domains


@query("legitimate_skip", f"SELECT DISTINCT 'x' || {_HOST} AS domain, {_HOST} AS target FROM pages WHERE {_HOST} <> ''")
def _legitimate(spark, sf):
    watch = _hosts(spark, sf).withColumnRenamed("host", "target")
    hosts = watch.select(F.col("target").alias("domain")).union(watch.select(F.concat(F.lit("x"), "target").alias("domain")))
    found = D.analysed(hosts, watch).where("reason = 'typosquat' and domain like 'x%'")
    # Only the least change counts here: real hosts may lie near each other as well.
    return found.where(F.col("domain") == F.concat(F.lit("x"), "target")).select("domain", "target")


@query("suspicious_places", f"SELECT c_custkey AS k, 'exаmple.com' AS domain, 'impersonation' AS reason, 'example.com' AS target, CAST(4 + length({_MAIL}) AS INT) AS start FROM customer WHERE c_custkey % 2 = 0")
def _suspicious(spark, sf):
    text = f"'by ' || {_MAIL} || ' ' || CASE WHEN c_custkey % 2 = 0 THEN 'exаmple.com' ELSE 'example.com' END"
    watch = spark.createDataFrame([("example.com",)], "target string")
    return D.suspicious(_made(spark, sf, "customer", k="c_custkey", text=text), ["k"], "text", watch).select("k", "domain", "reason", "target", "start")


@query("domain_lines", "SELECT c_custkey || ':4-15' || chr(9) || 'exаmple.com' || chr(9) || 'impersonation' || chr(9) || 'high' || chr(9) || '-> example.com' || chr(9) || 'looks the same as example.com' AS value FROM customer")
def _domain_lines(spark, sf):
    watch = spark.createDataFrame([("example.com",)], "target string")
    return files.domain_lines(D.suspicious(_made(spark, sf, "customer", source="CAST(c_custkey AS STRING)", text="'see exаmple.com'"), ["source"], "text", watch))


@query("domains_in_pages")
def _domains_in_pages(spark, sf):
    """Hosts in whole addresses and whole pages; held against Python's own search in the tests."""
    return D.domains(_table(spark, sf, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text")), ["page_id"])


# Sources and sinks


@query("undecodable_bytes", "SELECT c_custkey AS k, 'a�' || c_custkey || chr(10) || 'b' AS text FROM customer")
def _bytes(spark, sf):
    df = _made(spark, sf, "customer", k="c_custkey", raw="concat(unhex('61FF'), CAST(c_custkey || '\\r\\nb' AS BINARY))")
    return df.select("k", files.texts_of(F.col("raw")).alias("text"))


@query("read_files", "SELECT string_agg('id ' || c_custkey || ' by u' || c_custkey || '@h.example' || chr(10), '' ORDER BY c_custkey) AS text FROM customer")
def _files(spark, sf):
    folder = scratch(spark, "files")
    _made(spark, sf, "customer", k="c_custkey", value="'id ' || c_custkey || ' by u' || c_custkey || '@h.example'").repartition(1).sortWithinPartitions("k").select("value").write.text(folder)
    return files.read_texts(spark, [folder], [".txt"]).select("text")


@query("read_watchlist", f"SELECT DISTINCT {_HOST} AS target FROM pages WHERE {_HOST} <> ''")
def _watchlist(spark, sf):
    folder = scratch(spark, "watchlist")
    lines = _hosts(spark, sf).select(F.explode(F.array(F.concat(F.lit("\t "), "host", F.lit("  ")), F.lit(""), F.concat(F.lit("# "), "host"))).alias("value"))
    lines.write.text(folder)
    return files.watchlist(spark, folder)


_CUSTOMER_MAIL = f"'mail ' || {_MAIL}"


@query("table_lines", f"SELECT c_custkey || ':5-' || (5 + length({_MAIL})) || chr(9) || 'email' || chr(9) || 'medium' || chr(9) || 'contact' || chr(9) || {_MAIL} AS value FROM customer")
def _lines(spark, sf):
    return files.table_lines(findings(_made(spark, sf, "customer", source="CAST(c_custkey AS STRING)", text=_CUSTOMER_MAIL), ["source"]))


@query("scan_json", f"""SELECT '{{"source":"' || c_custkey || '","matches":[{{"entity_type":"email","category":"contact","confidence":"medium","start":5,"end":' || (5 + length({_MAIL})) || ',"value":"' || {_MAIL} || '","detector":"email","notes":"","label":""}}]}}' AS value FROM customer""")
def _scan_json(spark, sf):
    return files.scan_json(with_findings(_made(spark, sf, "customer", source="CAST(c_custkey AS STRING)", text=_CUSTOMER_MAIL)))


@query("redaction_json", f"""SELECT '{{"text":"mail <EMAIL_1>","count":1,"items":[{{"entity_type":"email","category":"contact","confidence":"medium","original":"' || {_MAIL} || '","replacement":"<EMAIL_1>","start":5,"end":' || (5 + length({_MAIL})) || '}}],"vault":{{"<EMAIL_1>":"' || {_MAIL} || '"}},"source":"' || c_custkey || '"}}' AS value FROM customer""")
def _redaction_json(spark, sf):
    return files.redaction_json(redacted(with_findings(_made(spark, sf, "customer", source="CAST(c_custkey AS STRING)", text=_CUSTOMER_MAIL)), mode="tokenize"))


@query("exit_code_gate", "SELECT true AS found, false AS nothing")
def _gate(spark, sf):
    found = findings(_made(spark, sf, "customer", k="c_custkey", text=_CUSTOMER_MAIL), ["k"])
    return spark.createDataFrame([(files.found_any(found), files.found_any(found.where("entity_type = 'custom'")))], "found boolean, nothing boolean")


@query("highlight", f"SELECT c_custkey AS k, 'a &lt; b<br><mark title=\"email\">' || {_MAIL} || '</mark> &amp; c' AS html FROM customer")
def _highlight(spark, sf):
    df = with_findings(_made(spark, sf, "customer", k="c_custkey", text=f"'a < b\\n' || {_MAIL} || ' & c'"))
    return df.select("k", highlighted(F.col("text"), F.col("findings")).alias("html"))


@query("display_names", "SELECT c_custkey AS k, 'Email,Saudi Mobile,Email' AS names FROM customer")
def _display(spark, sf):
    return with_findings(_made(spark, sf, "customer", k="c_custkey", text=_LETTER)).select("k", F.array_join(F.transform("findings", lambda m: C.display_name(m["entity_type"])), ",").alias("names"))


# Redaction


@query("redaction_counts", "SELECT c_custkey AS k, CAST(3 AS INT) AS n FROM customer")
def _counts(spark, sf):
    return redacted(with_findings(_made(spark, sf, "customer", k="c_custkey", text=_LETTER))).select("k", F.col("redaction.count").alias("n"))


@query("overlap_skip", "SELECT c_custkey AS k, 'x [A] y' AS safe, CAST(1 AS INT) AS n FROM customer")
def _overlaps(spark, sf):
    found = "array(" + ", ".join(f"named_struct('entity_type', '{t}', 'category', 'c', 'confidence', 'low', 'start', {s}, 'end', {e}, 'value', 'v', 'detector', 'd', 'notes', '', 'label', '')" for t, s, e in (("b", 4, 8), ("a", 2, 6))) + ")"
    df = _made(spark, sf, "customer", k="c_custkey", text="'x 1234 y'", findings=found).withColumn("findings", F.col("findings").cast(FINDINGS))
    return redacted(df).select("k", F.col("redaction.text").alias("safe"), F.col("redaction.count").alias("n"))


@query("tokens_by_length", "SELECT c_custkey AS k, array_to_string(list_transform(range(12), lambda i: 'u' || i || '@h' || c_custkey || '.example'), ' ') AS back FROM customer")
def _by_length(spark, sf):
    text = "array_join(transform(sequence(0, 11), i -> 'u' || i || '@h' || c_custkey || '.example'), ' ')"
    df = redacted(with_findings(_made(spark, sf, "customer", k="c_custkey", text=text)), mode="tokenize")
    return df.select("k", restored(F.col("redaction.text"), F.col("redaction.vault")).alias("back"))


# Counts, levels, adapters

_SUMMARY = "CASE c_custkey % 4 WHEN 0 THEN 'medical_record_number=1,email=1' WHEN 1 THEN 'email=1' WHEN 2 THEN 'ip_address=1' ELSE '' END"
_CATEGORIES = "CASE c_custkey % 4 WHEN 0 THEN 'sensitive_health=1,contact=1' WHEN 1 THEN 'contact=1' WHEN 2 THEN 'network=1' ELSE '' END"
_FLAT = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


@query("counts_of_rows", f"SELECT c_custkey AS k, {_SUMMARY} AS entities, {_CATEGORIES} AS categories FROM customer")
def _row_counts(spark, sf):
    df, f = with_findings(_made(spark, sf, "customer", k="c_custkey", text=_MIXED)), F.col("findings")
    return df.select("k", _FLAT(C.counted(F.transform(f, lambda m: m["entity_type"]))).alias("entities"), _FLAT(C.counted(F.transform(f, lambda m: m["category"]))).alias("categories"))


@query("external_projection", f"""WITH c AS ({_CUSTOMERS}) SELECT k, CASE WHEN id[1] = '1' THEN 'SA_NATIONAL_ID' ELSE 'SA_IQAMA' END AS entity_type, 0.95::DOUBLE AS score, CAST(3 AS INT) AS start FROM c WHERE {_luhn("id")}
UNION ALL SELECT c_custkey, 'SA_PHONE_NUMBER', 0.6::DOUBLE, CAST(19 AS INT) FROM customer UNION ALL SELECT c_custkey, 'PERSON', 0.4::DOUBLE, CAST(40 AS INT) FROM customer""")
def _external(spark, sf):
    text = f"'ID ' || {_ID} || ' call ' || {_CALL} || ' المريض ' || {_pick(_GIVEN, 'c_custkey')} || ' ' || {_pick(_FATHER, 'c_custkey')}"
    df = with_findings(_made(spark, sf, "customer", k="c_custkey", text=text))
    return df.select("k", F.inline(C.external(F.col("findings")))).select("k", "entity_type", "score", "start")


@query("external_filter", "SELECT c_custkey AS k, 'SA_PHONE_NUMBER' AS entity_type FROM customer")
def _external_filter(spark, sf):
    df = with_findings(_made(spark, sf, "customer", k="c_custkey", text=f"{_LETTER} || ' ID 1000000008'"))
    return df.select("k", F.inline(C.external(F.col("findings"), ["SA_PHONE_NUMBER"]))).select("k", "entity_type")


@query("recognizer", "SELECT c_custkey AS k, 'SA_PHONE_NUMBER' AS entity_type, CAST(10 + length('u' || c_custkey || '@host' || c_custkey % 7 || '.example') AS INT) + 1 AS start FROM customer")
def _recognizer(spark, sf):
    own = SaudiRecognizer()

    @F.udtf(returnType="entity_type string, start int")
    class Analyze:
        def eval(self, text: str):
            for m in own.analyze(text):
                yield m["entity_type"], m["start"]

    spark.udtf.register("qirtas_analyze", Analyze)
    _made(spark, sf, "customer", k="c_custkey", text=_LETTER).createOrReplaceTempView("qirtas_letters")
    return spark.sql("SELECT k, a.* FROM qirtas_letters, LATERAL qirtas_analyze(text) a")


@query("macro_average", "SELECT 0.75::DOUBLE AS precision, 1.0::DOUBLE AS recall, round(5.0 / 6, 6)::DOUBLE AS f1")
def _macro(spark, sf):
    """Half of the customers have a mail address that is in the truth, and all a telephone number: precision 1/2 and 1."""
    found = findings(_made(spark, sf, "customer", k="c_custkey", text=f"'mail ' || {_MAIL} || ' call ' || {_CALL}"), ["k"])
    one = _made(spark, sf, "customer", k="c_custkey")
    n = one.count()
    some = one.where(F.col("k") < n // 2).select("k", F.lit("email").alias("entity_type"))
    out = C.macro_average(C.quality(some.union(one.select("k", F.lit("saudi_mobile").alias("entity_type"))), found, ["k"]))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("noisy_recall", "SELECT 'medical_record_number' AS entity_type, 1.0::DOUBLE AS recall UNION ALL SELECT 'saudi_mobile', 1.0::DOUBLE")
def _noisy(spark, sf):
    """Recall behind noise, in three formats of a number and six ways to say "record number"."""
    words = ["MRN", "mrn:", "medical record no.", "رقم الملف الطبي", "السجل الطبي", "رقم السجل"]
    dial = "CASE c_custkey % 3 WHEN 0 THEN '05' WHEN 1 THEN '+9665' ELSE '009665' END || lpad(CAST((c_custkey * 7919) % 100000000 AS STRING), 8, '0')"
    df = _made(spark, sf, "customer", k="c_custkey", text=f"'## note ' || {_pick(words, 'c_custkey')} || ' QX-' || (10000 + c_custkey) || ' ; tel ' || translate({dial}, CASE WHEN c_custkey % 5 < 2 THEN '0123456789' ELSE '' END, CASE WHEN c_custkey % 5 < 2 THEN '٠١٢٣٤٥٦٧٨٩' ELSE '' END) || ' …'")
    n = df.count()
    rows = findings(df, ["k"]).where("entity_type in ('medical_record_number', 'saudi_mobile') or (entity_type = 'credit_card' and value like '00966%')")
    # A number with 00 in front may pass for a card as well, which ranks higher.
    rows = rows.select("k", F.when(F.col("entity_type") == "credit_card", "saudi_mobile").otherwise(F.col("entity_type")).alias("entity_type")).distinct()
    return rows.groupBy("entity_type").agg((F.count("*") / n).alias("recall"))


# Policy


@query("inspect", f"SELECT c_custkey AS k, {_SUMMARY} AS entities FROM customer")
def _inspect(spark, sf):
    df = Guard().inspect(_made(spark, sf, "customer", k="c_custkey", text=_MIXED))
    return df.select("k", _FLAT(C.counted(F.transform("findings", lambda m: m["entity_type"]))).alias("entities"))


_AUDITED = f"""SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 3 THEN 'allow' ELSE 'redact' END AS action, {_LEVEL} AS data_classification, {_SUMMARY} AS entities, {_CATEGORIES} AS categories,
 CASE c_custkey % 4 WHEN 0 THEN 'secret=1,confidential=1' WHEN 1 THEN 'confidential=1' WHEN 2 THEN 'public=1' ELSE '' END AS levels, c_custkey % 4 <> 3 AS redacted FROM customer"""


@query("audit_maps", _AUDITED)
def _audit_maps(spark, sf):
    rows = audit_rows(Guard().protect(_made(spark, sf, "customer", k="c_custkey", text=_MIXED, dest=_TO), destination=F.col("dest")), "k")
    return rows.select("k", "action", "data_classification", _FLAT(F.col("entity_summary")).alias("entities"), _FLAT(F.col("category_summary")).alias("categories"), _FLAT(F.col("classification_summary")).alias("levels"), "redacted")


@query("audit_sink", "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 3 THEN 'allow' ELSE 'redact' END AS action FROM customer")
def _audit_sink(spark, sf):
    path = scratch(spark, "audit")
    write_audit(Guard().protect(_made(spark, sf, "customer", k="c_custkey", text=_MIXED)), path, "k")
    return spark.read.schema("k long, action string").json(path)


@query("recorded_values", f"SELECT c_custkey AS k, {_MAIL} AS value FROM customer")
def _recorded(spark, sf):
    rows = audit_rows(Guard(record_values=True).protect(_made(spark, sf, "customer", k="c_custkey", text=_CUSTOMER_MAIL)), "k")
    return rows.select("k", F.explode(F.coalesce("values", F.array())).alias("value"))  # no mere column, as in ``findings``


class _Client:
    """What a chat client looks like; it keeps what it is sent and answers with its last message."""

    def __init__(self) -> None:
        self.sent: list[dict] = []
        self.chat = SimpleNamespace(completions=SimpleNamespace(create=self._create))

    def _create(self, **request):
        self.sent.append(request)
        last = request["messages"][-1]["content"]
        return SimpleNamespace(choices=[SimpleNamespace(message=SimpleNamespace(content=f"got {last if isinstance(last, str) else last[0]['text']}"))])


@query("wrapped_client", "SELECT 'mail <EMAIL_1>' AS sent, 'got mail a@b.example' AS answer UNION ALL SELECT '[{\"type\": \"text\", \"text\": \"id <SAUDI_NATIONAL_ID_1>\"}, {\"type\": \"image_url\"}]', 'got id 1000000008'")
def _wrapped(spark, sf):
    client = _Client()
    inner = Guard(mode="tokenize").wrap(spark, client, restore_response=True)
    rows = []
    for content in ("mail a@b.example", [{"type": "text", "text": "id 1000000008"}, {"type": "image_url"}]):
        answer = inner.create(messages=[{"role": "user", "content": content}]).choices[0].message.content
        sent = client.sent[-1]["messages"][0]["content"]
        rows.append((sent if isinstance(sent, str) else json.dumps(sent), answer))
    return spark.createDataFrame(rows, "sent string, answer string")


@query("engine_on_single_texts", "SELECT c_custkey AS k, 'mail [EMAIL] call [SAUDI_MOBILE] cc [EMAIL]' AS safe FROM customer")
def _engine(spark, sf):
    """Texts one by one through the engine that the driver uses for messages."""
    own = Engine()
    safe = F.arrow_udf(lambda text: pa.array([own.redact(t)[0] for t in text.to_pylist()], pa.string()), "string")
    return _made(spark, sf, "customer", k="c_custkey", text=_LETTER).select("k", safe("text").alias("safe"))


# Streams


def _event_rows(spark: SparkSession, sf: str) -> DataFrame:
    like = _table(spark, sf, "events")
    stream = read_stream(like, f"{sf}/events.parquet")
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("entity_type"), F.lit(0).alias("start"), F.lit(1).alias("end"))


@query("stream_without_replays", "SELECT event_id, event_type AS entity_type FROM events")
def _replays(spark, sf):
    rows = _event_rows(spark, sf)
    twice = rows.union(rows)
    out = scratch(spark, "replays")
    once = without_replays(twice, ["event_id"], "ts", "3650 days").select("event_id", "entity_type")
    once.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema("event_id long, entity_type string").parquet(f"{out}/rows")


@query("windowed_counts", "SELECT CAST(floor(epoch(ts) / 600) AS BIGINT) * 600 AS begin, event_type AS entity_type, count(*) AS n FROM events GROUP BY ALL")
def _windowed(spark, sf):
    rows = _table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("entity_type"))
    return windowed_counts(rows, "ts").select(F.unix_timestamp("window_start").alias("begin"), "entity_type", "n")


# Other operators of tables


@query("union_distinct", "SELECT entity_type FROM (SELECT 'email' AS entity_type FROM customer UNION SELECT 'saudi_mobile' FROM customer)")
def _union_distinct(spark, sf):
    rows = findings(_made(spark, sf, "customer", k="c_custkey", text=_LETTER), ["k"]).select("entity_type").distinct()
    return rows.union(rows).distinct()  # both sides are the one shuffle


@query("filter_in_rows", f"SELECT c_custkey AS k, {_CALL} AS value FROM customer")
def _filter_rows(spark, sf):
    df = with_findings(_made(spark, sf, "customer", k="c_custkey", text=_LETTER))
    return df.select("k", F.inline(filtered(F.col("findings"), only=["saudi_mobile"]))).select("k", "value")
