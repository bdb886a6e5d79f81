"""``python -m qirtas.cli scan|redact|domains``, also through spark-submit."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import domains as D
from .operators.redact import MODES, redacted
from .operators.scan import chunk_findings, filtered, with_findings
from .schema import CONFIDENCE_RANK
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="qirtas", description="find and redact personal data in text files")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "redact", "domains"):
        option = commands.add_parser(name).add_argument
        for flag, help_ in (("--json", "objects in place of lines"), ("--fail-on-find", "exit with 1 if anything is found")):
            option(flag, action="store_true", help=help_)
        option("paths", help="what to read: files, folders, - for the standard input", nargs="*")
        if name == "domains":
            option("--watchlist", help="a file with one domain per line")
            option("--max-distance", type=int, help="of typing errors; the configuration's, or 1")
        option("--config")
        if name == "domains":
            continue
        option("--min-confidence", choices=list(CONFIDENCE_RANK), default="low")
        option("--only", nargs="+", default=[])
        option("--exclude", nargs="+", default=[])
        if name == "scan":
            option("--no-values", action="store_true")
            option("--stream", action="store_true", help="read files of any size in chunks")
        else:
            option("--mode", choices=MODES, default="mask")
            option("--salt", default="")
            option("--hash-length", default=12, type=int)
            option("--keep-last", default=4, type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "redact" and a.mode == "hash" and not a.salt:
        print("--mode hash needs a --salt", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("qirtas").getOrCreate()
    stream = a.command == "scan" and a.stream
    texts = (files.read_chunks if stream else files.read_texts)(spark, a.paths)
    if a.command == "domains":
        watch = files.watchlist(spark, a.watchlist) if a.watchlist else None
        options = (Config.from_file(a.config) if a.config else Config()).domain_options()
        if a.max_distance is not None:
            options["max_distance"] = a.max_distance
        rows = D.suspicious(texts, ["source"], "text", watch, **options).persist()
        files.printed(rows.select(F.to_json(F.struct("*")).alias("value")) if a.json else files.domain_lines(rows))
        return int(a.fail_on_find and files.found_any(rows))
    detectors = Config.from_file(a.config).detectors() if a.config else None
    keep = {"min_confidence": a.min_confidence, "only": a.only, "exclude": a.exclude}
    if stream:
        rows = chunk_findings(texts, ["source"], "text", detectors, chunk=1 << 20)
        found = rows.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("start", "end", "entity_type", "category", "confidence", "value", "detector", "notes", "label"))).alias("findings"))
        found = texts.select("source").distinct().join(found, "source", "left").withColumn("findings", F.coalesce("findings", F.array()))
    else:
        found = with_findings(texts, "text", detectors)
    found = found.withColumn("findings", filtered(F.col("findings"), **keep))
    if a.command == "scan":
        found = found.select("source", "findings").persist()
        rows = found.select("source", F.inline("findings"))
        files.printed(files.scan_json(found) if a.json else files.table_lines(rows, not a.no_values))
        return int(a.fail_on_find and files.found_any(rows))
    out = redacted(found, "text", "findings", a.mode, salt=a.salt, hash_length=a.hash_length, keep_last=a.keep_last).persist()
    if a.json:
        files.printed(files.redaction_json(out))
    else:
        for r in out.select("source", "redaction.text", F.size("redaction.vault").alias("n")).toLocalIterator():
            if len(a.paths) > 1:
                print(f"== {r.source}")
            print(r.text, end="" if r.text.endswith("\n") else "\n")
            if r.n > 0:
                print(f"{r.n} tokens; --json has their vault, to be kept safe", file=sys.stderr)
    return int(a.fail_on_find and files.found_any(out.where(F.size("redaction.items") > 0)))


if __name__ == "__main__":
    sys.exit(main())
