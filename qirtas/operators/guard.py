"""Policy before text leaves: scan, decide to allow, redact or block, and keep an audit record."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from os import PathLike
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .classify import counted, has_health, has_personal, highest_level, level_counts
from .detectors import Detector
from .redact import MODES, hashed, parts, restored
from .scan import with_findings


def host_of(destination: Column) -> Column:
    """The host of a destination with or without scheme, lower case; null if there is none."""
    full = F.when(destination.contains("://"), destination).otherwise(F.concat(F.lit("//"), destination))
    place = F.regexp_replace(F.regexp_extract(full, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1), "^.*@", "")
    host = F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)", 1)).otherwise(F.substring_index(place, ":", 1))
    return F.nullif(F.lower(host), F.lit(""))


def is_in_kingdom(destination: Column, allowed: Sequence[str] = ()) -> Column:
    """True, false or null (unknown): a host under .sa, or one that is allowed or under one that is."""
    host = host_of(destination)
    ok = (host == "sa") | host.endswith(".sa")
    for h in sorted({h.lower() for h in allowed}):
        ok = ok | (host == h) | host.endswith(f".{h}")
    return ok


class AuditLog:
    """Takes audit records of messages that were protected on the driver: kept in ``records``, appended to a file of JSON
    lines and given to a function, if there are such. Audits of tables go by ``write_audit``."""

    def __init__(self, path: str | PathLike[str] | None = None, sink: Callable[[dict], object] | None = None):
        self.file, self.sink = Path(path) if path else None, sink
        self.records: list[dict] = []

    def record(self, one: dict) -> None:
        self.records += [one]
        if self.file:
            with self.file.open("a", encoding="utf-8") as lines:
                print(json.dumps(one, ensure_ascii=False), file=lines)
        if self.sink:
            self.sink(one)


@dataclass(frozen=True)
class Guard:
    """What may pass. Blocked text comes back masked whatever the mode, without a vault."""

    detectors: tuple[Detector, ...] | None = None
    mode: str = "mask"
    in_kingdom_hosts: tuple[str, ...] = ()
    block_categories: tuple[str, ...] = ()
    block_cross_border: bool = False
    record_values: bool = False
    salt: str = ""
    audit_log: AuditLog | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"no such mode: {self.mode}")
        if self.mode == "hash":
            hashed(F.lit(""), self.salt)

    def inspect(self, df: DataFrame, column: str = "text") -> DataFrame:
        return with_findings(df, column, self.detectors)

    def protect(self, df: DataFrame, column: str = "text", destination: str | Column | None = None) -> DataFrame:
        """``df`` with ``findings``, ``safe_text``, ``vault``, ``blocked`` and the ``audit`` record of each row.

        ``destination`` is a string for all rows or a column. The time of an audit is that of the query.
        """
        to = F.lit(destination).cast("string") if destination is None or isinstance(destination, str) else destination
        out = self.inspect(df, column)
        if self.mode != "mask":
            out = parts(out, column, "findings", self.mode, salt=self.salt, name="_qirtas_own")
        out = parts(out, column, "findings", "mask", name="_qirtas_mask")
        own = "_qirtas_own" if self.mode != "mask" else "_qirtas_mask"
        f = F.col("findings")
        kingdom, personal = is_in_kingdom(to, self.in_kingdom_hosts), has_personal(f)
        crossing = personal & to.isNotNull() & ~F.coalesce(kingdom, F.lit(False))
        block = F.exists(f, lambda m: m["category"].isin(list(self.block_categories)))
        block = F.coalesce(block | crossing if self.block_cross_border else block, F.lit(False))
        action = F.when(block, "block").when(F.size(f) > 0, "redact").otherwise("allow")
        no_vault = F.create_map().cast("map<string,string>")
        audit = F.struct(
            F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
            to.alias("destination"),
            host_of(to).alias("destination_host"),
            kingdom.alias("in_kingdom"),
            F.coalesce(crossing, F.lit(False)).alias("cross_border_transfer"),
            action.alias("action"),
            F.coalesce(personal, F.lit(False)).alias("personal_data_present"),
            F.coalesce(has_health(f), F.lit(False)).alias("health_data_present"),
            counted(F.transform(f, lambda m: m["entity_type"])).alias("entity_summary"),
            counted(F.transform(f, lambda m: m["category"])).alias("category_summary"),
            (action == "redact").alias("redacted"),
            block.alias("blocked"),
            highest_level(f).alias("data_classification"),
            level_counts(f).alias("classification_summary"),
            (F.transform(f, lambda m: m["value"]) if self.record_values else F.lit(None).cast("array<string>")).alias("values"),
        )
        safe = F.when(action == "block", F.col("_qirtas_mask_text")).when(action == "redact", F.col(f"{own}_text")).otherwise(F.col(column))
        return out.withColumns({"safe_text": safe, "vault": F.when(block, no_vault).otherwise(F.col(f"{own}_vault")), "blocked": block, "audit": audit}).drop(*[f"_qirtas_{m}_{x}" for m in ("own", "mask") for x in ("text", "items", "vault")])

    def protect_conversations(self, df: DataFrame, key: str = "conv_id", order: str = "turn", column: str = "text", destination: str | Column | None = None) -> DataFrame:
        """One row per conversation: its safe messages in order, its audits, the vault by message, and whether any is blocked.

        The vault keeps the order column beside each token, since equal tokens of two messages can stand for different text.
        """
        safe = self.protect(df, column, destination)
        rest = [c for c in df.columns if c not in (key, order, column)]
        one = F.struct(F.col(order).alias("order"), *[F.col(c) for c in rest], F.col("safe_text").alias("text"), "audit", "vault", "blocked")
        # A map can't be ordered, so the structs are compared by their order (nulls first) alone.
        by_order = lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).when(a["order"].isNull() & b["order"].isNotNull(), -1).when(a["order"].isNotNull() & b["order"].isNull(), 1).otherwise(0)
        all_ = safe.groupBy(key).agg(F.array_sort(F.collect_list(one), by_order).alias("m"), F.bool_or("blocked").alias("blocked"))
        messages = F.transform("m", lambda x: F.struct(x["order"].alias(order), *[x[c].alias(c) for c in rest], x["text"].alias(column)))
        vault = F.flatten(F.transform("m", lambda x: F.transform(F.map_entries(x["vault"]), lambda e: F.struct(x["order"].alias(order), e["key"].alias("token"), e["value"].alias("original")))))
        return all_.select(key, messages.alias("messages"), F.transform("m", lambda x: x["audit"]).alias("audits"), vault.alias("vault"), "blocked")

    # On the driver, for a few messages on their way to a client.

    def protect_texts(self, spark: SparkSession, texts: Sequence[str], destination: str | None = None) -> list:
        if not texts:
            return []
        rows = self.protect(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "text", destination)
        out = rows.select("i", "safe_text", "vault", "blocked", "audit").orderBy("i").collect()
        if self.audit_log:
            for r in out:
                self.audit_log.record(r.audit.asDict(True))
        return out

    def protect_messages(self, spark: SparkSession, messages: Sequence[dict], destination: str | None = None) -> tuple[list, list, dict, bool]:
        """Safe messages, audits, the merged vault (later messages win) and whether any is blocked.

        A message's content is a string, a list of parts of which those with a ``text`` count, or nothing.
        """
        texts: list[str] = []

        def collect(text: str) -> int:
            texts.append(text)
            return len(texts) - 1

        def places(content):
            if isinstance(content, str) and content:
                return collect(content)
            if isinstance(content, list):
                return [collect(p["text"]) if isinstance(p, dict) and isinstance(p.get("text"), str) and p["text"] else None for p in content]
            return None

        where = [places(m.get("content") if isinstance(m, dict) else None) for m in messages]
        rows = self.protect_texts(spark, texts, destination)
        safe: list = []
        for m, w in zip(messages, where):
            if w is None:
                safe.append(m)
            elif isinstance(w, int):
                safe.append({**m, "content": rows[w].safe_text})
            else:
                safe.append({**m, "content": [p if i is None else {**p, "text": rows[i].safe_text} for p, i in zip(m["content"], w)]})
        vault: dict = {}
        for r in rows:
            vault.update(r.vault)
        return safe, [r.audit.asDict(True) for r in rows], vault, any(r.blocked for r in rows)

    def wrap(self, spark: SparkSession, client, *, restore_response: bool = False, destination: str | None = None, provider: str = "auto"):
        """A stand-in for a chat client whose ``create`` protects what it sends. PermissionError where it is blocked."""
        from ..providers import resolve_adapter

        return Guarded(self, spark, client, resolve_adapter(client, provider), destination, restore_response)


    def guard_openai(self, spark: SparkSession, client, *, destination: str | None = None, restore_response: bool = False):
        """The older way to ``wrap(..., provider="openai")``: a proxy with ``chat.completions.create``."""
        warnings.warn("use wrap(client, provider='openai')", DeprecationWarning, stacklevel=2)
        inner = self.wrap(spark, client, restore_response=restore_response, destination=destination, provider="openai")
        return SimpleNamespace(chat=SimpleNamespace(completions=inner))


@dataclass
class Guarded:
    guard: Guard
    spark: SparkSession
    client: object
    adapter: object
    destination: str | None
    restore_response: bool
    audits: list | None = None

    def create(self, **request):
        request = dict(request)
        self.audits, vault, blocked = self.adapter.redact_request(self.guard, self.spark, request, self.destination)
        if blocked:
            raise PermissionError("blocked by policy")
        response = self.adapter.invoke(self.client, request)
        if self.restore_response and self.guard.mode == "tokenize" and not request.get("stream"):
            self.adapter.restore_response(response, vault)
        return response


def audit_rows(protected: DataFrame, *keys: str) -> DataFrame:
    """The audit records as rows, ready for ``.write.mode("append").json`` or a stream's ``foreachBatch``."""
    return protected.select(*keys, "audit.*")


def write_audit(protected: DataFrame, path: str, *keys: str) -> None:
    audit_rows(protected, *keys).write.mode("append").json(path)


restore = restored
