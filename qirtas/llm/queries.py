"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, langid, linededup, neardup, ogg, packing, quality, spm, topk, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_sentencepiece": spm.op2_sentencepiece,
        "op3_ogg": ogg.op3_ogg,
        "op4_simhash": neardup.op4_simhash,
        "op5_language_id": langid.op5_language_id,
        "op6_quality": quality.op6_quality,
        "op7_line_dedup": linededup.op7_line_dedup,
        "op8_chat_format": chat.op8_chat_format,
        "op9_topk": topk.op9_topk,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_chat_format": chat.SQL, "op9_topk": topk.SQL}
