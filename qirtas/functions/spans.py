"""Regular-expression matches with offsets, as Column expressions.

Python's ``\\d \\w \\s`` are Unicode classes and Java's are not, so patterns are written with the classes below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

D = r"\p{Nd}"
W = r"\p{L}\p{N}_"
S = r"\s\x1c-\x1f\x85\xa0  -     　"


def spans(text: Column, pattern: str, group: int = 0, gate: str | Column | None = None) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, in order; rows that fail ``gate`` aren't searched.

    The pattern must not match the empty string. With ``group`` the span is that of the group, which must be the
    last thing in the pattern. Offsets count code points. Matches and the text between them are cut out by the
    same automaton run each, so offsets are running sums of their lengths.
    """
    rx = F.lit(pattern)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    parts = [found.alias("m"), F.split(text, pattern, -1).alias("p")] + ([F.regexp_extract_all(text, rx, F.lit(group)).alias("v")] if group else [])

    def walk(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["p"]) + F.length(x["m"])
        value = x["v"] if group else x["m"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")))).alias("out"))

    # The last of the parts between has no match behind it.
    steps = F.filter(F.arrays_zip(*parts), lambda x: x["m"].isNotNull())
    walked = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), walk, lambda a: a["out"])
    test = text.rlike(gate if gate is not None else pattern) if not isinstance(gate, Column) else gate
    return F.when(test, walked).otherwise(none)
