"""Sensitivity levels, counts and quality measures over findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DISPLAY_NAMES, EXTERNAL_NAMES, EXTERNAL_SCORES, LEVEL_OF_CATEGORY, LEVELS, PERSONAL


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def level_of(category: Column) -> Column:
    """The level of a category; confidential, if nobody said."""
    return F.coalesce(_lookup(LEVEL_OF_CATEGORY, category), F.lit("confidential"))


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1


def highest_level(found: Column) -> Column:
    """The highest level among findings; null where there are none."""
    levels = F.transform(found, lambda m: level_of(m["category"]))
    return F.get(F.array_sort(levels, lambda a, b: (level_rank(b) - level_rank(a)).cast("int")), F.lit(0))


def counted(values: Column) -> Column:
    """map<value, how often>, in order of appearance."""
    return F.map_from_entries(F.transform(F.array_distinct(values), lambda k: F.struct(k.alias("key"), F.size(F.filter(values, lambda v: v == k)).alias("value"))))


def level_counts(found: Column) -> Column:
    return counted(F.transform(found, lambda m: level_of(m["category"])))


def has_personal(found: Column) -> Column:
    return F.exists(found, lambda m: m["category"].isin(list(PERSONAL)))


def has_health(found: Column) -> Column:
    return F.exists(found, lambda m: m["category"] == "sensitive_health")


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Findings (one row each) counted by columns; one shuffle, after a partial count in every task."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def display_name(entity_type: Column) -> Column:
    """What a type is called before people."""
    return F.coalesce(_lookup(DISPLAY_NAMES, entity_type), F.initcap(F.replace(entity_type, F.lit("_"), F.lit(" "))))


def external(found: Column, entities: Sequence[str] = ()) -> Column:
    """Findings under the names and scores of another tool, those of ``entities`` only if there are any; types that it has
    no name for are left out."""
    names = [t for t, n in EXTERNAL_NAMES.items() if not entities or n in entities]
    named = F.filter(found, lambda m: m["entity_type"].isin(names))
    return F.transform(named, lambda m: F.struct(_lookup(EXTERNAL_NAMES, m["entity_type"]).alias("entity_type"), m["start"].alias("start"), m["end"].alias("end"), _lookup(EXTERNAL_SCORES, m["confidence"]).alias("score")))


def quality(truth: DataFrame, found: DataFrame, keys: list[str], by: str = "entity_type") -> DataFrame:
    """tp, fp, fn, precision, recall and f1 by type: findings against the truth, both one row each, joined on ``keys`` and the type."""
    on = [*keys, by]
    both = truth.select(*on, F.lit(1).alias("t")).distinct().join(found.select(*on, F.lit(1).alias("f")).distinct(), on, "full")
    yes = lambda c: F.coalesce(c, F.lit(0))
    n = both.groupBy(by).agg(
        F.sum(yes(F.col("t")) * yes(F.col("f"))).alias("tp"), F.sum((1 - yes(F.col("t"))) * yes(F.col("f"))).alias("fp"), F.sum(yes(F.col("t")) * (1 - yes(F.col("f")))).alias("fn")
    )
    share = lambda a, b, none: F.when(b > 0, a / b).otherwise(none)
    n = n.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn"), 1.0))
    return n.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def macro_average(measured: DataFrame) -> DataFrame:
    """One row: precision, recall and f1 averaged over the types, each counting as much."""
    return measured.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
