"""Operators on arrays of spans: severity filters, first-wins duplicates, containment, and summaries.

A span is a struct with start, stop (code points, exclusive), text, reason, category and severity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in the order of summaries.
SEVERITIES = ["Info", "Warning", "Error"]
CATEGORIES = [
    "AmbiguousAbbreviation", "BareNumber", "Currency", "Date", "Identifier", "ForeignWord", "MixedScript", "RomanNumeral", "Unit", "Web",
    "InvalidDate", "AmbiguousNumberGrouping", "Agreement", "Time", "Fraction", "Network", "Scientific", "Coordinate",
]
SPAN = "struct<start: int, stop: int, text: string, reason: string, category: string, severity: string>"


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1


def at_least(spans: Column, severity: str) -> Column:
    return F.filter(spans, lambda s: rank(s["severity"]) >= SEVERITIES.index(severity))


def reaches(spans: Column, severity: str) -> Column:
    return F.exists(spans, lambda s: rank(s["severity"]) >= SEVERITIES.index(severity))


def first_of_each(found: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows with one key, start and stop the first in the order: the detector that found a place first keeps it."""
    window = Window.partitionBy(key, "start", "stop").orderBy(*order)
    return found.withColumn("_first", F.row_number().over(window)).where("_first = 1").drop("_first")


def not_inside(found: DataFrame, holders: DataFrame, key: str, strictly: bool) -> DataFrame:
    """Rows whose span lies in none of the holders' of the same key (strictly: the same span doesn't count)."""
    h = holders.select(F.col(key).alias("_holder"), F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    inside = (F.col(key) == F.col("_holder")) & (F.col("_start") <= F.col("start")) & (F.col("_stop") >= F.col("stop"))
    if strictly:
        inside &= (F.col("_start") < F.col("start")) | (F.col("_stop") > F.col("stop"))
    return found.join(h, inside, "left_anti")


def summarize(found: DataFrame) -> DataFrame:
    """kind, name and count of all spans, of each severity and of each category, in that order; ord is the order."""
    rows = found.groupingSets([[], [F.col("severity")], [F.col("category")]], "severity", "category").agg(F.count("*").alias("count"))
    order = F.when(F.col("severity").isNotNull(), 1 + rank(F.col("severity"))).when(F.col("category").isNotNull(), 10 + F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))).otherwise(0)
    kind = F.when(F.col("severity").isNotNull(), F.lit("severity")).when(F.col("category").isNotNull(), F.lit("category")).otherwise(F.lit("total"))
    return rows.select(order.cast("long").alias("ord"), kind.alias("kind"), F.coalesce("severity", "category", F.lit("total")).alias("name"), "count")
