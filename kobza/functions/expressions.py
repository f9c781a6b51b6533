"""Small building blocks of Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def words(values: Sequence[str]) -> Column:
    """A constant array, as one literal that the optimizer splits once."""
    return F.split(F.lit("|".join(values)), "[|]", -1)


def match_map(text: Column, pattern: str, replace: Callable[[Column, Column], Column]) -> Column:
    """Each match of the pattern replaced by replace(match, gap): gap is the text since the match before it.

    One pass of the regular expression engine finds the gaps and one the matches; nothing leaves the JVM.
    """
    found = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit(None).cast("string")))
    parts = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.concat(gap, F.when(m.isNull(), F.lit("")).otherwise(replace(m, gap))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


MATCH = "struct<start: int, stop: int, text: string>"


def matches(text: Column, pattern: str) -> Column:
    """All matches with their places in code points, stop exclusive: array<struct<start, stop, text>>."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("long"), m.alias("text")))
    none = F.expr(f"cast(array() as array<{MATCH}>)")

    def add(acc: Column, x: Column) -> Column:
        start, stop = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["long"]
        return F.when(x["long"].isNull(), acc).otherwise(F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["text"].alias("text")))).alias("out")))

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]
    return F.when(text.rlike(pattern), walked).when(text.isNotNull(), none)
