"""Spans and summaries as lines of text: tab-separated and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kobza.operators.spans import SEVERITIES, rank

FIELDS = ["start", "stop", "severity", "category", "text", "reason"]


def span_json(spans: Column) -> Column:
    """An array of spans as JSON, with the fields in their order."""
    return F.to_json(F.transform(spans, lambda s: F.struct(*[s[f].alias(f) for f in FIELDS])))


def line_json(line_no: Column, text: Column, spans: Column) -> Column:
    return F.to_json(F.struct(line_no.alias("line"), text.alias("text"), F.transform(spans, lambda s: F.struct(*[s[f].alias(f) for f in FIELDS])).alias("spans")))


def span_rows(df: DataFrame, spans: str, line_no: str | None = None) -> DataFrame:
    """A row for each span: value, its fields separated by tabs, after the line number if there is one."""
    rows = df.select(*([line_no] if line_no else []), F.explode(spans).alias("_s"))
    return rows.select(F.concat_ws("\t", *([F.col(line_no).cast("string")] if line_no else []), *[F.col(f"_s.{f}").cast("string") for f in FIELDS]).alias("value"))


def write_texts(df: DataFrame, column: str, path: str) -> None:
    """One text a line, as text files."""
    df.select(F.col(column).alias("value")).write.text(path)


def exit_code(found: DataFrame, severity: str) -> int:
    """2 if any span is at least as severe, else 0. found: a row for each span."""
    return 0 if found.where(rank(F.col("severity")) >= SEVERITIES.index(severity)).isEmpty() else 2
