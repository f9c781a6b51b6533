"""Scans of documents and lines, and tables of readings."""

from __future__ import annotations

import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = re.compile(r"[A-Za-z](?:[A-Za-z'-]*[A-Za-z])?")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One document a file: text."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def inline(spark: SparkSession, *parts: str) -> DataFrame:
    """One document: the parts joined by a space."""
    return spark.createDataFrame([(" ".join(parts),)], "text string")


def standard_input(spark: SparkSession) -> DataFrame:
    """One document: all that stands on the driver's standard input."""
    return spark.createDataFrame([(sys.stdin.read(),)], "text string")


def lines(df: DataFrame, text: str = "text", keep_last_empty: bool = True) -> DataFrame:
    """The frame's rows, one for each line: line_no from 1, line without its line end.

    A text that ends in a line feed has one more, empty line, unless keep_last_empty is false. Null has no lines.
    """
    parts = F.split(F.col(text), "\n", -1)
    if not keep_last_empty:
        parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    found = df.select(*others, F.posexplode(parts).alias("_at", "_line"))
    return found.select(*others, (F.col("_at") + 1).alias("line_no"), F.regexp_replace("_line", "\r$", "").alias("line"))


class VocabularyError(ValueError):
    """A table of readings that breaks a rule; the message has the line."""


def checked(pairs: list[tuple[str, str, str]], trimmed: bool = True) -> dict[str, str]:
    """Readings by lower-case word. pairs: where it stands, word, reading."""
    out: dict[str, str] = {}
    for where, word, reading in pairs:
        if not KEY.fullmatch(word):
            raise VocabularyError(f"{where}: {word!r} is no Latin word")
        if not reading or (trimmed and reading != reading.strip()):
            raise VocabularyError(f"{where}: a reading must not be empty{' or have blanks at its ends' if trimmed else ''}")
        if word.lower() in out:
            raise VocabularyError(f"{where}: {word!r} stands twice")
        out[word.lower()] = reading
    return out


def load_vocabulary(path: str) -> dict[str, str]:
    """A tab-separated file with the header latin, cyrillic; blank lines and those from # on are passed over."""
    with open(path, encoding="utf-8-sig", newline="") as file:
        rows = [(i, line.rstrip("\r\n")) for i, line in enumerate(file, 1)]
    rows = [(i, line) for i, line in rows if line.strip() and not line.startswith("#")]
    if not rows or rows[0][1] != "latin\tcyrillic":
        raise VocabularyError("the header must be latin, a tab, cyrillic")
    cells = [(i, line.split("\t")) for i, line in rows[1:]]
    for i, c in cells:
        if len(c) != 2:
            raise VocabularyError(f"line {i}: two columns are expected")
    return checked([(f"line {i}", c[0], c[1]) for i, c in cells])


def vocabulary_from(readings: dict[str, str]) -> dict[str, str]:
    for k, v in readings.items():
        if not isinstance(k, str) or not isinstance(v, str):
            raise TypeError("words and readings are strings")
    return checked([("entry", k, v) for k, v in readings.items()], trimmed=False)
