"""The same expressions on a stream as on a table, and counts by window."""

from pyspark.sql import functions as F

from kobza.functions.expressions import matches
from kobza.functions.text import transliterate_to_cyrillic
from kobza.streaming.text import line_stream, span_counts


def drained(query):
    query.awaitTermination(60)
    assert query.exception() is None


def test_lines_and_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("shum 5\nkyiv 7 8\n")
    lines = line_stream(spark, str(folder))
    drained(lines.select(transliterate_to_cyrillic(F.col("line")).alias("x")).writeStream.format("memory").queryName("said").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start())
    assert {r.x for r in spark.table("said").collect()} == {"шум 5", "кїв 7 8"}
    spans = F.transform(matches(F.col("line"), "[0-9]+"), lambda m: F.struct(m["start"].alias("start"), F.lit("BareNumber").alias("category"), F.lit("Warning").alias("severity")))
    counts = span_counts(lines.withColumn("spans", spans), "spans", "arrived")
    drained(counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start())
    assert [(r.category, r["count"]) for r in spark.table("counts").collect()] == [("BareNumber", 3)]
