"""The kernels as functions of SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kobza.operators.normalize import normalize_udf
from kobza.options import NormalizeOptions
from kobza.sources.lexicons import Lexicons


def register(spark: SparkSession, options: NormalizeOptions | None = None, lexicons: Lexicons | None = None) -> list[str]:
    """Registers uk_normalize(text) and inlined SQL functions; returns their names."""
    spark.udf.register("uk_normalize", normalize_udf(options, lexicons))
    inlined = {
        "uk_trim(t STRING)": "trim(regexp_replace(t, ' +', ' '))",
        "uk_plural(n BIGINT, one STRING, few STRING, many STRING)": "CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN one WHEN n % 10 BETWEEN 2 AND 4 AND n % 100 NOT BETWEEN 12 AND 14 THEN few ELSE many END",
        "uk_valid_date(d INT, m INT, y INT)": "try_to_timestamp(concat_ws('-', lpad(y, 4, '0'), lpad(m, 2, '0'), lpad(d, 2, '0')), 'yyyy-MM-dd') IS NOT NULL",
    }
    for head, body in inlined.items():
        result = "BOOLEAN" if "valid" in head else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {result} RETURN {body}")
    return ["uk_normalize", *(h.split("(")[0] for h in inlined)]

