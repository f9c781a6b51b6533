"""Registered queries of validators, helpers, spans and sinks over the orders and line items, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kobza.functions import morphology as M
from kobza.functions import text as T
from kobza.functions import validators as V
from kobza.operators import spans as S
from kobza.sources import lexicons as L
from kobza.sources.sinks import line_json, span_json, span_rows
from kobza.sources.text import lines

ROMAN_LETTERS = ["I", "V", "X", "L", "C", "D", "M"]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")


def key() -> Column:
    return F.col("o_orderkey").cast("long")


def text_key() -> Column:
    return F.col("o_orderkey").cast("string")


def iso_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", V.is_valid_iso_week(key() % 400 + 1800, key() % 56).alias("valid"))


def ordinal_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", V.is_valid_ordinal_day(key() % 400 + 1800, key() % 370).alias("valid"))


def iban_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("UA"), F.lpad((key() % 97).cast("string"), 2, "0"), F.lpad(text_key(), 25, "7"))
    return orders(spark, sf_dir).select("o_orderkey", V.valid_iban(code).alias("valid"), V.valid_iban(F.substring(code, 1, 28)).alias("short"))


def vin_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("1M8GDM9A"), (key() % 10).cast("string"), F.lit("KP"), F.lpad((key() % 1000000).cast("string"), 6, "0"))
    return orders(spark, sf_dir).select("o_orderkey", V.valid_vin_checksum(code).alias("valid"), V.valid_vin_checksum(F.concat(F.lit("W"), F.substring(code, 2, 16))).alias("foreign"))


def uuid_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.md5(text_key())
    cut = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return orders(spark, sf_dir).select("o_orderkey", V.valid_uuid_variant(F.concat_ws("-", *cut)).alias("valid"))


def digest_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    algorithm = F.get(F.array(F.lit("MD5"), F.lit("SHA-1"), F.lit("SHA-256"), F.lit("BLAKE2s"), F.lit("CRC")), (key() % 5).cast("int"))
    digest = F.when(key() % 2 == 0, F.md5(text_key())).otherwise(F.sha2(text_key(), 256))
    return orders(spark, sf_dir).select("o_orderkey", V.valid_hash_length(algorithm, digest).alias("valid"))


def roman_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.concat(*[F.get(F.array(*[F.lit(c) for c in ROMAN_LETTERS]), (F.floor(key() / d) % 7).cast("int")) for d in (343, 49, 7, 1)])
    return orders(spark, sf_dir).select("o_orderkey", letters.alias("letters"), V.valid_roman(letters).alias("valid"), M.roman_to_int(letters).cast("long").alias("value"))


def network_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = F.concat_ws(".", *[(key() % n).cast("string") for n in (300, 257, 7, 999)])
    hexes = [F.lower(F.hex(key() % n)) for n in (70000, 65536, 17, 4096)]
    six = F.when(key() % 3 == 0, F.concat_ws(":", *hexes, *hexes)).when(key() % 3 == 1, F.concat(F.concat_ws(":", *hexes), F.lit("::"), hexes[0])).otherwise(F.concat_ws(":", *hexes))
    return orders(spark, sf_dir).select("o_orderkey", V.valid_ipv4(four).alias("four"), V.valid_ipv6(six).alias("six"))


def clock_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour, minute = key() % 26, key() % 63
    return orders(spark, sf_dir).select("o_orderkey", V.valid_clock(hour, minute).alias("clock"), V.valid_offset(hour, minute).alias("offset"))


def coordinate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", V.valid_coordinates((key() % 401 - 200) / 2.0, (key() % 801 - 400) / 2.0).alias("valid"))


def number_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", *[M.number_to_words_gender(F.col("o_orderkey"), g).alias(g) for g in "mfn"])


def number_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", M.decimal_to_words((key() % 1000).cast("string"), F.lpad((key() % 1000).cast("string"), 3, "0")).alias("words"))


def number_ordinal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", *[M.number_to_ordinal_words(F.col("o_orderkey"), f).alias(f) for f in sorted(M.HARD)])


def counted_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every amount with the unit of each built-in currency in the form that its number asks for."""
    units = F.array(*[F.struct(F.lit(c).alias("code"), M.plural(key(), row[2]).alias("unit")) for c, row in L.CURRENCIES.items()])
    return orders(spark, sf_dir).select("o_orderkey", F.inline(units))


def letter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.translate(text_key(), "0123456789", "АБВГДЕЖЗИЙ")
    return orders(spark, sf_dir).select("o_orderkey", T.spell_letters(letters).alias("names"))


def vowelless_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.translate(text_key(), "0123456789", "АБВГДЕЖЗИК")
    return orders(spark, sf_dir).select("o_orderkey", T.expand_abbreviations(F.concat(F.lit("тут "), letters, F.lit(" та й"))).alias("spoken"))


def compact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(T.compact_lower(F.col("text"))).alias("digest"))


def scanned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without an empty one behind the last line feed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat("text", F.lit("\r\n")).alias("text"))
    return lines(docs, keep_last_empty=False).select("doc_id", "line_no", F.md5("line").alias("digest"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by rule: some fall together, some lie in others."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line, part = F.col("l_linenumber").cast("int"), F.col("l_partkey").cast("int")
    start = (part % 5).cast("int")
    kind = F.get(F.array(*[F.lit(c) for c in ("BareNumber", "Identifier", "Unit", "Time", "Date")]), (part % 5).cast("int"))
    severity = F.get(F.array(*[F.lit(s) for s in S.SEVERITIES]), line % 3)
    return items.select(F.col("l_orderkey").alias("key"), line.alias("rank"), start.alias("start"), (start + 1 + line % 4).cast("int").alias("stop"), kind.alias("category"), severity.alias("severity"))


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_of_each(places(spark, sf_dir), "key", ["rank"]).select("key", "rank", "start", "stop")


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.first_of_each(places(spark, sf_dir), "key", ["rank"])
    return S.not_inside(found, found.where(F.col("category").isin("Identifier", "Time")), "key", strictly=True).select("key", "rank", "start", "stop")


def span_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.struct("start", "stop", F.concat(F.lit("t\""), F.col("rank").cast("string")).alias("text"), F.lit("why").alias("reason"), "category", "severity")
    return places(spark, sf_dir).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", fields.alias("span")))).alias("_s")).select("key", F.transform("_s", lambda s: s["span"]).alias("spans"))


def severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_arrays(spark, sf_dir).select("key", F.size(S.at_least(F.col("spans"), "Warning")).alias("warnings"), S.reaches(F.col("spans"), "Error").alias("errors"))


def span_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summarize(places(spark, sf_dir))


def span_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = span_arrays(spark, sf_dir)
    return arrays.select("key", span_json(F.col("spans")).alias("json"), line_json(F.col("key").cast("long"), F.lit("a\\b"), F.slice("spans", 1, 1)).alias("line"))


def span_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_rows(span_arrays(spark, sf_dir).withColumn("line_no", F.col("key").cast("long")), "spans", "line_no")


QUERIES = [
    iso_weeks, ordinal_days, iban_numbers, vin_numbers, uuid_numbers, digest_lengths, roman_numbers, network_addresses, clock_checks, coordinate_checks, number_genders, number_decimals,
    number_ordinal_forms, counted_currency, letter_names, vowelless_acronyms, compact_texts, scanned_lines, first_wins, containment, severity_filter, span_summary, span_json_lines, span_tsv,
]


def oracle_sql(sql_words: Callable[[str], str], sql_ordinal: Callable[[str, str, str], str], sql_list: Callable[[list[str]], str]) -> dict[str, str]:
    k = "CAST(o_orderkey AS BIGINT)"
    year = f"CAST({k} % 400 + 1800 AS INT)"
    check, account = f"lpad(CAST({k} % 97 AS VARCHAR), 2, '0')", "lpad(CAST(o_orderkey AS VARCHAR), 25, '7')"
    vin = f"('1M8GDM9A' || CAST({k} % 10 AS VARCHAR) || 'KP' || lpad(CAST({k} % 1000000 AS VARCHAR), 6, '0'))"
    value = lambda c: f"CASE WHEN {c} BETWEEN '0' AND '9' THEN ascii({c}) - 48 WHEN {c} BETWEEN 'A' AND 'H' THEN ascii({c}) - 64 WHEN {c} BETWEEN 'J' AND 'R' THEN ascii({c}) - 73 ELSE ascii({c}) - 81 END"
    weighted = " + ".join(f"({value(f'substr(v, {i + 1}, 1)')}) * {w}" for i, w in enumerate(L.VIN_WEIGHTS))
    digest = f"(CASE WHEN {k} % 2 = 0 THEN 32 ELSE 64 END)"
    letters = " || ".join(f"{sql_list(ROMAN_LETTERS)}[CAST({k} // {d} % 7 AS INT) + 1]" for d in (343, 49, 7, 1))
    amount = lambda i: f"CASE substr(letters, {i}, 1) WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 ELSE 0 END"
    read = " + ".join(f"(CASE WHEN ({amount(i)}) < ({amount(i + 1)}) THEN -({amount(i)}) ELSE ({amount(i)}) END)" for i in range(1, 5))
    first, second = f"({k} % 70000)", f"({k} % 3)"
    one_word = lambda w, g: w if g == "m" else f"list_concat({w}[:-2], [CASE {w}[-1] " + ("WHEN 'один' THEN 'одна' WHEN 'два' THEN 'дві'" if g == "f" else "WHEN 'один' THEN 'одне'") + f" ELSE {w}[-1] END])"
    gendered = ", ".join(f"array_to_string({one_word('w', g)}, ' ') AS {g}" for g in "mfn")
    is_one = f"({k} % 1000 % 10 = 1 AND {k} % 1000 % 100 <> 11)"
    whole = f"array_to_string({one_word('w', 'f')}, ' ')"
    units = ", ".join("('" + c + "', '" + "', '".join(f.replace("'", "''") for f in row[2]) + "')" for c, row in L.CURRENCIES.items())
    form = f"CASE WHEN {k} % 10 = 1 AND {k} % 100 <> 11 THEN one WHEN {k} % 10 BETWEEN 2 AND 4 AND {k} % 100 NOT BETWEEN 12 AND 14 THEN few ELSE many END"
    named = lambda alphabet: "CASE c " + " ".join(f"WHEN '{c}' THEN '{T.LETTER_NAMES[c]}'" for c in dict.fromkeys(alphabet)) + " END"
    spelled = lambda alphabet: f"array_to_string(list_transform(string_split(translate(CAST(o_orderkey AS VARCHAR), '0123456789', '{alphabet}'), ''), lambda c: {named(alphabet)}), ' ')"
    acronym = "translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'АБВГДЕЖЗИК')"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + T.UPPER + T.RUSSIAN_UPPER, "abcdefghijklmnopqrstuvwxyz" + T.LOWER + T.RUSSIAN_LOWER
    spans = (
        "SELECT l_orderkey AS key, l_linenumber AS rank, CAST(l_partkey % 5 AS INT) AS start, CAST(l_partkey % 5 + 1 + l_linenumber % 4 AS INT) AS stop, "
        "['BareNumber', 'Identifier', 'Unit', 'Time', 'Date'][CAST(l_partkey % 5 AS INT) + 1] AS category, ['Info', 'Warning', 'Error'][l_linenumber % 3 + 1] AS severity FROM lineitem"
    )
    kept = f"SELECT * FROM ({spans}) QUALIFY row_number() OVER (PARTITION BY key, start, stop ORDER BY rank) = 1"
    json = "'{\"start\":' || start || ',\"stop\":' || stop || ',\"severity\":\"' || severity || '\",\"category\":\"' || category || '\",\"text\":\"t\\\"' || rank || '\",\"reason\":\"why\"}'"
    ordinals = ", ".join(f"{sql_ordinal('w', k, f)} AS {f}" for f in sorted(M.HARD))
    categories = "CASE category " + " ".join(f"WHEN '{c}' THEN {10 + i}" for i, c in enumerate(S.CATEGORIES, 1)) + " END"
    return {
        "iso_weeks": f"SELECT o_orderkey, ({k} % 56 BETWEEN 1 AND 52 OR ({k} % 56 = 53 AND extract('week' FROM make_date({year}, 12, 28)) = 53)) AS valid FROM orders",
        "ordinal_days": f"SELECT o_orderkey, {k} % 370 BETWEEN 1 AND extract('doy' FROM make_date({year}, 12, 31)) AS valid FROM orders",
        "iban_numbers": f"SELECT o_orderkey, CAST({account} || '3010' || {check} AS HUGEINT) % 97 = 1 AS valid, false AS short FROM orders",
        "vin_numbers": f"SELECT o_orderkey, (CASE WHEN ({weighted}) % 11 = 10 THEN 'X' ELSE CAST(({weighted}) % 11 AS VARCHAR) END) = substr(v, 9, 1) AS valid, true AS foreign FROM (SELECT o_orderkey, {vin} AS v FROM orders)".replace("foreign", '"foreign"'),
        "uuid_numbers": "SELECT o_orderkey, regexp_matches(md5(CAST(o_orderkey AS VARCHAR)), '^.{12}[1-8].{3}[89ab]') AS valid FROM orders",
        "digest_lengths": f"SELECT o_orderkey, (CASE {k} % 5 WHEN 0 THEN 32 WHEN 1 THEN 40 WHEN 2 THEN 64 WHEN 3 THEN 64 ELSE -1 END) = {digest} AS valid FROM orders",
        "roman_numbers": f"SELECT o_orderkey, letters, regexp_full_match(letters, 'M{{0,4}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})') AS valid, CAST({read} AS BIGINT) AS value FROM (SELECT o_orderkey, {letters} AS letters FROM orders)",
        "network_addresses": f"SELECT o_orderkey, ({k} % 300 <= 255 AND {k} % 257 <= 255 AND {k} % 999 <= 255) AS four, (CASE WHEN {second} = 2 THEN false ELSE {first} <= 65535 END) AS six FROM orders",
        "clock_checks": f"SELECT o_orderkey, (({k} % 26 <= 23 AND {k} % 63 <= 59) OR ({k} % 26 = 24 AND {k} % 63 = 0)) AS clock, (({k} % 26) * 60 + {k} % 63 <= 840 AND {k} % 63 <= 59) AS \"offset\" FROM orders",
        "coordinate_checks": f"SELECT o_orderkey, (abs({k} % 401 - 200) <= 180 AND abs({k} % 801 - 400) <= 360) AS valid FROM orders",
        "number_genders": f"SELECT o_orderkey, {gendered} FROM (SELECT o_orderkey, {sql_words(k)} AS w FROM orders)",
        "number_decimals": f"SELECT o_orderkey, {whole} || CASE WHEN {is_one} THEN ' ціла і ' ELSE ' цілих і ' END || {whole} || CASE WHEN {is_one} THEN ' тисячна' ELSE ' тисячних' END AS words FROM (SELECT o_orderkey, {sql_words(k + ' % 1000')} AS w FROM orders)",
        "number_ordinal_forms": f"SELECT o_orderkey, {ordinals} FROM (SELECT o_orderkey, {sql_words(k)} AS w FROM orders)",
        "counted_currency": f"SELECT o_orderkey, code, {form} AS unit FROM orders CROSS JOIN (VALUES {units}) AS t(code, one, few, many)",
        "letter_names": f"SELECT o_orderkey, {spelled('АБВГДЕЖЗИЙ')} AS names FROM orders",
        "vowelless_acronyms": f"SELECT o_orderkey, 'тут ' || CASE WHEN length({acronym}) < 2 OR regexp_matches({acronym}, '[АЕИ]') THEN {acronym} ELSE {spelled('АБВГДЕЖЗИК')} END || ' та й' AS spoken FROM orders",
        "compact_texts": f"SELECT doc_id, md5(translate(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g'), '{upper}', '{lower}')) AS digest FROM documents",
        "scanned_lines": r"SELECT doc_id, CAST(line_no AS INT) AS line_no, md5(regexp_replace(line, '\r$', '')) AS digest FROM (SELECT doc_id, unnest(string_split(text || chr(13), chr(10))) AS line, generate_subscripts(string_split(text || chr(13), chr(10)), 1) AS line_no FROM documents)",
        "first_wins": f"SELECT key, rank, start, stop FROM ({kept})",
        "containment": f"WITH f AS ({kept}) SELECT key, rank, start, stop FROM f WHERE NOT EXISTS (SELECT 1 FROM f AS h WHERE h.key = f.key AND h.category IN ('Identifier', 'Time') AND h.start <= f.start AND h.stop >= f.stop AND (h.start < f.start OR h.stop > f.stop))",
        "severity_filter": f"SELECT key, CAST(count(*) FILTER (severity <> 'Info') AS INT) AS warnings, count(*) FILTER (severity = 'Error') > 0 AS errors FROM ({spans}) GROUP BY key",
        "span_summary": f"WITH s AS ({spans}) SELECT CAST(0 AS BIGINT) AS ord, 'total' AS kind, 'total' AS name, count(*) AS count FROM s UNION ALL SELECT CASE severity WHEN 'Info' THEN 1 WHEN 'Warning' THEN 2 ELSE 3 END, 'severity', severity, count(*) FROM s GROUP BY severity UNION ALL SELECT {categories}, 'category', category, count(*) FROM s GROUP BY category",
        "span_json_lines": f"SELECT key, '[' || string_agg({json}, ',' ORDER BY rank, start, stop, severity) || ']' AS json, '{{\"line\":' || key || ',\"text\":\"a\\\\b\",\"spans\":[' || first({json} ORDER BY rank, start, stop, severity) || ']}}' AS line FROM ({spans}) GROUP BY key",
        "span_tsv": f"SELECT concat_ws(chr(9), key, start, stop, severity, category, 't\"' || rank, 'why') AS value FROM ({spans})",
    }
