"""Registered queries of the text engine, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kobza.functions import morphology as M
from kobza.functions import text as T
from kobza.functions import validators as V
from kobza.operators.diagnostics import flag_uncertain
from kobza.operators.normalize import normalize_many
from kobza.operators.segment import split_sentences, tokenize
from kobza.operators.spans import summarize
from kobza.plans import checks
from kobza.sources.text import lines


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", M.number_to_words(F.col("o_orderkey")).alias("words"))


def number_words_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey").cast("long") * 1_000_003
    return read(spark, sf_dir, "orders").select("o_orderkey", M.number_to_words(n).alias("words"))


def number_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", M.digit_words(F.col("o_orderkey").cast("string")).alias("words"))


def number_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", *[M.number_to_words_case(F.col("o_orderkey"), c).alias(c) for c in M.CASES])


def number_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", *[M.number_to_ordinal_words(F.col("o_orderkey"), f).alias(f) for f in ("nom_m", "gen", "loc_f")])


def transliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.transliterate_to_cyrillic(F.col("text"))).alias("digest"))


def trimmed_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.lower_text(T.trim_spaces(F.col("text")))).alias("digest"))


def distinct_then_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are rewritten once: the batch form of every scalar function."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    once = docs.select("text").distinct().select("text", F.md5(T.transliterate_to_cyrillic(F.col("text"))).alias("digest"))
    return docs.join(once, "text").select("doc_id", "digest")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "line_no", F.md5("line").alias("digest"))


def luhn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad(F.col("o_orderkey").cast("string"), 16, "4")
    return read(spark, sf_dir, "orders").select("o_orderkey", V.valid_luhn(number).alias("valid"))


def isbn_issn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return read(spark, sf_dir, "orders").select("o_orderkey", V.valid_isbn(F.concat(F.lit("978-"), F.lpad(key, 10, "0"))).alias("isbn"), V.valid_issn(F.lpad(key, 8, "0")).alias("issn"))


def calendar_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, month, day = F.col("o_orderkey") % 400 + 1800, F.col("o_orderkey") % 14, F.col("o_orderkey") % 33
    return read(spark, sf_dir, "orders").select("o_orderkey", V.is_valid_date(day, month, year).alias("valid"))


def bare_number_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare numbers and Latin words in capitals as spans, counted in total, by severity and by category."""
    docs = read(spark, sf_dir, "documents")
    one = lambda pattern, category, severity: docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("text")).select("doc_id", F.lit(category).alias("category"), F.lit(severity).alias("severity"))
    found = one(r"(?<!\w)[0-9]+(?!\w)", "BareNumber", "Info").unionByName(one(r"(?<!\w)[A-Z]{2,}(?!\w)", "ForeignWord", "Warning"))
    return summarize(found)


def diagnostic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of every document that diagnostics report."""
    return flag_uncertain(read(spark, sf_dir, "documents"))


def diagnostic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What diagnostics report, counted in total, by severity and by category."""
    return summarize(diagnostic_spans(spark, sf_dir))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").alias("n_tokens"), F.to_json("t").alias("spans")).select("doc_id", "n_tokens", F.md5("spans").alias("digest"))


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select("doc_id", split_sentences(F.col("text")).alias("s"))
    return found.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.to_json("s")).alias("digest"))


def normalized_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn in spoken form; equal turns are rewritten once."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return normalize_many(turns, "text", "spoken").select("conv_id", "turn", F.md5("spoken").alias("digest"), F.length("spoken").alias("n_chars"))


QUERIES = [
    number_words, number_words_large, number_digits, number_cases, number_ordinals, transliterate, trimmed_lower, distinct_then_join, document_lines,
    luhn_numbers, isbn_issn_numbers, calendar_checks, bare_number_summary, diagnostic_spans, diagnostic_summary, document_tokens, document_sentences,
    normalized_conversations,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in [*QUERIES, *checks.QUERIES]}


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_words(n: str) -> str:
    """The list of words of a number below 10**18, for DuckDB."""
    small = sql_list(["", *M.DIGITS[1:], *M.TEENS])

    def triad(k: str) -> str:
        return f"[{sql_list(M.HUNDREDS)}[({k}) // 100 + 1], CASE WHEN ({k}) % 100 < 20 THEN {small}[({k}) % 100 + 1] ELSE {sql_list(M.TENS)}[({k}) % 100 // 10 + 1] END, CASE WHEN ({k}) % 100 < 20 THEN '' ELSE {small}[({k}) % 10 + 1] END]"

    def form(k: str, forms: tuple[str, ...]) -> str:
        return f"CASE WHEN ({k}) % 10 = 1 AND ({k}) % 100 <> 11 THEN '{forms[0]}' WHEN ({k}) % 10 BETWEEN 2 AND 4 AND ({k}) % 100 NOT BETWEEN 12 AND 14 THEN '{forms[1]}' ELSE '{forms[2]}' END"

    parts = []
    for value, forms in M.SCALES:
        k = f"(({n}) // {value} % 1000)"
        named = triad(k)
        if value == 1000:
            named = f"(CASE WHEN {k} = 1 THEN [''] ELSE list_transform({named}, lambda w: CASE w WHEN 'один' THEN 'одна' WHEN 'два' THEN 'дві' ELSE w END) END)"
        parts.append(f"(CASE WHEN {k} = 0 THEN [''] ELSE list_concat({named}, [{form(k, forms)}]) END)")
    parts.append(triad(f"(({n}) % 1000)"))
    joined = parts[0]
    for p in parts[1:]:
        joined = f"list_concat({joined}, {p})"
    return f"(CASE WHEN ({n}) = 0 THEN ['нуль'] ELSE list_filter({joined}, lambda w: w <> '') END)"


def sql_case(word: str, values: dict[str, str]) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE {word} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in values.items()) + f" ELSE {word} END"


def sql_ordinal(words: str, n: str, form: str) -> str:
    last = sql_case(f"{words}[-1]", M.ORDINAL_OF)
    if form == "nom_m":
        inflect = lambda w: w
    else:
        inflect = lambda w: f"CASE WHEN ({w}) LIKE '%ій' THEN regexp_replace({w}, 'ій$', '') || '{M.SOFT.get(form, M.HARD[form])}' ELSE regexp_replace({w}, 'ий$', '') || '{M.HARD[form]}' END"
    whole = f"{sql_list(M.THOUSANDTHS)}[({n}) // 1000 - 1] || 'тисячний'"
    return f"CASE WHEN ({n}) BETWEEN 2000 AND 9000 AND ({n}) % 1000 = 0 THEN {inflect(whole)} ELSE array_to_string(list_concat({words}[:-2], [{inflect(last)}]), ' ') END"


def sql_transliteration(text: str) -> str:
    out = text
    for latin, cyrillic in sorted(T.UNITS, key=lambda u: (u[0] != "ts", -len(u[0]))):
        out = f"regexp_replace({out}, '{latin}', '{cyrillic}', 'gi')"
    for latin, cyrillic in (("[xX]", "кс"), ("[jJ]", "дж"), ("[ñÑ]", "нь"), ("ß", "сс")):
        out = f"regexp_replace({out}, '{latin}', '{cyrillic}', 'g')"
    latin, cyrillic = "".join(T.SINGLES), "".join(T.SINGLES.values())
    source, target = latin + latin.upper(), cyrillic * 2
    for to, letters in T.DIACRITICS.items():
        source, target = source + letters + letters.upper(), target + to * 2 * len(letters)
    return f"translate({out}, '{source}', '{target}')"


def oracle_sql() -> dict[str, str]:
    key, words = "CAST(o_orderkey AS BIGINT)", "w"
    listed = f"(SELECT o_orderkey, {sql_words(key)} AS w FROM orders)"
    digits = f"list_transform(string_split(CAST(o_orderkey AS VARCHAR), ''), lambda d: {sql_list(M.DIGITS)}[CAST(d AS INT) + 1])"
    cases = ", ".join(f"array_to_string(list_transform(w, lambda x: {sql_case('x', {k: v[i] for k, v in M.CASES_OF.items()})}), ' ') AS {c}" for i, c in enumerate(M.CASES))
    ordinals = ", ".join(f"{sql_ordinal(words, key, f)} AS {f}" for f in ("nom_m", "gen", "loc_f"))
    number = "lpad(CAST(o_orderkey AS VARCHAR), 16, '4')"
    luhn = "+".join(f"(CAST(substr({number}, {i + 1}, 1) AS INT) * {2 if i % 2 == 0 else 1} - CASE WHEN CAST(substr({number}, {i + 1}, 1) AS INT) * {2 if i % 2 == 0 else 1} > 9 THEN 9 ELSE 0 END)" for i in range(16))
    ten, eight = "('978' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0'))", "lpad(CAST(o_orderkey AS VARCHAR), 8, '0')"
    isbn = "+".join(f"CAST(substr({ten}, {i + 1}, 1) AS INT) * {1 if i % 2 == 0 else 3}" for i in range(13))
    issn = "+".join(f"CAST(substr({eight}, {i + 1}, 1) AS INT) * {8 - i}" for i in range(8))
    leap = "((o_orderkey % 400 + 1800) % 4 = 0 AND ((o_orderkey % 400 + 1800) % 100 <> 0 OR (o_orderkey % 400 + 1800) % 400 = 0))"
    longest = f"CASE WHEN o_orderkey % 14 = 2 THEN CASE WHEN {leap} THEN 29 ELSE 28 END WHEN o_orderkey % 14 IN (4, 6, 9, 11) THEN 30 ELSE 31 END"
    upper, lower = T.UPPER + T.RUSSIAN_UPPER, T.LOWER + T.RUSSIAN_LOWER
    latin = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    spans = r"SELECT unnest(regexp_extract_all(text, '\b[0-9]+\b')) AS t, 'BareNumber' AS category, 'Info' AS severity FROM documents UNION ALL SELECT unnest(regexp_extract_all(text, '\b[A-Z]{2,}\b')), 'ForeignWord', 'Warning' FROM documents"
    return checks.oracle_sql(sql_words, sql_ordinal, sql_list) | {
        "number_words": f"SELECT o_orderkey, array_to_string(w, ' ') AS words FROM {listed}",
        "number_words_large": f"SELECT o_orderkey, array_to_string({sql_words(key + ' * 1000003')}, ' ') AS words FROM orders",
        "number_digits": f"SELECT o_orderkey, array_to_string({digits}, ' ') AS words FROM orders",
        "number_cases": f"SELECT o_orderkey, {cases} FROM {listed}",
        "number_ordinals": f"SELECT o_orderkey, {ordinals} FROM {listed}",
        "transliterate": f"SELECT doc_id, md5({sql_transliteration('text')}) AS digest FROM documents",
        "distinct_then_join": f"SELECT doc_id, md5({sql_transliteration('text')}) AS digest FROM documents",
        "trimmed_lower": f"SELECT doc_id, md5(translate(trim(regexp_replace(text, ' +', ' ', 'g'), ' '), '{latin + upper}', '{latin.lower() + lower}')) AS digest FROM documents",
        "document_lines": r"SELECT doc_id, CAST(line_no AS INT) AS line_no, md5(regexp_replace(line, '\r$', '')) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)",
        "luhn_numbers": f"SELECT o_orderkey, ({luhn}) % 10 = 0 AS valid FROM orders",
        "isbn_issn_numbers": f"SELECT o_orderkey, ({isbn}) % 10 = 0 AS isbn, ({issn}) % 11 = 0 AS issn FROM orders",
        "calendar_checks": f"SELECT o_orderkey, (o_orderkey % 14 BETWEEN 1 AND 12 AND o_orderkey % 33 >= 1 AND o_orderkey % 33 <= {longest}) AS valid FROM orders",
        "bare_number_summary": f"SELECT CAST(CASE WHEN severity = 'Info' THEN 1 WHEN severity = 'Warning' THEN 2 WHEN category = 'BareNumber' THEN 12 WHEN category = 'ForeignWord' THEN 16 ELSE 0 END AS BIGINT) AS ord, CASE WHEN severity IS NOT NULL THEN 'severity' WHEN category IS NOT NULL THEN 'category' ELSE 'total' END AS kind, coalesce(severity, category, 'total') AS name, count(*) AS count FROM ({spans}) GROUP BY GROUPING SETS ((), (severity), (category))",
    }
