"""Spans that diagnostics report on texts with known answers."""

from pyspark.sql import functions as F

from kobza.operators.diagnostics import flag_uncertain, scanner, uncertain_spans
from kobza.operators.spans import at_least, reaches, summarize
from kobza.options import NormalizeOptions
from kobza.sources.lexicons import Lexicons
from kobza.sources.sinks import span_json

TEXTS = {
    1: "У 2024 вийшов Foo X.",
    2: "10:30, $12, 03/04/2026, 99:30",
    3: "Дата 31.02.2024 і 2023-02-30.",
    4: "Картка 4111 1111 1111 1112, ISSN 0378-5954.",
    5: "Пoлтава і 5/0, 999.1.1.1",
    6: "",
    7: None,
}


def found(spark, **options):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id int, text string")
    return {(r.doc_id, r.start, r.stop, r.text, r.category, r.severity) for r in flag_uncertain(df, **options).collect()}


def test_spans(spark):
    got = found(spark)
    assert all(TEXTS[d][a:b] == t for d, a, b, t, _, _ in got)
    assert {(2, 6, "2024"), (14, 17, "Foo")} <= {(a, b, t) for d, a, b, t, _, _ in got if d == 1}
    by = {(d, t): (c, s) for d, _, _, t, c, s in got}
    assert by[2, "10:30"] == ("Time", "Warning") and by[2, "$12"] == ("Currency", "Warning") and by[2, "03/04/2026"] == ("Date", "Warning") and by[2, "99:30"] == ("Time", "Error")
    assert by[3, "31.02.2024"] == by[3, "2023-02-30"] == ("InvalidDate", "Error")
    assert by[4, "Картка 4111 1111 1111 1112"] == ("Identifier", "Error") and (4, "4111") not in by
    assert by[5, "Пoлтава"] == ("MixedScript", "Error") and by[5, "5/0"] == ("Fraction", "Error") and by[5, "999.1.1.1"] == ("Network", "Error")
    assert not {d for d, *_ in got} & {6, 7}


def test_options_resolve_ambiguity(spark):
    got = {t for d, _, _, t, _, _ in found(spark, options=NormalizeOptions(colon_style="clock")) if d == 2}
    assert "$12" not in got and "03/04/2026" not in got and "10:30" not in got and "99:30" in got


def test_arrays_and_summary(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id int, text string")
    spans = uncertain_spans(df)
    rows = {r.doc_id: r for r in spans.select("doc_id", reaches(F.col("spans"), "Error").alias("bad"), F.size(at_least(F.col("spans"), "Error")).alias("n"), span_json(F.col("spans")).alias("json")).collect()}
    assert rows[3].bad and rows[3].n == 2 and not rows[6].bad and rows[6].json == "[]" and rows[7].n == 0
    assert rows[3].json.startswith('[{"start":')
    summary = {(r.kind, r.name): r["count"] for r in summarize(flag_uncertain(df)).collect()}
    assert summary["total", "total"] == sum(n for (k, _), n in summary.items() if k == "severity") == sum(n for (k, _), n in summary.items() if k == "category")


REPORTED = {
    "Подія 32.13.2024.": ("32.13.2024", "Date", "Error"), "Див. ст. 5": ("ст.", "AmbiguousAbbreviation", "Warning"), "Є 7 варіантів.": ("7", "BareNumber", "Warning"),
    "та FooКиїв IX.": ("FooКиїв", "MixedScript", "Error"), "розділ IX.": ("IX", "RomanNumeral", "Info"), "справа № 910/1234/24": ("№ 910/1234/24", "Identifier", "Info"),
    "картка 4149 1234 5678 9012": ("картка 4149 1234 5678 9012", "Identifier", "Error"), "ISBN 978-0-306-40615-8": ("ISBN 978-0-306-40615-8", "Identifier", "Error"),
    "ISSN 0317-8472": ("ISSN 0317-8472", "Identifier", "Error"), "DE88 3704 0044 0532 0130 00": ("DE88 3704 0044 0532 0130 00", "Identifier", "Error"),
    "VIN 1M8GDM9A1KP042788": ("VIN 1M8GDM9A1KP042788", "Identifier", "Error"), "550e8400-e29b-41d4-0716-446655440000": ("550e8400-e29b-41d4-0716-446655440000", "Identifier", "Error"),
    "MD5 d41d8cd98f00b204": ("MD5 d41d8cd98f00b204", "Identifier", "Error"), "Вага 5 qq.": ("5 qq", "Unit", "Warning"), "Контакт test@": ("test@", "Web", "Warning"),
    "Перейти на https://": ("https://", "Web", "Warning"), "Сума 1,234": ("1,234", "AmbiguousNumberGrouping", "Warning"), "у 4 фларбах": ("4 фларбах", "Agreement", "Info"),
    "Час 99:30": ("99:30", "Time", "Error"), "Час 13:30 PM": ("13:30 PM", "Time", "Error"), "Дата 2026-13-01": ("2026-13-01", "InvalidDate", "Error"), "Дата 2026-13": ("2026-13", "InvalidDate", "Error"),
    "Дата 2026-W54-8": ("2026-W54-8", "InvalidDate", "Error"), "Дата 2025-366": ("2025-366", "InvalidDate", "Error"), "10:00 UTC+15:00": ("10:00 UTC+15:00", "Time", "Error"),
    "10:00 +14:30": ("10:00 +14:30", "Time", "Error"), "10:00 Mars/Base": ("Mars/Base", "Time", "Warning"), "частка 5/0": ("5/0", "Fraction", "Error"), "число 1e+": ("1e+", "Scientific", "Warning"),
    "IP 999.1.1.1/40": ("999.1.1.1/40", "Network", "Error"), "geo:91.2,181.0": ("geo:91.2,181.0", "Coordinate", "Error"), "50°99′00″N": ("50°99′00″N", "Coordinate", "Error"),
}
SILENT = {
    "картка 4111 1111 1111 1111": "Error", "ISBN 978-0-306-40615-7": "Error", "ISBN-10 0-306-40615-2": "Error", "ISSN 0317-8471": "Error", "DE89 3704 0044 0532 0130 00": "Error",
    "VIN 1M8GDM9AXKP042788": "Error", "550e8400-e29b-41d4-a716-446655440000": "Error", "MD5 d41d8cd98f00b204e9800998ecf8427e": "Error", "IEEE 802.16e": "Scientific", "Сума 12 AED.": "Currency",
    "Сума 5 XYZ.": "Unit", "Енциклопедія у 3 т.": "Unit", "2016 у Wayback Machine": "Unit", "100 Мбіт/с": "Unit", "10 Гбіт/c": "Unit", "1 січня": "Unit", "H2O": "Unit", "мережа 3G": "Unit",
    "сервер 192.168.1.10": "BareNumber", "10:30 Europe/Kyiv": "Error",
}


def test_every_detector():
    scan = scanner(None, Lexicons())
    for text, wanted in REPORTED.items():
        assert wanted in {(t, c, s) for _, _, t, _, c, s in scan(text)}, (text, scan(text))
    for text, silent in SILENT.items():
        assert not [x for x in scan(text) if silent in x[4:]], (text, scan(text))


def test_the_first_detector_keeps_a_place_and_identifiers_hold_numbers():
    scan = scanner(None, Lexicons())
    assert [(t, s) for _, _, t, _, _, s in scan("картка 4149 1234 5678 9012")] == [("картка 4149 1234 5678 9012", "Error")]
    assert {c for *_, c, _ in scan("справа № 910/1234/24")} == {"Identifier"}
