"""Normalization on texts with known readings."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kobza.operators.normalize import build, normalize, normalize_many
from kobza.options import NormalizeOptions
from kobza.sources.lexicons import Lexicons, nouns, read_lexicon, units

READINGS = {
    "У 2024 році ПДВ 20%": "У дві тисячі двадцять четвертому році податок на додану вартість двадцять відсотків",
    "КМУ ухвалив. ПДВ 20%": "Кабінет міністрів України ухвалив. Податок на додану вартість двадцять відсотків",
    "до 5 кг і з 3 друзями": "до п'яти кілограмів і з трьома друзями",
    "3 клас, 2 місце, 5-річний план": "третій клас, друге місце, п'ятирічний план",
    "ч. 2 ст. 19, п. 3 розд. II": "частина два стаття дев'ятнадцять, пункт три розділ другий",
    "II кв. 2026, 2-й кв.": "другий квартал дві тисячі двадцять шостого року, другий квартал",
    "2.5 кг, 12.5%, 1.5 млн грн": "дві цілих і п'ять десятих кілограма, дванадцять цілих і п'ять десятих відсотка, одна ціла і п'ять десятих мільйона гривень",
    "21 місто, 22 заявки, 5 людей, 104 документи": "двадцять одне місто, двадцять дві заявки, п'ять людей, сто чотири документи",
    "test@example.com і #Київ": "тест равлик ексампле крапка ком і хештег Київ",
    "99.99.2024 і 31/02/2024": "99.99.2024 і 31/02/2024",
    "": "",
    "   ": "",
}


@pytest.mark.parametrize("text", READINGS)
def test_readings(text):
    run = build(NormalizeOptions(), Lexicons())
    if READINGS[text] is not None:
        assert run(text) == READINGS[text]
        assert run(run(text)) == run(text)
    else:
        assert not any(c.isdigit() for c in run(text))


def test_columns(spark):
    df = spark.createDataFrame([(1, "5 кг"), (2, None), (3, ""), (4, "5 кг")], "id int, text string")
    expected = {1: "п'ять кілограмів", 2: None, 3: "", 4: "п'ять кілограмів"}
    assert {r.id: r.x for r in df.select("id", normalize(F.col("text")).alias("x")).collect()} == expected
    assert {r.id: r.x for r in normalize_many(df, "text", "x").collect()} == expected
    tts = NormalizeOptions.preset("tts")
    assert df.select(normalize(F.lit("10-12"), tts).alias("x")).first().x == "від десяти до дванадцяти"


def test_lexicons(tmp_path):
    assert units()["км"] == ("кілометр", "кілометри", "кілометрів", "кілометра", "m")
    assert nouns()["друзів"] == ("друг", "друзі", "друзів", "m")
    (tmp_path / "units.tsv").write_text("key\tone\tfew\tmany\tdecimal\tgender\n# note\nпуд\tпуд\tпуди\tпудів\tпуда\tm\n")
    assert Lexicons.load(str(tmp_path)).units["пуд"][2] == "пудів"
    (tmp_path / "acronyms.tsv").write_text("acronym\texpansion\nА\tа\nА\tб\n")
    with pytest.raises(ValueError, match="line 3"):
        read_lexicon(str(tmp_path / "acronyms.tsv"), "acronyms")


def fixture(name: str) -> list[list[str]]:
    with open(Path(__file__).parent / "data" / name, encoding="utf-8") as file:
        rows = [line.rstrip("\r\n").split("\t") for line in file if line.strip() and not line.startswith("#")]
    return rows[1:]


@pytest.mark.parametrize("text, spoken", fixture("spoken_default.tsv"))
def test_default_readings(text, spoken):
    assert build(NormalizeOptions(), Lexicons())(text) == spoken


def test_speech_readings_of_every_kind():
    run, kinds = build(NormalizeOptions.preset("tts_friendly"), Lexicons()), Counter()
    for kind, text, spoken in fixture("spoken_tts.tsv"):
        assert run(text) == spoken
        assert run(spoken) == spoken
        kinds[kind] += 1
    assert len(kinds) >= 20 and min(kinds.values()) >= 2


OPAQUE = [
    "{\\displaystyle x_{5}}", "[ˈkɪjiu̯ 5]", "<!-- 5 -->", "```\n5\n```", "`x=5`", "<code>5</code>", "<b>", "&nbsp;", "1e+", "ISBN 978-0-306-40615-8",
    "MD5 d41d8cd98f00b204", "PT", "99:30", "24:01", "10:00 UTC+15:00", "10:00 +14:30", "300.1.1.1", "10.0.0.1/40", "[::1]:70000", "::1/129",
    "geo:91.2,181.0", "широта: 95, довгота: 10", "50°99′00″N", "30.02.2024", "2024-02-30", "2024-W54", "2023-366", "10:00 Mars/Base",
]


@pytest.mark.parametrize("fragment", OPAQUE)
def test_opaque_fragments_stay(fragment):
    assert build(NormalizeOptions(), Lexicons())(f"Ось {fragment} тут") == f"Ось {fragment} тут"


def test_link_destinations_stay():
    assert build(NormalizeOptions(), Lexicons())("[слово 5](http://a.b/c_(5))") == "[слово п'ять](http://a.b/c_(5))"


def test_policies():
    keep = NormalizeOptions(currency_symbol_policy="preserve_ambiguous", numeric_date_order="preserve_ambiguous", validate_dates=False, normalize_ip_addresses=False)
    run = build(keep, Lexicons())
    assert run("$12 і 03/04/2026") == "$12 і 03/04/2026"
    assert "ай пі" not in run("сервер 10.0.0.1") and "ай пі" in build(NormalizeOptions(), Lexicons())("сервер 10.0.0.1")
    assert build(NormalizeOptions(quote_style="straight"), Lexicons())("«так»") == '"так"'
    assert build(NormalizeOptions(repair_homoglyphs=True), Lexicons())("Пoлтaвa") == "Полтава"
    assert build(NormalizeOptions(), Lexicons())("== Назва ==\nтекст") == "Назва\nтекст"


@pytest.mark.parametrize("text, spoken", [
    ("12 MAC 00:1A:2B:3C:4D:5E", "мак адреса нуль нуль двокрапка один ей"), ("geo:50.45,30.52", "географічні координати: п'ятдесят цілих і сорок п'ять сотих градуса північної широти"),
    ("SWIFT DEUTDEFF", "свіфт код ді і ю ті ді і еф еф"), ("(UTC) 10:00 UTC+3", "за всесвітнім координованим часом плюс три години"),
    ("рух 10 м/с·с", "помножити на секунда"), ("у м. Харкові", "у місті Харкові"), ("з 1986 по 1991", "з тисяча дев'ятсот вісімдесят шостого по тисяча дев'ятсот дев'яносто перший рік"),
    ("10 CA$", "CAD"), ("US$ 5", "п'ять доларів"), ("ст. 5–7", "статті п'ять сім"), ("5 × 10^3", "десять у степені три"), ("½", "одна друга"),
])
def test_technical_readings(text, spoken):
    got = build(NormalizeOptions(transliterate_latin=False, normalize_english_words=False), Lexicons())(text)
    assert spoken in got
