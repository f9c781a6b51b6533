"""Number words, validators and rewriting on examples with known answers."""

import pytest
from pyspark.sql import functions as F

from kobza.functions import morphology as M
from kobza.functions import text as T
from kobza.functions import validators as V
from kobza.options import NormalizeOptions
from kobza.sources.text import VocabularyError, lines, load_vocabulary, vocabulary_from


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("n", "words"),
    [(0, "нуль"), (21, "двадцять один"), (1000, "тисяча"), (2001, "дві тисячі один"), (11_000, "одинадцять тисяч"), (1_000_001, "один мільйон один"), (10**18, "один " + " ".join(["нуль"] * 18)), (None, None), (-1, None)],
)
def test_number_to_words(spark, n, words):
    assert value(spark, M.number_to_words(F.lit(n).cast("long"))) == words


@pytest.mark.parametrize(("n", "form", "words"), [(3, "nom_n", "третє"), (3, "gen", "третього"), (21, "gen_f", "двадцять першої"), (2000, "nom_m", "двохтисячний"), (1991, "gen", "тисяча дев'ятсот дев'яносто першого"), (5, "no_such", "п'ятий")])
def test_number_to_ordinal_words(spark, n, form, words):
    assert value(spark, M.number_to_ordinal_words(F.lit(n), form)) == words


@pytest.mark.parametrize(("a", "b", "words"), [("12", "5", "дванадцять цілих і п'ять десятих"), ("1", "01", "одна ціла і одна сота"), ("2", "1234567", "два кома один два три чотири п'ять шість сім")])
def test_decimal_to_words(spark, a, b, words):
    assert value(spark, M.decimal_to_words(F.lit(a), F.lit(b))) == words


@pytest.mark.parametrize(("text", "n"), [("XIV", 14), ("MCMXC", 1990), ("IV", 4), ("Q", None)])
def test_roman(spark, text, n):
    assert value(spark, M.roman_to_int(F.lit(text))) == n


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (V.valid_isbn, ["978-3-16-148410-0", "0-306-40615-2", "080442957X"], ["978-3-16-148410-1", "X", ""]),
        (V.valid_issn, ["0378-5955", "2434-561X"], ["0378-5954", "1"]),
        (V.valid_iban, ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "UA213223130000026007233566001"], ["GB82 WEST 1234 5698 7654 33", "DE8937040044053201300", ""]),
        (V.valid_luhn, ["4111 1111 1111 1111"], ["4111 1111 1111 1112", "79927398713", "4111x"]),
        (V.valid_vin_checksum, ["1M8GDM9AXKP042788", "WVWZZZ1JZXW000001"], ["1M8GDM9A1KP042788", "IOQ"]),
        (V.valid_uuid_variant, ["123e4567-e89b-12d3-a456-426614174000", "00000000-0000-0000-0000-000000000000"], ["123e4567-e89b-92d3-a456-426614174000"]),
        (V.valid_roman, ["XIV", "", "MMMM"], ["IIII", "VX"]),
        (V.valid_ipv4, ["192.168.0.1"], ["256.1.1.1", "1.2.3"]),
        (V.valid_ipv6, ["::1", "2001:db8::8a2e:370:7334", "1:2:3:4:5:6:7:8", "::"], ["1:2:3", "1::2::3", "12345::", ":::"]),
    ],
)
def test_validators(spark, check, good, bad):
    assert [value(spark, check(F.lit(x))) for x in good + bad] == [True] * len(good) + [False] * len(bad)
    assert value(spark, check(F.lit(None).cast("string"))) is None


def test_dates(spark):
    assert value(spark, V.is_valid_date(F.lit(29), F.lit(2), F.lit(2000))) and not value(spark, V.is_valid_date(F.lit(29), F.lit(2), F.lit(1900)))
    assert value(spark, V.is_valid_iso_week(F.lit(2020), F.lit(53))) and not value(spark, V.is_valid_iso_week(F.lit(2021), F.lit(53)))
    assert value(spark, V.valid_hash_length(F.lit("MD5"), F.lit("d41d8cd98f00b204e9800998ecf8427e")))


@pytest.mark.parametrize(("text", "out"), [("Schtsch", "щцч"), ("Zoo Yu", "зу ю"), ("jazz é Ñ", "джазз е нь"), ("", "")])
def test_transliterate(spark, text, out):
    assert value(spark, T.transliterate_to_cyrillic(F.lit(text))) == out


def test_rewriting(spark):
    assert value(spark, T.expand_abbreviations(F.lit("СБУ і ДСНС, США"))) == "СБУ і деесенес, США".replace("деесенес", "де ес ен ес")
    assert value(spark, T.repair_homoglyphs(F.lit("Пoлтaвa cat"))) == "Полтава cat"
    assert value(spark, T.trim_spaces(F.lit("  a   b "))) == "a b"


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n"), (2, ""), (3, None)], "doc_id int, text string")
    assert [tuple(r) for r in lines(df).orderBy("doc_id", "line_no").collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (2, 1, "")]
    assert [tuple(r) for r in lines(df, keep_last_empty=False).orderBy("doc_id", "line_no").collect()] == [(1, 1, "a"), (1, 2, "b")]


def test_vocabulary(tmp_path):
    path = tmp_path / "v.tsv"
    path.write_bytes("﻿latin\tcyrillic\r\n# note\r\n\r\nSpark\tспарк\r\n".encode())
    assert load_vocabulary(str(path)) == {"spark": "спарк"}
    path.write_text("latin\tcyrillic\na\tб\nA\tв\n")
    with pytest.raises(VocabularyError, match="line 3"):
        load_vocabulary(str(path))
    with pytest.raises(TypeError):
        vocabulary_from({"a": 1})


def test_options():
    assert NormalizeOptions.preset("tts").range_style == "from_to"
    with pytest.raises(TypeError):
        NormalizeOptions(range_style="x")
    with pytest.raises(TypeError):
        NormalizeOptions(validate_dates=1)
