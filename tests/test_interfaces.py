"""Command line, SQL functions, sinks, calls and sources."""

import io

import pytest
from pyspark.sql import functions as F

from kobza.__main__ import main
from kobza.functions.registered import register
from kobza.functions.text import cyrilize, transliterate_to_cyrillic
from kobza.options import NormalizeOptions, chosen_options
from kobza.sources.sinks import exit_code, write_texts
from kobza.sources.text import inline, standard_input, vocabulary_from


def test_command_line(capsys, monkeypatch, tmp_path):
    assert main(["normalize", "до", "5", "кг"]) == 0 and capsys.readouterr().out == "до п'яти кілограмів\n"
    assert main(["uncertain", "--fail-on", "error", "Час 99:30"]) == 2 and "99:30" in capsys.readouterr().out
    assert main(["uncertain", "--fail-on", "warn", "слово"]) == 0 and capsys.readouterr().out == ""
    (tmp_path / "t").write_text("Раз. Два.", encoding="utf-8")
    assert main(["sentences", "--file", str(tmp_path / "t")]) == 0 and capsys.readouterr().out == "Раз.\nДва.\n"
    monkeypatch.setattr("sys.stdin", io.StringIO("раз, два"))
    assert main(["tokens", "--stdin"]) == 0 and capsys.readouterr().out == "раз\n,\nдва\n"
    with pytest.raises(SystemExit) as stopped:
        main(["normalize"])
    assert stopped.value.code == 1


def test_sql_functions(spark):
    assert "uk_normalize" in register(spark)
    row = spark.sql("SELECT uk_normalize('5 кг') AS a, uk_plural(22, 'рік', 'роки', 'років') AS b, uk_valid_date(30, 2, 2024) AS c, uk_valid_date(29, 2, 2024) AS d, uk_trim('  a  b ') AS e").first()
    assert tuple(row) == ("п'ять кілограмів", "роки", False, True, "a b")


def test_calls():
    assert chosen_options({"Foo": "фу"}).vocabulary == {"foo": "фу"}
    base = NormalizeOptions(range_style="from_to", vocabulary={"a": "б"})
    merged = chosen_options(base, vocabulary={"c": "д"})
    assert merged.vocabulary == {"a": "б", "c": "д"} and merged.range_style == "from_to" and base.vocabulary == {"a": "б"}
    with pytest.raises(TypeError):
        chosen_options(base, preset="tts")
    assert vocabulary_from({"Foo": " фу "}) == {"foo": " фу "}


def test_sinks_and_sources(spark, tmp_path, monkeypatch):
    df = inline(spark, "раз", "два")
    write_texts(df, "text", str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["раз два"]
    found = spark.createDataFrame([("Info",), ("Warning",)], "severity string")
    assert exit_code(found, "Warning") == 2 and exit_code(found, "Error") == 0
    monkeypatch.setattr("sys.stdin", io.StringIO("три"))
    assert standard_input(spark).first().text == "три"
    with pytest.warns(DeprecationWarning):
        same = df.select(cyrilize(F.lit("shchyt")).alias("a"), transliterate_to_cyrillic(F.lit("shchyt")).alias("b")).first()
    assert same.a == same.b
