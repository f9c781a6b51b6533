"""What normalization costs a text, and how a table's texts are dealt out."""

import itertools
import re

import pytest

from kobza.functions import text as T
from kobza.operators import normalize as N
from kobza.options import NormalizeOptions
from kobza.sources.lexicons import Lexicons


def one_by_one(text: str) -> str:
    """Each unit in its order over the whole text, then the letters."""
    for latin, cyrillic in [*sorted(T.UNITS, key=lambda u: (u[0] != "ts", -len(u[0]))), ("x", "кс"), ("j", "дж")]:
        text = re.sub(latin, cyrillic, text, flags=re.I)
    both = T.SINGLES | {c.upper(): v for c, v in T.SINGLES.items()} | {"ñ": "нь", "Ñ": "нь", "ß": "сс"}
    return text.translate(str.maketrans(both | {c: to for to, letters in T.DIACRITICS.items() for c in letters + letters.upper()}))


def test_transliteration_is_that_of_each_unit_in_turn(monkeypatch):
    words = ["".join(w) for k in (1, 2, 3, 4) for w in itertools.product("tschykueoa", repeat=k)] + ["SCHtSTSCH", "yİ yı YI", "Ñandú ßx Jazz", "çœŁ", "zhKHyayeee", ""]
    expected = [one_by_one(w) for w in words]
    monkeypatch.setattr(re, "sub", None)  # nothing is compiled or looked up a word
    assert [N.transliterated(w) for w in words] == expected


def test_beginning_of_a_sentence():
    before = re.compile(r"(?:^|[.!?]\s+)$")
    for text in ("".join(t) for k in range(6) for t in itertools.product("а.! \n", repeat=k)):
        assert N.begins_sentence(text + "НАТО", len(text)) == bool(before.search(text)), repr(text)


def test_gate_is_open_to_words_without_cyrillic():
    assert N.gate_of(["див.", "і т. д."]) is N.CYRILLIC
    assert N.gate_of(["див.", "etc."]) is None


@pytest.mark.parametrize("least", ["1", "40"])
def test_distinct_texts_are_dealt_out_evenly(spark, least):
    """Adaptive plans would read some hundred short texts in one task."""
    name, n = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    before = spark.conf.get(name)
    spark.conf.set(name, least)
    try:
        df = spark.createDataFrame([(i, None if i % 7 == 0 else f"Word {i % 300}") for i in range(900)], "id int, text string")
        out = N.normalize_many(df, "text", "spoken")
        rows = {r.id: r.spoken for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    tasks = max(int(least), 4 * n)
    assert f"RoundRobinPartitioning({tasks}), REPARTITION_BY_NUM" in plan
    rewrite = N.build(NormalizeOptions(), Lexicons())
    assert rows == {i: None if i % 7 == 0 else rewrite(f"Word {i % 300}") for i in range(900)}
