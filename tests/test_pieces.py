"""Arrow functions over texts: what a task holds follows a piece of a batch, and results don't depend on the cuts."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kobza.operators import diagnostics, segment
from kobza.operators.pieces import PIECE, pieces
from kobza.operators.spans import summarize
from kobza.sources.lexicons import Lexicons

LINE = "У 2024 вийшов Foo X, 10:30, $12. Так? Ні! Word 17 км. "


def test_pieces_hold_so_many_bytes():
    for texts, most, expected in (
        (["aa", None, "bb", "c", "", "dddd", "e"], 4, [["aa", None, "bb"], ["c", ""], ["dddd"], ["e"]]),
        (["д" * 9, "a", None], 4, [["д" * 9], ["a", None]]),
        ([], 4, []),
        ([None, None], 4, [[None, None]]),
        (["a", "b"], 10, [["a", "b"]]),
    ):
        assert [p.to_pylist() for p in pieces(pa.array(texts, pa.string()), most)] == expected


def peak(run, texts: list[str]) -> int:
    """Bytes of Python objects at most, while one batch is read to its end."""
    kept, batch = [], pa.array(texts)
    tracemalloc.start()
    for part in run(iter([batch])):
        kept.append(len(part))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(kept) == len(texts)
    return most


def functions(monkeypatch, call) -> list:
    """The functions that a call hands to arrow_udf."""
    found = []
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: found.append(f) or (lambda column: None))
    call()
    return found


@pytest.mark.parametrize("call", [diagnostics.spans, segment.tokenize, segment.split_sentences])
def test_objects_do_not_grow_with_the_batch(monkeypatch, call):
    (run,) = functions(monkeypatch, lambda: call(None))
    of = lambda k: peak(run, [f"{i} {LINE * 40}" for i in range(k * PIECE // len((LINE * 40).encode()))])
    of(1)
    assert of(8) < 2.5 * of(1)


def test_results_are_those_of_each_text(spark):
    texts = [None, "", *[f"{i} {LINE * (i % 60)}" for i in range(300)], LINE * 6000, None, LINE, LINE]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    scan = diagnostics.scanner(None, Lexicons())
    expected = {i: None if t is None else (segment.tokens(t), segment.sentences(t), scan(t)) for i, t in enumerate(texts)}
    found = df.select("doc_id", segment.tokenize(F.col("text")), segment.split_sentences(F.col("text")), diagnostics.spans(F.col("text"))).collect()
    assert len(found) == len(texts)
    for i, *columns in found:
        assert (None if columns[0] is None else tuple([tuple(s) for s in c] for c in columns)) == expected[i]
    total = sum(len(e[2]) for e in expected.values() if e)
    assert summarize(diagnostics.flag_uncertain(df)).where("kind = 'total'").first()["count"] == total
