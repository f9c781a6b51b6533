"""The registered diagnostics against brute force over what each detector finds."""

from collections import Counter

from kobza.operators.diagnostics import scanner
from kobza.plans.queries import queries
from kobza.sources.lexicons import Lexicons

TEXTS = ["У 2024 вийшов Foo X, 10:30, $12, 03/04/2026 і 99:30.", "Дата 31.02.2024 і 2023-02-30, AB-12/34 та 17 Word.", "Картка 4111 1111 1111 1112, ISSN 0378-5954, Пoлтава 5/0, 999.1.1.1", "", None]
LOOSE = {"BareNumber", "Unit", "ForeignWord", "Time"}


def test_queries_are_brute_force(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id int, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    scan, expected = scanner(None, Lexicons()), Counter()
    for row in df.collect():
        first = scan.first_found(row.text or "")
        for (a, b), (reason, category, severity) in first.items():
            held = [p for p, (_, c, _) in first.items() if c in ("Identifier", "Time") and p[0] <= a and b <= p[1] and p != (a, b)]
            if category not in LOOSE or not held:
                expected[row.doc_id, a, b, row.text[a:b], reason, category, severity] += 1
    got = Counter(tuple(r) for r in queries()["diagnostic_spans"](spark, str(tmp_path)).collect())
    assert got == expected and len(got) > 20
    summary = {(r.kind, r.name): r["count"] for r in queries()["diagnostic_summary"](spark, str(tmp_path)).collect()}
    assert summary == {("total", "total"): len(got), **{("severity", k): n for k, n in Counter(x[6] for x in got).items()}, **{("category", k): n for k, n in Counter(x[5] for x in got).items()}}
