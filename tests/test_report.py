"""Reports, salvage and the cut of inputs."""

import datetime as dt

from foliary.operators.report import render, slice_table, summary
from foliary.operators.grounding import Grounder, missing_sections
from foliary.operators.tidying import Tidier, salvaged


def test_report(spark):
    rows = [("b", "skills", 0.5), ("a", "skills", 0.5), ("c", "skills", 0.75), ("c", "education.level", 0.0)]
    fields = spark.createDataFrame(rows, "system string, field string, f1 double")
    text = render(fields).splitlines()
    assert text[0] == "| system | overall | education.level | skills |"
    assert text[2:] == ["| c | **75.0** | 0.0 | 75.0 |", "| a | **50.0** | n/a | 50.0 |", "| b | **50.0** | n/a | 50.0 |"]
    slices = slice_table(spark.createDataFrame([("x", "a", 1.0), ("w", "b", 0.5)], "slice string, system string, f1 double"))
    assert [tuple(r) for r in slices.collect()] == [("w", None, 0.5), ("x", 1.0, None)]


def test_summary(spark):
    fields = spark.createDataFrame([("skills", 1, 1, 1, 0.5, 0.5, 0.5)], "field string, tp long, fp long, fn long, prec double, rec double, f1 double")
    statuses = spark.createDataFrame([(1, True, None, None), (2, False, None, "boom"), (3, False, "format", None)], "doc_id long, ok boolean, skipped string, error string")
    lines = summary("x", fields, statuses).splitlines()
    assert lines[0] == "x: 3 documents, 2 attempted, 1 failed"
    assert lines[3].split() == ["skills", "50.0", "50.0", "50.0", "2"]
    assert lines[-1] == "failed: 2: boom"


def test_salvage():
    work = ",".join(f'{{"name":"Acme","position":"Cook","startDate":"{y}"}}' for y in (2000, 2002, 2004))
    got = salvaged(f'{{"work":[{work},{{"name":"B","startDate":"1800"}},{{"name":"C"}},{{"name":"c "}},{{"na', dt.date(2026, 1, 1))
    assert got == {"work": [{"name": "Acme", "position": "Cook", "startDate": "2000"}, {"name": "C"}]}
    assert salvaged('{"work":"x', dt.date(2026, 1, 1)) is None


def test_rules_on_awkward_records():
    entries = [None, 1, "x", [], {}, {"name": None, "keywords": "ab", "startDate": 3, "location": ["x"]}, {"name": " ", "position": "Cook", "startDate": "2010", "endDate": "2010"}]
    sections = ("work", "education", "volunteer", "skills", "languages", "certificates", "projects")
    for record in ({}, {"basics": None, "ext": None}, {"basics": {"profiles": entries, "location": {}}, "ext": {"location": {}, "normalizedSkills": []}}, dict.fromkeys(sections, entries), dict.fromkeys(sections, "text"), dict.fromkeys(sections, {})):
        for text in ("", "\n\n", "no headings here", "Educación\nx\r\nExperience\nCook 2010", "é" * 5000):
            grounded, _ = Grounder(record, text).run()
            assert set(grounded) >= set(record)
            assert isinstance(missing_sections(grounded, text), list)
            tidy, _ = Tidier(record, text, dt.date(2026, 1, 1)).run()
            assert tidy["ext"] is not None
