"""Every query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from foliary import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    plain = lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v
    num = lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return sorted(repr(tuple(num(plain(v)) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if (sql := catalog.oracle_sql().get(name)) is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_assignment():
    from foliary.operators.records import assign

    assert assign([[0.9, 0.8], [0.85, 0.1]]) == [(0, 1), (1, 0)]
    assert assign([[0.4]]) == []
    assert assign([]) == []
    assert assign([[0.6] * 20, [0.7] * 20]) == [(0, 1), (1, 0)]


def test_sources(spark, tmp_path):
    from foliary.sources.formats import read_documents

    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 x")
    got = {r.path.rsplit("/")[-1]: (r.format, r.text, r.error) for r in read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("text", "hello", None), "b.pdf": ("pdf", None, "NO_TEXT_LAYER")}


def test_inbox(spark, tmp_path):
    from foliary.streaming.inbox import watch

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("same")
    (inbox / "b.txt").write_text("same")
    seen = []
    watch(spark, str(inbox), lambda df, _: seen.extend(r.format for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == ["text"]


def test_ask():
    from foliary.operators.model import ask

    def model(*answers):
        asked = []
        rest = iter(answers)
        return asked, lambda text, most, penalty: (asked.append((len(text), penalty)), next(rest))[1]

    asked, m = model(("x", False))
    assert ask(m, "a" * 50, 100, 10) == ("x", "ok", 50) and asked == [(50, None)]
    asked, m = model(("x", True), ("y", False))
    assert ask(m, "a" * 1000, 100, 10) == ("y", "less_input", 198) and asked == [(330, None), (198, None)]
    asked, m = model(("ab" * 400, True), ("y", False))
    assert ask(m, "a", 100, 10) == ("y", "penalty", 1) and asked[1] == (1, 0.3)
    assert ask(model(("x", True))[1], "", 100, 10) == (None, "failed", 0)
    asked, m = model(("x", True), ('{"a":[{"b":1},2', True))
    assert ask(m, "a" * 1000, 100, 10)[1] == "salvaged"
