"""Tables of many rows but few bytes: their rows are work for many tasks."""

from random import Random

import pytest
from pyspark.sql import functions as F

from foliary import catalog
from foliary.functions.written import draw


@pytest.mark.parametrize("query", ["people_grounded", "people_read_back"])
def test_rows_of_one_file_are_many_tasks(spark, tmp_path, query):
    spark.range(12_000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = catalog.queries()[query](spark, str(tmp_path)).select("c_custkey", F.spark_partition_id().alias("task"))
    rows = got.groupBy("task").count().collect()
    assert len(rows) >= 3 and sum(r["count"] for r in rows) == 12_000


def test_draws(spark):
    """All draws at once are the draws one by one."""
    from foliary.operators.synthetic import draws

    rows = spark.createDataFrame([(s,) for s in (0, 1, 2**31, 2**32 - 1, 2654435761)], "s long")
    got = rows.select(draws(F.col("s"), 40).alias("all"), F.array(*[draw(F.col("s"), k) for k in range(40)]).alias("single")).collect()
    assert all(r["all"] == r.single for r in got)


def test_marks_go():
    """Every character goes that is a mark, however many there are."""
    import unicodedata

    from foliary.functions.text import _strip

    rnd, marks = Random(4), [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)).startswith("M")]
    texts = ["".join(rnd.choice(rnd.choice((marks, "aéẞñ中 Z"))) for _ in range(60)) for _ in range(300)]
    for t in [*texts, "".join(marks), "", "abc"]:
        plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", t))
        assert _strip(t, "NFKC") == "".join(c for c in plain if not unicodedata.category(c).startswith("M"))


def test_readings_kept():
    """What a worker keeps is what it would read, and only of short texts."""
    import datetime as dt

    from foliary.functions import dates as D

    ref, other = dt.date(2026, 1, 15), dt.date(2020, 3, 1)
    for t in [None, "", "Marzo 2021", "hace 2 años", "03/2015 - Actualidad", "ene. 2004 – dic. 2009", "2010", "x" * 70, "enero 2004" + " " * 60]:
        for r in (ref, other, ref):
            assert D.read_date(t, r) == tuple(D.normalize(t, r).values())
            assert D.read_range(t, r) == ((x := D.split_range(t, r)) and tuple(x.values()))
    held = D._kept_range.cache_info().currsize
    D.read_range("y" * 61, ref)
    assert D._kept_range.cache_info().currsize == held


def test_terms_of_letters():
    """What is told without the pattern is what the pattern tells."""
    from foliary.functions import phrases as P

    rnd = Random(7)
    texts = ["".join(rnd.choice("ab ñ.-/+1#") for _ in range(rnd.randrange(12))) for _ in range(2_000)]
    terms = ["", "a", "ab", "ñ", "a b", "a-b", "b.", "1a", "ba"]
    assert all(P.has_term(t, w) == bool((p := P.term(w)) and p.search(t)) for t in texts for w in terms)


def test_copied():
    from foliary.operators.grounding import copied

    value = {"a": [{"b": None, "c": [1, "x"]}], "d": {}}
    other = copied(value)
    other["a"][0]["c"].append(2)
    assert value == {"a": [{"b": None, "c": [1, "x"]}], "d": {}} and other["a"][0]["c"] == [1, "x", 2]
