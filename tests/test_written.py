"""Loaders, sinks and written forms."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliary.functions import written as W
from foliary.operators import runs as R
from foliary.sources import images as G


def test_stable_json():
    assert W.stable_json({}) == "{}\n"
    assert W.stable_json({"b": [1, "é"], "a": {"y": [], "x": [[1], 2]}}) == '{\n  "a": {\n    "x": [\n      [1],\n      2\n    ],\n    "y": []\n  },\n  "b": [1, "é"]\n}\n'
    fits = ["x" * 40, "y" * 44]  # with key, quotes and brackets 100 columns
    at = lambda v: W.stable_json({"k": v}).splitlines()
    assert len(at(fits)[1]) <= 100 and len(at(fits)) == 3
    assert len(at([fits[0] + "x" * 9, fits[1]])) == 6
    value = {"z": [{"a": None, "b": True}], "y": [[], [1, [2]]]}
    assert json.loads(W.stable_json(value)) == value


def test_schemas(spark):
    kind = StructType.fromDDL("name string NOT NULL, age int, score double, tags array<struct<t: string>>, more map<string, boolean>")
    got = W.json_schema(kind)
    assert got["required"] == ["name"]
    assert got["properties"]["tags"] == {"type": "array", "items": {"type": "object", "properties": {"t": {"type": "string"}}, "additionalProperties": False}}
    assert got["properties"]["more"] == {"type": "object", "additionalProperties": {"type": "boolean"}}
    assert W.json_schema(kind, "draft-07")["$schema"].startswith("http://json-schema.org/draft-07")
    strict = W.required_nullable(got)
    assert strict["required"] == ["name", "age", "score", "tags", "more"]
    assert strict["properties"]["age"] == {"anyOf": [{"type": "integer"}, {"type": "null"}]}
    assert strict["properties"]["tags"]["anyOf"][0]["items"]["required"] == ["t"]
    assert W.required_nullable(strict) == strict


def test_spliced():
    once = W.spliced("# Title\n", "results", "a\nb\n")
    assert once == "# Title\n\n<!-- results:start -->\na\nb\n<!-- results:end -->\n"
    assert W.spliced(once, "results", "c") == "# Title\n\n<!-- results:start -->\nc\n<!-- results:end -->\n"
    assert W.spliced("", "x", "y").startswith("<!-- x:start -->")


def test_draw(spark):
    row = spark.range(1).select(W.draw(F.lit(1)).alias("a"), W.draw(F.lit(1), 1).alias("b")).first()
    assert row.a == pytest.approx(0.6270739405881613)
    assert 0 <= row.b < 1 and row.b != row.a


def test_jpeg_size():
    frame = bytes.fromhex("FFC0001108012C0190") + bytes(13)
    assert G.jpeg_size(b"\xff\xd8" + frame) == (400, 300)
    assert G.jpeg_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xd0" + frame) == (400, 300)
    assert G.jpeg_size(b"\xff\xd8\xff\xda\x00\x04ab" + frame) is None
    assert G.jpeg_size(b"\xff\xd8") is None


def test_runs(spark, tmp_path):
    (tmp_path / "VERSION").write_text("1.2\n")
    (tmp_path / "manifest.json").write_text('[{"id": "a", "format": "pdf"},\n {"id": "b", "format": "image"}, {"id": "c", "format": "pdf"}]')
    (tmp_path / "truth").mkdir()
    (tmp_path / "truth" / "a.json").write_text('{"x":\n1}')
    entries, version = R.load_dataset(spark, str(tmp_path))
    assert version == "1.2" and entries.count() == 3
    assert [tuple(r) for r in R.load_truth(spark, str(tmp_path / "truth")).collect()] == [("a", '{"x":\n1}')]
    system = R.System("plain", "rules", ("pdf",), lambda e: e.where("id = 'a'").select("id", F.lit("{}").alias("prediction"), F.create_map(F.lit("in"), F.lit(None).cast("long")).alias("usage")))
    got = {r.id: (r.prediction, r.seconds, r.usage) for r in R.predictions(system, entries).collect()}
    assert got == {"a": ("{}", None, None), "b": (None, None, None), "c": (None, None, None)}
    assert R.result_folder("out/", True) == "out/partial" and R.result_folder("out", False) == "out"


def test_folds(spark):
    """The native way for plain Latin texts gives what the Unicode tables give."""
    from random import Random

    from foliary.functions import text as T

    rnd = Random(9)
    letters = [chr(c) for c in [*range(0, 0x180), *range(0x2010, 0x2024), 0x20AC, 0x301, 0x327, 0x3A9, 0x1E9E, 0xFB01, 0x4E2D] if c]
    texts = ["".join(rnd.choice(letters[: rnd.choice((128, 256, 383, len(letters)))]) for _ in range(rnd.randrange(1, 12))) for _ in range(4000)] + letters + ["", None, "Ñandú  ÁÉÍ\tœuvre Straße"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fold("t").alias("f"), T.unaccent("t").alias("u")).collect()
    bad = [(r.t, r.f, r.u) for r in got if r.t is not None and (r.f != T._fold(r.t) or r.u != T._unaccent(r.t))]
    assert not bad
    assert any(r.t is None and r.f is None for r in got)


def test_numbered(spark):
    from foliary.operators.records import numbered

    rows = spark.range(1000).select((F.col("id") * 7919 % 10007).alias("key"))
    got = [r.key for r in numbered(rows, "key", per_range=60).orderBy("k").collect()]
    assert got == sorted(i * 7919 % 10007 for i in range(1000))
    assert [r.k for r in numbered(rows, "key").orderBy("key").collect()] == list(range(1, 1001))
