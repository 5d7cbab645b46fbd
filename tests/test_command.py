"""The command line."""

from foliary.__main__ import main


def test_command(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    out = str(tmp_path / "out")
    assert main(["read", str(tmp_path / "in"), out], spark) == 0
    assert [r.text for r in spark.read.parquet(out).collect()] == ["hello"]
    assert main(["read", str(tmp_path / "in"), out], spark) == 1  # out is there already
    assert main(["run", "loop_docs", "/root/testdata/sf0.001", str(tmp_path / "q")], spark) == 0
    assert main(["run", "no_such_query", "x", "y"], spark) == 2
    assert main([], spark) == 2
    assert main(["--help"], spark) == 0
    assert main(["list"]) == 0
    assert "loop_docs" in capsys.readouterr().out
