"""DOCX files, engines, and the public names."""

import io
import json
import zipfile

import pytest

import foliary
from foliary.__main__ import main
from foliary.operators import adapters as A
from foliary.sources.docx import docx_text

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def docx(body, part="word/document.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("_rels/.rels", f'<Relationships><Relationship Type="http://x/officeDocument" Target="/{part}"/></Relationships>')
        z.writestr(part, f"<w:document {NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(text, more=""):
    return f"<w:p>{more}<w:r><w:t>{text}</w:t></w:r></w:p>"


def box(*texts):
    return "<w:r><w:pict><w:txbxContent>" + "".join(map(p, texts)) + "</w:txbxContent></w:pict></w:r>"


def test_docx():
    cell = lambda *blocks: f"<w:tc>{''.join(blocks)}</w:tc>"
    table = lambda *rows: f"<w:tbl>{''.join(f'<w:tr>{r}</w:tr>' for r in rows)}</w:tbl>"
    bullet = "<w:pPr><w:numPr/></w:pPr>"
    assert docx_text(docx(p("a") + p("") + p("b", bullet))) == "a\n- b"
    assert docx_text(docx(table(cell(p("1")) + cell(p("")), cell(p("2")) + cell(p("3"))), "word/other.xml")) == "1 | \n2 | 3"
    assert docx_text(docx(table(cell(p("1"), p("x" * 90)) + cell(p("2"))))) == "1\n" + "x" * 90 + "\n2"
    both = f"<mc:AlternateContent><mc:Choice>{box('Inglés', 'Go')}</mc:Choice><mc:Fallback>{box('Inglés', 'Go')}</mc:Fallback></mc:AlternateContent>"
    assert docx_text(docx(f"<w:p>{both}<w:r><w:t>Perfil</w:t></w:r></w:p><w:p>{box('Inglés', 'Perfil')}</w:p>")) == "Perfil\n\nInglés\nGo\nInglés"
    assert docx_text(docx("")) == ""
    with pytest.raises(ValueError):
        docx_text(docx(p("a")), most=10)


def test_nested_layouts(spark):
    schema = "doc_id long, page long, seq long, id string, kind string, text string, children array<string>"
    line = lambda k: (1, 1, 10 + k, f"l{k}", "LINE", f"line {k}", [])
    rows = [line(k) for k in range(5)] + [(1, 1, 2, "a", "LAYOUT_LIST", None, ["b", "l3", "gone"]), (1, 1, 1, "b", "LAYOUT_LIST", None, ["c"]), (1, 1, 0, "c", "LAYOUT_TEXT", None, ["l2", "l1"]), (1, 1, 3, "d", "LAYOUT_TEXT", None, ["l1", "l0"]), (2, 1, 0, "x", "LINE", "no layout", [])]
    assert [tuple(r) for r in A.layout_texts(spark.createDataFrame(rows, schema)).collect()] == [(1, 1, "line 2\nline 1\nline 3\n\nline 0\n\nline 4")]
    loop = [(1, 1, 0, "a", "LAYOUT_LIST", None, ["b"]), (1, 1, 1, "b", "LAYOUT_LIST", None, ["c"]), (1, 1, 2, "c", "LAYOUT_LIST", None, ["b"])]
    with pytest.raises(ValueError):
        A.layout_texts(spark.createDataFrame(loop, schema))


def test_public_names():
    assert all(callable(getattr(foliary, n)) for n in foliary.__all__)
    with pytest.raises(AttributeError):
        foliary.no_such_name  # noqa: B018


def test_show_score_and_import(spark, tmp_path, capsys):
    assert main(["show", "topk_customers", "/root/testdata/sf0.001"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines and all(isinstance(json.loads(x), dict) for x in lines)
    assert main(["show", "topk_customers", "/root/testdata/sf0.001", "--pretty"], spark) == 0
    assert json.loads(capsys.readouterr().out) == [json.loads(x) for x in lines]
    truth = tmp_path / "truth"
    truth.mkdir()
    for k in range(3):
        (truth / f"e{k}.json").write_text(json.dumps({"basics": {"name": "Ana Paz", "email": f"a{k}@x.org"}}))
    said = [("e0", '{"basics":{"name":"Ana Paz","email":"a0@x.org"}}'), ("e1", '{"basics":{"name":"Eva Gil"}}')]
    spark.createDataFrame(said, "id string, prediction string").write.parquet(str(tmp_path / "said"))
    args = ["score", str(truth), str(tmp_path / "said"), str(tmp_path / "out")]
    assert main([*args, "--name", "mine"], spark) == 0
    told = capsys.readouterr().out
    assert "basics.name" in told and json.loads(told.splitlines()[-1])["spark"] == spark.version
    assert main([*args, "--limit", "1"], spark) == 0  # a subset's counts go elsewhere
    assert main([*args, "--limit", "0"], spark) == 2
    assert main(args, spark) == 1
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "public-ar-one.txt").write_text("Experiencia\nfoo\nEducation\nbar")
    assert main(["import", str(inbox), str(tmp_path / "drafts")], spark) == 0
    assert [(r.source, r.cc, r.format, r.language) for r in spark.read.parquet(str(tmp_path / "drafts")).collect()] == [("public-record", "ar", "text", "mixed")]
