"""Queries without SQL over whole rows, against brute force."""

import zlib

from foliary import catalog


def run(spark, tmp_path, query, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    return catalog.queries()[query](spark, str(tmp_path)).collect()


def test_section_spans_whole(spark, tmp_path):
    known = {"Education": "education", "Perfil": "other", "Experiencia": "work", "Idiomas": "languages"}
    talks = [(1, 0, "one line"), (1, 1, "a\nb\nc"), (1, 100, None), (2, 0, "x\nExperiencia\nCook at Acme\r\nIdiomas\nInglés\n"), (2, 1, ""), (2, 2, "a\rb"), (3, 0, "\n\n")]
    want = []
    for conv, turn, text in talks:
        lines = f"Education\n{text or ''}\nPerfil".replace("\r\n", "\n").split("\n")
        at = [i for i, x in enumerate(lines) if x in known]
        want += [(conv, turn, known[lines[a]], lines[a], a, b) for a, b in zip(at, [*at[1:], len(lines)], strict=True)]
    got = run(spark, tmp_path, "section_spans_whole", "conversations", talks, "conv_id long, turn long, text string")
    assert sorted(map(tuple, got)) == sorted(want)


def test_model_stage_whole(spark, tmp_path):
    kept, low = "Ana\nExperiencia\n" + "cook at Acme\n" * 3_000, "Publicaciones\n" + "p" * 50_000 + "\n"
    plain = "word " * 20_000  # over the budget of 79,200 characters, without sections
    cases = [("", ""), (None, ""), ("short", "short"), ("é" * 5_000 + " end", "é" * 5_000 + " end"), ("x" * 79_200, "x" * 79_200), (kept + low + "Idiomas\nInglés", kept + "Idiomas\nInglés"), (plain, plain[:79_200].rstrip())]
    got = run(spark, tmp_path, "model_stage_whole", "documents", [(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r.doc_id: (r.answer, r.outcome, r.sent_chars) for r in got} == {i: (f'{{"n":{len(t)},"crc":{zlib.crc32(t.encode())}}}', "ok", len(t)) for i, (_, t) in enumerate(cases)}
