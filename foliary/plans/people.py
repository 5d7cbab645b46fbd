"""Queries over degrees, headings, positioned text and whole records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from foliary.functions import free_text as T
from foliary.functions import headings as H
from foliary.functions.degrees import degree_level
from foliary.operators import reading_order as O
from foliary.operators import scoring as S
from foliary.operators import sections as X
from foliary.operators.grounding import ground
from foliary.operators.tidying import tidy
from foliary.plans.registry import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

TODAY = dt.date(2026, 1, 15)
NL = "chr(10)"


def _told(c):
    return F.concat_ws(": ", c["level"], c["canonical"])


book.cases("degree_levels", "study string, area string, r string", [
    ("Licenciatura en Sistemas", None, "bachelor: Licenciatura"), ("Máster Universitario en IA", None, "master: Máster"), ("Técnico Superior en Ingeniería Informática", None, "technical: Técnico Superior"),
    ("Grado Superior de FP", None, "technical: Formación Profesional"), ("Diplomado en Marketing", None, "course: Diplomado"), ("Curso de posgrado en Derecho", None, "course: Curso"), ("Diplomado en posgrado", None, "postgraduate: Posgrado"),
    ("Ingeniería en curso", None, "bachelor: Ingeniería"), ("Cursó 3 años de Medicina", None, "bachelor: Medicina"), ("PhD in Physics", None, "doctorate: Doctorado"), ("M.Sc. Physics", None, "master: Máster"), ("MA", None, "master: Máster"),
    ("Bachelor of Engineering", None, "bachelor: Ingeniería"), ("Bachelor's Degree", None, "bachelor: Licenciatura"), ("High School", None, "secondary: Secundario"), ("Curso Técnico em Redes", None, "technical: Técnico"),
    ("Especialista y Doctor", None, "doctorate: Doctorado"), ("Bachiller técnico", None, "secondary: Bachillerato"), ("xyz", "Ingeniería", "unknown"), (None, "Ingeniería en Sistemas", "bachelor: Ingeniería"), (" ", "Sistemas, ingeniería", "unknown"),
    (None, None, "unknown"),
], lambda s, a: _told(degree_level(s, a)))
book.cases("section_headings", "t string, r string", [
    ("EXPERIENCIA LABORAL", "work"), ("• Educación:", "education"), ("Courses & Certifications", "certificates"), ("Skills & Tools", "skills"), ("Mis proyectos", "projects"), ("Habilidades e Intereses", "skills"), ("Formación Profesional, Universidad de Palermo", ""),
    ("Idiomas 2", ""), ("Idiomas", "languages"), ("Work experience at a small firm in town", ""), ("Perfil", ""), ("", ""), (None, ""),
], lambda t: F.array_join(H.section_keys(t), ","))
book.cases("heading_like_lines", "t string, r boolean", [
    ("CARGOS EJERCIDOS", True), ("Datos Complementarios", True), ("Juan Pérez", False), ("ANEXOS", False), ("SAP FI", False), ("BANCO CENTRAL", False), ("INGENIERO CIVIL", False), ("Otros datos personales", False), ("Datos de Interés", True), ("Datos, Varios", False),
    ("", False), (None, False),
], H.looks_like_heading)


@book.query("conversations", sql=f"""WITH t AS (SELECT conv_id * 100 + turn AS id, 'Education' || {NL} || coalesce(text, '') || {NL} || 'Perfil' AS text FROM conversations WHERE text IS NULL OR NOT regexp_matches(text, '[\\n\\r]'))
SELECT id AS doc_id, s.section, s.heading, s."start"::BIGINT AS "start", s."end"::BIGINT AS "end" FROM t, (VALUES ('education', 'Education', 0, 2), ('other', 'Perfil', 2, 3)) s(section, heading, "start", "end")""")
def section_spans(talks):
    one_line = talks.where("text IS NULL OR NOT text RLIKE '[\\\\n\\\\r]'")
    docs = one_line.select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), F.concat_ws("\n", F.lit("Education"), F.coalesce("text", F.lit("")), F.lit("Perfil")).alias("text"))
    return X.section_spans(docs)


@book.query("conversations")
def section_spans_whole(talks):
    """Spans of every turn's whole text, between two headings for turns that have none. section_spans has the one-line turns alone, which its SQL can express."""
    turn = F.struct("conv_id", "turn").alias("doc_id")
    docs = talks.select(turn, F.concat_ws("\n", F.lit("Education"), F.coalesce("text", F.lit("")), F.lit("Perfil")).alias("text"))
    return X.section_spans(docs).select("doc_id.*", "section", "heading", "start", "end")


@book.query("documents", "labels", sql="SELECT doc_id, 'projects' AS section FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def coverage(docs, labels):
    """Every document under a heading (they have none of their own); the labelled ones have their projects."""
    headed = docs.select("doc_id", F.concat_ws("\n", F.lit("• Featured Projects:"), "text").alias("text"))
    return X.uncovered(headed, labels.select("doc_id", F.lit("projects").alias("section")))


PAGES = {
    # Two columns in stream order, under a header as wide as the page.
    1: ([("Header of the page that is long enough to span all of the page", 50, 750)] + [(f"left line {k}", 50, 700 - 12 * k) for k in range(5)] + [(f"right line {k}", 350, 700 - 12 * k) for k in range(5)],
        "Header of the page that is long enough to span all of the page\n\n" + "\n".join(f"left line {k}" for k in range(5)) + "\n\n" + "\n".join(f"right line {k}" for k in range(5))),
    # Rows of a table, cell by cell: dates on the right stay with their rows.
    2: ([x for k in range(5) for x in ((f"Company number {k}", 50, 700 - 12 * k), (f"20{k}0", 400, 700 - 12 * k))], "\n".join(f"Company number {k} 20{k}0" for k in range(5))),
    # A hyphen at a line's end, a shadow, and a gap that starts a new block.
    3: ([("Comunica-", 50, 700), ("ción efectiva", 50, 688), ("Full-", 50, 676), ("Stack", 50, 664), ("Name", 50, 600), ("Name", 51, 600.5), ("joined", 50, 588), ("up", 80, 588)], "Comunicación efectiva\nFull-\nStack\n\nName\njoinedup"),
    4: ([("  ", 50, 700)], ""),
}


def _reading_order(spark, sf_dir):
    rows = [(d, 1, k, text, float(x), float(y), 5.0 * len(text), 10.0, False) for d, (items, _) in PAGES.items() for k, (text, x, y) in enumerate(items)]
    items = spark.createDataFrame(rows, "doc_id long, page int, seq int, str string, x double, y double, width double, height double, has_eol boolean")
    return O.reading_order(items).select("doc_id", "text", "layout")


def _sql(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


QUERIES["reading_order"] = _reading_order
ORACLES["reading_order"] = "SELECT d::BIGINT AS doc_id, t AS text, l AS layout FROM (VALUES " + ", ".join(f"({d}, {_sql(t)}, {_sql('unknown' if d == 4 else 'multi-column' if d == 1 else 'single-column')})" for d, (_, t) in PAGES.items()) + ") v(d, t, l)"

CV = """Ana Díaz
ana@x.org - +54 11 4127-7100 int 5045 - Mendoza, Argentina
Experiencia
Científica de Datos, Telecom S.A. (2016 - 2018)
2014: Secretaria Técnica
2016: Coordinadora Regional
Educación
Universidad de Cuyo - Computer Engineering (2010)
Coursera: Machine Learning, 2021
Habilidades
Python (avanzado), Node JS
Idiomas
Inglés: C1 - Avanzado
Portugués"""

book.cases("ground_records", "record string, r string", [
    ('{"basics":{"email":"ana@x.org","phone":"1141277100","url":"http://other.com","location":{"city":"Ciudad de Mendoza","countryCode":"AR"}}}',
     '{"basics":{"email":"ana@x.org","location":{"city":"Mendoza","countryCode":"AR"},"phone":"1141277100","url":null}}'),
    ('{"basics":{"email":"ana@y.org","phone":"5551234567","location":{"city":"Lima","region":"Lima","countryCode":"PE"}}}', '{"basics":{"email":null,"location":null,"phone":null}}'),
    ('{"skills":[{"name":"Backend","keywords":["node.js","Java"]},{"name":"Python","level":"avanzado"},{"name":"Rust"}]}', '{"skills":[{"keywords":["node.js"],"name":"Backend"},{"level":"avanzado","name":"Python"}]}'),
    ('{"languages":[{"language":"English","fluency":"B2"},{"language":"Portuguese","fluency":"native"},{"language":"French","fluency":"A1"}]}', '{"languages":[{"fluency":"C1 - Avanzado","language":"English"},{"fluency":null,"language":"Portuguese"}]}'),
    ('{"education":[{"institution":"Universidad de Cuyo","studyType":"Bachelor degree"}],"ext":{}}', '{"education":[{"institution":"Universidad de Cuyo","studyType":"Computer Engineering"}],"ext":{"educationLevels":[{"canonical":"Ingeniería","level":"bachelor","original":"Computer Engineering"}]}}'),
    ('{"work":[{"name":"Científica de Datos","position":null}]}', '{"work":[{"name":"Telecom S.A.","position":"Científica de Datos"}]}'),
    ('{"work":[{"name":"Universidad de Cuyo","position":"Computer Engineering","endDate":"2010"}]}',
     '{"education":[{"endDate":"2010","institution":"Universidad de Cuyo","startDate":null,"studyType":"Computer Engineering","url":null}],"work":[]}'),
    ("no json", "{}"), (None, "{}"),
], lambda r: ground(r, F.lit(CV))["record"])
book.cases("coverage_of_records", "record string, r string", [('{"work":[{"name":"Telecom S.A."}],"skills":[{}]}', "education,skills,languages"), ("{}", "work,education,skills,languages")], lambda r: F.array_join(ground(r, F.lit(CV))["missing"], ","))
book.cases("normalize_records", "record string, r string", [
    ('{"work":[{"name":" Telecom S.A. ","position":"","startDate":"marzo 2020","endDate":"actualidad"},{"name":"Telecom S.A.","startDate":"marzo 2020","endDate":"actualidad","position":null}]}',
     '{"ext":{},"work":[{"endDate":null,"name":"Telecom S.A.","position":null,"startDate":"2020-03"}]}'),
    ('{"work":[{"name":"Científica de Datos, Telecom S.A.","startDate":"2019 - 2021"}]}', '{"ext":{},"work":[{"endDate":"2021","name":"Telecom S.A.","position":"Científica de Datos","startDate":"2019"}]}'),
    ('{"work":[{"name":"Freelance — Developer","position":"Developer"},{"name":"Freelance","position":"Freelance"}]}', '{"ext":{},"work":[{"name":"Freelance","position":"Developer"},{"name":"Freelance","position":null}]}'),
    ('{"work":[{"name":"Coursera","startDate":"2021"}],"certificates":[{"issuer":"Coursera","name":"ML","date":"2021"}]}', '{"certificates":[{"date":"2021","issuer":"Coursera","name":"ML"}],"ext":{},"work":[]}'),
    ('{"skills":[{"name":"Go; Rust (std, core)","keywords":["a, b","A"]}]}', '{"ext":{"normalizedSkills":["a","b","rust (std, core)"]},"skills":[{"keywords":["a","b"],"name":"Go"},{"keywords":[],"name":"Rust (std, core)"}]}'),
    ('{"work":[{"name":"Directora de Comunicación del Ministerio de Cultura","position":"Directora"}]}', '{"ext":{},"work":[{"name":"Ministerio de Cultura","position":"Directora de Comunicación"}]}'),
    ('{"basics":{"location":{"countryCode":"ar"}},"ext":{"location":{"countryCode":"ARG"},"confidenceNotes":["8e51 77aa 12","a clear note"]}}',
     '{"basics":{"location":{"countryCode":"AR"}},"ext":{"confidenceNotes":["a clear note"],"location":{"countryCode":null}}}'),
    ('{"certificates":[{"name":"x","date":"2012, 2019"}]}', '{"certificates":[{"date":"2019","name":"x"}],"ext":{}}'),
], lambda r: tidy(r, F.lit(None).cast("string"), TODAY)["record"])

SCORED = [
    # (truth, prediction, field -> tp, fp, fn)
    ('{"basics":{"name":"María de la Paz Gómez","email":"M@x.org","phone":"+54 11 4127 7100","location":{"city":"CABA","countryCode":"AR"}},"skills":[{"name":"Go"},{"name":"g","keywords":["C++","Rust"]}],"languages":[{"language":"Inglés"}]}',
     '{"basics":{"name":"Maria Paz Gomez","email":"m@x.org","phone":"1141277100"},"skills":[{"name":"go"},{"name":"Java"}],"languages":[{"language":"English"},{"language":"French"}]}',
     {"basics.name": (1, 0, 0), "basics.email": (1, 0, 0), "basics.phone": (1, 0, 0), "basics.location": (0, 0, 1), "skills": (1, 1, 2), "languages": (1, 1, 0)}),
    ('{"work":[{"name":"Acme S.A.","position":"Cook","startDate":"2019","endDate":"2020"},{"name":"Acme S.A.","position":"Cook","startDate":"2021","endDate":null},{"name":"Other","position":"Chef","startDate":"2010"}]}',
     '{"work":[{"name":"Acme","position":"Cook","startDate":"2021-03","endDate":"Present"},{"name":"ACME","position":"Cook","startDate":"2019","endDate":"2021"}]}',
     {"work.entries": (2, 0, 1), "work.dates": (3, 1, 3)}),
    ('{"education":[{"institution":"UBA","studyType":"Licenciatura"},{"institution":"Coursera","studyType":"ML course","endDate":"2021"}],"ext":{"educationLevels":[{"level":"bachelor"},{"level":"course"}]}}',
     '{"education":[{"institution":"UBA","studyType":"Licenciatura"}],"certificates":[{"name":"ML course","issuer":"Coursera","date":"2021"}],"ext":{"educationLevels":[{"level":"master"}]}}',
     {"education.entries": (2, 0, 0), "education.dates": (1, 0, 0), "education.level": (1, 1, 1)}),
    ('{"work":[{"name":"A","startDate":"2020"}],"languages":[{"language":"es"}]}', None, {"work.entries": (0, 0, 1), "work.dates": (0, 0, 2), "languages": (0, 0, 1)}),
]


def _score_records(spark, sf_dir):
    rows = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(SCORED)], "doc_id long, t string, p string")
    side = lambda c: rows.select("doc_id", F.from_json(c, S.RECORD).alias("record")).where("record IS NOT NULL")
    return S.score_records(side("t"), side("p"))


QUERIES["score_records"] = _score_records
ORACLES["score_records"] = "SELECT d::BIGINT AS doc_id, f AS field, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn FROM (VALUES " + ", ".join(f"({i}, '{f}', {', '.join(map(str, c))})" for i, x in enumerate(SCORED) for f, c in x[2].items()) + ") v(d, f, tp, fp, fn)"

book.cases("free_text_skills", "t string, r string", [
    ("Lenguajes: TypeScript, Go; go\n• SQL • CI/CD.| A / B. | C", "TypeScript|Go|SQL|CI/CD|A|B.|C"), ("x" * 61 + ", y - z", "y|z"), ("", ""), (None, ""),
], lambda t: F.array_join(T.skills_of_text(t), "|"))
book.cases("free_text_languages", "t string, r string", [
    ("Inglés: avanzado\nFrancés (B1), Alemán - A2; Ruso", "Inglés=avanzado|Francés=B1|Alemán=A2|Ruso"), ("{end}", ""), (None, ""),
], lambda t: F.array_join(F.transform(T.languages_of_text(t), lambda x: F.concat_ws("=", x["language"], x["fluency"])), "|"))
book.cases("free_text_places", "t string, r string", [("Córdoba, Argentina", "Córdoba"), ("Rosario, Santa Fe, Argentina", "Rosario/Santa Fe"), (" , ", ""), (None, "")], lambda t: F.concat_ws("/", T.location_of_text(t)["city"], T.location_of_text(t)["region"]))
book.cases("free_text_rows", "t string, r string", [(" a\tb \r\n\n c", "ab\nc\n{end}"), (None, "{end}")], T.marked_rows)
book.cases("free_text_dates", "t string, r string", [("2019 – 2021", "2019/2021"), ("Jun 2022 - Present", "2022-06/-"), ("marzo 2020", "2020-03/-"), ("present", "-/-"), ("", "-/-"), (None, "-/-")], lambda t: F.concat_ws("/", *[F.coalesce(T.dates_of_text(t, TODAY)[k], F.lit("-")) for k in ("start", "end")]))
book.cases("free_text_end_dates", "t string, r string", [("2021", "-/2021"), ("2019-2021", "2019/2021")], lambda t: F.concat_ws("/", *[F.coalesce(T.dates_of_text(t, TODAY, "end")[k], F.lit("-")) for k in ("start", "end")]))
