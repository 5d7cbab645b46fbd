"""The level of a degree by its title (CLS1-3)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results: ranks, neutral phrases, and rules (kind, label, pattern) in their order.
RANKS = {"doctorate": 70, "master": 60, "postgraduate": 50, "bachelor": 40, "technical": 30, "secondary": 20, "course": 10, "profession": 5}
NEUTRAL = (
    r"\ben curso\b",
    r"\bcursando\b",
    r"\bcurso (?:\d|hasta\b)",
    r"\bgrado academico\b",
    r"\bem curso\b",
    r"\bin progress\b",
    r"\bon-?going\b",
    r"\bun-?finished\b",
    r"\bnot (?:completed|finished)\b",
    r"\bincomplet[eoa]s?\b",
    r"\bem andamento\b",
    r"\btrancad[oa]\b",
)
RULES = (
    ("postgraduate", "Posgrado", r"\bpost-?graduate (?:certificate|diploma)\b"),
    ("postgraduate", "Posgrado", r"\bgraduate (?:certificate|diploma)\b"),
    ("postgraduate", "Posgrado", r"\bdiplomad[oa] (?:de|en) pos-?t?-?grado\b"),
    ("postgraduate", "Posgrado", r"\bdiploma (?:de|en) pos-?t?-?grado\b"),
    ("postgraduate", "Posgrado", r"\bcertificad[oa] (?:de|en) pos-?t?-?grado\b"),
    ("bachelor", "Diplomatura", r"\bdiplomad[oa] universitari[oa]\b"),
    ("bachelor", "Ingeniería", r"\bingenier[oa] tecnic[oa]\b"),
    ("bachelor", "Ingeniería", r"\bingenieria tecnica\b"),
    ("bachelor", "Arquitectura", r"\barquitect[oa] tecnic[oa]\b"),
    ("secondary", "Bachillerato", r"\bbachiller(?:ato)? tecnic[oa]\b"),
    ("secondary", "Secundario", r"\bsecundari[oa] tecnic[oa]\b"),
    ("secondary", "Educación Media", r"\b(?:educacion|ensenanza) media tecnica\b"),
    ("secondary", "Educación Media", r"\bensino medio tecnico\b"),
    ("secondary", "Preparatoria", r"\bmedia superior\b"),
    ("secondary", "Secundario", r"\btechnical (?:high|secondary) ?school\b"),
    ("secondary", "Secundario", r"\bvocational (?:high|secondary) ?school\b"),
    ("technical", "Técnico", r"\bcurso tecnico\b"),
    ("technical", "Tecnólogo", r"\bcurso superior de tecnologia\b"),
    ("technical", "Técnico", r"\btechnical (?:degree|diploma|certificate|school|college|program(?:me)?|studies)\b"),
    ("technical", "Formación Profesional", r"\bvocational (?:degree|diploma|certificate|training|school|college|program(?:me)?)\b"),
    ("bachelor", "Ingeniería", r"\bbachelor(?:'?s)?(?: degree)? (?:of|in) engineering\b"),
    ("technical", "Técnico", r"\bmaestr[oa] mayor de obras?\b"),
    ("doctorate", "Doctorado", r"\bdoctorad[oa]\b"),
    ("doctorate", "Doctorado", r"\bdoctoral\b"),
    ("doctorate", "Doctorado", r"\bdoctorates?\b"),
    ("doctorate", "Doctorado", r"\bdoctora?\b"),
    ("doctorate", "Doctorado", r"\bdoutorad[oa]\b"),
    ("doctorate", "Doctorado", r"\bdoutora?\b"),
    ("doctorate", "Doctorado", r"\bph\.?\s?d\.?"),
    ("doctorate", "Doctorado", r"\bd\.?phil\b"),
    ("master", "MBA", r"\b(?:executive )?mba\b"),
    ("master", "MBA", r"\bemba\b"),
    ("master", "MBA", r"\bmaster (?:of|in) business administration\b"),
    ("master", "Maestría", r"\bmaestria\b"),
    ("master", "Maestría", r"\bmaestro\b"),
    ("master", "Maestría", r"\bmagister\b"),
    ("master", "Maestría", r"\bmg(?:tr|r)?\.?(?=\s|$)"),
    ("master", "Maestría", r"\bmestrad[oa]\b"),
    ("master", "Maestría", r"\bmestre\b"),
    ("master", "Máster", r"\bmasters?(?:'s)?\b"),
    ("master", "Máster", r"\bm\.?(?:sc|eng|phil|fa|res|tech|ed)\.?(?=[\s(,;:/-]|$)"),
    ("master", "Máster", r"\bm\.?[as]\.?(?=\s+(?:in|of|en)\b|\s*\(|\s*$)"),
    ("master", "Máster", r"\bll\.?m\.?(?=[\s(,;:/-]|$)"),
    ("postgraduate", "Especialización", r"\bespecializacion\b"),
    ("postgraduate", "Especialización", r"\bespecializacao\b"),
    ("postgraduate", "Especialización", r"\bespecialista\b"),
    ("postgraduate", "Especialización", r"\bspeciali[sz]ation\b"),
    ("postgraduate", "Especialización", r"\besp\.(?=\s|$)"),
    ("postgraduate", "Especialización", r"\blato sensu\b"),
    ("postgraduate", "Posgrado", r"\bpos-?t?-?\s?grado\b"),
    ("postgraduate", "Posgrado", r"\bpos-?\s?graduacao\b"),
    ("postgraduate", "Posgrado", r"\bpost-?graduate\b"),
    ("technical", "Formación Profesional", r"\bciclo formativo\b"),
    ("technical", "Formación Profesional", r"\bgrado (?:superior|medio)\b"),
    ("technical", "Formación Profesional", r"\bformacion profesional\b"),
    ("technical", "Formación Profesional", r"\bfp\b"),
    ("technical", "Técnico Superior", r"\btecnic[oa] superior\b"),
    ("technical", "Técnico Superior", r"\btsu\b"),
    ("technical", "Tecnicatura", r"\btecnic[oa] universitari[oa]\b"),
    ("technical", "Técnico", r"\btecnic[oa] profesional\b"),
    ("technical", "Tecnicatura", r"\btecnicatura\b"),
    ("technical", "Técnico", r"\btecnic[oa]s?\b"),
    ("technical", "Técnico", r"\btec\.(?=\s|$)"),
    ("technical", "Tecnólogo", r"\btecnolog[oa]\b"),
    ("technical", "Terciario", r"\bterciari[oa]\b"),
    ("technical", "Analista", r"\banalista\b"),
    ("technical", "Tecnicatura", r"\bassociate(?:'?s)? (?:degree|of)\b"),
    ("technical", "Tecnicatura", r"\bassociate(?:'?s)?\b"),
    ("technical", "Tecnicatura", r"\ba\.?a\.?s\.?(?=[\s(,;:/-]|$)"),
    ("technical", "Técnico", r"\btechnicians?\b"),
    ("technical", "Tecnólogo", r"\btechnologists?\b"),
    ("bachelor", "Licenciatura", r"\blicenciatura\b"),
    ("bachelor", "Licenciatura", r"\blicenciad[oa]\b"),
    ("bachelor", "Licenciatura", r"\blic\.?(?=\s|$)"),
    ("bachelor", "Grado", r"\bgrado\b"),
    ("bachelor", "Grado", r"\bgraduad[oa]\b"),
    ("bachelor", "Pregrado", r"\bpre-?grado\b"),
    ("bachelor", "Profesorado", r"\bprofesorado\b"),
    ("bachelor", "Diplomatura", r"\bdiplomatura\b"),
    ("bachelor", "Profesional", r"\bprofesional\b"),
    ("bachelor", "Licenciatura", r"\bbachelors?(?:'s)?\b"),
    ("bachelor", "Grado", r"\bundergraduate\b"),
    ("bachelor", "Grado", r"\bgraduacao\b"),
    ("bachelor", "Grado", r"\bensino superior\b"),
    ("bachelor", "Licenciatura", r"\bbacharel(?:ado)?\b"),
    ("bachelor", "Ingeniería", r"\bb\.?eng\.?(?=[\s(,;:/-]|$)"),
    ("bachelor", "Licenciatura", r"\bb\.?(?:sc|ba|fa|com|tech|ed)\.?(?=[\s(,;:/-]|$)"),
    ("bachelor", "Licenciatura", r"\bb\.?[as]\.?(?=\s+(?:in|of|en)\b|\s*\(|\s*$)"),
    ("bachelor", "Abogacía", r"\bll\.?b\.?(?=[\s(,;:/-]|$)"),
    ("profession", "Ingeniería", r"\bingenier(?:ia|[oa])\b"),
    ("profession", "Ingeniería", r"\bing\.?(?=\s|$)"),
    ("profession", "Ingeniería", r"\bengenh(?:aria|eir[oa])\b"),
    ("profession", "Ingeniería", r"\bengineer(?:ing|s)?\b"),
    ("profession", "Contador Público", r"\bcontador(?:a)? public[oa]\b"),
    ("profession", "Contador Público", r"\bcontaduria\b"),
    ("profession", "Contador Público", r"\bc\.?p\.?n?\.?(?=\s+en\b|\s*$)"),
    ("profession", "Abogacía", r"\babogacia\b"),
    ("profession", "Abogacía", r"\babogad[oa]\b"),
    ("profession", "Abogacía", r"\babog\.(?=\s|$)"),
    ("profession", "Arquitectura", r"\barquitect(?:ura|[oa])\b"),
    ("profession", "Arquitectura", r"\barq\.(?=\s|$)"),
    ("profession", "Medicina", r"\bmedicina\b"),
    ("profession", "Medicina", r"\bmedic[oa] cirujan[oa]\b"),
    ("secondary", "Bachillerato", r"\bbachiller(?:ato)?\b"),
    ("secondary", "Secundario", r"\bsecundari[oa]\b"),
    ("secondary", "Educación Media", r"\b(?:educacion|ensenanza|ensino) medi[oa]\b"),
    ("secondary", "Preparatoria", r"\bpreparatoria\b"),
    ("secondary", "Preparatoria", r"\bprepa\b"),
    ("secondary", "ESO", r"\beso\b"),
    ("secondary", "Secundario", r"\bpolimodal\b"),
    ("secondary", "Secundario", r"\bhigh ?school\b"),
    ("secondary", "Secundario", r"\bsecondary (?:school|education)\b"),
    ("short course", "Bootcamp", r"\bbootcamp\b"),
    ("short course", "Curso", r"\bcursos?\b"),
    ("short course", "Curso", r"\bcourse\b"),
    ("short course", "Certificación", r"\bcertificad[oa]\b"),
    ("short course", "Certificación", r"\bcertificacion\b"),
    ("short course", "Certificación", r"\bcertifica(?:te|tion|ted)\b"),
    ("short course", "Taller", r"\btaller(?:es)?\b"),
    ("short course", "Taller", r"\bworkshop\b"),
    ("short course", "Seminario", r"\bseminario\b"),
    ("short course", "Curso", r"\bcapacitacion\b"),
    ("short course", "Curso", r"\bnanodegree\b"),
    ("course", "Diplomado", r"\bdiplomad[oa]\b"),
    ("course", "Diplomado", r"\bdiploma\b"),
)


class Degree(NamedTuple):
    level: str
    canonical: str | None
    start: int


_neutral = [re.compile(p, re.ASCII) for p in NEUTRAL]
_rules = [(kind, label, re.compile(p, re.ASCII)) for kind, label, p in RULES]
#: A short course wins over every other title, and a profession tells of a bachelor's degree.
LEVEL_OF = {"profession": "bachelor", "short course": "course"}


@lru_cache(20_000)
def find_degree(title: str) -> Degree | None:
    """CLS1: every rule takes its words away from the rules after it; the highest rank wins, then the leftmost place."""
    left = re.sub(r"\s+", " ", re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", title)).lower()).strip()
    for p in _neutral:
        left = p.sub(lambda m: " " * len(m[0]), left)
    best = None
    for kind, label, p in _rules:
        if (first := p.search(left)) is None:
            continue
        standing = (1000 if kind == "short course" else RANKS[kind], -first.start())
        if best is None or standing > best[0]:
            best = standing, Degree(LEVEL_OF.get(kind, kind), label, first.start())
        left = p.sub(lambda m: " " * len(m[0]), left)
    return best[1] if best else None


def study_level(study: str | None, area: str | None) -> tuple[str, str | None, str | None]:
    """CLS2: (level, canonical, original). An area counts if there is no title, and only by a title it starts with."""
    study, area = ((x or "").strip() for x in (study, area))
    got = find_degree(study or area) if study or area else None
    if got is None or (not study and got.start):
        return "unknown", None, study or None
    return got.level, got.canonical, study or None


def degree_level(study: Column, area: Column) -> Column:
    """CLS1-2 as a struct of level, canonical and original."""

    def run(studies: pd.Series, areas: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([study_level(s, a) for s, a in zip(studies, areas, strict=True)], columns=["level", "canonical", "original"])

    return F.pandas_udf(run, "level string, canonical string, original string")(study, area)
