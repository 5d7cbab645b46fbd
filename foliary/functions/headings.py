"""Section headings (CLS10-11): which section a line opens, by native expressions on folded lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.functions.classify import is_job_title, is_organization
from foliary.functions.text import fold

# Fixed values that must equal the reference's for right results.
SECTIONS = {
    "work": (
        "experience", "work experience", "professional experience", "work history", "employment history", "employment", "career", "career history", "professional background", "positions held", "experiencia",
        "experiencia laboral", "experiencia profesional", "experiencia de trabajo", "antecedentes laborales", "antecedentes profesionales", "trayectoria", "trayectoria profesional", "trayectoria laboral",
        "historial laboral", "actividad profesional", "actividad laboral", "actividades profesionales", "funcion publica", "cargos", "cargos ejercidos", "cargos desempenados",
    ),
    "education": ("education", "academic background", "educacion", "formacion", "formacion academica", "estudios", "antecedentes academicos", "titulos", "titulos obtenidos"),
    "skills": ("skills", "technical skills", "habilidades", "aptitudes", "competencias", "conocimientos", "tech stack"),
    "languages": ("languages", "idiomas", "lenguas"),
    "projects": ("projects", "proyectos", "featured projects", "personal projects", "side projects"),
    "certificates": ("certifications", "certificates", "certificaciones", "certificados", "courses", "cursos", "licenses & certifications", "licenses and certifications"),
}
BOUNDARIES = (
    "summary", "profile", "about", "about me", "objective", "perfil", "resumen", "sobre mi", "acerca de mi", "objetivo", "objetivos", "volunteer", "volunteering", "volunteer experience", "voluntariado", "awards", "honors",
    "premios", "reconocimientos", "distinciones", "references", "referencias", "interests", "hobbies", "intereses", "publications", "publicaciones", "contact", "contacto", "datos personales", "personal information",
    "informacion personal", "informacion adicional", "otros datos", "datos de interes",
)
BEFORE = "featured selected key relevant other personal professional technical academic additional recent principales otros otras mis".split()
AFTER = (
    "laboral laborales profesional profesionales academica academicos tecnicas tecnicos personales destacados destacadas relevante relevantes complementaria complementarios obtenidos ejercidos desempenados publica "
    "history summary"
).split()
JOINED = (
    "tools herramientas tecnologias technologies logros achievements actividades activities training capacitacion capacitaciones talleres workshops seminarios congresos menciones otros otras mas more"
).split()
TITLE_CONNECTORS = "de del la las los el y e of and the al".split()
HEADING_WORDS = (
    "datos otros otras antecedentes actividad actividades informacion adicional complementaria complementarios interes anexos docencia cursos formacion cargos funciones varios logros distinciones membresias asociaciones "
    "investigacion becas pasantias practicas capacitacion capacitaciones disponibilidad observaciones herramientas additional information other activities memberships affiliations teaching research grants training "
    "availability miscellaneous background"
).split()


def _one_of(words) -> str:
    return "(?:" + "|".join(sorted(dict.fromkeys(words), key=len, reverse=True)) + ")"


def heading_pattern(words) -> str:
    """A heading of these words, with a modifier before or after and a second heading joined to it."""
    around = lambda ws: rf"(?:{_one_of(BEFORE)}\s+)?{_one_of(ws)}(?:\s+{_one_of(AFTER)})?"
    every = [*[w for ws in SECTIONS.values() for w in ws], *BOUNDARIES, *JOINED]
    return rf"^{around(words)}(?:\s*(?:&|and|y|e|/|,)\s*{around(every)})?$"


PATTERNS = {key: heading_pattern(words) for key, words in SECTIONS.items()}
BOUNDARY = heading_pattern(BOUNDARIES)
INLINE_LANGUAGES = r"^(?:languages|idiomas|lenguas)\s*:\s*\S"
LEAD, TAIL = r"^[^\p{L}\p{N}]+", r"[\s:.\-–—|]+$"


def _line(line: Column) -> Column:
    """Folded and without leading bullets; null if empty or over 60 characters."""
    out = F.trim(F.regexp_replace(fold(F.coalesce(line, F.lit(""))), LEAD, ""))
    return F.when(F.length(out).between(1, 60), out)


def _heading(line: Column) -> Column:
    out = F.regexp_replace(line, TAIL, "")
    return F.when(~out.rlike("[0-9]") & (F.size(F.split(out, " ")) <= 6), out)


def section_keys(line: Column) -> Column:
    """CLS10: the sections that a line opens, in their order; empty for other lines."""
    head = _heading(_line(line))
    return F.filter(F.array(*[F.when(head.rlike(p), F.lit(k)) for k, p in PATTERNS.items()]), lambda k: k.isNotNull())


def names_languages(line: Column) -> Column:
    """A line as "Languages: ..." tells of languages without a heading."""
    return F.coalesce(_line(line).rlike(INLINE_LANGUAGES), F.lit(False))


def is_boundary(line: Column) -> Column:
    """A heading of another section, which ends the one before."""
    return F.coalesce(F.regexp_replace(_line(line), TAIL, "").rlike(BOUNDARY), F.lit(False))


def looks_like_heading(line: Column) -> Column:
    """CLS11: an unknown heading, as 2 to 6 words in capitals or 2 to 4 in title case with a word of headings."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(line, F.lit(""))), LEAD, ""), r"[\s:|]+$", "")
    words = F.split(text, r"\s+")
    plain = F.length(text).between(1, 40) & ~text.rlike(r"[\p{N}.,;()\[\]{}—–|/@\"“”«»]") & F.size(words).between(2, 6)
    lettered = (F.regexp_count(text, F.lit(r"\p{L}")) >= 3) & F.exists(words, lambda w: F.regexp_count(w, F.lit(r"\p{L}")) >= 4)
    cased = F.forall(F.transform(words, lambda w, i: w.rlike(r"^\p{Lu}") | ((i > 0) & w.isin(TITLE_CONNECTORS))), lambda ok: ok)
    named = F.arrays_overlap(F.split(fold(text), " "), F.array(*[F.lit(w) for w in HEADING_WORDS]))
    return plain & lettered & ~is_organization(text) & ~is_job_title(text) & (~text.rlike(r"\p{Ll}") | ((F.size(words) <= 4) & cased & named))
