"""What a phrase of a record is, and how a line parts into an organization and a title (CLS6-9, CLS13-14, CLS17, STR2-4).

Plain Python for the rules over whole records; foliary.functions.classify has the same predicates as columns.
"""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

import regex

from foliary.functions import dates
from foliary.functions.degrees import find_degree
from foliary.functions.lexicon import HEADING_PREFIXES, LEGAL_SUFFIX, LEVEL_PHRASES, LEVEL_WORDS, LOW_VALUE_HEADINGS, NAME_CONNECTORS, ORG_WORDS, ROLE_WORDS
from foliary.functions.text import _fold

# Fixed values that must equal the reference's for right results.
DEGREE_WORDS = (
    "master maestria magister licenciatura licenciado licenciada doctorado especializacion tecnico tecnica tecnicatura grado posgrado postgrado diplomado diplomatura bachillerato bachelor bachelors phd degree mba"
).split()
FRAGMENT_LEADERS = "de del la las los el en por para con sin a al y e o u ni que of at for in on by to with and or the &".split()
FRAGMENT_TRAILERS = "de del la las los el en y e o u para con por sin a al of and at for in on by to with the &".split()
WORK_MODES = ["remote", "remoto", "remota", "hybrid", "hibrido", "hibrida", "on-site", "onsite", "presencial", "full-time", "part-time", "tiempo completo", "medio tiempo", "contract", "contractor"]
SELF_EMPLOYED = [
    "freelance", "freelancer", "independiente", "autonomo", "autonoma", "self-employed", "self employed", "cuenta propia", "por cuenta propia", "trabajador independiente", "trabajadora independiente",
]
ACADEMIC_ROLES = "profesora? docente investigadora? becari[oa] ayudante catedratic[oa] teacher lecturer researcher instructor tutora?".split()
LINE_PARTS = regex.compile(r"\s*(?:[—–|·•()[\],;\t]|\s-\s|\s-$|^-\s)\s*")
ORG_TITLE_SEPARATOR = regex.compile(r"\s*(?:[—–|·,]|\s-|-\s)\s*")
ORG_TITLE_JOIN = regex.compile(r"\s*[—–|·]\s*|\s+-\s+")
LINKS = regex.compile(r"\s+(?:de la|de los|de las|del|en|at|@)\s+", regex.I)
PROSE_LINKS = regex.compile(r"\s+(?:en(?:\s+(?:el|la|los|las))?|de(?:\s+(?:la|los|las))?|del|para(?:\s+(?:el|la|los|las))?|at|@|with)\s+", regex.I)
LOWERCASE_ARTICLE = regex.compile(r"^(?:el|la|los|las)\s+(?=\p{L})")
ACRONYM = regex.compile(r"^[\p{Lu}.&]{2,8}$")
WORD_BREAKS, NUMBERS = regex.compile(r"[\s,./()·|—–-]+"), regex.compile(r"\p{N}")

#: Only whether a phrase reads as a date matters here, so any day does.
SOME_DAY = dt.date(2026, 1, 1)

fold = lru_cache(100_000)(_fold)
_legal = regex.compile(LEGAL_SUFFIX)
_orgs, _roles = frozenset(ORG_WORDS), frozenset(ROLE_WORDS)


def said(value: object) -> str | None:
    """A text with more than blanks, else null."""
    return value if isinstance(value, str) and value.strip() else None


def words(folded: str) -> list[str]:
    return WORD_BREAKS.split(folded)


def legal_suffix(text: str) -> bool:
    return bool(_legal.search(fold(text)))


def organization(text: str) -> bool:
    return legal_suffix(text) or not _orgs.isdisjoint(words(fold(text)))


def job_title(text: str) -> bool:
    folded = fold(text)
    return bool(folded) and not NUMBERS.search(folded) and not organization(text) and not _roles.isdisjoint(words(folded))


def starts_with_role(text: str) -> bool:
    return words(fold(text))[0] in ROLE_WORDS


def title_case(text: str, least: int = 2) -> bool:
    capital = [bool(regex.match(r"[^\p{L}\p{N}]*\p{Lu}", w)) for w in text.split()]
    return sum(capital) >= least and all(c or w.lower() in NAME_CONNECTORS for c, w in zip(capital, text.split(), strict=True))


def degree_phrase(text: str) -> bool:
    """A bare degree word with one more word at most; a lone word that is a role too is none."""
    parts = words(regex.sub(r"'s\b", "s", fold(text)))
    return 1 <= len(parts) <= 2 and parts[0] in DEGREE_WORDS and (len(parts) == 2 or parts[0] not in ROLE_WORDS)


def employer_like(after: str, link: str, before: str) -> bool:
    """What may follow "title <link>": after a bare "de", which joins departments too, only a clear organization."""
    if not regex.search(r"\p{L}", after) or job_title(after):
        return False
    if link in ("de", "del"):
        return legal_suffix(after) or (organization(after) and min(len(after.split()), len(before.split())) >= 2)
    return organization(after) or title_case(after, 1 if link in ("at", "@", "with") else 2)


_academic = regex.compile(rf"(?:{'|'.join(ACADEMIC_ROLES)})(?![\p{{L}}\p{{N}}])")


def job_position(position: str | None) -> bool:
    """CLS14: a job, not a degree; an academic role is a job though its name holds a degree."""
    if not position or not job_title(position):
        return False
    return bool(_academic.match(fold(position))) or find_degree(position) is None


def title_like(name: str, headline: str | None) -> bool:
    """CLS17."""
    return job_title(name) or bool(headline) and not organization(name) and has_term(fold(name), fold(headline))


_low = regex.compile(rf"(?:(?:{'|'.join(HEADING_PREFIXES)})\s+)?(?:{'|'.join(sorted(LOW_VALUE_HEADINGS, key=len, reverse=True))})(?:\s+\p{{L}}+){{0,3}}")


def low_value(heading: str) -> bool:
    """CLS12."""
    line = regex.sub(r"^(?:\d+(?:\.\d+)*|[ivx]+)[.)]?\s+", "", regex.sub(r"^[^\p{L}\p{N}]+", "", fold(heading)))
    line = regex.sub(r"[\s:.\-–—|]+$", "", line)
    return 1 <= len(line) <= 60 and bool(_low.fullmatch(line))


_level_marks, _level_code = regex.compile(r"[()\[\].,;:/\\|-]+"), regex.compile(r"(?<![\p{L}\p{N}])[abc][12]\+?(?![\p{L}\p{N}])")


def language_level(text: str) -> bool:
    """CLS9."""
    line = _level_marks.sub(" ", fold(text)).strip()
    if not line or len(line.split()) > 4:
        return False
    return bool(_level_code.search(line)) or any(has_term(line, w) for w in (*LEVEL_PHRASES, *LEVEL_WORDS))


@lru_cache(20_000)
def term(folded: str) -> regex.Pattern | None:
    """JOI1: a folded term on token borders; separators between letters or digits are optional and interchangeable."""
    if not folded:
        return None
    pieces = regex.split(r"(?<=[\p{L}\p{N}])[ ._/-]+(?=[\p{L}\p{N}])", folded)
    body = r"(?:\s?[._/-]?\s?)".join(regex.escape(p, special_only=True, literal_spaces=True) for p in pieces)
    alnum = lambda c: bool(regex.match(r"[\p{L}\p{N}]", c))
    head = r"(?<![\p{L}\p{N}])(?<![\p{L}\p{N}][.])" if alnum(folded[0]) else ""
    return regex.compile(head + body + r"(?![\p{L}\p{N}+#])" + (r"(?![.][\p{L}\p{N}])" if alnum(folded[-1]) else ""))


def has_term(folded: str, wanted: str) -> bool:
    if wanted.isalpha() and wanted not in folded:  # letters alone are their own pattern, but for the borders
        return False
    pattern = term(wanted)
    return bool(pattern and pattern.search(folded))


def count_term(folded: str, wanted: str) -> int:
    pattern = term(wanted)
    return sum(1 for _ in pattern.finditer(folded)) if pattern else 0


def mapped(text: str) -> tuple[str, list[tuple[int, int]]]:
    """STR18: the folded text and where each of its characters stands in the original."""
    out: list[tuple[str, tuple[int, int]]] = []
    for at, c in enumerate(text):
        if not c.isspace():
            out += [(f, (at, at + 1)) for f in fold(c)]
        elif out and out[-1][0] != " ":
            out.append((" ", (at, at + 1)))
    if out and out[-1][0] == " ":
        out.pop()
    return "".join(c for c, _ in out), [s for _, s in out]


def find_span(text: str, folded: str) -> tuple[int, int] | None:
    """Where a folded term stands in the text as written."""
    plain, spots = mapped(text)
    pattern = term(folded)
    m = pattern.search(plain) if pattern else None
    return (spots[m.start()][0], spots[m.end() - 1][1]) if m and m.group() else None


def parts(text: str) -> list[str]:
    """STR4."""
    return [p for p in map(str.strip, LINE_PARTS.split(text)) if p]


def sentence_parts(text: str) -> list[str]:
    """STR4: at periods after words of three letters too."""
    return [p for s in regex.split(r"(?<=\p{L}{3})\.(?:\s+|$)", text) for p in parts(s)]


def plausible(part: str) -> bool:
    """CLS13: what can stand as a title or an employer, and isn't a cut piece of one, a label or a sentence's end."""
    text = part.strip()
    tokens = text.split()
    if not 3 <= len(text) <= 120 or regex.match(r"[\p{P}\p{S}]", text) or text.endswith(":"):
        return False
    if not any(regex.match(r"\p{L}", t) for t in tokens) or fold(tokens[0]) in FRAGMENT_LEADERS or fold(tokens[-1]).rstrip(".,;:") in FRAGMENT_TRAILERS:
        return False
    return not regex.search(r"\p{L}{4,}\.$", text) or organization(text)


def date_like(part: str) -> bool:
    """An ongoing marker or the bare name of a month."""
    return dates.normalize(part, SOME_DAY)["current"] or (dates.normalize(f"{part} 2000", SOME_DAY)["value"] or "").startswith("2000-")


def weak_institution(value: str | None) -> bool:
    """A single word that is neither an acronym nor an organization's."""
    return value is None or not (regex.search(r"\s", value.strip()) or ACRONYM.match(value.strip()) or organization(value))


def _sides(text: str, pattern: regex.Pattern):
    """(before, separator, after) at each match with something on both sides."""
    for m in pattern.finditer(text):
        before, after = text[: m.start()].strip(), text[m.end() :].strip()
        if before and after:
            yield before, " ".join(m.group().lower().split()), after


def strip_title(org: str, title: str) -> str | None:
    """STR2: the organization without a title at its start or end."""
    target = fold(title)
    for before, _, after in _sides(org, ORG_TITLE_SEPARATOR) if target else ():
        if target in (fold(after), fold(before)):
            return before if fold(after) == target else after
    return None


def split_joined(text: str) -> tuple[str, str] | None:
    """STR2: (organization, title) at the first dash, bar or dot."""
    m = ORG_TITLE_JOIN.search(text)
    got = (text[: m.start()].strip(), text[m.end() :].strip()) if m else ("", "")
    return got if all(got) else None


def split_by_title(text: str) -> tuple[str, str] | None:
    """STR2: (organization, title) where just one side reads as a title; a role at the start decides between two."""
    for before, mark, after in _sides(text, ORG_TITLE_SEPARATOR):
        tests = (job_title(before), job_title(after))
        if all(tests):
            tests = (starts_with_role(before), starts_with_role(after))
        if tests[0] == tests[1]:
            continue
        org, title = (after, before) if tests[0] else (before, after)
        if mark != "," or organization(org):
            return org, title
    return None


def split_phrase(phrase: str, title: str | None = None) -> tuple[str, str] | None:
    """STR3: (organization, title) of "title en employer". A known title must start it; else the last fit wins."""
    target = fold(title) if title else None
    for before, link, after in _sides(phrase, LINKS) if target is not None else ():
        after = LOWERCASE_ARTICLE.sub("", after)
        if fold(before) == target and not degree_phrase(before) and employer_like(after, link, before):
            return after, before
    fits = [
        (after, before)
        for before, link, after in _sides(phrase, PROSE_LINKS)
        if (target is None or f"{fold(before)} ".startswith(f"{target} ")) and not degree_phrase(before) and job_title(before) and employer_like(after, link, before)
    ]
    return fits[-1] if fits else None
