"""A document in the shapes that the rules ask (STR19), and what it says of places, languages, contacts and sections."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import regex

from foliary.functions import phrases as P
from foliary.functions.headings import BOUNDARY, HEADING_WORDS, INLINE_LANGUAGES, LEAD, PATTERNS, SECTIONS, TAIL, TITLE_CONNECTORS
from foliary.functions.text import _fold

# Fixed values that must equal the reference's for right results.
CITIES = [
    ["buenos aires", "caba", "c.a.b.a.", "capital federal", "ciudad autonoma de buenos aires", "ciudad de buenos aires"], ["mexico city", "ciudad de mexico", "cdmx", "mexico d.f.", "mexico df"],
    ["bogota", "bogota d.c.", "bogota dc", "santa fe de bogota"], ["sao paulo", "san pablo"], ["new york", "new york city", "nyc", "nueva york"], ["london", "londres"],
]
COUNTRIES = {
    "AR": ["argentina"], "BO": ["bolivia"], "BR": ["brasil", "brazil"], "CA": ["canada"], "CL": ["chile"], "CO": ["colombia"], "CR": ["costa rica"], "CU": ["cuba"], "DE": ["germany", "alemania", "alemanha", "deutschland"],
    "DO": ["republica dominicana", "dominican republic"], "EC": ["ecuador"], "ES": ["espana", "spain", "espanha"], "FR": ["france", "francia", "franca"], "GB": ["united kingdom", "reino unido", "england", "inglaterra", "uk"],
    "GT": ["guatemala"], "HN": ["honduras"], "IE": ["ireland", "irlanda"], "IT": ["italy", "italia"], "MX": ["mexico"], "NI": ["nicaragua"], "NL": ["netherlands", "paises bajos", "holanda", "holland"], "PA": ["panama"],
    "PE": ["peru"], "PR": ["puerto rico"], "PT": ["portugal"], "PY": ["paraguay"], "SV": ["el salvador"], "US": ["united states", "estados unidos", "usa", "eeuu", "ee.uu.", "ee. uu."], "UY": ["uruguay"], "VE": ["venezuela"],
}
LANGUAGES = [
    ["english", "ingles", "anglais", "englisch"], ["spanish", "espanol", "castellano", "espanhol", "castilian"], ["portuguese", "portugues"], ["french", "frances", "francais", "franzosisch"],
    ["german", "aleman", "alemao", "deutsch"], ["italian", "italiano"], ["chinese", "mandarin", "mandarin chinese", "chino", "chino mandarin", "chines", "cantonese"], ["japanese", "japones"], ["korean", "coreano"],
    ["russian", "ruso", "russo"], ["arabic", "arabe"], ["hebrew", "hebreo", "hebraico"], ["dutch", "neerlandes", "holandes"], ["catalan", "catala"], ["guarani"], ["quechua"], ["hindi"], ["polish", "polaco"],
]
#: Levels that are read after the name of a language.
LEVELS = (
    "native or bilingual proficiency", "full professional proficiency", "professional working proficiency", "limited working proficiency", "elementary proficiency", "idioma materno",
    "lengua materna", "lingua materna", "lingua nativa", "mother tongue", "native speaker", "upper intermediate", "upper-intermediate", "pre-intermediate", "conversational",
    "conversacional", "intermediario", "intermediate", "intermedio", "intermedia", "principiante", "elementary", "proficient", "bilingual", "bilingue", "avanzado", "avanzada", "avancado",
    "advanced", "elemental", "beginner", "materno", "materna", "nativo", "nativa", "native", "fluent", "fluido", "fluida", "fluente", "basico", "basica", "basic",
)
EXTENSION = r"(?:\s*(?:[,;(]\s*)?(?:int\.?|interno|ext\.?|extension|extensi[oó]n|x)\s*\.?\s*\d{1,6}\)?)"
PHONE = regex.compile(rf"\+?\(?\d[\d\s().\-/]{{4,}}\d{EXTENSION}?", regex.I)
PHONE_EXTENSION = regex.compile(rf"{EXTENSION}\s*$", regex.I)
CITY_PREFIX = regex.compile(r"^\s*(?:ciudad de|city of)\s+", regex.I)

_LEVEL = r"(?:[abc][12]\+?|" + "|".join(sorted((w.replace("-", "[- ]") for w in LEVELS), key=len, reverse=True)) + r")(?![\p{L}\p{N}])"
_AFTER_NAME = regex.compile(rf"^[\s(:\-–—|=]*({_LEVEL}(?:\s*[(\-–—/,]?\s*\(?\s*{_LEVEL}\s*\)?)?)")
_SECTIONS = {k: regex.compile(p) for k, p in PATTERNS.items()}
_digit, _not_ascii_digit, _not_digit = (regex.compile(p) for p in ("[0-9]", "[^0-9]", r"\D"))
_heading_tail, _no_heading, _letter, _lower, _upper = (regex.compile(p) for p in (r"[\s:|]+$", r"[\p{N}.,;()\[\]{}—–|/@\"“”«»]", r"\p{L}", r"\p{Ll}", r"\p{Lu}"))
_line_end, _link_start, _language_cut, _blank = (regex.compile(p) for p in (r"\r?\n", r"\bhttps?://|\bwww\.", r"[(,:\-–/]", r"[\s:\-–—|=]*"))
_boundary, _inline, _lead, _tail = (regex.compile(p) for p in (BOUNDARY, INLINE_LANGUAGES, LEAD, TAIL))


class Span(NamedTuple):
    """DM10: a section, by the line of its heading and the line where it ends."""

    key: str
    heading: str
    start: int
    end: int

    def holds(self, line: int) -> bool:
        return self.start < line < self.end


def main_number(phone: str) -> str:
    """CLN10."""
    out = PHONE_EXTENSION.sub("", phone).strip()
    return out if len(_not_digit.sub("", out)) >= 5 else phone.strip()


def _digits(text: str) -> str:
    return _not_ascii_digit.sub("", text)


@lru_cache(50_000)
def heading_line(line: str) -> bool:
    """CLS11."""
    text = _heading_tail.sub("", _lead.sub("", line.strip()))
    ws = text.split()
    letters = lambda w: len(_letter.findall(w))
    if not 1 <= len(text) <= 40 or _no_heading.search(text) or letters(text) < 3 or not 2 <= len(ws) <= 6 or max(map(letters, ws)) < 4:
        return False
    if P.organization(text) or P.job_title(text):
        return False
    if not _lower.search(text):
        return True
    return len(ws) <= 4 and all(_upper.match(w) or (i and w in TITLE_CONNECTORS) for i, w in enumerate(ws)) and any(P.fold(w) in HEADING_WORDS for w in ws)


@lru_cache(50_000)
def opened(line: str) -> tuple[tuple[str, ...], bool, bool]:
    """CLS10: the sections that a line opens, whether it bounds one, and whether it tells of languages inline."""
    text = _lead.sub("", P.fold(line)).strip()
    if not 1 <= len(text) <= 60:
        return (), False, False
    head = _tail.sub("", text)
    fits = not _digit.search(head) and len(head.split(" ")) <= 6
    return tuple(k for k, p in _SECTIONS.items() if fits and p.search(head)), bool(_boundary.search(head)), bool(_inline.search(text))


def variants(value: str, groups: list[list[str]], cut: str) -> list[str]:
    """CLN14: the folded value, its head, and other names of a known one."""
    own = [v for v in (P.fold(value), regex.split(cut, P.fold(value))[0].strip()) if v]
    return list(dict.fromkeys([*own, *(n for g in groups if not set(g).isdisjoint(own) for n in g)]))


def language_names(value: str) -> list[str]:
    own = [P.fold(value), _language_cut.split(P.fold(value))[0].strip()]
    return next((g for g in LANGUAGES if not set(g).isdisjoint(own)), [v for v in own if v])


def country_name(folded: str) -> bool:
    return any(folded in names for names in COUNTRIES.values())


def place_name(folded: str) -> bool:
    return country_name(folded) or any(folded in g for g in CITIES)


def place_like(folded: str, known: list[str]) -> bool:
    """CLS13: known places, or phrases that end in a country, joined by dots or commas."""
    pieces = [s for s in map(str.strip, regex.split(r"[.,;/]", folded)) if s]
    ends = lambda ws: any(country_name(" ".join(ws[-n:])) for n in range(1, min(3, len(ws) - 1) + 1))
    return bool(pieces) and all(place_name(s) or s in known or ends(s.split(" ")) for s in pieces)


def leading_level(text: str) -> str | None:
    """The language level at the beginning of a text, as written."""
    plain, spots = P.mapped(text)
    m = _AFTER_NAME.match(plain)
    if not m:
        return None
    out = text[spots[m.start(1)][0] : spots[m.end(1) - 1][1]].strip()
    return (out[:-1].strip() if out.endswith(")") and "(" not in out else out) or None


class Evidence:
    """STR19."""

    def __init__(self, text: str):
        self.original, self.raw = text, _line_end.split(text)
        self.text, self.lines = _fold(text), [P.fold(x) for x in self.raw]  # a whole text hardly comes again
        self.compact = self.text.replace(" ", "")
        self.urls = _link_start.sub("", self.text)
        runs = (_digits(s) for m in PHONE.finditer(text) for s in {main_number(m.group()), m.group()})
        self.runs = [r for r in runs if len(r) >= 5]
        self._spans: dict[bool, list[Span]] = {}

    def line(self, i: int) -> str:
        return self.lines[i] if 0 <= i < len(self.lines) else ""

    def has(self, value: str) -> bool:
        return P.has_term(self.text, P.fold(value))

    def naming(self, value: str) -> list[int]:
        """JOI2: the lines where a value is."""
        return [i for i, x in enumerate(self.lines) if P.has_term(x, P.fold(value))]

    def _holds(self, folded: str, text: str) -> bool:
        return bool(folded) and (folded in text or folded.replace(" ", "") in self.compact)

    def url(self, value: str) -> bool:
        return self._holds(regex.sub(r"[/?#]+$", "", regex.sub(r"^www\.", "", regex.sub(r"^[a-z][a-z0-9+.-]*://", "", P.fold(value)))), self.urls)

    def email(self, value: str) -> bool:
        return self._holds(P.fold(value).removeprefix("mailto:"), self.text)

    def handle(self, value: str) -> bool:
        name = P.fold(value).removeprefix("@")
        return name in self.text or name in self.compact

    def phone(self, value: str) -> bool:
        """JOI4, STR11: the last seven digits end a number of the document, or all are in one."""
        own = _digits(main_number(value))
        return bool(own) and any(r.endswith(own[-7:]) or own in r for r in self.runs)

    def place(self, value: str) -> bool:
        return any(P.has_term(self.text, v) for v in variants(value, CITIES, r"[,(]"))

    def place_count(self, value: str) -> int:
        return P.count_term(self.text, P.fold(value)) or max((P.count_term(self.text, v) for v in variants(value, CITIES, r"[,(]")), default=0)

    def country(self, code: str) -> bool:
        code = code.strip().upper()
        return bool(regex.search(rf"(?<![A-Za-z]){regex.escape(code)}(?![A-Za-z])", self.original)) or any(P.has_term(self.text, n) for n in COUNTRIES.get(code, []))

    def recovered_city(self, city: str, *told: str | None) -> str | None:
        """A city of the document among the city without its prefix and the heads of other places told."""
        for c in [CITY_PREFIX.sub("", city).strip(), *(regex.split(r"[,(·|—–]", t)[0].strip() for t in told if t)]:
            folded = P.fold(c)
            if folded and folded != P.fold(city) and not regex.search("[0-9]", folded) and not country_name(folded) and folded not in P.WORK_MODES and self.place(c):
                return c
        return None

    def level(self, language: str, fluency: str) -> tuple[str | None, bool]:
        """(level written after the language's name, whether the fluency is on a line of the language or the next)."""
        names, level = language_names(language), P.fold(fluency)
        others = [n for g in LANGUAGES if set(g).isdisjoint(names) for n in g]
        written, verbatim = None, False
        for i, x in enumerate(self.lines):
            if not any(P.has_term(x, n) for n in names):
                continue
            after = self.line(i + 1)
            after = "" if after and any(P.has_term(after, n) for n in others) else after
            verbatim = verbatim or P.has_term(x, level) or P.has_term(after, level)
            for span in filter(None, (P.find_span(self.raw[i], n) for n in names)) if written is None else ():
                rest = self.raw[i][span[1] :]
                written = leading_level(rest) or (leading_level(self.raw[i + 1]) if after and _blank.fullmatch(rest) else None)
                if written:
                    break
        return written, verbatim

    def sections(self, unknown: bool = False) -> list[Span]:
        """WIN1: the spans from heading to heading; with unknown, lines that merely look like headings end spans too."""
        if unknown in self._spans:
            return self._spans[unknown]
        found = []
        for i, x in enumerate(self.raw):
            keys, bounds, _ = opened(x)
            if keys or bounds or unknown and heading_line(x) and 1 <= len(_lead.sub("", self.lines[i]).strip()) <= 60:
                found.append((keys[0] if keys else "other", _tail.sub("", _lead.sub("", x.strip())), i))
        ends = [*(f[2] for f in found[1:]), len(self.raw)][: len(found)]
        self._spans[unknown] = [Span(*f, end) for f, end in zip(found, ends, strict=True)]
        return self._spans[unknown]

    def headed(self) -> list[str]:
        """The sections with a heading or an inline label, in their usual order."""
        found = [opened(x) for x in self.raw]
        return [k for k in SECTIONS if any(k in keys or (k == "languages" and inline) for keys, _, inline in found)]
