"""Scalar text functions. Unicode folds are Arrow UDFs, for Spark has no normalize; the rest are column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.functions.lexicon import CITY_ALIASES, COUNTRY_CODES, ENTITY_STOPWORDS, LANGUAGE_NAMES, LIGATURES

_marks = re.compile(r"[̀-ͯ]")
_space = re.compile(r"\s+")


def series_udf(one: Callable[[str], object], kind: str = "string") -> Callable[..., Column]:
    """An Arrow UDF that maps each text but null; it is made when used, for workers import this module too."""

    def apply(col: Column | str) -> Column:
        return F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else one(t)), kind)(col)

    apply.__doc__ = one.__doc__
    return apply


def _strip(text: str, form: str = "NFD") -> str:
    text = unicodedata.normalize(form, text)
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", text)
    for mark in [c for c in set(text) if unicodedata.category(c).startswith("M")]:
        text = text.replace(mark, "")
    return text


def _fold(t: str) -> str:
    """CLN2: compatibility form, no marks, lower case, single spaces."""
    return _space.sub(" ", _strip(t, "NFKC").lower()).strip()


def _unaccent(t: str) -> str:
    """Canonical decomposition without combining marks, in lower case."""
    return (t if t.isascii() else _marks.sub("", unicodedata.normalize("NFD", t))).lower()


def _clean(t: str) -> str:
    """CLN1: dotless i with a mark to i, ligatures spelled out, no-break spaces to spaces, composed form."""
    t = re.sub("ı(?=[̀-ͯ])", "i", t)
    for a, b in LIGATURES.items():
        t = t.replace(a, b)
    return unicodedata.normalize("NFC", re.sub("[\u00a0\u202f\u2007]", " ", t))


PYTHON_SPACE = r"[\x09-\x0D\x1C-\x20]+"


def _folding(native: Callable[[Column], Column], slow: Callable[[str], str]) -> Callable[[Column | str], Column]:
    """native for ASCII texts; an Arrow UDF gets the others alone."""
    rest = series_udf(slow)

    def apply(col: Column | str) -> Column:
        col = F.col(col) if isinstance(col, str) else col
        plain = F.octet_length(col) == F.char_length(col)
        return F.when(plain, native(col)).otherwise(rest(F.when(~plain, col)))

    apply.__doc__ = slow.__doc__
    return apply


fold = _folding(lambda c: F.trim(F.regexp_replace(F.lower(c), PYTHON_SPACE, " ")), _fold)
unaccent = _folding(F.lower, _unaccent)
clean_extracted = series_udf(_clean)


def score_text(text: Column, keep: str = "") -> Column:
    """CLN6: unaccented, punctuation but the kept to spaces, single spaces. Null is empty."""
    kept = "".join(f"\\{c}" for c in keep)
    out = F.regexp_replace(unaccent(F.coalesce(text, F.lit(""))), f"[^\\p{{L}}\\p{{N}}\\s{kept}]", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def token_set(text: Column, stop: tuple[str, ...] | list[str] = ()) -> Column:
    """CLN7: the distinct words of a scored text but the stop words."""
    words = F.array_distinct(F.filter(F.split(score_text(text), " "), lambda w: w != ""))
    return F.array_except(words, F.array(*[F.lit(w) for w in stop])) if stop else words


def entity_tokens(text: Column) -> Column:
    return token_set(text, ENTITY_STOPWORDS)


def jaccard(a: Column, b: Column) -> Column:
    """AGG10: two empty sets are not alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_estimate(text: Column) -> Column:
    """STR10."""
    return F.ceil(F.length(text) / F.lit(3.3)).cast("long")


def normalize_email(text: Column) -> Column:
    """CLN8."""
    return F.replace(score_text(text, "@.+_-"), F.lit(" "), F.lit(""))


def normalize_skill(text: Column) -> Column:
    """CLN8: keeps + # and inner dots."""
    return F.trim(F.regexp_replace(score_text(text, "+#."), r"^\.+|\.+$", ""))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def strip_extension(phone: Column) -> Column:
    """CLN10: the number without a written extension, unless under 5 digits would stay."""
    pattern = r"(?iu)\s*(?:[,;(]\s*)?(?:int\.?|interno|ext\.?|extension|extensi[oó]n|x)\s*\.?\s*\d{1,6}\)?\s*$"
    main = F.trim(F.regexp_replace(phone, pattern, ""))
    return F.when(F.length(digits(main)) >= 5, main).otherwise(F.trim(phone))


def phone_parts(phone: Column) -> Column:
    """CLN11: struct of calling code and national digits without trunk zeros."""
    raw = digits(F.trim(phone))
    plus, zeros = F.startswith(F.trim(phone), F.lit("+")), F.startswith(raw, F.lit("00"))
    number = F.when(~plus & zeros, F.substr(raw, F.lit(3))).otherwise(raw)
    longest = sorted(COUNTRY_CODES, key=len, reverse=True)
    code = F.when(plus | zeros, F.coalesce(*[F.when(F.startswith(number, F.lit(c)), F.lit(c)) for c in longest], F.lit(""))).otherwise(F.lit(""))
    national = F.regexp_replace(F.substr(number, F.length(code) + 1), "^0+", "")
    return F.struct(code.alias("country"), national.alias("national"))


def split_phones(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[/,;|]"), lambda p: strip_extension(F.trim(p)))
    return F.filter(parts, lambda p: F.length(digits(p)) >= 6)


def phones_match(a: Column, b: Column) -> Column:
    """STR21: the best pair decides; codes must agree where both have one, else the last 8 digits where one has."""

    def same(x: Column, y: Column) -> Column:
        both, any_ = (x["country"] != "") & (y["country"] != ""), (x["country"] != "") | (y["country"] != "")
        return F.when(both, (x["country"] == y["country"]) & (x["national"] == y["national"])).when(any_, F.right(x["national"], F.lit(8)) == F.right(y["national"], F.lit(8))).otherwise(x["national"] == y["national"])

    xs, ys = F.transform(split_phones(a), phone_parts), F.transform(split_phones(b), phone_parts)
    return F.exists(xs, lambda x: F.exists(ys, lambda y: same(x, y)))


def strip_url(url: Column) -> Column:
    """CLN9."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^(?:https?://)?(?:www\.)?", ""), r"[/?#]+$", "")


def normalize_city(text: Column) -> Column:
    """CLN12: aliases, the longest first, on word borders."""
    out = F.concat(F.lit(" "), score_text(text), F.lit(" "))
    for alias in sorted(CITY_ALIASES, key=len, reverse=True):
        out = F.replace(out, F.lit(f" {alias} "), F.lit(f" {CITY_ALIASES[alias]} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def city_matches(truth: Column, predicted: Column) -> Column:
    """STR22: every word of the truth is predicted."""
    words = lambda c: F.filter(F.split(normalize_city(c), " "), lambda w: w != "")
    return (F.size(words(truth)) > 0) & (F.size(F.array_except(words(truth), words(predicted))) == 0)


def language_code(text: Column) -> Column:
    """CLN13: the code of the first language name, else the scored text."""
    names = {w: code for code, words in LANGUAGE_NAMES.items() for w in words.split()}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    scored = score_text(text)
    known = F.filter(F.transform(F.split(scored, " "), lambda w: F.element_at(table, w)), lambda c: c.isNotNull())
    return F.when(scored.isin(list(LANGUAGE_NAMES)), scored).otherwise(F.coalesce(F.get(known, 0), scored))


def contains_term(text: Column, term: Column) -> Column:
    """JOI1: a folded term in folded text on word borders, with spaces, hyphens and the like interchangeable."""
    safe = F.regexp_replace(term, r"([\\\[\]{}()*+?.^$|])", r"\\$1")
    return F.regexp(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.regexp_replace(safe, r"[\s\-_/]+", r"[\\s\\-_/]+"), F.lit(r"(?![\p{L}\p{N}])")))


def split_list(text: Column) -> Column:
    """STR1: at semicolons, and commas before a space, outside of brackets."""
    parts = F.transform(F.split(text, r"(?:;|,(?=\s))(?![^(\[]*[)\]])"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def dehyphenate(text: Column) -> Column:
    """STR5."""
    return F.regexp_replace(text, r"(\p{L}{3,})[-‐]\n(\p{Ll}{3,})", "$1$2")


def slug(text: Column) -> Column:
    """PRJ14."""
    return F.regexp_replace(F.regexp_replace(unaccent(text), "[^a-z0-9.]+", "-"), "^-+|-+$", "")


def readable_note(text: Column) -> Column:
    """PRJ3: 8 characters and a run of 3 letters at least, and not a string of hex codes."""
    t = F.trim(text)
    words = F.split(t, r"\s+")
    hexy = lambda w: w.rlike("^[0-9a-fA-F]+$") & w.rlike("[0-9]")
    lone = (F.size(words) > 1) | ((F.regexp_count(t, F.lit(r"\p{L}")) >= 0.6 * F.length(t)) & ~t.rlike("^[0-9a-fA-F]+$"))
    return (F.length(t) >= 8) & t.rlike(r"\p{L}{3}") & ~F.forall(words, hexy) & lone


def fnv1a(text: Column) -> Column:
    """STR12: 32-bit FNV-1a over UTF-16 code units of the basic plane."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
