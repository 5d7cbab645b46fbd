"""Writing what the readers read: date ranges, seeded draws, stable JSON, schemas, marked sections of a report."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, IntegralType, MapType, StructType

# Fixed values that must equal the reference's for right results.
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
SHORT_MONTHS = "ene feb mar abr may jun jul ago sep oct nov dic".split()
LINE_WIDTH = 100


def written_range(style: Column, y1: Column, m1: Column, y2: Column, m2: Column) -> Column:
    """DAT14: a range of months in one of the styles month-name, mm-yyyy, abbr-dot, abbr-cap, two-digit, a-la-fecha and
    year-range; a null end is ongoing. Two digits are only written where they can't be read as a month."""
    pick = lambda names, m: F.element_at(F.array(*[F.lit(x) for x in names]), m)
    year = lambda y: y.cast("string")

    def month(y: Column, m: Column) -> Column:
        name = F.when(style == "month-name", pick(MONTHS, m)).when(style == "abbr-dot", F.concat(pick(SHORT_MONTHS, m), F.lit("."))).otherwise(F.initcap(pick(SHORT_MONTHS, m)))
        return F.when(style == "mm-yyyy", F.concat(F.lpad(m.cast("string"), 2, "0"), F.lit("/"), year(y))).otherwise(F.concat(name, F.lit(" "), year(y)))

    now = F.when(style == "abbr-cap", "Presente").when(style == "mm-yyyy", "Actualidad").otherwise("actualidad")
    months = F.concat(month(y1, m1), F.when(style == "mm-yyyy", " - ").otherwise(" – "), F.when(y2.isNull(), now).otherwise(month(y2, m2)))
    digits = (style == "two-digit") & (F.floor(y1 / 100) == F.floor(y2 / 100)) & (y2 > y1) & (y2 % 100 > 12)
    years = (
        F.when(y2.isNull(), F.concat(year(y1), F.when(style == "a-la-fecha", " a la fecha").otherwise(" – presente")))
        .when(digits, F.concat(year(y1), F.lit("-"), F.lpad((y2 % 100).cast("string"), 2, "0")))
        .otherwise(F.concat(year(y1), F.when(style == "a-la-fecha", " a ").otherwise(" – "), year(y2)))
    )
    return F.when(style.isin("month-name", "mm-yyyy", "abbr-dot", "abbr-cap"), months).otherwise(years)


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _times(x: Column, y: Column) -> Column:
    """The low 32 bits of a product of two numbers of 32 bits, without overflow."""
    half = F.lit(0xFFFF).cast("long")
    return _low(x.bitwiseAND(half) * y + F.shiftleft((F.shiftright(x, 16) * y).bitwiseAND(half), 16))


def _odd(x: Column, bits: int) -> Column:
    return x.bitwiseOR(F.lit(bits).cast("long"))


#: The generator mulberry32, from a state to a number from 0 to 1. Each step takes its argument several times over.
_STEPS = (
    lambda a: _times(a.bitwiseXOR(F.shiftright(a, 15)), _odd(a, 1)),
    lambda t: t.bitwiseXOR(_low(t + _times(t.bitwiseXOR(F.shiftright(t, 7)), _odd(t, 61)))),
    lambda t: t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(2.0**32),
)


def draw(seed: Column, nth: int = 0) -> Column:
    """STR12: the nth number from 0 to 1 of the 32-bit generator mulberry32 with this seed."""
    out = _low(seed.cast("long") + F.lit((nth + 1) * 0x6D2B79F5).cast("long"))
    for step in _STEPS:
        out = step(out)
    return out


def draws(seed: Column, n: int) -> Column:
    """The first n numbers of draw, as an array. Each step is a pass of its own: lambdas share nothing, so nested steps would be run some 50 times over."""
    out = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: _low(seed.cast("long") + k * F.lit(0x6D2B79F5).cast("long")))
    for step in _STEPS:
        out = F.transform(out, step)
    return out


def draw_int(seed: Column, least: int, most: int, nth: int = 0) -> Column:
    return (F.floor(draw(seed, nth) * (most - least + 1)) + least).cast("long")


def stable_json(value: object) -> str:
    """SNK7: keys in order, two spaces a level; a list of plain values on one line where it fits into LINE_WIDTH."""
    dump = lambda v: json.dumps(v, ensure_ascii=False)

    def lines(v: object, depth: int, used: int) -> str:
        pad, close = "  " * (depth + 1), "  " * depth
        if isinstance(v, dict) and v:
            heads = [(f"{pad}{dump(k)}: ", v[k]) for k in sorted(v)]
            last = len(heads) - 1
            return "{\n" + ",\n".join(h + lines(x, depth + 1, len(h) + (i < last)) for i, (h, x) in enumerate(heads)) + f"\n{close}}}"
        if isinstance(v, list) and v:
            flat = f"[{', '.join(map(dump, v))}]"
            if used + len(flat) <= LINE_WIDTH and not any(isinstance(x, (dict, list)) for x in v):
                return flat
            last = len(v) - 1
            return "[\n" + ",\n".join(pad + lines(x, depth + 1, len(pad) + (i < last)) for i, x in enumerate(v)) + f"\n{close}]"
        return dump(v)

    return lines(value, 0, 0) + "\n"


def json_schema(kind: DataType, draft: str = "2020-12") -> dict:
    """ARR6: the JSON Schema of a Spark type, for draft 2020-12 or draft-07. Nullable fields are optional."""
    name = {"2020-12": "https://json-schema.org/draft/2020-12/schema", "draft-07": "http://json-schema.org/draft-07/schema#"}

    def of(t: DataType) -> dict:
        if isinstance(t, StructType):
            out = {"type": "object", "properties": {f.name: of(f.dataType) for f in t.fields}, "additionalProperties": False}
            return out | ({"required": need} if (need := [f.name for f in t.fields if not f.nullable]) else {})
        if isinstance(t, ArrayType):
            return {"type": "array", "items": of(t.elementType)}
        if isinstance(t, MapType):
            return {"type": "object", "additionalProperties": of(t.valueType)}
        return {"type": "integer" if isinstance(t, IntegralType) else "number" if isinstance(t, FractionalType) else "boolean" if isinstance(t, BooleanType) else "string"}

    return {"$schema": name[draft], **of(kind)}


def required_nullable(schema: dict) -> dict:
    """ARR7: the schema with every property required, and null allowed for each, at every depth."""
    out = dict(schema)
    if "items" in out:
        out["items"] = required_nullable(out["items"])
    if "properties" in out:
        out["properties"] = {k: x if (x := required_nullable(v)).get("anyOf") else {"anyOf": [x, {"type": "null"}]} for k, v in out["properties"].items()}
        out["required"] = list(out["properties"])
    return out


def spliced(text: str, section: str, body: str) -> str:
    """SNK6: the text with body between the section's marks, which are added at its end where they are missing."""
    start, end = f"<!-- {section}:start -->", f"<!-- {section}:end -->"
    block = f"{start}\n{body.strip()}\n{end}"
    if start in text and end in text.split(start, 1)[1]:
        head, rest = text.split(start, 1)
        return head + block + rest.split(end, 1)[1]
    return f"{text.rstrip()}\n\n{block}\n" if text.strip() else f"{block}\n"
