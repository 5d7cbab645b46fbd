"""Made people: records and texts that tell the same, from a number alone, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions.text import unaccent
from foliary.functions.written import draws, written_range

# Fixed values that must equal the reference's for right results: the plan of a data set, its countries and how they write phones.
PLAN = (("single-column", "pdf", 11, (3,)), ("two-column", "pdf", 11, ()), ("sidebar", "pdf", 8, ()), ("single-column", "docx", 6, (2,)), ("table", "docx", 6, ()), ("textbox", "docx", 4, ()), ("functional", "pdf", 4, ()), ("academic", "pdf", 4, ()), ("scanned", "image", 4, ()), ("scanned", "pdf", 2, ()))
COUNTRIES = ("AR", "MX", "ES", "CO", "CL", "PE", "UY")
PHONES = {"ES": "+34 6## ### ###", "AR": "+54 9 11 *###-####", "MX": "+52 55 *### ####", "CO": "+57 3## ### ####", "CL": "+56 9 *### ####", "PE": "+51 9## ### ###", "UY": "+598 9* ### ###"}

#: Own choices, which nothing depends on.
NAMES = (("Lucía", "f"), ("Tomás", "m"), ("Inés", "f"), ("Joaquín", "m"), ("Sofía", "f"), ("Andrés", "m"), ("Noelia", "f"), ("Martín", "m"))
SURNAMES = ("Quiroga", "Peña", "Ibáñez", "Rosales", "Cifuentes", "Moyano", "Baeza", "Urrutia", "Lagos")
CITIES = {"AR": "Rosario", "MX": "Puebla", "ES": "Zaragoza", "CO": "Cali", "CL": "Temuco", "PE": "Cusco", "UY": "Salto"}
JOBS = ("Desarrollador{/a} web", "Analista de datos", "Contador{/a}", "Ingenier{o/a} de pruebas", "Diseñador{/a} gráfic{o/a}")
FIRMS = ("Norte Azul S.A.", "Talleres Lumen", "Grupo Cardón", "Molinos del Este", "Datos y Redes SRL")
SKILLS = ("Go", "SQL", "Python", "Excel", "Figma", "Docker", "Java", "Rust")
STYLES = ("month-name", "mm-yyyy", "abbr-dot", "abbr-cap")

#: The number drawn for the first character of a phone; those before are for the rest.
PHONE_AT = 20


def _pick(values: tuple, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def _int(u: Column, k: int, least: int, most: int) -> Column:
    return (F.floor(F.get(u, k) * (most - least + 1)) + least).cast("long")


def _drawn(values: tuple, u: Column, k: int) -> Column:
    return _pick(values, _int(u, k, 0, len(values) - 1))


def gendered(text: Column, female: Column) -> Column:
    """STR23: "Contador{/a}" as a man's or a woman's title."""
    return F.when(female, F.regexp_replace(text, r"\{[^/}]*/([^}]*)\}", "$1")).otherwise(F.regexp_replace(text, r"\{([^/}]*)/[^}]*\}", "$1"))


def email_part(name: Column) -> Column:
    """STR23: a name's plain letters."""
    return F.regexp_replace(unaccent(name), "[^a-z]", "")


def phone(country: Column, u: Column, first: int = 0) -> Column:
    """STR23: a phone as its country writes it, of drawn numbers from the first on; # is any digit, * none but 0."""

    def digits(pattern: str) -> Column:
        kinds = {"#": 0, "*": 1}
        return F.concat(*[_int(u, first + k, kinds[c], 9).cast("string") if c in kinds else F.lit(c) for k, c in enumerate(pattern)])

    out = F.lit(None).cast("string")
    for cc, pattern in PHONES.items():
        out = F.when(country == cc, digits(pattern)).otherwise(out)
    return out


def planned(index: Column) -> Column:
    """UDX12: struct of id, country, layout, format and language of the entry with this number, from 0; the plan repeats."""
    rows = [(layout, kind, "mixed" if v in mixed else "es") for layout, kind, n, mixed in PLAN for v in range(n)]
    country = _pick(COUNTRIES, index % len(COUNTRIES))
    row = F.get(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("layout", "format", "language"), r, strict=True)]) for r in rows]), (index % len(rows)).cast("int"))
    number = (F.floor(index / len(COUNTRIES)) + 1).cast("string")
    name = F.concat(F.lit("es-"), F.lower(country), F.lit("-"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")))
    return F.struct(name.alias("id"), country.alias("country"), row["layout"].alias("layout"), row["format"].alias("format"), row["language"].alias("language"))


def people(rows: DataFrame, index: str) -> DataFrame:
    """UDX12, SYN2: rows with plan, record (a struct) and text, made from the number in the column index alone.

    The text has all that the record tells: an address, a phone as the country writes it, two jobs with dates in one
    style, the later first and maybe going on, skills and a language. The same number gives the same person anywhere.
    """
    seed = F.pmod(F.col(index).cast("long") * 2654435761, F.lit(2**32))
    rows = rows.withColumn("plan", planned(F.col(index))).withColumn("_u", draws(seed, PHONE_AT + max(map(len, PHONES.values()))))
    u, cc = F.col("_u"), F.col("plan.country")
    at = _int(u, 0, 0, len(NAMES) - 1).cast("int")
    # Months are counted from the year 0: an early job, a gap, and a later one that may go on.
    begin = _int(u, 4, 2004 * 12, 2010 * 12)
    rows = rows.select("*", _pick(tuple(n for n, _ in NAMES), at).alias("_f"), _pick(tuple(g == "f" for _, g in NAMES), at).alias("_g"), F.concat_ws(" ", _drawn(SURNAMES, u, 1), _drawn(SURNAMES, u, 2)).alias("_l"), _drawn(STYLES, u, 3).alias("_y"), begin.alias("_a"), (begin + _int(u, 5, 6, 40)).alias("_b"))
    rows = rows.withColumn("_d", F.col("_b") + _int(u, 6, 1, 9)).withColumn("_e", F.when(_int(u, 7, 0, 2) > 0, F.col("_d") + _int(u, 8, 6, 60)))
    first, female, last, style = F.col("_f"), F.col("_g"), F.col("_l"), F.col("_y")
    mail = F.concat(email_part(first), F.lit("."), email_part(last), F.lit("@example.com"))
    city = F.element_at(F.create_map(*[F.lit(x) for p in CITIES.items() for x in p]), cc)
    y, m = lambda t: F.floor(t / 12).cast("int"), lambda t: (t % 12 + 1).cast("int")
    iso = lambda t: F.concat_ws("-", y(t).cast("string"), F.lpad(m(t).cast("string"), 2, "0"))

    def job(k: int, a: Column, b: Column) -> Column:
        title = gendered(_drawn(JOBS, u, 10 + k), female)
        return F.struct(_drawn(FIRMS, u, 12 + k).alias("name"), title.alias("position"), iso(a).alias("startDate"), F.when(b.isNotNull(), iso(b)).alias("endDate"), written_range(style, y(a), m(a), y(b), m(b)).alias("written"))

    skills = F.array_distinct(F.array(*[_drawn(SKILLS, u, 14 + k) for k in range(3)]))
    rows = rows.select("*", F.concat_ws(" ", first, last).alias("_n"), mail.alias("_m"), phone(cc, u, PHONE_AT).alias("_p"), city.alias("_c"), F.array(job(0, F.col("_d"), F.col("_e")), job(1, F.col("_a"), F.col("_b"))).alias("_w"), skills.alias("_s"))
    work = F.transform("_w", lambda x: x.dropFields("written"))
    basics = F.struct(F.col("_n").alias("name"), F.col("_m").alias("email"), F.col("_p").alias("phone"), F.struct(F.col("_c").alias("city"), cc.alias("countryCode")).alias("location"))
    record = F.struct(basics.alias("basics"), work.alias("work"), F.transform("_s", lambda s: F.struct(s.alias("name"))).alias("skills"), F.array(F.struct(F.lit("Inglés").alias("language"), F.lit("B2").alias("fluency"))).alias("languages"))
    jobs = F.array_join(F.transform("_w", lambda x: F.concat(x["position"], F.lit(", "), x["name"], F.lit("\n"), x["written"])), "\n")
    text = F.concat_ws("\n", "_n", F.concat_ws(" | ", "_m", "_p", "_c"), F.lit("Experiencia"), jobs, F.lit("Habilidades"), F.array_join("_s", ", "), F.lit("Idiomas"), F.lit("Inglés: B2"))
    return rows.withColumns({"record": record, "text": text}).drop(*[f"_{c}" for c in "unmpcwsfglyabde"])
