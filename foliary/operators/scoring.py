"""Counts of right, wrong and missing values of one record against its truth, as native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions.lexicon import NAME_PARTICLES
from foliary.functions.text import city_matches, entity_tokens, jaccard, language_code, normalize_city, normalize_email, normalize_skill, phones_match, score_text, split_phones, token_set
from foliary.operators.records import assign_entries, prf

#: Shared components this alike make up for one that only one side has.
PARTIAL_MATCH = 0.8
DEFAULT_INPUT_TOKENS, INSTRUCTION_TOKENS = 24_000, 2_000


def _counts(tp: Column | int, fp: Column | int, fn: Column | int) -> Column:
    as_long = lambda v, name: (F.lit(v) if isinstance(v, int) else v).cast("long").alias(name)
    return F.struct(as_long(tp, "tp"), as_long(fp, "fp"), as_long(fn, "fn"))


def _sum(a: Column, b: Column) -> Column:
    return _counts(*[a[k] + b[k] for k in ("tp", "fp", "fn")])


def scalar_counts(truth: Column, predicted: Column, equal: Column) -> Column:
    """AGG13: null where both sides are null or empty."""
    t, p = (F.coalesce(x, F.lit("")) != "" for x in (truth, predicted))
    right = F.coalesce(equal, F.lit(False))
    return F.when(t & p & right, _counts(1, 0, 0)).when(t & p, _counts(0, 1, 1)).when(t, _counts(0, 0, 1)).when(p, _counts(0, 1, 0))


def entry_likeness(fields: list[tuple[Column, Column]]) -> Column:
    """AGG11: mean likeness of the token sets that both sides have; a one-sided set counts as 0 unless the rest is alike."""
    has = [(F.size(a) > 0, F.size(b) > 0) for a, b in fields]
    add = lambda xs: reduce(lambda x, y: x + y, xs)
    total = add([F.when(x & y, jaccard(a, b)).otherwise(0.0) for (a, b), (x, y) in zip(fields, has, strict=True)])
    shared = add([(x & y).cast("int") for x, y in has])
    lone = add([(x != y).cast("int") for x, y in has])
    return F.when(shared == 0, 0.0).when((lone > 0) & (total >= PARTIAL_MATCH * shared), total / shared).otherwise(total / (shared + lone))


def _known(truth: Column, predicted: Column) -> Column:
    return F.when(predicted.isNull(), _counts(0, 0, 1)).when(F.startswith(predicted, truth), _counts(1, 0, 0)).otherwise(_counts(0, 1, 1))


def date_counts(ts: Column, te: Column, ps: Column, pe: Column) -> Column:
    """AGG12 for the normalized start and end of a matched pair."""
    none = _counts(0, ps.isNotNull().cast("int") + pe.isNotNull().cast("int"), 0)
    single = _sum(_known(te, F.coalesce(pe, ps)), _counts(0, (ps.isNotNull() & pe.isNotNull()).cast("int"), 0))
    ongoing = F.when(pe.isNotNull(), _counts(0, 1, 1)).when(ps.isNotNull(), _counts(1, 0, 0)).otherwise(_counts(0, 0, 1))
    both = _sum(_known(ts, ps), F.when(te.isNull(), ongoing).otherwise(_known(te, pe)))
    return F.when(ts.isNull() & te.isNull(), none).when(ts.isNull(), single).otherwise(both)


def date_slots(ts: Column, te: Column) -> Column:
    """AGG12: slots missed by a truth entry without a partner."""
    return F.when(ts.isNotNull(), 2).when(te.isNotNull(), 1).otherwise(0).cast("long")


def input_budget(explicit: Column, context: Column, output: Column) -> Column:
    """UDX7: tokens a model may read, 1 at least."""
    return F.greatest(F.lit(1), F.coalesce(explicit, context - output - INSTRUCTION_TOKENS, F.lit(DEFAULT_INPUT_TOKENS))).cast("long")


def merged_intervals(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """AGG20: unions of a key's intervals that overlap or touch. Rows with a null bound go; an end before its start counts as the start.

    The rows of a key meet in one sorted task, which spills.
    """
    rows = rows.select(key, F.col(start).alias("start"), F.greatest(start, end).alias("end"), (F.col(start).isNotNull() & F.col(end).isNotNull()).alias("ok")).where("ok").drop("ok")
    order = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    return opened.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


#: The nested record that scoring reads, as a Spark type; more fields may be there.
RECORD = (
    "struct<basics: struct<name: string, email: string, phone: string, location: struct<city: string, countryCode: string>>, "
    "work: array<struct<name: string, position: string, startDate: string, endDate: string>>, "
    "education: array<struct<institution: string, studyType: string, area: string, startDate: string, endDate: string>>, "
    "certificates: array<struct<name: string, issuer: string, date: string>>, skills: array<struct<name: string, keywords: array<string>>>, languages: array<struct<language: string>>, "
    "ext: struct<location: struct<city: string, countryCode: string>, educationLevels: array<struct<level: string>>>>"
)
FIELDS = ("basics.name", "basics.email", "basics.phone", "basics.location", "work.entries", "work.dates", "education.entries", "education.dates", "education.level", "skills", "languages")
#: The field that only some systems fill stays out of the mean.
COMMON_FIELDS = tuple(f for f in FIELDS if f != "education.level")
ENTRY_MATCH, NAME_MATCH, DATE_TIE = 0.5, 0.8, 1e-7
ONGOING = r"^(present|presente|actual|actualidad|actualmente|hoy|now|current|currently|(a |hasta )?la fecha|en curso|hasta hoy|hasta la actualidad)$"
ENTRY = "array<struct<a: string, b: string, s: string, e: string>>"


def date_value(date: Column) -> Column:
    """CLN15: an ISO date as it is, null for ongoing or nothing, else the scored text."""
    plain, scored = F.trim(date), score_text(date)
    return F.when(plain.rlike(r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$"), plain).when((plain != "") & ~scored.rlike(ONGOING), scored)


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _list(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _entries(r: Column, section: str) -> Column:
    """The section's entries with two texts to tell them by; certificates go on from education."""
    one = lambda a, b, s, e: F.struct(a.alias("a"), b.alias("b"), s.alias("s"), e.alias("e"))
    if section == "work":
        return _list(F.transform(r["work"], lambda x: one(x["name"], x["position"], x["startDate"], x["endDate"])), ENTRY)
    studies = F.transform(r["education"], lambda x: one(x["institution"], F.concat_ws(" ", _filled(x["studyType"]), _filled(x["area"])), x["startDate"], x["endDate"]))
    courses = F.transform(r["certificates"], lambda x: one(x["issuer"], x["name"], F.lit(None).cast("string"), x["date"]))
    return F.concat(_list(studies, ENTRY), _list(courses, ENTRY))


def _scalar_fields(rows: DataFrame) -> DataFrame:
    def pair(get) -> tuple[Column, Column]:
        return get(F.col("t")), get(F.col("p"))

    city = lambda r: F.coalesce(_filled(r["basics"]["location"]["city"]), r["ext"]["location"]["city"])
    country = lambda r: F.coalesce(_filled(r["basics"]["location"]["countryCode"]), r["ext"]["location"]["countryCode"])
    names = [token_set(c, NAME_PARTICLES) for c in pair(lambda r: r["basics"]["name"])]
    mails = [normalize_email(c) for c in pair(lambda r: r["basics"]["email"])]
    phones, cities = pair(lambda r: r["basics"]["phone"]), pair(city)
    codes = [score_text(c) for c in pair(country)]
    here = city_matches(*cities) & ((codes[0] == "") | (codes[1] == "") | (codes[0] == codes[1]))
    told = {
        "basics.name": scalar_counts(*[F.array_join(n, " ") for n in names], jaccard(*names) >= NAME_MATCH),
        "basics.email": scalar_counts(*mails, mails[0] == mails[1]),
        "basics.phone": scalar_counts(*[F.array_join(split_phones(p), " / ") for p in phones], phones_match(*phones)),
        "basics.location": scalar_counts(*[normalize_city(c) for c in cities], here),
    }
    return _long(rows.select("doc_id", *[c.alias(f"_{k}") for k, c in enumerate(told.values())]), list(told))


def _long(rows: DataFrame, names: list[str]) -> DataFrame:
    """Structs of counts, one column each, to (doc_id, field, tp, fp, fn); nulls are no rows."""
    told = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"_{k}").alias("c")) for k, n in enumerate(names)])).alias("x")
    return rows.select("doc_id", told).where("x.c IS NOT NULL").select("doc_id", "x.field", "x.c.*")


def _set_fields(rows: DataFrame) -> DataFrame:
    """JOI10: distinct items of both sides, counted by document and field."""

    def items(r: Column) -> dict[str, Column]:
        telling = lambda s: F.filter(s["keywords"], lambda k: k.rlike(r"[\p{L}\p{N}+#]"))
        return {
            "skills": F.flatten(F.transform(r["skills"], lambda s: F.when(F.size(telling(s)) > 0, telling(s)).otherwise(F.array(s["name"])))),
            "languages": F.transform(r["languages"], lambda x: x["language"]),
        }

    sides = []
    for side in ("t", "p"):
        for field, found in items(F.col(side)).items():
            plain = rows.select("doc_id", F.lit(field).alias("field"), F.explode(found).alias("item"))
            scored = plain.select("doc_id", "field", (normalize_skill if field == "skills" else language_code)(F.col("item")).alias("item"))
            sides.append(scored.where("item <> ''").select("*", F.lit(side == "t").alias("t"), F.lit(side == "p").alias("p")))
    both = reduce(DataFrame.unionByName, sides).groupBy("doc_id", "field", "item").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    n = lambda c, name: F.count_if(c).alias(name)
    t, p = F.col("t"), F.col("p")
    return both.groupBy("doc_id", "field").agg(n(t & p, "tp"), n(~t & p, "fp"), n(t & ~p, "fn"))


def _matched(rows: DataFrame, section: str) -> DataFrame:
    """JOI8: (doc_id, i, j) of the pairs of true and predicted entries."""

    def flat(side: str, at: str) -> DataFrame:
        out = rows.select("doc_id", F.posexplode(_entries(F.col(side), section)).alias(at, "x"))
        year = lambda c: F.substring(date_value(c), 1, 4)
        return out.select("doc_id", at, *[entity_tokens(F.col(f"x.{c}")).alias(f"{side}{c}") for c in "ab"], *[year(F.col(f"x.{c}")).alias(f"{side}{c}") for c in "se"])

    pairs = flat("t", "i").join(flat("p", "j"), "doc_id")
    like = entry_likeness([(F.col("ta"), F.col("pa")), (F.col("tb"), F.col("pb"))])
    tie = F.coalesce((F.col("ts") == F.col("ps")).cast("int"), F.lit(0)) * 2 + F.col("te").eqNullSafe(F.col("pe")).cast("int")
    pairs = pairs.select("doc_id", "i", "j", like.alias("like"), tie.alias("tie"))
    pairs = pairs.select("doc_id", F.col("i").cast("long").alias("t"), F.col("j").cast("long").alias("p"), F.when(F.col("like") >= ENTRY_MATCH, F.col("like") + DATE_TIE * F.col("tie")).otherwise(F.col("like")).alias("sim"))
    return assign_entries(pairs).select("doc_id", F.col("t").alias("i"), F.col("p").alias("j"))


def _section_fields(rows: DataFrame, section: str, levels: bool | None) -> DataFrame:
    """AGG14: entries, dates and, for education, levels."""
    pairs = _matched(rows, section).groupBy("doc_id").agg(F.collect_list(F.struct("i", "j")).alias("pairs"))
    rows = rows.select("*", _entries(F.col("t"), section).alias("te"), _entries(F.col("p"), section).alias("pe")).join(pairs, "doc_id", "left")
    rows = rows.withColumn("pairs", _list(F.col("pairs"), "array<struct<i: bigint, j: bigint>>"))
    n, t, p = F.size("pairs"), F.size("te"), F.size("pe")
    entries = rows.where((t > 0) | (p > 0)).select("doc_id", F.lit(f"{section}.entries").alias("field"), n.cast("long").alias("tp"), (p - n).cast("long").alias("fp"), (t - n).cast("long").alias("fn"))

    # One row for each true entry, with its partner if it has one.
    each = rows.select("doc_id", F.size("p.education").alias("n_studies"), "t.ext.educationLevels", F.col("p.ext.educationLevels").alias("guessed"), (F.col("p.ext").isNotNull() if levels is None else F.lit(levels)).alias("asked"), "pairs", "pe", F.posexplode("te").alias("i", "x"))
    each = each.withColumn("j", F.get(F.filter("pairs", lambda q: q["i"] == F.col("i")), 0)["j"].cast("int")).withColumn("y", F.get("pe", F.col("j")))
    ts, te, ps, pe = (date_value(F.col(c)) for c in ("x.s", "x.e", "y.s", "y.e"))
    dates = each.select("doc_id", F.col("j").isNotNull().alias("met"), ts.alias("ts"), te.alias("te"), ps.alias("ps"), pe.alias("pe"))
    told = F.when(F.col("met"), date_counts(*map(F.col, ("ts", "te", "ps", "pe")))).otherwise(_counts(0, 0, date_slots(F.col("ts"), F.col("te"))))
    out = [entries, _summed(dates.select("doc_id", F.lit(f"{section}.dates").alias("field"), told.alias("c")))]
    if section == "education":
        true = _filled(F.get("educationLevels", F.col("i"))["level"])
        guess = F.when(F.col("j") >= F.greatest(F.lit(0), F.coalesce("n_studies", F.lit(0))), "course").when(F.col("j").isNotNull(), _filled(F.get("guessed", F.col("j"))["level"]))
        out.append(_summed(each.where("asked").select("doc_id", F.lit("education.level").alias("field"), F.when(true.isNotNull(), scalar_counts(true, guess, true == guess)).alias("c"))))
    return reduce(DataFrame.unionByName, out)


def _summed(rows: DataFrame) -> DataFrame:
    sums = rows.where("c IS NOT NULL").groupBy("doc_id", "field").agg(*[F.sum(f"c.{k}").alias(k) for k in ("tp", "fp", "fn")])
    return sums.where("tp + fp + fn > 0")


def score_records(truth: DataFrame, predicted: DataFrame, levels: bool | None = None) -> DataFrame:
    """AGG14: (doc_id, field, tp, fp, fn) of each document of truth; a field that neither side has is no row.

    Both tables have doc_id, once each, and a struct record (see RECORD); a document without a prediction misses all.
    Levels are asked for where the prediction has an ext, or always or never. Entries are paired within a document only.
    """
    rows = truth.select("doc_id", F.col("record").alias("t")).join(predicted.select("doc_id", F.col("record").alias("p")), "doc_id", "left")
    return reduce(DataFrame.unionByName, [_scalar_fields(rows), *[_section_fields(rows, s, levels) for s in ("work", "education")], _set_fields(rows)])


def overall(scores: DataFrame) -> DataFrame:
    """AGG2: sums by field with precision, recall and F1."""
    sums = scores.groupBy("field").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    return sums.select("*", *prf(*[F.col(k) for k in ("tp", "fp", "fn")]))


def mean_f1(fields: DataFrame) -> DataFrame:
    """AGG2: the mean F1 of the fields that every system is asked for."""
    return fields.where(F.col("field").isin(*COMMON_FIELDS)).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("overall_f1"))
