"""From an inbox of files to a manifest and drafts of truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results: sources by the beginnings of file names, and headings.
SOURCES = {"consent": "consent", "linkedin": "linkedin", "public": "public-record", "fake": "fake", "fixture": "fixture"}
ES_HEADINGS = r"(?im)^\s*(experiencia( laboral| profesional)?|educaci[oó]n|formaci[oó]n( acad[eé]mica)?|habilidades|competencias|idiomas|perfil( profesional)?|resumen)\s*:?\s*$"
EN_HEADINGS = r"(?im)^\s*((work|professional) experience|experience|education|(technical )?skills|languages|summary|profile)\s*:?\s*$"
DRAFT = (
    "basics struct<name: string, email: string, phone: string, location: struct<city: string, region: string, countryCode: string>>, "
    "work array<struct<name: string, position: string, startDate: string, endDate: string>>, "
    "education array<struct<institution: string, studyType: string, area: string, startDate: string, endDate: string>>, "
    "skills array<struct<name: string>>, languages array<struct<language: string, fluency: string>>"
)


def inbox_source(name: Column) -> Column:
    """PRJ13: struct of source and cc by a file's name; a public record's country is its next part, else xx."""
    head = F.lower(F.regexp_extract(name, r"^([A-Za-z]+)-", 1))
    source = F.try_element_at(F.create_map(*[F.lit(x) for pair in SOURCES.items() for x in pair]), head)
    cc = F.lower(F.regexp_extract(name, r"(?i)^public-([a-z]{2})(?:-|$)", 1))
    known = (source == "public-record") & (cc != "")
    return F.struct(F.coalesce(source, F.lit("unknown")).alias("source"), F.when(known, cc).otherwise("xx").alias("cc"))


def manifest_language(text: Column, detected: Column) -> Column:
    """CLS5: mixed if a text has headings of both languages, else what was detected, else unknown."""
    both = F.coalesce(text, F.lit("")).rlike(ES_HEADINGS) & F.coalesce(text, F.lit("")).rlike(EN_HEADINGS)
    return F.when(both, "mixed").otherwise(F.coalesce(detected, F.lit("unknown")))


def draft_truth(record: Column) -> Column:
    """PRJ7: the parts of a JSON record that are scored, without nulls; a location without any part goes."""
    r = F.from_json(record, DRAFT)
    place = r["basics"]["location"]
    bare = F.coalesce(place["city"], place["region"], place["countryCode"]).isNull()
    basics = F.when(r["basics"].isNotNull(), r["basics"].withField("location", F.when(~bare, place)))
    return F.to_json(r.withField("basics", basics))


def upserted(manifest: DataFrame, drafts: DataFrame, key: str = "id") -> DataFrame:
    """SNK5: the manifest with the drafts' rows in place of its own of the same key. The same drafts again change nothing."""
    return manifest.join(drafts.select(key), key, "left_anti").unionByName(drafts.dropDuplicates([key])).orderBy(key)


def line_key(line: Column) -> Column:
    """STR24: a line without a bullet, trimmed."""
    return F.regexp_replace(F.trim(line), "^- ", "")


def box_lines(lines: DataFrame) -> DataFrame:
    """SRC16: (doc_id, block, pos, line) of text boxes; a line that a block has twice (an alternative) counts once there."""
    return lines.groupBy("doc_id", "block", "line").agg(F.min("pos").alias("pos"))


def unseen_lines(boxes: DataFrame, body: DataFrame) -> DataFrame:
    """JOI12: text-box lines whose key no line of the document's body has."""
    keyed = body.select("doc_id", line_key(F.col("line")).alias("key")).distinct()
    return boxes.withColumn("key", line_key(F.col("line"))).join(keyed, ["doc_id", "key"], "left_anti").drop("key")
