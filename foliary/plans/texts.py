"""Queries over documents' texts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.functions.lexicon import STOPWORDS
from foliary.operators import records as R
from foliary.plans.registry import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
FOLD = r"trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))"
SCORED = r"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_stop = " UNION ALL ".join(f"SELECT unnest([{', '.join(repr(w) for w in ws)}]) AS w, '{k}' AS l" for k, ws in STOPWORDS.items())


@book.query("documents", sql=rf"""
WITH s AS ({_stop}), t AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9ñ]+'), lambda x: x <> '') AS ts FROM documents),
u AS (SELECT doc_id, unnest(ts) AS w FROM t), h AS (SELECT doc_id, l, count(*) AS n FROM u JOIN s USING (w) GROUP BY ALL),
p AS (SELECT t.doc_id, t.lang, len(ts) AS k, coalesce(max(n) FILTER (l = 'es'), 0) AS es, coalesce(max(n) FILTER (l = 'en'), 0) AS en, coalesce(max(n) FILTER (l = 'pt'), 0) AS pt FROM t LEFT JOIN h USING (doc_id) GROUP BY ALL),
r AS (SELECT *, greatest(es, en, pt) AS b, es + en + pt - greatest(es, en, pt) - least(es, en, pt) AS c FROM p),
d AS (SELECT lang, CASE WHEN k >= 5 AND b > 0 AND b - c >= greatest(2.0, b * 0.2) THEN CASE b WHEN es THEN 'es' WHEN en THEN 'en' ELSE 'pt' END END AS detected FROM r)
SELECT lang, detected, count(*)::BIGINT AS n FROM d GROUP BY ALL""")  # fmt: skip
def language_profile(docs):
    return R.language_scores(docs.select("doc_id", "lang", "text")).groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


@book.query("documents", sql=f"SELECT doc_id, md5({FOLD}) AS folded FROM documents")
def fold_text(docs):
    return docs.select("doc_id", F.md5(T.fold("text").cast("binary")).alias("folded"))


@book.query("documents", sql="SELECT doc_id, ceil(length(text) / 3.3::DOUBLE)::BIGINT AS tokens FROM documents")
def token_estimate(docs):
    return docs.select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@book.query("documents", sql=f"""
WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split({SCORED}, ' '), lambda x: x <> '')) AS ws FROM documents)
SELECT doc_id, len(ws)::BIGINT AS n_tokens, len(list_filter(ws, lambda x: x NOT IN ('de','del','la','las','el','los','y','e','en','the','of','and','at','a','s','sa','srl','sl','sas','sac','spa','ltda','inc','llc','ltd','cv','r','l','c','v')))::BIGINT AS n_content FROM t""")
def score_text_tokens(docs):
    return docs.select("doc_id", F.size(T.token_set(F.col("text"))).cast("long").alias("n_tokens"), F.size(T.entity_tokens(F.col("text"))).cast("long").alias("n_content"))


RARE = """
WITH d AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split({0}, ' '), lambda x: x <> ''))) AS w FROM documents),
b AS (SELECT item_id, unnest(list_distinct(list_filter(string_split({0}, ' '), lambda x: x <> ''))) AS w FROM benchmark),
dn AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), bn AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1),
i AS (SELECT doc_id, item_id, count(*) AS k FROM d JOIN b USING (w) GROUP BY ALL)
""".format(SCORED)


#: Words and items of a benchmark up to this number of rows are broadcast; a larger one is joined by shuffle, whose hot words Spark splits.
BROADCAST_WORDS = 1_000_000


def _words(rows, key, n):
    # explode_outer, for Spark would fold the text once more to filter what explode drops; an empty set's null word meets none
    sets = rows.select(key, T.token_set(F.col("text")).alias("words")).select(key, "words", F.size("words").alias(n))
    return sets.select(key, n, F.explode_outer("words").alias("w"))


@book.query("documents", "benchmark", sql=RARE + "SELECT item_id, doc_id, k::BIGINT AS shared, k::DOUBLE / (dn.n + bn.n - k) AS jaccard FROM i JOIN dn USING (doc_id) JOIN bn USING (item_id) WHERE k * 10 >= (dn.n + bn.n - k)")
def jaccard_pairs(docs, bench):
    d, b = _words(docs, "doc_id", "n"), _words(bench, "item_id", "m")
    b = F.broadcast(b) if b.count() <= BROADCAST_WORDS else b
    out = d.join(b, "w").groupBy("doc_id", "n", "item_id", "m").agg(F.count(F.lit(1)).alias("shared"))
    out = out.withColumn("union", F.col("n") + F.col("m") - F.col("shared")).where("shared * 10 >= union")
    return out.select("item_id", "doc_id", "shared", (F.col("shared") / F.col("union")).alias("jaccard"))


BENCH_TERMS = "SELECT item_id, string_split({0}, ' ')[1:8] AS head FROM benchmark".format(SCORED)


#: Words of a passage that counts as shared; benchmark grams up to this number are broadcast.
GRAM, BROADCAST_GRAMS = 8, 2_000_000


def _wordy(rows, key):
    words = F.filter(F.split(T.score_text(F.col("text")), " "), lambda w: w != "")
    return rows.select(key, words.alias("ws")).where(F.size("ws") >= GRAM)


def _grams(rows, key):
    """(key, i, h): the place and a hash of each run of GRAM words. Only hashes are exploded."""
    runs = lambda hs: F.transform(F.sequence(F.lit(0), F.size(hs) - GRAM), lambda i: F.xxhash64(*[F.get(hs, i + j) for j in range(GRAM)]))
    hashes = F.transform(F.array(F.transform("ws", lambda w: F.xxhash64(w))), runs)[0]
    return rows.select(key, F.posexplode(hashes).alias("i", "h"))


GRAMS = """
WITH d0 AS (SELECT doc_id, list_filter(string_split({0}, ' '), lambda x: x <> '') AS ws FROM documents), b0 AS (SELECT item_id, list_filter(string_split({0}, ' '), lambda x: x <> '') AS ws FROM benchmark),
d AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d0)),
b AS (SELECT DISTINCT item_id, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM b0))
""".format(SCORED)


@book.query("documents", "benchmark", sql=GRAMS + "SELECT DISTINCT doc_id FROM d WHERE g IN (SELECT g FROM b)")
def contamination_semi(docs, bench):
    """Hashes find the few places that can be shared; only there are the words compared."""
    words, items = _wordy(docs, "doc_id"), _wordy(bench, "item_id")
    at = _grams(items, "item_id").join(items, "item_id").select("h", F.slice("ws", F.col("i") + 1, GRAM).alias("gram")).distinct()
    at = F.broadcast(at) if at.count() <= BROADCAST_GRAMS else at
    hits = _grams(words, "doc_id").join(at, "h").select("doc_id", "i", "gram")
    return words.join(hits, "doc_id").where(F.slice("ws", F.col("i") + 1, GRAM) == F.col("gram")).select("doc_id").distinct()


@book.query("documents", "benchmark", sql=GRAMS + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d WHERE g IN (SELECT g FROM b))")
def uncontaminated_anti(docs, bench):
    return docs.select("doc_id").join(contamination_semi(docs, bench), "doc_id", "left_anti")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ()-]{6,}[0-9]"


@book.query("documents", sql=f"SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS email FROM documents")
def emails_found(docs):
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("email"))


@book.query("documents", sql=rf"SELECT doc_id, right(regexp_replace(p, '[^0-9]', '', 'g'), 8) AS phone FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{PHONE}')) AS p FROM documents)")
def phones_found(docs):
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(PHONE), F.lit(0))).alias("p")).select("doc_id", F.right(T.digits(F.col("p")), F.lit(8)).alias("phone"))


@book.query("documents", sql=r"""SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@') AS has_email, regexp_matches(text, '\+?[0-9][0-9 ()-]{6,}[0-9]') AS has_phone,
len(regexp_extract_all(text, '[0-9]{4}'))::BIGINT AS n_years FROM documents WHERE NOT regexp_matches(text, '[A-Za-z0-9._%+-]+@') AND len(regexp_extract_all(text, '[0-9]{4}')) < 2""")
def suspect_docs(docs):
    t = F.col("text")
    years = F.regexp_count(t, F.lit("[0-9]{4}")).cast("long")
    return docs.where(~t.rlike("[A-Za-z0-9._%+-]+@") & (years < 2)).select("doc_id", F.lit(False).alias("has_email"), t.rlike(PHONE).alias("has_phone"), years.alias("n_years"))


@book.query("documents", sql="SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY text")
def dedupe_exact(docs):
    return docs.groupBy(F.xxhash64("text"), F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@book.query("documents", sql=f"SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY {FOLD}")
def dedupe_folded(docs):
    return docs.groupBy(F.sha2(T.fold("text"), 256)).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@book.query("documents", sql="""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) - count(DISTINCT lower(line)))::BIGINT AS repeated FROM l WHERE trim(line) <> '' GROUP BY 1""")
def repeated_lines(docs):
    rows = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    out = docs.select("doc_id", rows.alias("ls")).where(F.size("ls") > 0)
    return out.select("doc_id", F.size("ls").cast("long").alias("n_lines"), (F.size("ls") - F.size(F.array_distinct(F.transform("ls", F.lower)))).cast("long").alias("repeated"))


@book.query("documents", sql="SELECT doc_id FROM documents WHERE length(text) >= 200 AND (length(text) - length(replace(text, right(text, 200), ''))) / 200 >= 3")
def loop_docs(docs):
    return docs.where(R.loops(F.col("text"))).select("doc_id")


LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), h AS (SELECT *, length(line) <= 60 AS head, count(*) OVER (PARTITION BY doc_id) AS n FROM l)"
def _short():
    return F.length("line") <= 60


@book.query("documents", sql=LINES + " SELECT doc_id, pos::BIGINT AS pos, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), n)::BIGINT AS \"end\" FROM h WHERE head")
def line_spans(docs):
    return R.spans(R.lines(docs), "doc_id", _short()).select("doc_id", F.col("pos").cast("long").alias("pos"), "end")


@book.query("documents", sql=LINES + ", s AS (SELECT doc_id, last_value(CASE WHEN head THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section, length(line) AS k FROM h) SELECT doc_id, section::BIGINT AS section, count(*)::BIGINT AS n_lines, sum(k)::BIGINT AS chars FROM s GROUP BY ALL")
def lines_by_section(docs):
    out = R.section_of(R.lines(docs), "doc_id", _short())
    return out.groupBy("doc_id", F.col("section").cast("long").alias("section")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).cast("long").alias("chars"))


@book.query("documents", sql=LINES + ", b AS (SELECT doc_id, pos, length(line) AS c, sum(length(line)) OVER (PARTITION BY doc_id) AS t, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY length(line) DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM h) SELECT doc_id, count(*) FILTER (t - g > 1000)::BIGINT AS dropped, coalesce(sum(c) FILTER (t - g <= 1000), 0)::BIGINT AS kept_chars FROM b GROUP BY 1")
def budget_fit(docs):
    out = R.fit_budget(R.lines(docs), "doc_id", 1000)
    return out.groupBy("doc_id").agg(F.count_if("dropped").alias("dropped"), F.coalesce(F.sum(F.when(~F.col("dropped"), F.col("chars"))), F.lit(0)).alias("kept_chars"))


@book.query("documents", sql=LINES + ", a AS (SELECT doc_id, pos AS anchor FROM h WHERE line LIKE '%?%' OR length(line) > 400), c AS (SELECT a.doc_id, a.anchor, h.pos, row_number() OVER (PARTITION BY a.doc_id, a.anchor ORDER BY abs(h.pos - a.anchor), a.anchor - h.pos) AS k FROM a JOIN h ON h.doc_id = a.doc_id AND h.head AND h.pos <> a.anchor AND abs(h.pos - a.anchor) <= 2) SELECT doc_id, anchor::BIGINT AS anchor, pos::BIGINT AS pos FROM c WHERE k = 1")
def nearest_line(docs):
    rows = R.lines(docs)
    anchors = rows.where(F.col("line").contains("?") | (F.length("line") > 400))
    out = R.nearest(anchors, rows.where(_short()), "doc_id")
    return out.select("doc_id", F.col("anchor").cast("long").alias("anchor"), F.col("pos").cast("long").alias("pos"))


@book.query("documents", sql="SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS digest FROM documents")
def sha_keys(docs):
    return docs.select("doc_id", F.sha2(F.replace("text", F.lit("\r\n"), F.lit("\n")), 256).alias("digest"))


@book.query("part", sql=r"SELECT p_partkey, trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9.]+', '-', 'g'), '-') AS slug FROM part")
def slug_ids(part):
    return part.select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


book.cases("clean_text", "a string, r string", [("ﬁn de ﬂor", "fin de flor"), ("ı́a", "ia".replace("i", "í")), ("a b c", "a b c"), (None, None), ("", "")], T.clean_extracted)
book.cases("entity_email", "a string, r string", [(" Ana.Pérez+x@Mail.COM ", "ana.perez+x@mail.com"), (None, ""), ("a b@c.d", "ab@c.d")], T.normalize_email)
book.cases("skill_key", "a string, r string", [("C++", "c++"), (" .NET. ", "net"), ("Node.js", "node.js"), ("C#", "c#"), (None, "")], T.normalize_skill)
book.cases("url_key", "a string, r string", [("https://www.a.com/x/", "a.com/x"), ("HTTP://b.org?", "b.org"), ("c.net/#", "c.net"), (None, None)], T.strip_url)
book.cases("phone_parse", "a string, r string", [("+54 11 4127-7100", "54:1141277100"), ("0034 600 111 222", "34:600111222"), ("011 4444 5555", ":1144445555"), ("+598 99 123 456", "598:99123456"), ("", ":")], lambda a: F.concat_ws(":", T.phone_parts(a)["country"], T.phone_parts(a)["national"]))
book.cases("phone_match", "a string, b string, r boolean", [("+54 11 4127-7100 int 5045", "+541141277100", True), ("4127-7100", "+54 11 4127 7100", True), ("+54 11 4127-7100", "+56 11 4127-7100", False), ("123456 / 4444555", "4444555", True), (None, "123456", False)], T.phones_match)
book.cases("city_match", "a string, b string, r boolean", [("CABA", "Ciudad Autónoma de Buenos Aires, Argentina", True), ("Bogotá D.C.", "bogota", True), ("Lima", "Quito", False), ("", "Lima", False), ("CDMX", "Ciudad de México", True)], T.city_matches)
book.cases("language_names", "a string, r string", [("Inglés (C1)", "en"), ("Português nativo", "pt"), ("es", "es"), ("Klingon", "klingon"), ("", ""), (None, "")], T.language_code)
book.cases("skill_split", "a string, r string", [("Java; SQL (Oracle, Postgres), Go", "Java|SQL (Oracle, Postgres)|Go"), ("a,b", "a,b"), (" ; ", ""), ("x", "x")], lambda a: F.array_join(T.split_list(a), "|"))
book.cases("dehyphenate", "a string, r string", [("desa-\nrrollo de", "desa-\nrrollo de".replace("-\n", "")), ("ab-\ncde", "ab-\ncde"), ("gran-\nDeza", "gran-\nDeza")], T.dehyphenate)
book.cases("term_contains", "a string, b string, r boolean", [("worked with node js daily", "node js", True), ("node-js here", "node js", True), ("nodejs", "node", False), ("c++ and c", "c++", True), ("año", "a", False)], T.contains_term)
book.cases("note_filter", "a string, r boolean", [("a clear remark", True), ("short", False), ("deadbeef12 0a1b2c3d", False), ("12345678 90", False), ("abc123def456", False)], T.readable_note)
book.cases("hash_fnv", "a string, r long", [("", 2166136261), ("a", 3826002220), ("foobar", 3214735720)], T.fnv1a)
REF = dt.date(2024, 6, 15)
