"""Operator 3: document fingerprints from closed syncmers, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm.scratch import materialize

#: Letters of a text: single characters of scripts without spaces, and runs of up to 6 other ones between spaces.
LETTER = r"[\x{0E00}-\x{0EFF}\x{1100}-\x{11FF}\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]|[^\s\x{0E00}-\x{0EFF}\x{1100}-\x{11FF}\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]{1,6}"
#: Letters of a k-mer and of its inner substrings.
K, S = 5, 2


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def syncmers(text: Column) -> Column:
    """The text's anchors, as an array of (position of the k-mer's last letter, hash of the k-mer).

    A k-mer is a closed syncmer if the least hash of its substrings of S letters is the first or the last one's. It
    depends on the k-mer alone, so a k-mer that two texts share is an anchor in both or in neither. K-1 blank letters
    stand before a text, so that one of few letters has k-mers too; the first k-mer, all blanks but one, is an anchor.
    """
    m = K - S  # the last substring starts so much after the first

    def of_hashes(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))

        def of_inner(g: Column) -> Column:
            least = lambda i: F.least(*[F.get(g, i + j) for j in range(m + 1)])
            at = F.filter(F.sequence(F.lit(0), F.size(g) - m - 1), lambda i: (least(i) == F.get(g, i)) | (least(i) == F.get(g, i + m)))
            return F.transform(at, lambda i: F.struct(i.alias("at"), F.hash(F.get(g, i), F.get(g, i + 2), F.get(h, i + 4)).alias("h")))

        return F.when(F.size(h) < K, F.array().cast("array<struct<at:int,h:int>>")).otherwise(let(inner, of_inner))

    hashes = F.transform(F.regexp_extract_all(text, F.lit(LETTER), F.lit(0)), lambda x: F.xxhash64(x))
    return let(F.concat(F.array_repeat(F.lit(0).cast("long"), K - 1), hashes), of_hashes)


def written(anchors: Column) -> Column:
    """All anchors in order, as position:hash."""
    return F.array_join(F.transform(anchors, lambda x: F.concat_ws(":", x["at"], x["h"])), " ")


def links(anchors: Column) -> Column:
    """Each anchor with the distance to the next one and that one's hash, as a hash of them and of how many equal ones come before."""

    def ranked(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        end = lambda at, j: F.coalesce(F.get(at, j + 1), F.size(s)) - 1
        every = let(starts, lambda at: F.flatten(F.transform(at, lambda b, j: F.transform(F.sequence(b, end(at, j)), lambda i: F.xxhash64(F.get(s, b), i - b)))))
        return F.when(F.size(s) > 0, every).otherwise(F.array().cast("array<bigint>"))

    def linked(a: Column) -> Column:
        return F.sort_array(F.transform(a, lambda x, i: F.xxhash64(x["h"], F.get(a, i + 1)["at"] - x["at"], F.get(a, i + 1)["h"])))

    return let(let(anchors, linked), ranked)


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of all links, each as often as it occurs; 1 for two texts without any.

    A link is matched where both anchors recur at the same distance, so a passage is found wherever it stands.
    """
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / n).cast("double")


def neighbours(ids: DataFrame) -> DataFrame:
    """(id, tie, n, next_id, next_tie, copies): the distinct (id, tie) after each one, after the last the first.

    Ranges of the order go to partitions; each finds its own pairs, and the partitions' first rows, one for each,
    close the gaps.
    """
    rows = ids.groupBy("id", "tie", "n").agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    rows = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ids")
    firsts = rows.groupBy("part").agg(F.min_by(F.struct("id", "tie"), F.struct(F.col("id").isNotNull(), "id", "tie")).alias("first"))
    over = Window.orderBy("part")
    every = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(over), F.first("first").over(every)).alias("after"))
    w = Window.partitionBy("part").orderBy(*order)
    rows = rows.join(after, "part").withColumn("next", F.coalesce(F.lead(F.struct("id", "tie")).over(w), F.col("after")))
    return materialize(rows.select("id", "tie", "n", "copies", F.col("next.id").alias("next_id"), F.col("next.tie").alias("next_tie")), "neighbours")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The last quarter of a text's characters is replaced by as many from the beginning of the next document's, in
    ascending order of doc_id, null first, then of a hash of the text; the last one's next is the first. Of equal rows
    each but the last has the same text next. A null text is empty; a text without letters has an empty fingerprint, alike
    to such texts alone. No rows give no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text")).withColumn("n", F.length("text").cast("long"))
    near = neighbours(rows.select("id", "tie", "n"))
    repeated = near.where("copies > 1")
    has_copies = bool(repeated.head(1))
    texts = rows.dropDuplicates(["id", "tie"]) if has_copies else rows
    texts = texts.select("id", "tie", "text")
    quarter = F.floor(F.col("n") / 4).cast("int")
    steps = near.select("id", "tie", "n", "next_id", "next_tie", F.lit(1).cast("long").alias("times"))
    if has_copies:
        steps = steps.unionByName(repeated.select("id", "tie", "n", F.col("id").alias("next_id"), F.col("tie").alias("next_tie"), (F.col("copies") - 1).alias("times")))
    same = lambda a, b: F.col(a[0]).eqNullSafe(F.col(b[0])) & (F.col(a[1]) == F.col(b[1]))
    asked = steps.select(F.col("id").alias("i"), F.col("tie").alias("t"), "n", "next_id", "next_tie", "times")
    heads = texts.join(asked, same(("id", "tie"), ("next_id", "next_tie"))).select("i", "t", "n", "times", F.col("text").alias("next_text"))
    both = texts.join(heads, same(("id", "tie"), ("i", "t")))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n") - quarter).cast("int")), F.substring("next_text", F.lit(1), quarter))
    both = both.select("id", "n", "times", "text", "next_text", edited.alias("edited"))
    anchors = lambda c: syncmers(F.col(c))
    both = both.select("id", "n", "times", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), anchors("text").alias("own"), anchors("edited").alias("new"), anchors("next_text").alias("next_own"))
    both = both.select("id", "n", "times", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("new")).alias("edited_fingerprint"), *[links(F.col(c)).alias(c) for c in ("own", "new", "next_own")])
    both = both.select("id", "n", "times", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
    if has_copies:
        both = both.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return both.select(F.col("id").alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
