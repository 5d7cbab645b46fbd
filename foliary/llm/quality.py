"""Operator 8: quality rules and robust multivariate outliers per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm.flat import SPACE, Rolling, blocks, copies, mix, runs, shingles, word_hashes
from foliary.llm.scratch import materialize, small

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_other")
#: Transformed statistics, and the least spread each is held to have, so that a constant one doesn't reject the rest.
DIMS = ("x_words", "x_word_len", "x_symbols", "x_dup_lines", "x_repeats", "x_other")
FLOORS = (0.5, 0.5, 0.05, 0.15, 0.15, 0.05)
P = len(DIMS)
#: Share of rows the covariance is fitted to; the factor that makes it consistent for normal data in P dimensions.
SUBSET, SCALE = 0.75, 1.36
C_STEPS = 4
#: Squared distance beyond which a row is an outlier; a chi-square of 6 degrees passes it with odds of 1e-6.
LIMIT = 38.26
#: Shares are taken as if a text had so many typical characters, words or lines more: a few marks in a short text
#: say little.
MORE_CHARS, MORE_WORDS, MORE_LINES, USUAL_LEN, USUAL_OTHER = 50, 20, 5, 5.0, 0.04
#: Rows that the wider group's estimate counts as in a group's own: with n rows, a group's own has the weight n / (n + PRIOR).
PRIOR = 100
#: A group's sums, and those of the next wider groups as "up_" and "top_".
MOMENTS = ("n", "sums", "products")

_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(192, 256)]] = True


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS of each text."""
    for batch in batches:
        for i, j, data, offs in blocks(batch.column("text")):
            n = j - i
            h, ws, we, docs = word_hashes(data, offs)
            per = lambda at: np.bincount(np.searchsorted(offs, at, side="right") - 1, minlength=n)
            lead = (data & 0xC0) != 0x80
            words = np.bincount(docs, minlength=n)
            chars = per(np.flatnonzero(lead & ~SPACE[data]))
            other = per(np.flatnonzero(lead & ~SPACE[data] & ~_letter[data]))
            ls, le, ld = runs(data != 10, offs)
            full = np.searchsorted(ws, ls, side="left") < np.searchsorted(ws, le, side="left")
            ls, le, ld = ls[full], le[full], ld[full]
            line = mix(Rolling(data, 1)(ls, le) + (le - ls).astype(np.uint64))
            dup = np.bincount(ld[copies(ld, line) > 0], minlength=n)
            # words of windows that come twice or more
            five = words[docs] >= 5
            sh, sd, at = shingles(h[five], docs[five], n)
            order = np.lexsort((sh, sd))
            d, v = sd[order], sh[order]
            same = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
            twice = np.zeros(len(d), bool)
            twice[1:] |= same
            twice[:-1] |= same
            starts = at[order][twice]
            edge = np.zeros(int(five.sum()) + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + 5, -1)
            repeat = np.bincount(docs[five][np.cumsum(edge[:-1]) > 0], minlength=n)
            cols = [words, chars, per(np.flatnonzero(_symbol[data])), dup, repeat, np.bincount(ld, minlength=n), other]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, n) for c in ("doc_id", "lang", "source")], *[pa.array(c.astype(np.int64)) for c in cols]], ["doc_id", "lang", "source", *COUNTS])


def moments(n: float, sums: list[float], products: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of n rows."""
    mean = np.asarray(sums) / n
    cov = np.zeros((P, P))
    cov[np.triu_indices(P)] = np.asarray(products) / n
    return mean, np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)


def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean and inverse covariance of each group, drawn to its wider groups' by PRIOR, from the sums of all."""
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            mean, cov = None, None
            for wide in ("top_", "up_", ""):
                if (n := r[f"{wide}n"]) is None:
                    continue
                own = moments(*[r[wide + c] for c in MOMENTS])
                w = n / (n + PRIOR) if mean is not None else 1.0
                mean, cov = (own[0], own[1]) if mean is None else (w * own[0] + (1 - w) * mean, w * own[1] + (1 - w) * cov)
            out.append((r["g"], mean, np.linalg.inv(cov * SCALE + np.diag(np.square(FLOORS)))[np.triu_indices(P)]))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(list(cols[1]), pa.list_(pa.float64())), pa.array(list(cols[2]), pa.list_(pa.float64()))], ["g", "mean", "inverse"])


def distance() -> Column:
    """Squared Mahalanobis distance by the columns mean and inverse."""
    d = [F.col(x) - F.col("mean")[i] for i, x in enumerate(DIMS)]
    out, k = F.lit(0.0), 0
    for i in range(P):
        for j in range(i, P):
            out = out + d[i] * d[j] * F.col("inverse")[k] * (1.0 if i == j else 2.0)
            k += 1
    return out


def transformed(rows: DataFrame) -> DataFrame:
    share = lambda a, b, more, usual=0.0: (F.col(a) + more * usual) / (F.col(b) + more)
    xs = (F.log1p("n_words"), share("word_chars", "n_words", MORE_WORDS, USUAL_LEN), F.sqrt(share("n_symbols", "word_chars", MORE_CHARS)), F.sqrt(share("n_dup_lines", "n_lines", MORE_LINES)), F.sqrt(share("n_repeat_words", "n_words", MORE_WORDS)), F.sqrt(share("n_other", "word_chars", MORE_CHARS, USUAL_OTHER)))
    return rows.withColumns({n: F.least(x, F.lit(50.0)) for n, x in zip(DIMS, xs, strict=True)})


def grouped(rows: DataFrame) -> DataFrame:
    """groups: (g, up) of language and source, of the language and of the whole corpus, each with the next wider one."""
    name = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    wider = [name("lang", "source"), name("lang"), F.lit("{}"), F.lit(None).cast("string")]
    return rows.withColumn("groups", F.array(*[F.struct(g.alias("g"), up.alias("up")) for g, up in zip(wider, wider[1:], strict=False)]))


def fitted(sums: DataFrame) -> tuple[DataFrame, int]:
    """(g, mean, inverse) of each group by its own and its wider groups' MOMENTS, and the number of groups."""
    sums = materialize(sums, "sums")
    wider = sums.join(sums.select(F.col("up").alias("g")).distinct(), "g", "left_semi")
    n, n_wider = sums.count(), wider.count()
    for prefix, up in (("up_", "up"), ("top_", "up_up")):
        as_wider = wider.select(F.col("g").alias(f"{prefix}g"), F.col("up").alias(f"{prefix}up"), *[F.col(c).alias(prefix + c) for c in MOMENTS])
        sums = sums.join(small(as_wider, n_wider), F.col(up) == F.col(f"{prefix}g"), "left")
    sums = sums.select("g", *[prefix + c for prefix in ("", "up_", "top_") for c in MOMENTS])
    return materialize(sums.mapInArrow(invert, "g string, mean array<double>, inverse array<double>"), "fits"), n


def covariances(rows: DataFrame) -> DataFrame:
    """(g, mean, inverse): the minimum-covariance-determinant estimate of each group, over all its rows.

    Each language and source has an estimate of its own, drawn to the language's, and that to the whole corpus', by as
    much as it has few rows (PRIOR): it changes smoothly as a group grows. It starts at medians and quartile ranges;
    each concentration step keeps the SUBSET of a group's rows that are the nearest and fits them anew. The cut comes
    from counts of distances in fine logarithmic bins, so no group is sorted or gathered. Every step is sums by group,
    joined back to the rows.
    """
    rows = rows.select(F.explode("groups").alias("_"), *DIMS).select("_.g", "_.up", *DIMS)
    start = rows.groupBy("g", "up").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in DIMS])
    spread = [F.pow((F.col(x)[2] - F.col(x)[0]) / 1.349, 2) / SCALE for x in DIMS]
    products = [F.col("n") * (F.col(DIMS[i])[1] * F.col(DIMS[j])[1] + (spread[i] if i == j else 0.0)) for i in range(P) for j in range(i, P)]
    fits, n_groups = fitted(start.select("g", "up", "n", F.array(*[F.col("n") * F.col(x)[1] for x in DIMS]).alias("sums"), F.array(*products).alias("products")))
    for _ in range(C_STEPS):
        near = rows.join(small(fits, n_groups), "g").select("g", "up", *DIMS, F.floor(F.log(distance() + 1e-6) * 256).cast("long").alias("bin"))
        bins = near.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("g")
        bins = bins.select("g", "bin", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(w).alias("all"))
        cut = bins.where(F.col("upto") >= SUBSET * F.col("all")).groupBy("g").agg(F.min("bin").alias("cut"))
        kept = near.join(small(cut, n_groups), "g").where("bin <= cut")
        products = [F.sum(F.col(DIMS[i]) * F.col(DIMS[j])) for i in range(P) for j in range(i, P)]
        sums = kept.groupBy("g", "up").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x) for x in DIMS]).alias("sums"), F.array(*products).alias("products"))
        fits, _n = fitted(sums)
    return fits


def judge_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) for each row.

    kept: the base rules hold and the row's transformed statistics lie within LIMIT of its group's robust centre.
    A null text has no words and so fails; null languages or sources make groups of their own; every row that holds the
    base rules gets a distance, the others none. Equal rows get equal verdicts. No rows give no rows; other columns are
    ignored.
    """
    rows = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(count, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = materialize(rows.withColumn("base_failed", failed), "counts")
    good = materialize(grouped(transformed(rows.where("not base_failed"))), "vectors")
    fits = covariances(good)
    far = good.withColumn("g", F.col("groups")[0]["g"]).join(small(fits, fits.count()), "g").withColumn("distance", distance())
    plain = ("doc_id", *COUNTS[:5], "base_failed")
    far = far.select(*plain, (F.col("distance") <= LIMIT).alias("kept"), "distance", "lang", "source")
    bad = rows.where("base_failed").select(*plain, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"), "lang", "source")
    return far.unionByName(bad)
