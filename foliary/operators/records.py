"""Operators over rows of documents, lines and scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions.lexicon import STOPWORDS
from foliary.functions.text import series_udf, unaccent


def _among(words: list[str]):
    return lambda t: t.isin(words)


def language_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """CLS4: the language whose stop words are hit most, if by 2 and a fifth of its hits at least; 5 tokens needed.

    Hits are counted in the row, so nothing is exploded or shuffled.
    """
    tokens = F.filter(F.split(unaccent(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9ñ]+"), lambda t: t != "")
    rows = docs.withColumn("_tokens", tokens)
    hits = [F.size(F.filter("_tokens", _among(words))).alias(f"{lang}_hits") for lang, words in STOPWORDS.items()]
    rows = rows.select("*", F.size("_tokens").alias("_n"), *hits).drop("_tokens")
    ranked = F.reverse(F.sort_array(F.array(*[F.struct(F.col(f"{x}_hits").alias("n"), F.lit(x).alias("l")) for x in STOPWORDS])))
    clear = (ranked[0]["n"] > 0) & (ranked[0]["n"] - ranked[1]["n"] >= F.greatest(F.lit(2.0), ranked[0]["n"] * 0.2)) & (F.col("_n") >= 5)
    return rows.withColumn("detected", F.when(clear, ranked[0]["l"])).drop("_n")


def numbered(rows: DataFrame, key: str, out: str = "k", per_range: int = 100_000) -> DataFrame:
    """AGG19: rows numbered from 1 by a numeric key, in ranges of it: no task sorts more than a range, whose count comes first.

    The cuts between ranges are quantiles, at most one for each per_range rows.
    """
    n = rows.count() // per_range
    cuts = sorted({c for c in rows.approxQuantile(key, [i / (n + 1) for i in range(1, n + 1)], 0.1 / (n + 1))}) if n else []
    rows = rows.withColumn("_range", sum((F.when(F.col(key) > c, 1).otherwise(0) for c in cuts), F.lit(0)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rows = rows.join(F.broadcast(base), "_range")  # a row a range
    return rows.withColumn(out, F.col("_base") + F.row_number().over(Window.partitionBy("_range").orderBy(key))).drop("_range", "_base")


def spread(rows: DataFrame, per_task: int = 5_000) -> DataFrame:
    """Rows dealt out to as many tasks as their number asks for: many rows of few bytes are one task's file, whatever is done to each."""
    return rows.repartition(rows.count() // per_task + 1)


def first_by(rows: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """AGG6-8: of rows with equal keys the first stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def loops(text: Column, window: int = 200, times: int = 3) -> Column:
    """AGG17: the last characters come several times without overlap."""
    tail = F.right(text, F.lit(window))
    return (F.length(text) >= window) & ((F.length(text) - F.length(F.replace(text, tail, F.lit("")))) / window >= times)


def constant_step(rows: DataFrame, keys: list[str], order: list[str], value: str, least: int = 3) -> DataFrame:
    """AGG15: groups whose values, in order, go on by one constant step other than zero."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = rows.withColumn("_step", F.col(value) - F.lag(value).over(w))
    out = step.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_step").alias("step"), F.max("_step").alias("_most"))
    return out.where((F.col("n") >= least) & (F.col("step") == F.col("_most")) & (F.col("step") != 0)).drop("_most")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """DM9: (key, pos, line)."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))


def spans(rows: DataFrame, key: str, heading: Column) -> DataFrame:
    """WIN1: each heading row with the position where its section ends."""
    w = Window.partitionBy(key)
    rows = rows.withColumn("_lines", F.count(F.lit(1)).over(w)).where(heading)
    return rows.withColumn("end", F.coalesce(F.lead("pos").over(w.orderBy("pos")), F.col("_lines")).cast("long")).drop("_lines")


def section_of(rows: DataFrame, key: str, heading: Column) -> DataFrame:
    """WIN2: the position of the last heading at or before each line."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(F.when(heading, F.col("pos")), ignorenulls=True).over(w))


def fit_budget(rows: DataFrame, key: str, budget: int) -> DataFrame:
    """WIN3: sections dropped, the largest first, until a document's characters fit."""
    rows = rows.withColumn("chars", F.length("line").cast("long"))
    total = F.sum("chars").over(Window.partitionBy(key))
    gone = F.coalesce(F.sum("chars").over(Window.partitionBy(key).orderBy(F.desc("chars"), "pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("dropped", total - gone > budget)


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """AGG1: an empty denominator counts 1 if the other error is 0, else 0."""
    p = F.when(tp + fp == 0, F.when(fn == 0, 1.0).otherwise(0.0)).otherwise(tp / (tp + fp))
    r = F.when(tp + fn == 0, F.when(fp == 0, 1.0).otherwise(0.0)).otherwise(tp / (tp + fn))
    f = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return [p.alias("prec"), r.alias("rec"), f.alias("f1")]


def counted(truth: Column, predicted: Column) -> list[Column]:
    n = lambda c: F.count_if(c).alias
    return [n(truth & predicted)("tp"), n(~truth & predicted)("fp"), n(truth & ~predicted)("fn")]


def nearest(anchors: DataFrame, rows: DataFrame, key: str, reach: int = 2) -> DataFrame:
    """JOI14: the qualifying row nearest to an anchor within reach: +1, -1, +2, -2. An equi-join on exploded offsets."""
    steps = F.array(*[F.struct(F.lit(s * d).alias("off"), F.lit(2 * d - (s > 0)).alias("rank")) for d in range(1, reach + 1) for s in (1, -1)])
    asked = anchors.select(key, F.col("pos").alias("anchor"), F.explode(steps).alias("s")).select(key, "anchor", (F.col("anchor") + F.col("s.off")).alias("pos"), F.col("s.rank").alias("rank"))
    hit = asked.join(rows, [key, "pos"])
    return hit.groupBy(key, "anchor").agg(F.min_by("pos", "rank").alias("pos"), F.min_by("line", "rank").alias("line"))


#: Beyond so many columns pairs are taken one by one, the likeliest first: a rule of the contract, not of speed.
MOST_COLUMNS = 16


def _likeliest_first(sims: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """The greatest entry left, at the lowest indices, takes its row and column out, again and again."""
    left, out = sims.copy(), []
    while left.size and left.max() >= threshold:
        i, j = divmod(int(left.argmax()), left.shape[1])
        out.append((i, j))
        left[i], left[:, j] = -np.inf, -np.inf
    return sorted(out)


def _greatest_total(sims: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Shortest augmenting paths over whole-number costs. Of equal totals, earlier rows get lower columns.

    Each row has a column of its own besides, which leaves it single. A likeness is a whole number of billionths,
    times more than all the ranks of columns, which only speak at a tie, could add up to.
    """
    n, m = sims.shape
    place = [(m + 1) ** (n - i) for i in range(n + 1)]
    cost = [[0] * (m + n) for _ in range(n)]
    closed = 2 * (n + 1) * 10**9 * place[0]
    for i in range(n):
        for j in range(m + n):
            if j < m:
                cost[i][j] = -(round(float(sims[i, j]) * 10**9) * place[0] + (m - j) * place[i + 1]) if sims[i, j] >= threshold else closed
            elif j != m + i:
                cost[i][j] = closed
    row_price, col_price, owner = [0] * n, [0] * (m + n), [-1] * (m + n)
    for start in range(n):
        far = {j: (cost[start][j] - row_price[start] - col_price[j], -1) for j in range(m + n)}
        done: dict[int, int] = {}
        while True:
            j = min((j for j in far if j not in done), key=lambda j: (far[j][0], j))
            done[j] = far[j][0]
            if owner[j] < 0:
                break
            i = owner[j]
            for k in far:
                if k not in done and (step := done[j] + cost[i][k] - row_price[i] - col_price[k]) < far[k][0]:
                    far[k] = step, j
        end = done[j]
        row_price[start] += end
        for k, d in done.items():
            if owner[k] >= 0:
                row_price[owner[k]] += end - d
            col_price[k] -= end - d
        while j >= 0:
            before = far[j][1]
            owner[j] = owner[before] if before >= 0 else start
            j = before
    return sorted((owner[j], j) for j in range(m) if owner[j] >= 0)


def assign(matrix: list[list[float]], threshold: float = 0.5) -> list[tuple[int, int]]:
    """AGG9: one-to-one pairs of a likeness of threshold or more and of the greatest total; ties to the lowest indices.

    A matrix of over MOST_COLUMNS columns is paired the likeliest first.
    """
    if not matrix or not matrix[0]:
        return []
    sims = np.asarray(matrix, np.float64)
    return _likeliest_first(sims, threshold) if sims.shape[1] > MOST_COLUMNS else _greatest_total(sims, threshold)


def assign_entries(pairs: DataFrame) -> DataFrame:
    """JOI8: (doc_id, t, p, sim) to the assigned (doc_id, t, p) of each document."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ts, ps = sorted(rows.t.unique()), sorted(rows.p.unique())
        sim = {(r.t, r.p): r.sim for r in rows.itertuples()}
        got = assign([[sim.get((t, p), 0.0) for p in ps] for t in ts])
        return pd.DataFrame([(rows.doc_id.iloc[0], ts[i], ps[j]) for i, j in got], columns=["doc_id", "t", "p"])

    return pairs.groupBy("doc_id").applyInPandas(run, "doc_id long, t long, p long")


def repair_json(text: str) -> str | None:
    """ARR3: the first object of a text; one that is cut ends after the last complete list or object inside it. Null if nothing is left."""
    import json
    import re

    text, opened, cuts = text[max(text.find("{"), 0) :], [], []
    for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}\[\]]', text, re.DOTALL):
        if m[0] in "{[":
            opened.append("}" if m[0] == "{" else "]")
        elif m[0] in "}]":
            if not opened or opened.pop() != m[0]:
                return None
            cuts.append(text[: m.end()] + "".join(reversed(opened)))
            if not opened:
                cuts = cuts[-1:]
                break
    for cut in reversed(cuts[-50:]):
        try:
            out = json.loads(cut)
        except ValueError:
            continue
        return json.dumps(out, ensure_ascii=False, separators=(",", ":")) if isinstance(out, dict) else None
    return None


def _canonical(t: str) -> str | None:
    """ARR4: keys sorted, no blanks, nulls kept; null for what isn't JSON."""
    import json

    try:
        return json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return None


repaired_json, canonical_json = series_udf(repair_json), series_udf(_canonical)
