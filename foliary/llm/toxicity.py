"""Operator 6: toxicity by multiple-instance learning, sentences as instances."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliary.llm.flat import Rolling, blocks, mix, runs

#: Feature slots; byte lengths of word beginnings that are features beside whole words.
SLOTS, PREFIXES = 1 << 20, (4, 5, 6)
#: Bound of the labelled rows that the model is fitted on: those with the least hashes.
TRAIN_ROWS = 20_000
#: Features kept are in so many training documents at least, with class rates so many standard errors apart.
MIN_DOCS, MIN_Z = 3, 4.0
STEPS, RATE, DECAY = 400, 0.1, 2e-3
#: At a document score of this, a document counts as toxic; likewise a sentence as offending.
CUT = 0.5

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_wordy = np.zeros(256, bool)
_wordy[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ends = np.zeros(256, bool)
_ends[[0x0A, 0x21, 0x2E, 0x3F]] = True


def sentences(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each sentence. A document without one is one sentence by itself."""
    start, end, doc = runs(~_ends[data], offs)
    bare = np.setdiff1d(np.arange(len(offs) - 1), doc)
    if len(bare):
        start, end, doc = (np.concatenate(x) for x in ((start, offs[bare]), (end, offs[bare]), (doc, bare)))
        order = np.lexsort((start, doc))
        start, end, doc = start[order], end[order], doc[order]
    return start, end, doc


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slot and sentence of each feature, and start, end and document of each sentence."""
    low = _lower[data]
    start, end, _ = runs(_wordy[data], offs)
    roll = Rolling(low)
    s0, s1, doc = sentences(data, offs)
    # a sentence may be empty, and then starts where the next document does
    sent = np.searchsorted(s1, start, side="right") if len(s1) else start
    out, of = [], []
    for k in (0, *PREFIXES):
        stop = end if not k else start + k
        ok = stop <= end
        slot = mix(roll(start[ok], stop[ok]) + np.uint64(k + 1)) >> np.uint64(64 - 20)
        out.append(slot.astype(np.int64))
        of.append(sent[ok])
    return np.concatenate(out), np.concatenate(of), s0, s1, doc


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of either class have each feature, of all batches of a task."""
    n = np.zeros((2, SLOTS), np.int64)
    docs = np.zeros(2, np.int64)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for i, j, data, offs in blocks(batch.column("text")):
            slot, sent, _, _, doc = features(data, offs)
            seen = np.unique(doc[sent] * SLOTS + slot)
            y = toxic[i:j]
            docs += np.bincount(y, minlength=2)
            for c in (0, 1):
                n[c] += np.bincount(seen[y[seen // SLOTS] == c] % SLOTS, minlength=SLOTS)
    at = np.flatnonzero(n.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[0][at], docs[0])), pa.array(np.append(n[1][at], docs[1]))], ["slot", "n0", "n1"])


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(SLOTS, np.float32)
        out[self.slots] = self.weights
        return out

    def sentence_scores(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple:
        slot, sent, s0, s1, doc = features(data, offs)
        w = table[slot]
        hit = np.flatnonzero(w)
        pair = np.unique(sent[hit] * SLOTS + slot[hit])
        z = self.bias + np.bincount(pair // SLOTS, weights=table[pair % SLOTS], minlength=len(s0))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), s0, s1, doc

    def score(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batch with a score and the offending sentences' byte ranges for each row."""
        table = self.table()
        for batch in batches:
            scores, spans = [], []
            for i, j, data, offs in blocks(batch.column("text")):
                p, s0, s1, doc = self.sentence_scores(data, offs, table)
                scores.append(1 - np.exp(np.bincount(doc, weights=np.log1p(-p), minlength=j - i)))
                bad: list[list] = [[] for _ in range(j - i)]
                for k in np.flatnonzero(p >= CUT):
                    bad[doc[k]].append({"start": int(s0[k] - offs[doc[k]]), "end": int(s1[k] - offs[doc[k]]), "score": float(p[k])})
                spans += bad
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            cols = [*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "_score", "_offending"])


def fit(slots: np.ndarray, toxic: np.ndarray, n_sent: np.ndarray, doc: np.ndarray, sent: np.ndarray, slot: np.ndarray) -> Model:
    """Noisy-or likelihood by Adam. n_sent: sentences of each document; doc, sent, slot: kept features by sentence."""
    col = np.searchsorted(slots, slot)
    key, inst = np.unique(doc * (1 << 32) + sent, return_inverse=True)
    of = key >> 32
    plain = n_sent - np.bincount(of, minlength=len(n_sent))  # sentences without a kept feature
    theta = np.zeros(len(slots) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(inst, weights=theta[col], minlength=len(key))
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + np.exp(-theta[-1]))
        log_clean = np.bincount(of, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(n_sent)) + plain * np.log1p(-p0)
        clean = np.exp(log_clean)
        pull = np.where(toxic == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)  # d loss / d -log clean
        gz = p * pull[of]
        grad = np.append(np.bincount(col, weights=gz[inst], minlength=len(slots)), gz.sum() + (plain * p0 * pull).sum()) / len(n_sent)
        grad[:-1] += DECAY * theta[:-1] / len(slots)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        theta[-1] = min(theta[-1], -3.0)
    return Model(slots, theta[:-1], float(theta[-1]))


def fold(doc_id: Column) -> Column:
    """0 for held-out rows."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from labelled rows outside the held-out fold, at most `rows` of them, picked by hash of doc_id.

    The driver gets class counts of features (SLOTS at most) and the training rows' hits of the kept ones. A doc_id
    with several labels is toxic if one says so; null ids or labels don't count. Without toxic rows nothing is toxic.
    """
    sample = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id")) != 0)
    sample = sample.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("toxic", "text")
    counts = texts.mapInArrow(count_features, "slot long, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = counts.where((F.col("n0") + F.col("n1") >= MIN_DOCS) | (F.col("slot") < 0)).toPandas().sort_values("slot")
    total = table[table.slot < 0]
    d0, d1 = (float(total.n0.sum()), float(total.n1.sum()))
    table = table[table.slot >= 0]
    if not d1 or not d0:
        return Model(np.zeros(0, np.int64), np.zeros(0), 10.0 if d1 else -10.0)
    r0, r1, both = (table.n0 + 0.5) / (d0 + 1), (table.n1 + 0.5) / (d1 + 1), (table.n0 + table.n1 + 1) / (d0 + d1 + 2)
    z = (r1 - r0) / np.sqrt(both * (1 - both) * (1 / d0 + 1 / d1))
    slots = table.slot[np.abs(z) >= MIN_Z].to_numpy()

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(SLOTS, bool)
        keep[slots] = True
        for batch in batches:
            for i, j, data, offs in blocks(batch.column("text")):
                slot, sent, _, _, doc = features(data, offs)
                pair = np.unique(sent[keep[slot]] * SLOTS + slot[keep[slot]])
                at = doc[pair // SLOTS]
                cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=j - i))]).astype(np.int32))
                first = np.searchsorted(doc, np.arange(j - i))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (pair // SLOTS - first[at], pair % SLOTS)]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, j - i), pa.array(np.bincount(doc, minlength=j - i)), *lists], ["toxic", "n", "sent", "slot"])

    got = texts.mapInArrow(hits, "toxic int, n long, sent array<int>, slot array<int>").toPandas()
    got = got.iloc[np.lexsort((got.slot.map(len), got.n, got.toxic))]
    sizes = got.sent.map(len).to_numpy()
    flat = lambda c: np.concatenate([np.asarray(x, np.int64) for x in c]) if sizes.sum() else np.zeros(0, np.int64)
    return fit(slots, got.toxic.to_numpy(), got.n.to_numpy(), np.repeat(np.arange(len(got)), sizes), flat(got.sent), flat(got.slot))


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs and _score and _offending, by text alone."""
    more = StructType.fromDDL("_score double, _offending array<struct<start:long,end:long,score:double>>")
    schema = StructType([*docs.schema.fields, *more.fields])
    return docs.mapInArrow(model.score, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending) for each row of documents.

    A sentence's score is logistic in its words and word beginnings; a document's is the noisy-or of its sentences'.
    Texts alone are scored, so equal texts score alike; a null text scores as an empty one, which is one sentence
    without words. offending lists byte ranges of sentences that score CUT or more. A null doc_id is held out if the
    empty string is. No rows give no rows; other columns are ignored.
    """
    model = train(docs, labels)
    rows = with_scores(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"), F.col("_offending").alias("offending"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents that score under CUT, columns as they are, whatever their names.

    A null text scores as an empty one and stays null; equal texts go or stay together; a null doc_id has no label but is
    scored; a text of any length is scored as a whole, as one block of a task. No rows give no rows; without labels, or
    without toxic ones, all rows stay.
    """
    model = train(docs, labels)
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = f"c{docs.columns.index('text')}"
    rows = with_scores(plain.withColumnRenamed(text, "text"), model).where(F.col("_score") < CUT)
    return rows.withColumnRenamed("text", text).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
