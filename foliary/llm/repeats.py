"""Operator 5: removal of strings that occur twice, by prefix-free parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.flat import Rolling, blocks, mix, word_hashes
from foliary.llm.scratch import discard, keyed, materialize, packed


@dataclass(frozen=True)
class Scale:
    """What counts as a repeat.

    length: units that a repeat has at least. words: units are words, else bytes. across: a repeat must come in two
    documents, else anywhere twice. gram: units that a trigger hashes, a power of two. reach: positions one trigger must
    fall in. chunk: starts that are compared at once before single ones.
    """

    length: int
    words: bool
    across: bool
    gram: int
    reach: int
    chunk: int

    @property
    def core(self) -> int:
        """A repeat's first trigger starts less than reach after it does, so these units from the trigger on are in it."""
        return self.length - self.reach


#: Strings of 400 bytes that come anywhere twice, and passages of 50 words that come in two documents.
BYTES = Scale(400, False, False, 16, 240, 16)
WORDS = Scale(50, True, True, 2, 32, 8)


def grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A scrambled 32-bit hash of the units of a gram at each position, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    step, k = 1, 0x9E3779B97F4A7C15
    while step < gram:
        h = h[:-step] * np.uint64(k) + h[step:]
        k = k * k % 2**64 | 1
        step *= 2
    return (mix(h) >> np.uint64(32)).astype(np.uint32)


def triggers(data: np.ndarray, scale: Scale = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where phrases start, and how far before each the starts of repeats it answers for lie, at least and at most.

    A trigger is a position whose rolling hash is the least (the rightmost such) of some reach positions; a repeat
    that starts at the first of them is that trigger's. The units of the repeat alone decide which one it is, so it is
    the same in every occurrence. Block minima from the left and the right give each window's least
    (hash, -position) in constant time.
    """
    if len(data) < scale.length:
        z = np.zeros(0, np.int64)
        return z, z, z
    reach, h = scale.reach, grams(data, scale.gram)
    n = len(h)
    v = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    m = -(-n // reach) * reach
    pad = np.full(m, np.uint64(2**64 - 1))
    pad[:n] = v
    rows = pad.reshape(-1, reach)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - reach + 1], left[reach - 1 : n])[: len(data) - scale.length + 1]
    at = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    at = at[first]
    return at, at - last, at - first


def contexts(data: np.ndarray, at: np.ndarray, least: np.ndarray, most: np.ndarray, scale: Scale) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each trigger's core, and of all that its repeats can touch."""
    core = mix(Rolling(data, 0)(at, at + scale.core))
    whole = Rolling(data, 1)(at - most, at - least + scale.length)
    return core, mix(whole + (least * 1000 + most).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def units(text: pa.StringScalar, scale: Scale) -> np.ndarray:
    """The units of one text."""
    data = np.frombuffer(text.as_buffer(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]))[0] if scale.words else data


def parse(scale: Scale) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each parse suffix that a repeat can start before: its truncated rank keys and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column("id").to_numpy(), batch.column("tie").to_numpy()
            for i, j, data, offs in blocks(batch.column("text")):
                if scale.words:
                    data, _, _, docs = word_hashes(data, offs)
                    offs = np.searchsorted(docs, np.arange(j - i + 1))
                found: list[tuple] = []
                for d in np.flatnonzero(np.diff(offs) >= scale.length):
                    t, least, most = triggers(data[offs[d] : offs[d + 1]], scale)
                    found.append((t + offs[d], least, most, np.full(len(t), d)))
                if not found:
                    continue
                at, least, most, doc = (np.concatenate(x) for x in zip(*found, strict=True))
                core, whole = contexts(data, at, least, most, scale)
                place = (at - offs[doc]) << 20 | least << 10 | most
                cols = [core.view(np.int64), whole.view(np.int64), ids[i + doc], ties[i + doc], place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["core", "whole", "id", "tie", "place"])

    return run


def _seeds(column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    """The seeds of each row, as arrays by field."""
    flat = column.flatten()
    fields = {f.name: flat.field(f.name).to_numpy() for f in column.type.value_type}
    ends = np.concatenate([[0], np.cumsum([len(x) for x in column])])
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield {k: v[a:b] for k, v in fields.items()}


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of whole numbers, the range and the number of each of their members."""
    n = np.maximum(0, last - first + 1)
    w = np.repeat(np.arange(len(n)), n)
    return w, first[w] + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)


def chunk_keys(scale: Scale) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For contexts that differ around an equal core, by chunks of starts: a hash of the units that all the starts'
    strings share, and one of all the units that any of them has."""
    names = ["core", "whole", "chunk", "weak", "strong", "n", "low", "high", "id", "tie", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for text, s, id_, tie in zip(batch.column("text"), _seeds(batch.column("seeds")), batch.column("id").to_numpy(), batch.column("tie").to_numpy(), strict=True):
                data = units(text, scale)
                roll = Rolling(data, 1)
                at, least, most = s["place"] >> 20, s["place"] >> 10 & 1023, s["place"] & 1023
                w, chunk = _spread(least // scale.chunk, most // scale.chunk)
                lo, hi, a = chunk * scale.chunk, chunk * scale.chunk + scale.chunk - 1, at[w]
                weak = mix(roll(a - lo, a - hi + scale.length) + chunk.astype(np.uint64))
                b, e = np.maximum(0, a - hi), np.minimum(len(data), a - lo + scale.length)
                strong = mix(roll(b, e) + ((a - b) * 1000 + (e - a)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                for c, x in zip(out, (s["core"][w], s["whole"][w], chunk, weak.view(np.int64), strong.view(np.int64), s["n"][w], s["low"][w], s["high"][w], np.full(len(w), id_), np.full(len(w), tie), s["place"][w]), strict=True):
                    c.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    return run


def start_keys(scale: Scale) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For chunks that differ though they share what all their starts do: the hash of the string of each start."""
    names = ["core", "strong", "before", "h", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for text, s in zip(batch.column("text"), _seeds(batch.column("seeds")), strict=True):
                roll = Rolling(units(text, scale), 1)
                at = s["place"] >> 20
                least = np.maximum(s["place"] >> 10 & 1023, s["chunk"] * scale.chunk)
                most = np.minimum(s["place"] & 1023, s["chunk"] * scale.chunk + scale.chunk - 1)
                w, before = _spread(least, most)
                h = mix(roll(at[w] - before, at[w] - before + scale.length) + before.astype(np.uint64))
                for c, x in zip(out, (s["core"][w], s["strong"][w], before, h.view(np.int64), s["low"][w], s["high"][w]), strict=True):
                    c.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    return run


def remove(scale: Scale) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Take the covered ranges out of each text. A range of words goes with the blanks between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            kept = []
            for text, spans in zip(batch.column("text"), _seeds(batch.column("spans")), strict=True):
                raw = memoryview(text.as_buffer())
                order = np.argsort(spans["lo"], kind="stable")
                lo, hi = spans["lo"][order], np.maximum.accumulate(spans["hi"][order])
                first = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]])) if len(lo) else np.zeros(0, np.int64)
                lo, hi = lo[first], hi[np.append(first[1:], len(hi)) - 1] if len(hi) else hi
                gone = int((hi - lo).sum())
                if scale.words:
                    data = np.frombuffer(raw, np.uint8)
                    _, starts, ends, _ = word_hashes(data, np.array([0, len(data)]))
                    lo, hi = starts[lo], ends[hi - 1]
                edges = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                kept.append(rest.decode("utf-8", "replace"))
                for c, x in zip(out, (len(raw), len(raw) - len(rest), len(lo), gone, hashlib.sha256(rest).hexdigest()), strict=True):
                    c.append(x)
            cols = [batch.column("id"), batch.column("tie"), *[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "tie", "n_bytes", "n_removed", "n_spans", "n_units", "kept_sha256", "kept"])

    return run


def repeated_spans(docs: DataFrame, scale: Scale = BYTES) -> DataFrame:
    """(id, tie, spans): for each text with repeats, ranges of units whose union is what repeats cover.

    Rolling-hash triggers cut texts into phrases so that a repeated string holds the same triggers wherever it is.
    Its first trigger lies less than reach units in, so both occurrences meet at suffixes of the parse that start
    there and share a core. The corpus order of suffixes is needed only to the depth of one repeat, so the sort of
    the parse is truncated to that depth and done by hash: suffixes with the same core share a rank. Where all that a
    trigger's repeats can touch is equal in two places, every start is a repeat. Else the core's distinct contexts are
    compared a chunk of starts at a time, and where chunks share only a part, start by start; one place stands for all
    that are equal so far. low and high are the least and greatest document of a class, so a class lies in two
    documents if they differ. Joins on a core that many places share read tables, whose partitions Spark splits.
    """
    id_, tie = keyed(docs)
    texts = docs.select(id_, tie, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") >= (2 * scale.length - 1 if scale.words else scale.length))
    one, n, doc = F.min(F.struct("id", "tie", "place")).alias("one"), F.count(F.lit(1)).alias("n"), F.xxhash64("id", "tie")
    ends = lambda low, high: [F.min(low).alias("low"), F.max(high).alias("high")]
    twice: Column = F.col("low") < F.col("high") if scale.across else F.col("n") > 1
    differ = lambda c: [F.min(c).alias("a"), F.max(c).alias("b")]
    by_text = lambda rows, *cols: texts.join(rows.groupBy("id", "tie").agg(F.collect_list(F.struct(*cols)).alias("seeds")), ["id", "tie"])

    suffixes = materialize(texts.mapInArrow(parse(scale), "core long, whole long, id long, tie long, place long"), "parse")
    often = materialize(suffixes.groupBy("core").agg(n, *ends(doc, doc)).where(twice).select("core"), "cores")
    seeds = materialize(suffixes.join(often, "core"), "seeds")
    discard(suffixes, often)
    classes = materialize(seeds.groupBy("core", "whole").agg(n, *ends(doc, doc), one), "contexts")
    mixed = materialize(classes.groupBy("core").agg(*differ("whole")).where("a < b").select("core", F.lit(True).alias("mixed")), "mixed")
    asked = by_text(classes.join(mixed, "core", "left_semi").select("core", "whole", "n", "low", "high", "one.*"), "core", "whole", "place", "n", "low", "high")
    chunks = asked.select("text", "seeds", "id", "tie").mapInArrow(chunk_keys(scale), "core long, whole long, chunk long, weak long, strong long, n long, low long, high long, id long, tie long, place long")
    chunks = materialize(chunks, "chunks")
    alike = materialize(chunks.groupBy("core", "chunk", "weak", "strong").agg(F.sum("n").alias("n"), *ends("low", "high"), one), "alike")
    partly = materialize(alike.groupBy("core", "chunk", "weak").agg(*differ("strong")).where("a < b").select("core", "chunk", "weak"), "partly")
    asked = by_text(alike.join(partly, ["core", "chunk", "weak"]).select("core", "chunk", "strong", "low", "high", "one.*"), "core", "chunk", "strong", "low", "high", "place")
    starts = materialize(asked.select("text", "seeds").mapInArrow(start_keys(scale), "core long, strong long, before long, h long, low long, high long"), "starts")
    same = starts.groupBy("core", "before", "h").agg(*differ("strong"), *ends("low", "high")).where("a < b")
    same = materialize((same.where("low < high") if scale.across else same).select("core", "before", "h"), "same")
    found = materialize(starts.join(same, ["core", "before", "h"]).groupBy("core", "strong").agg(F.min("before").alias("l"), F.max("before").alias("m")), "found")

    lo, hi = F.col("chunk") * scale.chunk, F.col("chunk") * scale.chunk + (scale.chunk - 1)
    lone = chunks.where(~twice).select("core", "whole", "strong", lo.alias("l"), hi.alias("m"))
    full = lone.join(alike.where(twice).select("core", "strong"), ["core", "strong"]).select("core", "whole", "l", "m")
    some = lone.drop("l", "m").join(found, ["core", "strong"]).select("core", "whole", "l", "m")
    every = classes.where(twice).select("core", "whole", F.lit(0).cast("long").alias("l"), F.lit(scale.reach).cast("long").alias("m"))
    good = materialize(every.unionByName(full).unionByName(some).groupBy("core", "whole").agg(F.min("l").alias("l"), F.max("m").alias("m")), "good")
    discard(classes, mixed, chunks, alike, partly, starts, same, found)
    place = F.col("place")
    least = F.greatest("l", F.shiftright(place, 10).bitwiseAND(F.lit(1023)))
    most = F.least("m", place.bitwiseAND(F.lit(1023)))
    spans = seeds.join(good, ["core", "whole"]).select("id", "tie", F.shiftright(place, 20).alias("at"), least.alias("l"), most.alias("m"))
    spans = spans.select("id", "tie", (F.col("at") - F.col("m")).alias("lo"), (F.col("at") - F.col("l") + scale.length).alias("hi"))
    spans = materialize(spans.groupBy("id", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    discard(seeds, good)
    return spans


def _cut(docs: DataFrame, scale: Scale) -> DataFrame:
    """(id, tie, n_bytes, n_removed, n_spans, n_units, kept_sha256, kept) of the texts that have repeats, once each."""
    spans = repeated_spans(docs, scale)
    id_, tie = keyed(docs)
    texts = docs.select(id_, tie, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(spans, ["id", "tie"]).select("id", "tie", "text", "spans").mapInArrow(remove(scale), "id long, tie long, n_bytes long, n_removed long, n_spans long, n_units long, kept_sha256 string, kept string")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, passage_words) for each row of documents.

    Every byte of a 400-byte string that also starts elsewhere, in any document or the same one, goes; strings are
    judged on the input. passage_words are the words in passages of 50 words or more that another document has too,
    whatever their bytes; they don't touch the other columns.

    A null text is empty; shorter texts stay whole; equal texts of 400 bytes or more go altogether; rows equal in doc_id
    and text count as separate occurrences of bytes, but as one document of passages. A text of any length is one block
    of a task, with some 60 bytes of memory a byte. No rows give no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    id_, tie = keyed(docs)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    plain = docs.select("doc_id", id_, tie, F.octet_length(text).cast("long").alias("n"), F.sha2(text, 256).alias("sha"))
    passages = materialize(_cut(docs, WORDS).select("id", "tie", F.col("n_units").alias("passage_words")), "passages").dropDuplicates(["id", "tie"])
    cut = materialize(_cut(docs, BYTES).drop("kept", "n_bytes", "n_units"), "cut").dropDuplicates(["id", "tie"])
    rows = plain.join(cut, ["id", "tie"], "left").join(passages, ["id", "tie"], "left")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", F.col("n").alias("n_bytes"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("passage_words", zero).alias("passage_words"))


def without_repeats(docs: DataFrame, scale: Scale = WORDS) -> DataFrame:
    """documents with repeats cut out of text and n_chars counted anew; other columns and rows as they are.

    With the default, passages of 50 words or more that come in two documents go from all of them; a passage that
    comes only within one document stays. A null text stays null and has no repeats; shorter texts stay whole; rows equal
    in doc_id and text are one document; a text may become empty, its row stays. Bytes that a cut leaves of a
    split character become U+FFFD. Columns of any other name, those of the helpers among them, keep their values. Texts
    without blanks are few long words: BYTES finds their repeats. No rows give no rows.
    """
    cut = materialize(_cut(docs.select("doc_id", "text"), scale).select("id", "tie", "kept"), "cut").dropDuplicates(["id", "tie"])
    rows = packed(docs).join(cut, ["id", "tie"], "left")
    hit, row = F.col("kept").isNotNull(), F.col("row")
    changed = row.withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
    return rows.select(F.when(hit, changed).otherwise(row).alias("row")).select("row.*")


#: DuckDB SQL for repeat_digests, for small tables: every string of 400 bytes and every 50 words by themselves.
ORACLE = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, md5(array_slice(b, i + 1, i + 400)) AS h FROM (SELECT r, b, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM s) WHERE c > 1),
g AS (SELECT r, i, sum(far) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS far FROM t)),
u AS (SELECT r, run, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY ALL),
k AS (SELECT r, lag(hi, 1, 0) OVER (PARTITION BY r ORDER BY lo) AS a, lo AS z FROM u UNION ALL SELECT r, max(hi), NULL FROM u GROUP BY r),
c AS (SELECT k.r, sha256(unhex(string_agg(hex(array_slice(b, a + 1, coalesce(z, n))), '' ORDER BY a))) AS kept FROM k JOIN d USING (r) WHERE a < coalesce(z, n) GROUP BY k.r),
m AS (SELECT r, sum(hi - lo)::BIGINT AS gone, count(*)::BIGINT AS runs FROM u GROUP BY r),
p AS (SELECT r, i, md5(array_to_string(w[i:i + 49], ' ')) AS h, md5(doc_id || ' ' || hex(b)) AS doc FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
q AS (SELECT r, i FROM (SELECT r, i, min(doc) OVER (PARTITION BY h) < max(doc) OVER (PARTITION BY h) AS hit FROM p) WHERE hit),
v AS (SELECT r, sum(least(50, coalesce(after, i + 50) - i))::BIGINT AS words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM q) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(runs, 0) AS n_spans, CASE WHEN gone IS NULL THEN sha256(b) ELSE coalesce(kept, sha256(''::BLOB)) END AS kept_sha256, coalesce(words, 0) AS passage_words
FROM d LEFT JOIN m USING (r) LEFT JOIN c USING (r) LEFT JOIN v USING (r)"""
