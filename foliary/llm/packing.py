"""Operator 10: mixture-controlled packing by deficit round-robin over source queues."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm.scratch import bucket_of, hash31, materialize, prefix_sums, small

WINDOW, END_ID = 2048, 1
RANGE_ROWS, MAX_RANGES = 256, 4096
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids, the same as the tokenizers library gives for the file with add_special_tokens=False.

    Beside a byte-level vocabulary of the same name as tiktoken ranks, that library encodes, for it is several times
    as fast; a test holds the two together. Without such a file the tokenizers library does it.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
    if not special:
        return fast.encode_ordinary
    return lambda text: fast.encode(text, allowed_special="all") if any(s in text for s in special) else fast.encode_ordinary(text)


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, tie, n, ids): little-endian ids of 2 bytes each, or 4 where one needs them, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, ids = [], []
                for text in part.column("text").to_pylist():
                    x = np.array(encode(text or "") + [END_ID], "<u4")
                    n.append(len(x))
                    ids.append(x.astype("<u2").tobytes() if x.max() < 65536 else x.tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("tie"), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "tie", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64("text").alias("tie"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, source string, tie long, n long, ids binary")


def shared_out(lo: np.ndarray, hi: np.ndarray, first: np.ndarray, end: np.ndarray, total: int, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """The pieces of runs of queue tokens in windows: run, start in it, length, window, offset there.

    Queues lie beside each other in a stack of `total` tokens; one's tokens are lo to hi of it, and a run is its tokens
    first to end, counted from lo. The stack is halved again and again until a single window is left. The first half's
    windows get so many of each queue's first tokens as is their share of all, to the token: a stack height of C is
    rounded to C * share. So either half is full, no queue gets less than nothing or more than it has, and what rounding
    leaves over is the deficit that the other half and then all windows in it carry. A full window has each queue's part
    of all tokens within 3, wherever it is; a run's pieces depend on its own queue's heights alone.
    """
    run = np.arange(len(lo))
    start = np.zeros(len(lo), np.int64)
    a, b = np.zeros(len(lo), np.int64), np.full(len(lo), -(-total // window), np.int64)
    done = []
    while len(run):
        leaf = b - a == 1
        done.append([x[leaf] for x in (run, start, end - first, a, lo + first)])
        run, start, first, end, lo, hi, a, b = (x[~leaf] for x in (run, start, first, end, lo, hi, a, b))
        middle = (a + b) >> 1
        share = (middle - a) * window / (np.minimum(b * window, total) - a * window)
        low, high = (np.floor(x * share + 0.5).astype(np.int64) for x in (lo, hi))
        mine = high - low
        left, right = first < mine, end > mine
        over = np.maximum(first, mine)
        one = [x[left] for x in (run, start, first, np.minimum(end, mine), low, high, a, middle)]
        two = [x[right] for x in (run, start + over - first, over - mine, end - mine, lo - low, hi - high, middle, b)]
        run, start, first, end, lo, hi, a, b = (np.concatenate(x) for x in zip(one, two, strict=True))
    out = [np.concatenate(x) for x in zip(*done, strict=True)]
    order = np.lexsort((out[1], out[0]))
    return tuple(x[order] for x in out)


def cut(total: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cut each document where its queue's part of a window ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, before, lo, hi = (batch.column(c).to_numpy() for c in ("n", "before", "lo", "hi"))
            doc, start, length, seq, offset = shared_out(lo, hi, before, before + n, total)
            ids = [memoryview(np.frombuffer(raw.as_buffer(), "<u2" if len(raw.as_buffer()) == 2 * k else "<u4").astype("<u4").tobytes()) for raw, k in zip(batch.column("ids"), n.tolist(), strict=True)]
            crc = [zlib.crc32(ids[d][4 * s : 4 * (s + k)]) for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            cols = [batch.column("doc_id").take(pa.array(doc)), *[pa.array(x, pa.int64()) for x in (start, length, crc, n[doc], seq, offset)]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The pieces of all documents in sequences of WINDOW tokens, each filled to every source's share of all tokens.

    Deficit round-robin in a closed form: a source's documents queue up in the order of a hash of doc_id, and each
    window takes from each queue what its share of a window is, in whole tokens, while deficits carry on to other
    windows (shared_out). A document's pieces follow from its place in its queue and the sizes of the queues, so no task
    walks a queue: prefix sums by ranges of the hash give the places. Only the last sequence is padded. A document is
    cut wherever its queue's part of a window ends, so many sources or small ones make short pieces.

    A null text is empty and yields the end id alone; a null source is a queue; a null doc_id stays null; equal rows
    are packed as often as they come; a text of any length is encoded as a whole and cut freely. No rows give no rows;
    other columns are ignored.
    """
    path = path or vocabulary()
    rows = materialize(tokenize(docs, path).withColumn("rid", F.monotonically_increasing_id()), "tokens")
    queues = materialize(rows.groupBy("source").agg(F.sum("n").alias("queue_n"), F.count(F.lit(1)).alias("rows")), "queues")
    tokens, n_queues = queues.agg(F.sum("queue_n"), F.count(F.lit(1))).first()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    queues = queues.select(F.col("source").alias("_s"), F.row_number().over(by_name).alias("queue"), F.sum("queue_n").over(by_name.rowsBetween(Window.unboundedPreceding, 0)).alias("hi"), "queue_n", F.least(F.lit(MAX_RANGES), F.ceil(F.col("rows") / RANGE_ROWS)).cast("long").alias("ranges"))
    line = rows.drop("ids").join(small(queues, n_queues), F.col("source").eqNullSafe(F.col("_s"))).withColumn("lo", F.col("hi") - F.col("queue_n"))
    line = line.withColumn("h", hash31(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("queue")))
    line = line.withColumn("range", bucket_of(F.col("h"), F.col("ranges"))).select("rid", "doc_id", "tie", "n", "h", "range", "queue", "lo", "hi")
    line = prefix_sums(materialize(line, "line"), ["queue"], "range", ["h", "doc_id", "tie", "rid"], "n", "before")
    return rows.select("rid", "doc_id", "n", "ids").join(line.select("rid", "before", "lo", "hi"), "rid").mapInArrow(cut(tokens or 0), PIECE)
