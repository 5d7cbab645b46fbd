"""Operator 2: chat formatting as a prefix tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.scratch import NO_ID, materialize, prefix_sums

CONTROL = r"\### Assistant: </turn> ok"
CONTROL_ROWS = [(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)]
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Characters that control strings need, and what stands for them inside roles and texts.
ESCAPES = (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"))
TRAINED = "assistant"


def escape(text: Column, also: tuple = ()) -> Column:
    for a, b in (*ESCAPES, *also):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: A colon would end a role.
ROLE_ESCAPE = ((":", "\\c"),)


def unescape(text: str) -> str:
    """One pass from the left, so that an escaped backslash never starts another escape."""
    parts, i = [], 0
    while (j := text.find("\\", i)) >= 0:
        parts += [text[i:j], {"\\": "\\", "h": "#", "l": "<", "c": ":"}[text[j + 1]]]
        i = j + 2
    return "".join(parts) + text[i:]


def turns(talks: DataFrame) -> DataFrame:
    """(conv, segment, head, body, trained, own, n): each turn in the template, conversations one by one in their order.

    own is a digest of the segment, n its characters, head and body those before and of the text.
    """
    rows = talks.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    body, head = escape(F.col("text")), F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPE), F.lit(MIDDLE))
    rows = rows.repartition(F.col("conv")).sortWithinPartitions("conv", "turn", "role", "text")
    rows = rows.select("conv", F.concat(head, body, F.lit(CLOSE)).alias("segment"), F.length(head).cast("long").alias("head"), F.length(body).cast("long").alias("body"), (F.col("role") == TRAINED).alias("trained"))
    return rows.withColumns({"own": F.unhex(F.sha2(F.col("segment").cast("binary"), 256)), "n": F.length("segment").cast("long")})


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a turn's place in its conversation, a digest of all turns so far, and the characters before it.

    One digest and two numbers are all that is kept of a conversation, which may span batches.
    """
    conv, at, position, digest = None, 0, 0, b""
    for batch in batches:
        out: list[tuple] = []
        for c, own, n in zip(*(batch.column(x).to_pylist() for x in ("conv", "own", "n")), strict=True):
            if c != conv:
                conv, at, position, digest = c, 0, 0, b""
            digest = hashlib.sha256(digest + own).digest()[:16]
            out.append((at, digest, position))
            at, position = at + 1, position + n
        more = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in KEPT), *more], [*KEPT, "at", "node", "position"])


KEPT = ("conv", "segment", "head", "body", "trained", "n")
TURNS = "conv long, segment string, head long, body long, trained boolean, n long, at long, node binary, position long"


class Tree(NamedTuple):
    """nodes: (node, run, at, segment, loss_start, loss_end, position, start), each once.
    runs: (run, start, end, ancestors). spans: (path, run, least, most, start, end). member: (conv, path)."""

    nodes: DataFrame
    runs: DataFrame
    spans: DataFrame
    member: DataFrame


def prefix_tree(talks: DataFrame) -> Tree:
    """Conversations that share their first turns, merged to a tree, and the tree written depth first. Tokens are characters.

    A node is a turn after certain earlier turns, named by a digest that goes on from its parent's. Distinct
    conversations, sorted by the lists of their nodes, are the depth-first order of the leaves; what each adds to those
    before it is a run, the end of its list, and runs one after another are the stream. Each node has the position id
    of its first character, which counts on from its parent's last, its place in the stream, and the interval of
    trained characters in its segment. It attends to its run from the run's start and to the run's ancestors, the
    intervals of the stream where its earlier turns stand (attention()). All tables grow with the turns, the spans with
    the places where paths branch: one for each run that a path goes through.
    """
    rows = materialize(turns(talks).mapInArrow(chained, TURNS), "turns")
    ends = materialize(rows.groupBy("conv").agg(F.max_by("node", "at").alias("leaf")), "ends")
    first = ends.groupBy("leaf").agg(F.min("conv").alias("conv"))
    paths = rows.select("conv", "at", "node").join(first, "conv").groupBy("conv", "leaf").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("path"))
    paths = paths.select("conv", "leaf", F.transform("path", lambda x: x["node"]).alias("path"))
    order = materialize(paths.repartitionByRange(F.col("path")).withColumn("part", F.spark_partition_id()), "paths")
    order = prefix_sums(order.withColumn("one", F.lit(1).cast("long")), [], "part", ["path"], "one", "path_no")
    order = materialize(order.select("conv", "leaf", "part", F.col("path_no").alias("path")), "order")

    steps = materialize(rows.select("conv", "at", "node", "n", "position").join(order.select("conv", "path", "part"), "conv"), "steps")
    owner = materialize(steps.groupBy("node").agg(F.min("path").alias("run")), "owners")
    steps = materialize(steps.join(owner, "node"), "steps")
    mine = steps.where("path = run")
    runs = materialize(mine.groupBy("run", "part").agg(F.sum("n").alias("n"), F.min("position").alias("from"), F.min("at").alias("least")), "runs")
    runs = materialize(prefix_sums(runs, [], "part", ["run"], "n", "start").select("run", "start", "n", "from"), "stream")
    spans = steps.groupBy("path", "run").agg(F.min("at").alias("least"), F.max("at").alias("most"), F.min("position").alias("p"), F.max(F.col("position") + F.col("n")).alias("q"))
    place = F.col("start") - F.col("from")
    spans = spans.join(runs.select("run", "start", "from"), "run").select("path", "run", "least", "most", (place + F.col("p")).alias("start"), (place + F.col("q")).alias("end"))
    spans = materialize(spans, "spans")
    above = spans.where("run < path").groupBy(F.col("path").alias("run")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ancestors"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    told = runs.join(above, "run", "left").select("run", "start", (F.col("start") + F.col("n")).alias("end"), F.coalesce("ancestors", none).alias("ancestors"))

    loss_end = F.when(F.col("trained"), F.col("head") + F.col("body")).otherwise(F.col("head"))
    nodes = rows.join(mine.select("conv", "at", "run"), ["conv", "at"]).join(runs.select("run", "start", "from"), "run")
    nodes = nodes.select("node", "run", "at", "segment", F.col("head").alias("loss_start"), loss_end.alias("loss_end"), "position", (F.col("start") + F.col("position") - F.col("from")).alias("start"))
    member = ends.join(order.select("leaf", "path"), "leaf").select("conv", "path")
    return Tree(materialize(nodes, "nodes"), told, spans, member)


def attention(tree: Tree) -> DataFrame:
    """nodes with ancestors: the intervals of the stream that a node attends to besides itself."""
    runs = tree.runs.select("run", F.col("start").alias("begin"), F.col("ancestors").alias("above"))
    own = F.when(F.col("start") > F.col("begin"), F.array(F.struct(F.col("begin").alias("start"), F.col("start").alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return tree.nodes.join(runs, "run").withColumn("ancestors", F.concat("above", own)).drop("begin", "above")


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose segments come in the stream's order; a conversation may span batches."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    state: list | None = None
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def close(s: list) -> None:
        out.append((s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]))

    for batch in batches:
        for conv, segment, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv", "segment", "loss_start", "loss_end")), strict=True):
            if state is None or conv != state[0]:
                if state is not None:
                    close(state)
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, _, text = segment.removeprefix(OPEN).removesuffix(CLOSE).partition(MIDDLE)
            state[1] += 1
            state[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            trained = unescape(segment[a:b])
            state[3] += len(trained)
            state[4].update(trained.encode())
            state[5] += len(segment)
        if out:
            yield flush()
    if state is not None:
        close(state)
        yield flush()


def chat_digests(talks: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) for each conversation.

    Each conversation is read back from the depth-first stream, through the intervals where its turns stand: the
    template's marks give role and text, the loss intervals the trained text. Rows of a conversation stand by turn,
    then role and text; a null role or text is empty; a null conv_id is a conversation; equal rows are turns of their
    own; equal conversations share all their nodes; a text of any length is one segment. No rows give no rows; other
    columns are ignored.
    """
    tree = prefix_tree(talks)
    seen = tree.member.join(tree.spans.select("path", "run", "least", "most"), "path").select("conv", "run", "least", "most")
    rows = seen.join(tree.nodes, "run").where("at >= least AND at <= most").select("conv", "start", "segment", "loss_start", "loss_end")
    rows = rows.repartition(F.col("conv")).sortWithinPartitions("conv", "start")
    rows = rows.mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return rows.withColumn("conv_id", F.when(F.col("conv_id") != NO_ID, F.col("conv_id")))


#: The same rows as op2 in DuckDB's SQL. The template adds 13 characters to a role and a text.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(14 + length(role) + length(text) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(regexp_replace(text, '[^\\#<]', '', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
