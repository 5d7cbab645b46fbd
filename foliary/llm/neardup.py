"""Operator 7: near-duplicates by DartMinHash signatures, banded joining and exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.components import components
from foliary.llm.flat import blocks, copies, mix, shingles, word_hashes
from foliary.llm.scratch import NO_ID, keyed, materialize, packed

#: Coordinates in bands of rows: at a likeness of 0.8 a pair meets in no band with odds of 6e-5, at 0.5 in one with 0.39.
BANDS, ROWS = 32, 6
COORDS = BANDS * ROWS
THRESHOLD = 0.8
#: Rounds in which buckets compare with one member, before the rest is compared in full.
STAR_ROUNDS = 3
#: Nodes of a bucket that one task holds of either side, and their regions, about; columns of a matrix of regions.
BLOCK_NODES, BLOCK_REGIONS, COLUMNS = 512, 1 << 20, 2048
#: Bags that are alike differ in size by less than this factor.
SIZE_STEP = 1 / THRESHOLD + 1e-4


def regions(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each unit of weight: a 5-word shingle that comes c times owns regions 0 to c-1."""
    h, _, _, docs = word_hashes(data, offs)
    s, doc, _ = shingles(h, docs, len(offs) - 1)
    return mix(s + copies(doc, s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), doc


def dart_minhash(region: np.ndarray, doc: np.ndarray, n_docs: int, t: int = COORDS) -> np.ndarray:
    """(n_docs, t) keys of the earliest dart on each coordinate; documents without regions get zeros.

    A region's darts arrive at hashed exponential gaps and land on hashed coordinates. Only darts up to a rank of
    (t ln t + 2t) / weight are thrown, so about that many in all; documents with a bare coordinate go on with twice
    the rank. Equal regions get equal darts in every document, so two signatures agree on a coordinate with odds of
    their weighted Jaccard likeness.
    """
    out = np.zeros((n_docs, t), np.uint64)
    weight = np.bincount(doc, minlength=n_docs).astype(float)
    limit = np.divide(t * np.log(t) + 2 * t, weight, out=np.zeros(n_docs), where=weight > 0)
    todo = weight > 0
    while todo.any():
        mine = todo[doc]
        r, d = region[mine], doc[mine]
        rank, key = np.zeros(len(r)), r
        hits: list[tuple] = []
        while len(r):
            key = mix(key + np.uint64(0xA24BAED4963EE407))
            rank = rank - np.log(((key >> np.uint64(11)).astype(float) + 0.5) / 2**53)
            ok = rank <= limit[d]
            r, d, rank, key = r[ok], d[ok], rank[ok], key[ok]
            hits.append((d, rank, key))
        d, rank, key = (np.concatenate(x) for x in zip(*hits, strict=True))
        dart = mix(key ^ np.uint64(0x8CB92BA72F3D8DD7))
        cell = d * t + (dart % np.uint64(t)).astype(np.int64)
        order = np.lexsort((dart, rank))[::-1]
        flat = out.reshape(-1)
        flat[cell[order]] = dart[order] | np.uint64(1)  # the earliest is written last
        todo &= (out == 0).any(axis=1)
        limit = limit * 2
    return out


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash for each band of a document's signature, and its weight."""
    for batch in batches:
        for i, j, data, offs in blocks(batch.column("text")):
            region, doc = regions(data, offs)
            sig = dart_minhash(region, doc, j - i)
            bands = np.zeros((j - i, BANDS), np.uint64)
            for r in range(ROWS):  # band k has coordinates k, k + BANDS, ...
                bands = mix(bands * np.uint64(31) + sig[:, r * BANDS : (r + 1) * BANDS])
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
            weight = np.bincount(doc, minlength=j - i)
            at = np.where(weight > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(at)]).astype(np.int32)), pa.array(bands[weight > 0].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), batch.column("tie").slice(i, j - i), batch.column("same").slice(i, j - i), pa.array(weight), lists], ["id", "tie", "same", "weight", "bands"])


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted regions of each document, and their number."""
    for batch in batches:
        for i, j, data, offs in blocks(batch.column("text")):
            region, doc = regions(data, offs)
            order = np.lexsort((region, doc))
            n = np.bincount(doc, minlength=j - i)
            ends = np.concatenate([[0], np.cumsum(n)])
            region = region[order]
            raw = [region[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), pa.array(raw, pa.binary()), pa.array(n, pa.int64())], ["node", "regions", "n"])


def alike(x: bytes, y: bytes) -> bool:
    """Whether two bags of regions reach the threshold."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= THRESHOLD * (len(x) + len(y) - shared)


def shared_regions(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many regions each of the left bags shares with each of the right ones, by products of 0-1 matrices over
    the regions that both sides have, COLUMNS at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x])) for x in (left, right)]
    both = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    if left is right:
        v, n = np.unique(sides[0][0], return_counts=True)
        both = v[n > 1]
    if not len(both):
        return out
    coded = []
    for v, row in sides:
        code = np.minimum(np.searchsorted(both, v), len(both) - 1)
        hit = both[code] == v
        code, row = code[hit], row[hit]
        order = np.argsort(code, kind="stable")
        coded.append((code[order], row[order]))
    for at in range(0, len(both), COLUMNS):
        matrices = []
        for (code, row), n in zip(coded, out.shape, strict=True):
            a, b = np.searchsorted(code, (at, at + COLUMNS))
            x = np.zeros((n, min(COLUMNS, len(both) - at)), np.float32)
            x[row[a:b], code[a:b] - at] = 1
            matrices.append(x)
        out += matrices[0] @ matrices[1].T
    return out


def compare_block(rows: pa.Table) -> pa.Table:
    """Links between classes in a block of a bucket, or between two blocks of it; enough of them to join the classes.

    All pairs of the two blocks are compared, exactly.
    """
    names = rows.column("block").to_numpy()
    one, two = rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
    bags = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("regions")]
    nodes, roots = (rows.column(c).to_numpy() for c in ("node", "root"))
    left = np.flatnonzero(names == one)
    right = left if one == two else np.flatnonzero(names == two)
    out: list[tuple[int, int]] = []
    if len(left) and len(right) and len(np.unique(roots)) > 1:
        mine = [bags[i] for i in left]
        shared = shared_regions(mine, mine if one == two else [bags[i] for i in right])
        sizes = np.array([len(x) for x in bags], np.float64)
        near = shared >= THRESHOLD * (sizes[left][:, None] + sizes[right][None, :] - shared)
        near &= roots[left][:, None] != roots[right][None, :]
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            while (p := parent.get(v, v)) != v:
                parent[v] = v = parent.get(p, p)
            return v

        for i, j in zip(*np.nonzero(near), strict=True):
            u, v = find(int(roots[left[i]])), find(int(roots[right[j]]))
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((int(nodes[left[i]]), int(nodes[right[j]])))
    return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def compare_all(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join the classes of each bucket, from all of its pairs, block by block. Only links are rows.

    Bags whose sizes are so far apart that they can't be alike aren't compared: a bucket's members go by SIZE_STEP into
    classes of size, and blocks of a class meet blocks of that and of the next class alone. A block has some BLOCK_NODES
    members, or BLOCK_REGIONS regions if they are long.
    """
    rows = rows.join(sets.select("node", "n"), "node").withColumn("c", F.floor(F.log(F.col("n")) / F.lit(float(np.log(SIZE_STEP)))).cast("long"))
    least = F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n") / BLOCK_REGIONS)
    of_class = rows.groupBy("key", "c").agg(F.ceil(least).alias("blocks"))
    of_key = of_class.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("c", "blocks"))).alias("blocks"))
    rows = rows.join(of_key, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.element_at("blocks", F.col("c"))))
    name = lambda c, k: F.shiftleft(c, 32) + k
    own = name(F.col("c"), F.col("mine")).alias("block")
    others = lambda c: F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce(F.try_element_at("blocks", c), F.lit(0)) - 1, F.lit(1).cast("long")), lambda k: name(c, k))
    there = lambda c: F.when(F.try_element_at("blocks", c).isNotNull(), others(c)).otherwise(F.array().cast("array<long>"))
    mates = F.concat(*[there(F.col("c") + d) for d in (-1, 0, 1)])
    rows = rows.select("key", "node", "root", own, F.explode(mates).alias("mate"))
    rows = rows.select("key", "node", "root", "block", F.least("block", "mate").alias("one"), F.greatest("block", "mate").alias("two"))
    rows = rows.join(sets.select("node", "regions"), "node")
    return rows.groupBy("key", "one", "two").applyInArrow(compare_block, "a long, b long")


def likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose weighted Jaccard likeness reaches the threshold."""
    for batch in batches:
        ok = [alike(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["a", "b"])


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) pairs that are alike. Spark splits the partitions of a member that many pairs share."""
    pairs = pairs.select("a", "b").distinct()
    pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("regions").alias("y")), "b")
    pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("regions").alias("x")), "a")
    near = F.least(F.octet_length("x"), F.octet_length("y")) >= THRESHOLD * F.greatest(F.octet_length("x"), F.octet_length("y"))
    return pairs.where(near).select("a", "b", "x", "y").mapInArrow(likeness, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """(id, tie, rid, class) of each row: class is the least rid that exact copies and links of likeness lead to.

    Equal texts share a node, so copies never pair up. A node's 32 band hashes put it in buckets; buckets of several
    nodes compare all with one member (another one each round) by exact weighted Jaccard, and links merge classes.
    Buckets that then still hold several classes compare them in full, in blocks, and only links come out of it.
    """
    id_, tie = keyed(docs)
    same = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("same")
    texts = docs.select(id_, tie, same, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    signed = texts.mapInArrow(sign, "id long, tie long, same string, weight long, bands array<long>")
    signed = materialize(signed.withColumn("rid", F.monotonically_increasing_id()), "signed")
    blank = F.when(F.col("weight") == 0, F.lit("")).otherwise(F.col("same"))
    nodes = materialize(signed.groupBy(blank.alias("same")).agg(F.min("rid").alias("node")), "nodes")  # a table, so that Spark splits the join on a text of many copies
    member = signed.select("id", "tie", "rid", blank.alias("same")).join(nodes, "same").select("id", "tie", "rid", "node")
    member = materialize(member, "members")
    own = member.where("rid = node").select("rid")
    bands = signed.select("rid", F.posexplode("bands").alias("band", "key")).join(own, "rid", "left_semi")
    often = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets = materialize(bands.join(often, "key").select("key", "band", F.col("rid").alias("node")), "buckets")
    wanted = member.join(buckets.select(F.col("node").alias("rid")).distinct(), "rid", "left_semi").select("id", "tie", "node")
    sets = texts.select("id", "tie", "text").join(wanted, ["id", "tie"]).select("node", "text")
    sets = materialize(sets.mapInArrow(gather, "node long, regions binary, n long"), "regions")
    if sets.count() > wanted.count():  # rows equal in doc_id and text
        sets = materialize(sets.dropDuplicates(["node"]), "regions")
    links, roots = None, None
    for r in range(STAR_ROUNDS + 1):
        rows = buckets if roots is None else buckets.join(roots, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
        if roots is not None:
            open_ = rows.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p < q").select("key")
            rows = rows.join(open_, "key", "left_semi")
        else:
            rows = rows.withColumn("root", F.col("node"))
        rows = materialize(rows, "open")
        if not rows.head(1):
            break
        if r < STAR_ROUNDS:
            pick = F.min(F.struct(F.xxhash64("node", F.lit(r)), "node", "root"))
            centre = rows.groupBy("key").agg(pick.alias("c")).select("key", F.col("c.node").alias("c"), F.col("c.root").alias("cr"))
            pairs = rows.join(centre, "key").where("root <> cr").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))
            new = materialize(linked(pairs, sets), "links")
        else:
            new = materialize(compare_all(rows, sets), "links")
        links = new if links is None else links.unionByName(new)
        roots = components(links)
    if roots is None:
        return member.withColumn("class", F.col("node"))
    return member.join(roots, "node", "left").select("id", "tie", "rid", F.coalesce("root", "node").alias("class"))


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, keep) for each row of documents.

    class_id is the least doc_id of the class; one row of each class is kept, one with that id. Classes are the
    connected components of equal texts and of texts whose bags of 5-word shingles have a weighted Jaccard likeness of
    0.8 or more. Texts with 1 to 4 words are one shingle; texts without words, null among them, are one class. Null
    doc_ids count as the least number; equal rows are copies. A text of any length is one block of a task. No rows give no
    rows; other columns are ignored.
    """
    rows = materialize(classes(docs.select("doc_id", "text")), "classes")
    sizes = rows.groupBy("class").agg(F.min(F.struct("id", "rid")).alias("least"), F.count(F.lit(1)).alias("class_size"))
    rows = rows.join(sizes, "class")
    none = lambda c: F.when(c != NO_ID, c)
    return rows.select(none(F.col("id")).alias("doc_id"), none(F.col("least.id")).alias("class_id"), "class_size", (F.col("rid") == F.col("least.rid")).alias("keep"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """documents with one row of each class of near-duplicates: one with the least doc_id, its columns as they are.

    Of rows equal in doc_id and text any one stays. Null texts and texts without words are one class; a null doc_id is
    the least. Columns of any other name, those of the helpers among them, keep their values. No rows give no rows.
    """
    rows = materialize(classes(docs.select("doc_id", "text")), "classes")
    kept = rows.groupBy("class").agg(F.min(F.struct("id", "rid", "tie")).alias("x")).select("x.id", "x.tie")
    return packed(docs).join(kept, ["id", "tie"], "left_semi").dropDuplicates(["id", "tie"]).select("row.*")


#: DuckDB SQL for near_duplicate_classes over tables without repeated ids: all pairs that share a shingle, exactly.
ORACLE = r"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
g AS MATERIALIZED (SELECT doc_id, h, row_number() OVER (PARTITION BY doc_id, h) AS k FROM s),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.h = b.h AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)
  UNION ALL SELECT min(doc_id) OVER (), doc_id FROM d WHERE len(w) = 0),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT x.t, r.root FROM r JOIN (SELECT a AS f, b AS t FROM e UNION SELECT b, a FROM e) x ON x.f = r.doc_id WHERE r.root < x.t),
c AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY ALL)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS keep FROM c"""
