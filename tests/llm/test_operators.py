"""Operators on awkward tables, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from foliary.llm.chat import CONTROL_ROWS, attention, chat_digests, prefix_tree
from foliary.llm.fingerprints import edited_likeness
from foliary.llm.mixing import mix_sources, mixed_documents
from foliary.llm.neardup import COORDS, compare_block, near_duplicate_classes, without_near_duplicates
from foliary.llm.packing import encoder, pack_documents, shared_out, vocabulary
from foliary.llm.quality import judge_documents
from foliary.llm import repeats
from foliary.llm.repeats import repeat_digests, without_repeats
from foliary.llm.sharding import shard_documents
from foliary.llm.toxicity import score_documents, without_toxic
from foliary.llm.urls import judge_pages, possible, spam_urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, tie long, size long, _key string, c0 string, node long, class long"
WORDS = " ".join(f"word{i * 7919 % 1000}" for i in range(300))
TEXTS = ["", None, " \n\t ", "a", "one two three", WORDS, WORDS, WORDS.replace("word7 ", "edited "), WORDS[100:900] + " tail " + "x" * 50, "é" * 900, "ab" * 600, "\n".join(["same line here"] * 40), "<|endoftext|> special", "日本語の文章です。" * 60]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, [None, "a", "b", ""][i % 4], len(t or ""), i, i, i, "k", "c", i, i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], rows[5], rows[0]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (mix_sources, mixed_documents, shard_documents, pack_documents, repeat_digests, without_repeats, near_duplicate_classes, without_near_duplicates, judge_documents, edited_likeness):
        assert f(none).collect() == [], f
    assert score_documents(none, labels).collect() == []
    assert without_toxic(none, labels).collect() == []
    assert judge_pages(spark.createDataFrame([], "page_id long, url string, key string")).collect() == []
    assert chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_mixing(docs):
    got = mix_sources(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        x = by.setdefault(r.source, [r.source_size, r.target, 0])
        x[2] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert sum(x[0] for x in by.values()) == pytest.approx(sum(x[1] for x in by.values()))
    assert all(abs(x[1] - x[2]) <= 0.5 for x in by.values())
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in texts(mixed_documents(docs)))
    assert words == sum(r.taken for r in got)
    assert mixed_documents(docs).columns == docs.columns


def test_sharding(docs):
    got = shard_documents(docs).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts(docs))
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_packing(docs):
    import numpy as np
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary())
    want = Counter()
    for i, t in texts(docs):
        ids = slow.encode(t, add_special_tokens=False).ids
        assert ids == list(encoder(vocabulary())(t))
        want[i, zlib.crc32(np.array(ids + [1], "<u4").tobytes())] += 1
    got = pack_documents(docs).collect()
    total = sum(r.length for r in got)
    assert {r.sequence_id for r in got} == set(range(-(-total // 2048)))
    assert sorted(r.sequence_id * 2048 + r.offset for r in got) == [0, *np.cumsum([r.length for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))])[:-1]]
    assert Counter((r.doc_id, r.ids_crc32) for r in got if r.length == r.doc_tokens) <= want
    assert sum(r.doc_tokens for r in got if r.start == 0) == total


@pytest.mark.parametrize("sizes", [[5], [9000, 1], [700_000, 70_000, 69_000, 3, 1], [2048 * 3 + 1, 2048, 77], list(range(1, 300))])
def test_packing_of_queues(sizes):
    """Against a plain walk over the windows: every token once, windows full and near each queue's share."""
    import numpy as np

    total, ends = sum(sizes), np.cumsum(sizes)
    runs = []  # (queue, first, end): documents of up to 5,000 tokens
    for q, n in enumerate(sizes):
        at = 0
        while at < n:
            k = min(n - at, 1 + (at * 7919 + q * 31) % 5000)
            runs.append((q, at, at + k))
            at += k
    q, first, end = (np.array(x) for x in zip(*runs, strict=True))
    run, start, length, seq, offset = shared_out(ends[q] - np.array(sizes)[q], ends[q], first, end, total)
    assert (np.bincount(run, weights=length) == end - first).all()
    new = np.append(True, run[1:] != run[:-1])
    assert (start[new] == 0).all() and (start[~new] == (start + length)[:-1][~new[1:]]).all()
    place = np.sort(seq * 2048 + offset)
    order = np.argsort(seq * 2048 + offset)
    assert (place == np.append(0, np.cumsum(length[order])[:-1])).all()
    assert (offset + length <= 2048).all()
    queue_first = first[run] + start
    for k in range(len(sizes)):  # a queue's tokens come in its order
        mine = order[q[run[order]] == k]
        assert (np.diff(queue_first[mine]) > 0).all()
    got = np.zeros((seq.max() + 1, len(sizes)))
    np.add.at(got, (seq, q[run]), length)
    full = got[: total // 2048]
    assert len(got) == -(-total // 2048) and (full.sum(axis=1) == 2048).all()
    assert (np.abs(full - 2048 * np.array(sizes) / total) <= 3).all()


def removed(items, n=400):
    count = Counter(t[p : p + n] for t in items for p in range(len(t) - n + 1))
    for t in items:
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if count[t[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        yield gone


def test_repeats(docs):
    items = texts(docs)
    want = []
    for (i, t), gone in zip(items, removed([t.encode() for _, t in items]), strict=True):
        kept = bytes(b for b, g in zip(t.encode(), gone, strict=True) if not g)
        want.append((i or -1, len(gone), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    got = [(r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_digests(docs).collect()]
    assert sorted(got) == sorted(want)
    for scale in (repeats.BYTES, repeats.WORDS):
        kept = without_repeats(docs, scale)
        assert kept.schema.names == docs.columns
        same = lambda df: sorted(repr([v for k, v in r.asDict().items() if k not in ("text", "n_chars")]) for r in df.collect())
        assert same(kept) == same(docs)
        assert all(r.n_chars == len(r.text or "") for r in kept.collect())
        assert {r.size for r in kept.collect() if r.text is None} == {1}


BLANK = r"[^\x20\x09-\x0D]+"


def passages(items, n=50):
    """Which words of each text stand in passages of n words that another text of another id has too."""
    where = {}
    words = [re.findall(BLANK, t) for _, t in items]
    for (i, t), w in zip(items, words, strict=True):
        for p in range(len(w) - n + 1):
            where.setdefault(tuple(w[p : p + n]), set()).add((i, t))
    for w in words:
        gone = bytearray(len(w))
        for p in range(len(w) - n + 1):
            if len(where[tuple(w[p : p + n])]) > 1:
                gone[p : p + n] = b"\1" * n
        yield gone


def test_passages(spark, docs):
    from random import Random

    rnd = Random(5)
    say = lambda n, k=900: " ".join(f"w{rnd.randrange(k)}" for _ in range(n))
    shared = [say(n) for n in (49, 50, 51, 52, 60, 75, 130)]
    made = [(100 + i, "\n".join([say(rnd.randrange(60)), shared[i % 7] if i % 9 else "", say(rnd.randrange(40)), shared[(i * 5) % 7]])) for i in range(80)]
    made += [(300, say(20) + " " + " ".join([say(60, 3)] * 2)), (301, " ".join(["a"] * 500)), (302, " ".join(["a"] * 70)), (303, " ".join(["b"] * 300))]
    items = [*texts(docs), *made]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    want = sorted((i or -1, sum(gone)) for (i, _), gone in zip(items, passages(items), strict=True))
    assert sorted((r.doc_id or -1, r.passage_words) for r in repeat_digests(df).collect()) == want
    left = []
    for (i, t), gone in zip(items, passages(items), strict=True):
        spans, at = [m.span() for m in re.finditer(BLANK, t)], 0
        out = ""
        for m in re.finditer(b"\1+", bytes(gone)):
            out += t[at : spans[m.start()][0]]
            at = spans[m.end() - 1][1]
        left.append((i or -1, out + t[at:]))
    assert sorted((r.doc_id or -1, r.text or "") for r in without_repeats(df).collect()) == sorted(left)


def test_near_duplicates(docs):
    got = near_duplicate_classes(docs).collect()
    assert len(got) == docs.count()
    classes = {r.doc_id: r.class_id for r in got}
    assert classes[5] == classes[6] == classes[7] == 5 != classes[8]
    assert classes[0] == classes[1] == classes[2] == 0
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.keep for r in got) == len(set(classes.values()))


def test_near_duplicates_of_a_large_group(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join([*base[:k % 100], f"edit{k}", *base[k % 100 + 1 :]])) for k in range(700)]
    rows += [(1000 + k, " ".join(f"v{k}x{i}" for i in range(50))) for k in range(50)]
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(700)} == {0}
    assert len({got[1000 + k] for k in range(50)}) == 50


def test_near_duplicates_of_a_block():
    import numpy as np
    import pyarrow as pa

    bag = lambda a, b: np.arange(a, b, dtype=np.uint64).tobytes()
    bags = [bag(0, 900), bag(100, 1000), bag(150, 1100), bag(5000, 5900), bag(0, 700)]  # 0.8, 0.81, apart, 0.78
    rows = [{"key": 0, "node": i, "root": i, "block": 0, "one": 0, "two": 0, "regions": b} for i, b in enumerate(bags)]
    got = compare_block(pa.Table.from_pylist(rows)).to_pylist()
    assert sorted((r["a"], r["b"]) for r in got) == [(0, 1), (1, 2)]
    apart = [r | {"block": i % 2, "two": 1} for i, r in enumerate(rows)]
    assert sorted((r["a"], r["b"]) for r in compare_block(pa.Table.from_pylist(apart)).to_pylist()) == [(0, 1), (2, 1)]


def test_near_duplicates_of_mixed_buckets(spark, monkeypatch):
    """Without star rounds: buckets of one common passage and several classes, in small blocks, against brute force."""
    from foliary.llm import neardup

    monkeypatch.setattr(neardup, "STAR_ROUNDS", 0)
    monkeypatch.setattr(neardup, "BLOCK_NODES", 4)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for k in range(60):
        own = [f"w{k % 20}x{i}" for i in range(8 + k % 20)]
        own[(k // 20) % len(own)] = f"edit{k}"
        rows.append((k, " ".join(passage + own)))

    def bag(t):
        w = t.split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    bags = [bag(t) for _, t in rows]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total():
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(60)] == root


def test_stages_keep_columns(spark):
    """Columns with the helpers' names keep their values."""
    names = ["id", "tie", "row", "kept", "copies", "size", "n", "of", "_id", "_tie", "_key", "_n", "_hash", "rid", "spans", "class"]
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    rows = [(k, say(k % 12) + f" tail{k}", "abc"[k % 3], *[f"{c}{k}" for c in names]) for k in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    for stage in (without_repeats, without_near_duplicates, mixed_documents):
        got = stage(df)
        assert got.columns == df.columns
        got = got.collect()
        assert got
        assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)


def test_stages_with_a_long_text(spark):
    """A text of 4 MB, and the same again with another end."""
    long = " ".join(f"word{i * 7919 % 500_009}" for i in range(400_000))
    df = spark.createDataFrame([(1, long + " one", "a"), (2, long + " two", "a"), (3, "a short text of some words", "b")], "doc_id long, text string, source string")
    assert {r.doc_id: len(r.text) for r in without_repeats(df).collect()} == {1: 4, 2: 4, 3: 26}
    assert {r.doc_id for r in without_near_duplicates(df).collect()} == {1, 3}
    got = {r.doc_id: r for r in repeat_digests(df).collect()}
    assert got[1].n_removed == len(long) + 1 and got[1].passage_words == 400_000 and got[3].n_removed == 0
    assert sum(r.length for r in pack_documents(df).collect()) > 400_000


def test_toxicity(spark, docs):
    rows = [(i, f"plain words number {i}. " + ("you vile{} thing. ".format("xyz"[i % 3]) if i % 4 == 0 else "") + "more plain text here.") for i in range(400)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = score_documents(corpus, labels).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.held_out)
    bad = next(r for r in got if r.doc_id == 0)
    assert [dict(rows)[0].encode()[s.start : s.end] for s in bad.offending] == [b" you vilex thing"]
    awkward = score_documents(docs, labels).collect()
    assert len(awkward) == docs.count()
    assert all(0 <= r.score <= 1 for r in awkward)
    assert without_toxic(docs, labels).columns == docs.columns


def base_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_quality(spark, docs):
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judge_documents(docs).collect())
    assert got == sorted((i or -1, *base_rules(t)) for i, t in texts(docs))
    plain = [(i, " ".join(f"word{(i * 31 + j) % 977}" for j in range(100 + i % 50)), "en", "s") for i in range(300)]
    junk = [(1000, " ".join("#$%&" for _ in range(20)) + " a b", "en", "s")]
    kept = {r.doc_id: r.kept for r in judge_documents(spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept.pop(1000)
    assert all(kept.values())


def test_quality_of_small_groups(spark):
    schema = "doc_id long, text string, lang string, source string"
    plain = lambda i, n: " ".join(f"word{(i * 31 + j) % 977}" for j in range(n + i % 50))
    junk = " ".join(f"#{j}$%&|<>" for j in range(40))
    few = [(i, plain(i, 100), f"l{i % 3}", f"s{i % 4}") for i in range(40)]
    for rows in (few, few + [(i + 100, plain(i, 100), "l0", "big") for i in range(150)]):
        got = {r.doc_id: r for r in judge_documents(spark.createDataFrame([*rows, (1000, junk, "l0", "s0"), (1001, junk, "new", None)], schema)).collect()}
        assert {i for i, r in got.items() if not r.kept} == {1000, 1001}
        assert all(r.distance is not None for r in got.values())
    others = [(i + 1000, plain(i, 100), "l0", "s0") for i in range(300)]
    far = [next(r.distance for r in judge_documents(spark.createDataFrame(others + [(i, plain(i, 600), "l0", "s1") for i in range(n)], schema)).collect() if r.doc_id == 0) for n in (97, 103)]
    assert far[1] == pytest.approx(far[0], rel=0.15)


def test_fingerprints(docs):
    items = sorted(texts(docs), key=lambda x: (x[0] is not None, x[0] or 0))
    got = edited_likeness(docs).collect()
    assert len(got) == len(items)
    alone = {i: t for i, t in items if sum(j == i for j, _ in items) == 1}
    for r in got:
        if r.doc_id in alone and r.doc_id not in (0, 5):
            t = alone[r.doc_id]
            at = [i for i, _ in items].index(r.doc_id)
            n = items[(at + 1) % len(items)][1]
            q = len(t) // 4
            assert r.n_chars == len(t)
            assert r.edited_sha256 == hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1
        assert 0 <= r.near_next <= 1
    assert len({r.fingerprint for r in got if r.doc_id in (5, 6)}) == 1


def dice(a, b):
    def links(fingerprint):
        anchors = [tuple(map(int, x.split(":"))) for x in fingerprint.split()]
        return Counter((h, n and n[0] - at, n and n[1]) for (at, h), n in zip(anchors, [*anchors[1:], None], strict=bool(anchors)))

    a, b = links(a), links(b)
    return 2 * (a & b).total() / (a.total() + b.total()) if a or b else 1.0


def test_fingerprints_of_long_texts(spark):
    passage = " ".join(f"shared{i * 37 % 101}" for i in range(60))
    long = [" ".join(f"{c}{i * 7919 % 4001}" for i in range(3000)) for c in "ab"]
    items = [long[0] + " " + passage, passage + " " + long[1], "\n".join(["same line here"] * 40), "\n".join(["same line here"] * 80), "日本語の文章です。" * 60]
    got = sorted(edited_likeness(spark.createDataFrame(list(enumerate(items)), "doc_id long, text string")).collect())
    own = [r.fingerprint for r in got]
    assert len(own[0].split()) > 1000
    assert all(r.near_edited == pytest.approx(dice(r.fingerprint, r.edited_fingerprint)) for r in got)
    assert [r.near_next for r in got] == pytest.approx([dice(a, b) for a, b in zip(own, own[1:] + own[:1], strict=True)])
    assert 0 < got[0].near_next < 0.1
    assert 0.6 < got[2].near_next < 0.7


def test_fingerprints_of_short_texts(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    items = [base + " x"[: 63 - len(base)], base + " xy", base + " xyz", "one two three", "one two three four", "a", " \n"]
    assert [len(x) for x in items[:2]] == [63, 65]
    got = sorted(edited_likeness(spark.createDataFrame(list(enumerate(items)), "doc_id long, text string")).collect())
    assert all(r.near_next > 0.5 for r in got[:2])
    assert 0 < got[3].near_next < 1
    assert all(r.fingerprint for r in got[:6])
    assert got[6].fingerprint == ""


def test_chat(spark):
    talks = [*CONTROL_ROWS, (1, 0, "user", "hi"), (1, 1, "assistant", "yo \\h < # \\"), (2, 0, "user", "hi"), (2, 1, "assistant", "other"), (3, 5, None, None), (3, 5, None, None), (None, 0, "a:b", "x</turn>\n")]
    df = spark.createDataFrame([(*t, "clash", 1) for t in talks], "conv_id long, turn long, role string, text string, node string, at int")
    got = {r.conv_id: r for r in chat_digests(df).collect()}
    for conv in {t[0] for t in talks}:
        mine = [t for t in talks if t[0] == conv]
        said = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    nodes = {bytes(r.node): r for r in attention(prefix_tree(df)).collect()}
    assert len(nodes) == 8  # the first turn of 1 and 2 is there once
    ends = sorted((r.start, r.start + len(r.segment)) for r in nodes.values())
    assert ends[0][0] == 0
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert all(r.position == sum(a.end - a.start for a in r.ancestors) for r in nodes.values())


def test_chat_tree(spark):
    """Depth-first order, shared segments once, and intervals, against a plain walk over paths."""
    from random import Random

    rnd = Random(3)
    talks = [(c, t, ["user", "assistant"][t % 2], f"say {rnd.randrange(1 + t % 3)}") for c in range(60) for t in range(rnd.randrange(1, 9))]
    talks += [(c, t, "user", "the same") for c in (100, 101, 102) for t in range(40)]
    tree = prefix_tree(spark.createDataFrame(talks, "conv_id long, turn long, role string, text string"))
    paths = {}
    for c, t, role, text in talks:
        paths.setdefault(c, []).append(f"### {role}: {text}</turn>\n")
    prefixes = {tuple(p[: k + 1]) for p in paths.values() for k in range(len(p))}
    nodes = sorted(attention(tree).collect(), key=lambda r: r.start)
    assert len(nodes) == len(prefixes)
    at = 0
    for r in nodes:  # the stream has no gaps, and each segment stands right after what it attends to
        assert r.start == at
        at += len(r.segment)
    stream = "".join(r.segment for r in nodes)
    told = {"".join(stream[a.start : a.end] for a in r.ancestors) + r.segment for r in nodes}
    assert told == {"".join(p) for p in prefixes}
    assert all(sum(a.end - a.start for a in r.ancestors) == r.position for r in nodes)
    spans = {}
    for r in tree.spans.collect():
        spans.setdefault(r.path, []).append((r.start, r.end))
    for r in tree.member.collect():
        assert "".join(stream[a:b] for a, b in sorted(spans[r.path])) == "".join(paths[r.conv])


def test_urls(spark):
    pages = [(1, "http://A.Example.com/en/7198#top"), (2, "https://x.com/en/1"), (3, "http://example.org/?q"), (4, None), (5, "no scheme"), (6, "http://notcom/en/"), (7, "http://b.example.net/de/81?x"), (8, "http://net/de/")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, key int")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_pages(df, listed=spark.createDataFrame([("example.org",), ("x.org",)], "url string")).collect()}
    assert got == {1: ("example.com/en/7", "allow"), 2: ("com/en/", "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("example.net/de/8", "block"), 8: ("net/de/", "allow")}


def test_spam_urls(spark):
    urls = ["http://WWW.spam-farm.example.org/a/?x", "https://www.spam-farm.example.org/a//#y", "http://casino-win.net", "http://spammer.org/a", "https://my.blog.casino.org/b", None, "spam.org/x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    assert sorted(r.url for r in spam_urls(df).collect()) == ["casino-win.net", "my.blog.casino.org/b", "www.spam-farm.example.org/a"]
    got = judge_pages(df.union(df), listed=spam_urls(df)).collect()
    assert sorted(r.page_id for r in got if r.verdict == "block") == [0, 0, 1, 1, 2, 2, 4, 4]


def test_urls_of_a_long_list(spark):
    listed = {f"h{i % 97}.org/a/{i}" for i in range(5_000)}
    pages = [(i, f"https://H{i % 97}.org/a/{i}{'/' * (i % 3)}?q={i}") for i in range(0, 20_000, 3)]
    want = {i: "block" if f"h{i % 97}.org/a/{i}" in listed else "allow" for i, _ in pages}
    got = judge_pages(spark.createDataFrame(pages, "page_id long, url string"), listed=spark.createDataFrame([(u,) for u in listed], "url string")).collect()
    assert {r.page_id: r.verdict for r in got} == want
    assert set(want.values()) == {"block", "allow"}
    keys = spark.createDataFrame([(u,) for u in listed], "key string")
    asked = spark.createDataFrame([(u,) for u in [*listed, *(f"miss{i}" for i in range(20_000))]], "key string")
    passed = {r.key for r in possible(asked, keys, len(listed)).collect()}
    assert listed < passed
    assert len(passed - listed) < 200


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert 0 < out.count() <= 3 * docs.count()
        docs = out
    assert corpus_pipeline.run(spark, sf).count()
