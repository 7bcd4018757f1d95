"""Passage search, hard negatives and the prefix trie against plain versions of them."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdtape.llm import decontaminate, hard_negatives, prefix_trie, queries


# --- passages of benchmark items ---

def words_of(text):
    folded = "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def plain_passages(docs, items, window):
    """(words, covered positions, item names) of every document."""
    wanted = defaultdict(set)
    for name, text in items:
        own = words_of(text)
        size = min(len(own), window)
        for at in range(len(own) - size + 1 if size else 0):
            wanted[tuple(own[at:at + size])].add("" if name is None else str(name))
    sizes = {len(w) for w in wanted}
    found = []
    for text in docs:
        own, covered, names = words_of(text), set(), set()
        for size in sizes:
            for at in range(len(own) - size + 1):
                hit = wanted.get(tuple(own[at:at + size]))
                if hit:
                    covered.update(range(at, at + size))
                    names |= hit
        found.append((len(own), covered, sorted(names)))
    return found


@pytest.mark.parametrize("shard_bytes", [1 << 24, 700])
def test_passages_by_brute_force(spark, shard_bytes):
    rng = random.Random(5)
    stock = ["a", "B", "cc", "Ünder", "x9", "word", "é", "long" * 9, "日本", "to"]

    def text(least, most):
        return rng.choice([" ", ", ", "\n", "\0 "]).join(rng.choices(stock, k=rng.randint(least, most)))

    items = [(i, text(1, 14)) for i in range(40)] + [(3, "a b cc to"), (None, "word word x9"), (50, None), (51, ""), (52, "..!"), (3, "a b cc to")]
    items += [(100, "z" * 300), (101, "z" * 300), (60, " ".join(f"q{i}" for i in range(25)))]
    docs = [text(0, 60) for _ in range(60)] + [None, "", "\0\0", "ONLY other THINGS", "A", "q3 q4 " + " ".join(f"q{i}" for i in range(5, 30)), "z" * 300, "z" * 299]
    docs += [items[0][1], items[1][1], docs[0]]
    docs.append(" ".join(rng.choices(["no", "such", "thing"], k=30_000)) + " " + items[2][1])
    rows = [(None if i == 7 else i, t, "k", 1) for i, t in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row string, Spans int").repartition(2)
    found = decontaminate.find_passages(
        frame, spark.createDataFrame(items, "item_id long, text string"), window=4, shard_bytes=shard_bytes).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for (doc, *_), (count, covered, names) in zip(rows, plain_passages(docs, items, 4)):
        r = by[doc]
        spans = [i for s in r.spans for i in range(s["first"], s["last"])]
        assert (r.n_words, spans, r["items"]) == (count, sorted(covered), names)
    clean = decontaminate.without_passages(
        frame, spark.createDataFrame(items, "item_id long, text string"), window=4, shard_bytes=shard_bytes)
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in found if not r.spans}


def test_passages_of_nothing(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.find_passages(docs, none).collect()
    assert [(r.n_words, r.spans, r["items"]) for r in found] == [(2, [], [])] * 2
    assert decontaminate.find_passages(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_shifts_skip_and_lose_nothing():
    rng = random.Random(2)
    windows = [" " + " ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(10)) + " " for _ in range(300)]
    index = decontaminate.Windows([w.encode() for w in windows], [[str(i)] for i in range(len(windows))])
    import pyarrow as pa
    texts = ["".join(rng.choices("abcdefgh ", k=5000)) + windows[7] + windows[8].strip() + " x", windows[9] * 3]
    run = decontaminate.Run(pa.array(texts))
    first, count, number = index.find(run)
    folded = [" ".join(words_of(t)) for t in texts]
    want = sum(len(re.findall(f"(?={re.escape(w)})", f" {t} ")) for w in windows for t in folded)
    assert len(first) == want and {7, 8, 9} <= set(number.tolist()) and set(count.tolist()) == {10}
    assert all(int(c.shifts.max()) > 1 for c in index.classes)


# --- hard negatives ---

def plain_negatives(rows, anchor, positives, negatives, low, high):
    found = []
    for a, label, vector in rows:
        if not anchor(a):
            continue

        def ranked(same):
            return sorted((-sum(x * y for x, y in zip(vector, v)), i) for i, other, v in rows
                          if i != a and len(v) == len(vector) and (other == label) == same)

        unlike = ranked(False)
        for p, positive in ranked(True)[:positives]:
            fits = [(s, i) for s, i in unlike if low * -p <= 100 * -s <= high * -p][:negatives]
            found += [(a, positive, n + 1, i, -p, -s) for n, (s, i) in enumerate(fits)]
    return sorted(found)


@pytest.mark.parametrize("group", [4096, 8])
def test_negatives_by_brute_force(spark, monkeypatch, group):
    # Many small groups are first asked by sample.
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    rng = random.Random(8)
    centres = [[rng.randint(-200, 200) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(400):
        base = rng.choice(centres)
        rows.append((i, rng.randint(0, 3), [x + rng.randint(-30, 30) for x in base]))
    rows += [(400 + i, i % 2, rows[3][2]) for i in range(20)]
    rows += [(430, 0, [0] * 6), (440, 1, [0] * 6), (450, 0, [5, 5]), (451, 0, [5, 4]), (452, 1, [3, 4]), (460, 2, [])]
    odd = [(None, 1, rows[0][2]), (470, None, rows[0][2]), (480, 1, None), (490, 1, [1, None, 3, 4, 5, 6])]
    shuffled = [(*r, 0, "x") for r in [*rows, *odd, rows[10]]]
    rng.shuffle(shuffled)
    frame = spark.createDataFrame(shuffled, "vec_id long, label int, embedding array<bigint>, score int, `GROUP` string").repartition(3)
    found = hard_negatives.hard_negatives(frame, F.col("id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in found) == plain_negatives(rows, lambda a: a % 10 == 0, 5, 3, 50, 95)
    assert hard_negatives.hard_negatives(frame.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(frame, F.lit(False)).count() == 0
    with pytest.raises(Exception, match="pass a long"):
        huge = spark.createDataFrame([(0, 1, [1 << 40]), (1, 1, [1 << 40])], "vec_id long, label int, embedding array<bigint>")
        hard_negatives.hard_negatives(huge, F.lit(True)).collect()


def test_coordinate_ranges_narrow_and_lose_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(hard_negatives, "BUCKET", 64)
    centres = rng.normal(size=(12, 8)) * 400
    vectors = np.floor(centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8)) * 25)
    ids, labels = np.arange(1500), rng.integers(0, 5, 1500)
    seen = []
    narrow = hard_negatives._Bucket.candidates
    monkeypatch.setattr(hard_negatives._Bucket, "candidates",
                        lambda *a: seen.append(narrow(*a)) or seen[-1])
    group = hard_negatives._Group(5, True)
    group.hold(ids, labels, {8: (ids, vectors)})
    group.close()
    low, high = np.full(40, hard_negatives._LEAST), np.full(40, hard_negatives._MOST)
    best = group.ask(ids[:40], labels[:40], 8, vectors[:40], np.arange(40), low, high)
    scores = vectors[:40] @ vectors.T
    for i in range(40):
        want = sorted((-scores[i, j], j) for j in range(1500) if j != i and labels[j] == labels[i])[:5]
        mine = best.question == i
        assert list(zip(-best.score[mine], best.id[mine])) == want
    narrowed = [x for x in seen if x is not None]
    assert len(narrowed) >= 50 and np.mean([len(x) for x in narrowed]) < 32


def test_mined_rows_follow_the_contract(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 9), [rng.gauss(0, 0.2) for _ in range(5)]) for i in range(300)]
    rows += [(700, None, [0.1] * 5), (750, 3, [float("nan")] * 5), (800, 3, [float("inf")] * 5), (850, 3, [None] * 5), (900, 3, None)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op12_hard_negatives(spark, str(tmp_path)).collect()
    whole = [(i, (c + 1) % 10 if i % 7 == 0 else c, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, c, v in rows[:300]]
    assert sorted(tuple(r) for r in found) == plain_negatives(whole, lambda a: a % 50 == 0, 5, 3, 50, 95)


# --- the prefix trie ---

def plain_trie(rebuilt):
    """Rows of op13 from {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for path, own in members.items():
        below = [p for p in members if p[:len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in own if len(rebuilt[c]) == len(path))))
        rows.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own),
                     sum(len(p) == len(path) + 1 for p in below),
                     sum(not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below) for p in below),
                     sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def conversations_of(rng):
    rows = []
    for c in list(range(0, 60)) + [-7, -5, 1000, 1003]:
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, rng.choice(["user", None, "bot"]), rng.choice(["hi", "é", "yes", None, "", "no " * 5])))
    rows += [(c, t, "user", "same") for c in range(200, 240) for t in range(4)]
    rows += [(300, t, "user", str(t % 3)) for t in range(150)] + [(301, t, "user", str(t % 3)) for t in range(149)]
    rows += [(400, None, "user", "first"), (400, 0, "user", "second"), (None, 0, "user", "nobody's")]
    return rows


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        found[c] = own.get(base, [])[:h] + turns[h:]
    return found


@pytest.mark.parametrize("most_rows", [50_000, 7])
def test_trie_by_brute_force(spark, tmp_path, monkeypatch, most_rows):
    rng = random.Random(most_rows)
    rows = conversations_of(rng)
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", b"y") for r in rows], "conv_id long, turn long, role string, text string, node string, KEY binary")
    frame.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    build = prefix_trie.prefix_trie
    monkeypatch.setattr(prefix_trie, "prefix_trie", lambda s: build(s, most_rows))
    # Keys in many ranges: copies of one conversation then lie on both sides of borders.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        found = queries.op13_prefix_trie(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((tuple(r) for r in found), key=repr) == plain_trie(plain_rebuilt(rows))


def test_trie_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_prefix_trie(spark, str(tmp_path)).count() == 0


def test_layouts_grow_and_paths_compress():
    rng = random.Random(6)
    width, tree = prefix_trie.WIDTH, prefix_trie.Tree()
    ids = [bytes([b]) + rng.randbytes(width - 1) for b in range(256)]
    keys = [(i,) for i in ids] + [(ids[0], i) for i in ids[:40]] + [(ids[1], i) for i in ids[:12]] + [(ids[2],) * 50]
    for c, key in enumerate(sorted(b"".join(k) for k in keys)):
        tree.add(key, c)

    def layout(node):
        return type(node.children).__name__

    assert layout(tree.root) == "_All" and len(tree.root.below()) == 256
    children = [n for _, n in tree.root.below()]
    assert (layout(children[0]), layout(children[1]), children[1].children.room, layout(children[2])) == ("_Indexed", "_Few", 16, "_Few")
    (_, chain), = children[2].below()
    assert len(chain.path) == 49 * width and not chain.below()
    nodes = list(tree.nodes(b"", b"", -1, -1))
    assert len(nodes) == 1 + 256 + 40 + 12 + 49 and all(n[6] >= 1 for n in nodes)
