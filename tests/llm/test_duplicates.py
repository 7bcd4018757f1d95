"""Line, vector and SimHash duplicates against brute force, and their edge cases."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from crowdtape.llm import embedding_dedup, line_dedup, simhash_dedup
from crowdtape.llm.common import Lookup, components

DOCS = "doc_id long, text string, _id string, _line string, kept string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", None, "k") for i, t in rows], DOCS)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def classes(keys, near):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in keys:
        for b in keys:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def edited(rng, line, times):
    chars = list(line)
    for _ in range(times):
        at = rng.randrange(len(chars))
        what = rng.randrange(3)
        if what == 0:
            chars.insert(at, rng.choice("abé "))
        elif what == 1:
            del chars[at]
        else:
            chars[at] = rng.choice("abé ")
    return "".join(chars)


# --- shared ---

def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in found} == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_lookup_finds_exactly_what_it_holds():
    codes = np.unique(np.random.default_rng(1).integers(0, 5000, 900).astype(np.uint64))
    find = Lookup(codes)
    every = np.arange(5000, dtype=np.uint64)
    found = find.find(every)
    assert (codes[found[found >= 0]] == every[found >= 0]).all() and (found >= 0).sum() == len(codes)
    assert (Lookup(codes[:0]).find(every) == -1).all()


# --- lines ---

@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abé", max_size=9), st.text("abé", max_size=9)), min_size=1, max_size=12),
       st.integers(1, 4))
def test_banded_distance(pairs, edits):
    found = line_dedup.within([a for a, _ in pairs], [b for _, b in pairs], edits)
    assert found.tolist() == [distance(a, b) <= edits for a, b in pairs]


@pytest.mark.parametrize("block", [2, 256])
def test_line_classes_match_brute_force(spark, block):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(20, 60))).strip() for _ in range(12)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(4))) for i in range(30)]
    lines = {}
    for i, text in rows:
        for no, line in enumerate(text.split("\n")):
            if len(line.strip(" ")) >= line_dedup.LEAST_CHARS:
                lines[i, no] = line.strip(" ")
    want = classes(sorted(lines), lambda a, b: lines[a] == lines[b] or (
        min(len(lines[a]), len(lines[b])) >= line_dedup.LEAST_NEAR_CHARS and distance(lines[a], lines[b]) <= 2))
    found = line_dedup.line_classes(docs(spark, rows), block=block).collect()
    assert {(r.doc_id, r.line_no): (r.class_id, r.class_line) for r in found} == want
    assert all(r.kept == (want[r.doc_id, r.line_no] == (r.doc_id, r.line_no)) for r in found)


def test_lines_that_repeat_go(spark):
    long = "one line that many of the documents share"
    rows = [(2, f"first\n{long}\nmine alone, all of it"), (1, f"{long}\t\n\nsecond"), (3, long), (None, long), (4, None), (5, ""),
            (6, "first\nfirst"), (7, f"{long[:-1]}!"), (1, f"{long}\t\n\nsecond"), (8, "x" * 200_000)]
    frame = docs(spark, rows)
    left = line_dedup.without_repeats(frame)
    assert left.columns == frame.columns
    assert sorted(left.select("doc_id", "text").collect(), key=str) == sorted([
        (2, "first\nmine alone, all of it"), (1, f"{long}\t\n\nsecond"), (1, f"{long}\t\n\nsecond"), (4, None), (5, ""),
        (6, "first\nfirst"), (8, "x" * 200_000)], key=str)
    assert line_dedup.without_repeats(frame.limit(0)).count() == 0


# --- SimHash ---

def plain_fingerprint(text, size=3):
    words = (text or "").lower().split()
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_every_three_positions_are_left_out_by_a_mask():
    for free in ((1 << 64) - 1, simhash_dedup.covering_masks((1 << 64) - 1)[3]):
        masks = simhash_dedup.covering_masks(free)
        rng, places = random.Random(2), [i for i in range(64) if free >> i & 1]
        for _ in range(3000):
            three = sum(1 << i for i in rng.sample(places, 3))
            assert any(mask & three == 0 for mask in masks)


@pytest.mark.parametrize("bucket", [1, 5, 2048])
def test_links_connect_what_pairs_connect(spark, bucket):
    rng = random.Random(bucket)
    centers = [rng.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1]
    fps = {c ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for c in centers for _ in range(25)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash_dedup.links_within(spark.createDataFrame(signed, "_fp long"), bucket=bucket)
    roots = {r.node: r.root for r in components(links, "a", "b").collect()}
    want = classes(sorted(x for x, in signed), lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3)
    assert {x: roots.get(x, x) for x, in signed} == want


def test_simhash_classes_and_who_stays(spark):
    prose = " ".join(f"Word{i % 97}x{i}" for i in range(400))
    rows = [(3, prose), (1, prose.upper()), (2, "other text of its own"), (9, None), (5, ""), (4, " \n\t"), (None, prose),
            (None, "alone without an id"), (2, "other text of its own"), (8, "two words"), (7, "x " * 50_000)]
    frame = docs(spark, rows)
    found = simhash_dedup.near_duplicates(frame, shingle=3).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.component_id) for r in found} == {
        (3, 1), (1, 1), (None, 1), (2, 2), (9, 4), (5, 4), (4, 4), (None, None), (8, 8), (7, 7)}
    assert {r.doc_id: r.fingerprint for r in found if r.doc_id in (2, 3, 4, 8, 7)} == {
        i: format(plain_fingerprint(t), "016x") for i, t in rows if i in (2, 3, 4, 8, 7)}
    left = simhash_dedup.keep_one(frame)
    assert left.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([
        (1, prose.upper()), (2, "other text of its own"), (4, " \n\t"), (None, "alone without an id"), (8, "two words"),
        (7, "x " * 50_000)], key=str)
    assert simhash_dedup.keep_one(frame.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [3, 25, 4096])
def test_vectors_match_brute_force(spark, cell):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 8))
    rows = [(int(i), (centers[i % 6] + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.3])).astype(np.float32).tolist())
            for i in range(90)]
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [1.0, None] * 4), (204, [float("nan")] + [1.0] * 7),
             (205, [float("inf")] + [1.0] * 7), (206, [1.0, 2.0]), (207, [10.0, 20.0]), (208, [2e-30] * 8), (209, [3e30] * 8)]
    found = embedding_dedup.near_duplicates(
        spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, key string"), cell=cell).collect()

    def unit(v):
        v = np.array(v, np.float64)
        return v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())

    good = {i: unit(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}

    def near(a, b):
        return a in good and b in good and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95

    want = classes([i for i, _ in rows], near)
    assert {r.vec_id: r.component_id for r in found} == want
    assert {r.vec_id: r.n_links for r in found} == {i: sum(near(i, j) for j, _ in rows if i != j) for i, _ in rows}
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_no_vectors_and_repeated_ones(spark):
    kind = "vec_id long, embedding array<double>"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = [(5, [1.0, 0.0])] * 3 + [(None, [1.0, 0.0]), (None, [0.0, 1.0]), (6, [0.0, 0.0])]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, kind)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(5, 3, 5, True)] * 3 + [(None, 3, 5, False), (None, 0, None, True), (6, 0, 6, True)], key=str)


def test_pairs_are_decided_in_double_precision_but_compared_in_single():
    rng = np.random.default_rng(3)
    own = rng.normal(size=(300, 48))
    own /= np.linalg.norm(own, axis=1)[:, None]
    across = rng.normal(size=own.shape)
    across -= (across * own).sum(axis=1)[:, None] * own
    across /= np.linalg.norm(across, axis=1)[:, None]
    cosine = 0.95 + np.resize([1e-9, -1e-9, 1e-7, -1e-7, 0.04, -0.04], len(own))
    rows = cosine[:, None] * own + np.sqrt(1 - cosine ** 2)[:, None] * across
    cell = embedding_dedup._Cell(0.95)
    cell.held = [(np.arange(300), np.ones(300, np.int64), own)]
    cell.close()
    i, j = cell.near(rows)
    assert cell.single.dtype == np.float32
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(rows @ own.T >= 0.95))) and set(i) == set(np.flatnonzero(cosine > 0.95))
    # A group whose members are all near each other is one product of matrices.
    group = own[:1] + 1e-3 * rng.normal(size=(200, 48))
    group /= np.linalg.norm(group, axis=1)[:, None]
    cell = embedding_dedup._Cell(0.95)
    cell.held = [(np.arange(200), np.full(200, 2), group)]
    cell.close()
    assert (cell.counts == 398).all() and sum(map(len, cell.links)) == 199
