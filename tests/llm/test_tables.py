"""Mixing, rollups, quality rules and the pipeline against plain versions of them; all queries against their SQL."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from crowdtape.llm import (
    common, divergence, line_crf, line_dedup, mixing, ordinal_toxicity, pieces, ppm, queries, rollups,
    simhash_dedup,
)
from crowdtape.llm.common import remainder
from crowdtape.sources.staging import new_path

FOLDER = "/root/testdata/sf0.001"


def key(row):
    return tuple(map(repr, row))


# --- mixing ---

def shares(budget, children):
    """Exact shares of (name, room, weight): fill those that need least for their weight first."""
    rest, given = Fraction(budget), {}
    todo = sorted(children, key=lambda c: (Fraction(c[1], max(c[2], 1)), c[0]))
    while todo:
        name, room, weight = todo[0]
        level = rest / sum(c[2] for c in todo)
        if room > level * weight:
            given.update({n: level * w for n, _, w in todo})
            break
        given[name] = Fraction(room)
        rest -= room
        todo.pop(0)
    return given


@pytest.mark.parametrize("budget", [0, 1, 37, 100, 400, 10_000])
def test_budgets_flow_down_the_tree(spark, budget):
    leaves = [("a", "x", 10), ("a", "y", 200), ("b", "x", 30), ("b", "y", 5), ("c", "x", 90), ("d", "x", 0), ("e", "x", 50)]
    weights = [{"a": 3, "b": 2, "e": 0}, {"x": 2}]
    found = mixing.leaf_budgets(spark.createDataFrame(leaves, "l0 string, l1 string, tokens long"), ["l0", "l1"], weights,
                                F.lit(budget), max_epochs=2).collect()
    got = {(r.l0, r.l1): r.budget for r in found}
    rooms = {(a, b): 0 if a == "e" else 2 * n for a, b, n in leaves}
    tops = sorted({a for a, _ in rooms})
    top = shares(min(budget, sum(rooms.values())), [
        (a, sum(n for k, n in rooms.items() if k[0] == a), weights[0].get(a, 1) or 1) for a in tops])
    assert sum(got.values()) == min(budget, sum(rooms.values()))
    for a in tops:
        mine = {k: n for k, n in rooms.items() if k[0] == a}
        want = shares(top[a], [(k[1], n, weights[1].get(k[1], 1)) for k, n in mine.items()])
        for k in mine:
            assert abs(got[k] - want[k[1]]) <= 2 and got[k] <= rooms[k]


def test_leaf_prefixes_and_edges(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 9), rng.choice(["x", "y", None, ""]), "c") for i in range(300)]
    rows += [(None, "a b c", "x", "c"), (7, "a b", "x", "c"), (400, None, "z", "c"), (401, "w " * 20_000, "long", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string")
    found = mixing.with_copies(docs, {"source": F.col("source")}, [{"x": 2}], F.lit(900), seed=5, max_epochs=3).collect()
    assert len(found) == len(rows)
    leaves = defaultdict(list)
    for r in found:
        leaves[r.source or ""].append((r.doc_id, len((r.text or "").split()), r.copies))
    total = 0
    for mine in leaves.values():
        spent = sum(n * copies for _, n, copies in mine)
        total += spent
        whole = min(c for _, _, c in mine)
        assert {c for _, _, c in mine} <= {whole, whole + 1}
        order = {i: hashlib.md5(f"5:{whole}:{'' if i is None else i}".encode()).hexdigest() for i, _, _ in mine}
        given = [order[i] for i, n, c in mine if c > whole and n]
        left = [order[i] for i, n, c in mine if c == whole and n]
        assert not given or not left or max(given) < min(left)
    # The one long document fits nowhere, so its leaf's share stays unspent.
    assert 650 <= total <= 900
    mixed = mixing.mixture(docs, {"source": F.col("source")}, [{"x": 2}], F.lit(900), seed=5, max_epochs=3)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in found)
    assert mixing.mixture(docs.limit(0), {"source": F.col("source")}, [{}], F.lit(900)).count() == 0


# --- rollups ---

def test_totals_follow_random_changes(spark):
    rng = random.Random(11)
    rollup, state = rollups.Rollup(spark, new_path(spark, "rollup")), {}
    assert rollup.totals().count() == 0
    for batch in range(1, 5):
        rows = []
        for no in range(60):
            rows.append((rng.randint(1, 25), rng.choice(["v1", "v2"]), rng.choice(["insert", "revise", "delete"]),
                         rng.choice(["s", "t", None]), rng.choice(["en", "de"]), rng.choice([None, 0, 3, 50]), no, "x"))
        for doc, version, op, source, lang, tokens, _, _ in rows:
            if op == "delete":
                state.pop((doc, version), None)
            else:
                state[doc, version] = (source, lang, tokens or 0)
        rows += [(None, "v1", "insert", "s", "en", 9, 99, "x"), (3, None, "insert", "s", "en", 9, 99, "x"),
                 (3, "v1", "unknown", "s", "en", 9, 99, "x"), rows[-1]]
        rng.shuffle(rows)
        changes = spark.createDataFrame(rows, rollups.CHANGE + ", batch string")
        assert rollup.commit(batch, changes)
        assert not rollup.commit(batch, changes)
        want = defaultdict(lambda: [0, 0])
        for (_, version), (source, lang, tokens) in state.items():
            want[source, lang, version][0] += 1
            want[source, lang, version][1] += tokens
        found = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in rollup.totals().collect()}
        assert found == dict(want)
    assert rollup.commit(9, changes.limit(0)) and rollup.totals().count() == len(found)


def test_a_batch_that_broke_off_leaves_no_trace(spark):
    rollup = rollups.Rollup(spark, new_path(spark, "rollup"))
    one = spark.createDataFrame([(1, "v", "insert", "s", "en", 5, 0)], rollups.CHANGE)
    two = spark.createDataFrame([(1, "v", "revise", "s", "en", 7, 0), (2, "v", "insert", "s", "en", 1, 0)], rollups.CHANGE)
    rollup.commit(1, one)
    two.limit(0).withColumn("live", F.lit(True)).select("doc_id", "tokenizer", "source", "lang", "tokens", "live").write.parquet(
        f"{rollup.root}/ledger/batch=2")
    one.select("source", "lang", "tokenizer", F.lit(4).cast("long").alias("docs"), "tokens").write.parquet(f"{rollup.root}/deltas/batch=2")
    assert [(r.docs, r.tokens) for r in rollup.totals().collect()] == [(1, 5)]
    assert rollup.commit(2, two)
    assert [(r.docs, r.tokens) for r in rollup.totals().collect()] == [(2, 8)]


def test_late_batches_are_refused_and_compaction_changes_nothing(spark):
    rng = random.Random(2)
    rollup, state = rollups.Rollup(spark, new_path(spark, "rollup")), {}
    for batch in (0, 3, 4, 9):
        rows = [(rng.randint(1, 12), "v", rng.choice(["insert", "delete"]), rng.choice(["s", "t"]), "en", rng.randint(1, 9), no)
                for no in range(20)]
        for doc, _, op, source, _, tokens, _ in rows:
            state.pop(doc, None)
            if op == "insert":
                state[doc] = source, tokens
        assert rollup.commit(batch, spark.createDataFrame(rows, rollups.CHANGE))
        if batch in (3, 9):
            rollup.compact()
        # What a compaction that broke off has left is not read.
        spark.createDataFrame([("s", "en", "v", 100, 100)], "source string, lang string, tokenizer string, docs long, tokens long").write.mode(
            "overwrite").parquet(f"{rollup.root}/base-deltas/upto=100")
        want = defaultdict(lambda: [0, 0])
        for source, tokens in state.values():
            want[source][0] += 1
            want[source][1] += tokens
        assert {r.source: [r.docs, r.tokens] for r in rollup.totals().collect()} == dict(want)
        assert {r.doc_id: (r.source, r.tokens) for r in rollup.ledger().collect()} == state
    late = spark.createDataFrame([(1, "v", "insert", "s", "en", 5, 0)], rollups.CHANGE)
    with pytest.raises(ValueError):
        rollup.commit(5, late)
    assert not rollup.commit(3, late)
    assert {r.doc_id: (r.source, r.tokens) for r in rollup.ledger().collect()} == state


def test_counts_of_texts(spark):
    texts = spark.createDataFrame([(None,), ("",), (" \n",), ("one, two  3é",)], "text string")
    found = texts.select(*[n.alias(k) for k, n in rollups.counts("text").items()]).collect()
    assert [tuple(r) for r in found] == [(0, 0), (0, 0), (0, 0), (3, 5)]


# --- quality rules ---

def plain_distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    return math.sqrt(max(0, sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0)
                                for a, b in zip(p, q)) / 2))


def repeated(words, size=8):
    windows = Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    inside = set()
    for i in range(len(words) - size + 1):
        if windows[tuple(words[i:i + size])] > 1:
            inside.update(range(i, i + size))
    return len(inside)


def test_rules_by_brute_force(spark):
    rng = random.Random(9)
    vocabulary = divergence.COMMON_WORDS["en"] + ["river", "Stone", "x#y", "1900", "é,"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 80))) for _ in range(25)]
    texts += ["a b c d e f g h " * 3, "one\none\n\n \none two\n one", None, "", "# " * 60, "the of and " * 40 + "\n" + "the of and " * 40,
              "der die und " * 30, "w%d " * 9000]
    rows = [(i, t, "fr" if i % 9 == 8 else None if i % 9 == 7 else "xx" if i % 9 == 6 else "en", "k") for i, t in enumerate(texts)]
    rows.append((None, "the of and", "en", "k"))
    found = divergence.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}

    def classes(text):
        counts = []
        for pattern in divergence.CLASSES.values():
            less = re.sub(pattern, "", text)
            counts.append(len(text) - len(less))
            text = less
        return [*counts, len(text)]

    def common(text, lang):
        listed = divergence.COMMON_WORDS.get(lang, [])
        spoken = [w for w in re.split(divergence.WORD_ENDS, text.lower()) if w]
        return [spoken.count(w) for w in listed] + [sum(w not in listed for w in spoken)]

    total = {}
    for _, text, lang, _ in rows:
        for name, make in (("c", classes(text or "")), ("w", common(text or "", lang))):
            total[name, lang] = [a + b for a, b in zip(total.get((name, lang), [0] * len(make)), make)]
    for i, text, lang, _ in rows:
        text, r = text or "", by[i]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeated(words))
        assert r.base_failed == (len(words) < 20 or 100 * repeated(words) > 30 * len(words)) and (not r.kept or not r.base_failed)
        if text:
            assert r.class_distance == pytest.approx(plain_distance(classes(text), total["c", lang]), abs=1e-9)
        else:
            assert r.class_distance is None
        if lang in divergence.COMMON_WORDS and sum(common(text, lang)):
            assert r.word_distance == pytest.approx(plain_distance(common(text, lang), total["w", lang]), abs=1e-9)
        else:
            assert r.word_distance is None
    assert divergence.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


# --- the pipeline ---

def test_every_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, names = docs.columns, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_repeats", "near_duplicates", "mixture", "encoded"]
    odd = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "", "en", "src0", 0)], docs.schema)
    docs = docs.unionByName(odd)
    model = line_crf.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), remainder("doc_id") != 0)
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        if name == "encoded":
            vocabulary = pieces.Vocabulary()
            assert {r.doc_id for r in rows} == set(before)
            assert all(r.ids is None if before[r.doc_id] is None else vocabulary.decode(np.array(r.ids)) == before[r.doc_id]
                       for r in rows)
            assert all(r.round_trip for r in rows)
            best = {i: vocabulary.encode([t], queries.NBEST)[0] for i, t in list(before.items())[:40]}
            assert all(best[r.doc_id] is None or r.nbest_scores == [s for s, _ in best[r.doc_id][2]] for r in rows if r.doc_id in best)
            continue
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in rows}
        if name == "quality":
            scores = dict(zip(before, model.scores(list(before.values()))))
            assert after == {i: t for i, t in before.items() if scores[i] >= queries.QUALITY}
        elif name == "line_repeats":
            seen, want = [], {}
            for i in sorted(before):
                if before[i] is None:
                    want[i] = None
                    continue
                left, gone = [], False
                for line in before[i].split("\n"):
                    bare = line.strip(" \t\r\f\v")
                    if len(bare) >= line_dedup.LEAST_CHARS:
                        same = [s for s in seen if s == bare or len(bare) >= line_dedup.LEAST_NEAR_CHARS and line_dedup.within([s], [bare], 2)[0]]
                        seen.append(bare)
                        if same:
                            gone = True
                            continue
                    left.append(line)
                if not gone or "".join(left).strip():
                    want[i] = "\n".join(left)
            assert after == want
        elif name == "near_duplicates":
            fps = {i: simhash_dedup.fingerprint(t, 3) for i, t in before.items()}
            root = {i: i for i in fps}
            for a in sorted(fps):
                for b in sorted(fps):
                    if (fps[a] ^ fps[b]).bit_count() <= 3:
                        low, high = sorted((root[a], root[b]))
                        root = {i: low if r == high else r for i, r in root.items()}
            assert set(after) == {i for i, r in root.items() if i == r}
        else:
            assert set(after) <= set(before) and len(rows) == len(after)
            sizes = {i: len((t or "").split()) for i, t in before.items()}
            assert 0.8 * sum(sizes.values()) < sum(sizes[i] for i in after) <= 0.9 * sum(sizes.values())
        before = after


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == ["doc_id", "lang", "source", "n_pieces", "score", "ids", "nbest_scores", "round_trip"] and found.count() > 100


def test_clashing_names_and_tables_of_one_column(spark):
    """Columns that differ from an operator's own by case are replaced; a table may have nothing but its text."""
    one = [("Some words of a text, and some more of them.",), (None,)]
    text = spark.createDataFrame(one, "text string")
    named = text.select("text", F.lit(1).alias("_"), F.lit(2).alias("Score"), F.lit("en").alias("lang"), F.lit(3).alias("SEVERITY"),
                        F.lit(4).alias("Kept"), F.lit(5).alias("IDS"), F.lit(6).alias("Copies"), F.lit(7).alias("_row"), F.lit(8).alias("N_Tokens"),
                        F.lit(9).alias("doc_id"))
    vocabulary = pieces.Vocabulary()

    def written(frame):
        path = new_path(spark, "named")
        frame.write.parquet(path)
        return spark.read.parquet(path)

    model = line_crf.train(spark.createDataFrame([(1, "good text here"), (2, "#### $$$$")], "doc_id long, text string"),
                           spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), F.lit(True))
    for m in (model, None):
        assert written(line_crf.with_quality(named, m)).columns == [*[c for c in named.columns if c != "Score"], "score"]
        assert written(line_crf.with_quality(text, m)).columns == ["text", "score"]
    toxic = ordinal_toxicity.train(spark.createDataFrame([(1, "fine"), (2, "awful words")], "doc_id long, text string"),
                                   spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"), F.lit(True))
    assert written(ordinal_toxicity.with_severity(named, toxic)).columns[-3:] == ["severity", "grade", "p_toxic"]
    scored = written(ppm.score_texts(named, F.lit(True)))
    assert "Score" not in scored.columns and scored.count() == 2
    assert written(ppm.score_texts(text, F.lit(True))).columns == ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    encoded = written(pieces.with_pieces(named, vocabulary))
    assert encoded.columns[-3:] == ["ids", "score", "nbest"] and "IDS" not in encoded.columns
    decoded = written(pieces.with_text(encoded, vocabulary))
    assert [r.decoded for r in decoded.orderBy(F.col("decoded").isNull()).collect()] == [one[0][0], None]
    assert written(pieces.with_text(encoded.select("ids"), vocabulary)).columns == ["ids", "decoded"]
    judged = written(divergence.judge(named))
    assert judged.columns[-1] == "kept" and "Kept" not in judged.columns
    copied = written(mixing.with_copies(named, {"lang": F.col("lang")}, [{}], F.lit(5)))
    assert copied.columns[-1] == "copies" and "Copies" not in copied.columns


def test_every_operator_is_registered():
    names = set(contract.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) <= names and set(queries.ORACLES) <= set(contract.oracle_sql())


def test_batches_between_spark_and_workers_are_bounded(spark):
    """Rows of 64 kB came in batches of 20 MB, on both sides of every task at once."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    rows = spark.range(0, 320, 1, 1).select(F.repeat(F.lit("x"), 1 << 16).alias("text"))
    found = [r.n for r in common.arrow_map(rows, sizes, "n long").collect()]
    assert sum(found) >= 320 << 16 and max(found) <= 2 * common.BATCH_BYTES
