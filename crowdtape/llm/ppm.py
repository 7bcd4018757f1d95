"""Scoring texts by prediction by partial matching over a byte-context trie.

A text is its words, lower-cased (A-Z), joined by one blank and closed by an end byte, so it holds exactly
the tokens that a word model sees. Each byte is predicted from the longest context of the trie that precedes
it; a byte not seen there escapes to the next shorter context, and bytes that the longer context could have
predicted are excluded from the shorter one's counts.

With n(c) bytes seen after context c, D(c) different ones in the trie and u(c) seen whose node is not in the
trie: P(s|c) = (2 n(cs) - 1) / 2 n(c) and P(escape|c) = (D(c) + 2 u(c)) / 2 n(c), so every byte gives half a
count to the escape. After an escape from the longer context e, n and D of c are taken without the bytes of
e. Below the empty context all bytes not yet excluded are equally likely. So the probabilities of the 256
bytes sum to 1 after any context.

``score_texts`` has every string of the training texts in the trie, so u(c) is 0, and no task holds all of it. A byte's
probability depends on the order+1 bytes that end at it. Those that hold 1/``share`` of all bytes or more, ``share`` at
most, have theirs in memory of each task; texts are joined with the others. Strings that training texts lack are
looked up where all contexts with the same last bytes are.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from crowdtape.llm.common import Lookup, arrow_map, others, packed, unpacked
from crowdtape.sources.staging import staged

ORDER = 5
# Strings whose probabilities are in memory of each task: at most this many. Frequent words likewise.
SHARE = 1 << 23
FREQUENT_WORDS = 1 << 22
# Contexts of fewer bytes are known to every task (2^24 strings at most); longer ones go by that many of their last bytes.
_NEAR = 3
# Strings of a task that looks up what training texts lack.
_STRINGS = 1 << 18
END = b"\n"
_WINDOW = 1 << 18
# Grams that a learning task holds, and words, each of which weighs some ten times as much.
_HELD, _HELD_WORDS = 1 << 20, 1 << 17
_GRAM, _WORD = 0, 1


def tokens_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _hashes(tokens: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(token) for token in tokens]), ">i8").astype(np.int64)


def _mask(symbols: int) -> int:
    return (1 << 8 * symbols) - 1


def _low_bytes(code: Column, symbols: int) -> Column:
    return code if symbols == 8 else code.bitwiseAND(F.lit(_mask(symbols)).cast("long"))


def _codes(data: np.ndarray, order: int) -> np.ndarray:
    """The order+1 bytes that end at each position from ``order`` on, as one number."""
    codes = np.zeros(len(data) - order, np.uint64)
    for back in range(order + 1):
        codes |= data[order - back:len(data) - back].astype(np.uint64) << np.uint64(8 * back)
    return codes


# --- learning ---

def _count(order: int):
    """Distinct grams and words of a task with their counts, given out whenever many have gathered."""
    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([x[1] for x in parts])).astype(np.int64)

    def out(kind: int, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(codes), kind, np.int32)), pa.array(codes.astype(np.int64)), pa.array(counts)],
            names=["kind", "code", "n"])

    def counted(words: Counter) -> pa.RecordBatch:
        return out(_WORD, _hashes(list(words)), np.fromiter(words.values(), np.int64, len(words)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        for flat, starts, ends, tokens in _flat_texts(batches, order):
            words.update(tokens)
            words[END] += len(starts)
            for a, b, codes in _windows(flat, order):
                keep = _inside(starts, ends, a, b)
                found, counts = np.unique(codes[keep], return_counts=True)
                grams.append((found, counts))
            if sum(len(x[0]) for x in grams) > _HELD:
                grams = [merged(grams)]
                if len(grams[0][0]) > _HELD // 2:
                    yield out(_GRAM, *grams.pop())
            if len(words) > _HELD_WORDS:
                yield counted(words)
                words = Counter()
        if grams:
            yield out(_GRAM, *merged(grams))
        if words:
            yield counted(words)
    return work


def _flat_texts(batches: Iterator[pa.RecordBatch], order: int, most: int = 1 << 20):
    """Texts joined to one array, each behind ``order`` end bytes: it, their starts, ends and tokens."""
    for batch in batches:
        column = batch.column(0)
        at = 0
        while at < len(column):
            parts, starts, ends, tokens, size = [], [], [], [], 0
            while at < len(column) and size < most:
                mine = tokens_of(column[at].as_py())
                data = b" ".join(mine)
                parts.append(data)
                tokens.extend(mine)
                starts.append(size + order)
                size += order + len(data) + 1
                ends.append(size)
                at += 1
            padding = END * order
            flat = padding + (END + padding).join(parts) + END
            yield np.frombuffer(flat, np.uint8), np.array(starts), np.array(ends), tokens


def _windows(flat: np.ndarray, order: int):
    for a in range(order, len(flat), _WINDOW):
        b = min(len(flat), a + _WINDOW)
        yield a, b, _codes(flat[a - order:b], order)


def _inside(starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> np.ndarray:
    """Which positions of a window belong to a text, not to the padding before one."""
    turns = np.zeros(b - a + 1, np.int32)
    np.add.at(turns, np.clip(starts, a, b) - a, 1)
    np.add.at(turns, np.clip(ends, a, b) - a, -1)
    return np.cumsum(turns[:-1]) > 0


def learn(texts: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Counts of all (order+1)-byte strings (``kind`` 0) and of all words by hash (``kind`` 1)."""
    counted = arrow_map(texts.select(F.col(f"`{text_col}`").cast("string")), _count(order),
                        "kind int, code long, n long")
    return staged(counted.groupBy("kind", "code").agg(F.sum("n").alias("n")), "ppm-counts")


# --- the trie ---

class Trie:
    """Log probabilities of all nodes and escapes, by order."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]], totals: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """For each order from 0: (string codes, counts), and (context codes, counts of what follows)."""
        self.order = len(nodes) - 1
        self.nodes, self.log_count, self.log_first = [], [], []
        self.contexts, self.log_all, self.log_escape = [], [], []
        self.log_all_after, self.log_escape_after = [], []
        shorter = None
        for order, (codes, counts) in enumerate(nodes):
            owner = codes >> np.uint64(8)
            context, at = np.unique(owner, return_inverse=True)
            known = Lookup(totals[order][0])
            n = totals[order][1][known.find(context)].astype(np.float64) if len(context) else np.zeros(0)
            kept = np.bincount(at, counts, len(context)) if len(context) else np.zeros(0)
            different = np.bincount(at, minlength=len(context)).astype(np.float64)
            unseen = n - kept
            find = Lookup(codes)
            self.nodes.append(find)
            self.contexts.append(Lookup(context))
            self.log_count.append(np.log(2.0 * counts - 1))
            self.log_all.append(np.log(2 * n))
            self.log_escape.append(np.log(different + 2 * unseen))
            self.log_first.append(self.log_count[-1] - self.log_all[-1][at] if len(codes) else np.zeros(0))
            # What is left of the next shorter context once the bytes of this one are excluded.
            if shorter is None or not len(context):
                self.log_all_after.append(np.zeros(len(context)))
                self.log_escape_after.append(np.zeros(len(context)))
            else:
                s_find, s_counts, s_contexts, s_n, s_different, s_unseen = shorter
                excluded = np.bincount(at, s_counts[s_find.find(codes & np.uint64(_mask(order)))], len(context))
                below = s_contexts.find(context & np.uint64(_mask(order - 1)))
                left = s_different[below] - different
                everything, escape = 2 * (s_n[below] - excluded), left + 2 * s_unseen[below]
                with np.errstate(divide="ignore"):
                    self.log_all_after.append(np.where(everything > 0, np.log(everything), 0.0))
                    self.log_escape_after.append(np.where(escape > 0, np.log(escape), 0.0))
            shorter = (find, counts, self.contexts[-1], n, different, unseen)
        different = len(nodes[0][0])
        self.log_rest = -np.log(256 - different) if different < 256 else 0.0

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each code's last byte after the bytes before it."""
        result = np.zeros(len(codes))
        rest, after = np.arange(len(codes)), np.full(len(codes), -1)
        for order in range(self.order, -1, -1):
            mine = codes[rest] & np.uint64(_mask(order + 1))
            node = self.nodes[order].find(mine)
            hit = node >= 0
            first = hit & (after < 0)
            result[rest[first]] += self.log_first[order][node[first]]
            later = hit & (after >= 0)
            if later.any():
                result[rest[later]] += (self.log_count[order][node[later]]
                                        - self.log_all_after[order + 1][after[later]])
            rest, after, mine = rest[~hit], after[~hit], mine[~hit]
            if not len(rest):
                return result
            context = self.contexts[order].find(mine >> np.uint64(8))
            there = context >= 0
            first = there & (after < 0)
            result[rest[first]] += (self.log_escape[order] - self.log_all[order])[context[first]]
            later = there & (after >= 0)
            if later.any():
                result[rest[later]] += (self.log_escape_after[order + 1]
                                        - self.log_all_after[order + 1])[after[later]]
            after = context
        result[rest] += self.log_rest
        return result


def _unsigned(codes: np.ndarray) -> np.ndarray:
    return codes.view(np.uint64) if len(codes) else np.zeros(0, np.uint64)


def _collected(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns of a table whose rows the caller has bounded."""
    found = df.select(*columns).toArrow()
    return [found.column(name).to_numpy() for name in columns]


def build_trie(counts: DataFrame, order: int = ORDER, share: int = SHARE) -> Trie:
    """The nodes with at least 1/``share`` of all counted bytes, at most ``share`` for each order: a model in one memory."""
    grams = counts.where(F.col("kind") == _GRAM)
    total = grams.agg(F.sum("n")).first()[0] or 0
    code = F.col("code")
    levels = F.array(*[
        F.struct(F.lit(d).alias("order"), F.lit(is_node).alias("is_node"),
                 (_low_bytes(code, d + 1) if is_node else _low_bytes(F.shiftrightunsigned(code, 8), d)).alias("code"))
        for d in range(order + 1) for is_node in (True, False)])
    summed = (
        grams.select(F.explode(levels).alias("x"), "n").groupBy("x.order", "x.is_node", "x.code")
        .agg(F.sum("n").alias("n")).where(F.col("n") * share >= total)
    )
    level, is_node, codes, n = _collected(summed, "order", "is_node", "code", "n")
    is_node, codes = is_node.astype(bool), codes.astype(np.uint64)
    nodes = [(codes[k], n[k]) for k in (is_node & (level == d) for d in range(order + 1))]
    totals = [(codes[k], n[k]) for k in (~is_node & (level == d) for d in range(order + 1))]
    return Trie(nodes, totals)


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(codes, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


def _near_nodes(grams: DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All nodes behind contexts of less than ``_NEAR`` bytes, by order."""
    longest = min(order + 1, _NEAR)
    code, n = _collected(grams.groupBy(_low_bytes(F.col("code"), longest).alias("code")).agg(F.sum("n").alias("n")), "code", "n")
    code = code.astype(np.uint64)
    return [_summed(code & np.uint64(_mask(d + 1)), n) for d in range(longest)]


def _known_logs(grams: DataFrame) -> DataFrame:
    """``code, n, log`` of each string of the training texts: the log probability of its last byte after the others."""
    context = Window.partitionBy(F.shiftrightunsigned("code", 8))
    return grams.select("code", "n", (F.ln(2 * F.col("n") - 1) - F.ln(2 * F.sum("n").over(context))).alias("log"))


def _look_up(shared, order: int):
    """Log probabilities of the strings without count, from a task's strings that share the last bytes of their context."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not sum(len(b) for b in batches):
            return
        rows = pa.Table.from_batches(batches)
        code = rows.column("code").to_numpy().astype(np.uint64)
        n = rows.column("n").to_numpy()
        wanted = code[n == 0]
        if not len(wanted):
            return
        code, n = code[n > 0], n[n > 0]
        nodes = shared.value + [_summed(code & np.uint64(_mask(d + 1)), n) for d in range(len(shared.value), order + 1)]
        trie = Trie(nodes, [_summed(codes >> np.uint64(8), counts) for codes, counts in nodes])
        for at in range(0, len(wanted), _WINDOW):
            some = wanted[at:at + _WINDOW]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(trie.log_probabilities(some))], names=["code", "log"])
    return work


def _lacking_logs(grams: DataFrame, lacking: DataFrame, order: int) -> DataFrame:
    """``code, log`` of strings that the training texts lack."""
    spark = grams.sparkSession
    shared = spark.sparkContext.broadcast(_near_nodes(grams, order))
    both = grams.select("code", "n").unionByName(lacking.select("code", F.lit(0).cast("long").alias("n")))
    tasks = max(spark.sparkContext.defaultParallelism, -(-grams.count() // _STRINGS))
    near = _low_bytes(F.shiftrightunsigned("code", 8), _NEAR)
    return arrow_map(both.repartition(tasks, near), _look_up(shared, order), "code long, log double")


# --- scoring ---

def _score(shared, order: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, string_logs, words, log_counts = shared.value
        for batch in batches:
            done = 0
            for flat, starts, ends, tokens in _flat_texts(iter([batch]), order):
                logs, lacking, lacking_sizes = np.zeros(len(starts)), [], np.zeros(len(starts), np.int64)
                for a, b, codes in _windows(flat, order):
                    at, inside = strings.find(codes), _inside(starts, ends, a, b)
                    here = inside & (at >= 0)
                    found = np.where(here, string_logs[at] if len(string_logs) else 0.0, 0.0)
                    sums = np.concatenate(([0.0], np.cumsum(found)))
                    logs += sums[np.clip(ends, a, b) - a] - sums[np.clip(starts, a, b) - a]
                    away = np.flatnonzero(inside & ~here)
                    lacking.append(codes[away].astype(np.int64))
                    lacking_sizes += np.bincount(np.searchsorted(starts, away + a, "right") - 1, minlength=len(starts))
                hashes = _hashes(tokens)
                at = words.find(hashes.view(np.uint64))
                # Texts of n words have n - 1 blanks, so words are counted at blanks and ends.
                sizes = _word_counts(flat, starts, ends)
                owner = np.repeat(np.arange(len(starts)), sizes)
                known = at >= 0
                value = np.where(known, log_counts[at] if len(log_counts) else 0.0, 0.0)
                end = words.find(_hashes([END]).view(np.uint64))[0]
                frequent = np.bincount(owner, known, len(starts)).astype(np.int64) + int(end >= 0)
                base = np.bincount(owner, value, len(starts)) + (log_counts[end] if end >= 0 else 0.0)
                rare_sizes = np.bincount(owner, ~known, len(starts)).astype(np.int64)
                mine = batch.slice(done, len(starts))
                done += len(starts)
                yield pa.RecordBatch.from_arrays(
                    [*mine.columns[1:], pa.array(sizes + 1), pa.array(frequent), pa.array(base), pa.array(logs),
                     _lists(rare_sizes, hashes[~known]), _lists(lacking_sizes, np.concatenate(lacking)),
                     pa.array(np.full(len(starts), end >= 0))],
                    names=[*mine.schema.names[1:], "n_tokens", "frequent", "base", "log", "rare", "strings", "end_known"])
    return work


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


def _word_counts(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    blanks = np.concatenate(([0], np.cumsum(flat == 32)))
    return blanks[ends] - blanks[starts] + (ends - starts > 1)


def score_texts(docs: DataFrame, train: Column, text_col: str = "text", order: int = ORDER,
                share: int = SHARE, frequent: int = FREQUENT_WORDS) -> DataFrame:
    """``docs`` without its text, with two models' scores of every text, learned from the rows where ``train``.

    Added: ``n_tokens`` (words and one end), ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (log10 probability under smoothed word counts) and ``score`` (log10 probability under the
    trie). NULL and empty texts are one end token. Without training rows every byte is as likely as any other
    and the base score is 0. Repeated rows each get their scores. A column of ``docs`` that has one of these
    names is replaced.
    """
    spark = docs.sparkSession
    ours = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    passed = others(docs, text_col, *ours)
    text = F.col(f"`{text_col}`").cast("string").alias("_text")
    counts = learn(docs.where(train).select(text), "_text", order)
    words = counts.where(F.col("kind") == _WORD)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    codes, n = _collected(words.where(F.col("n") * frequent >= total), "code", "n")
    grams = counts.where(F.col("kind") == _GRAM)
    logs = staged(_known_logs(grams), "ppm-logs")
    strings, string_logs = _collected(logs.where(F.col("n") * share >= grams.agg(F.sum("n")).scalar()), "code", "log")
    model = (Lookup(_unsigned(strings)), string_logs, Lookup(_unsigned(codes)), np.log10(n + 0.5) if len(n) else np.zeros(0))
    shared = spark.sparkContext.broadcast(model)

    learned = F.coalesce(train, F.lit(False)).alias("_learned")
    rows = docs.select(text, packed(passed), learned, F.monotonically_increasing_id().alias("_id"))
    schema = T.StructType([rows.schema["_row"], *T.StructType.fromDDL(
        "_learned boolean, _id long, n_tokens long, frequent long, base double, log double, "
        "rare array<long>, strings array<long>, end_known boolean")])
    scored = staged(arrow_map(rows, _score(shared, order), schema), "ppm-scores")

    # Strings and words that are not frequent: the share of each in the rows learned from is bounded.
    lacking = scored.where("NOT _learned").select(F.explode("strings").alias("code")).distinct().join(
        logs.select("code"), "code", "left_anti")
    of_strings = logs.select("code", "log").unionByName(_lacking_logs(grams, staged(lacking, "ppm-lacking"), order))
    values = words.select("kind", "code", "n", F.lit(None).cast("double").alias("log")).unionByName(
        of_strings.select(F.lit(_GRAM).alias("kind"), "code", F.lit(None).cast("long").alias("n"), "log"))
    rare = scored.select("_id", F.lit(_WORD).alias("kind"), F.explode("rare").alias("code")).unionByName(
        scored.where("NOT end_known").select("_id", F.lit(_WORD).alias("kind"), F.lit(int(_hashes([END])[0])).alias("code")))
    rare = rare.unionByName(scored.select("_id", F.lit(_GRAM).alias("kind"), F.explode("strings").alias("code")))
    of_word = F.when(F.col("kind") == _WORD, F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5)))
    added = rare.join(values.hint("merge"), ["kind", "code"], "left").groupBy("_id").agg(
        F.count("n").alias("known"), F.sum(of_word).alias("more"), F.sum("log").alias("rest"))
    lines = scored.drop("rare", "strings").join(added, "_id", "left")
    size = F.log10(F.lit(float(total)) + F.lit(0.5) * (F.lit(float(distinct)) + 1))
    return lines.select(
        *unpacked(passed), "n_tokens", (F.col("frequent") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * size).alias("base_score"),
        ((F.col("log") + F.coalesce("rest", F.lit(0.0))) / F.lit(float(np.log(10)))).alias("score"))
