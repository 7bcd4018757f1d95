"""Passages of benchmark items in documents, found by multi-pattern search after Wu and Manber.

Items become windows of consecutive words, documents one run of words with single blanks, so that a window
occurs where its string does. Windows are divided into classes of like length. A class looks at the text
through a frame as long as its shortest window: a shift table over the hashes of byte blocks says how far the
frame may move on, because no window holds the frame's last block nearer to that place. Where it may not move,
the block selects the windows that have it there, and the text is compared with them.

Many places of a text are searched in step: each lane has its own stretch of frame ends.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtape.llm.common import arrow_map, pieces_of
from crowdtape.sources.staging import staged

# Words of a window; an item of fewer words is one window.
WINDOW = 10
# Windows are looked for in shards of about this many bytes: what the driver and every task hold at a time.
SHARD_BYTES = 16 << 20
_LANES = 4096
_PIECE = 4 << 20
_BLOCK = 8
_MOST_BITS = 22
_LETTERS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words are digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


# --- windows of the items ---

def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text",
                 window: int = WINDOW) -> DataFrame:
    """``window`` (its words, each between single blanks) and ``items``, the ids as text, a row per window.

    A NULL text has no words; an item without id goes by the empty name.
    """
    text = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), _LETTERS, _SMALL)
    words = items.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"),
                         F.regexp_extract_all(text, F.lit(WORD), 0).alias("words"))
    size = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    each = words.where(F.size("words") > 0).select("item", "words", size.alias("size"), F.explode(starts).alias("at"))
    named = each.select(F.concat(F.lit(" "), F.array_join(F.slice("words", F.col("at"), F.col("size")), " "), F.lit(" "))
                        .alias("window"), "item")
    return named.groupBy("window").agg(F.collect_set("item").alias("items"))


class _Class:
    """Shift table and buckets of windows whose lengths differ less than twofold."""

    def __init__(self, windows: list[tuple[int, bytes]]) -> None:
        self.least = min(len(text) for _, text in windows)
        self.block = min(_BLOCK, (self.least + 1) // 2)
        self.mask = np.uint64((1 << 8 * self.block) - 1)
        width = self.least + _BLOCK
        rows = np.zeros((len(windows), width), np.uint8)
        for at, (_, text) in enumerate(windows):
            rows[at, :self.least] = np.frombuffer(text, np.uint8, self.least)
        starts = np.arange(len(windows)) * width
        flat = np.concatenate((rows.ravel(), np.zeros(_BLOCK, np.uint8)))
        bits = min(_MOST_BITS, max(10, (4 * len(windows) * self.least).bit_length()))
        self.right = np.uint64(64 - bits)
        self.shifts = np.full(1 << bits, self.least - self.block + 1, np.uint32)
        # Later blocks allow less, so the last one written for a hash is the least.
        for end in range(self.block, self.least + 1):
            self.shifts[self.hash(self.blocks(flat, starts + end - self.block))] = self.least - end
        self.buckets: dict[int, tuple[set[int], dict[bytes, int]]] = {}
        for suffix, (number, text) in zip(self.blocks(flat, starts + self.least - self.block).tolist(), windows):
            counts, found = self.buckets.setdefault(suffix, (set(), {}))
            counts.add(text.count(b" ") - 1)
            found[text] = number

    def blocks(self, buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.ndarray(len(buffer) - 7, np.uint64, buffer, 0, (1,))[starts] & self.mask

    def hash(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks * np.uint64(0x9E3779B97F4A7C15)) >> self.right).astype(np.int64)

    def stops(self, buffer: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where frames start that may not move on and that a blank begins, and their last blocks."""
        first, count = self.least - 1, size - self.least + 1
        lanes = max(1, min(_LANES, count // (4 * self.least)))
        at = first + np.arange(lanes) * count // lanes
        ends = np.append(at[1:], size)
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        starts, blocks = [], []
        while len(at):
            block = self.blocks(buffer, at - self.block + 1)
            move = self.shifts[self.hash(block)]
            stop = move == 0
            if stop.any():
                begin = at[stop] - first
                blank = buffer[begin] == 0x20
                starts.append(begin[blank])
                blocks.append(block[stop][blank])
            at = at + np.maximum(move, 1)
            open_ = at < ends
            if not open_.all():
                at, ends = at[open_], ends[open_]
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(starts), np.concatenate(blocks)


class Windows:
    """The windows of one shard, and the search for them."""

    def __init__(self, windows: list[bytes], items: list[list[str]]) -> None:
        self.items = items
        classes: dict[int, list[tuple[int, bytes]]] = {}
        for number, text in enumerate(windows):
            classes.setdefault(len(text).bit_length(), []).append((number, text))
        self.classes = [_Class(some) for some in classes.values()]

    def find(self, run: "Run") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and window of every occurrence."""
        found: list[tuple[int, int, int]] = []
        text, last = run.buffer.tobytes(), len(run.blanks) - 1
        for group in self.classes:
            starts, blocks = group.stops(run.buffer, run.size)
            ranks = np.searchsorted(run.blanks, starts)
            for start, rank, block in zip(starts.tolist(), ranks.tolist(), blocks.tolist()):
                counts, windows = group.buckets.get(block, ((), {}))
                for count in counts:
                    if rank + count <= last:
                        number = windows.get(text[start:run.blanks[rank + count] + 1])
                        if number is not None:
                            found.append((rank, count, number))
        both = np.array(found, np.int64).reshape(-1, 3)
        return both[:, 0], both[:, 1], both[:, 2]


class Run:
    """Texts as one run of words; a word of one zero byte stands before, between and behind the texts."""

    def __init__(self, texts: pa.Array) -> None:
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        folded = bytes(memoryview(data)[offsets[0]:offsets[-1]]).translate(_FOLD) if data is not None else b""
        cuts = (offsets - offsets[0]).tolist()
        joined = b" \0 ".join([b"", *[folded[a:b] for a, b in zip(cuts[:-1], cuts[1:])], b""])
        raw = np.frombuffer(joined, np.uint8)
        blank = raw == 0x20
        keep = np.ones(len(raw), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        run = raw[keep]
        self.size = len(run)
        self.buffer = np.concatenate((run, np.zeros(_BLOCK, np.uint8)))
        self.blanks = np.flatnonzero(run == 0x20)
        #: The words that are marks: text i lies between mark i and mark i + 1.
        self.marks = np.flatnonzero(self.buffer[self.blanks[:-1] + 1] == 0)


# --- documents ---

_FOUND = "n_words long, spans array<struct<first:int,last:int>>, items array<string>"


def _spans(pairs: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    both = pa.StructArray.from_arrays([pa.array(pairs[:, 0].astype(np.int32)), pa.array(pairs[:, 1].astype(np.int32))],
                                      names=["first", "last"])
    return pa.ListArray.from_arrays(pa.array(offsets), both)


def _search(shard, keep_text: bool):
    """Adds a shard's occurrences to what earlier shards have found in the same rows."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shard.value
        for piece in pieces_of(batches, "_text", _PIECE):
            run = Run(piece.column("_text").fill_null(""))
            first, count, number = windows.find(run)
            before = piece.column("spans").to_pylist()
            items = [set(x or ()) for x in piece.column("items").to_pylist()]
            change = np.zeros(len(run.blanks) + 1, np.int64)
            np.add.at(change, first, 1)
            np.add.at(change, first + count, -1)
            for row, spans in enumerate(before):
                for span in spans or ():
                    change[run.marks[row] + 1 + span["first"]] += 1
                    change[run.marks[row] + 1 + span["last"]] -= 1
            owner = np.searchsorted(run.marks, first) - 1
            for row, window in set(zip(owner.tolist(), number.tolist())):
                items[row].update(windows.items[window])
            inside = np.cumsum(change) > 0
            edges = np.flatnonzero(np.diff(inside, prepend=False)).reshape(-1, 2)
            owner = np.searchsorted(run.marks, edges[:, 0]) - 1
            columns = {
                "_row": piece.column("_row"), "_text": piece.column("_text"),
                "n_words": pa.array(np.diff(run.marks) - 1),
                "spans": _spans(edges - run.marks[owner][:, None] - 1, owner, len(piece)),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            }
            if not keep_text:
                del columns["_text"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return work


def _shards(spark: SparkSession, windows: DataFrame, shard_bytes: int):
    """The windows in shards of bounded size, broadcast one after the other."""
    weight = F.octet_length("window") + F.lit(64) + 16 * F.size("items")
    total = windows.agg(F.sum(weight.cast("long"))).first()[0] or 0
    count = max(1, -(-total // shard_bytes))
    for shard in range(count):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(count)) == shard).collect()
        yield shard == count - 1, spark.sparkContext.broadcast(
            Windows([row["window"].encode("utf-8", "surrogatepass") for row in rows], [row["items"] for row in rows]))


def _with_passages(rows: DataFrame, items: DataFrame, item_col: str, item_text_col: str, window: int,
                   shard_bytes: int) -> DataFrame:
    """``_row`` and what is found in ``_text``. Every shard but the last has its result written."""
    spark = rows.sparkSession
    kind = rows.schema["_row"].dataType.simpleString()
    windows = staged(item_windows(items, item_col, item_text_col, window), "windows")
    found = rows.select("_row", "_text", F.expr("CAST(NULL AS array<struct<first:int,last:int>>)").alias("spans"),
                        F.expr("CAST(NULL AS array<string>)").alias("items"))
    for last, shard in _shards(spark, windows, shard_bytes):
        found = arrow_map(found, _search(shard, not last), f"_row {kind}, {'' if last else '_text string, '}{_FOUND}")
        if not last:
            found = staged(found, "passages").drop("n_words")
    return found


def find_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``id_col``, ``n_words``, ``spans`` and ``items``, one row per input row.

    ``spans`` holds the stretches of words, as [first, last) counted from 0, that lie in some occurrence of a
    window of ``window`` consecutive item words; an item of fewer words is one window. ``items`` holds the ids,
    as text and in that order, of the items whose windows occur. A to Z are lower-cased first. NULL and empty
    texts have no words: as documents they hold nothing, as items they are nowhere. Repeated rows stay, each
    with its own answer, and repeated items count once by their id; an item without id goes by the empty name.
    Without items nothing is found. Other columns are not read.

    Windows go to the tasks in shards of ``shard_bytes``, and the documents pass once per shard, so neither
    driver nor tasks hold more of the items however many there are; the ids that share one window are one list.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_row"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    found = _with_passages(rows, items, item_col, item_text_col, window, shard_bytes)
    return found.select(F.col("_row").alias(id_col), "n_words", "spans", "items")


def without_passages(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                     item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window of the items occurs, with all their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(f"`{text_col}`").cast("string").alias("_text"))
    found = _with_passages(rows, items, item_col, item_text_col, window, shard_bytes)
    return found.where(F.size("spans") == 0).select("_row.*")
