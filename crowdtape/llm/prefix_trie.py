"""Shared beginnings of conversations: adaptive radix trees over fixed-width turn ids.

A turn's id is a digest of its role and text followed by the length of the text, all in WIDTH big-endian bytes,
and a conversation's key is its turns' ids in order. Keys are dealt out in sorted ranges, and each task builds
trees over runs of bounded size: nodes branch on one byte in layouts that grow with their children, and stretches
without branches are one node. Only depths at whole turns are nodes of the result.

A run owns the nodes that its first key does not share with the key before it, and closes those that its last key
does not share with the key after it. With children counted where they are owned and leaves where they are closed,
every figure of a node is a sum over the runs it lies in. Only nodes shared with a neighbour have such sums to make.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from crowdtape.llm.common import arrow_map
from crowdtape.sources.staging import staged

# 16 bytes of digest, 4 bytes of length.
WIDTH = 20
# Conversations and bytes of keys in one tree.
RUN_ROWS, RUN_BYTES = 50_000, 4 << 20
_BATCH = 10_000


# --- keys ---

def turn_ids(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """``conv_id`` and ``turns``, the ids of its turns in order as hexadecimal text, a row per conversation.

    A NULL turn comes first, and turns of the same number are ordered by their ids; NULL roles and texts count as
    empty. Rows without conversation id are in no conversation. Texts are digested where they are read: what is
    gathered for a conversation is its ids.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.col(f"`{turn_col}`")
    each = conversations.select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"),
        F.struct(turn.isNotNull().alias("placed"), turn.alias("turn"),
                 F.concat(F.upper(digest), F.lpad(F.hex(F.octet_length(text)), 8, "0")).alias("id")).alias("at"))
    gathered = each.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("at")).alias("turns"))
    return gathered.select("conv_id", F.transform("turns", lambda x: x["id"]).alias("turns"))


# --- the tree ---

class _Few:
    """Up to ``room`` children beside their bytes, in order."""

    def __init__(self, room: int, pairs=()) -> None:
        self.room, self.bytes, self.nodes = room, bytearray(b for b, _ in pairs), [n for _, n in pairs]

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.nodes[at]

    def put(self, byte: int, node) -> bool:
        at = self.bytes.find(byte)
        if at >= 0:
            self.nodes[at] = node
            return True
        if len(self.nodes) == self.room:
            return False
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return True

    def pairs(self) -> list:
        return list(zip(self.bytes, self.nodes))


class _Indexed:
    """Up to 48 children behind an index of all bytes."""

    room = 48

    def __init__(self, pairs=()) -> None:
        self.index, self.nodes = bytearray(b"\xff" * 256), []
        for byte, node in pairs:
            self.put(byte, node)

    def get(self, byte: int):
        at = self.index[byte]
        return None if at == 0xFF else self.nodes[at]

    def put(self, byte: int, node) -> bool:
        at = self.index[byte]
        if at != 0xFF:
            self.nodes[at] = node
            return True
        if len(self.nodes) == self.room:
            return False
        self.index[byte] = len(self.nodes)
        self.nodes.append(node)
        return True

    def pairs(self) -> list:
        return [(b, self.nodes[at]) for b, at in enumerate(self.index) if at != 0xFF]


class _All:
    """A place for every byte."""

    def __init__(self, pairs=()) -> None:
        self.nodes = [None] * 256
        for byte, node in pairs:
            self.nodes[byte] = node

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> bool:
        self.nodes[byte] = node
        return True

    def pairs(self) -> list:
        return [(b, n) for b, n in enumerate(self.nodes) if n is not None]


def _grown(layout):
    """The next larger layout with the same children."""
    if isinstance(layout, _Few):
        return _Few(16, layout.pairs()) if layout.room == 4 else _Indexed(layout.pairs())
    return _All(layout.pairs())


class _Node:
    __slots__ = ("path", "ends", "children", "levels", "sums")

    def __init__(self, path: bytes) -> None:
        self.path, self.ends, self.children = path, [], None
        self.levels, self.sums = [], None

    def attach(self, byte: int, node: "_Node") -> None:
        if self.children is None:
            self.children = _Few(4)
        while not self.children.put(byte, node):
            self.children = _grown(self.children)

    def below(self) -> list:
        return self.children.pairs() if self.children is not None else []


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    low, high = 0, size
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Tree:
    """Adaptive radix tree of keys that are whole numbers of WIDTH bytes long."""

    def __init__(self) -> None:
        self.root = _Node(b"")

    def add(self, key: bytes, conv_id: int) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.ends.append(conv_id)
                return
            child = node.children.get(key[at]) if node.children is not None else None
            if child is None:
                leaf = _Node(key[at:])
                leaf.ends.append(conv_id)
                node.attach(key[at], leaf)
                return
            same = _common(child.path, key[at:at + len(child.path)])
            if same < len(child.path):
                split = _Node(child.path[:same])
                child.path = child.path[same:]
                split.attach(child.path[0], child)
                node.attach(key[at], split)
                child = split
            node, at = child, at + same

    def _walk(self, first: bytes, last: bytes, left: int, right: int) -> list[_Node]:
        """All nodes, parents first, with a level for each whole turn that ends in their path.

        A level is [depth, digest of the turns so far, length of the last text, shared with the run before, shared
        with the run after]. The smallest key lies on the leftmost way down, the largest on the rightmost.
        """
        order: list[_Node] = []
        self.root.levels = [[0, hashlib.md5().digest(), 0, left >= 0, right >= 0]]
        open_ = [(self.root, 0, b"", hashlib.md5(), True, True)]
        while open_:
            node, start, tail, digest, leftmost, rightmost = open_.pop()
            order.append(node)
            text, depth = tail + node.path, start // WIDTH
            whole = len(text) // WIDTH
            if whole:
                digest = digest.copy()
            for at in range(0, whole * WIDTH, WIDTH):
                turn, depth = text[at:at + WIDTH], depth + 1
                digest.update(turn)
                node.levels.append([depth, digest.digest(), int.from_bytes(turn[-4:], "big"),
                                    leftmost and depth <= left, rightmost and depth <= right])
            end, tail = start + len(node.path), text[whole * WIDTH:]
            pairs = node.below()
            for i in range(len(pairs) - 1, -1, -1):
                open_.append((pairs[i][1], end, tail, digest, leftmost and i == 0 and end < len(first),
                              rightmost and i == len(pairs) - 1 and end < len(last)))
        return order

    def nodes(self, first: bytes, last: bytes, left: int, right: int) -> Iterator[tuple]:
        """(depth, node, parent, parent's conv_id, shared, conv_id, n_convs, n_children, n_leaves, saved, ends).

        ``first`` and ``last`` are the run's edge keys; the keys before and after have so many turns in common with
        them (-1 where there is no such key). Below a shared node, whose smallest member may lie in another run,
        the parent's conv_id is None.
        """
        order = self._walk(first, last, left, right)
        for node in reversed(order):
            n, smallest = len(node.ends), min(node.ends, default=None)
            owned = leaves = saved = 0
            parent = False
            for _, child in node.below():
                m, least, child_owned, child_leaves, child_saved, child_any = child.sums
                n, smallest = n + m, least if smallest is None else min(smallest, least)
                owned, leaves, saved, parent = owned + child_owned, leaves + child_leaves, saved + child_saved, parent or child_any
            for level in reversed(node.levels):
                _, _, size, before, after = level
                leaves += not parent and not after
                saved += n * size - (0 if before else size)
                level += [smallest, n, owned, leaves, saved]
                owned, parent = 0 if before else 1, True
            node.sums = n, smallest, owned, leaves, saved, parent
        open_ = [(self.root, None, None)]
        while open_:
            node, above, above_id = open_.pop()
            for level in node.levels:
                depth, digest, _, before, after, smallest, n, children, leaves, saved = level
                shared = before or after
                ends = node.ends if level is node.levels[-1] else []
                yield depth, digest, above, above_id, shared, smallest, n, children, leaves, saved, ends
                above, above_id = digest, None if shared else smallest
            open_.extend((child, above, above_id) for _, child in reversed(node.below()))


# --- runs ---

_PART = ("run long, depth long, node binary, parent binary, parent_conv_id long, shared boolean, conv_id long, "
         "n_convs long, n_children long, n_leaves long, saved_bytes long, ends array<bigint>")
_TYPES = pa.schema([
    ("run", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()),
    ("parent_conv_id", pa.int64()), ("shared", pa.bool_()), ("conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_bytes", pa.int64()), ("ends", pa.list_(pa.int64())),
])


def _turns_in_common(a: bytes | None, b: bytes | None) -> int:
    return -1 if a is None or b is None else _common(a, b) // WIDTH


class _Runs:
    """Sorted keys of one range, cut into runs."""

    def __init__(self, part: int, before: bytes | None, after: bytes | None, most_rows: int, most_bytes: int) -> None:
        self.part, self.before, self.after, self.count = part, before, after, 0
        self.most_rows, self.most_bytes = most_rows, most_bytes
        self._new()

    def _new(self) -> None:
        self.tree, self.rows, self.bytes, self.first, self.last = Tree(), 0, 0, None, None

    def add(self, key: bytes, conv_id: int) -> Iterator[pa.RecordBatch]:
        if self.rows >= self.most_rows or self.bytes >= self.most_bytes:
            yield from self.close(key)
        if self.first is None:
            self.first = key
        self.tree.add(key, conv_id)
        self.last, self.rows, self.bytes = key, self.rows + 1, self.bytes + len(key)

    def close(self, after: bytes | None) -> Iterator[pa.RecordBatch]:
        if self.first is None:
            return
        run, self.count = self.part << 24 | self.count, self.count + 1
        found = self.tree.nodes(self.first, self.last, _turns_in_common(self.before, self.first),
                                _turns_in_common(self.last, after))
        batch: list[tuple] = []
        for row in found:
            batch.append((run, *row))
            if len(batch) == _BATCH:
                yield _record(batch)
                batch = []
        if batch:
            yield _record(batch)
        self.before = self.last
        self._new()


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip(zip(*rows), _TYPES)], schema=_TYPES)


def _grow(most_rows: int, most_bytes: int):
    """Rows of a range come in order, its neighbours' edge keys first."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = None
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("part", "placed", "key", "next_key", "conv_id"))
            for part, placed, key, next_key, conv_id in zip(*columns):
                if not placed:
                    if runs is not None:
                        yield from runs.close(runs.after)
                    runs = _Runs(part, key, next_key, most_rows, most_bytes)
                else:
                    yield from runs.add(key, conv_id)
        if runs is not None:
            yield from runs.close(runs.after)
    return work


# --- the result ---

@dataclass
class Trie:
    """``nodes``, and in ``ends`` the (node, conv_id) of conversations that end at a node whose own ``ends`` is NULL."""

    nodes: DataFrame
    ends: DataFrame


def prefix_trie(sequences: DataFrame, most_rows: int = RUN_ROWS, most_bytes: int = RUN_BYTES) -> Trie:
    """The nodes of all beginnings of ``turns``, hexadecimal turn ids as ``turn_ids`` makes them, by ``conv_id``.

    A node has ``node`` and ``parent`` (digests of its turns and of its parent's), ``depth``, ``conv_id`` (the
    smallest of its conversations), ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_bytes``
    (over its subtree, how many bytes its nodes' last texts would take if every conversation but one gave them up)
    and ``ends``, the conversations that end there. Conversations without turns end at the root, which has depth 0,
    no parent and no text. Where a node's conversations lie in several runs, and a hot one's do, ``ends`` is NULL
    and they are rows of the other table, so that no list grows beyond a run. An empty table has no nodes, not even
    a root. A conversation's ids are one value; texts are not gathered.
    """
    keys = sequences.select("conv_id", F.unhex(F.array_join("turns", "")).alias("key"))
    ranged = keys.repartitionByRange("key", "conv_id").withColumn("part", F.spark_partition_id().cast("long"))
    ranged = staged(ranged, "trie-keys")
    # One row per range.
    along = Window.orderBy("part")
    edges = ranged.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).select(
        "part", F.lit(False).alias("placed"), F.lag("high").over(along).alias("key"),
        F.lead("low").over(along).alias("next_key"), F.lit(None).cast("long").alias("conv_id"))
    rows = ranged.select("part", F.lit(True).alias("placed"), "key", F.lit(None).cast("binary").alias("next_key"), "conv_id")
    dealt = edges.unionByName(rows).repartition("part").sortWithinPartitions("part", "placed", "key", "conv_id")
    parts = staged(arrow_map(dealt, _grow(most_rows, most_bytes), _PART), "trie-parts")

    figures = ["node", "depth", "parent", "parent_conv_id", "conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes", "ends"]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_bytes")]
    merged = staged(parts.where("shared").groupBy("node").agg(
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *sums), "shared-nodes")
    smallest = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    top = merged.join(smallest, "parent", "left").withColumn("ends", F.lit(None).cast("array<bigint>"))
    # Every run has its own copy of a shared node's smallest member, so the children of a hot node meet it run by run.
    copies = parts.where("shared").select("run", F.col("node").alias("parent")).join(smallest, "parent")
    inner = parts.where("NOT shared")
    known = inner.where("parent IS NULL OR parent_conv_id IS NOT NULL").select(*figures)
    below = inner.where("parent IS NOT NULL AND parent_conv_id IS NULL").drop("parent_conv_id").join(copies, ["run", "parent"])
    nodes = known.unionByName(below.select(*figures)).unionByName(top.select(*figures))
    ends = parts.where("shared").select("node", F.explode("ends").alias("conv_id"))
    return Trie(nodes, ends)


def listed_digests(ends: DataFrame, name: str = "digest") -> DataFrame:
    """``node`` and the SHA-256 of its conversation ids, ascending and separated by commas.

    Such a digest is made by one reader in order, so a node's ids stream through one task, sorted on disk; nothing
    but the state of the digest is held.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            nodes = batch.column(0).to_pylist()
            ids = batch.column(1).to_pylist()
            at = 0
            while at < len(nodes):
                upto = at
                while upto < len(nodes) and nodes[upto] == nodes[at]:
                    upto += 1
                listed = ",".join(map(str, ids[at:upto])).encode()
                if nodes[at] == node:
                    digest.update(b"," + listed)
                else:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = nodes[at], hashlib.sha256(listed)
                at = upto
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([y for _, y in done])],
                                                 names=["node", name])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", name])

    ordered = ends.select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    return arrow_map(ordered, work, f"node binary, {name} string")
