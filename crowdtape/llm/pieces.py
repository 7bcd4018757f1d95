"""SentencePiece encoding, decoding and N-best segmentation over the piece lattice.

The lattice of a text has its character boundaries as nodes and the pieces of the vocabulary as edges; a
segmentation's score is the sum of its pieces' log probabilities. A forward Viterbi pass gives the best score
of every prefix. Going backward from the end, a partial segmentation's own score plus the best score of the
prefix still missing is the exact score of its best completion, so A-star search with that heuristic yields
segmentations in order of score without ever expanding one that is not needed.

No piece crosses a line end, or a blank that follows something else, so every segmentation passes these nodes:
the lattice falls into units between them, mostly words, and scores add over units. The forward pass runs once
for each distinct unit, over many units at a time. The N best of a text differ from the best one only in the
N - 1 units whose second-best segmentations lose least, so only those units are searched, and their
alternatives are put together in order of loss.
"""

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from crowdtape.llm.common import Lookup, arrow_map, others, packed, pieces_of, unpacked

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN_LOSS = 10.0
# Units a worker remembers, and characters of new ones that it works on at a time. A character has several edges, each
# some hundred bytes while the lattice is searched.
_REMEMBERED, _AT_ONCE = 100_000, 1 << 16
_CHANGES = "array<struct<score:double,changes:array<struct<at:int,old:int,ids:array<int>>>>>"


class Vocabulary:
    """The pieces of a model file as a trie, with what is known of the units met so far.

    Models with merge ranks for scores get log probabilities by Zipf's law over the ranks; models whose scores
    are log probabilities keep them. A character that no piece can spell is one edge, worth ``UNKNOWN_LOSS``
    less than the worst piece, and is written as its UTF-8 bytes.
    """

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ  Å x") != BLANK + "ﬁ  Å x".replace(" ", BLANK):
            raise ValueError(f"{path} rewrites text; only models that keep it as it is decode exactly")
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        scores = np.array([model.get_score(i) for i in range(size)])
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        special = {i for i in range(size) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)}
        plain = [i for i in range(size) if i not in special]
        if (scores[plain] <= 0).all() and np.array_equal(scores[plain], np.round(scores[plain])):
            rank = np.empty(size)
            rank[plain] = np.argsort(np.argsort(-scores[plain], kind="stable"), kind="stable") + 1
            scores = -np.log(np.where(np.isin(np.arange(size), plain), rank, 1.0)) - np.log((1 / rank[plain]).sum())
        self.scores = np.append(scores, scores[plain].min() - UNKNOWN_LOSS)  # the last: an unknown character
        self.text = [b"" if i in special else pieces[i].replace(BLANK, " ").encode() for i in range(size)]
        for byte, i in enumerate(self.bytes):
            self.text[i] = bytes([byte])
        self.text.append(b"")  # what an unknown id spells
        self.longest = max((len(pieces[i]) for i in plain), default=1)
        # The trie: a child for each node and character, and the piece that ends at each node.
        children: dict[int, int] = {}
        ends = {0: -1}
        for i in plain:
            node = 0
            for char in pieces[i]:
                node = children.setdefault(node << 21 | ord(char), len(children) + 1)
                ends.setdefault(node, -1)
            ends[node] = i
        self.children, self.ends = children, np.array([ends[n] for n in range(len(ends))], np.int32)
        self.step = Lookup(np.fromiter(children, np.uint64, len(children)))
        self.child = np.fromiter(children.values(), np.int64, len(children))
        crossing = any(BLANK in pieces[i].lstrip(BLANK) for i in plain) or any(
            "\n" in pieces[i] and len(pieces[i]) > 1 for i in plain)
        self.unit = re.compile(r"[\s\S]+" if crossing else f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.names: list[str] = []
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.best, self.gap = np.zeros(0), np.zeros(0)
        self.several: dict[tuple[str, int], list] = {}

    # --- the forward pass, over many units at once ---

    def _edges(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All edges of a run of characters, whose units end at ``ends`` (for each character): first, after, piece."""
        firsts, afters, kinds = [], [], []
        start, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        spelled = np.zeros(len(chars), bool)
        for length in range(1, self.longest + 1):
            inside = start + length <= ends[start]
            start, node = start[inside], node[inside]
            if not len(start):
                break
            found = self.step.find((node.astype(np.uint64) << np.uint64(21)) | chars[start + length - 1].astype(np.uint64))
            start, node = start[found >= 0], self.child[found[found >= 0]]
            piece = self.ends[node]
            firsts.append(start[piece >= 0])
            afters.append(firsts[-1] + length)
            kinds.append(piece[piece >= 0])
            if length == 1:
                spelled[firsts[-1]] = True
        missing = np.flatnonzero(~spelled)
        firsts.append(missing)
        afters.append(missing + 1)
        kinds.append(np.full(len(missing), len(self.scores) - 1, np.int32))
        return np.concatenate(firsts), np.concatenate(afters), np.concatenate(kinds)

    def _learn(self, units: list[str]) -> None:
        """Best segmentation of new units, and how much the second best loses."""
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        unit = np.repeat(np.arange(len(units)), sizes)
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        first, after, piece = self._edges(chars, (begins + sizes)[unit])
        own = unit[first]
        # A unit of n characters has n + 1 nodes.
        source, target, offset = first + own, after + own, after - begins[own]
        # By end, longer pieces first; all of it fits one number, which sorts faster.
        order = np.argsort((offset << 40) + (target << 8) + (self.longest - (after - first)), kind="stable")
        source, target, offset, piece, first = (x[order] for x in (source, target, offset, piece, first))
        worth = self.scores[piece]
        one, two = (np.full(len(chars) + len(units), -np.inf) for _ in range(2))
        via = np.full(len(one), -1, np.int64)
        one[begins + np.arange(len(units))] = 0.0
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(offset)) + 1, [len(offset)])) if len(offset) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            heads = np.concatenate(([0], np.flatnonzero(np.diff(target[a:b])) + 1))
            at = target[a:b][heads]
            value = one[source[a:b]] + worth[a:b]
            top = np.maximum.reduceat(value, heads)
            counts = np.diff(np.append(heads, b - a))
            place = np.where(value == np.repeat(top, counts), np.arange(b - a), b - a)
            chosen = np.minimum.reduceat(place, heads)
            value[chosen] = -np.inf
            rest = np.maximum(value, two[source[a:b]] + worth[a:b])
            one[at], two[at], via[at] = top, np.maximum.reduceat(rest, heads), chosen + a
        last = begins + sizes + np.arange(len(units))
        path_unit, path_edge, here, active = [], [], last.copy(), np.arange(len(units))
        while len(active):
            edge = via[here[active]]
            path_unit.append(active)
            path_edge.append(edge)
            here[active] = source[edge]
            active = active[here[active] != begins[active] + active]
        path_unit, path_edge = np.concatenate(path_unit[::-1]), np.concatenate(path_edge[::-1])
        order = np.argsort(path_unit, kind="stable")
        path_unit, path_edge = path_unit[order], path_edge[order]
        ids, width = piece[path_edge], np.ones(len(path_edge), np.int64)
        strange = np.flatnonzero(ids == len(self.scores) - 1)
        spelling = {int(i): self._spell(chr(chars[first[path_edge[i]]])) for i in strange}
        width[strange] = [len(x) for x in spelling.values()]
        flat = np.repeat(ids, width)
        put = np.cumsum(width) - width
        for i, x in spelling.items():
            flat[put[i]:put[i] + len(x)] = x
        lengths = np.bincount(path_unit, width, len(units)).astype(np.int64)
        known = len(self.names)
        self.index.update(zip(units, range(known, known + len(units))))
        self.names.extend(units)
        self.ids = np.concatenate((self.ids, flat.astype(np.int32)))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(lengths)))
        self.best = np.concatenate((self.best, one[last]))
        self.gap = np.concatenate((self.gap, one[last] - two[last]))

    def _spell(self, char: str) -> list[int]:
        return self.bytes[list(char.encode("utf-8", "surrogatepass"))].tolist()

    # --- backward A-star over one unit ---

    def search(self, unit: str, count: int) -> list[tuple[float, list[int]]]:
        """The ``count`` best segmentations of a unit with their scores, best first."""
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(len(unit) + 1)]
        for start in range(len(unit)):
            node, spelled = 0, False
            for end in range(start + 1, min(len(unit), start + self.longest) + 1):
                node = self.children.get(node << 21 | ord(unit[end - 1]), -1)
                if node < 0:
                    break
                if self.ends[node] >= 0:
                    into[end].append((start, float(self.scores[self.ends[node]]), int(self.ends[node])))
                    spelled = spelled or end == start + 1
            if not spelled:
                into[start + 1].append((start, float(self.scores[-1]), -1))
        forward = [0.0] + [-np.inf] * len(unit)
        for end in range(1, len(unit) + 1):
            forward[end] = max((forward[start] + worth for start, worth, _ in into[end]), default=-np.inf)
        agenda = [(-forward[-1], 0, len(unit), 0.0, ())]
        found, serial = [], 0
        while agenda and len(found) < count:
            _, _, node, score, path = heapq.heappop(agenda)
            if node == 0:
                ids: list[int] = []
                while path:
                    (start, kind), path = path
                    ids.extend(self._spell(unit[start]) if kind < 0 else [kind])
                found.append((score, ids))
                continue
            for start, worth, kind in into[node]:
                if forward[start] > -np.inf:
                    serial += 1
                    heapq.heappush(agenda, (-(score + worth + forward[start]), serial, start, score + worth,
                                            ((start, kind), path)))
        return found

    def _alternatives(self, k: int, count: int) -> list[tuple[float, list[int]]]:
        """Loss and pieces of a known unit's segmentations from the second best on."""
        found = self.several.get((self.names[k], count))
        if found is None:
            best = self.ids[self.starts[k]:self.starts[k + 1]].tolist()
            ranked = self.search(self.names[k], count)
            others = [x for x in ranked if x[1] != best][:count - 1]
            found = [(ranked[0][0] - score, ids) for score, ids in others]
            self.several[self.names[k], count] = found
        return found

    # --- texts ---

    def encode(self, texts: list[str | None], count: int = 1) -> list[tuple[np.ndarray, float, list] | None]:
        """Pieces, score and ``count`` best segmentations of each text; None for None.

        A segmentation is its score and its changes against the best: the place in the pieces, how many go
        there, and the pieces that come instead.
        """
        split = [None if t is None else self.unit.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        if len(self.index) > _REMEMBERED:
            self._forget()
        fresh: set[str] = set()
        for mine in split:
            if mine:
                fresh |= set(mine).difference(self.index)
        some, size = [], 0
        for unit in fresh:
            some.append(unit)
            size += len(unit)
            if size > _AT_ONCE:
                self._learn(some)
                some, size = [], 0
        if some:
            self._learn(some)
        return [None if mine is None else self._put_together(mine, count) for mine in split]

    def _put_together(self, units: list[str], count: int) -> tuple[np.ndarray, float, list]:
        at = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        sizes = self.starts[at + 1] - self.starts[at]
        places = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        ids = self.ids[np.arange(total) - np.repeat(places - self.starts[at], sizes)]
        score = float(self.best[at].sum())
        ranked = [(score, [])]
        if count > 1 and len(units):
            gaps = self.gap[at]
            if len(gaps) >= count:
                limit = np.partition(gaps, count - 2)[count - 2]
                near = np.concatenate((np.flatnonzero(gaps < limit), np.flatnonzero(gaps == limit)))[:count - 1]
            else:
                near = np.arange(len(gaps))
            near = np.sort(near[np.isfinite(gaps[near])])
            options = [self._alternatives(int(at[i]), count) for i in near]
            # Ranks of the units' segmentations, in order of total loss; each is reached from one parent only.
            agenda = [(0.0, (0,) * len(near))]
            while agenda and len(ranked) <= count:
                loss, ranks = heapq.heappop(agenda)
                changes = [(int(places[i]), int(sizes[i]), options[j][ranks[j] - 1][1])
                           for j, i in enumerate(near) if ranks[j]]
                if changes:
                    ranked.append((score - loss, changes))
                last = max((j for j, rank in enumerate(ranks) if rank), default=0)
                for j in range(last, len(near)):
                    if ranks[j] < len(options[j]):
                        more = options[j][ranks[j]][0] - (options[j][ranks[j] - 1][0] if ranks[j] else 0.0)
                        heapq.heappush(agenda, (loss + more, (*ranks[:j], ranks[j] + 1, *ranks[j + 1:])))
        return ids, score, ranked[:count]

    def decode(self, ids: np.ndarray) -> str:
        """The text that pieces spell; bytes that are not UTF-8 become U+FFFD, ids out of range nothing."""
        return _spelled(self.text, ids)


def _spelled(text: list[bytes], ids: np.ndarray) -> str:
    ids = np.where((ids >= 0) & (ids < len(text)), ids, len(text) - 1)
    return b"".join([text[i] for i in ids.tolist()]).decode("utf-8", "replace").removeprefix(" ")


def with_pieces(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", count: int = 1) -> DataFrame:
    """``docs`` with ``ids`` (pieces of the best segmentation), ``score`` and ``nbest``.

    ``nbest`` has the ``count`` best segmentations in order, fewer if there are fewer: score and changes against
    ``ids``, each the place, the number of pieces that go and the pieces that come. NULL has NULL in all three, an
    empty text no pieces and score 0. U+2581 is read as a blank, as it always is in such vocabularies. Columns
    of these names are replaced, all others pass unread; repeated rows each get theirs.
    """
    ours = ["ids", "score", "nbest"]
    # A text that is a string already goes through once, for the pieces and as a column.
    returned = [text_col] if text_col in others(docs, *ours) and docs.schema[text_col].dataType == T.StringType() else []
    passed = others(docs, *ours, *returned)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct(
            [("at", pa.int32()), ("old", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
        for piece in pieces_of(batches):
            found = shared.value.encode(piece.column(0).to_pylist(), count)
            none = np.array([x is None for x in found], bool)
            sizes = np.array([0 if x is None else len(x[0]) for x in found], np.int64)
            flat = np.concatenate([x[0] for x in found if x is not None] or [np.zeros(0, np.int32)])
            ids = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat, pa.int32()),
                mask=pa.array(none))
            scores = pa.array([None if x is None else x[1] for x in found], pa.float64())
            nbest = pa.array([None if x is None else [
                {"score": s, "changes": [{"at": a, "old": o, "ids": i} for a, o, i in changes]}
                for s, changes in x[2]] for x in found], kinds)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:len(returned)], piece.column(1), ids, scores, nbest], names=["_text"][:len(returned)] + ["_row", *ours])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), packed(passed))
    schema = T.StructType([*rows.schema.fields[:len(returned)], rows.schema["_row"],
                           *T.StructType.fromDDL(f"ids array<int>, score double, nbest {_CHANGES}")])
    kept = dict(zip(passed, unpacked(passed))) | {c: F.col("_text").alias(c) for c in returned}
    return arrow_map(rows, work, schema).select(*[kept[c] for c in others(docs, *ours)], *ours)


def with_text(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its pieces spell; NULL pieces spell NULL, none an empty text."""
    passed = others(encoded, ids_col, text_col)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(at, 1000) for at in range(0, len(batch), 1000)):
                column = piece.column(0)
                flat = column.flatten().fill_null(-1).to_numpy()
                ends = np.cumsum(np.nan_to_num(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64))
                none = column.is_null().to_pylist()
                texts = [None if gone else _spelled(shared.value, flat[a:b])
                         for a, b, gone in zip([0, *ends[:-1].tolist()], ends.tolist(), none)]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], names=["_ids", "_row", "_text"])

    rows = encoded.select(F.col(f"`{ids_col}`").alias("_ids"), packed(passed))
    schema = T.StructType([rows.schema["_ids"], rows.schema["_row"], T.StructField("_text", T.StringType())])
    found = arrow_map(rows, work, schema)
    return found.select(*unpacked(passed), F.col("_ids").alias(ids_col), F.col("_text").alias(text_col))
