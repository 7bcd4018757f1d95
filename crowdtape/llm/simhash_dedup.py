"""Near-duplicate documents by SimHash, with every pair within the radius found.

Fingerprints are compared through covering locality-sensitive hashing. Every bit position gets a nonzero
vector of radius + 1 bits, and every nonzero vector v a mask that keeps the positions whose vector has an
odd product with v. For any ``radius`` positions some v is orthogonal to all their vectors, so its mask
leaves exactly those positions out: two fingerprints that differ nowhere else agree under that mask. The
2^(radius+1) - 1 masks keep about half of the bits each, and no pair within the radius escapes them.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from crowdtape.llm.common import arrow_map, components
from crowdtape.sources.staging import staged

BITS = 64
SHINGLE = 5
RADIUS = 3
# Fingerprints that agree under a mask are compared in one task up to this many; more are first divided
# by further masks over the bits that the mask leaves out.
BUCKET = 2048
_SLICE = 1 << 18


# --- fingerprints ---

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased word shingles of a text; a text without words has 0."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    size = min(shingle, len(tokens))
    count = len(tokens) - size + 1
    ends = (starts + lengths)[size - 1:].tolist()
    starts = starts[:count].tolist()
    digest = xxhash.xxh64_digest
    totals = np.zeros(BITS, np.int64)
    for at in range(0, count, _SLICE):
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at:at + _SLICE], ends[at:at + _SLICE])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS)
        totals += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(totals * 2 > count).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      shingle: int = SHINGLE) -> DataFrame:
    """``id_col`` and ``_fp``, the fingerprint as a signed long, for every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), shingle) for text in batch.column(1)]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["_id", "_fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = arrow_map(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")),
                      work, f"_id {kind}, _fp long")
    return found.withColumnRenamed("_id", id_col)


# --- covering masks ---

def covering_masks(free: int, radius: int = RADIUS) -> list[int]:
    """Masks over the set bits of ``free`` such that any ``radius`` of them are all left out by one."""
    positions = [i for i in range(BITS) if free >> i & 1]
    vectors = (1 << radius + 1) - 1
    return [
        sum(1 << at for n, at in enumerate(positions) if (n % vectors + 1 & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> BITS - 1 else mask


def links_within(fps: DataFrame, fp_col: str = "_fp", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links ``a``, ``b`` that connect exactly the distinct fingerprints that chains of pairs within
    the radius connect; not every such pair has a link of its own.

    Fingerprints meet in the buckets of all masks. A bucket of at most ``bucket`` is compared whole and
    yields a spanning forest, so at most as many links as it has members. A larger one is dealt out
    again, by covering masks over the bits its mask leaves out, which loses no pair either; after three
    levels at most 2^7 distinct fingerprints can share a bucket, so this ends.
    """
    spark = fps.sparkSession
    rows = fps.select(F.col(fp_col).alias("fp"), F.lit(0).cast("long").alias("fixed"))
    everything = (1 << BITS) - 1
    masks, found, level = {0: covering_masks(everything, radius)}, None, 0
    while True:
        level += 1
        deal = spark.createDataFrame(
            [(_signed(old), [_signed(old | new) for new in sub]) for old, sub in masks.items()],
            "fixed long, deeper array<long>")
        dealt = rows.join(F.broadcast(deal), "fixed").select("fp", F.explode("deeper").alias("fixed")).distinct()
        keyed = dealt.select("fp", "fixed", F.col("fp").bitwiseAND(F.col("fixed")).alias("key"))
        sizes = keyed.groupBy("fixed", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        shared = staged(keyed.join(sizes, ["fixed", "key"]), "buckets")
        large = shared.agg(F.max("members")).first()[0] or 0
        last = all(_left_out(old | new) <= 7 for old, sub in masks.items() for new in sub)
        small = shared if last else shared.where(F.col("members") <= bucket)
        grouped = small.groupBy("fixed", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        links = arrow_map(grouped, _compare(radius), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if last or large <= bucket:
            return found
        rows = shared.where(F.col("members") > bucket).select("fp", "fixed")
        masks = {old | new: covering_masks(everything & ~(old | new), radius)
                 for old, sub in masks.items() for new in sub}


def _left_out(mask: int) -> int:
    return BITS - mask.bit_count()


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(seed, member) for every member that chains of near pairs connect to an earlier seed."""
    rest, links = np.unique(fps), []
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        reached = [seed]
        while reached and len(rest):
            near = np.bitwise_count(rest ^ reached.pop()) <= radius
            if near.any():
                reached.extend(rest[near])
                links.extend((seed, x) for x in rest[near])
                rest = rest[~near]
    return links


def _compare(radius: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat = column.flatten().to_numpy().view(np.uint64)
            ends = np.asarray(column.offsets) - column.offsets[0].as_py()
            links: list[tuple[int, int]] = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if b - a == 2:
                    if np.bitwise_count(flat[a] ^ flat[a + 1]) <= radius:
                        links.append((flat[a], flat[a + 1]))
                else:
                    links.extend(spanning_links(flat[a:b], radius))
            both = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])
    return work


# --- classes ---

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits), ``component_id``, ``kept``, one row per input row.

    ``component_id`` is the smallest id reachable over fingerprints that differ in at most ``radius``
    bits; ``kept`` marks the rows that carry it. Texts that are NULL, empty or white space only have
    fingerprint 0 and link like any other. Repeated rows stay, each with the same answer. A row without
    id takes part; its component's id comes from the others and is NULL only where none has one. Other
    columns of ``docs`` are not read.
    """
    rows = staged(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = staged(rows.groupBy("_fp").agg(F.min(id_col).alias("_first")), "distinct-fingerprints")
    roots = components(links_within(fps, "_fp", radius, bucket), "a", "b")
    placed = fps.join(roots, fps["_fp"] == roots["node"], "left").select(
        "_fp", "_first", F.coalesce("root", "_fp").alias("_root"))
    firsts = placed.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = placed.join(firsts, "_root").select("_fp", "component_id")
    return rows.join(named, "_fp").select(
        id_col, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one document left of each group that ``near_duplicates`` makes: its smallest id.

    Rows that share an id and a text are one document, of which one row stays; rows that share an id but
    not the text stand or go together. A row without id counts as having a large one made from its text
    (2^62 and up), so it goes where another row of its group has an id, and one text of a group stays.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text.alias("_text"),
        F.xxhash64(text).alias("_hash"), F.col(f"`{id_col}`").cast("long").alias("_id"))
    unnamed = F.col("_hash").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    keyed = keyed.select("_row", "_text", "_hash", F.coalesce("_id", unnamed).alias("_key"))
    found = near_duplicates(keyed.select("_key", "_text"), "_key", "_text", **options)
    kept = found.where("kept").select("_key").distinct()
    mine = keyed.select("_row", "_hash", "_key").join(kept, "_key", "left_semi")
    return mine.dropDuplicates(["_key", "_hash"]).select("_row.*")
