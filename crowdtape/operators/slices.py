"""Posts of a task, worked on in slices whose words lie one after the other."""

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array

# Words that one task unrolls: few enough that the distinct grams it has gathered fit in its memory. More of them
# would be sorted on disk, which costs many times as much as counting them.
WORDS_PER_TASK = 1 << 20


class Slice:
    """Posts of about ``WORDS_PER_TASK`` words in all: their keys, all words one after the other, and where each stands."""

    def __init__(self, keys: pa.Array, words: pa.Array, sizes: np.ndarray) -> None:
        self.keys, self.words, self.sizes = keys, words, sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.at = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.left = np.repeat(sizes, sizes) - self.at
        codes = words.dictionary_encode()
        self.distinct, self.there = codes.dictionary, codes.is_valid().to_numpy(zero_copy_only=False)
        self.code = codes.indices.fill_null(0).to_numpy().astype(np.int64)

    def among(self, some: pa.Array) -> np.ndarray:
        """The number of each word in a list of words, -1 where it is not there."""
        found = pc.index_in(self.distinct, value_set=some).fill_null(-1).to_numpy()
        return np.where(self.there, found[self.code], -1) if len(found) else np.full(len(self.code), -1)

    @cached_property
    def _of_word(self) -> np.ndarray:
        return hash_array(self.distinct.to_numpy(zero_copy_only=False), categorize=False)

    def hashes(self, places: np.ndarray, n: int) -> np.ndarray:
        """A number for the n words from each place on, the same wherever they stand."""
        found = np.zeros(len(places), np.uint64)
        for i in range(n):
            found = found * np.uint64(0x9E3779B97F4A7C15) + self._of_word[self.code[np.minimum(places + i, len(self.code) - 1)]]
        return found ^ (found >> np.uint64(29))

    def joined(self, places: np.ndarray, start: int, stop: int) -> pa.Array:
        """The words from ``start`` to ``stop`` behind each place, joined by a blank."""
        if start >= stop:
            return pa.repeat(pa.scalar("", pa.string()), len(places))
        parts = [self.words.take(pa.array(np.minimum(places + i, len(self.words) - 1))) for i in range(start, stop)]
        return parts[0] if stop == start + 1 else pc.binary_join_element_wise(*parts, " ", null_handling="skip")


def slices(batches: Iterator[pa.RecordBatch], most: int = WORDS_PER_TASK) -> Iterator[Slice]:
    for batch in batches:
        lists = batch.column(1)
        ends = lists.offsets.to_numpy().astype(np.int64)
        at = 0
        while at < len(batch):
            upto = min(len(batch), max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1))
            yield Slice(batch.column(0).slice(at, upto - at), lists.values.slice(ends[at], ends[upto] - ends[at]),
                         np.diff(ends[at:upto + 1]))
            at = upto
