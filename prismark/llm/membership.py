"""A Bloom filter of bounded size that thins a table before it is shuffled. It never changes a result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash

#: Words of 64 bits if not said otherwise: one megabyte, however many ids there are. Too many ids only make the filter let more through.
WORDS = 1 << 17


class Filter:
    def __init__(self, words: np.ndarray):
        self.words = words

    def __contains__(self, ids) -> bool:
        return bool(self.maybe(np.asarray([ids]))[0])

    def maybe(self, ids: np.ndarray) -> np.ndarray:
        """Whether each 64-bit id may be in the set; true for all that are."""
        out = np.ones(len(ids), bool)
        for salt in (1, 2):
            h = wordhash.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(salt))
            out &= (self.words[(h >> np.uint64(6)) % np.uint64(len(self.words))] >> (h & np.uint64(63))) & np.uint64(1) == 1
        return out


def _bits(size: int):
    """The filter of each task, as its words that are not zero."""

    def run(batches):
        import pyarrow as pa

        words = np.zeros(size, np.uint64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for salt in (1, 2):
                h = wordhash.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(salt))
                np.bitwise_or.at(words, ((h >> np.uint64(6)) % np.uint64(size)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
        place = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(words[place].view(np.int64))], names=["place", "word"])

    return run


def filter_of(ids: DataFrame, size: int = WORDS) -> Filter:
    """A filter of the long column `ids`; the driver receives its `size` words, united by place, and nothing else."""
    united = ids.mapInArrow(_bits(size), "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(size, np.uint64)
    words[united.column("place").to_numpy()] = united.column("word").to_numpy().view(np.uint64)
    return Filter(words)
