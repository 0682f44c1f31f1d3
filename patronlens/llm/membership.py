"""A set of ids as a fixed-size bit table: never a false no, rarely a false yes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from patronlens.llm.words import mixed

# 2**25 bits are 4 MB, whatever the number of ids.
BITS = 25


@dataclass
class Membership:
    """Which ids may be in a table.  It only spares work: a later join decides."""

    words: np.ndarray

    @classmethod
    def of(cls, ids: DataFrame) -> Membership:
        """From the only column (long) of ``ids``.  At most 2**BITS / 64 rows reach the driver."""
        (name,) = ids.columns

        def places(frames):
            for frame in frames:
                at = _places(frame[name].to_numpy())
                yield frame.iloc[:0].assign(word=0, bits=0)[["word", "bits"]] if not len(at) else _packed(at)

        rows = ids.where(F.col(name).isNotNull()).mapInPandas(places, "word long, bits long")
        table = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(2 ** (BITS - 6), np.int64)
        words[table.column("word").to_numpy()] = table.column("bits").to_numpy()
        return cls(words.view(np.uint64))

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = _places(ids)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _places(ids: np.ndarray) -> np.ndarray:
    return mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITS)


def _packed(at: np.ndarray):
    import pandas as pd

    word = (at >> np.uint64(6)).astype(np.int64)
    order = np.argsort(word)
    word, bit = word[order], np.uint64(1) << (at[order] & np.uint64(63))
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    return pd.DataFrame({"word": word[first], "bits": np.bitwise_or.reduceat(bit, first).view(np.int64)})
