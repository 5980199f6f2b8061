"""Near copies by a wide SimHash: sets meet by their strongest votes and are judged by differing bits of the fingerprint."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm import minhash
from scrivener.llm.common import mix

#: Blocks of votes, and votes in each.  In a block two sets of similarity .8 have the same strongest vote in 4 of 9 cases.
BLOCKS, VOTES = 144, 64
#: A table is keyed by the strongest votes of blocks i, i + a, i + b and i + c, with (a, b) from OFFSETS and c from FOURTH; no
#: two tables share two blocks.  Keys have 28 bits: with 21, a set in ten met others by chance in each table at 200,000 sets.
OFFSETS, FOURTH = ((1, 3), (4, 9)), (11, 16)
#: So many tables are met in first; by the families that they show, the others have fewer rows.
FIRST = 48
_STREAMS = mix(np.arange(1, BLOCKS * VOTES // 64 + 1, dtype=np.uint64))


def votes(grams: np.ndarray) -> np.ndarray:
    """The SimHash's votes of a set of hashes: for each of BLOCKS * VOTES bits, hashes that have it less those that don't."""
    ones = np.zeros(BLOCKS * VOTES, np.int64)
    for at in range(0, len(grams), 255):  # so many bits fit into a byte's count
        words = mix(grams[at : at + 255, None] ^ _STREAMS)
        ones += np.add.reduce(np.unpackbits(words.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return 2 * ones - len(grams)


def strongest(votes: np.ndarray) -> np.ndarray:
    """For each block, the place and the sign of its strongest vote as a number under 2 * VOTES."""
    block = votes.reshape(BLOCKS, VOTES)
    at = np.abs(block).argmax(axis=1)
    return (2 * at + (block[np.arange(BLOCKS), at] > 0)).astype(np.uint64)


def of(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest votes and fingerprint of a set; of the fingerprint as many bits as a sketch has."""
    cast = votes(grams)
    return strongest(cast), np.packbits(cast[: minhash.BITS] > 0, bitorder="little").view(np.uint64)


def keys(strong: Column) -> Column:
    """A key for each table."""

    def table(*others: int) -> Column:
        return F.transform(strong, lambda x, i: sum(((2 * VOTES) ** (n + 1) * strong[(i + at) % BLOCKS] for n, at in enumerate(others)), x))

    return F.flatten(F.array(*[table(a, b, c) for (a, b), c in zip(OFFSETS, FOURTH)]))


def most_differing(percent: int) -> int:
    """Bits in which fingerprints of a pair with the similarity differ at most, but for minhash.DEVIATIONS of their spread.

    A bit differs with the angle between the sets' vectors; ties of votes add up to a quarter where sets are small.
    """
    j = percent / 100
    p = 1.25 * math.acos(2 * j / (1 + j)) / math.pi
    return math.floor(minhash.BITS * p + minhash.DEVIATIONS * math.sqrt(minhash.BITS * p * (1 - p)))


SIMHASH = minhash.Method(of, keys, most_differing, first=FIRST, more=True)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``minhash.groups`` (doc_id, part, n, root) with a SimHash in place of the MinHash: candidates meet by the strongest of its
    votes, pass by the bits in which their fingerprints differ, and are confirmed on their whole sets."""
    return minhash.groups(docs, id_col, text_col, width, percent, SIMHASH)
