"""Near copies by bottom-k sketches of one hash function.

A document's set is its distinct shingles of five words, by their hashes; the K least of them are its sketch, a sample of the set
that any two sets draw alike: the K least of two sketches together (the union sketch) are a sample of both sets' union, and
the share of it that both retain estimates their Jaccard similarity.

1. Sketches are compared over all documents through tallyrook.llm.repeats: a document of whose retained values too few stand in other
   sketches has no link, and most documents end here. Equal sets become one class.
2. A pair that the estimate lets pass shares NEEDED of a sketch's values, and more where sets are little larger than sketches (surely_shared),
   so two such sketches share one of their rarest (the prefix); sets that share some come into one block (tallyrook.llm.blocks). A passage that
   many texts have makes no block unless it is most of a sketch.
3. In a chunk of a block, inverted lists say for each retained value which sketches have it. A set that asks gathers the lists of its
   values; the overlaps, counted, give candidates, the union sketch filters them, and the whole sets verify them.

Of sets of at most K shingles the sketch is the set and the estimate exact, so nothing is lost. Of larger ones, a pair at the
threshold is lost if fewer than NEEDED of K drawn shingles are common: by Chernoff's bound less than once in 10 ** 10 such pairs.

Null and empty texts have no shingles and no links. Texts of fewer than five words are one shingle. A very long text is one set: its task
holds about a hundred bytes a word of it, its sketch is as small as any. Repeated rows, and rows with equal texts, are of one class. A
null doc_id takes part, takes the least id of its component, and is kept only where that has none. An empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrook.llm import blocks
from tallyrook.llm import repeats as r
from tallyrook.llm.jaccard_join import COMPONENTS_SQL

#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Values of a sketch; in percent, the least estimate of a pair that is verified, where a sketch isn't the whole set.
K, NEEDED = 128, 60


def least_shared(sizes: np.ndarray) -> np.ndarray:
    """How many of its retained values a set of each size shares at least with another that it links with, if the estimate lets the pair pass."""
    whole = 100 * sizes <= PERCENT * K  # whatever links with it is retained whole too
    passing = -(-np.where(whole, PERCENT, NEEDED) * np.minimum(sizes, K) // 100)
    smallest, largest = -(-PERCENT * sizes // 100), 100 * sizes // PERCENT  # between these the bound falls from some size on, and rises up to it
    return np.maximum(passing, np.minimum(surely_shared(sizes, smallest), surely_shared(sizes, largest)))


def surely_shared(sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many retained values two sets of these sizes share at least, if they link: of the sketch that ends first, all that the
    other set has is in the other's sketch too. For sets of many times K, nothing (or less)."""
    common = -(-PERCENT * (sizes + others) // (100 + PERCENT))
    return common - np.maximum(np.maximum(sizes, others) - K, 0)


def retained(sizes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where the sketches stand among sets in order of hashes, of those sizes and beginnings."""
    kept = np.minimum(sizes, K)
    return np.repeat(begin[:-1] - np.append(0, np.cumsum(kept)[:-1]), kept) + np.arange(kept.sum())


def _sketches(sets: blocks.ShingleSets) -> r.Runs:
    return r.Runs.of(sets.hashes[retained(sets.size, sets.begin)])


def _tell(sets: blocks.ShingleSets, part: pa.Table, runs: r.Runs, elsewhere: np.ndarray, level: np.ndarray) -> pa.Table:
    """Only where a link is possible is there a class, and there the whole set."""
    at = retained(sets.size, sets.begin)
    several = np.diff(np.append(runs.begin, len(at))) > 1
    shared, level = runs.spread(elsewhere | several), runs.spread(level)
    count = np.bincount(sets.row[at[shared]], minlength=len(sets.size))
    needed = least_shared(sets.size)
    able = (sets.size > 0) & (count >= needed)
    pick = np.flatnonzero(shared & able[sets.row[at]])
    pick = at[pick[blocks.rarest(sets.row[at[pick]], level[pick], sets.hashes[at[pick]], np.maximum(count - needed + 1, 0))]]
    return blocks.told(sets, part, able, (sets.hashes[pick], sets.row[pick]), np.ones(len(sets.hashes), bool))


class InvertedLists:
    """Of a chunk, the sets by retained value."""

    def __init__(self, chunk: blocks.Chunk):
        self.chunk, n = chunk, len(chunk.sizes)
        kept = np.minimum(chunk.sizes, K)
        at = retained(chunk.sizes, chunk.begin)
        owner = np.repeat(np.arange(n), kept)
        self.begin = np.append(0, np.cumsum(kept))
        values = chunk.shingles.view(np.uint64)[at]
        self.lists = blocks.Lists(values, owner, n)
        self.least = np.maximum(least_shared(chunk.sizes), 1)
        self.sketches = np.full((n, K), np.iinfo(np.uint64).max)
        self.sketches[owner, np.arange(len(owner)) - self.begin[owner]] = values

    def updated(self) -> None:
        """Labels are read as they are."""

    def search(self, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both sets of every pair that may meet (Chunk.meet), whose estimate is enough; of each set, the largest overlaps first."""
        a, b, sizes = [], [], self.chunk.sizes
        for x in asking.tolist():
            overlap = self.lists.overlaps(np.arange(self.begin[x], self.begin[x + 1]))
            found = np.flatnonzero((overlap >= self.least) & (overlap >= surely_shared(sizes[x], sizes)) & self.chunk.meet(x))
            found = found[self.alike(x, found)]
            found = found[np.argsort(-overlap[found], kind="stable")]
            a.append(np.full(len(found), x))
            b.append(found)
        return np.concatenate(a), np.concatenate(b)

    def alike(self, x: int, others: np.ndarray) -> np.ndarray:
        """Whether the union sketches of x with others let them pass."""
        sizes = self.chunk.sizes
        both = np.sort(np.concatenate([np.tile(self.sketches[x], (len(others), 1)), self.sketches[others]], axis=1), axis=1)
        real = both[:, 1:] != np.iinfo(np.uint64).max
        again = (both[:, 1:] == both[:, :-1]) & real
        place = 1 + np.cumsum(~again & real, axis=1)  # of the different values, from 1
        distinct = place[:, -1]
        common = (again & (place <= K)).sum(axis=1)
        exact = (sizes[x] <= K) & (sizes[others] <= K) & (distinct <= K)
        return 100 * common >= np.where(exact, PERCENT, NEEDED) * np.minimum(distinct, K)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id is component_id) of each of docs."""
    found = blocks.similar_components(blocks.shingle_sets(docs, _sketches, _tell), PERCENT, InvertedLists)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


NEAR_COPIES_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({COMPONENTS_SQL.replace('>= 75 *', '>= 85 *')})"
