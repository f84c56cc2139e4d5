"""N-gram Jaccard self-join with count vectors in R-trees.

A document's set is its distinct shingles of five words. Shingles are hashed into GROUPS groups, and the counts of the groups
are a point. Two sets share at most the sum of the lesser coordinates of their points; a node of an R-tree over points
holds, for each coordinate, the greatest below it, and the same sum with those bounds what any set below it shares. The
tree of a chunk is built once, and descended by many points at once; the pairs that survive are verified on the sets themselves.
After links its nodes learn the labels of what is connected now: what has a point's own label is not searched for it.

Points of unrelated texts of one length are alike, so one tree over all documents would prune little; what goes into a
tree together is decided exactly first:

1. A link takes three quarters of either set, so a document with fewer than that of its shingles in any other document
   has no link. Which shingles are shared is asked through tallyrook.llm.repeats. Most documents end here.
2. Equal sets become one class.
3. Ordered by how few parts of the table have them, two linked sets share one of their first shingles (the prefix: what is left
   if three quarters are missing, plus one). tallyrook.llm.blocks makes blocks and chunks of the classes that share some. What
   many texts share comes late in the order, so that a common passage makes no block unless it is most of a text.

No link between different sets is lost: it is given, or implied by given ones. Classes meet as rows of joins, in tasks of bounded
size; nothing is collected but counts.

Words are told apart by 128 bits of their letters and shingles by 64; sets of one class share 128 bits of a digest.

Null and empty texts have no shingles and no links. Texts of fewer than five words are one shingle. A very long text is one set: its task
holds about a hundred bytes a word of it. Repeated rows, and rows with equal texts, are of one class. A null doc_id takes
part, and takes the least id of its component. An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyrook.llm import blocks
from tallyrook.llm import repeats as r

GROUPS = 256
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Points in a leaf, nodes in a node.
LEAF, FANOUT = 16, 16


def _every(sets: blocks.ShingleSets) -> r.Runs:
    return r.Runs.of(sets.hashes)


def _tell(sets: blocks.ShingleSets, part: pa.Table, runs: r.Runs, elsewhere: np.ndarray, level: np.ndarray) -> pa.Table:
    """Only where a link is possible is there a class, and there the shingles that other documents have too."""
    several = np.diff(np.append(runs.begin, len(sets.hashes))) > 1
    shared, level = runs.spread(elsewhere | several), runs.spread(level)
    count = np.bincount(sets.row[shared], minlength=len(sets.size))
    able = (sets.size > 0) & (100 * count >= PERCENT * sets.size)
    needed = -(-PERCENT * sets.size // 100)
    at = np.flatnonzero(shared & able[sets.row])
    at = at[blocks.rarest(sets.row[at], level[at], sets.hashes[at], np.maximum(count - needed + 1, 0))]
    return blocks.told(sets, part, able, (sets.hashes[at], sets.row[at]), shared)


class CountTree:
    """An R-tree over the points of a chunk, of which only upper bounds matter. Its nodes also have the least size of the sets
    below and the range of their labels."""

    def __init__(self, chunk: blocks.Chunk):
        self.chunk = chunk
        self.points = points_of(chunk.shingles, chunk.begin)
        self.order = np.lexsort((chunk.sizes, chunk.root))
        self.levels, width = [(self.points[self.order], chunk.sizes[self.order])], LEAF
        while len(self.levels) == 1 or len(self.levels[-1][0]) > FANOUT:
            at = np.arange(0, len(self.levels[-1][0]), width)
            self.levels.append(tuple(f.reduceat(x, at) for f, x in zip((np.maximum, np.minimum), self.levels[-1], strict=True)))
            width = FANOUT
        self.updated()

    def updated(self) -> None:
        """Labels of all nodes, by what is connected now."""
        root = self.chunk.root[self.order]
        self.labels, width = [(root, root)], LEAF
        for points, _ in self.levels[1:]:
            at = np.arange(0, len(self.labels[-1][0]), width)
            self.labels.append((np.minimum.reduceat(self.labels[-1][0], at), np.maximum.reduceat(self.labels[-1][1], at)))
            width = FANOUT

    def search(self, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both sets of every pair, of different labels, that may link."""
        n = len(self.levels[-1][0])
        query, node = np.repeat(asking, n), np.tile(np.arange(n), len(asking))
        for depth in range(len(self.levels) - 1, -1, -1):
            query, node = self._kept(query, node, *self.levels[depth], *self.labels[depth])
            if depth:
                width = LEAF if depth == 1 else FANOUT
                child = (node[:, None] * width + np.arange(width)).ravel()
                real = child < len(self.levels[depth - 1][0])
                query, node = np.repeat(query, width)[real], child[real]
        return query, self.order[node]

    def _kept(self, query, node, high, low, first, last, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        root, sizes = self.chunk.root, self.chunk.sizes
        other = (first[node] != root[query]) | (last[node] != root[query])
        query, node = query[other], node[other]
        keep = np.zeros(len(query), bool)
        for i in range(0, len(query), step):
            q, k = query[i : i + step], node[i : i + step]
            most = np.minimum(self.points[q], high[k]).sum(axis=1, dtype=np.int64)
            # 100 c >= P (a + b - c) for c shared, with the least b below the node that can link with a at all
            least = np.maximum(low[k], -(-PERCENT * sizes[q] // 100))
            keep[i : i + step] = (100 + PERCENT) * most >= PERCENT * (sizes[q] + least)
        return query[keep], node[keep]


def points_of(shingles: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Counts of shingles by group of the sets that begin at begin[i] and end before begin[i + 1]."""
    n = len(begin) - 1
    cells = np.repeat(np.arange(n), np.diff(begin)) * GROUPS + (shingles.view(np.uint64) & np.uint64(GROUPS - 1)).astype(np.int64)
    return np.bincount(cells, minlength=n * GROUPS).reshape(n, GROUPS).astype(np.int32)


def shingle_sets(docs: DataFrame) -> DataFrame:
    return blocks.shingle_sets(docs, _every, _tell)


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each of docs."""
    return blocks.similar_components(shingle_sets(docs), PERCENT, CountTree)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows that are not the least of their component: see blocks.keep_one_of_each()."""
    return blocks.keep_one_of_each(docs, shingle_sets(docs), PERCENT, CountTree)


#: A shingle's words are joined by one blank: no word contains one.
COMPONENTS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[s : s + 4], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM d WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least_ AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least_ FROM reach GROUP BY a) USING (doc_id)
"""
