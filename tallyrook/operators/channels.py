"""Candidate channels of a search: words of queries (see sources/text_index.py for BM25), and exact cosine similarity over vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrook.functions.text import tokens

K1, B = 1.2, 0.75

def ranked(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The k best of each query, by score, then id, with 0-based rank. Spark cuts each partition to k before it exchanges."""
    best = Window.partitionBy("qid").orderBy(F.desc(score), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < k)


def query_words(queries: DataFrame) -> DataFrame:
    """qid, token and words (how many different ones the query has) of queries (qid, text)."""
    held = queries.select("qid", tokens(F.col("text")).alias("tokens"))
    return held.select("qid", F.explode("tokens").alias("token"), F.size("tokens").alias("words"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def renormalised(vector: Column, dimensions: int) -> Column:
    """The first dimensions of a vector, at norm 1; null where they are all zero."""
    head = F.slice(vector, 1, dimensions)
    norm = F.sqrt(dot(head, head))
    return F.when(norm > 0, F.transform(head, lambda x: x / norm))


def sound(vector: Column, dimensions: int, tolerance: float = 0.02) -> Column:
    """Whether a vector is of the dimension, finite throughout, and of norm 1, nearly."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimensions) & finite & (F.abs(F.sqrt(dot(vector, vector)) - 1) <= tolerance), F.lit(False))


def _cut(a: int, score: np.ndarray, of: np.ndarray, k: int, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The k best of each row by score, then id, where there are more than `most`."""
    if score.shape[1] <= most:
        return a, score, of
    order = np.lexsort((of, -score), axis=-1)[:, :k]
    return a, np.take_along_axis(score, order, axis=1), np.take_along_axis(of, order, axis=1)


#: Queries of a dense search at most: each is compared with every vector.
MOST_QUERIES = 20_000


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 9, block: int = 256) -> DataFrame:
    """qid, doc_id, similarity (0 to 1), rank from queries (qid, vector) and vectors (doc_id, vector), all of norm 1.

    A stated set of queries is compared with all vectors: exact matrix products, a block of queries by an Arrow batch of vectors,
    of which each task hands on no more than k rows a query. The query side (MOST_QUERIES at most, checked) is broadcast.
    """
    rows = queries.select("qid", "vector").limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"a dense search takes at most {MOST_QUERIES} queries")
    qids = np.array([r["qid"] for r in rows], np.int64)
    held = queries.sparkSession.sparkContext.broadcast((qids, np.array([r["vector"] for r in rows], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_, q = held.value
        blocks = [(a, np.zeros((len(q[a : a + block]), 0)), np.zeros((len(q[a : a + block]), 0), np.int64)) for a in range(0, len(ids_), block)]
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("doc_id").to_numpy(zero_copy_only=False)
            by = np.argsort(own)
            v = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)[by]
            for i, (a, score, of) in enumerate(blocks):
                likeness = np.clip(np.round((q[a : a + block] @ v.T + 1) / 2, digits), 0, 1)
                columns = np.tile(np.arange(len(own)), (len(likeness), 1))
                if len(own) > k:  # the best of the batch, ties by id: by one whole number each
                    keys = np.round(likeness * 10**digits).astype(np.int64) * len(own) - np.arange(len(own))
                    columns = np.argpartition(-keys, k - 1, axis=1)[:, :k]
                score = np.append(score, np.take_along_axis(likeness, columns, axis=1), axis=1)
                blocks[i] = _cut(a, score, np.append(of, own[by][columns], axis=1), k, 3 * k)
        for a, score, of in (_cut(*x, k, k) for x in blocks):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids_[a : a + block], score.shape[1])), pa.array(of.ravel()), pa.array(score.ravel())], ["qid", "doc_id", "similarity"])

    size = len(rows[0]["vector"]) if rows else 0  # vectors of another dimension have no likeness
    return ranked(vectors.filter(F.size("vector") == size).select("doc_id", "vector").mapInArrow(run, "qid long, doc_id long, similarity double"), "similarity", k)


# --- searches of any number of queries: blocks of queries meet blocks of vectors ---------------------------------
#: Bytes of the vectors of a block, and how many vectors of a small table are worth a block of their own.
BLOCK, LEAST = 8 << 20, 1024
#: Queries and vectors whose likenesses are in memory at once; of the first vectors fewer, since a query that has no k yet may take them all.
TILE, FIRST = (256, 2048), 256


def block_rows(size: int) -> int:
    """How many vectors of a size a block holds."""
    return max(1, BLOCK // (8 * max(size, 1)))


def vector_rows(n: int, size: int, cores: int) -> int:
    """How many of n vectors a block holds: fewer where a table is small, so that each core has some."""
    return min(block_rows(size), max(LEAST, -(-n // (2 * cores))))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _finite(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    vectors = matrix(rows.column("vector").combine_chunks())
    good = np.isfinite(vectors).all(axis=1)
    return (rows, vectors) if good.all() else (rows.filter(pa.array(good)), vectors[good])


def _take(like: np.ndarray, of: np.ndarray, rows: np.ndarray, products: np.ndarray, ids: np.ndarray, digits: int) -> None:
    """Takes products of some rows' vectors with those of ids, ascending, into the rows' best (like, and of whom), by likeness, then id."""
    k, step = like.shape[1], 10.0**-digits
    held, whose = like[rows], of[rows]
    # What lies below the floor cannot be rounded to as much as a row's last one has, or to more where all ids are larger, so that a vector of very many
    # copies costs no more than others. A row of fewer than k takes k of these products, and what may equal them.
    least = held[:, -1]
    floor = np.where(least > 0, 2 * least - 1 - 1.01 * step, -np.inf)
    floor = np.where(whose[:, -1] < ids[0], np.where(least < 1, 2 * least - 1 + 0.99 * step, np.inf), floor)
    if products.shape[1] > k and (least < 0).any():
        kth = np.minimum(np.partition(products, -k, axis=1)[:, -k], 1)
        floor = np.maximum(floor, np.where(kth > 2.02 * step - 1, kth - 2.02 * step, -np.inf))
    row, at = np.divmod(np.flatnonzero(products >= floor[:, None]), products.shape[1])
    new, who = np.clip(np.round((products[row, at] + 1) / 2, digits), 0, 1), ids[at]
    better = (new > least[row]) | ((new == least[row]) & (who < whose[row, -1]))
    if not better.any():
        return
    row, new, who = row[better], new[better], who[better]
    own = np.unique(row)
    row, new, who = np.append(np.repeat(own, k), row), np.append(held[own], new), np.append(whose[own], who)
    by = np.lexsort((who, -new, row))
    first = np.searchsorted(row[by], own)
    by = by[first[:, None] + np.arange(k)]
    like[rows[own]], of[rows[own]] = new[by], who[by]


def best_of(left: pa.Table, right: pa.Table, k: int, digits: int, meet: Callable | None = None) -> pa.Table:
    """qid, doc_id and similarity: for each of left (qid, vector), the k best of right (doc_id, vector) by similarity, then id. meet gives places of
    queries and of vectors that are compared; else all are. Vectors that are not finite have no likeness."""
    out = {"qid": np.array([], np.int64), "doc_id": np.array([], np.int64), "similarity": np.array([])}
    if left.num_rows and right.num_rows:
        (left, q), (right, v) = _finite(left), _finite(right)
        qids, ids = left.column("qid").to_numpy(), right.column("doc_id").to_numpy()
        like, of = np.full((len(q), k), -1.0), np.full((len(q), k), np.iinfo(np.int64).max)
        for mine, theirs in meet(left, right) if meet else [(np.arange(len(q)), np.arange(len(v)))]:
            theirs = theirs[np.argsort(ids[theirs], kind="stable")]
            cuts = [0, *range(FIRST, len(theirs), TILE[1]), len(theirs)]
            for some in (theirs[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b):
                part = v[some].T
                for a in range(0, len(mine), TILE[0]):
                    rows = mine[a : a + TILE[0]]
                    _take(like, of, rows, q[rows] @ part, ids[some], digits)
        there = like >= 0
        out = {"qid": np.repeat(qids, there.sum(axis=1)), "doc_id": of[there], "similarity": like[there]}
    return pa.table(out)


def cosine_top_blocks(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The rows of cosine_top() for any number of queries, each compared with every vector of its dimension.

    Nothing is collected or broadcast: a task has a block of queries and a block of vectors (BLOCK bytes each), and hands on k rows a query. So the
    time grows with the product of both tables; a row is exchanged once for each block of the other side.
    """
    asked, held = (x.filter(F.size("vector") > 0).select(F.col(i).cast("long"), "vector", F.size("vector").alias("size")) for x, i in ((queries, "qid"), (vectors, "doc_id")))
    many = asked.count()
    n, size = held.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(1))).first()
    mine = max(1, -(-many // block_rows(size)))
    theirs = max(1, -(-n // vector_rows(n, size, queries.sparkSession.sparkContext.defaultParallelism)))
    dealt = lambda i, blocks: F.pmod(F.xxhash64(i, "vector"), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = asked.withColumn("mine", dealt("qid", mine)).withColumn("theirs", each(theirs))
    held = held.withColumn("theirs", dealt("doc_id", theirs)).withColumn("mine", each(mine))

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return best_of(left, right, k, digits)

    keys = ["size", "mine", "theirs"]
    return ranked(asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(score, "qid long, doc_id long, similarity double"), "similarity", k)
