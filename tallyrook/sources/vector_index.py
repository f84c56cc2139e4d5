"""An inverted-file index of vectors: cells around centres, probed by queries, with vectors added and deleted.

Centres are fitted by k-means on at most SAMPLE vectors (a documented sample; about the square root of the number of vectors, CENTRES at most); every
vector is indexed, in the cell of its nearest centre. A cell of more than PART vectors is dealt into parts, so that no task holds a hot one.
What makes up the index is told by a log (sources/versions.py): centres, segments and deletions.

A search deals the parts of cells to blocks of bounded size. A query's vector goes once to each block that holds cells it probes, with the names
of these cells, in Arrow batches of bounded size; a task has a block of queries and one of vectors, multiplies cell by cell and hands on k rows a query.
How many cells a query probes is measured when centres are fitted: as many as hold RECALL of the NEAR nearest neighbours of some sampled vectors, so that
vectors without clusters are probed more widely. The exact way is operators/channels.py cosine_top() or, for any number of queries, cosine_top_blocks();
recall() compares both.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.operators.channels import best_of, block_rows, matrix, ranked, vector_rows
from tallyrook.operators.store import small
from tallyrook.sources.versions import Log

c = F.col
#: Vectors that centres are fitted on, centres, vectors of a part; vectors whose neighbours tell how many cells are probed.
SAMPLE, CENTRES, PART, ASKED = 20_000, 4096, 20_000, 400
#: Pairs of a query and a block of a cell that it probes, of which a task makes rows at once.
PROBES = 1 << 18
#: The share of a sampled vector's nearest neighbours that its probes are to hold, and how many neighbours.
RECALL, NEAR = 0.96, 10
VECTORS = "cell int, part int, doc_id long, vector array<double>"


def fit_centres(vectors: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of norm 1 of vectors of norm 1, by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), cells, replace=False)]
    for _ in range(rounds):
        own = cells_of(vectors, centres, 4096)
        total = np.zeros_like(centres)
        np.add.at(total, own, vectors)
        norm = np.linalg.norm(total, axis=1)
        empty = norm < 1e-12
        centres = np.where(empty[:, None], vectors[rng.choice(len(vectors), cells)], total / np.maximum(norm, 1e-12)[:, None])
    return centres


def probes_for(vectors: np.ndarray, centres: np.ndarray) -> int:
    """How many cells hold RECALL of the NEAR nearest neighbours, among vectors, of the first ASKED of them."""
    asked = vectors[:ASKED]
    alike = asked @ vectors.T
    alike[np.arange(len(asked)), np.arange(len(asked))] = -2
    near = np.argsort(-alike, axis=1)[:, : min(NEAR, len(vectors) - 1)]
    own = (vectors @ centres.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    return int(np.ceil(np.quantile(np.take_along_axis(place, own[near], axis=1), RECALL))) + 1 if near.size else 1


def cells_of(vectors: np.ndarray, centres: np.ndarray, rows: int = 1024) -> np.ndarray:
    """The nearest centre of each vector."""
    return np.concatenate([(vectors[i : i + rows] @ centres.T).argmax(axis=1) for i in range(0, len(vectors), rows)])


def dealt(counts: list[int], rows: int) -> list[tuple[int, int]]:
    """For parts of so many vectors, in order: the block that each is in, of about so many rows, and over how many blocks from there on it is spread, if it is larger."""
    block, filled, found = 0, 0, []
    for n in counts:
        if filled and filled + n > rows:
            block, filled = block + 1, 0
        pieces = max(1, -(-n // rows))
        found.append((block, pieces))
        block, filled = (block, filled + n) if pieces == 1 else (block + pieces, 0)
    return found


def asked_of(batch: pa.RecordBatch, centres: np.ndarray, many: int, first: np.ndarray, blocks: np.ndarray, rows: int) -> Iterator[pa.RecordBatch]:
    """block, qid, cells and vector: a row for each query (qid, vector) of the batch and each block that has some of the `many` cells nearest to it, in batches
    of so many rows at most. The blocks of cell i are blocks[first[i] : first[i + 1]]."""
    vectors, number = matrix(batch.column("vector")), np.diff(first)
    slice_ = max(1, PROBES // (many * max(1, number.max(initial=1))))
    for a in range(0, len(vectors), slice_):
        near = np.argpartition(-(vectors[a : a + slice_] @ centres.T), many - 1, axis=1)[:, :many]
        times = number[near.ravel()]
        query, cell = np.repeat(np.repeat(np.arange(len(near)), many), times), np.repeat(near.ravel(), times)
        block = blocks[first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)]
        by = np.lexsort((cell, block, query))
        query, cell, block = query[by], cell[by], block[by]
        starts = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (block[1:] != block[:-1]))[: len(query)])
        ends = np.append(starts, len(query))
        for i in range(0, len(starts), rows):
            at, to = starts[i : i + rows], ends[i : i + rows + 1]
            cells = pa.ListArray.from_arrays(pa.array(to - to[0], pa.int32()), pa.array(cell[to[0] : to[-1]], pa.int32()))
            take = pa.array(a + query[at])
            yield pa.RecordBatch.from_arrays([pa.array(block[at], pa.int32()), batch.column("qid").take(take), cells, batch.column("vector").take(take)], ["block", "qid", "cells", "vector"])


def by_cell(queries: pa.Table, vectors: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each cell of the vectors (cell): the places of the queries (cells) that probe it, and of its vectors."""
    lists = queries.column("cells").combine_chunks()
    cell, query = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    own = vectors.column("cell").to_numpy()
    by, at = np.argsort(cell, kind="stable"), np.argsort(own, kind="stable")
    for x in np.unique(own):
        yield (query[by[slice(*np.searchsorted(cell, (x, x + 1), sorter=by))]], at[slice(*np.searchsorted(own, (x, x + 1), sorter=at))])


class VectorIndex:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.log = spark, base, Log(spark, base)

    def build(self, vectors: DataFrame) -> int:
        """Fits centres and indexes vectors (doc_id, vector of norm 1); others of another size are left out."""
        head = self.log.head()
        n = vectors.count()
        share = min(1.0, 2 * SAMPLE / max(n, 1))
        rows = vectors.select("vector").sample(fraction=share, seed=7).limit(SAMPLE).toArrow() if n else None
        if not n or not rows.num_rows:
            raise ValueError("there are no vectors to fit centres on")
        sizes = rows.column("vector").combine_chunks().value_lengths().to_numpy()
        size = int(np.bincount(sizes).argmax())
        held = matrix(rows.column("vector").combine_chunks().filter(pa.array(sizes == size)))
        centres = fit_centres(held, min(CENTRES, max(1, math.isqrt(n)), len(held)))
        content = {"centres": f"centres/{uuid.uuid4().hex}", "size": size, "probes": probes_for(held, centres), "segments": [], "deletions": []}
        frame = self.spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centres)], "cell int, centre array<double>")
        journal = self.log.begin(head.number if head else None, [content["centres"]], content)
        frame.coalesce(1).write.parquet(f"{self.base}/{content['centres']}")
        self.log.finish(journal, head.number if head else None, content)
        return self.add(vectors)

    def centres(self) -> np.ndarray:
        rows = self.spark.read.schema("cell int, centre array<double>").parquet(f"{self.base}/{self.log.head().content['centres']}").orderBy("cell").toArrow()
        return matrix(rows.column("centre").combine_chunks())

    def add(self, vectors: DataFrame) -> int:
        """A segment of more vectors, with ids that no segment has."""
        head = self.log.head()
        centres = self.spark.sparkContext.broadcast(self.centres())

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = cells_of(matrix(batch.column("vector")), centres.value)
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column("doc_id"), batch.column("vector")], ["cell", "doc_id", "vector"])

        found = vectors.filter(F.size("vector") == head.content["size"]).select(c("doc_id").cast("long"), "vector").mapInArrow(nearest, "cell int, doc_id long, vector array<double>")
        folder = f"segments/{uuid.uuid4().hex}"
        parts = found.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        dealt = found.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("doc_id"), c("parts")).cast("int"))  # a row a centre
        journal = self.log.begin(head.number, [folder], {"folder": folder})
        dealt.select("cell", "part", "doc_id", "vector").repartition("cell", "part").sortWithinPartitions("cell", "part").write.parquet(f"{self.base}/{folder}")
        return self.log.finish(journal, head.number, head.content | {"segments": [*head.content["segments"], folder]})

    def delete(self, ids: DataFrame) -> int:
        """Deletes vectors by doc_id, of the segments there are now."""
        head = self.log.head()
        folder = f"deletions/{uuid.uuid4().hex}"
        journal = self.log.begin(head.number, [folder], {"folder": folder})
        named = F.explode(F.array(*map(F.lit, head.content["segments"])).cast("array<string>")).alias("segment")
        ids.select(c("doc_id").cast("long")).distinct().select("doc_id", named).write.parquet(f"{self.base}/{folder}")
        return self.log.finish(journal, head.number, head.content | {"deletions": [*head.content["deletions"], folder]})

    def vectors(self) -> DataFrame:
        """cell, segment, part, doc_id and vector of what is not deleted."""
        now = self.log.head().content
        rows = reduce(DataFrame.unionByName, (self.spark.read.schema(VECTORS).parquet(f"{self.base}/{s}").withColumn("segment", F.lit(s)) for s in now["segments"]))
        for d in now["deletions"]:
            rows = rows.join(small(self.spark.read.schema("doc_id long, segment string").parquet(f"{self.base}/{d}")), ["doc_id", "segment"], "left_anti")
        return rows

    def search(self, queries: DataFrame, k: int, digits: int = 9, probes: int | None = None) -> DataFrame:
        """qid, doc_id, similarity (0 to 1), rank of the k best in the cells that queries (qid, vector of norm 1) probe."""
        now, centres = self.log.head().content, self.centres()
        size, many = now["size"], min(len(centres), probes or now["probes"])
        asked, rows, names = queries.filter(F.size("vector") == size).select(c("qid").cast("long"), "vector"), self.vectors(), ["cell", "segment", "part"]
        parts = rows.groupBy(*names).count().orderBy(*names).toArrow()  # a row a part: some for each centre and segment
        counts = parts.column("count").to_pylist()
        of = dealt(counts, vector_rows(sum(counts), size, self.spark.sparkContext.defaultParallelism))
        where = self.spark.createDataFrame([(*x.values(), *y) for x, y in zip(parts.select(names).to_pylist(), of, strict=True)], "cell int, segment string, part int, block int, pieces int")
        pairs = np.array(sorted({(cell, b) for cell, (block, pieces) in zip(parts.column("cell").to_pylist(), of, strict=True) for b in range(block, block + pieces)}), np.int64).reshape(-1, 2)
        held = self.spark.sparkContext.broadcast((centres, many, np.searchsorted(pairs[:, 0], np.arange(len(centres) + 1)), pairs[:, 1], block_rows(size)))

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from asked_of(batch, *held.value)

        def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            return best_of(left, right, k, digits, by_cell)

        mine = max(1, -(-asked.count() // block_rows(size)))
        met = asked.mapInArrow(probed, "block int, qid long, cells array<int>, vector array<double>").withColumn("mine", F.pmod(F.xxhash64("qid", "vector"), F.lit(mine)).cast("int"))
        spread = (c("block") + F.pmod(F.hash("doc_id"), c("pieces"))).cast("int")  # parts are dealt by another hash
        there = rows.join(F.broadcast(where), names).select("cell", "doc_id", "vector", spread.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(mine - 1))).alias("mine"))
        keys = ["mine", "block"]
        found = met.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(score, "qid long, doc_id long, similarity double")
        return ranked(found, "similarity", k)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """qid and recall: of a query's k exact neighbours, the share that was found."""
    both = exact.filter(c("rank") < k).select("qid", "doc_id").join(found.filter(c("rank") < k).select("qid", "doc_id", F.lit(1).alias("hit")), ["qid", "doc_id"], "left")
    return both.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
