"""Ranked lexical search of short queries over all documents, with equal bags scored once.

Only what the queries' vocabulary sees of a document counts for its score: how often it has each of their terms, and its
length, through m. Documents of one vector of counts and one m are a class. Classes are found by a hash of both and told apart by
both themselves; each is scored once, against all items, and its documents come back at the end by ascending doc_id.

1. One pass over the texts counts each document's terms and keeps its vector: the terms of the vocabulary, numbered, with their counts,
   packed. Vectors are written; all statistics (documents, terms, documents of each term) are summed from them, over all documents.
2. Vectors group into classes, combined before they are exchanged, each with its least doc_id.
3. A task scores the classes that it has, an item against many at once, and keeps of each item those that can be among its DEPTH best: by
   score, then by least doc_id. A document that is among them belongs to one of the DEPTH first classes, since each
   class before its own has a document before it. Only these are exchanged, and the best of all tasks taken.
4. The classes that stay are at most DEPTH an item. They meet the vectors again, and of each class the DEPTH least documents are ranked.

Items are taken in blocks of at most VOCABULARY terms, which are sent to all tasks; each block is one round of the above.

A null text has no terms and is in no result; a null doc_id comes after all others, and rows repeated are documents of their own.
Items without terms, or without a document that has one, have no rows. A very long text is one document: its task holds about
fifty bytes a byte of it. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrook.llm import words as w
from tallyrook.llm.shared import written

#: Documents of an item; terms of a block of items; classes scored at once.
DEPTH, VOCABULARY, CLASSES = 20, 20_000, 512
#: Of the score: m is LEAST + (VARYING * n * N) div L.
LEAST, VARYING, SCALE = 75, 25, 1_000_000_000
VECTORS = "doc_id long, n long, bag binary"
TOP = "item int, score long, least long, hash long, bag binary, m long"
_NO_ID = np.iinfo(np.int64).max


def item_terms(items: DataFrame, most: int = VOCABULARY) -> Iterator[tuple[list, list[bytes], list[dict[int, int]]]]:
    """Blocks of items: their ids, their vocabulary, and of each item the terms by number in it, with repeats."""
    ids, vocabulary, bags = [], {}, []
    for row in items.select("item_id", "text").toLocalIterator():
        found = w.split(pa.array([row["text"]], pa.string()), w.ALNUM, lower=True)
        terms = Counter(found.lower(i) for i in range(len(found.hash)))
        if terms:
            if ids and len(vocabulary) + len(terms) > most:
                yield ids, list(vocabulary), bags
                ids, vocabulary, bags = [], {}, []
            ids.append(row["item_id"])
            bags.append({vocabulary.setdefault(t, len(vocabulary)): n for t, n in terms.items()})
    if ids:
        yield ids, list(vocabulary), bags


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """VECTORS of docs that have a term; bag: pairs (term, count) of the vocabulary, by term, as 32-bit numbers."""
    numbers = w.split(pa.array([b" ".join(vocabulary).decode()], pa.string()), w.ALNUM, lower=True)
    order = np.argsort(numbers.hash)
    keys, others = numbers.hash[order], numbers.other[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches):
            found = w.split(batch.column("text"), w.ALNUM, lower=True)
            at = np.minimum(np.searchsorted(keys, found.hash), len(keys) - 1)
            hit = np.flatnonzero((keys[at] == found.hash) & (others[at] == found.other))
            cell, tf = np.unique(found.rows()[hit] * len(keys) + order[at[hit]], return_counts=True)
            row = cell // len(keys)
            pairs = np.stack([cell % len(keys), tf], axis=1).astype(np.uint32)
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows)))
            bags = [pairs[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            n = np.diff(found.first)
            there = pa.array(n > 0)
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(bags, pa.binary())]
            yield pa.RecordBatch.from_arrays([x.filter(there) for x in columns], ["doc_id", "n", "bag"])

    return written(docs.select("doc_id", "text").mapInArrow(count, VECTORS))


def pairs_of(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of each pair of some bags."""
    lengths = np.array([len(x) for x in bags.to_pylist()], np.int64) // 8
    pairs = np.frombuffer(b"".join(bags.to_pylist()), np.uint32).reshape(-1, 2)
    return np.repeat(np.arange(len(lengths)), lengths), pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)


def statistics(held: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, all their terms, and the documents that have each term of the vocabulary, of VECTORS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            df += np.bincount(pairs_of(batch.column("bag"))[1], minlength=terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    found = np.zeros(terms, np.int64)
    for row in held.select("bag").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        found[row["term"]] = row["df"]
    documents, length = held.agg(F.count("*"), F.sum("n")).first()
    return documents, length or 0, found


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


class Best:
    """Of each item, the best classes so far, by score and then least doc_id."""

    def __init__(self, items: int):
        self.heaps = [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, keep) -> None:
        """scores: by item and class; keep(j): what to remember of class j."""
        for i, j in np.argwhere((scores >= np.maximum(self.least, 1)[:, None])).tolist():
            heap, entry = self.heaps[i], (int(scores[i, j]), -int(ids[j]))
            if len(heap) < DEPTH:
                heapq.heappush(heap, (*entry, keep(j)))
            elif entry > heap[0][:2]:
                heapq.heapreplace(heap, (*entry, keep(j)))
            if len(heap) == DEPTH:
                self.least[i] = heap[0][0]

    def rows(self) -> list[tuple]:
        return [(i, score, -least, *kept) for i, heap in enumerate(self.heaps) for score, least, kept in heap]


def best_classes(classes: DataFrame, weight: np.ndarray, bags: list[dict[int, int]]) -> DataFrame:
    """TOP of each task, from classes (hash, bag, m, least)."""
    asked = [(np.array(list(b), np.int64), np.array(list(b.values()), np.int64)) for b in bags]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(asked))
        for batch in w.slices(batches, CLASSES):
            hashes, m = (batch.column(c).to_numpy() for c in ("hash", "m"))
            ids = batch.column("least").fill_null(_NO_ID).to_numpy()
            row, term, tf = pairs_of(batch.column("bag"))
            part = np.zeros((len(weight), batch.num_rows), np.int64)
            part[term, row] = weight[term] * ((SCALE * tf) // (1000 * tf + 12 * m[row]))
            scores = np.stack([(part[t] * n[:, None]).sum(axis=0) for t, n in asked])
            bag = batch.column("bag")
            best.add(scores, ids, lambda j: (int(hashes[j]), bag[j].as_py(), int(m[j])))  # noqa: B023
        rows = best.rows()
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["item", "score", "least", "hash", "bag", "m"])

    return classes.select("hash", "bag", "m", "least").mapInArrow(score, TOP)


def _first(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first DEPTH rows of each group, with their rank; Spark cuts each task's groups before it exchanges them."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= DEPTH)


def _ranked(docs: DataFrame, ids: list, vocabulary: list[bytes], bags: list[dict[int, int]]) -> DataFrame | None:
    held = vectors(docs, vocabulary)
    documents, length, df = statistics(held, len(vocabulary))
    if not documents:
        return None
    m = (LEAST + F.expr(f"div({VARYING} * n * {documents}, {length})")).alias("m")
    scored = held.filter(F.length("bag") > 0).select("doc_id", "bag", m).select("doc_id", F.xxhash64("bag", "m").alias("hash"), "bag", "m")
    classes = scored.groupBy("hash", "bag", "m").agg(F.min("doc_id").alias("least"))
    told = best_classes(classes, weights(documents, df), bags)
    top = written(_first(told, ["item"], [F.desc("score"), F.asc("least"), F.asc("hash")]).drop("rank", "least"))
    chosen = F.broadcast(top.select("hash", "bag", "m").distinct())  # at most DEPTH an item
    members = _first(scored.join(chosen, ["hash", "bag", "m"], "left_semi"), ["hash", "bag", "m"], [F.asc_nulls_last("doc_id")]).drop("rank")
    found = _first(top.join(members, ["hash", "bag", "m"]), ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")])
    names = docs.sparkSession.createDataFrame(list(enumerate(ids)), "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score of the DEPTH best documents of each item."""
    found = [x for block in item_terms(items) if (x := _ranked(docs, *block)) is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


RANKED_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), d AS (SELECT r, doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM words WHERE len(ws) > 0
), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d
), tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) GROUP BY r, t
), asked AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t
), weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t, docs
), part AS (
  SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS part
  FROM tf JOIN d USING (r) JOIN weight USING (t), total WHERE t IN (SELECT t FROM asked)
), scored AS (
  SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score
  FROM asked JOIN part USING (t) JOIN d USING (r) GROUP BY item_id, r, doc_id HAVING sum(times * part) > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 20
"""
