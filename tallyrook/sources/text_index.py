"""A full-text index: segments of postings by range of documents, added, deleted from and merged, with BM25 on top.

A segment is a folder of rows (range, token, docs, tfs, sizes, max_tf, min_size): the postings of a token in a range of about RANGE
documents, dealt by a hash of their ids, so that the best of a range can be cut where it is scored. max_tf and min_size bound what the token can give
to any document there. What makes up the index is told by a log (sources/versions.py): segments and deletions, with their totals. Adding
documents writes one segment and one entry and touches no other file; deleting some writes their ids and what they take from the tokens'
counts; a merge writes one segment of what is left, in which each range is one or a few of the old ones, as they lie: lists of documents are
exchanged, never a row for each document and word.

A range is built by one call over its own documents, and a task of ranges has PART documents at any size of the table.

A search reads the postings of its words only. Ranges are dealt to tasks as a whole; a task goes through its ranges, those with the largest bounds
first, skips a query where the bounds say that no document can come among its k best so far, and hands on k rows a query at most. So what
is exchanged is postings of asked words, and k rows a query and task, never a row for each query and document that share a word.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.operators.channels import K1, B, query_words, ranked
from tallyrook.operators.store import small
from tallyrook.sources.versions import Log

c = F.col
#: Documents of a range, and of the ranges that a task goes through, about.
RANGE, TASK = 512, 16_384
#: Documents of a task that builds or merges ranges, about; ids of documents that are broadcast, at most.
PART, IDS = 4096, 1_000_000
POSTINGS = "range int, token string, docs array<long>, tfs array<int>, sizes array<int>, max_tf int, min_size int"


def words(text: Column) -> Column:
    """Lower-cased runs of at least two letters or digits, as often as they stand."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 2)


class TextIndex:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.log = spark, base, Log(spark, base)

    def _now(self) -> tuple[int | None, dict]:
        head = self.log.head()
        return (head.number, head.content) if head else (None, {"segments": [], "deletions": []})

    def _commit(self, number: int | None, folder: str, content: dict, rows: DataFrame) -> int:
        journal = self.log.begin(number, [folder], content)
        rows.write.parquet(f"{self.base}/{folder}")
        return self.log.finish(journal, number, content)

    # --- writes ------------------------------------------------------------------------------------------------------
    def add(self, docs: DataFrame) -> int:
        """A segment of docs (doc_id, text): ids that no segment has. Null texts are empty."""
        number, now = self._now()
        split = docs.select(c("doc_id").cast("long"), words(F.coalesce(c("text"), F.lit(""))).alias("words"))
        folder, content = f"segments/{uuid.uuid4().hex}", dict(now)
        journal = self.log.begin(number, [folder], {"folder": folder})
        try:
            n = docs.count()
            ranges = _ranges(n)
            dealt = split.withColumn("range", _range(ranges)).repartition(_parts(self.spark, ranges), "range")
            dealt.groupBy("range").applyInArrow(_built, POSTINGS).write.parquet(f"{self.base}/{folder}")
            length = self._segment(folder).agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0]
        except BaseException:
            self.log.abandon(journal)
            raise
        content["segments"] = [*now["segments"], {"folder": folder, "docs": n, "length": length or 0, "ranges": ranges}]
        return self.log.finish(journal, number, content)

    def delete(self, ids: DataFrame) -> int:
        """Deletes documents (doc_id) that are there."""
        number, now = self._now()
        live = self._exploded(now).join(small(ids.select(c("doc_id").cast("long")).distinct(), IDS), "doc_id", "left_semi")
        folder = f"deletions/{uuid.uuid4().hex}"
        journal = self.log.begin(number, [folder], {"folder": folder})
        try:
            live.select("token", "doc_id", "size", "folder", "range").write.parquet(f"{self.base}/{folder}")
        except BaseException:
            self.log.abandon(journal)
            raise
        n, length = self._deleted(folder).select("folder", "doc_id", "size").distinct().agg(F.count("*"), F.sum("size")).first()
        content = now | {"deletions": [*now["deletions"], {"folder": folder, "docs": n, "length": length or 0}]}
        return self.log.finish(journal, number, content)

    def merge(self) -> int:
        """One segment of all that is left."""
        number, now = self._now()
        docs, length = self._totals(now)
        ranges = _ranges(docs)
        at, parts = _merged_range(now["segments"], ranges), _parts(self.spark, ranges)
        rows = self._postings(now).withColumn("range", at).repartition(parts, "range")
        gone = self._deletions(now)
        if gone is None:
            merged = rows.groupBy("range").applyInArrow(_merged, POSTINGS)
        else:
            dead = gone.select("folder", at.alias("range"), "doc_id").distinct().repartition(parts, "range")
            merged = rows.groupBy("range").cogroup(dead.groupBy("range")).applyInArrow(_merged_without, POSTINGS)
        folder = f"segments/{uuid.uuid4().hex}"
        return self._commit(number, folder, {"segments": [{"folder": folder, "docs": docs, "length": length, "ranges": ranges}], "deletions": []}, merged)

    # --- reads -------------------------------------------------------------------------------------------------------
    def _totals(self, now: dict) -> tuple[int, int]:
        docs, length = (sum(s[key] for s in now["segments"]) - sum(d[key] for d in now["deletions"]) for key in ("docs", "length"))
        return docs, length

    def _segment(self, folder: str) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.base}/{folder}")

    def _deleted(self, folder: str) -> DataFrame:
        return self.spark.read.schema("token string, doc_id long, size int, folder string, range int").parquet(f"{self.base}/{folder}")

    def _postings(self, now: dict) -> DataFrame:
        rows = [self._segment(s["folder"]).withColumn("folder", F.lit(s["folder"])) for s in now["segments"]]
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], f"{POSTINGS}, folder string")

    def _deletions(self, now: dict) -> DataFrame | None:
        rows = [self._deleted(d["folder"]) for d in now["deletions"]]
        return reduce(DataFrame.unionByName, rows) if rows else None

    def _exploded(self, now: dict, postings: DataFrame | None = None) -> DataFrame:
        """doc_id, token, tf, size, folder, range of what is not deleted, of all postings or of some."""
        each = F.inline(F.arrays_zip("docs", "tfs", "sizes")).alias("doc_id", "tf", "size")
        rows = (self._postings(now) if postings is None else postings).select("token", "folder", "range", each).select("doc_id", "token", "tf", "size", "folder", "range")
        gone = self._deletions(now)
        return rows if gone is None else rows.join(small(gone.select("doc_id", "folder").distinct(), IDS), ["doc_id", "folder"], "left_anti")

    def words_of(self, queries: DataFrame, docs: DataFrame | None = None) -> DataFrame:
        """doc_id, token, tf and size of the words that queries (qid, text) have, in all documents or in docs (doc_id)."""
        number, now = self._now()
        met = self._postings(now).join(small(query_words(queries).select("token").distinct()), "token", "left_semi")
        rows = self._exploded(now, met)
        rows = rows if docs is None else rows.join(small(docs.select("doc_id").distinct(), IDS), "doc_id", "left_semi")
        return rows.select("doc_id", "token", "tf", "size")

    def search(self, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
        """qid, doc_id, score, rank of queries (qid, text), by BM25 over what is not deleted. Scores are rounded, so that ranks do not
        hang on the order of sums. The queries are a stated set: their words and weights are sent to all tasks, in blocks of BLOCK queries."""
        number, now = self._now()
        docs, length = self._totals(now)
        asked = query_words(queries).select("qid", "token")
        met = self._postings(now).join(small(asked.select("token").distinct()), "token", "left_semi")
        df = met.groupBy("token").agg(F.sum(F.size("docs")).alias("df"))
        gone = self._deletions(now)
        if gone is not None:
            less = gone.groupBy("token").agg(F.count("*").alias("less"))
            df = df.join(less, "token", "left").select("token", (c("df") - F.coalesce("less", F.lit(0))).alias("df"))
        weight = F.log(1 + (docs - c("df") + 0.5) / (c("df") + 0.5))
        terms = asked.join(df, "token").filter("df > 0").select("qid", "token", weight.alias("weight"))
        tasks = max(min(self.spark.sparkContext.defaultParallelism, -(-docs // RANGE)), docs // TASK, 1)
        task = F.pmod(F.xxhash64("folder", "range"), F.lit(tasks)).cast("int").alias("task")
        keyed = met.select(task, "folder", "range", "token", "docs", "tfs", "sizes", "max_tf", "min_size").repartition(tasks, "task").groupBy("task")
        dead = None if gone is None else gone.select(task, "folder", "doc_id").distinct().groupBy("task")
        out = []
        for block in _blocks(terms):
            alone, without = _scorers(self.spark.sparkContext.broadcast(block), length / docs if docs and length else 1.0, k, digits)
            schema = "qid long, doc_id long, score double"
            out.append(keyed.applyInArrow(alone, schema) if dead is None else keyed.cogroup(dead).applyInArrow(without, schema))
        found = reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], "qid long, doc_id long, score double")
        return ranked(found, "score", k)


#: Queries whose words are sent to all tasks at once.
BLOCK = 20_000


def _blocks(terms: DataFrame) -> Iterator[tuple[list[int], list[tuple[list[str], list[float]]]]]:
    """Queries with their words and weights, BLOCK at a time."""
    rows = terms.groupBy("qid").agg(F.collect_list(F.struct("token", "weight")).alias("terms"))
    qids, held = [], []
    for r in rows.toLocalIterator():
        qids.append(r["qid"])
        held.append(([t["token"] for t in r["terms"]], [t["weight"] for t in r["terms"]]))
        if len(qids) == BLOCK:
            yield qids, held
            qids, held = [], []
    if qids:
        yield qids, held


def _ranges(docs: int) -> int:
    return max(1, -(-docs // RANGE))


def _range(ranges: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int")


def _parts(spark: SparkSession, ranges: int) -> int:
    """Tasks that ranges are dealt to: a range each while there are few, PART documents each at last."""
    return max(1, min(ranges, max(4 * spark.sparkContext.defaultParallelism, ranges * RANGE // PART)))


def _merged_range(segments: list[dict], ranges: int) -> Column:
    """Where a range of a segment's folder goes: the ranges of all segments follow each other, and as many documents of them are one."""
    total, before, at = max(sum(s["docs"] for s in segments), 1), 0, F.lit(0)
    for s in segments:
        place = before + c("range") * (s["docs"] / s.get("ranges", _ranges(s["docs"])))
        at = F.when(c("folder") == s["folder"], F.least(F.floor(place * (ranges / total)), F.lit(ranges - 1))).otherwise(at)
        before += s["docs"]
    return at.cast("int")


def _lists(at: int, tokens: pa.Array, token: np.ndarray, docs: np.ndarray, tfs: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """POSTINGS of a range, by token, from entries: a place in tokens, a document, how often, and the document's size."""
    place = np.empty(len(tokens), np.int64)
    place[pc.sort_indices(tokens).to_numpy()] = np.arange(len(tokens))
    order = np.lexsort((docs, place[token]))
    token, docs, tfs, sizes = token[order], docs[order], tfs[order], sizes[order]
    begin = np.flatnonzero(np.diff(token, prepend=-1))
    ends = pa.array(np.append(begin, len(token)), pa.int32())
    most, least = (f.reduceat(x, begin) if len(begin) else x for f, x in ((np.maximum, tfs), (np.minimum, sizes)))
    columns = [pa.array(np.full(len(begin), at), pa.int32()), tokens.take(pa.array(token[begin])), *(pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((docs, pa.int64()), (tfs, pa.int32()), (sizes, pa.int32()))), pa.array(most, pa.int32()), pa.array(least, pa.int32())]
    return pa.Table.from_arrays(columns, ["range", "token", "docs", "tfs", "sizes", "max_tf", "min_size"])


def _built(docs: pa.Table) -> pa.Table:
    """POSTINGS of a range's documents (doc_id, words, range)."""
    lists = docs.column("words").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    (ids, size), row = np.unique(np.stack([docs.column("doc_id").to_numpy(), sizes]), axis=1, return_inverse=True)  # a row that is repeated is one
    key, count = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(row.ravel(), sizes), return_counts=True)
    token, at = np.divmod(key, max(len(ids), 1))
    return _lists(docs.column("range")[0].as_py(), coded.dictionary, token, ids[at], count, size[at])


def _merged(rows: pa.Table) -> pa.Table:
    return _merged_without(rows, None)


def _merged_without(rows: pa.Table, gone: pa.Table | None) -> pa.Table:
    """POSTINGS of rows of one new range, with their folders, without what is gone (folder, doc_id)."""
    if not rows.num_rows:
        return pa.schema([("range", pa.int32()), ("token", pa.string()), *((x, pa.list_(kind)) for x, kind in (("docs", pa.int64()), ("tfs", pa.int32()), ("sizes", pa.int32()))), ("max_tf", pa.int32()), ("min_size", pa.int32())]).empty_table()
    lists = rows.column("docs").combine_chunks()
    many = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    docs, tfs, sizes = (rows.column(x).combine_chunks().flatten().to_numpy() for x in ("docs", "tfs", "sizes"))
    coded, folders = (pc.dictionary_encode(rows.column(x).combine_chunks()) for x in ("token", "folder"))
    token, folder = (np.repeat(x.indices.to_numpy(), many) for x in (coded, folders))
    alive = np.ones(len(docs), bool)
    if gone is not None and gone.num_rows:
        of = np.array(gone.column("folder").to_pylist(), object)
        for i, name in enumerate(folders.dictionary.to_pylist()):
            own = np.flatnonzero(folder == i)
            alive[own] = ~np.isin(docs[own], gone.column("doc_id").to_numpy()[of == name])
    return _lists(rows.column("range")[0].as_py(), coded.dictionary, token[alive], docs[alive], tfs[alive], sizes[alive])


def _part(tf: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def _scorers(held, mean: float, k: int, digits: int) -> tuple[Callable, Callable]:
    """The best of a task's postings; and of these without what was deleted (folder, doc_id)."""

    def score(task: pa.Table, gone: pa.Table | None) -> pa.Table:
        qids, terms = held.value
        known = {t: i for i, t in enumerate(sorted({t for ts, _ in terms for t in ts}))}
        asked = [(np.array([known[t] for t in ts], np.int64), np.array(ws)) for ts, ws in terms]
        token = np.array([known.get(t, -1) for t in task.column("token").to_pylist()], np.int64)
        place = {x: i for i, x in enumerate(sorted({*zip(task.column("folder").to_pylist(), task.column("range").to_pylist(), strict=True)}))}
        own = np.array([place[x] for x in zip(task.column("folder").to_pylist(), task.column("range").to_pylist(), strict=True)], np.int64)
        lists = task.column("docs").combine_chunks()
        ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
        docs = lists.flatten().to_numpy()
        tf, size = (task.column(x).combine_chunks().flatten().to_numpy().astype(float) for x in ("tfs", "sizes"))
        gives = _part(tf, size, mean)
        most = np.zeros((len(place), len(known)))  # of a range and a token, what a document gets at most
        rows = np.flatnonzero(token >= 0)
        most[own[rows], token[rows]] = _part(task.column("max_tf").to_numpy()[rows].astype(float), task.column("min_size").to_numpy()[rows].astype(float), mean)
        folders, dead = {i: f for (f, _), i in place.items()}, {}
        if gone is not None:
            of_folder = np.array(gone.column("folder").to_pylist(), object)
            dead = {f: gone.column("doc_id").to_numpy()[of_folder == f] for f in {*folders.values()}}
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in qids]
        least = np.full(len(qids), -1.0)
        bounds = np.stack([most[:, t] @ ws for t, ws in asked], axis=1) if asked else np.zeros((len(place), 0))
        for at in np.argsort(-bounds.max(axis=1, initial=0)).tolist():
            here = np.flatnonzero((own == at) & (token >= 0))
            ids, where = np.unique(np.concatenate([docs[ends[i] : ends[i + 1]] for i in here]), return_inverse=True) if len(here) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            begin = np.append(0, np.cumsum(ends[here + 1] - ends[here]))
            given = np.concatenate([gives[ends[i] : ends[i + 1]] for i in here]) if len(here) else np.zeros(0)
            of = {int(token[i]): slice(begin[j], begin[j + 1]) for j, i in enumerate(here.tolist())}
            alive = ~np.isin(ids, dead[folders[at]]) if dead else np.ones(len(ids), bool)
            for q, (ts, ws) in enumerate(asked):
                if bounds[at, q] <= 0 or bounds[at, q] + 10.0**-digits < least[q]:
                    continue
                mine = [(of[t], x) for t, x in zip(ts.tolist(), ws.tolist(), strict=True) if t in of]
                total = np.bincount(np.concatenate([where[s] for s, _ in mine]), np.concatenate([given[s] * x for s, x in mine]), len(ids)) if mine else np.zeros(len(ids))
                total = np.floor(total * 10**digits + 0.5) / 10**digits
                hit = np.flatnonzero((total > 0) & (total >= least[q]) & alive)
                score, of_doc = np.append(best[q][0], total[hit]), np.append(best[q][1], ids[hit])
                if len(score) > k:
                    cut = np.partition(score, len(score) - k)[len(score) - k]
                    some = np.flatnonzero(score >= cut)
                    some = some[np.lexsort((of_doc[some], -score[some]))[:k]]
                    score, of_doc, least[q] = score[some], of_doc[some], cut
                best[q] = score, of_doc
        many = [len(s) for s, _ in best]
        return pa.Table.from_arrays([pa.array(np.repeat(np.array(qids, np.int64), many)), pa.array(np.concatenate([d for _, d in best] or [np.zeros(0, np.int64)])), pa.array(np.concatenate([s for s, _ in best] or [np.zeros(0)]))], ["qid", "doc_id", "score"])

    return lambda task: score(task, None), lambda task, gone: score(task, gone)
