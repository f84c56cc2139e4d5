"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item's windows are its runs of ten consecutive words (one window if it has fewer). A window is a set of
shingles of three consecutive words; a text holds the window only if it holds all of them. So one prefix token is
necessary and enough to find it: shingles are ordered by how rare they are in all documents, and the rarest of each
window is its prefix. A place where a document has such a shingle is a candidate for every window with that prefix; it
survives the length bound (the document is as long as the window), the positional bound (the window, laid so that the
shingles meet, lies within the document), the comparison of the words' hashes, and that of the words themselves.

The benchmark is taken in blocks of windows, each with a bounded index that is broadcast; beyond one block the
documents are passed through the blocks in turn, twice each. So the result does not depend on the bound, and nothing is
shuffled but counts of benchmark shingles. Equal windows are one, with the list of its items: however many share it, a place in
a text is compared with it once, and the lists of what a text has are united once for all texts that have the same. A window of very many
items is dealt to blocks with parts of its list. A passage that a third of all documents share costs no more than its places.
A very long text is held by its task as a whole, with some forty bytes a word.

Null texts have no words and, as items, no windows; items without words have none; repeated items and documents are
matched each; an empty benchmark hits nothing; an empty table of documents gives an empty table; extra columns of any name
stay, and in find_overlaps() the new ones replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from tallyrook.llm import words as w
from tallyrook.llm.shared import bundled, cut, unbundled, with_new

WINDOW, SHINGLE = 10, 3
#: Windows of a block: its index holds about 250 bytes for each, and for each ITEMS items of them; items in the list of a window, about.
BLOCK, ITEMS, LISTED = 200_000, 4, 100_000
NEW = ("n_words", "spans", "items")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item, words (hashes, in order), shingles (hashes, in order) and wording (the words, one blank between) of each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = w.split(batch.column("text"), w.ALNUM, lower=True)
            items, runs, sets, wordings = [], [], [], []
            for i, item in enumerate(batch.column("item").to_pylist()):
                own = found.hash[found.first[i] : found.first[i + 1]]
                spelled = [found.lower(k) for k in range(found.first[i], found.first[i + 1])]
                size = min(WINDOW, len(own))
                shingles = w.rolled(own, min(SHINGLE, size)).view(np.int64) if size else own
                for s in range(len(own) - size + 1 if size else 0):
                    items.append(item)
                    runs.append(own[s : s + size].view(np.int64))
                    sets.append(shingles[s : s + size - min(SHINGLE, size) + 1])
                    wordings.append(b" ".join(spelled[s : s + size]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(runs, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64())), pa.array(wordings, pa.binary())], ["item", "words", "shingles", "wording"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string")).mapInArrow(run, "item string, words array<long>, shingles array<long>, wording binary")


def _distinct(windows: DataFrame) -> tuple[DataFrame, int]:
    """Different windows with their items (a part of them, where they are very many), and how large they are, as windows without."""
    pairs = windows.count()
    part = F.pmod(F.xxhash64("item"), F.lit(max(1, pairs // LISTED)))
    found = cut(windows.groupBy("words", "shingles", "wording", part.alias("part")).agg(F.collect_set("item").alias("items")))
    return found, found.count() + pairs // ITEMS


def _places(found: w.Words, sizes: tuple[int, ...], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the column has wanted shingles (first word of each), and which of the sorted wanted ones."""
    at, which = [], []
    for size in sizes:
        h, inside = w.windows(found, size)
        i = np.searchsorted(wanted, h)
        i[i == len(wanted)] = 0
        hit = np.flatnonzero(inside & (wanted[i] == h))
        at.append(hit)
        which.append(i[hit])
    return np.concatenate(at), np.concatenate(which)


def _rarity(docs: DataFrame, wanted: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """How often each wanted shingle stands in all documents. The counts are as many as the block's shingles."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), np.int64)
        for batch in w.slices(batches):
            _, which = _places(w.split(batch.column("text"), w.ALNUM, lower=True), sizes, held.value)
            total += np.bincount(which, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["which", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "which long, n long").groupBy("which").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(wanted), np.int64)
    out[counts["which"].to_numpy()] = counts["n"].to_numpy()
    return out


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each list begins (and the last ends)."""
    lists = column.combine_chunks()
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.append(0, ends)


class _Index:
    """Windows of a block by their prefix: for the i-th of the sorted prefixes, those from first[i] to first[i + 1]."""

    def __init__(self, windows: pa.Table, counts: np.ndarray, wanted: np.ndarray):
        shingles, at = _lists(windows["shingles"])
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        often = counts[np.searchsorted(wanted, shingles)] if len(shingles) else np.zeros(0, np.int64)
        best = np.lexsort((shingles, often, row))  # the rarest of each window comes first
        best = best[at[:-1]] if len(at) > 1 else best[:0]
        # Where no document has a shingle of a window, the window is nowhere.
        nowhere = np.zeros(len(at) - 1, bool)
        nowhere[row[often == 0]] = True
        kept = np.flatnonzero(~nowhere)
        kept = kept[np.argsort(shingles[best[kept]], kind="stable")]
        best = best[kept]
        prefix = shingles[best]
        self.prefix, first = np.unique(prefix, return_index=True)
        self.first = np.append(first, len(prefix)).astype(np.int64)
        self.offset = best - at[kept]
        words, begin = _lists(windows["words"])
        self.size = np.diff(begin)[kept]
        self.words = np.zeros((len(kept), WINDOW), np.uint64)
        for j in range(WINDOW):
            has = self.size > j
            self.words[has, j] = words[begin[kept[has]] + j]
        known: dict[str, str] = {}
        items, wordings = windows["items"].to_pylist(), windows["wording"].to_pylist()
        self.items, self.wording = [[known.setdefault(x, x) for x in items[i]] for i in kept.tolist()], [wordings[i] for i in kept.tolist()]

    def find(self, found: w.Words, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of every occurrence in the column."""
        at, which = _places(found, sizes, self.prefix) if len(self.prefix) else (np.zeros(0, np.int64),) * 2
        many = self.first[which + 1] - self.first[which]
        entry = np.repeat(self.first[which] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        begin = np.repeat(at, many) - self.offset[entry]
        row = np.searchsorted(found.first, np.repeat(at, many), "right") - 1
        keep = (begin >= found.first[row]) & (begin + self.size[entry] <= found.first[row + 1])
        begin, entry = begin[keep], entry[keep]
        for j in range(WINDOW):
            place = np.minimum(begin + j, max(len(found.hash) - 1, 0))
            keep = (j >= self.size[entry]) | (found.hash[place] == self.words[entry, j])
            begin, entry = begin[keep], entry[keep]
        same = [b" ".join([found.lower(k) for k in range(b, b + n)]) == self.wording[e] for b, e, n in zip(begin.tolist(), entry.tolist(), self.size[entry].tolist(), strict=True)]
        keep = np.array(same, bool)
        return begin[keep], entry[keep]


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint spans in order, flat: begin, end, begin, end ..."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _united(before: pa.Array, row: np.ndarray, entry: np.ndarray, items: list[list[str]]) -> pa.Array:
    """The items of each row: those before, and those of its entries; made once for all rows that have the same."""
    own: list[set] = [set() for _ in range(len(before))]
    for r, e in zip(row.tolist(), entry.tolist(), strict=True):
        own[r].add(e)
    places: dict[tuple, int] = {}
    which = [places.setdefault((frozenset(x), tuple(old)), len(places)) for x, old in zip(own, before.to_pylist(), strict=True)]
    united = [sorted({*old, *(i for e in entries for i in items[e])}) for entries, old in places]
    return pa.array(united, pa.list_(pa.string())).take(pa.array(which))


def _overlaps(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of bundled documents: doc_id, text, row and NEW."""
    windows, size = _distinct(benchmark_windows(benchmark))
    blocks = max(1, -(-size // block))
    if blocks > 1:
        windows = cut(windows.withColumn("block", F.pmod(F.xxhash64("words", "part"), F.lit(blocks))))
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<long>"), "items": F.array().cast("array<string>")})
    for b in range(blocks):
        held = (windows.filter(F.col("block") == b) if blocks > 1 else windows).toArrow()  # about `block` of them
        shingles, _ = _lists(held["shingles"])
        wanted = np.unique(shingles)
        sizes = tuple(sorted({min(SHINGLE, n) for n in np.unique(np.diff(_lists(held["words"])[1])).tolist()}))
        counts = _rarity(docs, wanted, sizes) if len(wanted) else np.zeros(0, np.int64)
        out = _pass(out, docs.sparkSession.sparkContext.broadcast(_Index(held, counts, wanted)), sizes)
    return out


def _pass(docs: DataFrame, index, sizes: tuple[int, ...]) -> DataFrame:
    names = docs.columns
    schema = StructType([f for f in docs.schema.fields if f.name not in NEW]).add("n_words", LongType()).add("spans", ArrayType(LongType())).add("items", ArrayType(StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches):
            found = w.split(batch.column("text"), w.ALNUM, lower=True)
            begin, entry = index.value.find(found, sizes)
            row = np.searchsorted(found.first, begin, "right") - 1
            columns = {c: batch.column(c) for c in names}
            columns["n_words"] = pa.array(np.diff(found.first), pa.int64())
            if len(begin):
                spans: list[list] = [[] for _ in range(batch.num_rows)]
                for r, a, n in zip(row.tolist(), (begin - found.first[row]).tolist(), index.value.size[entry].tolist(), strict=True):
                    spans[r].append((a, a + n))
                before = columns["spans"].to_pylist()
                spans = [_merge(own + list(zip(old[::2], old[1::2], strict=True))) for own, old in zip(spans, before, strict=True)]
                columns |= {"spans": pa.array(spans, pa.list_(pa.int64())), "items": _united(columns["items"], row, entry, index.value.items)}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return docs.mapInArrow(run, schema)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs with n_words, spans (begin and end words of hits, flat) and items (item_ids as strings, sorted)."""
    return with_new(_overlaps(bundled(docs), benchmark, block), docs.columns, NEW)


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_overlaps(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark)
    ends = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda s, x: F.struct((s["n"] + x * s["sign"]).alias("n"), (-s["sign"]).alias("sign")), lambda s: s["n"])
    return found.select("doc_id", "n_words", ends.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with the columns they came with."""
    return unbundled(_overlaps(bundled(docs), benchmark).filter(F.size("spans") == 0), docs.columns)


#: A window's words are joined by one blank: no word contains one.
CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[s : s + 9], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT r, s, n, array_to_string(ws[s : s + n - 1], ' ') AS w
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, lens WHERE len(ws) >= n)
), hit AS (SELECT r, s, n, item FROM dw JOIN bw USING (n, w)
), places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r
), its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN its USING (r)
"""
