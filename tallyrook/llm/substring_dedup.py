"""Substring deduplication by fixed-block anchors.

A window of 13 words that stands in two documents contains, in either, a whole block of 7 words that begins at a
multiple of 7. So each document's non-overlapping blocks are indexed, and every rolling window of 7 words of every
document probes the index: what hits is an anchor. Anchors are extended on both sides, by up to six words in all: each
extension of 13 words is compared with those of all documents, and learns the smallest doc_id that it starts in. Extensions
that start in a document with a smaller id join to maximal exact repeats, whose words are removed.

Both comparisons go through tallyrook.llm.repeats: a few bytes for each different hash of a part of the table. The texts are
exchanged once, by part, and that exchange is read by all steps. Anchors are found by 39 bits or more of a hash, which only adds
some; extensions are compared by two independent hashes of 64 bits each over the hashes of their words (see words.py).

Null texts have no words. A null doc_id is larger than any other. Rows with equal doc_id do not remove from each other.
An empty table gives an empty table; extra columns of any name stay, and in remove_repeats() the new ones replace any of the
same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from tallyrook.llm import repeats as r
from tallyrook.llm import words as w
from tallyrook.llm.shared import bundled, unbundled, with_new

WINDOW = 13
#: The longest block of which every window of WINDOW words holds a whole one, wherever it begins.
BLOCK = (WINDOW + 1) // 2
_LAST = np.iinfo(np.int64).max
_OTHER_STEP = np.uint64(0xA0761D6478BD642F)
NEW = ("n_words", "removed", "kept")


class _Part:
    """The texts of one part."""

    def __init__(self, docs: pa.Table, bits: int):
        self.bits = bits
        self.words = w.split(docs.column("text"), w.SPACE, lower=False)
        self.ids = docs.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows = self.words.rows()
        h, inside = w.windows(self.words, BLOCK)
        self.at = np.flatnonzero(inside)
        self.probes = r.Runs.of(h[self.at])
        row = self.rows[self.at]
        aligned = (self.at - self.words.first[row]) % BLOCK == 0
        self.indexed = self.probes.each(np.logical_or, aligned)
        self.several = self.probes.each(np.minimum, row) != self.probes.each(np.maximum, row)

    def blocks(self, part: int) -> pa.Table:
        return r.question(part, self.probes.hashes, self.indexed, self.bits)

    def extend(self, answers: pa.Table) -> None:
        """Finds the windows around anchors."""
        elsewhere, _ = r.heard(answers, 0, self.probes.hashes, self.bits)
        anchor = np.zeros(len(self.words.hash) + 1, np.int64)
        anchor[self.at + 1] = self.probes.spread(elsewhere | (self.several & self.indexed))
        anchors = np.cumsum(anchor)
        del self.at, self.probes, self.indexed, self.several, anchor
        h, inside = w.windows(self.words, WINDOW)
        span = WINDOW - BLOCK + 1
        self.windows = np.flatnonzero(inside & (anchors[span : span + len(h)] > anchors[: len(h)]))
        other = w.rolled(self.words.other, WINDOW, _OTHER_STEP)[self.windows]
        self.found = r.Runs.of(h[self.windows], other)
        self.other = self.found.first(other)
        self.own = self.found.each(np.minimum, self.ids[self.rows[self.windows]])

    def starts(self, part: int) -> pa.Table:
        return r.question(part, self.found.hashes, self.own.view(np.uint64), self.bits, self.other)

    def removed(self, answers: pa.Table) -> np.ndarray:
        """Which words are covered by a window that starts in a document with a smaller id."""
        smaller, ids = r.heard(answers, 1, self.found.hashes, self.bits)
        first = self.found.spread(np.where(smaller, ids, self.own))
        hit = self.windows[first < self.ids[self.rows[self.windows]]]
        change = np.zeros(len(self.words.hash) + WINDOW + 1, np.int64)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + WINDOW, -1)
        return np.cumsum(change)[: len(self.words.hash)] > 0


def _smallest(asked: pa.Table) -> pa.Table:
    """Of each extension, whether another part has it in a document with a smaller id, and that id."""
    parts, buckets, ns = (asked.column(c).to_pylist() for c in ("part", "bucket", "n"))
    hashes = np.concatenate([r.unpacked(x, np.uint64) for x in asked.column("hashes").to_pylist()])
    others = np.concatenate([np.frombuffer(x, np.uint64) for x in asked.column("more").to_pylist()])
    own = np.concatenate([r.unpacked(x, np.uint64).view(np.int64) for x in asked.column("flags").to_pylist()])
    runs = r.Runs.of(hashes, others)
    first = runs.spread(runs.each(np.minimum, own))
    smaller, ends = first < own, np.cumsum(ns)[:-1]
    bits = [np.packbits(x).tobytes() for x in np.split(smaller, ends)]
    extra = [r.packed(x[s].view(np.uint64)) for x, s in zip(np.split(first, ends), np.split(smaller, ends), strict=True)]
    return r.replied(parts, buckets, 1, bits, extra)


def _spans(covered: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]))).tolist()


def _repeats(docs: DataFrame) -> DataFrame:
    """Of bundled documents: doc_id, text, row and NEW."""
    plan, dealt = r.layout(docs)
    bits, names = plan.bits, docs.columns
    schema = StructType(list(docs.schema.fields)).add("n_words", LongType()).add("removed", ArrayType(LongType())).add("kept", StringType())

    def ask_blocks(key: tuple, part: pa.Table) -> pa.Table:
        return _Part(part, bits).blocks(key[0].as_py())

    def ask_starts(key: tuple, part: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Part(part, bits)
        own.extend(answers)
        return own.starts(key[0].as_py())

    def cut_out(key: tuple, part: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Part(part, bits)
        own.extend(answers)
        gone, first = own.removed(answers), own.words.first
        removed, kept = [], []
        for i, text in enumerate(part.column("text").to_pylist()):
            covered = gone[first[i] : first[i + 1]]
            words = (text or "").encode("utf-8", "surrogatepass").split()
            removed.append(_spans(covered) if covered.any() else [])
            kept.append(b" ".join([x for x, out in zip(words, covered.tolist(), strict=True) if not out] if removed[-1] else words).decode("utf-8", "surrogatepass"))
        out = part.select(names)
        for name, values, kind in (("n_words", np.diff(first), pa.int64()), ("removed", removed, pa.list_(pa.int64())), ("kept", kept, pa.string())):
            out = out.append_column(name, pa.array(values, kind))
        return out.cast(pa.schema([(f.name, f.type) for f in out.schema]))

    def asked(question: DataFrame, answer) -> DataFrame:
        return question.groupBy("bucket").applyInArrow(answer, r.ANSWER)

    anchors = asked(dealt.groupBy("part").applyInArrow(ask_blocks, r.QUESTION), r.shared_by_parts(0, flagged=True))
    starts = asked(dealt.groupBy("part").cogroup(anchors.groupBy("part")).applyInArrow(ask_starts, r.QUESTION), _smallest)
    answers = anchors.unionByName(starts)
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(cut_out, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with n_words, removed (begin and end words of what goes, flat) and kept (the other words, one blank between)."""
    return with_new(_repeats(bundled(docs)), docs.columns, NEW)


def repeat_digests(docs: DataFrame) -> DataFrame:
    found = remove_repeats(docs.select("doc_id", "text"))
    pairs = F.aggregate("removed", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda s, x: F.struct((s["n"] + x * s["sign"]).alias("n"), (-s["sign"]).alias("sign")), lambda s: s["n"])
    return found.select("doc_id", "n_words", pairs.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeats cut out of text (n_chars follows, if there is one); texts without repeats stay as they are."""
    found = _repeats(bundled(docs))
    changed = F.size("removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return unbundled(found, docs.columns, **new)


#: A window's words are joined by one blank: no word contains one.
REPEATS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), win AS (
  SELECT r, doc_id, s, array_to_string(ws[s : s + 12], ' ') AS w
  FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM d WHERE len(ws) >= 13)
), firsts AS (SELECT w, min(doc_id) AS least FROM win GROUP BY w
), gone AS (
  SELECT DISTINCT r, unnest(range(s, s + 13)) AS p FROM win JOIN firsts USING (w) WHERE doc_id > least
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS kept
  FROM (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r
), n AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
