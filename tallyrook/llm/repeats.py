"""Which hashes of a table stand in more than one of its parts, without a row for each hash.

Rows are dealt into parts by a hash of their id and text. A part sends the hashes it has, each once, sorted and packed, to
buckets by their leading bits; a bucket sees all parts' hashes of its range, and answers each part in the order of its
question: a bit for each hash, and values where an operator needs them. So the exchange holds a few bytes for each
different hash of a part, whatever the number of copies of a text, and a hash that a third of all rows have comes to its
bucket once from each part. A part is a pure function of the row: a task that is computed again asks the same question.
A row that is repeated so often that its copies would fill a part is dealt by a number that is written beside it first.

Parts have PART_BYTES of text at any size of the table, so the memory of a task does not grow with it; their number does,
and that of buckets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrook.llm.shared import quoted, written

#: Bytes of text in a part, about. A bucket has the hashes of FEWER times as many.
PART_BYTES, FEWER = 2 << 20, 4
QUESTION = "part int, bucket int, n int, hashes binary, flags binary, more binary"
ANSWER = "part int, bucket int, kind int, bits binary, extra binary"


@dataclass(frozen=True)
class Layout:
    parts: int
    bits: int


def layout(docs: DataFrame) -> tuple[Layout, DataFrame]:
    """How many parts and buckets; and docs with the column part, together."""
    row = F.xxhash64(*(F.col(quoted(c)) for c in docs.columns))
    of_row = docs.groupBy(row.alias("hash")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"))
    repeated = F.when(F.col("n") > 1, F.col("bytes") + 64 * F.col("n"))
    total, most = of_row.agg(F.sum("bytes"), F.max(repeated)).first()
    parts = max(1, int(-(-(total or 0) // PART_BYTES)))
    salt = F.lit(0).cast("long")
    if parts > 1 and (most or 0) > PART_BYTES:
        hot = [r["hash"] for r in of_row.filter(repeated > PART_BYTES).select("hash").collect()]  # at most as many as parts
        docs = written(docs.withColumn("salt", F.when(row.isin(hot), F.monotonically_increasing_id()).otherwise(salt)))
        salt = docs["salt"]
    dealt = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text", salt), F.lit(parts)).cast("int"))
    return Layout(parts, max(1, (max(1, parts // FEWER) - 1).bit_length())), dealt.drop("salt").repartition(parts, "part")


def packed(values: np.ndarray) -> bytes:
    """Sorted or small unsigned numbers as differences, byte by byte, so that the exchange's compression finds the zeros."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(len(values), gaps.itemsize).T).tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    bytes_ = np.frombuffer(data, np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(bytes_.T).view(kind).ravel(), dtype=kind)


def edges(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins among sorted hashes, and their number."""
    return np.append(np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(hashes))


def question(part: int, hashes: np.ndarray, flags: np.ndarray | None, bits: int, more: np.ndarray | None = None) -> pa.Table:
    """A row for each bucket, of the 32 bits after the bucket's; of all 64, where there is a second hash (more). flags: a bit or a number each."""
    whole = more is not None
    cuts = edges(hashes, bits)
    some = np.flatnonzero(np.diff(cuts)).tolist()
    own = hashes if whole else ((hashes >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    rows = [(own[cuts[b] : cuts[b + 1]], None if flags is None else flags[cuts[b] : cuts[b + 1]]) for b in some]
    bare = lambda f: b"" if f is None else np.packbits(f).tobytes() if f.dtype == bool else packed(f)
    columns = [pa.array([part] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([len(h) for h, _ in rows], pa.int32()), pa.array([packed(h) for h, _ in rows], pa.binary()), pa.array([bare(f) for _, f in rows], pa.binary())]
    columns.append(pa.array([more[cuts[b] : cuts[b + 1]].tobytes() if whole else b"" for b in some], pa.binary()))
    return pa.Table.from_arrays(columns, ["part", "bucket", "n", "hashes", "flags", "more"])


def bits_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def shared_by_parts(kind: int, flagged: bool, counted: bool = False) -> Callable[[pa.Table], pa.Table]:
    """Answers of a bucket: which hashes another part has too; flagged: only those that some part has flagged; counted: with
    how many parts have each (8 times its binary logarithm)."""

    def answer(asked: pa.Table) -> pa.Table:
        parts, buckets, ns = (asked.column(c).to_pylist() for c in ("part", "bucket", "n"))
        hashes = [unpacked(x, np.uint32) for x in asked.column("hashes").to_pylist()]
        every = np.sort(np.concatenate(hashes))
        shared, again = np.unique(every[1:][every[1:] == every[:-1]], return_counts=True)
        level = np.round(8 * np.log2(again + 1)).astype(np.uint8)
        if flagged:
            marked = [h[bits_of(f, n)] for h, f, n in zip(hashes, asked.column("flags").to_pylist(), ns, strict=True)]
            shared = np.intersect1d(shared, np.concatenate(marked))
        found = [among(h, shared) for h in hashes]
        extra = [level[np.searchsorted(shared, h[f])].tobytes() if counted else b"" for h, f in zip(hashes, found, strict=True)]
        return replied(parts, buckets, kind, [np.packbits(f).tobytes() for f in found], extra)

    return answer


def among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def replied(parts: list, buckets: list, kind: int, bits: list[bytes], extra: list[bytes]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(parts, pa.int32()), pa.array(buckets, pa.int32()), pa.array([kind] * len(parts), pa.int32()), pa.array(bits, pa.binary()), pa.array(extra, pa.binary())], ["part", "bucket", "kind", "bits", "extra"])


def heard(answers: pa.Table, kind: int, hashes: np.ndarray, bits: int, wide: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The bit of each of the sorted hashes, and the extra numbers (wide: of 64 bits, packed, else of 8) of those whose bit is set."""
    cuts = edges(hashes, bits)
    found, extra = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64 if wide else np.uint8)
    for own, bucket, data, more in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "bits", "extra")), strict=True):
        if own == kind:
            a, b = cuts[bucket], cuts[bucket + 1]
            found[a:b] = bits_of(data, b - a)
            if more:
                extra[a:b][found[a:b]] = unpacked(more, np.uint64).view(np.int64) if wide else np.frombuffer(more, np.uint8)
    return found, extra


@dataclass
class Runs:
    """Occurrences grouped by hash: sorted different hashes, and what each occurrence is."""

    hashes: np.ndarray
    order: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, more: np.ndarray | None = None) -> Runs:
        """more: a second hash of each, so that only what is equal in both is one."""
        order = np.argsort(hashes, kind="stable") if more is None else np.lexsort((more, hashes))
        ordered = hashes[order]
        change = ordered[1:] != ordered[:-1]
        if more is not None:
            change |= np.diff(more[order]) != 0
        begin = np.flatnonzero(np.append(True, change)) if len(ordered) else np.zeros(0, np.int64)
        return cls(ordered[begin], order, begin)

    def first(self, values: np.ndarray) -> np.ndarray:
        """The value of each hash's first occurrence."""
        return values[self.order[self.begin]]

    def each(self, f: np.ufunc, values: np.ndarray) -> np.ndarray:
        """f over the values of each hash's occurrences."""
        return f.reduceat(values[self.order], self.begin) if len(self.begin) else values[:0]

    def spread(self, values: np.ndarray) -> np.ndarray:
        """The value of its hash for each occurrence."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = np.repeat(values, np.diff(np.append(self.begin, len(self.order))))
        return out
