"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Encoding: long texts are cut where no match of the split pattern can reach across, so that no single call grows with
the text. Such a place lies between any character and white space after it, since every alternative of the pattern takes
white space only at its front or alone; and between a letter or digit and punctuation after it, which no alternative spans.
A run of letters alone is one match, of any length. A long run of white space is one match (but for its last character, which
goes with what follows); it is encoded as such, since the library's own regular expression overflows its stack there.

Nulls and empty texts: no ids, no bytes. Repeated rows: encoded each. Extra columns stay; the new columns replace any
of the same name. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

#: Texts of up to so many characters are encoded in one call.
LONG = 100_000
_CUT = regex.compile(r"\P{White_Space}(?=\p{White_Space})|[\p{L}\p{N}](?=\p{P})")
_BLANK = regex.compile(r"\p{White_Space}{256,}")


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str):
    """The encoding by matches of the pattern, and that of a whole string as one match."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    own = lambda name, pat: tiktoken.Encoding(name, pat_str=pat, mergeable_ranks=ranks, special_tokens={})
    return own("matches", pattern), own("whole", r"[\s\S]+")


def pieces(text: str, long: int = LONG) -> Iterator[tuple[str, bool]]:
    """Parts of the text that are encoded alone, and of each whether it is one match as a whole."""
    if len(text) <= long and not _BLANK.search(text):
        yield text, False
        return
    begin = 0
    for blank in _BLANK.finditer(text):
        yield from _cuts(text[begin : blank.start()], long)
        begin = blank.end() if blank.end() == len(text) else blank.end() - 1
        yield text[blank.start() : begin], True
    yield from _cuts(text[begin:], long)


def _cuts(text: str, long: int) -> Iterator[tuple[str, bool]]:
    begin = 0
    while begin < len(text):
        cut = _CUT.search(text, begin + long)
        end = cut.end() if cut else len(text)
        yield text[begin:end], False
        begin = end


def encode(text: str, ranks_path: str, pattern: str, long: int = LONG) -> list[int]:
    by_match, whole = codec(ranks_path, pattern)
    ids: list[int] = []
    for part, one in pieces(text, long):
        ids += (whole if one else by_match).encode_ordinary(part)
    return ids


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of ids, array<int>."""
    docs = docs.drop(ids) if ids in docs.columns else docs
    schema = StructType(list(docs.schema.fields)).add(ids, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                found = [encode(x or "", ranks_path, pattern) for x in part.column(text).to_pylist()]
                yield part.append_column(ids, pa.array(found, pa.list_(pa.int32())))

    return docs.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with a column of the raw bytes that the ids stand for; they need not be valid UTF-8."""
    encoded = encoded.drop(to) if to in encoded.columns else encoded
    schema = StructType(list(encoded.schema.fields)).add(to, BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(ranks_path, pattern)[0].decode_bytes
        for batch in batches:
            found = [decode(x or []) for x in batch.column(ids).to_pylist()]
            yield batch.append_column(to, pa.array(found, pa.binary()))

    return encoded.mapInArrow(run, schema)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_match, _ = codec(ranks_path, pattern)
        names = [str(i) for i in range(by_match.n_vocab)]
        for batch in batches:
            count, joined, back = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(text or "", ranks_path, pattern)
                count.append(len(ids))
                joined.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(by_match.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(joined, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
