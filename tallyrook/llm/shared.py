"""The check of a size before a broadcast, and input columns carried past working ones; tables in the shared folder are the core's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrook.operators.store import cut, written

__all__ = ["bundled", "cut", "quoted", "small", "unbundled", "with_new", "written"]

#: A side of a join is broadcast up to so many rows of ids or counts; beyond, Spark shuffles.
BROADCAST_ROWS = 1_000_000


def small(frame: DataFrame, rows: int | None = None) -> DataFrame:
    """The frame with a broadcast hint if it has at most BROADCAST_ROWS rows (counted, unless given)."""
    return F.broadcast(frame) if (frame.count() if rows is None else rows) <= BROADCAST_ROWS else frame


def quoted(name: str) -> str:
    """The name of a column as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def bundled(docs: DataFrame) -> DataFrame:
    """doc_id, text, and row, a struct of all columns but text: no working column can clash with those of docs."""
    row = F.struct(*(F.col(quoted(c)) for c in docs.columns if c != "text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("row"))


def unbundled(frame: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns as bundled() took them, but for new ones."""
    return frame.select(*((new[c] if c in new else F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in columns))


def with_new(frame: DataFrame, columns: list[str], names: tuple[str, ...]) -> DataFrame:
    """The columns as bundled() took them, and those of the frame by the names given, which replace any of the same name."""
    rest = [c for c in columns if c not in names]
    return unbundled(frame, [*rest, *names], **{c: F.col(c) for c in names})
