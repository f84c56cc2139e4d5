"""A table's vectors made anew, in phases that a restart takes up where they stopped, and switched to in one step.

A table of sources/versions names its vectors in its log: an entry holds the version of the rows and, once a switch has succeeded, the
generation of their vectors and the folder. Writes of rows carry this on. A switch keeps a log of its own, an entry a phase and
batch; phases are queued, validating, reindexing, verifying, committing, and then succeeded, failed or cancelled.

A batch is some of the files of the version (which never change), up to `batch_bytes`: no row is exchanged or copied to form it. It is written
to a folder of its own, so a batch that was killed is written again and no other. Rows written meanwhile abort the switch: every step looks at
the table's last entry, the rows' digest is taken before and after, and the switch itself is a claim of the next entry, which only
one writer gets. What a failed or cancelled switch has written goes. Errors of Spark or of the model leave the phase as it is: run() again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyrook.operators import channels
from tallyrook.sources.versions import Conflict, Entry, Log, read

c = F.col
#: From rows of the table to (key, vector).
Embed = Callable[[DataFrame], DataFrame]
TERMINAL = ("succeeded", "failed", "cancelled")
#: Rows whose own vector must find them again, and known pairs, at most.
PROBES, MOST_PAIRS, WITHIN = 16, 1000, 10
SAME = 1e-6


class Refused(Exception):
    """A check that ends a switch; its code: SOURCE_CHANGED, SAME_GENERATION, NO_ROWS, TARGET_INCOMPLETE, TARGET_VECTOR_INVALID or PROBE_FAILED."""


def digest(rows: DataFrame) -> list[int]:
    """Number of rows and two sums of their hashes: equal for the same rows in any order."""
    hashes = (F.xxhash64(*map(c, rows.columns)), F.xxhash64(F.lit(1), *map(c, rows.columns)))
    said = rows.agg(F.count("*"), *(F.sum(x.cast("decimal(20,0)")) for x in hashes)).first()
    return [int(x or 0) for x in said]


def active(spark: SparkSession, table: str) -> dict | None:
    """generation, folder and version of the rows whose vectors the table names; None before its first generation."""
    head = Log(spark, table).head()
    return head.content.get("vectors") if head else None


def vectors(spark: SparkSession, table: str) -> DataFrame:
    """The vectors of the active generation, with the columns that the model gave."""
    now = active(spark, table)
    if now is None:
        raise ValueError("the table has no generation of vectors")
    return spark.read.option("recursiveFileLookup", True).schema(StructType.fromJson(now["schema"])).parquet(f"{table}/{now['folder']}")


def roll_back(spark: SparkSession, table: str) -> None:
    """The generation before becomes the active one, if it was kept and is of the rows that are current."""
    log = Log(spark, table)
    head = log.head()
    before = (head.content.get("vectors") or {}).get("previous") if head else None
    if before is None or not log.files.exists(f"{table}/{before['folder']}"):
        raise ValueError("no earlier generation was kept")
    if before["version"] != head.content["version"]:
        raise ValueError("rows were written after the earlier generation")
    log.claim(head.number, {**head.content, "vectors": before})


class Switch:
    """One switch, by its name; opening a name that is there goes on with it."""

    def __init__(self, spark: SparkSession, table: str, name: str, embed: Embed):
        self.spark, self.table, self.embed = spark, table, embed
        self.rows_log, self.log = Log(spark, table), Log(spark, f"{table}/switches/{name}")

    def begin(self, generation: str, schema: StructType, key: str, dimensions: int, keep_previous: bool = True, batch_bytes: int = 64 << 30) -> Switch:
        """Queues the switch, from what the table is now. An open switch of the table refuses another."""
        head = self.rows_log.head()
        if head is None:
            raise ValueError("the table has no version")
        for other in self.rows_log.files.names(f"{self.table}/switches"):
            last = Log(self.spark, f"{self.table}/switches/{other}").head()
            if last is not None and last.content["phase"] not in TERMINAL:
                raise Conflict(f"switch {other} is open")
        said = {"generation": generation, "entry": head.number, "source": head.content, "schema": schema.jsonValue(), "key": key, "dimensions": dimensions}
        self.log.claim(None, {"phase": "queued", "keep_previous": keep_previous, "batch_bytes": batch_bytes, **said})
        return self

    # --- state -------------------------------------------------------------------------------------------------------
    def now(self) -> Entry:
        head = self.log.head()
        if head is None:
            raise ValueError("the switch was not begun")
        return head

    def history(self) -> list[dict]:
        return [e.content for name in self.log.entries() if (e := self.log._entry(name)) is not None]

    def cancel(self) -> None:
        """Asks for the end of a switch; a step at work ends it when it is done. One that was committed stays."""
        at = self.now()
        if at.content["phase"] not in TERMINAL:
            self.log.claim(at.number, {**at.content, "phase": "cancel_requested"})

    def run(self, known: DataFrame | None = None) -> str:
        """Steps to the end; `known`: see step()."""
        while (phase := self.step(known)) not in TERMINAL:
            pass
        return phase

    def step(self, known: DataFrame | None = None) -> str:
        """Does what the phase says and returns the next one. known: pairs (qid, vector, key) of queries that must find a row among
        the first ten; at most MOST_PAIRS."""
        at = self.now()
        said = at.content
        if said["phase"] in TERMINAL:
            return said["phase"]
        try:
            if self._committed(said):  # killed between the claim and its entry here
                return self._end(at)
            if said["phase"] == "cancel_requested":
                return self._stop(at, "cancelled")
            self._unchanged(said)
            more = getattr(self, f"_{said['phase']}")(said, known)
        except Refused as e:
            return self._stop(at, "failed", str(e))
        if more["phase"] == "succeeded":
            return self._end(at)
        try:
            self.log.claim(at.number, {**said, **more})
        except Conflict:
            if self.now().content["phase"] != "cancel_requested":
                raise
        return self.now().content["phase"]

    def _folder(self, said: dict) -> str:
        return f"vectors/{self.log.base.rsplit('/', 1)[1]}-{said['generation']}"

    def _committed(self, said: dict) -> bool:
        later = [n for n in self.rows_log.entries() if int(n.removesuffix(".json")) > said["entry"]]
        return any(((e := self.rows_log._entry(n)) and e.content.get("vectors") or {}).get("folder") == self._folder(said) for n in later)

    def _stop(self, at: Entry, phase: str, code: str | None = None) -> str:
        self.rows_log.files.drop(f"{self.table}/{self._folder(at.content)}")
        self.log.claim(at.number, {**at.content, "phase": phase, "code": code})
        return phase

    def _end(self, at: Entry) -> str:
        before = at.content["source"].get("vectors")
        if before and not at.content["keep_previous"]:
            self.rows_log.files.drop(f"{self.table}/{before['folder']}")
        self.log.claim(self.now().number, {**at.content, "phase": "succeeded", "code": None})
        return "succeeded"

    # --- checks ------------------------------------------------------------------------------------------------------
    def _unchanged(self, said: dict) -> None:
        if self.rows_log.head().number != said["entry"]:
            raise Refused("SOURCE_CHANGED")

    def _rows(self, said: dict, files: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(said["schema"])
        return self.spark.read.schema(schema).parquet(*files) if files else read(self.spark, self.table, schema, said["source"]["version"])

    def _batches(self, said: dict) -> list[list[str]]:
        """The files of the version, in the order of their names, in runs of up to batch_bytes."""
        out, room = [], 0
        for line in self.rows_log.files.signature(f"{self.table}/{said['source']['folder']}"):
            path, size, _ = line.rsplit(" ", 2)
            if path.rsplit("/", 1)[1].startswith(("_", ".")):
                continue
            if not out or room < int(size):
                out.append([])
                room = said["batch_bytes"]
            out[-1].append(path)
            room -= int(size)
        return out

    def _files(self, batches: list[list[str]]) -> str:
        return hashlib.sha256(json.dumps(batches).encode()).hexdigest()

    def _target(self, said: dict) -> DataFrame:
        schema = StructType.fromJson(said["vectors_schema"])
        return self.spark.read.option("recursiveFileLookup", True).schema(schema).parquet(f"{self.table}/{self._folder(said)}")

    # --- phases ------------------------------------------------------------------------------------------------------
    def _queued(self, said: dict, known: DataFrame | None) -> dict:
        return {"phase": "validating"}

    def _validating(self, said: dict, known: DataFrame | None) -> dict:
        if (said["source"].get("vectors") or {}).get("generation") == said["generation"]:
            raise Refused("SAME_GENERATION")
        rows, batches = self._rows(said), self._batches(said)
        if not (was := digest(rows))[0]:
            raise Refused("NO_ROWS")
        self.rows_log.files.drop(f"{self.table}/{self._folder(said)}")
        made = self.embed(rows).schema.jsonValue()
        return {"phase": "reindexing", "digest": was, "files": self._files(batches), "batches": len(batches), "batch": 0, "vectors_schema": made}

    def _reindexing(self, said: dict, known: DataFrame | None) -> dict:
        batches, n = self._batches(said), said["batch"]
        if self._files(batches) != said["files"]:
            raise Refused("SOURCE_CHANGED")
        self.embed(self._rows(said, batches[n])).write.mode("overwrite").parquet(f"{self.table}/{self._folder(said)}/{n:08d}")
        return {"phase": "reindexing" if n + 1 < len(batches) else "verifying", "batch": n + 1}

    def _verifying(self, said: dict, known: DataFrame | None) -> dict:
        key, target = said["key"], self._target(said)
        if digest(self._rows(said).select(key)) != digest(target.select(key)):
            raise Refused("TARGET_INCOMPLETE")
        if not target.filter(~channels.sound(c("vector"), said["dimensions"])).isEmpty():
            raise Refused("TARGET_VECTOR_INVALID")
        own = target.orderBy(key).limit(PROBES).select(c(key).alias("qid"), "vector")
        hits = channels.cosine_top(own, target.select(c(key).alias("doc_id"), "vector"), 1)
        if hits.filter(c("similarity") >= 1 - SAME).count() < min(PROBES, said["digest"][0]):
            raise Refused("PROBE_FAILED")
        if known is not None:
            pairs = known.select("qid", "vector", c(key).alias("doc_id")).limit(MOST_PAIRS)
            first = channels.cosine_top(pairs.select("qid", "vector"), target.select(c(key).alias("doc_id"), "vector"), WITHIN)
            if not pairs.select("qid", "doc_id").join(first, ["qid", "doc_id"], "left_anti").isEmpty():
                raise Refused("PROBE_FAILED")
        return {"phase": "committing"}

    def _committing(self, said: dict, known: DataFrame | None) -> dict:
        if digest(self._rows(said)) != said["digest"]:
            raise Refused("SOURCE_CHANGED")
        before = said["source"].get("vectors")
        kept = {k: v for k, v in before.items() if k != "previous"} if before and said["keep_previous"] else None
        named = {"generation": said["generation"], "folder": self._folder(said), "version": said["source"]["version"], "schema": said["vectors_schema"], "previous": kept}
        try:
            self.rows_log.claim(said["entry"], {**said["source"], "vectors": named})
        except Conflict:
            raise Refused("SOURCE_CHANGED") from None
        return {"phase": "succeeded"}
