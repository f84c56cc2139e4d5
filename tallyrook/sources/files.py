"""Files: records as shared Markdown, one file each; their discovery and inspection; snapshots and corpora as JSON lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.functions import ids
from tallyrook.schemas import KINDS

c = F.col
#: Bytes of a shared file and of an ingested one at most.
SHARED_BYTES, FILE_BYTES = 64 << 10, 32 << 20
#: Media types by suffix.
TYPES = {"md": "text/markdown", "markdown": "text/markdown", "html": "text/html", "htm": "text/html", "txt": "text/plain", "pdf": "application/pdf", "json": "application/json"}
_HEAD = r"^---\n((?:[a-z]+: [^\n]*\n)*)---\n"


def markdown(title: Column, kind: Column, tags: Column, body: Column) -> Column:
    """A record as a file: front matter and body."""
    line = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")
    return F.concat(F.lit("---\ntitle: "), line(title), F.lit("\nkind: "), line(kind), F.lit("\ntags: "), F.array_join(tags, ", "), F.lit("\n---\n"), body)


def promote(rows: DataFrame, folder: str) -> None:
    """Writes one file a row (name, file), in a folder named after it."""
    rows.select(c("name").alias("path"), F.concat(c("file"), F.lit("")).alias("value")).write.partitionBy("path").option("lineSep", "\0").text(folder)


def discovered(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, bytes and content of the files under a folder. Hidden ones, and what begins with an underscore, are passed over."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", c("length").alias("bytes"), "content")


def inspected(found: DataFrame, most: int = FILE_BYTES) -> DataFrame:
    """found with sha256, type (by suffix) and reject: too large, empty, or not UTF-8."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    types = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    code = F.when(c("bytes") > most, "too_large").when(c("bytes") == 0, "empty").when(~F.is_valid_utf8(c("content")), "not_utf8")
    return found.withColumns({"sha256": F.sha2("content", 256), "type": F.coalesce(types[suffix], F.lit("application/octet-stream")), "reject": code})


def parsed(files: DataFrame, text: str = "text") -> DataFrame:
    """files with title, kind, tags, body and verdict, of shared Markdown: strict front matter of known fields, each once."""
    head = F.regexp_extract(text, _HEAD, 1)
    field = lambda name: F.regexp_extract(head, rf"(?m)^{name}: (.*)$", 1)
    names = F.transform(F.filter(F.split(head, "\n"), lambda x: x != ""), lambda x: F.substring_index(x, ":", 1))
    unknown = F.size(F.array_except(names, F.array(*map(F.lit, ("title", "kind", "tags"))))) > 0
    verdict = (
        F.when(~c(text).rlike(_HEAD), "no_frontmatter").when(unknown, "unknown_field").when(F.size(names) != F.size(F.array_distinct(names)), "repeated_field")
        .when(F.trim(field("title")) == "", "title_missing").when(~field("kind").isin(*KINDS), "kind_unknown").otherwise("ok")
    )
    tags = F.filter(F.split(field("tags"), r",\s*"), lambda x: x != "")
    return files.withColumns({"title": field("title"), "kind": field("kind"), "tags": tags, "body": F.regexp_replace(text, _HEAD, ""), "verdict": verdict})


def shared_id(kind: Column, body: Column) -> Column:
    return ids.memory_id(kind, F.lit("repository"), F.lit(None).cast("string"), body)


def write_lines(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines."""
    rows.write.json(folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path and sha256 of a folder's files of JSON lines, to be kept beside them."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return discovered(spark, folder, "*.json").select(name.alias("name"), F.sha2("content", 256).alias("sha256"))


def read_lines(spark: SparkSession, folder: str, schema: str, pinned: DataFrame, key: str) -> DataFrame:
    """Rows of JSON lines, read with a schema; an error where files are not those of the manifest, or a key stands twice."""
    now = manifest(spark, folder)
    if now.exceptAll(pinned).unionByName(pinned.exceptAll(now)).limit(1).count():
        raise ValueError("the files are not those of the manifest")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(folder)
    if rows.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"a {key} stands twice")
    return rows


def plain_name(text: str) -> str:
    """A text as a file's name."""
    return re.sub(r"[^A-Za-z0-9._-]+", "-", text).strip("-")
