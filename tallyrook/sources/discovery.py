"""Discovery of documents in a tree of paths: ignore files of every level, hidden names, links and unsafe paths, in a stable order.

A tree is a table, however large: entries (path, kind, text), kind being file, dir or link, text what an ignore file says. Directories are
decided first, and are few; a file then asks its own directory only. Rules become one regular expression for each directory that has
some, so that paths are judged in the JVM.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyrook.operators import store

c = F.col
# Files with rules, the strongest last; suffixes of documents; documents of a tree at most.
RULES = (".git/info/exclude", ".gitignore", ".ignore")
SUFFIXES = ("pdf", "md", "markdown", "html", "htm")
MOST_FOUND = 1000
#: Names and rules are broadcast up to so many characters; beyond, Spark shuffles.
BROADCAST_CHARS = 8 << 20
#: Stands among the files with rules for the root of a nested repository.
_ROOT = "root"


def _class(glob: str, i: int) -> tuple[str | None, int]:
    """The class that begins after glob[i - 1] == '[' as a regular expression, and where it ends; None: it has no end, or a range runs down."""
    negated = glob[i : i + 1] in ("!", "^")
    i += negated
    items: list[str] = []
    first = True
    while i < len(glob) and (glob[i] != "]" or first):
        first = False
        i += glob[i] == "\\"
        low = glob[i : i + 1]
        if glob[i + 1 : i + 2] == "-" and glob[i + 2 : i + 3] not in ("", "]"):
            i += 3 if glob[i + 2] == "\\" else 2
            if glob[i : i + 1] < low:
                return None, i
            items.append(f"{_quoted(low)}-{_quoted(glob[i])}")
        else:
            items.append(_quoted(low))
        i += 1
    return (f"(?![/\\x00])[{'^' * negated}{''.join(items)}]" if i < len(glob) else None), i + 1


def _quoted(text: str) -> str:
    """Characters that a regular expression takes as they are, inside classes too."""
    return re.sub(r"([^\w/])", r"\\\1", text, flags=re.ASCII) if text.isascii() else "".join(_quoted(x) if x.isascii() else x for x in text)


def _glob(glob: str) -> str | None:
    """A glob over paths as a regular expression; None: it is malformed and matches nothing."""
    out, i = [], 0
    while i < len(glob):
        x, i = glob[i], i + 1
        if x == "*":
            start = i - 1
            while glob[i : i + 1] == "*":
                i += 1
            whole = i - start == 2 and (start == 0 or glob[start - 1] == "/")
            if whole and glob[i : i + 1] == "/":
                out.append("(?:.*/)?")
                i += 1
            elif whole and i == len(glob):
                out.append(".+")
            else:
                out.append(r"[^/\x00]*")
        elif x == "?":
            out.append(r"[^/\x00]")
        elif x == "[":
            part, i = _class(glob, i)
            if part is None:
                return None
            out.append(part)
        elif x == "\\":
            if i == len(glob):
                return None
            out.append(_quoted(glob[i]))
            i += 1
        else:
            out.append(_quoted(x))
    return "".join(out)


def rule(line: str) -> tuple[str, bool] | None:
    """A line of an ignore file: what it matches below its directory, where directories end in a NUL, and whether it takes back. None: no rule."""
    line = line.removesuffix("\r")
    bare = line.rstrip(" ")
    if bare != line and (len(bare) - len(bare.rstrip("\\"))) % 2:
        bare += " "
    if not bare or bare.startswith("#"):
        return None
    negated = bare.startswith("!")
    bare = bare[negated:]
    only_dirs = bare.endswith("/")
    bare = bare.removesuffix("/")
    anchored = "/" in bare
    bare = bare.removeprefix("/")
    found = _glob(bare) if bare else None
    if found is None:
        return None
    return f"{'' if anchored else '(?:.*/)?'}{found}\\x00{'' if only_dirs else '?'}", negated


def compiled(files: list[tuple[str, str, str]], at: str) -> str | None:
    """One expression for the files (directory, name, text) that count in directory `at`; None: they hold no rule.

    .ignore comes before .gitignore, and that before .git/info/exclude; within a kind the deeper directory, within a file the later line. The
    first alternative that matches decides: it takes in the path if a rule ignores it, and nothing if a rule takes it back. Rules of
    .gitignore and exclude above the root of a nested repository don't count.
    """
    roots = [len(where) for where, name, _ in files if name == _ROOT]
    floor = max(roots, default=0)
    parts = []
    for where, name, text in sorted((f for f in files if f[1] != _ROOT), key=lambda f: (RULES.index(f[1]), len(f[0])), reverse=True):
        if name != RULES[-1] and len(where) < floor:
            continue
        below = _quoted(f"{where}/") if where else ""
        for said in map(rule, reversed(text.removeprefix("\ufeff").split("\n"))):
            if said:
                parts.append(f"(?={below}{said[0]}\\z)" if said[1] else f"{below}{said[0]}\\z")
    return f"(?s)\\A(?:{'|'.join(parts)})" if parts else None


@F.pandas_udf(StringType())
def _compiled(at: pd.Series, files: pd.Series) -> pd.Series:
    return pd.Series([compiled([(f["of"], f["name"], f["text"]) for f in own], where) for where, own in zip(at, files, strict=True)], dtype=object)


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)


def _ancestors(path: Column) -> Column:
    """The directories above a path, and itself; the tree's own root is ''."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def _few(frame: DataFrame, chars: Column) -> DataFrame:
    """The frame, written, with a broadcast hint if it and its texts are small."""
    held = store.written(frame)
    n, size = held.agg(F.count("*"), F.coalesce(F.sum(F.coalesce(chars, F.lit(0))), F.lit(0))).first()
    return F.broadcast(held) if n <= store.BROADCAST_ROWS and size <= BROADCAST_CHARS else held


def _judged(path: Column, is_dir: Column, expression: Column) -> Column:
    """ignored, hidden, or null, of a path whose directory is entered. A rule that takes a path back also shows a hidden one."""
    node = F.concat(path, F.when(is_dir, "\0").otherwise(""))
    taken = F.regexp_substr(node, expression).isNotNull()
    shown = F.coalesce(F.regexp_instr(node, expression), F.lit(0)) > 0
    hidden = F.regexp_extract(path, r"([^/]*)\z", 1).startswith(".")
    return F.when(taken, "ignored").when(~shown & hidden, "hidden")


def unsafe(path: Column) -> Column:
    """Whether a path is missing, absolute, or has a part that is empty, `.`, `..` or holds a NUL."""
    return path.isNull() | F.coalesce(path.rlike(r"(?s)\A\z|\A/|//|/\z|\x00|(?:\A|/)\.\.?(?:\z|/)"), F.lit(True))


def discovered(entries: DataFrame, reserved: tuple[str, ...] = (), suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, verdict and n of the files and links of a tree (path, kind, text): found, or why not; n is a found one's place by path, from 0.

    Verdicts: unsafe_path, link (never followed), pruned (a directory above is ignored, hidden or a link), ignored, hidden, reserved (below one of the
    given directories), unsupported (another suffix). A path that comes twice comes once here, and is a link if one row says so. Null paths are one
    row. Paths may be of any length and depth; an ignore file is read whole. Extra columns are left out.
    """
    said = entries.select("path", c("kind"), c("text"), unsafe(c("path")).alias("unsafe"))
    nodes = said.filter("kind IS NULL OR kind <> 'dir'").groupBy("path").agg(F.max(F.coalesce(c("kind") == "link", F.lit(False))).alias("link"), F.max("unsafe").alias("unsafe"))
    nodes = store.written(nodes)
    sound = nodes.filter(~c("unsafe"))
    links = sound.filter("link").select("path")
    dirs = store.written(sound.select(_parent(c("path")).alias("dir")).distinct().select(F.explode(_ancestors(c("dir"))).alias("dir")).filter("dir <> ''").distinct())

    name = F.coalesce(F.nullif(F.regexp_extract("path", r"\A(\.git/info/exclude)\z", 1), F.lit("")), F.nullif(F.regexp_extract("path", r"(?:\A|/)(\.gitignore|\.ignore)\z", 1), F.lit("")))
    own = said.filter(~c("unsafe") & (c("kind") == "file")).withColumn("name", name).filter("name IS NOT NULL")
    of = F.when(c("name") == RULES[0], "").otherwise(_parent(c("path")))
    texts = own.groupBy(of.alias("of"), "name").agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))
    roots = dirs.filter(r"dir RLIKE '/\\.git$'").select(_parent(c("dir")).alias("of"), F.lit(_ROOT).alias("name"), F.lit("").alias("text"))
    rules = _few(texts.unionByName(roots), F.length("text") + F.length("of"))

    # Of each directory the nearest one, itself or above, that has rules; there all rules that count are made one expression.
    holders = _few(rules.select("of").distinct(), F.length("of"))
    above = dirs.unionByName(dirs.sparkSession.createDataFrame([("",)], "dir string")).select("dir", F.explode(F.array_distinct(_ancestors(c("dir")))).alias("of"))
    held = store.written(above.join(holders, "of").groupBy("dir").agg(F.max_by("of", F.length("of")).alias("owner")))
    chains = holders.select(c("of").alias("owner")).select("owner", F.explode(F.array_distinct(_ancestors(c("owner")))).alias("of"))
    gathered = chains.join(rules, "of").groupBy("owner").agg(F.collect_list(F.struct("of", "name", "text")).alias("files"))
    expressions = _few(gathered.select("owner", _compiled("owner", "files").alias("expression")), F.length("expression") + F.length("owner"))

    parents = dirs.select(c("dir").alias("node"), _parent(c("dir")).alias("dir")).join(held, "dir", "left").join(expressions, "owner", "left")
    shut = parents.filter(_judged(c("node"), F.lit(True), c("expression")).isNotNull()).select(c("node").alias("of")).unionByName(links.select(c("path").alias("of"))).distinct()
    closed = dirs.select("dir", F.explode(_ancestors(c("dir"))).alias("of")).join(_few(shut, F.length("of")), "of", "left_semi").select("dir").distinct().withColumn("closed", F.lit(True))
    # A directory may hold a third of all files: it is on the small side, and Spark splits the other.
    where = _few(dirs.unionByName(dirs.sparkSession.createDataFrame([("",)], "dir string")).join(held, "dir", "left").join(closed, "dir", "left"), F.length("dir"))
    asked = sound.withColumn("dir", _parent(c("path"))).join(where, "dir", "left").join(expressions, "owner", "left")
    kept_out = F.lit(False)
    for folder in reserved:
        kept_out = kept_out | c("path").startswith(folder.rstrip("/") + "/")
    suffix = F.lower(F.regexp_extract("path", r"[^/]\.([^./]*)\z", 1))
    verdict = F.when(c("closed"), "pruned").when(c("link"), "link")
    verdict = F.coalesce(verdict, _judged(c("path"), F.lit(False), c("expression")), F.when(kept_out, "reserved").when(~suffix.isin(*suffixes), "unsupported").otherwise("found"))
    judged = store.written(asked.select("path", verdict.alias("verdict")).unionByName(nodes.filter("unsafe").select("path", F.lit("unsafe_path").alias("verdict"))))
    found = store.numbered(judged.filter("verdict = 'found'"), "path")
    return found.unionByName(judged.filter("verdict <> 'found'").withColumn("n", F.lit(None).cast("long")))


def limited(found: DataFrame, most: int = MOST_FOUND) -> DataFrame:
    """found with refused: whether the tree has more documents than an index takes, so that none of them is indexed."""
    held = store.written(found)
    return held.withColumn("refused", F.lit(held.filter("verdict = 'found'").count() > most))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The entries below a folder that all executors see, level by level: a level's directories are dealt to tasks. Links are named, not followed;
    names that are not UTF-8 are left out, as is what cannot be read."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for below in batch["dir"]:
                rows = []
                try:
                    with os.scandir(os.path.join(folder, below)) as there:
                        for x in there:
                            path = f"{below}/{x.name}" if below else x.name
                            if not path.isprintable() and any("\ud800" <= y <= "\udfff" for y in path):
                                continue
                            kind = "link" if x.is_symlink() else "dir" if x.is_dir() else "file" if x.is_file() else None
                            text = None
                            if kind == "file" and (x.name in RULES or path == RULES[0]):
                                with open(x.path, encoding="utf-8", errors="replace", newline="") as file:
                                    text = file.read()
                            if kind:
                                rows.append((path, kind, text))
                except OSError:
                    pass
                yield pd.DataFrame(rows, columns=["path", "kind", "text"])

    schema, levels = "path string, kind string, text string", []
    dirs = spark.createDataFrame([("",)], "dir string")
    while True:
        levels.append(store.written(dirs.repartition(spark.sparkContext.defaultParallelism).mapInPandas(scan, schema)))
        dirs = levels[-1].filter("kind = 'dir'").select(c("path").alias("dir"))
        if dirs.isEmpty():
            return store.union(*levels)
