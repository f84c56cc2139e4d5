"""Links between sets of shingles and components of them, whatever way candidates are found within a chunk of sets.

What meets is decided exactly, by tokens: each set has some, of which two sets that link share one (its prefix, rarest
first). A token's smallest set is its pivot; all sets that share tokens with one pivot make a block, and a large block is cut into
chunks by size. Within a chunk only sets outside its largest component ask for candidates, since a pair of different components has
one of these: however many sets are alike, they ask about once.

A first pass has each set in one block only, that with which it shares most, and that block's pivot. A second has blocks in which
components still differ: the sets outside the block's largest component meet all sets of it, by sizes that can link. So a chunk
is sent once for each chunk of outsiders, and not once for each other chunk.

No link between different sets is lost: it is given, or implied by given ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrook.llm import repeats as r
from tallyrook.llm import words as w
from tallyrook.llm.components import connected_components
from tallyrook.llm.shared import cut, quoted, small, written

SHINGLE = 5
#: A chunk's shingles, each set counted as if it had SET_COST more; what a task of chunks takes, so counted, about.
CHUNK, SET_COST, TASK = 1_000_000, 500, 500_000
#: class_check: of a class, a second hash. tokens: some that a linked set shares one of. shingles: in the order of their bits as signed numbers.
SETS = "doc_id long, mark long, n_shingles long, class long, class_check long, tokens array<long>, shingles array<long>"


class ShingleSets:
    """Distinct shingles of the texts of one part, each text's together and in order."""

    def __init__(self, docs: pa.Table):
        words = w.split(docs.column("text"), w.SPACE, lower=True)
        n = len(words.first) - 1
        h, inside = w.windows(words, SHINGLE)
        at = np.flatnonzero(inside)
        rows = words.rows()
        lengths = np.diff(words.first)
        short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
        whole = np.array([w.sequence(words.hash[words.first[i] : words.first[i + 1]]) for i in short], np.uint64)
        hashes, row = np.concatenate([h[at], whole]), np.concatenate([rows[at], short])
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        first = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))[: len(hashes)]
        self.hashes, self.row = hashes[first], row[first]
        self.size = np.bincount(self.row, minlength=n)
        self.begin = np.append(0, np.cumsum(self.size))

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each text's whole set, of its digest."""
        digests = [hashlib.blake2b(self.hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(self.begin[:-1].tolist(), self.begin[1:].tolist(), strict=True)]
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def lists(values: np.ndarray, row: np.ndarray, n: int, there: np.ndarray) -> pa.Array:
    """The values of each of n rows, null where it isn't there; row: of each value, ascending."""
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=n))).astype(np.int32)
    array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
    return pc.if_else(pa.array(there), array, pa.nulls(n, array.type))


def told(sets: ShingleSets, part: pa.Table, able: np.ndarray, tokens: tuple[np.ndarray, np.ndarray], shingles: np.ndarray) -> pa.Table:
    """SETS of a part; able: which texts may link; tokens: with the text of each; shingles: which of them count. Tokens and
    shingles are given once for each class of the part."""
    n = len(sets.size)
    classes, check = sets.classes()
    _, first = np.unique(np.stack([classes, check]), axis=1, return_index=True)
    given = np.zeros(n, bool)
    given[first] = True
    given &= able
    values, row = tokens
    pick = given[row]
    kept = np.flatnonzero(shingles & given[sets.row])
    ids = [pc.if_else(pa.array(able), pa.array(x), None) for x in (classes, check)]
    columns = [part.column("doc_id"), part.column("mark"), pa.array(sets.size.astype(np.int64)), *ids, lists(values[pick], row[pick], n, given), lists(sets.hashes[kept], sets.row[kept], n, given)]
    return pa.Table.from_arrays(columns, ["doc_id", "mark", "n_shingles", "class", "class_check", "tokens", "shingles"])


def rarest(row: np.ndarray, level: np.ndarray, hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which of the entries, by row the many[row] of least level; ties go by hash. Ordered by row."""
    order = np.lexsort((hashes, level, row))
    begin = np.searchsorted(row[order], np.arange(len(many)))
    place = np.arange(len(order)) - begin[row[order]]
    return order[place < many[row[order]]]


def mark(docs: DataFrame) -> Column:
    """A hash of a row's id and text: rows with one id and one mark are one row repeated."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def shingle_sets(docs: DataFrame, asked: Callable, tell: Callable) -> DataFrame:
    """A row of SETS for each of docs, written. asked(sets): occurrences (repeats.Runs) of the hashes of a part of which it is asked
    whether other parts have them; tell(sets, part, runs, elsewhere, level): the rows, by told(), from the answer for each hash of the
    runs: whether, and how many parts, roughly."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), mark(docs).alias("mark"))
    plan, dealt = r.layout(docs)
    bits = plan.bits

    def ask(key: tuple, part: pa.Table) -> pa.Table:
        return r.question(key[0].as_py(), asked(ShingleSets(part)).hashes, None, bits)

    def answered(key: tuple, part: pa.Table, answers: pa.Table) -> pa.Table:
        sets = ShingleSets(part)
        runs = asked(sets)
        return tell(sets, part, runs, *r.heard(answers, 0, runs.hashes, bits, wide=False))

    answers = dealt.groupBy("part").applyInArrow(ask, r.QUESTION).groupBy("bucket").applyInArrow(r.shared_by_parts(0, flagged=False, counted=True), r.ANSWER)
    rows = written(dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(answered, SETS))
    clash = rows.groupBy("class").agg(F.min("class_check").alias("lo"), F.max("class_check").alias("hi")).filter("lo != hi").select("class", F.lit(True).alias("clash"))
    if clash.isEmpty():
        return rows
    parted = F.when(F.col("clash"), F.xxhash64("class", "class_check")).otherwise(F.col("class"))
    return rows.join(clash, "class", "left").withColumn("class", parted).drop("clash")


# --- chunks ------------------------------------------------------------------------------------------------------
class Lists:
    """Owners by value, of values with an owner each."""

    def __init__(self, values: np.ndarray, owner: np.ndarray, n: int):
        runs = r.Runs.of(values)
        self.members, self.first, self.n = owner[runs.order], np.append(runs.begin, len(values)), n
        self.list = runs.spread(np.arange(len(runs.hashes)))

    def overlaps(self, at: np.ndarray) -> np.ndarray:
        """How many of the values at these places each owner has."""
        own = self.list[at]
        begin, many = self.first[own], self.first[own + 1] - self.first[own]
        places = np.repeat(begin - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        return np.bincount(self.members[places], minlength=self.n)


#: So many pairs of one set are verified one by one.
FEW = 4


@dataclass
class Chunk:
    """Sets of a chunk: the size of each whole set, its shingles from begin[i] to begin[i + 1], and root, of what is connected. left and
    right: masks of the sets whose links with each other are asked for (both may be all); where there are none, all links are."""

    sizes: np.ndarray
    shingles: np.ndarray
    begin: np.ndarray
    root: np.ndarray
    percent: int
    lists: Lists | None = None
    left: np.ndarray | None = None
    right: np.ndarray | None = None

    def meet(self, x: int) -> np.ndarray:
        """Which sets have another label than x and stand on a side that x asks."""
        apart = self.root != self.root[x]
        return apart if self.left is None else apart & ((self.left[x] & self.right) | (self.right[x] & self.left))

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """How many shingles x shares with each of the others: one by one, or many by lists of the sets that have each shingle."""
        own = self.shingles[self.begin[x] : self.begin[x + 1]]
        if len(others) <= FEW:
            return np.array([len(np.intersect1d(own, self.shingles[self.begin[y] : self.begin[y + 1]], assume_unique=True)) for y in others], np.int64)
        if self.lists is None:
            self.lists = Lists(self.shingles, np.repeat(np.arange(len(self.sizes)), np.diff(self.begin)), len(self.sizes))
        return self.lists.overlaps(np.arange(self.begin[x], self.begin[x + 1]))[others]

    def linked(self, x: int, others: np.ndarray) -> np.ndarray:
        """Which of the others x links with."""
        common = self.common(x, others)
        return others[100 * common >= self.percent * (self.sizes[x] + self.sizes[others] - common)]

    def join(self, a: int, b: int) -> None:
        self.root[self.root == self.root[b]] = self.root[a]


def chunk_links(chunk: Chunk, left: np.ndarray, right: np.ndarray, finder: type, batch: int = 64) -> list[tuple[int, int]]:
    """Links that connect all that links between sets of the left and of the right connect (masks; both may be all).

    finder(chunk) is an index of the chunk's sets, whose search(asking) gives pairs (of asking, of the chunk) that may link, of each set the
    likeliest first. After links it is told by updated(), as the labels have changed. A pair of different labels has a set outside the largest
    component, one on the left and one on the right: when all sets of one of these three have asked, all pairs have met.
    """
    chunk.left, chunk.right = left, right
    index, found = finder(chunk), []
    done = np.zeros(len(chunk.sizes), bool)
    while True:
        roots, counts = np.unique(chunk.root, return_counts=True)
        waiting = min((np.flatnonzero(~done & some) for some in (chunk.root != roots[np.argmax(counts)], left, right)), key=len)
        if not len(waiting):
            return found
        asking = waiting[: batch if found or done.any() else 1]
        done[asking] = True
        a, b = index.search(asking)
        sides = (left[a] & right[b]) | (right[a] & left[b])
        before = len(found)
        a, b = a[sides], b[sides]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        heads = np.flatnonzero(np.diff(a, prepend=-1))
        for x, ys in zip(a[heads].tolist(), np.split(b, heads[1:]), strict=False):  # without pairs, one empty piece and no x
            for some in (ys[:FEW], ys[FEW:]):  # the likeliest come first, and mostly connect the rest
                for y in chunk.linked(x, some[chunk.root[some] != chunk.root[x]]).tolist():
                    if chunk.root[x] != chunk.root[y]:
                        chunk.join(x, y)
                        found.append((x, y))
        if len(found) > before:
            index.updated()


def stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each node with the least of those that the links connect it with, where that is another."""
    least: dict[int, int] = {}

    def top(x: int) -> int:
        while least.setdefault(x, x) != x:
            least[x] = x = least[least[x]]
        return x

    for x, y in links:
        x, y = top(x), top(y)
        least[max(x, y)] = min(x, y)
    return [(x, top(x)) for x in least if top(x) != x]


def _linked(rows: DataFrame, shingles: DataFrame, percent: int, finder: type) -> DataFrame:
    """Links (a, b) of chunks, of each chunk as stars: rows (block, c1, c2, side, class, label, n, m), side 0 with side 1, or 2 for both."""
    weight = rows.agg(F.sum(F.col("m") + SET_COST)).first()[0] or 0
    tasks = max(1, weight // TASK)
    keyed = rows.join(shingles, "class").withColumn("task", F.pmod(F.xxhash64("block", "c1", "c2"), F.lit(tasks)).cast("int")).repartition(tasks, "task")

    def search(task: pa.Table) -> pa.Table:
        block, c1, c2, side, classes, labels, sizes = (task.column(c).to_numpy() for c in ("block", "c1", "c2", "side", "class", "label", "n"))
        column = task.column("shingles").combine_chunks()
        values, ends = column.flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(column).to_numpy()))
        order = np.lexsort((classes, c2, c1, block))
        change = np.flatnonzero((np.diff(block[order]) != 0) | (np.diff(c1[order]) != 0) | (np.diff(c2[order]) != 0)) + 1
        a, b = [], []
        for own in np.split(order, change) if len(order) else []:
            _, root = np.unique(labels[own], return_inverse=True)
            if root.any():
                begin = np.append(0, np.cumsum(ends[own + 1] - ends[own]))
                chunk = Chunk(sizes[own], np.concatenate([values[ends[i] : ends[i + 1]] for i in own]), begin, root, percent)
                of = classes[own].tolist()
                for x, y in stars([(of[x], of[y]) for x, y in chunk_links(chunk, side[own] != 1, side[own] != 0, finder)]):
                    a.append(x)
                    b.append(y)
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return keyed.groupBy("task").applyInArrow(search, "a long, b long").distinct()


def _chunks(members: DataFrame, name: str) -> DataFrame:
    """members (block, class, n, m, ...) with a chunk: stretches by size of about CHUNK shingles. Sets of one size are spread over
    the stretch they take by a hash, so that only sizes are added up, not members. Sizes within a sixteenth of each other are added together."""
    level = F.floor(16 * F.log2("n"))
    weights = members.groupBy("block", level.alias("level")).agg(F.sum(F.col("m") + SET_COST).alias("own"))
    before = Window.partitionBy("block").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    placed = weights.withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0)))
    spread = F.pmod(F.xxhash64("class"), F.lit(1 << 20)) / (1 << 20)
    return members.withColumn("level", level).join(placed, ["block", "level"]).withColumn(name, ((F.col("before") + F.col("own") * spread) / CHUNK).cast("int")).drop("level", "before", "own")


def class_links(sets: DataFrame, percent: int, finder: type) -> DataFrame:
    """Links (a, b) between classes, from sets (class, n, tokens, shingles), that connect all that are linked."""
    m = F.size("shingles")
    prefix = sets.select("class", "n", F.explode("tokens").alias("token"))
    pivots = prefix.groupBy("token").agg(F.min(F.struct("n", "class")).alias("pivot"), F.count("*").alias("members")).filter("members > 1")
    pairs = prefix.join(pivots, "token").groupBy(F.col("pivot.class").alias("block"), "class").agg(F.count("*").alias("tokens"))
    members = cut(pairs.join(sets.select("class", "n", m.alias("m")), "class"))
    shingles = sets.select("class", "shingles")

    # First each class in one block, that with which it shares most, and with that block's pivot.
    best = members.filter("class != block").groupBy("class").agg(F.max(F.struct("tokens", "block", "n", "m")).alias("x")).select(F.col("x.block").alias("block"), "class", "x.n", "x.m")
    own = cut(_chunks(best, "c1"))
    pivots = own.select("block", "c1").distinct().join(sets.select(F.col("class").alias("block"), "n", m.alias("m")), "block")
    pivot_too = pivots.select("block", F.col("block").alias("class"), "n", "m", "c1")
    within = own.unionByName(pivot_too).withColumns({"c2": F.col("c1"), "side": F.lit(2), "label": F.col("class")})
    links = cut(_linked(within, shingles, percent, finder))

    # Then, where classes of a block are still apart, those outside its largest component with all.
    labels = connected_components(links).withColumnRenamed("node", "class")
    labelled = members.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    count = labelled.groupBy("block", "label").agg(F.count("*").alias("count"))
    main = count.groupBy("block").agg(F.max(F.struct("count", "label")).alias("x"), F.count("*").alias("labels")).filter("labels > 1").select("block", F.col("x.label").alias("main"))
    apart = labelled.join(main, "block").select("block", "class", "label", "n", "m", "main")
    every = cut(_chunks(apart, "c2"))
    outside = cut(_chunks(every.filter("label != main").drop("c2"), "c1"))
    ranges = lambda rows, chunk, lo, hi: rows.groupBy("block", chunk).agg(F.min("n").alias(lo), F.max("n").alias(hi))
    meet = ranges(outside, "c1", "low", "high").join(ranges(every, "c2", "low2", "high2"), "block").filter((100 * F.col("high") >= percent * F.col("low2")) & (100 * F.col("high2") >= percent * F.col("low"))).select("block", "c1", "c2")
    columns = ["block", "c1", "c2", "class", "label", "n", "m"]
    asking = outside.join(meet, ["block", "c1"]).select(*columns, F.lit(0).alias("side"))
    asked = every.join(meet, ["block", "c2"]).select(*columns, F.lit(1).alias("side"))
    return labels.select(F.col("class").alias("a"), F.col("label").alias("b")).unionByName(_linked(asking.unionByName(asked), shingles, percent, finder))


# --- components of documents -------------------------------------------------------------------------------------
def _least(rows: DataFrame, percent: int, finder: type) -> DataFrame:
    """class and least (none, doc_id, class, mark), the least row of its component, of rows of shingle_sets(). Null ids come last."""
    able = rows.filter(F.col("class").isNotNull())
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class", "mark")
    given = [F.first(c, ignorenulls=True).alias(c) for c in ("tokens", "shingles")]
    sets = written(able.groupBy("class").agg(F.min(key).alias("least"), F.min("n_shingles").alias("n"), *given))
    found = connected_components(class_links(sets.select("class", "n", "tokens", "shingles"), percent, finder)).withColumnRenamed("node", "class")
    of_class = sets.select("class", "least").join(found, "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = of_class.groupBy("label").agg(F.min("least").alias("least"))
    return of_class.select("class", "label").join(least, "label").select("class", "least")


def similar_components(rows: DataFrame, percent: int, finder: type) -> DataFrame:
    """doc_id, n_shingles and component_id of each of rows of shingle_sets()."""
    of_class = _least(rows, percent, finder).select("class", F.col("least.doc_id").alias("component_id"))
    return rows.select("doc_id", "n_shingles", "class").join(of_class, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, rows: DataFrame, percent: int, finder: type) -> DataFrame:
    """docs without the rows that are not the least of their component (null ids last), whatever other rows have their id. rows: of
    shingle_sets(docs).

    Rows with one id (or none) and one text are one row repeated, of which the least stays; but texts without words have no links,
    and those without an id stay too.
    """
    keys = rows.select("doc_id", "mark", "class").join(_least(rows, percent, finder), "class")
    gone = cut(keys.filter(~(F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark")))).select("doc_id", "mark").distinct())
    able = rows.filter(F.col("class").isNotNull() | ((F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()))
    counts = able.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).filter("n > 1")
    again = cut(_of(counts, counts["mark"], gone, "left_anti").select("doc_id", "mark"))
    kept = _of(docs, mark(docs), small(gone), "left_anti")
    if again.isEmpty():
        return kept
    again = small(again)
    fields = F.struct(*(docs[quoted(c)] for c in docs.columns))
    repeated = _of(kept, mark(kept), again, "left_semi")
    single = repeated.groupBy(repeated["doc_id"].alias("id"), mark(repeated).alias("mark")).agg(F.min_by(fields, F.to_json(fields)).alias("least"))
    return _of(kept, mark(kept), again, "left_anti").unionByName(single.select("least.*"))


def _of(rows: DataFrame, mark: Column, keys: DataFrame, how: str) -> DataFrame:
    """A semi or anti join of rows with keys (doc_id, mark), with null ids as one."""
    return rows.join(keys, (mark == keys["mark"]) & rows["doc_id"].cast("long").eqNullSafe(keys["doc_id"]), how)
