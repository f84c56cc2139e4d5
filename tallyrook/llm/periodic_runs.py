"""Periodic runs of words, found in grammars.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, TIMES * q) words, which no neighbour
extends. Within a run each word but those of its last period comes again within q words: only texts with such a
stretch are looked at further (a text of many words mostly has none), and of these the whole text is compressed.

1. Re-Pair. Adjacent symbols that occur more than once become a nonterminal. A round replaces, of all texts of a batch at once, each
   occurrence of a pair that is more frequent than the pairs that overlap it (of equal ones, every other), and counts again; rounds end
   when no pair of a text occurs twice. What is left of a text becomes a balanced tree, so that each text is one derivation.
2. Each nonterminal is looked at once, where it first stands: a run that crosses its inner boundary covers two periods on one side of
   it, so q is a distance at which the block of 2 ** j words beside the boundary comes again, 2 ** j the largest power up to q.
   Blocks of powers of two are numbered exactly, by doubling, so equality of any stretches is two comparisons, and
   each candidate is extended both ways, within the nonterminal, by halving steps.
3. What is found is carried to all positions at which its nonterminal was derived. Every run is whole in the least
   nonterminal that has it whole; parts of it that others have overlap it by more than a period and merge with it.

Words are numbered by 128 bits of their letters. A text is worked on as a whole, in a batch of at most BATCH_BYTES or alone: a very long one
takes some hundred bytes a word for each doubling of its length. Null and empty texts have no words and no runs. Repeated rows are
texts of their own, an empty table gives an empty table, and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrook.llm import words as w

#: Words of a run: at least LEAST, and TIMES periods.
LEAST, TIMES = 6, 4
#: Bytes of text that are worked on at once; pairs of positions compared at once.
BATCH_BYTES, STEP = 4 << 20, 1 << 20
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


# --- which texts ---------------------------------------------------------------------------------------------------
def next_same(ids: np.ndarray) -> np.ndarray:
    """How far from each position its number comes next; len(ids) if it does not."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    out = np.full(n, n, np.int64)
    again = ids[order][1:] == ids[order][:-1]
    out[order[:-1][again]] = order[1:][again] - order[:-1][again]
    return out


def may_repeat(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Which of n rows may have a run. ids: of words, equal within a row only.

    In a run of period q, at least (TIMES - 1) * q words, and LEAST - q, come again within q. So in a stretch of words that come again, those
    that do so within a (TIMES - 1)-th of its length can belong to one only; the stretches of these are shorter, and so on.
    """
    gap = next_same(ids)
    near = gap < len(ids)
    while True:
        near_, change = np.append(near, False), np.append(True, rows[1:] != rows[:-1])
        begin = np.flatnonzero(near & (np.append(True, ~near[:-1]) | change[: len(near)]))
        if not len(begin):
            return np.zeros(n, bool)
        end = np.flatnonzero(near & (~near_[1:] | np.append(change[1:], True)))
        size = end - begin + 1
        of = np.repeat(size, size)
        at = np.flatnonzero(near)
        stays = (gap[at] * (TIMES - 1) <= of) & (of + gap[at] >= LEAST - 1)
        if stays.all():
            return np.bincount(rows[at], minlength=n) > 0
        near = np.zeros(len(near), bool)
        near[at[stays]] = True


# --- the grammar ---------------------------------------------------------------------------------------------------
class Grammar:
    """Derivations of some texts, one after the other: nodes with a symbol each, that begin at start and have an inner boundary and an end."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.symbols, self.start, self.middle, self.end = [], [], [], []
        self.names = len(ids)
        self.known_keys, self.known_names = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        sequence, begin, row = self._paired(ids.astype(np.int64), np.arange(len(ids)), rows)
        self._tree(begin, row, len(ids))
        self.symbols, self.start, self.middle, self.end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.symbols, self.start, self.middle, self.end))

    def _add(self, symbols, start, middle, end) -> None:
        for own, new in zip((self.symbols, self.start, self.middle, self.end), (symbols, start, middle, end), strict=True):
            own.append(new)

    def _paired(self, sequence: np.ndarray, begin: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is left when no pair occurs twice; numbers of different rows differ."""
        total = len(sequence)
        while len(sequence) > 1:
            key = (sequence[:-1].astype(np.uint64) << np.uint64(32)) | sequence[1:].astype(np.uint64)
            runs = _numbered(key)
            count = np.bincount(runs)[runs]
            count[row[1:] != row[:-1]] = 0
            shuffled = np.argsort(w.mix(np.arange(runs.max() + 1, dtype=np.uint64)))
            rank = count * len(shuffled) + shuffled[runs]  # more frequent first; among equals no order that follows the text
            rank[count < 2] = -1
            before, after = np.append(-1, rank[:-1]), np.append(rank[1:], -1)
            top = (rank >= 0) & (rank >= before) & (rank >= after)
            at = np.flatnonzero(top)
            if not len(at):
                break
            # Equal neighbours are one pair of equal symbols that overlaps itself: every other is taken.
            chained = np.append(False, (np.diff(at) == 1) & (rank[at[1:]] == rank[at[:-1]]))
            head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            names = self._named(key[at])
            end = np.append(begin[1:], total)
            self._add(names, begin[at], begin[at + 1], end[at + 1])
            sequence = sequence.copy()
            sequence[at] = names
            stays = np.ones(len(sequence), bool)
            stays[at + 1] = False
            sequence, begin, row = sequence[stays], begin[stays], row[stays]
        return sequence, begin, row

    def _named(self, keys: np.ndarray) -> np.ndarray:
        """The nonterminal of each pair, the same as before if it had one."""
        distinct, which = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.known_keys, distinct)
        old = np.zeros(len(distinct), bool)
        inside = at < len(self.known_keys)
        old[inside] = self.known_keys[at[inside]] == distinct[inside]
        names = np.empty(len(distinct), np.int64)
        names[old] = self.known_names[at[old]]
        names[~old] = self.names + np.arange((~old).sum())
        self.names += int((~old).sum())
        self.known_keys = np.insert(self.known_keys, at[~old], distinct[~old])
        self.known_names = np.insert(self.known_names, at[~old], names[~old])
        return names[which]

    def _tree(self, begin: np.ndarray, row: np.ndarray, total: int) -> None:
        """Nodes over what is left of each row, two and two."""
        end = np.append(begin[1:], total)
        while len(begin) and (row[1:] == row[:-1]).any():
            first = np.searchsorted(row, row)
            left = np.flatnonzero(((np.arange(len(row)) - first) % 2 == 0) & np.append(row[1:] == row[:-1], False))
            self._add(self.names + np.arange(len(left)), begin[left], begin[left + 1], end[left + 1])
            self.names += len(left)
            end[left] = end[left + 1]
            stays = np.ones(len(row), bool)
            stays[left + 1] = False
            begin, end, row = begin[stays], end[stays], row[stays]


def _numbered(values: np.ndarray) -> np.ndarray:
    """A number for each different value."""
    return pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int64)


# --- runs --------------------------------------------------------------------------------------------------------
class Blocks:
    """Numbers of all stretches of 2 ** j words."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.numbers = [_numbered(ids)]
        while 2 << len(self.numbers) - 1 <= max(longest, 1):
            last, half = self.numbers[-1], 1 << len(self.numbers) - 1
            if len(last) <= half:
                break
            self.numbers.append(_numbered((last[:-half].astype(np.uint64) << np.uint64(32)) | last[half:].astype(np.uint64)))

    def common_after(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words from a and from b on agree, up to limit."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.numbers) - 1, -1, -1):
            for _ in range(2 if j < len(self.numbers) - 1 else 1 << 62):
                able = np.flatnonzero(out + (1 << j) <= limit)
                able = able[self.numbers[j][a[able] + out[able]] == self.numbers[j][b[able] + out[able]]]
                if not len(able):
                    break
                out[able] += 1 << j
        return out

    def common_before(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words that end before a and before b agree, up to limit."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.numbers) - 1, -1, -1):
            for _ in range(2 if j < len(self.numbers) - 1 else 1 << 62):
                able = np.flatnonzero(out + (1 << j) <= limit)
                able = able[self.numbers[j][a[able] - out[able] - (1 << j)] == self.numbers[j][b[able] - out[able] - (1 << j)]]
                if not len(able):
                    break
                out[able] += 1 << j
        return out


def crossing(blocks: Blocks, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Node, begin, end and period of all runs, within nodes, that cross their boundary; a period may be a multiple of the smallest."""
    out = []
    for j, numbers in enumerate(blocks.numbers):
        size, n = 1 << j, len(numbers)
        order = np.argsort(numbers, kind="stable")
        place = numbers[order] * (n + 1) + order  # by block, then position
        for right in (True, False):
            # A run has two periods right of the boundary, or left of it: the block there comes again q words on, or came q words before.
            room = np.minimum((end - middle if right else middle - start) // 2, (end - start) // TIMES)
            node = np.flatnonzero((room >= size) & (end - start >= LEAST))
            at = middle[node] if right else middle[node] - size
            node, at = (x[(at >= 0) & (at < n)] for x in (node, at))
            far = np.minimum(2 * size - 1, room[node])
            if right:
                lo, hi = np.searchsorted(place, numbers[at] * (n + 1) + at + size), np.searchsorted(place, numbers[at] * (n + 1) + at + far, "right")
            else:
                lo, hi = np.searchsorted(place, numbers[at] * (n + 1) + at - far), np.searchsorted(place, numbers[at] * (n + 1) + at - size, "right")
            many = np.maximum(hi - lo, 0)
            cuts = np.append(0, np.searchsorted(np.cumsum(many), np.arange(STEP, many.sum() + STEP, STEP), "left") + 1)
            for a, b in zip(cuts[:-1].tolist(), np.minimum(cuts[1:], len(many)).tolist(), strict=True):
                if a >= b:
                    continue
                k = np.repeat(np.arange(a, b), many[a:b])
                own = node[k]
                other = order[lo[k] + np.arange(len(k)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b])]
                q = np.abs(other - at[k])
                x = middle[own] if right else middle[own] - q  # x and x + q are compared, both ways from there
                after = blocks.common_after(x, x + q, end[own] - x - q)
                before = blocks.common_before(x, x + q, x - start[own])
                first, last = x - before, x + q + after
                good = (last - first >= np.maximum(LEAST, TIMES * q)) & (first < middle[own]) & (last > middle[own])
                out.append(np.stack([own[good], first[good], last[good], q[good]]))
    return tuple(np.concatenate(out, axis=1)) if out else tuple(np.zeros((4, 0), np.int64))


def runs_of(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and smallest period of all runs of a sequence of rows; ids of different rows differ."""
    grammar = Grammar(ids, rows)
    _, once = np.unique(grammar.symbols, return_index=True)
    longest = int((grammar.end - grammar.start).max()) // TIMES if len(once) else 0
    node, first, last, period = crossing(Blocks(ids, longest), grammar.start[once], grammar.middle[once], grammar.end[once])
    # Of one stretch of a nonterminal, the smallest period.
    order = np.lexsort((period, last, first, node))
    node, first, last, period = node[order], first[order], last[order], period[order]
    least = np.append(True, (np.diff(node) != 0) | (np.diff(first) != 0) | (np.diff(last) != 0))[: len(node)]
    node, first, last, period = node[least], first[least], last[least], period[least]
    # To every position of the nonterminal.
    symbol = grammar.symbols[once][node]
    by = np.argsort(grammar.symbols, kind="stable")
    lo, hi = np.searchsorted(grammar.symbols[by], symbol), np.searchsorted(grammar.symbols[by], symbol, "right")
    many = hi - lo
    k = np.repeat(np.arange(len(node)), many)
    places = grammar.start[by[lo[k] + np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)]]
    shift = places - grammar.start[once][node[k]]
    first, last, period = first[k] + shift, last[k] + shift, period[k]
    # Stretches of one period that overlap by a period are one.
    order = np.lexsort((last, first, period))
    first, last, period = first[order], last[order], period[order]
    if not len(first):
        return first, last, period
    far = len(ids) + 1
    reach = np.maximum.accumulate(last + period * far) - period * far
    new = np.append(True, (period[1:] != period[:-1]) | (first[1:] + period[1:] > reach[:-1]))
    begin = np.flatnonzero(new)
    first, last, period = first[begin], np.maximum.reduceat(last, begin), period[begin]
    # A stretch that has a smaller period too.
    order = np.lexsort((period, last, first))
    first, last, period = first[order], last[order], period[order]
    only = np.append(True, (first[1:] != first[:-1]) | (last[1:] != last[:-1]))
    return first[only], last[only], period[only]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most BATCH_BYTES of text, or one row."""
    for batch in w.slices(batches):
        _, at = w.utf8(batch.column("text"))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + BATCH_BYTES, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def periodic_runs(docs: DataFrame) -> DataFrame:
    """RUNS of each of docs, by start and period; collapsed: without the words that a run has after its first period."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            found = w.split(batch.column("text"), w.SPACE, lower=False)
            n, rows = batch.num_rows, found.rows()
            ids = _numbered(found.hash ^ w.mix(rows.astype(np.uint64)))
            at = np.flatnonzero(may_repeat(ids, rows, n)[rows])
            of_row = [[] for _ in range(n)]
            gone = np.zeros(len(rows) + 1, np.int64)
            if len(at):
                exact = _numbered(_numbered(found.hash[at]) * len(at) + _numbered(found.other[at]))
                exact = _numbered(rows[at] * (int(exact.max()) + 1) + exact)
                first, last, period = runs_of(exact, rows[at])
                shift = at[first] - first  # rows are whole, so a run moves as one
                np.add.at(gone, first + shift + period, 1)
                np.add.at(gone, last + shift, -1)
                own = rows[at[first]]
                begin = at[first] - found.first[own]
                for i in np.lexsort((period, begin, own)).tolist():
                    of_row[own[i]].append({"start": int(begin[i]), "length": int(last[i] - first[i]), "period": int(period[i])})
            out = np.cumsum(gone)[:-1] > 0
            texts = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ws = (text or "").encode("utf-8", "surrogatepass").split()
                if of_row[i]:
                    ws = [x for x, dropped in zip(ws, out[found.first[i] : found.first[i + 1]].tolist(), strict=True) if not dropped]
                texts.append(b" ".join(ws).decode("utf-8", "surrogatepass"))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(found.first), pa.int64()), pa.array(of_row, kind), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(find, RUNS)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten, by a checksum of its id, repeats some of its words to its end."""
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    base = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("ws"))
    sized = base.withColumns({"n": F.size("ws"), "g": F.floor(F.col("h") / 10)})
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    changed = F.expr("array_join(transform(ws, (x, i) -> if(i < a, x, ws[cast(a + (i - a) % p as int)])), ' ')")
    return period.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), changed).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: least start, then period), and digests of all runs and of the collapsed text."""
    found = periodic_runs(with_planted_runs(docs))
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length as length, r.start as start, r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("x", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("x.start").alias("start"), (-F.col("x.length")).alias("length"), F.col("x.period").alias("period"),
        F.expr("div(1000 * -x.length, x.period)").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: crc32 of the decimal id, bit by bit; all pairs of equal words of a text, by distance.
RUNS_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT doc_id, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS cs, 1 AS i, 4294967295::BIGINT AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, cs, i + 1, list_reduce(list_prepend(xor(crc, cs[i]), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) FROM bits WHERE i <= len(cs)
), sums AS (SELECT doc_id, xor(crc, 4294967295) AS h FROM bits WHERE i = len(cs) + 1
), plain AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), placed AS (
  SELECT r, plain.doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, (h // 10) % greatest(len(ws), 1) AS a, h // 10 AS g FROM plain LEFT JOIN sums USING (doc_id)
), d AS (
  SELECT r, doc_id, CASE WHEN planted THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws FROM placed
), word AS (SELECT r, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d
), equal AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM word x JOIN word y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretch AS (
  SELECT r, q, min(i) AS s, max(i) + 1 + q AS e FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM equal) GROUP BY r, q, part
), run AS (SELECT r, s, e, min(q) AS q FROM stretch WHERE e - s >= greatest(6, 4 * q) GROUP BY r, s, e
), told AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    arg_min({'s': s, 'l': e - s, 'q': q}, {'l': s - e, 's': s, 'q': q}) AS x FROM run GROUP BY r
), gone AS (SELECT DISTINCT r, unnest(range(s + q, e)) AS i FROM run
), kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, x.s AS start, x.l AS length, x.q AS period, (1000 * x.l) // x.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""
