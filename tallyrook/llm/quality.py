"""Quality classifier: a sparse ensemble of rules, compiled into column expressions.

Statistics of whole texts (lengths, shares of characters, repetition) are computed once. Trees of a random forest, fitted
on labelled rows, give rules: each path from a root is a conjunction of bounds on statistics. A logistic regression with
a lasso penalty weighs all rules and leaves most at zero. What is left is compiled into one Spark column: the logistic
function of a sum of weights, each under its conjunction.

At most `bound` labelled rows are fitted (those with the smallest hashes of their id, by a threshold that is worked out
from their number); everything is scored.

Null and empty texts have statistics of zero and are scored like others; labels with a null quality are left out; a
document labelled twice is learned from twice. With no labels, or one class only, the score is that class's, or 0.5.
Repeated rows are scored each; an empty table gives an empty table; extra columns stay in with_statistics() (which replaces
columns named like a statistic) and are ignored in quality_scores().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tallyrook.llm import words as w
from tallyrook.llm.shared import cut

STATISTICS = ("log_words", "word_bytes", "upper", "shouts", "bars", "symbols", "digits", "distinct", "top_word", "same_again", "repeated_threes", "line_words", "same_lines", "stops", "wide")
BOUND = 20_000
THRESHOLD = 0.3
_U = np.uint64


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_UPPER, _ASCII_LETTER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_CLASSES = {"shout": _class("!"), "bar": _class("|"), "symbol": _class("#$%&*@^~<>{}[]=+_\\/"), "digit": _class("0123456789"), "stop": _class(".?"), "upper": _UPPER, "letter": _ASCII_LETTER}
_WIDE = np.arange(256) >= 128
_LINES = w._breaks([(0x0A, 0x0D)])


def _per_row(first: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Sums of hits over rows that begin at first[i] and end before first[i + 1]."""
    total = np.concatenate([[0], np.cumsum(hits, dtype=np.int64)])
    return (total[first[1:]] - total[first[:-1]]).astype(np.float64)


def _kinds(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, how many different hashes it has, and how often it has its most frequent one."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    keys = np.sort((hashes >> _U(16)) | (rows.astype(np.uint64) << _U(48)))
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    count, row = np.diff(np.append(begin, len(keys))), (keys[begin] >> _U(48)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, row, count)
    return np.bincount(row, minlength=n).astype(np.float64), most.astype(np.float64)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text. At most 65,536 texts at once."""
    n = len(column)
    found, (data, at) = w.split(column, w.SPACE, lower=True), w.utf8(column)
    lines = w.split(column, _LINES, lower=False)
    size, count = np.diff(at).astype(np.float64), np.diff(found.first).astype(np.float64)
    each, chars = np.maximum(count, 1), np.maximum(size, 1)
    of = {k: _per_row(at, t[data]) for k, t in _CLASSES.items()}
    rows = found.rows()
    distinct, top = _kinds(found.hash, rows, n)
    again = np.append(False, (found.hash[1:] == found.hash[:-1]) & (rows[1:] == rows[:-1])) if len(rows) else np.zeros(0, bool)
    threes, inside = w.windows(found, 3)
    row3 = rows[: len(threes)][inside]
    kinds3, _ = _kinds(threes[inside], row3, n)
    count3 = np.bincount(row3, minlength=n)
    n_lines = np.diff(lines.first).astype(np.float64)
    kind_lines, _ = _kinds(lines.hash, lines.rows(), n)
    return np.column_stack([
        np.log1p(count), _per_row(found.first, found.end - found.start) / each, of["upper"] / np.maximum(of["letter"], 1), of["shout"] / each, of["bar"] / each,
        of["symbol"] / each, of["digit"] / chars, distinct / each, top / each, _per_row(found.first, again) / each, 1 - kinds3 / np.maximum(count3, 1),
        count / np.maximum(n_lines, 1), 1 - kind_lines / np.maximum(n_lines, 1), of["stop"] / each, _per_row(at, _WIDE[data]) / chars,
    ])


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with a column for each of STATISTICS."""
    docs = docs.drop(*STATISTICS)
    schema = StructType(list(docs.schema.fields))
    for name in STATISTICS:
        schema = schema.add(name, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                values = statistics(part.column("text"))
                for k, name in enumerate(STATISTICS):
                    part = part.append_column(name, pa.array(values[:, k]))
                yield part

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Bound:
    """statistic <= value, or > value."""

    statistic: str
    above: bool
    value: float

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c > F.lit(self.value) if self.above else c <= F.lit(self.value)


Rule = tuple[Bound, ...]


@dataclass
class Ensemble:
    """Weighted rules and an intercept."""

    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1, as a column over STATISTICS."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule) -> Column:
    found = rule[0].column()
    for b in rule[1:]:
        found = found & b.column()
    return found


def tree_rules(model) -> list[Rule]:
    """The conjunction of every path from a root to a node of the forest, each once."""
    found: dict[Rule, None] = {}

    def walk(node, path: dict[tuple[str, bool], float]) -> None:
        if path:
            found.setdefault(tuple(Bound(s, above, v) for (s, above), v in sorted(path.items())))
        if node.getClass().getSimpleName() != "InternalNode":
            return
        split = node.split()
        name, value = STATISTICS[split.featureIndex()], split.threshold()
        low, high = (name, False), (name, True)
        walk(node.leftChild(), path | {low: min(value, path.get(low, value))})
        walk(node.rightChild(), path | {high: max(value, path.get(high, value))})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def fit(labelled: DataFrame, bound: int = BOUND, trees: int = 20, depth: int = 3, penalty: float = 0.002) -> Ensemble:
    """From rows of doc_id, STATISTICS and label."""
    n = labelled.count()
    share = 1 << 20
    if n > bound:
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) < share * bound // n)
    rows = cut(labelled.select(F.col("label").cast("double").alias("label"), *STATISTICS).coalesce(4))
    ones, n = rows.agg(F.sum("label"), F.count("*")).first()
    if not n or ones in (0, n):
        return Ensemble([], 0.0 if not n else 20.0 if ones else -20.0)
    joined = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, minInstancesPerNode=max(1, n // 500), featureSubsetStrategy="onethird", maxBins=64).fit(joined)
    rules = tree_rules(forest)
    if not rules:
        return Ensemble([], float(np.log(ones / (n - ones))))
    tested = cut(rows.select("label", *(holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules))))
    vectors = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(tested).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(vectors)
    return Ensemble([(r, x) for r, x in zip(rules, lasso.coefficients.toArray().tolist(), strict=True) if x], float(lasso.intercept))


def quality_scores(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by rules from labels of those not held out."""
    held_out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5) == 0
    known = cut(with_statistics(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).select("doc_id", held_out.alias("held_out"), *STATISTICS))
    marks = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
    ensemble = fit(known.filter(~F.col("held_out")).join(marks, "doc_id"), bound)
    scored = known.select("doc_id", "held_out", ensemble.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
