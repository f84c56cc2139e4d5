"""Language identification by interpolated Kneser-Ney character models.

One model a language, over lower-cased letters with each run of other characters as one blank. N-grams are counted on Spark
over all learnable documents (repeated rows as often as they stand), but for one in five that is kept for calibration; so are
the lower orders' numbers of different continuations, and the totals of contexts. A model is a language's own: for every
order a sorted array of its hashed n-grams with log probabilities, interpolated down to the letters, and one of its hashed contexts with
back-off weights. Only what a task can hold goes into models: of each order a language's most frequent n-grams, CELLS / languages of
them at most, whatever the sizes of other languages. What is beyond is folded exactly into the weights of the contexts, so that
probabilities still sum to one; languages share nothing but the number of different letters. A text is scored by binary search of its
different n-grams in each model, slice by slice, and goes to the language with the lowest cross-entropy per character.

Rejection is calibrated on all kept documents: they say what cross-entropy a language's own texts have, how far they
stray with their length, and what the same letters have in random order. A text is rejected where it lies, beyond
straying, nearer to random letters than to the language. A language of fewer than FEW * FOLDS documents is learned from all of
them and calibrated on all, each scored by models that were learned without its fifth (counted and bounded like any other), and
strays as far as all languages together at least. A language of a single document has nothing kept: what is as random as its
letters in random order is rejected.

A very long text is scored in slices of SLICE characters. Null texts and those without a letter: `und`, score 0, rejected. Ties go to the first language in sorted order. With
nothing to learn from, all is `und`. Repeated rows are scored each; an empty table gives an empty table; extra columns of any
name stay in keep_identified() and identify() (where the new ones replace any of the same name) and are ignored in the digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType
from pyspark.sql.window import Window

from tallyrook.llm.shared import bundled, cut, unbundled, with_new, written
from tallyrook.llm.words import mix, slices

ORDER = 4
#: Of each order, n-grams that the models hold together at most; n-grams that a task holds before it hands on counts.
CELLS, PENDING = 2_000_000, 2_000_000
NEW = ("lang_pred", "score", "rejected", "cross_entropy")
UNKNOWN = "und"
#: Characters of a slice; a 16-bit code of the blank, and of letters beyond those codes.
SLICE, BLANK, BEYOND = 1 << 20, 0x20, 0xFFFE
#: How many times as far as 99 of 100 of a language's own texts a text may stray from their mean.
STRAY = 3.0
#: A fifth is kept; a language with fewer kept documents is calibrated by leaving out each fifth; random letters lie so far from a language at least.
FOLDS, FEW, APART = 5, 10, 0.1
_U = np.uint64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def _slices(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of the texts (three blanks before each) and the row of each, slice by slice."""
    part, rows, size = [], [], 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        for a in range(0, max(len(text), 1), SLICE):  # a later slice of a text begins with the characters before it
            piece = text[max(0, a - ORDER + 1) : a + SLICE] if a else "\n" * (ORDER - 1) + text[:SLICE] + "\n" * (len(text) <= SLICE)
            part.append(piece)
            rows.append((i, len(piece)))
            size += len(piece)
            if size >= SLICE:
                yield _codes(part, rows)
                part, rows, size = [], [], 0
    if part:
        yield _codes(part, rows)


def _codes(part: list[str], rows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
    high = x >= 0x10000
    if high.any():
        x = x.copy()
        values, at = np.unique(x[high], return_inverse=True)
        x[high] = np.array([BEYOND if chr(c).isalpha() else BLANK for c in values.tolist()], np.uint32)[at]
    letter = _letters()[x] | (x == BEYOND)
    lengths = np.array([n for _, n in rows])
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    begin = np.cumsum(lengths) - lengths
    for k in range(ORDER - 1):
        keep[(begin + k)[lengths > k]] = True
    row = np.repeat(np.arange(len(rows)), lengths)[keep]
    return np.where(letter, x, BLANK)[keep].astype(np.uint64), np.array([i for i, _ in rows])[row]


def ngrams(codes: np.ndarray, rows: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams, 16 bits a character, the last in the lowest bits, and their rows."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = np.zeros(n, np.uint64)
    for j in range(order):
        packed = (packed << _U(16)) | codes[j : j + n]
    whole = rows[:n] == rows[order - 1 :]
    return packed[whole], rows[:n][whole]


@dataclass
class Level:
    """A language's n-grams of one order, sorted by hash, with log2 probabilities; contexts, sorted by hash, with log2 weights."""

    grams: np.ndarray
    prob: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


def log_prob(levels: list[Level], packed: np.ndarray, order: int) -> np.ndarray:
    """log2 of a language's probability of the last character after the others. An n-gram of order 1 that it has not is an unknown character."""
    level = levels[order - 1]
    at, found = _find(level.grams, mix(packed))
    out = np.where(found, level.prob[at] if len(level.prob) else 0, level.weight[0] if order == 1 else 0)
    rest = np.flatnonzero(~found)
    if order > 1 and len(rest):
        at, known = _find(level.contexts, mix(packed[rest] >> _U(16)))
        back = level.weight[at] * known if len(level.weight) else 0
        out[rest] = log_prob(levels, packed[rest] & _U((1 << 16 * (order - 1)) - 1), order - 1) + back
    return out


@dataclass
class Models:
    languages: list[str]
    levels: list[list[Level]]  # of each language, of order 1, 2, ...
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    noise: np.ndarray | None = None

    def log_prob(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log2 of each language's probability of the last character after the others."""
        return np.stack([log_prob(own, packed, order) for own in self.levels], axis=1)

    def entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text by language, characters scored, and whether it has a letter."""
        total = np.zeros((len(texts), len(self.languages)))
        count, letters = np.zeros(len(texts)), np.zeros(len(texts), bool)
        for codes, rows in _slices(texts):
            packed, row = ngrams(codes, rows)
            letters[rows[codes != BLANK]] = True
            count += np.bincount(row, minlength=len(texts))
            once = pa.array(packed).dictionary_encode()
            which, different = once.indices.to_numpy(), once.dictionary.to_numpy()
            for k, own in enumerate(self.levels):
                total[:, k] -= np.bincount(row, log_prob(own, different, ORDER)[which], len(texts))
        return total / np.maximum(count, 1)[:, None], count, letters

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, float]]:
        """Language, score, whether it is rejected, and the cross-entropy of each text."""
        if not self.languages:
            return [(UNKNOWN, 0.0, True, 0.0)] * len(texts)
        entropy, count, letters = self.entropy(texts)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(texts)), best]
        odds = np.exp2(-(entropy - low[:, None]) * np.minimum(count, 30)[:, None]).sum(axis=1)
        stray = STRAY * self.spread[best] / np.sqrt(np.maximum(count, 1))
        off = (low - self.mean[best] - stray) / (self.noise[best] - self.mean[best])
        fits = 1 / (1 + np.exp(np.clip(10 * (off - 0.5), -50, 50)))
        score = fits / odds
        return [(self.languages[b], s, f < 0.5, h) if has else (UNKNOWN, 0.0, True, 0.0) for b, s, f, h, has in zip(best.tolist(), score.tolist(), fits.tolist(), low.tolist(), letters.tolist(), strict=True)]


def _find(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.searchsorted(table, hashes)
    at[at == len(table)] = 0
    return at, table[at] == hashes


@dataclass
class Grams:
    """n-grams of a language and an order: sorted, with their counts, the totals of their contexts, and the discount."""

    grams: np.ndarray
    counts: np.ndarray
    totals: np.ndarray
    discount: float


def discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def all_orders(grams: np.ndarray, counts: np.ndarray, order: int = ORDER) -> list[Grams]:
    """Of order 1, 2, ... from sorted n-grams of the highest order. Below it: in how many different n-grams of the next each is the end."""
    held = []
    for n in range(order, 0, -1):
        if n < order:
            grams, counts = np.unique(grams & _U((1 << 16 * n) - 1), return_counts=True)
        _, at = np.unique(grams >> _U(16) if n > 1 else np.zeros(len(grams), np.uint64), return_inverse=True)
        held.append(Grams(grams, counts, np.bincount(at, counts)[at], discount((counts == 1).sum(), (counts == 2).sum())))
    return held[::-1]


def kneser_ney(held: list[Grams], letters: int) -> list[Level]:
    """A language's model from its n-grams of order 1, 2, ...; what of a context's total is not in them goes to its back-off weight.
    letters: how many there are in all languages, of which, and one unknown, each is as likely at the bottom."""
    levels: list[Level] = []
    for n, own in enumerate(held, start=1):
        contexts, at = np.unique(own.grams >> _U(16) if n > 1 else np.zeros(len(own.grams), np.uint64), return_inverse=True)
        lower = np.exp2(log_prob(levels, own.grams & _U((1 << 16 * (n - 1)) - 1), n - 1)) if n > 1 else 1 / (letters + 1)
        taken = (own.counts - own.discount) / own.totals
        share = np.maximum(1 - np.bincount(at, taken, len(contexts)), 1e-9)
        prob = taken + lower * share[at]
        weight = share if n > 1 else (share if len(share) else np.ones(1)) / (letters + 1)
        by, of_context = np.argsort(mix(own.grams)), np.argsort(mix(contexts))
        weight = weight[of_context] if n > 1 else weight
        levels.append(Level(mix(own.grams)[by], np.log2(prob).astype(np.float32)[by], mix(contexts)[of_context], np.log2(weight).astype(np.float32)))
    return levels


def models_of(held: dict[str, list[Grams]]) -> Models:
    """The models of all languages, from their n-grams of order 1, 2, ..."""
    languages = sorted(held)
    letters = len(np.unique(np.concatenate([held[x][0].grams for x in languages])))
    return Models(languages, [kneser_ney(held[x], letters) for x in languages])


def _counted(rows: DataFrame) -> DataFrame:
    """lang, gram and n: how often each n-gram stands in the texts of rows (lang, text)."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    def handed(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang in sorted(held):
            g, n = merged(held[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for batch in slices(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                for codes, rows_ in _slices([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    held.setdefault(lang, []).append(np.unique(ngrams(codes, rows_)[0], return_counts=True))
                    size += len(held[lang][-1][0])
            if size > PENDING:
                held = {lang: [merged(parts)] for lang, parts in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > PENDING // 2:
                    yield from handed(held)
                    held, size = {}, 0
        yield from handed(held)

    return rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _gathered(counts: DataFrame, quota: int) -> dict[str, list[Grams]]:
    """Of each language, the n-grams of every order with exact counts, totals and discounts; at most quota of a language and an order."""
    held: dict[str, dict[int, Grams]] = {}
    level, size = counts, F.floor(F.log2("n") * 64)
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            level = cut(level.groupBy("lang", F.col("gram").bitwiseAND((1 << 16 * n) - 1).alias("gram")).agg(F.count("*").alias("n")))
        of = {r["lang"]: discount(r["ones"], r["twos"]) for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()}
        often = level.groupBy("lang", size.alias("size")).agg(F.count("*").alias("count"))
        above = F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("size")))
        least = often.withColumn("above", above).filter(F.col("above") <= quota).groupBy("lang").agg(F.min("size").alias("least"))
        context = F.shiftrightunsigned("gram", 16) if n > 1 else F.lit(0).cast("long")
        totals = level.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"))
        kept = level.join(F.broadcast(least), "lang").filter(size >= F.col("least")).withColumn("context", context)  # a row a language
        table = kept.join(totals, ["lang", "context"]).select("lang", "gram", "n", "total").toArrow()
        lang = table["lang"].combine_chunks().dictionary_encode()
        names, at = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
        grams, ns, sums = table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy(), table["total"].to_numpy()
        for k, name in enumerate(names):
            own = np.flatnonzero(at == k)
            own = own[np.argsort(grams[own])]
            held.setdefault(name, {})[n] = Grams(grams[own], ns[own], sums[own], of[name])
        none = Grams(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0.5)
        for name in of:
            held.setdefault(name, {}).setdefault(n, none)
    return {lang: [orders[n] for n in range(1, ORDER + 1)] for lang, orders in held.items()}


def learn(docs: DataFrame, learnable, cells: int = CELLS) -> Models:
    """Models from rows of docs (doc_id, text, lang) that the condition learnable admits."""
    fold = F.pmod(F.xxhash64("doc_id", "text"), F.lit(FOLDS)).alias("fold")
    rows = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text", fold)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    rare = sorted(lang for lang, n in sizes.items() if n < FEW * FOLDS)
    # A rare language is learned from all, and for its calibration once more without each fifth: under its name and the fifth's number.
    few = rows.filter(F.col("lang").isin(rare))
    if rare:
        few = written(few)
    taught = rows.filter((F.col("fold") != 0) & ~F.col("lang").isin(rare)).select(F.concat(F.lit("-"), "lang").alias("lang"), "text")
    for k in range(-1, FOLDS) if rare else ():
        taught = taught.unionByName(few.filter(F.col("fold") != k).select(F.concat(F.lit("-" if k < 0 else str(k)), "lang").alias("lang"), "text"))
    held = _gathered(cut(_counted(taught)), max(cells // max(len(sizes), 1), 1))
    whole = {lang[1:]: own for lang, own in held.items() if lang[0] == "-"}
    if not whole:
        return Models([], [])
    models = models_of(whole)
    kept = rows.filter((F.col("fold") == 0) & ~F.col("lang").isin(rare))
    seen = [_scores(models, kept)] if len(rare) < len(sizes) else []
    for k in range(FOLDS) if rare else ():
        without = {lang: own for lang, own in whole.items() if lang not in rare} | {lang[1:]: own for lang, own in held.items() if lang[0] == str(k)}
        if without:
            seen.append(_scores(models_of(without), few.filter(F.col("fold") == k)))
    every = cut(reduce(DataFrame.unionByName, seen)) if seen else None
    return _calibrate(models, every, _scores(models, few) if rare else None)


def _scores(models: Models, kept: DataFrame) -> DataFrame:
    """Language, cross-entropy under its model, that of the same letters in random order, and length of each text with a letter."""
    held = kept.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            batch = batch.filter(pc.is_in(batch.column("lang"), pa.array(held.value.languages, pa.string())))
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            entropy, count, letters = held.value.entropy(texts)
            random, _, _ = held.value.entropy(["".join(np.random.default_rng(len(t)).permutation(list(t))) if t else t for t in texts])
            at = np.array([held.value.languages.index(x) for x in langs], int)
            row = np.arange(len(at))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(langs, object)[letters], pa.string()), *(pa.array(x[letters]) for x in (entropy[row, at], random[row, at], count))], ["lang", "entropy", "noise", "n"])

    return kept.select("lang", "text").mapInArrow(run, "lang string, entropy double, noise double, n double")


def _quantiles(seen: DataFrame, value, q: float, step: float) -> dict[str | None, float]:
    """The quantile of each language's values, and at None that of all, to the step: from counts of steps."""
    found: dict[str | None, list] = {}
    for r in seen.groupBy("lang", F.floor(value / step).alias("at")).count().collect():
        found.setdefault(r["lang"], []).append((r["at"], r["count"]))
        found.setdefault(None, []).append((r["at"], r["count"]))
    out = {}
    for lang, bins in found.items():
        bins.sort()
        ends = np.cumsum([n for _, n in bins])
        out[lang] = float((bins[int(np.searchsorted(ends, q * ends[-1]))][0] + 0.5) * step)
    return out


def _calibrate(models: Models, seen: DataFrame | None, learned: DataFrame | None) -> Models:
    """models with the mean, spread and noise of what was seen of each language (learned: of languages of which nothing was)."""
    size = len(models.languages)
    models.mean, models.spread, models.noise = np.zeros(size), np.zeros(size), np.zeros(size)
    mean = _quantiles(seen, F.col("entropy"), 0.5, 0.001) if seen is not None else {}
    noise = _quantiles(seen, F.col("noise"), 0.5, 0.001) if seen is not None else {}
    strayed, counts = {}, {}
    if len(mean) > 1:
        means = F.create_map(*(F.lit(x) for lang, m in mean.items() if lang is not None for x in (lang, m)))
        strayed = _quantiles(seen, F.abs(F.col("entropy") - means[F.col("lang")]) * F.sqrt("n"), 0.99, 0.01)
        counts = {r["lang"]: r["count"] for r in seen.groupBy("lang").count().collect()}
    alone = [lang for lang in models.languages if lang not in mean]
    own_noise = _quantiles(learned.filter(F.col("lang").isin(alone)), F.col("noise"), 0.5, 0.001) if alone and learned is not None else {}
    for i, lang in enumerate(models.languages):
        if lang in mean:
            models.mean[i] = mean[lang]
            models.noise[i] = max(noise[lang], mean[lang] + APART)
        elif lang in own_noise:
            models.noise[i] = own_noise[lang]
            models.mean[i] = models.noise[i] - APART
        else:  # not one letter
            models.mean[i], models.noise[i] = -APART, 0
        pooled = strayed.get(None, 0.0)
        models.spread[i] = strayed[lang] if counts.get(lang, 0) >= FEW else max(strayed.get(lang, 0.0), pooled)
    return models


def _identified(docs: DataFrame, models: Models) -> DataFrame:
    """Of bundled documents: doc_id, text, row and NEW."""
    kinds = (pa.string(), pa.float64(), pa.bool_(), pa.float64())
    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(NEW, (StringType(), DoubleType(), BooleanType(), DoubleType()), strict=True):
        schema = schema.add(name, kind)
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 500):
            found = held.value.predict(part.column("text").to_pylist())
            for name, kind, values in zip(NEW, kinds, zip(*found, strict=True), strict=True):
                part = part.append_column(name, pa.array(values, kind))
            yield part

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """docs with lang_pred, score, rejected and cross_entropy."""
    return with_new(_identified(bundled(docs), models), docs.columns, NEW)


def _remainder(divisor: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def language_digests(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    models = learn(docs, _remainder(3) != 1)
    return identify(docs.select("doc_id", "text"), models).select("doc_id", (_remainder(3) == 1).alias("held_out"), *NEW)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with the columns they came with."""
    models = learn(docs, _remainder(3) != 1)
    return unbundled(_identified(bundled(docs), models).filter(~F.col("rejected")), docs.columns)
