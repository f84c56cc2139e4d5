"""What hashes must not confuse, columns that clash with working ones, and models, pictures and splitters against definitions."""

import math
from bisect import bisect_left

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyrook.llm import decontaminate, jaccard_join, lang_id, licenses, media, quality, repeats, sharding, substring_dedup
from tallyrook.llm import words as w


def thue_morse(n):
    """Two words of n letters whose polynomials coincide modulo 2 ** 64 for every odd base, if n is 1024 or more."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [32, 64, 65, 1024, 2048])
def test_long_words_differ(n):
    found = w.split(pa.array(list(thue_morse(n))), w.SPACE, lower=True)
    assert found.hash[0] != found.hash[1]


@pytest.mark.parametrize("n", [1024, 2048])
def test_colliding_words_in_operators(spark, n):
    one, other = thue_morse(n)
    many = " ".join(f"w{i}" for i in range(12))
    docs = lambda a, b: spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.repeat_digests(docs(f"{many} {one}", f"{many} {other}")).collect()] == [0, 0]
    found = jaccard_join.similar_components(docs(f"a b c d {one}", f"a b c d {other}")).collect()
    assert {r.component_id for r in found} == {1, 2}
    items = spark.createDataFrame([(7, f"x y {one}")], "item_id long, text string")
    hit = {r.doc_id: r.contaminated for r in decontaminate.contamination_digests(docs(f"x y {one}", f"x y {other}"), items).collect()}
    assert hit == {1: True, 2: False}


def test_impostors_lose_their_hash():
    found = w.split(pa.array(["mit License mit"]), w.ALNUM, lower=True)
    known = {int(found.hash[0]): b"mit", int(found.hash[1]): b"licence"}  # as if another word had the hash of license
    w.without_impostors(found, known)
    assert found.hash[0] and found.hash[2] and not found.hash[1]


NAMES = ("part", "row", "salt", "n_words", "spans", "items", "score", "rejected", "lang_pred", "cross_entropy", "removed", "kept", "class", "mark", "shingles", "n_shingles", "fold", "bucket", "dot.ted", "tick`ed")


def clashing(spark, rows):
    schema = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *("`" + x.replace("`", "``") + "` string" for x in NAMES)])
    return spark.createDataFrame([(i, t, "en", "s", len(t), *(f"{x} of {i}" for x in NAMES)) for i, t in rows], schema)


@pytest.mark.parametrize("k", range(4))
def test_clashing_columns_come_out_unchanged(spark, monkeypatch, k):
    """Every stage but the last, with all its working names as columns of the input, none dropped beforehand."""
    monkeypatch.setattr(repeats, "PART_BYTES", 500)
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["the", "house", "stands", "near", "river", "and", "old", "garden", "with", "many", "trees", "in", "light"], 40)) for _ in range(30)]
    rows = [*enumerate(texts), (40, texts[0]), (41, " ".join(texts[1].split()[:20] + texts[2].split()[:20])), (42, "")]
    docs = clashing(spark, rows)
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    kept = {r["doc_id"]: r for r in out.collect()}
    assert kept
    for i, r in kept.items():
        assert [r[x] for x in NAMES] == [f"{x} of {i}" for x in NAMES] and r["source"] == "s"
    assert out.limit(0).count() == 0 and stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_very_long_texts(spark):
    """One text of 1.5 million characters among short ones."""
    base = " ".join(f"w{i % 5003}x{i % 11}" for i in range(150_000))
    docs = spark.createDataFrame([(1, base), (2, "a short text"), (3, "intro " + base)], "doc_id long, text string")
    words = len(base.split())
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.repeat_digests(docs).collect()}
    assert removed[1] == (words, 0) and removed[3] == (words + 1, words)
    assert {r.doc_id: r.component_id for r in jaccard_join.similar_components(docs).collect()} == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([(5, " ".join(base.split()[-12:]))], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.contamination_digests(docs, items).collect()} == {1: True, 2: False, 3: True}
    assert {r.doc_id: r.n_words for r in licenses.license_digests(docs).collect()}[3] == words + 1
    stored = {r.doc_id: r for r in media.media_digests(docs).collect()}
    assert stored[1].n_bytes == len(base) and len(stored[1].feature) == 16


def test_repeated_rows_fill_no_part(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART_BYTES", 2000)
    rows = [(1, "same words again and again " * 4)] * 300 + [(i, f"text number {i} of its own kind") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan, dealt = repeats.layout(docs.select("doc_id", "text", F.lit(0).alias("row")))
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert plan.parts > 10 and sum(sizes) == len(rows) and max(sizes) < 100
    assert {r.n_removed for r in substring_dedup.repeat_digests(docs).collect()} == {0}


def test_cosine_hash_by_definition():
    rng = np.random.default_rng(6)
    for height in (1, 3, 32, 100):
        pixels = rng.integers(0, 256, (height, 64)).astype(float)
        mean = lambda rows: [np.mean(rows[i * len(rows) // 32 : max((i + 1) * len(rows) // 32, i * len(rows) // 32 + 1)], axis=0) for i in range(32)]
        small = np.array(mean(np.array(mean(pixels)).T)).T
        wave = lambda k, i: math.cos(math.pi * k * (2 * i + 1) / 64)
        flat = [round(sum(small[y][x] * wave(u, y) * wave(v, x) for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
        middle = np.median(flat[1:])
        assert media.cosine_hash(pixels.astype(np.uint8)) == np.packbits([x > middle for x in flat]).tobytes()


def test_rules_by_hand(spark):
    """The compiled column against the rules, evaluated one by one in Python."""
    rng = np.random.default_rng(3)
    rows = [tuple(rng.random(len(quality.STATISTICS)).tolist()) for _ in range(200)]
    bound = lambda: quality.Bound(str(rng.choice(quality.STATISTICS)), bool(rng.integers(2)), float(rng.random()))
    ensemble = quality.Ensemble([(tuple(bound() for _ in range(rng.integers(1, 4))), float(rng.normal())) for _ in range(40)], 0.3)
    frame = spark.createDataFrame(rows, ", ".join(f"{s} double" for s in quality.STATISTICS))
    for r in frame.withColumn("p", ensemble.score()).collect():
        total = 0.3 + sum(weight for rule, weight in ensemble.rules if all(r[b.statistic] > b.value if b.above else r[b.statistic] <= b.value for b in rule))
        assert abs(r["p"] - 1 / (1 + math.exp(-total))) < 1e-9


def test_kneser_ney_by_dictionaries():
    """Interpolated Kneser-Ney written as its recursion over dictionaries, against the arrays."""
    texts = {"aa": "banana bandana ban ana", "bb": "tomato potato motto"}
    held, plain = {}, {}
    for lang, text in texts.items():
        (codes, rows), *_ = lang_id._slices([text])
        grams, n = np.unique(lang_id.ngrams(codes, rows)[0], return_counts=True)
        held[lang] = lang_id.all_orders(grams, n)
        tops = {tuple((int(g) >> 16 * (3 - j)) & 0xFFFF for j in range(4)): int(k) for g, k in zip(grams, n, strict=True)}
        levels = {4: tops}
        for k in (3, 2, 1):
            levels[k] = {}
            for g in levels[k + 1]:
                levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1
        plain[lang] = levels
    letters = {g[-1] for levels in plain.values() for g in levels[1]}

    def probability(levels, gram):
        k = len(gram)
        if not k:
            return 1 / (len(letters) + 1)
        counts, lower = levels[k], probability(levels, gram[1:])
        ones, twos = (sum(c == x for c in counts.values()) for x in (1, 2))
        cut = ones / (ones + 2 * twos) if ones and twos else 0.5
        own = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        return lower if not total else max(counts.get(gram, 0) - cut, 0) / total + cut * len(own) / total * lower

    models = lang_id.models_of(held)
    rng = np.random.default_rng(1)
    asked = [g for levels in plain.values() for g in levels[4]] + [tuple(rng.choice(sorted(letters), 4).tolist()) for _ in range(60)]
    packed = np.array([sum(x << 16 * (3 - j) for j, x in enumerate(g)) for g in asked], np.uint64)
    got = np.exp2(models.log_prob(packed, 4))
    for k, lang in enumerate(models.languages):
        assert np.allclose(got[:, k], [probability(plain[lang], g) for g in asked], rtol=1e-4)


def test_folded_models_still_sum_to_one(spark):
    docs = spark.createDataFrame([(i, "aa", f"kalo mira tesun doba relik sano {chr(97 + i % 26)}{chr(97 + i % 7)}") for i in range(80)], "doc_id long, lang string, text string")
    for cells in (40, lang_id.CELLS):
        models = lang_id.learn(docs, docs["doc_id"] >= 0, cells)
        letters = sorted({ord(c) for c in "abcdefghijklmnopqrstuvwxyz"} | {0x20})
        level = models.levels[0][0]
        assert cells != 40 or len(level.grams) <= 40
        context = sum(ord(c) << 16 * (2 - j) for j, c in enumerate("alo")) << 16
        known = np.array([context | x for x in letters], np.uint64)
        assert np.exp2(models.log_prob(known, 4)).sum(axis=0)[0] < 1.0001


def test_splitters_by_a_sort(spark):
    rng = np.random.default_rng(2)
    rows = [(f"{int(k):032x}", int(s)) for k, s in zip(rng.integers(0, 1 << 62, 4000), rng.integers(16, 400, 4000), strict=True)]
    bounds = sharding.splitters(spark.createDataFrame(rows, "key string, size long"), 12, tolerance=0.0)
    rows.sort()
    ends = np.append(0, np.cumsum([s for _, s in rows]))
    keys = [k for k, _ in rows]
    for i, b in enumerate(bounds, 1):
        below = ends[bisect_left(keys, b)]
        assert abs(below - ends[-1] * i / 12) == np.abs(ends - ends[-1] * i / 12).min()


def test_whole_licences(spark):
    fill = lambda t: licenses._MARK.sub(" ", t).replace("  ", " ")
    texts = {label: "Copyright 2024 A. B.\n" + fill(t) for label, t in licenses.WHOLE.items()}
    rows = [*texts.values(), texts["MIT"].replace("merge", "merged"), "x " + licenses.NOTICES["cc-by-nc-4.0"].replace("<<beginOptional>>the<<endOptional>>", "")[:40]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.license_digests(docs).collect()}
    for i, label in enumerate(texts):
        assert label in found[i].labels.split(",") and found[i].score == 1.0, label
    broken = found[len(texts)]
    assert "MIT" not in broken.labels.split(",") and broken.score == 0.75  # the grant alone is left
