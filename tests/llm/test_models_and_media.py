"""Quality rules, pictures, language models, shards and byte-level encoding: held-out accuracy, round trips, brute force."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from tallyrook.llm import bpe, lang_id, media, quality, registry, sharding
from tallyrook.llm.lang_id import models_of

ODD = [None, "", " ", "a", "\n", "12 34!", "é" * 70, "x" * 64, "y" * 65, "word " * 3000, "日本語", "á 🙂 \U0001d400"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, upper string"


def frame(spark, texts, repeat=False):
    rows = [(i, t, "en", "s", 0, 9.0, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *(rows[:3] if repeat else [])], SCHEMA)


# --- pictures ----------------------------------------------------------------------------------------------------
def filtered(pixels, kinds):
    """A PNG whose rows use the given filter types, written sample by sample."""
    rows, above = b"", [0] * pixels.shape[1]
    for kind, row in zip(kinds, pixels.tolist(), strict=True):
        out = []
        for j, x in enumerate(row):
            a, b, c = row[j - 1] if j else 0, above[j], above[j - 1] if j else 0
            p = a + b - c
            paeth = a if abs(p - a) <= min(abs(p - b), abs(p - c)) else b if abs(p - b) <= abs(p - c) else c
            out.append((x - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        rows, above = rows + bytes([kind, *out]), row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    stream = zlib.compress(rows)
    return media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], len(pixels), 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"x") + chunk(b"IDAT", stream[:7]) + chunk(b"IDAT", stream[7:]) + chunk(b"IEND", b"")


def test_png():
    rng = np.random.default_rng(1)
    for height, width in ((1, 1), (1, 64), (40, 17), (300, 64)):
        pixels = rng.integers(0, 256, (height, width), dtype=np.uint8)
        assert (media.read_png(media.write_png(pixels)) == pixels).all()
        assert (media.read_png(filtered(pixels, rng.integers(0, 5, height))) == pixels).all()
        assert len(media.cosine_hash(pixels)) == 8
    smooth = (np.add.outer(np.arange(64), np.arange(64)) * 2).astype(np.uint8)
    assert (media.read_png(media.write_png(smooth)) == smooth).all()
    good = media.write_png(smooth)
    for bad in (b"", good[:-1], good[:30], b"x" + good[1:], *(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :] for i in (17, 29, 50, len(good) - 1))):
        with pytest.raises(ValueError):
            media.read_png(bad)


def test_media_columns(spark):
    found = {r.doc_id: r for r in media.media_digests(frame(spark, ODD, repeat=True)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        padded = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        assert (found[i].n_bytes, found[i].payload_bytes, found[i].payload_sha256, found[i].tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert found[0].feature == found[1].feature and found[0].media_sha256 == found[1].media_sha256
    stored = media.store_texts(frame(spark, ODD)).collect()
    assert all(media.read_png(bytes(r.media)).tobytes()[: r.n_bytes].decode() == (ODD[r.doc_id] or "") for r in stored)
    assert media.media_digests(frame(spark, ODD).limit(0)).count() == 0


# --- shards ------------------------------------------------------------------------------------------------------
def check_shards(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r.size for r in by.get(s, [])) for s in range(shards)]


def test_shards(spark, sf_dir):
    rows = sharding.shard_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), 10).collect()
    sizes = check_shards(rows, 10)
    assert max(sizes) - min(sizes) < 0.35 * sum(sizes) / 10  # a document alone has up to a third of a share here
    assert registry.QUERIES["op8_sharding"](spark, sf_dir).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_shards_of_a_hot_group(spark):
    texts = ["the same text " * 5] * 3000 + [f"another {i} " * (i % 7) for i in range(6000)]
    rows = sharding.shard_by_bytes(frame(spark, texts), 40, range_bytes=1 << 12).collect()
    sizes = check_shards(rows, 40)
    assert len(rows) == 9000 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 40 + 200
    assert sorted(r.doc_id for r in rows) == list(range(9000))
    again = sharding.shard_by_bytes(frame(spark, texts).repartition(7), 40, range_bytes=1 << 12).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == {r.doc_id: (r.shard, r.slot) for r in again}


def test_shards_odd(spark):
    rows = sharding.shard_digests(frame(spark, ODD, repeat=True), 40).collect()
    check_shards(rows, 40)
    for r in rows:
        raw = (ODD[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    assert sharding.shard_digests(frame(spark, ODD).limit(0), 40).count() == 0


# --- encoding ----------------------------------------------------------------------------------------------------
def test_encoding(spark):
    path, pattern = registry.ranks()
    whole = bpe.codec(path, pattern)[0]
    texts = [*ODD, "it's  a\t\tb\n\n c   ", " " * 300 + "x", "a" + "\n" * 299 + " " + "b", "end" + " " * 400, " " * 256, "Ünï ¡cödé! 12345 " * 40]
    found = {r.doc_id: r for r in bpe.token_digests(frame(spark, texts), path, pattern).collect()}
    for i, t in enumerate(texts):
        ids = whole.encode_ordinary(t or "")
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert bpe.encode(t or "", path, pattern, long=5) == ids
    assert len(bpe.encode(" " * 3_000_000 + "a", path, pattern)) > 0
    back = bpe.decode_ids(bpe.encode_texts(frame(spark, texts), path, pattern), path, pattern).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    assert bpe.token_digests(frame(spark, texts).limit(0), path, pattern).count() == 0


# --- language models ---------------------------------------------------------------------------------------------
def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    counts = {}
    for lang in "ab":
        g = np.unique(rng.integers(97, 103, (60, 4)), axis=0).astype(np.uint64)
        packed = g[:, 0] << np.uint64(48) | g[:, 1] << np.uint64(32) | g[:, 2] << np.uint64(16) | g[:, 3]
        counts[lang] = (np.sort(packed), rng.integers(1, 5, len(packed)))
    models = models_of({lang: lang_id.all_orders(*own) for lang, own in counts.items()})
    letters = np.unique(np.concatenate([c[0] & np.uint64(0xFFFF) for c in counts.values()]))
    for context in [*(counts["a"][0][:5] >> np.uint64(16)), np.uint64(0x7A007A007A)]:
        p = np.exp2(models.log_prob((context << np.uint64(16)) | np.append(letters, np.uint64(0x41)), 4))
        assert np.allclose(p.sum(axis=0), 1, atol=1e-4)  # all known letters, and one unknown


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lang_id.language_digests(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows) and not any(r.rejected for r in rows)
    models = lang_id.learn(docs, lang_id._remainder(3) != 1)
    odd = {r.doc_id: r for r in lang_id.identify(frame(spark, [*ODD, "12 !? 34", "zq xj wv kq " * 50]), models).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].rejected and odd[i].score == 0 for i in (0, 1, 2, 4, 5, len(ODD)))
    assert odd[len(ODD) + 1].rejected and "source" in odd[0].asDict()
    long = "".join(r.text or "" for r in docs.filter("lang = 'de'").limit(40).collect())
    split = models.entropy([long])[0]
    assert lang_id.Models.entropy(models, [long + "\n"])[0].argmin() == split.argmin() == models.languages.index("de")


def test_rare_languages_reject(spark):
    """One language with few documents, one with a single document: junk that falls to either goes, their own texts stay."""
    rng = np.random.default_rng(4)
    stems = {"aa": ["kalo", "mira", "tesun", "doba", "relik", "sano"], "bb": ["жура", "полан", "тесик", "мору", "вадел", "синот"], "cc": ["γαλο", "πετρυ", "μαρικ", "σενα"]}
    prose = lambda lang, n=80: " ".join(rng.choice(stems[lang], n))
    learned = [(lang, prose(lang)) for lang, n in (("aa", 80), ("bb", 12), ("cc", 1)) for _ in range(n)]
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(learned)], "doc_id long, lang string, text string")
    models = lang_id.learn(docs, docs["doc_id"] >= 0)
    junk = {lang: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(80)) for lang, letters in (("bb", "щъыэюфцчшх"), ("cc", "ωψξζθφχδηβ"))}
    for lang, text in junk.items():
        assert models.predict([text])[0][2], lang
    for lang in stems:
        assert [p[0] == lang and not p[2] for p in models.predict([prose(lang), *(t for x, t in learned if x == lang)])].count(False) == 0


def test_rare_languages_keep_their_models(spark):
    """A language's model doesn't depend on how much others have, though models are cut; and it is told from one of the same letters."""
    rng = np.random.default_rng(6)
    stems = {lang: ["".join(rng.choice(list("aeioklmnrst"), n)) for n in rng.integers(2, 8, 60)] for lang in ("aa", "bb", "cc")}
    prose = lambda lang, n=60: " ".join(rng.choice(stems[lang], n))
    rare, held_out = [("aa", prose("aa")) for _ in range(60)], [prose("aa") for _ in range(40)]
    found = []
    for many in (60, 2000):
        learned = rare + [(lang, prose(lang)) for lang in ("bb", "cc") for _ in range(many)]
        docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(learned)], "doc_id long, lang string, text string")
        found.append(lang_id.learn(docs, docs["doc_id"] >= 0, cells=3000))
        assert np.mean([p[0] == "aa" and not p[2] for p in found[-1].predict(held_out)]) > 0.97
    for a, b in zip(found[0].levels[0], found[1].levels[0], strict=True):
        assert len(a.grams) <= 1000 and (a.grams == b.grams).all() and np.allclose(a.prob, b.prob)


def test_one_document_without_an_id_is_learned(spark):
    docs = spark.createDataFrame([(None, "aa", "kalo mira tesun doba")] * 3, "doc_id long, lang string, text string")
    models = lang_id.learn(docs, docs["lang"] == "aa")
    assert models.languages == ["aa"] and not models.predict(["kalo mira tesun doba"])[0][2]


def test_languages_without_labels(spark):
    docs = frame(spark, ODD).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string"))
    assert {r.lang_pred for r in lang_id.language_digests(docs).collect()} == {"und"}
    assert lang_id.language_digests(docs.limit(0)).count() == 0


# --- quality -----------------------------------------------------------------------------------------------------
def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_odd(spark):
    docs = frame(spark, ODD, repeat=True)
    for marks in ([], [(0, 1, 0), (1, 1, 0), (2, None, 0)], [(3, 0, 0)], [(0, 1, 0), (3, 0, 1), (4, 1, 0), (7, 0, 0), (8, 1, 1)]):
        rows = quality.quality_scores(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
        assert len(rows) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_statistics_by_hand():
    import pyarrow as pa

    got = dict(zip(quality.STATISTICS, quality.statistics(pa.array(["Ab ab! | x x\nAb ab!", None]))[0], strict=True))
    want = {"upper": 2 / 10, "shouts": 2 / 7, "bars": 1 / 7, "distinct": 4 / 7, "top_word": 2 / 7, "same_again": 1 / 7, "line_words": 3.5, "same_lines": 0.0, "word_bytes": 13 / 7}
    assert all(np.isclose(got[k], v) for k, v in want.items()), got
