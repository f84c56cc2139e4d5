"""Logs, versions and generations, the text index against plain BM25, and the vector index against the exact search."""

import json
import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrook.jobs import search
from tallyrook.operators import channels
from tallyrook.sources import generations, text_index, vector_index, versions

rng = np.random.default_rng(3)


# --- versions ----------------------------------------------------------------------------------------------------
def rows(spark, base, version=None):
    return versions.read(spark, base, "id long", version).count()


def test_commit_rollback_commit(spark, tmp_path):
    base = f"{tmp_path}/t"
    assert versions.current_version(spark, base) is None
    first = versions.commit(spark.range(3), base)
    second = versions.commit(spark.range(5), base, after=first)
    assert (rows(spark, base), rows(spark, base, first)) == (5, 3)
    versions.rollback(spark, base, first)
    assert rows(spark, base) == 3 and versions.current_version(spark, base) == first
    third = versions.commit(spark.range(7), base, after=first)
    assert rows(spark, base) == 7 and len({first, second, third}) == 3
    with pytest.raises(ValueError):
        versions.rollback(spark, base, 99)


def test_one_of_two_writers_wins(spark, tmp_path):
    base = f"{tmp_path}/t"
    first = versions.commit(spark.range(3), base)
    log = versions.Log(spark, base)
    journal = log.begin(0, ["data/loser"], {"version": 9, "folder": "data/loser"})
    spark.range(9).write.parquet(f"{base}/data/loser")
    second = versions.commit(spark.range(5), base, after=first)
    with pytest.raises(versions.Conflict):
        log.finish(journal, 0, {"version": 9, "folder": "data/loser"})
    with pytest.raises(versions.Conflict):
        versions.commit(spark.range(8), base, after=first)
    assert rows(spark, base) == 5 and versions.current_version(spark, base) == second
    assert not os.path.exists(f"{base}/data/loser") and not os.listdir(f"{base}/pending")
    # Both have read the same entry; the file decides.
    assert log.files.create(f"{base}/log/0000000002.json", "{") and not log.files.create(f"{base}/log/0000000002.json", "{}")
    assert rows(spark, base) == 5  # half an entry is none
    assert versions.commit(spark.range(6), base, after=second) and rows(spark, base) == 6


@pytest.mark.parametrize(("written", "replay", "became"), [(False, True, "dropped"), (True, False, "dropped"), (True, True, "replayed")])
def test_a_killed_writer(spark, tmp_path, written, replay, became):
    """Killed before or after its files were whole: the old version stays, until the journal is dropped or replayed."""
    base = f"{tmp_path}/t"
    versions.commit(spark.range(3), base)
    log = versions.Log(spark, base)
    log.begin(0, ["data/x"], {"version": 1, "folder": "data/x"})
    if written:
        spark.range(4).write.parquet(f"{base}/data/x")
    assert rows(spark, base) == 3
    assert list(versions.recover(spark, base, replay).values()) == [became]
    assert rows(spark, base) == (4 if became == "replayed" else 3) and os.path.exists(f"{base}/data/x") == (became == "replayed")
    assert versions.recover(spark, base) == {}
    versions.commit(spark.range(6), base, after=versions.current_version(spark, base))
    assert rows(spark, base) == 6


def test_a_writer_killed_after_its_entry(spark, tmp_path):
    base = f"{tmp_path}/t"
    log = versions.Log(spark, base)
    log.begin(None, ["data/x"], {"version": 0, "folder": "data/x"})
    spark.range(4).write.parquet(f"{base}/data/x")
    log.claim(None, {"version": 0, "folder": "data/x"})
    assert list(versions.recover(spark, base).values()) == ["committed"] and rows(spark, base) == 4


# --- text index --------------------------------------------------------------------------------------------------
def bm25(docs, queries, k):
    bags = {i: Counter(w for w in t.lower().split() if len(w) >= 2) for i, t in docs.items()}
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / max(len(bags), 1)
    df = Counter(w for b in bags.values() for w in b)
    out = []
    for q, text in queries:
        scored = []
        for i, b in bags.items():
            size = sum(b.values())
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in set(text.split()) if w in b)
            if s > 0:
                scored.append((-round(s, 6), i))
        out += [(q, i, r) for r, (_, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(index, queries, k):
    return sorted((r.qid, r.doc_id, r.rank) for r in index.search(queries, k).collect())


def test_text_index(spark, tmp_path, monkeypatch):
    """Segments added, deleted from and merged give the rows of plain BM25; others' files stay as they are."""
    monkeypatch.setattr(text_index, "RANGE", 20)
    text = lambda n: " ".join(f"w{x:02d}" for x in rng.zipf(1.4, n) % 60)
    docs = {i: text(int(rng.integers(3, 40))) for i in range(300)}
    asked = [(q, " ".join({f"w{x:02d}" for x in rng.integers(0, 60, 4)})) for q in range(12)]
    queries = spark.createDataFrame([*asked, (99, "nowhere"), (98, "")], "qid long, text string")
    frame = lambda ids: spark.createDataFrame([(i, docs[i]) for i in ids], "doc_id long, text string")
    index = text_index.TextIndex(spark, f"{tmp_path}/i")
    assert found(index, queries, 10) == []
    index.add(frame(range(200)))
    files = lambda: {f for d, _, fs in os.walk(f"{tmp_path}/i/segments") for f in (os.path.join(d, x) for x in fs)}
    before = {f: os.path.getmtime(f) for f in files()}
    assert found(index, queries, 10) == bm25({i: docs[i] for i in range(200)}, asked, 10)
    index.add(frame(range(200, 300)))
    assert all(os.path.getmtime(f) == t for f, t in before.items()) and len(files()) > len(before)
    assert found(index, queries, 7) == bm25(docs, asked, 7)
    gone = [i for i in range(300) if i % 7 == 0]
    index.delete(spark.createDataFrame([(i,) for i in [*gone, 5000]], "doc_id long"))
    left = {i: t for i, t in docs.items() if i % 7}
    assert found(index, queries, 10) == bm25(left, asked, 10)
    docs[0] = "w01 w01 w02 again"
    index.add(frame([0]))  # an id that was deleted comes again
    left[0] = docs[0]
    assert found(index, queries, 10) == bm25(left, asked, 10)
    index.merge()
    assert found(index, queries, 400) == bm25(left, asked, 400)
    assert len(index.log.head().content["segments"]) == 1 and index.log.head().content["deletions"] == []


def test_text_index_skips_ranges(spark, monkeypatch):
    """Where bounds say that nothing can come among the best, a range isn't scored; the rows are the same."""
    part = np.array([])
    assert text_index._part(part, part, 1.0).size == 0
    tf, size = rng.integers(1, 9, 200), rng.integers(1, 90, 200)
    assert (text_index._part(tf, size, 20.0) <= text_index._part(tf.max(), size.min(), 20.0)).all()


def test_a_writer_of_an_index_that_lost(spark, tmp_path):
    one, two = (text_index.TextIndex(spark, f"{tmp_path}/i") for _ in range(2))
    frame = spark.createDataFrame([(1, "aa bb")], "doc_id long, text string")
    number, now = two._now()
    one.add(frame)
    two._now = lambda: (number, now)
    with pytest.raises(versions.Conflict):
        two.add(frame)
    assert len(os.listdir(f"{tmp_path}/i/segments")) == 1 and json.loads(one.log.files.read(f"{tmp_path}/i/log/0000000000.json"))["segments"]


# --- vector index ------------------------------------------------------------------------------------------------
def test_vector_index(spark, sf_dir, tmp_path, monkeypatch):
    """Recall at 10 of at least 0.9; a hot cell in parts; added vectors are found, deleted ones are not."""
    monkeypatch.setattr(vector_index, "PART", 60)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    extra = vectors.filter("doc_id < 100").select((F.col("doc_id") + 10**6).alias("doc_id"), "vector")
    same = spark.range(300).select((F.col("id") + 2 * 10**6).alias("doc_id"), F.lit(1).alias("x")).crossJoin(vectors.filter("doc_id = 7").select("vector")).drop("x")
    base = vectors.unionByName(same)
    queries = vectors.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("qid"), "vector")
    index = vector_index.VectorIndex(spark, f"{tmp_path}/v")
    index.build(base)
    assert index.vectors().count() == base.count() and index.vectors().groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 200
    exact = channels.cosine_top(queries, base, 10)
    got = index.search(queries, 10)
    assert vector_index.recall(got, exact, 10).agg(F.avg("recall")).first()[0] >= 0.9
    everything = index.search(queries, 10, probes=10**6)
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, exact.collect()))
    index.add(extra)
    index.delete(vectors.filter("doc_id = 20").select("doc_id"))
    now = {(r.qid, r.doc_id) for r in index.search(queries, 10).collect()}
    assert (10, 10**6 + 10) in now and not any(d == 20 for _, d in now)
    assert index.search(queries.limit(0), 10).count() == 0


def some_vectors(spark, first, n, size=5, of=60):
    """n vectors of norm 1, of which many are equal, with ids from first on."""
    own = np.random.default_rng(size).normal(size=(of, size))
    own /= np.linalg.norm(own, axis=1)[:, None]
    return spark.createDataFrame([(first + i, own[i * i % of].tolist()) for i in range(n)], "doc_id long, vector array<double>")


def test_blocks_give_the_rows_of_the_exact_search(spark, monkeypatch):
    """Ties go by id across blocks and tiles; other dimensions have no likeness, nor has what is not finite; fewer vectors than k; no query."""
    held, asked = some_vectors(spark, 0, 700), some_vectors(spark, 100, 90).withColumnRenamed("doc_id", "qid")
    expect = sorted(map(tuple, channels.cosine_top(asked, held, 12).collect()))
    for block, least in ((8 << 20, 1024), (8 * 5 * 40, 1), (8 * 5 * 5, 1)):
        monkeypatch.setattr(channels, "BLOCK", block)
        monkeypatch.setattr(channels, "LEAST", least)
        assert sorted(map(tuple, channels.cosine_top_blocks(asked, held, 12).collect())) == expect
    odd = spark.createDataFrame([(-1, [1.0, 0.0]), (-2, [float("nan")] * 5), (-3, None), (-4, [])], held.schema)
    assert sorted(map(tuple, channels.cosine_top_blocks(asked, held.union(odd), 12).collect())) == expect
    few = channels.cosine_top_blocks(asked, held.filter("doc_id < 3"), 12)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, channels.cosine_top(asked, held.filter("doc_id < 3"), 12).collect())) and few.count() == 270
    assert channels.cosine_top_blocks(asked.limit(0), held, 12).count() == channels.cosine_top_blocks(asked, held.limit(0), 12).count() == 0


def test_best_of_many_tiles(monkeypatch):
    """Against a sort of everything: equal vectors in tiles that are smaller than k, and larger."""
    own = np.round(rng.normal(size=(40, 4)), 1)
    own /= np.linalg.norm(own, axis=1)[:, None]
    q, v, ids = own[rng.integers(0, 40, 30)], own[rng.integers(0, 40, 500)], rng.permutation(500)
    alike = np.clip(np.round((q @ v.T + 1) / 2, 9), 0, 1)
    expect = {(i, ids[j], alike[i, j]) for i in range(30) for j in np.lexsort((ids, -alike[i]))[:20]}
    tables = [text_index.pa.table({name: list(range(30)) if name == "qid" else ids, "vector": list(x)}) for name, x in (("qid", q), ("doc_id", v))]
    for tile in ((7, 11), (16, 64), (256, 2048)):
        monkeypatch.setattr(channels, "TILE", tile)
        found = channels.best_of(*tables, 20, 9)
        assert found.num_rows == 600 and {tuple(x.values()) for x in found.to_pylist()} == expect


def test_parts_are_dealt_to_blocks_of_bounded_size():
    counts = [3, 4, 5, 1, 30, 2, 9, 10, 1]
    found = vector_index.dealt(counts, 10)
    held = {}
    for n, (block, pieces) in zip(counts, found):
        for b in range(block, block + pieces):
            held[b] = held.get(b, 0) + n / pieces
    assert max(held.values()) <= 10 and sorted(held) == list(range(len(held))) and found[4][1] == 3 and len(held) == 9


def test_a_query_goes_once_to_a_block_in_batches_of_bounded_size(spark, tmp_path, monkeypatch):
    """A batch of queries came out with a row, and a vector, for each cell that each probes: 88,000 rows here, gigabytes on a large table."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    index = vector_index.VectorIndex(spark, f"{tmp_path}/v")
    index.build(vectors)
    sizes, real = [], type(vectors).mapInArrow

    def sized(frame, run, schema, *more, **named):
        each = lambda batches: (text_index.pa.RecordBatch.from_arrays([text_index.pa.array([x.num_rows])], ["n"]) for x in run(batches))
        sizes.extend(r["n"] for r in real(frame, each, "n long").collect())
        return real(frame, run, schema, *more, **named)

    monkeypatch.setattr(type(vectors), "mapInArrow", sized)
    queries = vectors.withColumnRenamed("doc_id", "qid")
    found = index.search(queries, 3, probes=10**6)
    assert max(sizes) <= 16_384 and 2000 <= sum(sizes) <= 2000 * 8
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, channels.cosine_top_blocks(queries, vectors, 3).collect()))
    # the same where blocks are small, so that a cell lies in several
    monkeypatch.setattr(channels, "BLOCK", 8 * 64 * 20)
    monkeypatch.setattr(channels, "LEAST", 1)
    sizes.clear()
    again = index.search(queries.filter("qid < 100"), 3, probes=10**6)
    assert max(sizes) <= 20 and sorted(map(tuple, again.collect())) == sorted(map(tuple, found.filter("qid < 100").collect()))


def test_candidates_of_the_vector_index_for_any_number_of_queries(spark, sf_dir, monkeypatch):
    """The exact search beside it took 20,000 queries at most, so it failed on tables of more than 200,000 vectors."""
    monkeypatch.setattr(channels, "MOST_QUERIES", 10)
    found = search.vector_index_candidates(spark, sf_dir)
    assert found.agg(F.avg("recall")).first()[0] >= 0.9 and found.select("qid").distinct().count() == 50


# --- generations -------------------------------------------------------------------------------------------------
@pytest.fixture
def rows_table(spark, tmp_path):
    """A table of 40 rows in four files, and what opens a switch of it."""
    base = f"{tmp_path}/t"
    schema = "id long, x array<double>"
    frame = spark.createDataFrame([(i, [float(i), 1.0, float(i % 5)]) for i in range(40)], schema)
    versions.commit(frame.repartition(4), base)
    made = []

    def embed(rows):
        made.append(sorted(rows.inputFiles()))
        return rows.select("id", channels.renormalised(F.col("x"), 3).alias("vector"))

    return base, frame, made, lambda name="one": generations.Switch(spark, base, name, embed)


def begun(rows_table, generation="g1", name="one", **options):
    base, frame, _, opened = rows_table
    return opened(name).begin(generation, frame.schema, "id", 3, batch_bytes=1, **options)


def test_switch_restarts_after_every_phase(spark, rows_table, monkeypatch):
    """A kill before, within and after each batch, and between the switch and its entry: one table, and no batch twice."""
    base, _, made, opened = rows_table
    begun(rows_table)
    opened().step(), opened().step()
    made.clear()
    opened().step()
    claim = versions.Log.claim

    def killed(log, after, content):
        if content.get("batch") == 2:
            raise RuntimeError("killed")
        return claim(log, after, content)

    monkeypatch.setattr(versions.Log, "claim", killed)
    with pytest.raises(RuntimeError):  # the second batch is written, its entry isn't
        opened().step()
    monkeypatch.setattr(versions.Log, "claim", claim)
    while opened().now().content["phase"] != "committing":
        opened().step()
    assert len(made) == 5 and made[1] == made[2] and sorted({f for x in made for f in x}) == sorted(f for x in made[:1] + made[2:] for f in x)
    assert generations.active(spark, base) is None
    monkeypatch.setattr(generations.Switch, "_end", lambda self, at: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):  # switched, not yet said
        opened().step()
    monkeypatch.undo()
    assert opened().now().content["phase"] == "committing" and generations.active(spark, base)["generation"] == "g1"
    versions.commit(spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "id long, x array<double>"), base, after=0)  # after the switch: it stays
    assert opened().run() == "succeeded" and generations.active(spark, base)["generation"] == "g1"
    assert generations.vectors(spark, base).count() == 40


def test_switch_is_fenced(spark, rows_table):
    """A write at any phase before the switch aborts it and its files go; a rollback of rows counts as a write."""
    base, frame, _, opened = rows_table
    for n, phase in enumerate(("queued", "validating", "reindexing", "verifying", "committing")):
        own = begun(rows_table, name=phase)
        with pytest.raises(versions.Conflict):
            begun(rows_table, name="another")
        while own.now().content["phase"] != phase:
            own.step()
        if n % 2:
            versions.rollback(spark, base, 0)
        else:
            versions.commit(frame.repartition(4), base, after=versions.current_version(spark, base))
        assert opened(phase).run() == "failed" and own.now().content["code"] == "SOURCE_CHANGED"
        assert generations.active(spark, base) is None and not own.log.files.exists(f"{base}/{own._folder(own.now().content)}")


def test_switch_probes_and_previous(spark, rows_table):
    base, frame, _, opened = rows_table
    pair = lambda v, i: spark.createDataFrame([(0, v, i)], "qid long, vector array<double>, id long")
    assert begun(rows_table, name="a").run(pair([0.0, 1.0, 0.0], 39)) == "failed" and opened("a").now().content["code"] == "PROBE_FAILED"
    assert begun(rows_table, name="b").run(pair([0.0, 1.0, 0.0], 0)) == "succeeded"
    assert begun(rows_table, "g2", "c", keep_previous=False).run() == "succeeded"
    with pytest.raises(ValueError):
        generations.roll_back(spark, base)
    assert begun(rows_table, "g3", "d").run() == "succeeded" and generations.active(spark, base)["generation"] == "g3"
    generations.roll_back(spark, base)
    assert generations.active(spark, base)["generation"] == "g2" and generations.vectors(spark, base).count() == 40
    assert begun(rows_table, "g4", "e").run() == "succeeded"
    versions.commit(frame, base, after=0)
    with pytest.raises(ValueError):  # the rows are others now
        generations.roll_back(spark, base)
    assert begun(rows_table, "g5", "f").run() == "succeeded"


def test_switch_of_an_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([], "id long, x array<double>")
    versions.commit(frame, f"{tmp_path}/e")
    own = generations.Switch(spark, f"{tmp_path}/e", "s", lambda rows: rows.select("id", F.col("x").alias("vector")))
    assert own.begin("g1", frame.schema, "id", 3).run() == "failed" and own.now().content["code"] == "NO_ROWS"


def test_digest_of_rows(spark):
    rows = [(i % 7, None if i % 3 else f"t{i}") for i in range(50)]
    a, b, less = (spark.createDataFrame(x, "k long, t string") for x in (rows, rows[::-1], rows[:-1] + rows[:1]))
    assert generations.digest(a) == generations.digest(b.repartition(5)) != generations.digest(less)
