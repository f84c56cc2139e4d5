"""Substring dedup and the Jaccard join against brute force and SQL, with odd rows, hot groups and chunks."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyrook.llm import blocks, bottom_k, jaccard_join, registry, repeats, substring_dedup
from tallyrook.llm import components as components_of
from tallyrook.llm.words import SPACE as SPACES
from tallyrook.llm.words import rolled, sequence, split

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, class string, n_words string"
rng = np.random.default_rng(5)


def text(n, vocabulary=400):
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


def edited(base, edits):
    ws = base.split(" ")
    for i in rng.integers(0, len(ws), edits):
        ws[i] = f"x{rng.integers(0, 10**6)}"
    return " ".join(ws)


def corpus():
    base, passage = text(200), text(40)
    out = [None, "", " \n", "one", "One", "one two", "one two three four five", "ONE two three four five", "one", text(12), text(13)]
    out += [base, base, edited(base, 1), edited(base, 3), edited(base, 8), edited(base, 15), base + " tail end", base.upper()]
    out += [f"{text(30)} {passage} {text(20)}" for _ in range(12)] + [passage, passage + "\n" + passage]
    near = text(120)
    out += [edited(near, 2) for _ in range(40)]
    other = edited(near, 12)
    out += [edited(other, 2) for _ in range(25)]
    out += [text(n) for n in rng.integers(5, 60, 30)] + ["é ü x " * 30, "a" * 5000, "a b " * 400]
    return [(i * 3 % 977, t, "en", "s", 0, "clash", "clash", "clash") for i, t in enumerate(out)]


ROWS = corpus()


@pytest.fixture(autouse=True)
def small_parts(monkeypatch):
    monkeypatch.setattr(repeats, "PART_BYTES", 12_000)


def removed(rows):
    first = {}
    words = [SPACE.findall(t or "") for _, t in ((r[0], r[1]) for r in rows)]
    for (i, *_), ws in zip(rows, words, strict=True):
        for s in range(len(ws) - 12):
            key = tuple(ws[s : s + 13])
            first[key] = min(first.get(key, 10**9), i if i is not None else 10**9)
    out = []
    for (i, *_), ws in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(ws) - 12):
            if first[tuple(ws[s : s + 13])] < (i if i is not None else 10**9):
                gone |= set(range(s, s + 13))
        kept = " ".join(x for p, x in enumerate(ws) if p not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")


def components(rows, percent=75):
    sets = []
    for r in rows:
        ws = SPACE.findall(lower(r[1]))
        sets.append({tuple(ws[s : s + 5]) for s in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), 10**9), r[0])
    return sorted(((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(rows)), key=repr)


def test_repeats(spark):
    rows = [*ROWS, ROWS[11], (None, ROWS[12][1], *ROWS[12][2:])]
    assert sorted(map(tuple, substring_dedup.repeat_digests(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == removed(rows)


def test_repeats_keep_columns_and_clean_texts(spark):
    out = {r.doc_id: r for r in substring_dedup.drop_repeats(spark.createDataFrame(ROWS, SCHEMA).drop("part", "n_words")).collect()}
    gone = {i: n for i, _, n, _ in removed(ROWS)}
    for i, t, *_ in ROWS:
        assert out[i].lang == "en"
        assert gone[i] or out[i].text == t
        assert not gone[i] or (len(SPACE.findall(out[i].text)) == len(SPACE.findall(t)) - gone[i] and out[i].n_chars == len(out[i].text))


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.repeat_digests(none).count() == 0
    assert jaccard_join.similar_components(none).count() == 0
    assert jaccard_join.keep_one_of_each(none).count() == 0


@pytest.mark.parametrize("chunk", [6000, blocks.CHUNK])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(blocks, "CHUNK", chunk)
    rows = [*ROWS, ROWS[11], (None, ROWS[12][1], *ROWS[12][2:]), (None, "alone and without an id here", *ROWS[12][2:])]
    found = jaccard_join.similar_components(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, found.collect()), key=repr) == components(rows)


def test_one_of_each_stays(spark):
    rows = [*ROWS, ROWS[11]]
    kept = jaccard_join.keep_one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in components(rows)})


def test_one_of_each_stays_by_row(spark):
    """One id with unlinked texts, with a copy elsewhere, with a repeated row; and copies without an id."""
    one, two, three, four, five, six = (f"{k} " + text(30, 10**6) for k in "abcdef")
    given = [(7, one), (7, two), (7, two), (7, three), (3, three), (7, four), (8, four), (None, five), (None, five), (None, six), (9, six), (2, None), (2, None), (None, None), (None, "")]
    rows = [(i, t, "en", f"s{k}", k, "clash", "clash", "clash") for k, (i, t) in enumerate(given)]
    stay = [(7, one), (7, two), (3, three), (7, four), (None, five), (9, six), (2, None), (None, None), (None, "")]
    for order in (rows, rows[::-1]):
        kept = jaccard_join.keep_one_of_each(spark.createDataFrame(order, SCHEMA).repartition(3)).collect()
        assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(stay, key=repr)
        assert {r.source for r in kept if r.text in (two, five)} == {"s1", "s7"}


@pytest.mark.parametrize("chunk", [6000, blocks.CHUNK])
def test_near_copies(spark, monkeypatch, chunk):
    """Links at 0.85 of whole sets, of texts within a sketch and far beyond it."""
    monkeypatch.setattr(blocks, "CHUNK", chunk)
    long = text(900, 10**6)
    more = [(2000 + i, edited(long, int(k)), *ROWS[0][2:]) for i, k in enumerate(rng.integers(1, 40, 40))]
    rows = [*ROWS, ROWS[11], (None, ROWS[12][1], *ROWS[12][2:]), (None, "alone and without an id here", *ROWS[12][2:]), *more]
    found = bottom_k.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == components(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert bottom_k.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


#: Words that a polynomial modulo 2 ** 64 takes as equal.
ALIKE = ("cccxcxccxccccxxxccccccxccccxcxxxcxccxcccxxxccxxcccxcxcxccxxcccxc", "cxxcccxccxcccxxcccxxcccccxxcccxcccxccxcxcccccxcccxcxcccccxcccxxc")


def test_words_alike(spark):
    """Other words are other words, in operators and stages."""
    import corpus_pipeline

    tail = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"{x} {tail}", "en", "s", 0) for i, x in enumerate(ALIKE)] + [(i + 2, f"{x} a b c d", "en", "s", 0) for i, x in enumerate(ALIKE)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.n_removed for r in substring_dedup.repeat_digests(docs).collect()} == {0}
    few = docs.filter("doc_id > 1")
    for found in (jaccard_join.similar_components(few), bottom_k.near_copies(few)):
        assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(2, 2), (3, 3)]
    stages = dict(corpus_pipeline.STAGES)
    assert stages["near_copies"](spark, few, "").count() == 2
    assert sorted(r.text for r in stages["repeats"](spark, docs, "").collect()) == sorted(r.text for r in docs.collect())


def test_hashes_tell_words_apart():
    words = [bytes(rng.integers(97, 100, n, dtype=np.uint8)).decode() for n in rng.integers(1, 40, 20_000)] + [*ALIKE, "a", "a\x00", "é", "É", "a" * 15, "a" * 16]
    found = split(pa.array([" ".join(words[i::7]) for i in range(7)]), SPACES, lower=False)
    spelled = [found.text(i) for i in range(len(found.hash))]
    for hashes in (found.hash, found.other):
        assert len({*zip(spelled, hashes.tolist(), strict=True)}) == len({*hashes.tolist()}) == len({*spelled})
    runs = rolled(found.hash, 13)
    assert all(sequence(found.hash[i : i + 13]) == runs[i] for i in range(0, 1000, 97))


def test_classes_that_share_a_hash(spark, monkeypatch):
    """Sets whose first hashes are equal are of two classes, by the second."""
    plain = blocks.ShingleSets.classes
    monkeypatch.setattr(blocks.ShingleSets, "classes", lambda sets: (np.ones(len(sets.size), np.int64), plain(sets)[1]))
    rows = ROWS[:20]
    assert sorted(map(tuple, jaccard_join.similar_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == components(rows)


def chunk_of(sets, root, percent=75):
    begin = np.append(0, np.cumsum([len(x) for x in sets]))
    return blocks.Chunk(np.diff(begin), np.concatenate(sets), begin, root.copy(), percent)


def families(n, most=61):
    base = [rng.choice(2**40, 60, replace=False) for _ in range(3)]
    sets = []
    for _ in range(n):
        own = set(rng.permutation(base[rng.integers(0, 3)])[: rng.integers(45, most)].tolist())
        sets.append(np.array(sorted(own | set(rng.integers(0, 2**40, rng.integers(0, 12)).tolist()))))
    return sets


def alike(a, b, percent=75):
    return 100 * len(set(a.tolist()) & set(b.tolist())) >= percent * len(set(a.tolist()) | set(b.tolist()))


@pytest.mark.parametrize(("finder", "percent"), [(jaccard_join.CountTree, 75), (bottom_k.InvertedLists, 85)])
def test_search_loses_no_pair(finder, percent):
    for trial in range(6):
        sets = families(200)
        chunk = chunk_of(sets, np.sort(rng.integers(0, 5 if trial % 2 else 200, 200)), percent)
        index = finder(chunk)
        for _ in range(2):
            a, b = index.search(np.arange(200))
            found = set(zip(a.tolist(), b.tolist(), strict=True))
            assert all(chunk.root[i] != chunk.root[j] for i, j in found)
            for i, j in itertools.permutations(range(200), 2):
                assert chunk.root[i] == chunk.root[j] or not alike(sets[i], sets[j], percent) or (i, j) in found
            chunk.join(3, 150)
            index.updated()


@pytest.mark.parametrize(("finder", "percent"), [(jaccard_join.CountTree, 75), (bottom_k.InvertedLists, 85)])
def test_chunk_links_connect_what_links_connect(finder, percent):
    for trial in range(15):
        sets = families(150)
        root = np.arange(150) if trial % 2 else np.arange(150) // 2
        left = np.arange(150) < 75 if trial % 3 else np.ones(150, bool)
        right = ~left if trial % 3 else left
        got = blocks.chunk_links(chunk_of(sets, root, percent), left, right, finder)

        def roots(links):
            out = root.copy()
            for a, b in links:
                out[out == out[b]] = out[a]
            return [np.flatnonzero(out == out[i])[0] for i in range(150)]

        every = [(a, b) for a in np.flatnonzero(left).tolist() for b in np.flatnonzero(right).tolist() if a != b and alike(sets[a], sets[b], percent)]
        assert set(got) <= set(every) | {(b, a) for a, b in every} and len(got) < 150
        assert roots(got) == roots(every)


def test_no_two_sets_of_one_passage_are_estimated(monkeypatch):
    """Sets of which most is one passage share many retained values, but fewer than sets of their sizes that link: none comes to its sketch's union."""
    passage = rng.choice(2**62, 110, replace=False)
    sets = [np.sort(np.append(passage, rng.choice(2**62, 36, replace=False))) for _ in range(80)]
    index, met = bottom_k.InvertedLists(chunk_of(sets, np.arange(80), 85)), []
    monkeypatch.setattr(index, "alike", lambda x, others: met.append(len(others)) or np.ones(len(others), bool))
    assert len(index.search(np.arange(80))[0]) == 0 and sum(met) == 0


def test_retained_values_that_linked_sets_share():
    """Bounds hold for sets that just link, at any size, and the bound of one set for all sizes that it can link with."""
    for _ in range(400):
        common, more = int(rng.integers(1, 400)), int(rng.integers(0, 60))
        own = int(rng.integers(0, more + 1))
        values = rng.permutation(10**6)[: common + more]
        a, b = np.sort(values[: common + own]), np.sort(np.append(values[:common], values[common + own :]))
        if 100 * common >= 85 * (common + more):
            shared = len(np.intersect1d(a[: bottom_k.K], b[: bottom_k.K]))
            assert shared >= bottom_k.surely_shared(np.int64(len(a)), np.int64(len(b)))
    for n in range(1, 700):
        every = np.arange(-(-85 * n // 100), 100 * n // 85 + 1)
        bound = bottom_k.surely_shared(np.full(len(every), n), every).min()
        old = -(-(85 if 100 * n <= 85 * bottom_k.K else bottom_k.NEEDED) * min(n, bottom_k.K) // 100)
        assert bottom_k.least_shared(np.array([n]))[0] == max(bound, old)


def test_only_sides_that_ask_meet():
    """Of two sides, sets of one side don't search each other, and the smaller side asks."""
    sets, asked = families(150), []

    class Finder(bottom_k.InvertedLists):
        def search(self, asking):
            a, b = super().search(asking)
            asked.extend(asking.tolist())
            assert not (left[a] & left[b]).any() and not (right[a] & right[b]).any()
            return a, b

    left = np.arange(150) % 10 == 0
    right = ~left
    blocks.chunk_links(chunk_of(sets, np.arange(150), 85), left, right, Finder)
    assert len(asked) <= 16


def test_components_that_are_stars_need_no_round(spark, monkeypatch):
    rounds, plain = [], components_of._star
    monkeypatch.setattr(components_of, "_star", lambda *args, **named: rounds.append(1) or plain(*args, **named))
    links = blocks.stars([(9, 4), (4, 7), (7, 2), (30, 31), (5, 5)])
    assert sorted(links) == [(4, 2), (7, 2), (9, 2), (31, 30)]
    found = components_of.connected_components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(2, 2), (4, 2), (7, 2), (9, 2), (30, 30), (31, 30)] and not rounds
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(None, 3)], "a long, b long")
    assert {(r.label) for r in components_of.connected_components(chain).collect()} == {0} and rounds


def test_union_sketch_estimates():
    """Sketches of large sets: of their union's least K values, the share that both have."""
    values = rng.choice(2**62, 4000, replace=False)
    sets = [np.sort(values[:2000]), np.sort(np.append(values[:1500], values[2000:2500])), np.sort(values[1900:3900])]
    index = bottom_k.InvertedLists(chunk_of(sets, np.arange(3), 85))
    for x, y in itertools.permutations(range(3), 2):
        union = sorted({*sets[x].tolist(), *sets[y].tolist()})[: bottom_k.K]
        share = sum(v in sets[x] and v in sets[y] for v in union)
        assert index.alike(x, np.array([y])).tolist() == [100 * share >= bottom_k.NEEDED * bottom_k.K]


@pytest.mark.parametrize("name", ["op6_jaccard_join", "op7_substring_dedup", "op11_minhash_dedup"])
def test_sql(spark, sf_dir, oracle, name):
    found = registry.QUERIES[name](spark, sf_dir)
    assert sorted(map(tuple, found.collect()), key=repr) == oracle(registry.ORACLE_SQL[name], sf_dir, found.columns)


def test_packing():
    for kind in (np.uint32, np.uint64):
        values = np.sort(rng.integers(0, np.iinfo(kind).max, 1000, dtype=kind))
        assert (repeats.unpacked(repeats.packed(values), kind) == values).all()
    assert len(repeats.unpacked(repeats.packed(np.zeros(0, np.uint32)), np.uint32)) == 0
