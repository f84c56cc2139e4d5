"""Bag search and periodic runs against brute force and SQL, with odd rows, ties, copies and long texts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyrook.llm import bag_search, periodic_runs, registry

TERM, SPACE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, rank int, score long, hash string, bag string, m string, least string, item string, n long"
rng = np.random.default_rng(11)


def rows(pairs):
    return [(i, t, 0, 0, "h", "b", "m", "l", "i", 0) for i, t in pairs]


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")


def ranked(docs, items):
    bags = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    documents, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in items:
        asked, scored = Counter(TERM.findall(lower(text))), []
        for i, b, n in bags:
            m = 75 + 25 * n * documents // length
            score = sum(k * weight[t] * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, k in asked.items() if t in b)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:20])]
    return sorted(out, key=repr)


def corpus():
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, n) % 60) for n in rng.integers(1, 60, 150)]
    texts += ["W1 w2, w3", "w3-W2 w1", "w1 w2 w3 other", "w1 w2 w3 again"] * 15 + [None, "", " .,!", "é É ü", "w1 " * 30_000, "x" * 5000]
    return [(int(i), t) for i, t in zip(rng.permutation(10 * len(texts))[: len(texts)], texts, strict=True)]


DOCS = corpus()
ITEMS = [(5, "w1 w2 w3"), (1, "W1 w1 w9 unknown w20"), (2, None), (3, "..."), (4, "é w4 w5 w6 w7"), (9, "nowhere"), (8, " ".join(f"w{k}" for k in range(60)))]


@pytest.mark.parametrize("most", [4, bag_search.VOCABULARY])
def test_ranked(spark, monkeypatch, most):
    """Ties by id, copies and a class of more than DEPTH members, repeated rows, a null id, blocks of items and of classes."""
    monkeypatch.setattr(bag_search.item_terms, "__defaults__", (most,))
    monkeypatch.setattr(bag_search, "CLASSES", 16)
    docs = [*DOCS, DOCS[0], (None, "w1 w2 w3 w9 w20"), (3, "w1 w2 w3")]
    found = bag_search.ranked(spark.createDataFrame(rows(docs), SCHEMA).repartition(5), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == ranked(docs, ITEMS)


def test_copies_are_scored_once(spark, monkeypatch):
    """A thousand copies are one class: its least ids come first."""
    docs = [(k, "w1 w2 w3") for k in range(1000, 0, -1)] + DOCS
    held = bag_search.vectors(spark.createDataFrame(rows(docs), SCHEMA), [b"w1", b"w2", b"w3"])
    assert held.filter("n = 3").select("bag").distinct().count() < 10
    found = bag_search.ranked(spark.createDataFrame(rows(docs), SCHEMA), spark.createDataFrame(ITEMS[:1], "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == ranked(docs, ITEMS[:1])


def test_nothing_to_rank(spark):
    docs, items = spark.createDataFrame(rows(DOCS[:3]), SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert bag_search.ranked(docs.limit(0), items).count() == 0
    assert bag_search.ranked(docs, items.limit(0)).count() == 0
    assert bag_search.ranked(spark.createDataFrame(rows([(1, None), (2, "...")]), SCHEMA), items).count() == 0


# --- runs ----------------------------------------------------------------------------------------------------------
def runs(ws):
    out, n = {}, len(ws)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def planted(doc_id, ws):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not ws:
        return ws
    g, n = h // 10, len(ws)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i if i < a else a + (i - a) % p] for i in range(n)]


def digests(doc_id, text):
    ws = planted(doc_id, SPACE.findall(text or ""))
    found = runs(ws)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in found), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *longest, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(ws) if i not in gone)))


def periodic():
    word = lambda k: [f"w{x}" for x in rng.integers(0, k, rng.integers(1, 12))]
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "é \u00a0 " * 9, "x" * 5000 + " y" * 7]
    for _ in range(150):
        unit = word(int(rng.integers(1, 9)))
        ws = word(30) + unit * int(rng.integers(1, 8)) + unit[: rng.integers(0, len(unit) + 1)] + word(30)
        texts.append(" ".join((ws * 5 + word(4)) * int(rng.integers(1, 6)) if rng.random() < 0.3 else ws))
    texts += [" ".join(rng.choice(["a", "b"], 300)), " ".join(word(400) * 300)]
    return list(enumerate(texts))


def test_runs(spark):
    docs = [*periodic(), (None, "a b " * 8), (4, "a a a a a a"), (4, "a a a a a a")]
    found = periodic_runs.run_digests(spark.createDataFrame(rows(docs), SCHEMA))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((digests(*x) for x in docs), key=repr)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def numbers(texts):
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    return periodic_runs._numbered(np.concatenate([*map(np.array, texts), []]).astype(np.int64) + 1000 * row), row


def test_runs_of_many_small_texts():
    for _ in range(400):
        texts = []
        for kind in rng.integers(0, 4, rng.integers(1, 6)):
            own, k = rng.integers(0, 4, rng.integers(1, 60)).tolist(), int(rng.integers(1, 8))
            texts.append([own, own[:10] + own[:k] * 6 + own[:3], (own[:2] * k + own[2:4]) * k, [0] * len(own) + own[:4]][kind])
        ids, row = numbers(texts)
        first = np.append(0, np.cumsum([len(x) for x in texts]))
        s, e, q = periodic_runs.runs_of(ids, row)
        may = periodic_runs.may_repeat(ids, row, len(texts))
        for i, x in enumerate(texts):
            own = (s >= first[i]) & (s < first[i + 1])
            assert sorted(zip((s[own] - first[i]).tolist(), (e - s)[own].tolist(), q[own].tolist(), strict=True)) == runs(x)
            assert may[i] or not runs(x)


def test_grammar_derives_the_text():
    """Every node is two nodes or words, and nodes of one symbol derive one text, each pair of which has one symbol."""
    ids, row = numbers([rng.integers(0, 3, 200).tolist(), [0, 1, 2] * 60, [5] * 33])
    g = periodic_runs.Grammar(ids, row)
    derived = {}
    for name, a, m, b in zip(g.symbols.tolist(), g.start.tolist(), g.middle.tolist(), g.end.tolist(), strict=True):
        assert a < m < b and row[a] == row[b - 1]
        assert derived.setdefault(name, ids[a:b].tolist()) == ids[a:b].tolist()
    whole = {(a, b) for a, b in zip(g.start.tolist(), g.end.tolist(), strict=True)}
    assert {(0, 200), (200, 380), (380, 413)} <= whole
    assert all(b - a == 1 or (a, b) in whole for x, m, y in zip(g.start.tolist(), g.middle.tolist(), g.end.tolist(), strict=True) for a, b in ((x, m), (m, y)))
    assert len({*g.symbols.tolist()}) < 300


def test_long_texts_end():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 30_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    long = rng.integers(0, 1000, 5000).tolist()
    for text, many in (([0] * 40_000, 1), (fibonacci[-1], 0), (long * 8, 1), (long * 3, 0), ([0, 0, 1] * 10_000, 1)):
        ids, row = numbers([text])
        assert len(periodic_runs.runs_of(ids, row)[0]) == many


@pytest.mark.parametrize("name", ["op12_bag_search", "op13_periodic_runs"])
def test_sql(spark, sf_dir, oracle, name):
    found = registry.QUERIES[name](spark, sf_dir)
    assert sorted(map(tuple, found.collect()), key=repr) == oracle(registry.ORACLE_SQL[name], sf_dir, found.columns)
