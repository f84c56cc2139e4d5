"""Rules on literal rows, and what SQL does not check."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrook import jobs
from tallyrook.functions import ids, lifecycle, safety, text
from tallyrook.jobs.exchange import fit_units
from tallyrook.operators import candidates, channels, graph, metrics, ranking, store
from tallyrook.schemas import DAY_MS
from tallyrook.sources import files


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def test_chunks():
    fence = "```\na\n\nb\n```"
    assert text._pack(fence, 100) == [fence]
    assert text._pack("a\n\n\nb\n \nc", 100) == ["a\n\nb\n\nc"]
    assert text._pack("aaaa\n\nbbbb\n\ncc", 8) == ["aaaa", "bbbb\n\ncc"]
    assert text._pack("one two three " + "x" * 12 + " four", 8) == ["one two", "three", "x" * 8, "x" * 4, "four"]
    assert text._pack("", 10) == [] and text._pack(" \n \n", 10) == []


def test_html():
    page = "<html><head><title>t</title></head><body><h1>A &amp; B</h1><script>x()</script><p>one <b>two</b></p><p>three<br>four</p></body></html>"
    assert text._plain(page) == "A & B\none two\nthree\nfour"
    assert text._plain(None) == ""


def test_texts(spark):
    got = one(
        spark,
        name=text.normal_name(F.lit("  ﬁne  ＡＢＣ  x ")),
        title=text.title(F.lit("\n  \n  first line  \nsecond")),
        none=text.title(F.lit(" \n")),
        cut=text.truncate(F.lit("x" * 50), 40),
        tokens=text.tokens(F.lit("A bc, bc Éé d1!")),
    )
    assert got == {"name": "fine abc x", "title": "first line", "none": "Memory", "cut": "x" * 24 + "\n...[truncated]", "tokens": ["bc", "éé", "d1"]}


def test_identities(spark):
    f = lambda key, content: ids.fingerprint(F.lit("fact"), F.lit("session"), F.lit(key), F.lit(content))
    got = one(spark, a=f("s", "one  two"), b=f("s", " one\ttwo "), c=f("t", "one two"), d=ids.memory_id(F.lit("fact"), F.lit("project"), F.lit(None).cast("string"), F.lit("x")))
    assert got["a"] == got["b"] != got["c"] and got["d"].startswith("mem_") and len(got["d"]) == 36


def test_lifecycle(spark):
    now = 1000 * DAY_MS
    past = F.lit(now - 365 * DAY_MS)
    got = one(
        spark,
        pinned=lifecycle.retention(F.lit(True), F.lit("fact"), past, now),
        half=lifecycle.retention(F.lit(False), F.lit("preference"), past, now),
        kept=lifecycle.expired(F.lit(True), past, now),
        gone=lifecycle.expired(F.lit(False), F.lit(now), now),
        few=lifecycle.feedback_factor(F.lit(2), F.lit(2), F.lit(0), F.lit(0)),
        bad=lifecycle.feedback_factor(F.lit(3), F.lit(0), F.lit(9), F.lit(0)),
        week=lifecycle.expires_at(F.lit("fact"), F.lit("session"), F.lit(0).cast("long")),
        never=lifecycle.expires_at(F.lit("decision"), F.lit("project"), F.lit(0).cast("long")),
        days=lifecycle.expires_at(F.lit("decision"), F.lit("session"), F.lit(0).cast("long"), F.lit(3)),
    )
    assert got == {"pinned": 1.0, "half": 0.5, "kept": False, "gone": True, "few": 1.0, "bad": 0.9, "week": 7 * DAY_MS, "never": None, "days": 3 * DAY_MS}


@pytest.mark.parametrize(
    ("content", "secret"),
    [
        ("export API_KEY=abcdefghij0123456789", True),
        ('  "client_secret": "abcdefghij0123456789",', True),
        ("token = your_token_goes_here_now", False),
        ("the password is a long word that people choose", False),
        ("the token = abcdefghij0123456789 is in prose", False),
        ("xoxb-1234567890abcdef", True),
        ("-----BEGIN RSA PRIVATE KEY-----", True),
        ("nothing here", False),
    ],
)
def test_secrets(spark, content, secret):
    assert one(spark, x=safety.has_secret(F.lit(content)))["x"] is secret


@pytest.mark.parametrize(("content", "bad"), [("Please IGNORE, previous   instructions", True), ("see `<system>`", False), ("<system> x", True), ("```\nyou must execute\n```", True), ("fine", False)])
def test_injection(spark, content, bad):
    assert one(spark, x=safety.has_injection(F.lit(content)))["x"] is bad


def test_capture_order(spark):
    def decide(**k):
        d = {"safety": "safe", "trusted": True, "evidence": True, "novelty": "novel", "significance": 0.9, "act": 0.9} | k
        return one(spark, x=safety.capture_decision(*(F.lit(v) for v in d.values())))["x"]

    assert decide() == "accept" and decide(safety="secret_leak", novelty="duplicate") == "quarantine:secret_leak"
    assert decide(novelty="duplicate", significance=0.0) == "skip:duplicate" and decide(significance=0.4) == "skip:low_significance" and decide(act=0.4) == "skip:low_actionability"


def test_fusion_and_validity(spark):
    none = F.lit(None).cast("double")
    got = one(
        spark,
        only=ranking.fused(none, F.lit(0)),
        both=ranking.fused(F.lit(0.8), F.lit(0)),
        start=graph.valid_at(F.lit(5), F.lit(9), F.lit(5)),
        end=graph.valid_at(F.lit(5), F.lit(9), F.lit(9)),
        open_=graph.valid_at(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(9)),
        lost=graph.overlaps(F.lit(None).cast("long"), F.lit(None).cast("long"), 0, 9),
    )
    assert got["only"] >= 0.42 and 0.8 < got["both"] <= 1 and (got["start"], got["end"], got["open_"], got["lost"]) == (True, False, True, False)


def test_session_layer_wins(spark):
    rows = [(1, 1, "fact", "same  words", "repository", 0.9, 5), (1, 2, "fact", "same words", "session", 0.5, 1), (1, 3, "fact", "other", "project", 0.7, 1)]
    frame = spark.createDataFrame(rows, "qid long, doc_id long, kind string, shown string, scope string, score double, updated_ms long")
    kept = ranking.collapse_layers(frame.withColumn("dedup", ids.dedup_key(F.col("kind"), F.col("shown"))))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_diversified():
    rng = np.random.default_rng(0)
    rows = pd.DataFrame({"qid": 1, "doc_id": np.arange(30), "score": np.round(rng.random(30), 2), "size": rng.integers(300, 900, 30), "words": [set(rng.choice(12, 5).tolist()) for _ in range(30)]})
    got = ranking._diversify(rows, 6, 3000)
    chosen, spent, left = [], 0, list(range(30))
    like = lambda a, b: len(rows.words[a] & rows.words[b]) / len(rows.words[a] | rows.words[b])
    while left and len(chosen) < 6:
        i = min(left, key=lambda i: (-round(0.75 * rows.score[i] - 0.25 * max((like(i, j) for j in chosen), default=0), 12), -rows.score[i], i))
        left.remove(i)
        if spent + rows["size"][i] <= 3000:
            chosen.append(i)
            spent += rows["size"][i]
    assert got.doc_id.tolist() == chosen and got.place.tolist() == list(range(len(chosen)))


def test_metrics(spark):
    # query 1 has two relevant records, one of them of grade 2; query 2 has one
    asked = spark.createDataFrame([(1, True, 2, 1), (2, True, 1, 0), (3, False, 0, 0)], "qid long, answerable boolean, relevant long, high long")
    schema = "mode string, qid long, doc_id long, place int, grade int"
    perfect, nothing = [("a", 1, 10, 0, 2), ("a", 1, 11, 1, 1), ("a", 2, 20, 0, 1)], [("b", 3, 1, 0, None)]
    found = {r["mode"]: r for r in metrics.summary(metrics.per_query(spark.createDataFrame(perfect + nothing, schema), asked, ("a", "b"))).collect()}
    a, b = found["a"], found["b"]
    assert (a.mrr_10, a.ndcg_10, a.recall_10, a.false_abstention, a.specificity) == (1, 1, 1, 0, 1)
    assert (b.mrr_10, b.ndcg_10, b.precision_1, b.false_abstention, b.specificity) == (0, 0, 0, 1, 0)


def test_chains_and_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (10, 11), (11, 12), (12, 10)], "node long, next long")
    got = {r.node: (r.head, r.steps) for r in store.chain_heads(links).collect()}
    assert {k: got[k] for k in (1, 2, 3, 7)} == {1: (4, 3), 2: (4, 2), 3: (4, 1), 7: (8, 1)}
    assert all(got[k] == (None, None) for k in (10, 11, 12))


def test_diff(spark):
    known = spark.createDataFrame([("a", "1", True), ("b", "1", False), ("c", "1", True), ("d", "1", True)], "path string, digest string, alive boolean")
    found = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("e", "1")], "path string, digest string")
    assert dict(map(tuple, store.index_diff(known, found).collect())) == {"a": "unchanged", "b": "updated", "c": "updated", "d": "removed", "e": "added"}
    assert dict(map(tuple, store.index_diff(known, found, complete=False).collect()))["d"] == "kept"


def test_bounded_search(spark):
    relations = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "d"), (4, "a", "e")], "relation long, subject string, object string")
    seeds = spark.createDataFrame([(1, "a", 1.0)], "qid int, entity string, score double")
    got = {r.entity: (r.level, r.score) for r in graph.bounded_search(seeds, relations).collect()}
    assert got == {"a": (0, 1.0), "b": (1, 0.05), "e": (1, 0.05), "c": (2, 0.033333333)}
    assert {r.entity for r in graph.bounded_search(seeds, relations, fanout=1).collect()} == {"a", "b"}


def test_stream_counts_each_event_once(spark, sf_dir, oracle):
    found = jobs.QUERIES["feedback_stream"](spark, sf_dir)
    sql = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"
    rows, expect = sorted(map(tuple, found.collect())), oracle(sql, sf_dir, found.columns)
    assert [r[:3] for r in rows] == [e[:3] for e in expect] and all(abs(r[3] - e[3]) < 1e-3 for r, e in zip(rows, expect, strict=True))


def test_extraction_units():
    rows = pd.DataFrame({"conv_id": 1, "turn": [2, 0, 1, 3, 4], "role": "user", "text": ["é" * 600, "a" * 1200, " ", "b" * 600, "c" * 500]})
    got = list(map(tuple, fit_units(rows).itertuples(index=False)))
    assert got == [(1, 0, 1000, None), (1, 1, 0, "empty"), (1, 2, 1000, None), (1, 3, 0, "budget"), (1, 4, 500, None)]


def test_extraction_takes_whole_turns(spark, tmp_path):
    texts = {0: "é" * 700, 1: "a" * 2078, 2: "b" * 40_000, **{turn: "c" * 30_000 for turn in range(3, 11)}, 11: "d" * 5000, 12: " ", 13: None}
    rows = [(conv, turn, "user", text) for turn, text in reversed(texts.items()) for conv in (1, 2)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, jobs.QUERIES["extraction_units"](spark, str(tmp_path)).collect()))
    taken = {0: 1400, 1: 2078, 2: 32_768, **{turn: 30_000 for turn in range(3, 10)}}
    left = 262_144 - sum(taken.values())
    rest = {10: "budget", 11: None, 12: "empty", 13: "empty"}
    assert 5000 <= left < 30_000
    assert got == [(conv, turn, taken.get(turn, 5000 if turn == 11 else 0), rest.get(turn)) for conv in (1, 2) for turn in texts]


def test_unicode_space_and_line_ends(spark):
    got = one(spark, a=text.collapse(F.lit("a\u3000\u00a0b")), t=text.title(F.lit("\u3000\n\u00a0x y\u2003")))
    assert got == {"a": "a b", "t": "x y"}
    assert text._pack("a\r\nb\r\n\r\nc", 100) == ["a\nb\n\nc"]


def test_whole_query_inside_longer_words(spark):
    """A query that a record contains scores 1, even where its first and last word are parts of longer ones."""
    asked = spark.createDataFrame([(1, "oo bar ba"), (2, "none of this"), (3, "b1")], "qid long, text string")
    rows = spark.createDataFrame([(10, "T", ["x"], "foo bar baz"), (11, "T", ["x"], "this is it"), (12, "T", ["x"], "ab12")], "doc_id long, title string, tags array<string>, content string")
    found = rows.select("doc_id", F.explode(text.tokens(F.concat_ws(" ", "title", "content"))).alias("token"))
    pairs = asked.select("qid").crossJoin(rows.select("doc_id"))
    got = {(r.qid, r.doc_id): r.lexical for r in ranking.lexical_scores(pairs, asked, found, rows).collect()}
    assert got[1, 10] == 1.0 and got[3, 12] == 1.0 and got[3, 10] == 0.0 and abs(got[2, 11] - 1 / 3) < 1e-12


def test_inverted_time_filters_are_errors():
    for kind in ("valid", "extracted", "occurred"):
        with pytest.raises(ValueError):
            graph.TimeFilter(**{f"{kind}_after": 2, f"{kind}_before": 1})


def test_too_many_queries_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(channels, "MOST_QUERIES", 1)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid long, vector array<double>")
    with pytest.raises(ValueError):
        channels.cosine_top(v, v.withColumnRenamed("qid", "doc_id"), 5)


def test_changed_files_are_an_error(spark, tmp_path):
    files.write_lines(spark.createDataFrame([(1, "a")], "item_id long, text string"), f"{tmp_path}/a")
    other = spark.createDataFrame([("part-0.json", "00")], "name string, sha256 string")
    with pytest.raises(ValueError):
        files.read_lines(spark, f"{tmp_path}/a", "item_id long, text string", other, "item_id")


def test_semantic_score_and_scopes(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    got = one(
        spark,
        same=graph.semantic(v(1.0, 0.0), v(1.0, 0.0), F.lit("g"), F.lit("g")),
        other=graph.semantic(v(1.0, 0.0), v(1.0, 0.0), F.lit("g"), F.lit("h")),
        size=graph.semantic(v(1.0, 0.0), v(1.0), F.lit("g"), F.lit("g")),
    )
    assert got == {"same": 1.0, "other": 0.0, "size": 0.0}
    rows = spark.createDataFrame([("session", "s1"), ("session", "s2"), ("project", None)], "scope string, scope_key string")
    count = lambda *x: rows.filter(graph.scope_matches(*x)).count()
    assert (count(None, None), count("session", None), count("session", "s1"), count(None, "")) == (3, 2, 1, 1)


def test_updates_merge_rows(spark):
    """Revisions, successors with back-links, locks, the first of two requests, and identities that are there already."""
    from tallyrook.functions import ids
    from tallyrook.operators import records

    F = records.F
    kinds = "kind string, scope string, scope_key string, content string, title string, importance double, tags array<string>, created_ms long, updated_ms long, pinned boolean, locked boolean, lock_reason string, superseded_by string, supersedes array<string>"
    row = lambda content, scope="project", locked=False: ("fact", scope, None, content, "t", 0.5, ["x"], 1, 10, False, locked, None, None, [])
    held = spark.createDataFrame([row("one"), row("two"), row("three", locked=True), row("four", "repository")], kinds)
    held = held.withColumn("id", ids.memory_id(F.col("kind"), F.col("scope"), F.col("scope_key"), F.col("content")))
    of = {r.content: r.id for r in held.collect()}
    ask = lambda n, who, revision=10, action=None, reason=None, content=None, importance=None, pinned=None: (n, of.get(who, "mem_none"), revision, action, reason, content, None, None, importance, None, pinned)
    requests = [ask(1, "one", content="one more"), ask(2, "one", importance=0.9), ask(3, "two", revision=9), ask(4, "two", None, importance=0.7), ask(5, "three", content="x"), ask(6, "four"), ask(7, "gone"), ask(8, "three", action="unlock")]
    named = spark.createDataFrame(requests, "request long, id string, revision long, action string, reason string, content string, title string, kind string, importance double, tags array<string>, pinned boolean")
    dead = spark.createDataFrame([], "fingerprint string")
    outcomes, table = records.updated(named, held, dead, 99)
    assert {r.request: r.outcome for r in outcomes.collect()} == {1: "superseded_by_new", 2: "conflict", 3: "conflict", 4: "in_place", 5: "locked", 6: "repository_managed", 7: "not_found", 8: "in_place"}
    after = {r.content: r for r in table.collect()}
    assert len(after) == 5 and after["one"].superseded_by == after["one more"].id and after["one"].updated_ms == 99
    assert (after["one more"].supersedes, after["one more"].created_ms, after["one more"].tags) == ([of["one"]], 1, ["x"])
    assert (after["two"].importance, after["two"].updated_ms, after["three"].locked, after["four"].updated_ms) == (0.7, 99, False, 10)
    taken = records.updated(spark.createDataFrame([ask(1, "one", content="two")], named.schema), held, dead, 99)[0].first()
    assert taken.outcome == "exists"
    gone = held.filter("content = 'one'").select(ids.fingerprint(F.col("kind"), F.col("scope"), F.col("scope_key"), F.lit("again")).alias("fingerprint"))
    assert records.updated(spark.createDataFrame([ask(1, "one", content="again")], named.schema), held, gone, 99)[0].first().outcome == "tombstoned"


def test_graph_seeds_by_vectors(spark):
    """A seed by vector alone; another generation or dimension counts for nothing; words keep the greater score; ties go to the least number."""
    entities = spark.createDataFrame([(e, n, "thing", []) for e, n in (("a", "alpha"), ("b", "beta"), ("c", "gamma"), ("d", "delta"), ("e", "eps"), ("f", "zeta"))], "entity string, name string, type string, aliases array<string>")
    relations = spark.createDataFrame([("r", "a", "uses", "d")], "relation string, subject string, predicate string, object string")
    queries = spark.createDataFrame([(1, "alpha"), (2, "nothing else")], "qid int, text string")
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "qid int, vector array<double>")
    held = [("a", 9, [1.0, 0.0], "g2"), ("b", 2, [1.0, 0.0], "g2"), ("c", 3, [1.0, 0.0], "g1"), ("d", 4, [1.0, 0.0, 0.0], "g2"), ("e", 1, [0.6, 0.8], "g2"), ("gone", 0, [1.0, 0.0], "g2")]
    vectors = spark.createDataFrame(held, "entity string, number long, vector array<double>, generation string")
    meaning = graph.Meaning(asked, vectors, "g2")
    found = {(r.qid, r.entity): r.score for r in graph.seeds(queries, entities, relations, meaning).collect()}
    assert found == {(1, "a"): 1.0, (1, "b"): 0.5, (1, "e"): 0.9, (2, "a"): 1.0, (2, "b"): 1.0, (2, "e"): 0.8, (3, "e"): 0.2}
    top = {(r.qid, r.entity) for r in graph.near(meaning, entities, 1).collect()}
    assert top == {(1, "e"), (2, "b"), (3, "e")}
    assert graph.near(graph.Meaning(asked, vectors, ""), entities).isEmpty() and graph.near(graph.Meaning(asked.limit(0), vectors, "g2"), entities).isEmpty()


def test_candidates_are_parsed_strictly(spark):
    """A code for each refusal; repeated keys at any depth, constants that JSON lacks and what follows the array are refused."""
    import json

    good = {"title": "t", "content": "c", "kind": "pattern", "importance": 0.5, "tags": ["x"], "code_paths": []}
    of = lambda **more: {k: v for k, v in (good | more).items() if v is not ...}
    user = {"taxonomy": "user_goal", "kind": "fact", "evidence_quote": "  I want  it "}
    cases = [
        (good, None), (of(extra=1), "unknown_key"), ([], "not_object"), (None, "not_object"), (of(taxonomy="nothing"), "taxonomy"), (of(taxonomy=None), "taxonomy"), (of(taxonomy="code_style"), None),
        (of(kind="summary"), "kind"), (of(kind=..., importance=9), "kind"), (of(kind=["fact"]), "kind"), (of(taxonomy="user_goal"), "kind"), (of(**user), None), (of(**user | {"evidence_quote": "ab"}), "evidence"),
        (of(**user | {"evidence_quote": "x" * 501}), "evidence"), (of(**user | {"evidence_quote": 3}), "evidence"), (of(title=""), "title"), (of(title="\U0001f600" * 81), "title"), (of(title="\U0001f600" * 80), None),
        (of(content="x" * 6001), "content"), (of(importance=True), "importance"), (of(importance=0.61), "importance"), (of(importance=-1), "importance"), (of(importance="0"), "importance"), (of(tags=[""]), "tags"),
        (of(tags=["x"] * 13), "tags"), (of(tags="x"), "tags"), (of(code_paths=["x" * 513]), "code_paths"), (of(code_paths=...), "code_paths"), (of(kind="fact"), "no_anchor"), (of(kind="fact", code_paths=["a"]), None),
    ]
    whole = lambda x: f"said {candidates.OPEN}\ufeff {x} \n{candidates.CLOSE} {candidates.CLOSE}"
    texts = [whole(json.dumps([x for x, _ in cases])), whole('[{"title": "a", "title": "b"}, {"tags": [{"a": 1, "a": 1}]}]'), whole("[NaN]"), whole("[1,]"), whole("[] []"), whole("{}"), whole("[" * 100_000), candidates.OPEN + "[]", "nothing", None, ""]
    texts += [candidates.OPEN + "junk" + candidates.CLOSE + whole("[]"), whole(json.dumps([good | {"title": "\ud800x"}]))]
    found = candidates.parsed(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ["id"]).collect()
    by = lambda i: [(r.n, r.code) for r in sorted(found, key=lambda r: (r.id, r.n or 0)) if r.id == i]
    assert by(0) == [(n, code) for n, (_, code) in enumerate(cases)]
    assert by(1) == [(0, "repeated_key"), (1, "repeated_key")]
    assert [by(i) for i in range(2, 11)] == [[(None, "not_json")]] * 3 + [[(None, "not_array")], [(None, "not_json")], [(None, "unclosed")], [], [], []]
    assert by(11) == [] and by(12) == [(0, None)] and next(r for r in found if r.id == 12).title == "\ufffdx"
    assert next(r for r in found if r.quote).quote == "I want it"


def test_first_three_candidates_and_evidence(spark):
    held = [(1, n, None, None) for n in range(2)] + [(1, 2, "title", None), (1, 3, None, "not said"), (1, 4, None, "he said"), (1, 5, None, None)]
    found = spark.createDataFrame(held, "id int, n int, code string, quote string").withColumn("who", F.lit(7))
    said = spark.createDataFrame([(7, "what  he\tsaid"), (8, "not said"), (7, None)], "who int, text string")
    got = {r.n: (r.code, r.accepted) for r in candidates.judged(found, said, ["id"], "who").collect()}
    assert got == {0: (None, True), 1: (None, True), 2: ("title", False), 3: ("evidence", False), 4: (None, True), 5: ("beyond", False)}
    assert candidates.judged(found.limit(0), said, ["id"], "who").isEmpty()


def test_quotes_in_texts_of_a_hot_group(spark, monkeypatch):
    """Many quotes and texts of one group, in several tasks, against brute force; nulls, empty texts and other groups."""
    monkeypatch.setattr(candidates, "QUOTES", 7)
    monkeypatch.setattr(candidates, "TEXTS", 11)
    rng = np.random.default_rng(5)
    word = lambda n: "".join("ab c"[i] for i in rng.integers(0, 4, n))
    quotes = [(int(g), word(int(n))) for g, n in zip(rng.integers(0, 3, 120) // 2, rng.integers(1, 7, 120), strict=True)] + [(0, ""), (0, None), (None, "a"), (5, "a"), (0, "\U0001f600 é")]
    texts = [(int(g), i, word(30)) for i, g in enumerate(rng.integers(0, 3, 90) // 2)] * 2 + [(0, 900, None), (0, 901, ""), (6, 902, "a"), (None, 903, "a"), (0, 904, "x\U0001f600 éa")]
    got = {tuple(r) for r in candidates.quoted(spark.createDataFrame(quotes, "g int, quote string"), spark.createDataFrame(texts, "g int, k int, text string"), "g", ("k",)).collect()}
    assert got == {(g, q) for g, q in quotes if q and g is not None and any(h == g and t and q in t for h, _, t in texts)}
    assert 20 < len(got) < len(set(quotes))
