"""What must not change, or not grow, with the size of a table."""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from tallyrook.functions import canonical, text
from tallyrook.jobs import search, writes
from tallyrook.operators import channels, extraction, graph, store
from tallyrook.sources import graph as held
from tallyrook.sources import tables, text_index


def test_digest_of_many_rows_goes_by_the_same_prefixes(spark):
    n = 66_000  # once there were more than 65,536 rows, the first prefix was longer
    rows = spark.range(n).select(F.lit("a").alias("scope"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    (found,) = store.tree_digest(rows, "scope", "h").collect()
    level = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    level = [(x[:2], x) for x in level]
    for digits in (2, 1, 0):
        lists = {}
        for slot, x in level:
            lists.setdefault(slot[:digits], []).append(x)
        level = [(slot, hashlib.sha256("".join(sorted(xs)).encode()).hexdigest()) for slot, xs in lists.items()]
    assert [(found["scope"], found["digest"])] == [("a", level[0][1])]


def test_circles_end_a_walk_by_the_longest_chain_not_by_the_table(spark, monkeypatch):
    cuts, cut = [], store.cut
    monkeypatch.setattr(store, "cut", lambda frame: cuts.append(1) or cut(frame))
    i = F.col("id")
    circles = spark.range(5000).select(i.alias("node"), F.when(i % 10 == 9, i - 9).otherwise(i + 1).alias("next"))
    chains = spark.range(5000, 5020).select(i.alias("node"), F.when(i % 4 == 3, -i).otherwise(i + 1).alias("next"))
    before = spark.createDataFrame([(6000, 3)], circles.schema)
    found = {r["node"]: (r["head"], r["steps"]) for r in store.chain_heads(circles.union(chains).union(before)).collect()}
    assert len(found) == 5021 and all(found[x] == (None, None) for x in [*range(5000), 6000])
    assert all(found[x] == (-(x // 4 * 4 + 3), 4 - x % 4) for x in range(5000, 5020))
    assert len(cuts) <= 6  # chains of 4 links take 3 rounds; 13 rounds of doubling once followed for the circles


def words_index(spark, base, parts):
    index = text_index.TextIndex(spark, base)
    for part in parts:
        index.add(spark.createDataFrame(part, "doc_id long, text string"))
    return index


def test_a_merge_and_a_build_exchange_no_row_for_each_word(spark, tmp_path, monkeypatch):
    """Ranges go as they lie: a merge explodes no list; a range is built by one call."""
    monkeypatch.setattr(text_index, "RANGE", 20)
    texts = [(i, " ".join(f"w{(i * j) % 17}x" for j in range(1, 12))) for i in range(300)]
    index = words_index(spark, f"{tmp_path}/t", [texts[:200], texts[200:205], texts[205:]])
    index.delete(spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc_id long"))
    plans, exploded = [], text_index.TextIndex._exploded
    monkeypatch.setattr(text_index.TextIndex, "_exploded", lambda self, *a: plans.append(1) or exploded(self, *a))
    index.merge()
    assert not plans
    held = index._postings(index._now()[1])
    each = held.select("range", "token", F.size("docs").alias("n"), F.explode("docs").alias("doc_id"))
    assert each.select("doc_id").distinct().count() == 200 and each.groupBy("token", "doc_id").count().filter("count > 1").isEmpty()
    sizes = [r["n"] for r in each.groupBy("range").agg(F.count_distinct("doc_id").alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) <= 60
    fresh = words_index(spark, f"{tmp_path}/u", [[x for x in texts if x[0] % 3]])
    queries = spark.createDataFrame([(1, "w3x w5x"), (2, "w16x w1x w2x")], "qid long, text string")
    assert sorted(map(tuple, index.search(queries, 50).collect())) == sorted(map(tuple, fresh.search(queries, 50).collect()))


def test_tasks_of_an_index_grow_in_number_with_the_documents(spark):
    """Once 48 tasks, whatever they held, up to 65,536 documents each."""
    ranges = 3_000_000 // text_index.RANGE
    assert ranges * text_index.RANGE / text_index._parts(spark, ranges) <= 2 * text_index.PART <= 8192


def test_words_of_some_documents(spark, tmp_path):
    index = words_index(spark, f"{tmp_path}/t", [[(1, "ab cd"), (2, "ab ab"), (3, "cd ef")]])
    queries = spark.createDataFrame([(1, "ab cd")], "qid long, text string")
    found = index.words_of(queries, spark.createDataFrame([(2,), (3,), (3,)], "doc_id long"))
    assert sorted(map(tuple, found.collect())) == [(2, "ab", 2, 2), (3, "cd", 1, 2)]


def test_entities_of_one_name_are_not_listed_for_each_candidate(spark, monkeypatch):
    """A name that 400 entities and 300 candidates have: pairs of names are made, not 120,000 pairs."""
    sizes, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda frame: (lambda held: sizes.append(held.count()) or held)(cut(frame)))
    known = [(i, "a", "red ring", [f"part {i}", "red ring", "ring"]) for i in range(400)] + [(400, "a", "blue ring", ["part 0"]), (401, "b", "ring red", None), (402, "a", "", ["nothing"])]
    asked = [(i, "a", "ring red" if i % 2 else "red ring") for i in range(300)] + [(300, "a", "part 0"), (301, "a", "part 7"), (302, "b", "red ring"), (303, "a", "green"), (304, "a", "ring"), (305, "a", ""), (306, "a", "blue ring")]
    found = graph.resolve(spark.createDataFrame(asked, "candidate long, scope string, name string"), spark.createDataFrame(known, "entity long, scope string, name string, aliases array<string>"))
    rows = {r["candidate"]: (r["matches"], r["entity"], r["outcome"]) for r in found.collect()}
    assert all(rows[i] == (400, None, "ambiguous") for i in range(300)) and rows[300] == (2, None, "ambiguous") and rows[304] == (400, None, "ambiguous")
    assert (rows[301], rows[302], rows[303], rows[305], rows[306]) == ((1, 7, "resolved"), (1, 401, "resolved"), (0, None, "new"), (1, 402, "resolved"), (1, 400, "resolved"))
    assert sizes and max(sizes) < 20


def test_pages_of_a_batch_are_read_slice_by_slice(monkeypatch):
    """A whole batch was a pandas series of strings, and its texts another."""
    sizes, array = [], pa.array
    pages = array([None if i % 7 == 0 else f"<p>a {i}</p><script>x</script><p>b</p>" for i in range(2 * text.PAGES + 3)])
    monkeypatch.setattr(text.pa, "array", lambda x, kind: sizes.append(len(x)) or array(x, kind))
    found = text._html.func(pages).to_pylist()
    assert found == ["" if i % 7 == 0 else f"a {i}\nb" for i in range(len(pages))] and max(sizes) <= text.PAGES


def test_tables_that_grow_are_not_sent_through_the_driver(spark, sf_dir, monkeypatch):
    """Their files are small, so Spark broadcast them: digests of all files, entities, relations and facts."""
    plans, cut = [], graph.cut
    see = lambda *frames: plans.extend(x._jdf.queryExecution().executedPlan().toString() for x in frames)
    monkeypatch.setattr(graph, "cut", lambda frame: see(frame) or cut(frame))
    see(store.stale(tables.anchors(tables.records(spark, sf_dir)), tables.files(spark, sf_dir)))
    of = store.written(held.sources(spark, sf_dir))
    evidence = held.evidence(spark, sf_dir, of)
    own = (held.entities(spark, sf_dir), held.relations(spark, sf_dir), held.facts(spark, sf_dir), held.observations(spark, sf_dir), evidence)
    live = graph.eligible(*own, of, 1_800_000_000_000)
    left = graph.erase(of.filter("doc_id % 3 = 0").select("doc_id"), *own)
    see(live.observations, *live.evidence.values(), *left.values())
    assert len(plans) > 15 and not [x for x in plans if "BroadcastExchange" in x]


def test_runs_of_few_parts_are_digested_in_one_exchange(spark, monkeypatch):
    """All parts were written, read twice and exchanged at every level."""
    rows = [(run, "s", f'{{"b": {i % 3}.0, "a": {run}}}') for run, n in ((1, 1), (2, 2), (3, extraction.FEW_PARTS), (4, 40), (5, 90)) for i in range(n)] + [(2, "s", None), (None, "s", "1")]
    material = spark.createDataFrame(rows, "run long, section string, json string")
    whole = sorted(map(tuple, extraction.run_digests(material).collect()))
    monkeypatch.setattr(extraction, "FEW_PARTS", 0)
    assert whole == sorted(map(tuple, extraction.run_digests(material).collect())) and [x[1] for x in whole] == [1, 3, extraction.FEW_PARTS or 32, 40, 90]
    assert [x[3] for x in whole] == [None, "missing", None, None, None] and whole[1][2] is None
    monkeypatch.undo()
    monkeypatch.setattr(store, "written", None)
    plan = extraction.run_digests(material.filter("run < 4"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_short_text_is_read_once_a_worker(monkeypatch):
    seen, one = [], canonical.canonical_text
    monkeypatch.setattr(canonical, "canonical_text", lambda *a: seen.append(1) or one(*a))
    canonical._told_lately.cache_clear()
    found = [canonical._told_lately(x, frozenset()) for x in ['{"b":1.0, "a":2}', "{", '{"b":1.0, "a":2}', "{"]]
    assert found == [('{"a":2,"b":1}', None), (None, "not_json")] * 2 and len(seen) == 2


def test_updates_are_decided_without_texts(spark, sf_dir, monkeypatch):
    """Merged rows, old and new texts and all, went through four joins and two checkpoints; the table was made twice."""
    kept, made, cut, changeable = [], [], store.cut, writes._changeable
    monkeypatch.setattr(store, "cut", lambda frame: kept.append(frame.columns) or cut(frame))
    monkeypatch.setattr(writes, "_changeable", lambda *a: made.append(1) or changeable(*a))
    assert writes.updated_records(spark, sf_dir).count() > 0 and made == [1]
    assert len(kept) > 1 and not [x for x in kept if "content" in x]


def test_metrics_search_each_channel_once(spark, sf_dir, monkeypatch):
    """Modes score one table of candidates: words and vectors are searched once, and a mode has what its own search returns."""
    asked, words, vectors_ = [], text_index.TextIndex.search, channels.cosine_top
    monkeypatch.setattr(text_index.TextIndex, "search", lambda *args, **named: asked.append("words") or words(*args, **named))
    monkeypatch.setattr(channels, "cosine_top", lambda *args, **named: asked.append("vectors") or vectors_(*args, **named))
    returned, _, _ = search._evaluation(spark, sf_dir)
    assert sorted(asked) == ["vectors", "words"]
    own = search.search(spark, sf_dir, "lexical").select("qid", "doc_id", "score")
    best = {tuple(x) for x in own.collect()}
    got = {(r.qid, r.doc_id, r.score) for r in returned.filter("mode = 'lexical'").collect()}
    assert got and got <= best


def test_a_search_task_has_a_bounded_number_of_documents():
    """Of larger tables a search has more tasks, not larger ones: each about 16,384 documents, in whole ranges."""
    assert text_index.TASK <= 16_384 and text_index.TASK % text_index.RANGE == 0
