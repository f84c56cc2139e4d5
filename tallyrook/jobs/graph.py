"""Queries on a graph of regions, nations, customers and suppliers, with events as facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrook.jobs.catalog import query
from tallyrook.operators import graph, ranking, store
from tallyrook.schemas import DAY_MS, NOW_MS
from tallyrook.sources import graph as held
from tallyrook.sources.graph import GRAPH_SQL, entities, millis, relations
from tallyrook.sources.tables import table

c = F.col
#: The time of as-of queries: 1998-06-01.
AS_OF = 896_659_200_000


def live(spark: SparkSession, sf_dir: str, time: graph.TimeFilter | None = None) -> graph.Eligible:
    of = store.written(held.sources(spark, sf_dir))
    return graph.eligible(entities(spark, sf_dir), relations(spark, sf_dir), held.facts(spark, sf_dir), held.observations(spark, sf_dir), held.evidence(spark, sf_dir, of), of, NOW_MS, time)


_NAMED = lambda rows: f"""SELECT qid, id, round(max(CASE WHEN field = text THEN 1.0 WHEN contains(field, text) THEN 0.75 ELSE 0.6::DOUBLE * len(list_filter(string_split(text, ' '), lambda w: list_contains(string_split(field, ' '), w))) / len(string_split(text, ' ')) END), 9) AS score
  FROM gq, (SELECT id, unnest(fields) AS field FROM ({rows})) GROUP BY ALL HAVING score > 0"""  # noqa: E731
_SEARCH = lambda near="": f"""{GRAPH_SQL}, live_ent AS (SELECT * FROM ent WHERE entity IN (SELECT id FROM ok_entity)
), by_name AS ({_NAMED("SELECT entity AS id, list_concat([name, type], aliases) AS fields FROM live_ent")}
), by_rel AS ({_NAMED("SELECT relation AS id, [predicate] AS fields FROM ok_relation")}
), seeds AS (SELECT qid, entity, max(score) AS score FROM (SELECT qid, id AS entity, score FROM by_name UNION ALL SELECT qid, unnest([subject, object]), score FROM by_rel JOIN ok_relation ON relation = id{near}) GROUP BY ALL
), adj AS (
  SELECT node, neighbour FROM (SELECT relation, subject AS node, object AS neighbour FROM ok_relation UNION ALL SELECT relation, object, subject FROM ok_relation)
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY relation, neighbour) <= 32
), l1 AS (SELECT DISTINCT qid, neighbour AS entity FROM seeds JOIN adj ON node = entity EXCEPT SELECT qid, entity FROM seeds
), l2 AS (SELECT DISTINCT qid, neighbour AS entity FROM l1 JOIN adj ON node = entity EXCEPT (SELECT qid, entity FROM seeds UNION SELECT qid, entity FROM l1)
), reached AS (SELECT qid, entity, score, 0 AS level FROM seeds UNION ALL SELECT qid, entity, 0.05, 1 FROM l1 UNION ALL SELECT qid, entity, 0.033333333, 2 FROM l2
), every AS (SELECT qid, 'entity' AS kind, entity AS id, score FROM reached
  UNION ALL SELECT qid, 'fact', CAST(id AS VARCHAR), score FROM ({_NAMED("SELECT fact AS id, [text, '', type] AS fields FROM ok_fact")})
  UNION ALL SELECT qid, 'observation', CAST(id AS VARCHAR), score FROM ({_NAMED("SELECT observation AS id, [statement] AS fields FROM ok_obs")})
), best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id, kind) - 1 AS place FROM every QUALIFY place < 64
), memories AS (SELECT 'entity' AS kind, id, min(doc_id) AS memory FROM cur_entity GROUP BY id UNION ALL SELECT 'fact', CAST(id AS VARCHAR), min(doc_id) FROM cur_fact GROUP BY id
  UNION ALL SELECT 'observation', CAST(observation AS VARCHAR), min(doc_id) FROM obs JOIN cur_fact ON id = fact GROUP BY observation
), found AS (SELECT qid, place, best.kind, best.id, CAST(score AS DOUBLE) AS score, memory FROM best LEFT JOIN memories USING (kind, id))"""  # noqa: E731
SEARCH_SQL = _SEARCH()
_LIKE = "round(least(greatest((list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) + 1) / 2, 0), 1), 9)"
#: Of two of three customers and suppliers the vector is of the active generation; every one of them is near to a query, the best 64 count.
_NEAR = f"""SELECT qid, entity, {_LIKE} AS score FROM gq JOIN embeddings q ON q.vec_id = qid, live_ent JOIN embeddings v ON v.vec_id = key
  WHERE type IN ('customer', 'supplier') AND key % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, key, type) <= 64"""
MEANT_SQL = _SEARCH(f" UNION ALL SELECT * FROM ({_NEAR}) WHERE score > 0")


@query(f"WITH {GRAPH_SQL} SELECT doc_id, unit, revision, eligible, remote FROM src")
def graph_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot of what an extraction may read: unit, revision, whether eligible, and whether for a remote model."""
    return held.sources(spark, sf_dir).select("doc_id", "unit", "revision", "eligible", "remote")


_ELIGIBLE_SQL = "SELECT 'entity' AS section, id FROM ok_entity UNION ALL SELECT 'relation', CAST(relation AS VARCHAR) FROM ok_relation UNION ALL SELECT 'fact', CAST(fact AS VARCHAR) FROM ok_fact UNION ALL SELECT 'observation', CAST(observation AS VARCHAR) FROM ok_obs"


def _sections(found: graph.Eligible) -> DataFrame:
    own = {"entity": found.entities, "relation": found.relations, "fact": found.facts, "observation": found.observations}
    return store.union(*(rows.select(F.lit(kind).alias("section"), c(kind).cast("string").alias("id")) for kind, rows in own.items()))


@query(f"WITH {GRAPH_SQL} {_ELIGIBLE_SQL}")
def graph_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a graph search may read: only what current evidence carries."""
    return _sections(live(spark, sf_dir))


@query(f"WITH {SEARCH_SQL} SELECT CAST(qid AS INT) AS qid, entity, score FROM seeds")
def graph_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that a query names, by themselves or by their relations, with scores."""
    found = live(spark, sf_dir)
    return graph.seeds(held.queries(spark, sf_dir), found.entities, found.relations)


def found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, graph.Eligible]:
    own = live(spark, sf_dir)
    return store.cut(graph.results(held.queries(spark, sf_dir), own)), own


@query(f"WITH {SEARCH_SQL} SELECT CAST(qid AS INT) AS qid, CAST(place AS INT) AS place, kind, id, score, memory FROM found")
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each query finds: entities within two steps of the seeds, at most 32 relations a node; facts; observations."""
    return found(spark, sf_dir)[0]


def meaning(spark: SparkSession, sf_dir: str) -> graph.Meaning:
    return graph.Meaning(*held.meaning(spark, sf_dir), "g2")


_BY = """SELECT CAST(qid AS INT) AS qid, entity, score, coalesce(n.score_n, 0) AS semantic, CASE WHEN n.score_n IS NULL THEN 'words' WHEN w.qid IS NULL THEN 'vector' ELSE 'both' END AS found_by
FROM seeds LEFT JOIN (SELECT qid, entity, score AS score_n FROM near) n USING (qid, entity) LEFT JOIN (SELECT DISTINCT qid, entity FROM (SELECT qid, id AS entity FROM by_name UNION ALL SELECT qid, unnest([subject, object]) FROM by_rel JOIN ok_relation ON relation = id)) w USING (qid, entity)"""


@query(f"WITH {MEANT_SQL}, near AS ({_NEAR}) {_BY}")
def graph_seeds_by_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that a query names or is near to by vectors of the active generation, with scores and what found them."""
    own, asked, meant = live(spark, sf_dir), held.queries(spark, sf_dir), meaning(spark, sf_dir)
    near = store.cut(graph.near(meant, own.entities)).withColumnRenamed("score", "semantic")
    words = graph.seeds(asked, own.entities, own.relations)
    both = words.join(near, ["qid", "entity"], "full_outer")
    by = F.when(c("semantic").isNull(), "words").when(c("score").isNull(), "vector").otherwise("both")
    return both.select("qid", "entity", F.greatest("score", "semantic").alias("score"), F.coalesce("semantic", F.lit(0.0)).alias("semantic"), by.alias("found_by"))


@query(f"WITH {MEANT_SQL} SELECT CAST(qid AS INT) AS qid, CAST(place AS INT) AS place, kind, id, score, memory FROM found")
def graph_search_by_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each query finds where its seeds are by words and by vectors."""
    return store.cut(graph.results(held.queries(spark, sf_dir), live(spark, sf_dir), meaning=meaning(spark, sf_dir)))


@query(f"WITH {SEARCH_SQL} SELECT qid, memory AS doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY min(place), memory) - 1 AS INT) AS rank FROM found WHERE memory IS NOT NULL GROUP BY qid, memory")
def graph_memory_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records behind a graph search, in the order of its results."""
    return graph.memory_ranks(found(spark, sf_dir)[0])


@query(
    f"""WITH {SEARCH_SQL}, ends AS (SELECT relation, unnest([subject, object]) AS id FROM ok_relation), firsts AS (SELECT id, relation FROM ends QUALIFY row_number() OVER (PARTITION BY id ORDER BY relation) <= 32
), r AS (SELECT qid, count(DISTINCT relation) AS relations FROM found JOIN firsts USING (id) WHERE kind = 'entity' GROUP BY qid
), n AS (SELECT qid, count(DISTINCT memory) AS memories, count(*) FILTER (kind = 'entity') AS entities, count(*) FILTER (kind = 'fact') AS facts, count(*) FILTER (kind = 'observation') AS observations FROM found GROUP BY qid)
SELECT qid, least(memories, 64) AS memories, least(entities, 64) AS entities, least(coalesce(relations, 0), 64) AS relations, least(facts, 64) AS facts, least(observations, 64) AS observations, greatest(memories, entities, coalesce(relations, 0), facts, observations) >= 64 AS truncated FROM n LEFT JOIN r USING (qid)"""
)
def graph_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many memories, entities, relations, facts and observations a search returns, and whether a list is full."""
    return graph.assembled(*found(spark, sf_dir))


_FILTERS = {
    "now": graph.TimeFilter(),
    "as_of": graph.TimeFilter(valid_after=NOW_MS - 90 * DAY_MS, valid_before=NOW_MS - 90 * DAY_MS),
    "started": graph.TimeFilter(valid_after=NOW_MS - 400 * DAY_MS, valid_before=NOW_MS - 100 * DAY_MS),
    "extracted": graph.TimeFilter(extracted_after=NOW_MS - 200 * DAY_MS, extracted_before=NOW_MS - 50 * DAY_MS),
    "occurred": graph.TimeFilter(occurred_after=1_704_844_800_000, occurred_before=1_705_708_800_000),
    "occurred_learned": graph.TimeFilter(occurred_after=1_704_844_800_000, extracted_before=1_705_300_000_000),
}
_VALID = lambda at: f"(valid_ms IS NULL OR valid_ms <= {at}) AND (invalid_ms IS NULL OR {at} < invalid_ms)"
_FILTERS_SQL = {
    "now": (_VALID(NOW_MS), "true"),
    "as_of": (_VALID(NOW_MS - 90 * DAY_MS), "true"),
    "started": (f"{_VALID(NOW_MS)} AND valid_ms BETWEEN {NOW_MS - 400 * DAY_MS} AND {NOW_MS - 100 * DAY_MS}", "true"),
    "extracted": (f"{_VALID(NOW_MS)} AND extracted_ms BETWEEN {NOW_MS - 200 * DAY_MS} AND {NOW_MS - 50 * DAY_MS}", f"learned_ms BETWEEN {NOW_MS - 200 * DAY_MS} AND {NOW_MS - 50 * DAY_MS}"),
    "occurred": (_VALID(NOW_MS), "coalesce(end_ms, start_ms) >= 1704844800000 AND coalesce(start_ms, end_ms) <= 1705708800000"),
    "occurred_learned": (f"{_VALID(NOW_MS)} AND extracted_ms <= 1705300000000", "coalesce(end_ms, start_ms) >= 1704844800000 AND learned_ms <= 1705300000000"),
}


@query(f"WITH {GRAPH_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS filter, 'relation' AS kind, relation AS id FROM rel WHERE {r} UNION ALL SELECT '{k}', 'fact', fact FROM fct WHERE {f}" for k, (r, f) in _FILTERS_SQL.items()))
def graph_time_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of time filter lets through: valid now, as of a time, started in a range, extracted in a range, occurred in a range."""
    r, f = relations(spark, sf_dir), held.facts(spark, sf_dir)
    one = lambda name, rows, kind, test: rows.filter(test).select(F.lit(name).alias("filter"), F.lit(kind).alias("kind"), c(kind).alias("id"))
    return store.union(*(x for name, t in _FILTERS.items() for x in (one(name, r, "relation", t.relations(NOW_MS)), one(name, f, "fact", t.facts()))))


_TRADE_SQL = "trade AS (SELECT o_orderkey, l_linenumber, o_custkey AS subject, l_partkey AS object, (epoch_us(o_orderdate) // 1000) AS valid_ms, CASE WHEN l_shipdate > o_orderdate THEN (epoch_us(l_shipdate) // 1000) END AS invalid_ms FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to part, valid from the order to its shipping."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", c("o_custkey").alias("subject"), millis("o_orderdate").alias("valid_ms"), "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("o_orderkey"), "l_linenumber", c("l_partkey").alias("object"), "l_shipdate")
    return o.join(lines, "o_orderkey").withColumn("invalid_ms", F.when(c("l_shipdate") > c("o_orderdate"), millis("l_shipdate"))).drop("o_orderdate", "l_shipdate")


@query(f"WITH {_TRADE_SQL} SELECT o_orderkey, l_linenumber, subject, object, valid_ms, invalid_ms FROM trade WHERE valid_ms <= {AS_OF} AND (invalid_ms IS NULL OR {AS_OF} < invalid_ms)")
def graph_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations valid at a time."""
    return trade(spark, sf_dir).filter(graph.valid_at(c("valid_ms"), c("invalid_ms"), F.lit(AS_OF))).select("o_orderkey", "l_linenumber", "subject", "object", "valid_ms", "invalid_ms")


_FACT_SQL = "fact AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN (epoch_us(ts) // 1000) END AS start_ms, CASE WHEN event_id % 3 = 1 THEN NULL WHEN event_id % 15 = 0 THEN NULL ELSE (epoch_us(ts) // 1000) + CAST(floor(value) AS BIGINT) * 60000 END AS end_ms FROM events)"
_AFTER, _BEFORE = 1_704_844_800_000, 1_705_708_800_000


@query(f"WITH {_FACT_SQL} SELECT event_id, start_ms, end_ms FROM fact WHERE coalesce(end_ms, start_ms) >= {_AFTER} AND coalesce(start_ms, end_ms) <= {_BEFORE}")
def graph_fact_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that occurred within ten days, with open bounds."""
    i, at = c("event_id"), millis("ts")
    end = F.when((i % 3 == 1) | (i % 15 == 0), None).otherwise(at + F.floor("value").cast("long") * 60_000)
    facts = table(spark, sf_dir, "events").select("event_id", F.when(i % 3 != 0, at).alias("start_ms"), end.alias("end_ms"))
    return facts.filter(graph.overlaps(c("start_ms"), c("end_ms"), _AFTER, _BEFORE))


@query(
    """WITH e AS (SELECT p_partkey AS entity, p_brand AS scope, lower(p_name) AS name, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS ws FROM part
), k AS (SELECT s_suppkey AS candidate, p_brand AS scope, CASE s_suppkey % 4 WHEN 0 THEN array_to_string(list_reverse(string_split(lower(p_name), ' ')), ' ') WHEN 1 THEN 'part ' || p_partkey WHEN 2 THEN lower(p_name) || ' unheard' ELSE lower(p_name) END AS name FROM supplier JOIN part ON p_partkey = s_suppkey
), kw AS (SELECT *, list_sort(list_distinct(string_split(name, ' '))) AS ws FROM k
), m AS (SELECT candidate, entity FROM k JOIN e USING (scope) WHERE k.name = e.name OR k.name = 'part ' || e.entity
  UNION SELECT candidate, entity FROM kw JOIN e USING (scope) WHERE len(list_intersect(kw.ws, e.ws)) >= 0.9 * (len(kw.ws) + len(e.ws) - len(list_intersect(kw.ws, e.ws)))
), n AS (SELECT candidate, count(DISTINCT entity) AS matches, min(entity) AS entity FROM m GROUP BY candidate)
SELECT candidate, coalesce(matches, 0) AS matches, CASE WHEN matches = 1 THEN entity END AS entity, CASE WHEN matches IS NULL THEN 'new' WHEN matches = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome FROM k LEFT JOIN n USING (candidate)"""
)
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suppliers call their first part, among all parts of its brand: by name, by alias, or by words in another order."""
    p = table(spark, sf_dir, "part")
    name, key = F.lower("p_name"), c("candidate")
    known = p.select(c("p_partkey").alias("entity"), c("p_brand").alias("scope"), name.alias("name"), F.array(F.concat(F.lit("part "), "p_partkey")).alias("aliases"))
    asked = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("candidate"), c("s_suppkey").alias("p_partkey")).join(p, "p_partkey")
    said = F.when(key % 4 == 0, F.array_join(F.reverse(F.split(name, " ")), " ")).when(key % 4 == 1, F.concat(F.lit("part "), "p_partkey")).when(key % 4 == 2, F.concat(name, F.lit(" unheard"))).otherwise(name)
    return graph.resolve(asked.select("candidate", c("p_brand").alias("scope"), said.alias("name")), known)


@query("SELECT l_partkey AS entity, count(DISTINCT l_orderkey) AS sources, count(*) AS mentions FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem) GROUP BY l_partkey")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources and mentions of every entity."""
    mentions = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey").distinct()
    by_source = mentions.groupBy(c("l_partkey").alias("entity"), "l_orderkey").agg(F.count("*").alias("n"))
    return by_source.groupBy("entity").agg(F.count("*").alias("sources"), F.sum("n").alias("mentions"))


@query(
    f"""WITH {GRAPH_SQL}, parts AS (
  SELECT 'entity:' || entity AS s, unnest(['rdf:type', 'name', 'type']) AS p, unnest(['Entity', name, type]) AS o FROM ent
  UNION ALL SELECT 'relation:' || relation, unnest(['rdf:type', 'subject', 'object', 'predicate']), unnest(['Relation', subject, object, predicate]) FROM rel
  UNION ALL SELECT 'fact:' || fact, unnest(['rdf:type', 'text', 'about', 'causedBy']), unnest(['Fact', text, 'c' || "user", 'fact:' || cause]) FROM fct
  UNION ALL SELECT 'observation:' || observation, unnest(['rdf:type', 'statement', 'freshness', 'supportedBy']), unnest(['Observation', statement, freshness, 'fact:' || fact]) FROM obs
  UNION ALL SELECT 'entity:' || id, 'evidenceSource', CAST(doc_id AS VARCHAR) FROM ev_entity UNION ALL SELECT 'relation:' || id, 'evidenceSource', CAST(doc_id AS VARCHAR) FROM ev_relation UNION ALL SELECT 'fact:' || id, 'evidenceSource', CAST(doc_id AS VARCHAR) FROM ev_fact)
SELECT DISTINCT s, p, o FROM parts WHERE o IS NOT NULL"""
)
def rdf_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = held.facts(spark, sf_dir).withColumn("about", F.concat(F.lit("c"), c("user").cast("string")))
    return graph.triples(entities(spark, sf_dir), relations(spark, sf_dir), facts, held.observations(spark, sf_dir), held.evidence(spark, sf_dir))


_SCORES_SQL = "base AS (SELECT l_orderkey % 50 AS qid, l_partkey AS doc_id, round(max(l_discount * 9), 9) AS score FROM lineitem WHERE l_linenumber < 4 GROUP BY 1, 2), g AS (SELECT l_orderkey % 50 AS qid, l_partkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY sum(l_quantity) DESC, l_partkey) - 1 AS INT) AS rank FROM lineitem WHERE l_linenumber > 2 GROUP BY l_orderkey % 50, l_partkey QUALIFY rank < 64)"


@query(
    f"""WITH {_SCORES_SQL}, f AS (SELECT qid, doc_id, score, rank, round(CASE WHEN score IS NULL THEN 0.45::DOUBLE * (61.0::DOUBLE / (61 + rank)) WHEN rank IS NULL THEN score ELSE 0.75::DOUBLE * score + 0.25::DOUBLE * (61.0::DOUBLE / (61 + rank)) END, 9) AS fused FROM base FULL JOIN g USING (qid, doc_id))
SELECT qid, doc_id, rank, fused FROM f WHERE fused >= 0.42"""
)
def graph_rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores fused with graph ranks; what only the graph found comes in with its rank alone."""
    lines = table(spark, sf_dir, "lineitem").withColumns({"qid": c("l_orderkey") % 50, "doc_id": c("l_partkey")})
    base = lines.filter("l_linenumber < 4").groupBy("qid", "doc_id").agg(F.round(F.max(c("l_discount") * 9), 9).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("weight"), "doc_id")
    found = lines.filter("l_linenumber > 2").groupBy("qid", "doc_id").agg(F.sum("l_quantity").alias("weight")).withColumn("rank", F.row_number().over(order) - 1).filter("rank < 64").drop("weight")
    both = base.join(found, ["qid", "doc_id"], "full_outer").withColumn("fused", ranking.fused(c("score"), c("rank")))
    return both.filter("fused >= 0.42").select("qid", "doc_id", "rank", "fused")


@query(
    f"""WITH {GRAPH_SQL}, gone AS (SELECT doc_id FROM mem WHERE (doc_id * 7 + 3) % 10 < 4
), lf AS (SELECT DISTINCT id FROM ev_fact WHERE doc_id NOT IN (SELECT doc_id FROM gone)), le AS (SELECT DISTINCT id, doc_id FROM ev_entity WHERE doc_id NOT IN (SELECT doc_id FROM gone)), lr AS (SELECT DISTINCT id FROM ev_relation WHERE doc_id NOT IN (SELECT doc_id FROM gone))
SELECT 'fact' AS kind, CAST(fact AS VARCHAR) AS id, CAST(CASE WHEN cause IN (SELECT id FROM lf) THEN cause END AS VARCHAR) AS detail FROM fct WHERE fact IN (SELECT id FROM lf)
UNION ALL SELECT 'observation', CAST(observation AS VARCHAR), CAST(count(DISTINCT fact) AS VARCHAR) FROM obs WHERE fact IN (SELECT id FROM lf) GROUP BY observation
UNION ALL SELECT 'mention', id, CAST(doc_id AS VARCHAR) FROM le
UNION ALL SELECT 'relation', CAST(relation AS VARCHAR), NULL FROM rel WHERE relation IN (SELECT id FROM lr) AND subject IN (SELECT id FROM le) AND object IN (SELECT id FROM le)
UNION ALL SELECT 'entity', entity, NULL FROM ent WHERE entity IN (SELECT id FROM le)
UNION ALL SELECT 'run', CAST(o_orderkey AS VARCHAR), CASE WHEN o_custkey % (SELECT count(*) FROM documents) IN (SELECT doc_id FROM gone) THEN 'source_deleted' ELSE 'kept' END FROM orders
UNION ALL SELECT 'job', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderstatus <> 'F' AND o_custkey % (SELECT count(*) FROM documents) IN (SELECT doc_id FROM gone) THEN 'failed:source_changed' ELSE o_orderstatus END FROM orders"""
)
def source_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every kind after records are erased: facts with their causes, observations with their proofs, mentions, relations,
    entities; and what becomes of runs and open jobs over them."""
    gone = table(spark, sf_dir, "documents").filter((c("doc_id") * 7 + 3) % 10 < 4).select("doc_id")
    left = graph.erase(gone, entities(spark, sf_dir), relations(spark, sf_dir), held.facts(spark, sf_dir), held.observations(spark, sf_dir), held.evidence(spark, sf_dir))
    proofs = left["observation"].groupBy("observation").agg(F.count_distinct("fact").alias("proofs"))
    of = lambda rows, kind, detail=F.lit(None): rows.select(F.lit(kind).alias("kind"), c("entity" if kind == "mention" else kind).cast("string").alias("id"), detail.cast("string").alias("detail"))
    n = max(table(spark, sf_dir, "documents").count(), 1)
    runs = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("run"), c("o_orderkey").alias("job"), c("o_orderstatus").alias("state"), (c("o_custkey") % n).alias("doc_id"))
    runs = runs.join(store.small(gone.withColumn("gone", F.lit(True))), "doc_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    told = F.when(c("gone"), "source_deleted").otherwise("kept")
    state = F.when(c("gone") & (c("state") != "F"), "failed:source_changed").otherwise(c("state"))
    return store.union(of(left["fact"], "fact", c("cause")), of(proofs, "observation", c("proofs")), of(left["mention"], "mention", c("doc_id")), of(left["relation"], "relation"), of(left["entity"], "entity"), of(runs, "run", told), of(runs, "job", state))


@query(
    f"""WITH {GRAPH_SQL} SELECT (SELECT count(*) FROM ok_entity) AS entities, (SELECT count(*) FROM ok_relation) AS relations, (SELECT count(*) FROM ok_fact) AS facts, (SELECT count(*) FROM ok_obs) AS observations,
  count(*) FILTER (o_orderstatus <> 'F') AS pending_jobs, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS latest_run FROM orders"""
)
def graph_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a graph is visible, the jobs that are open, and the latest run."""
    counts = [_sections(live(spark, sf_dir)).agg(*(F.count_if(c("section") == k).alias(n) for k, n in (("entity", "entities"), ("relation", "relations"), ("fact", "facts"), ("observation", "observations"))))]
    done = F.when(c("o_orderstatus") == "F", F.struct("o_orderdate", "o_orderkey"))
    counts.append(table(spark, sf_dir, "orders").agg(F.count_if(c("o_orderstatus") != "F").alias("pending_jobs"), F.max(done)["o_orderkey"].alias("latest_run")))
    return counts[0].crossJoin(counts[1])  # one row each
