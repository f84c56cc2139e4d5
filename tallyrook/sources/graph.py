"""The graph that queries derive from the tables: regions, nations, customers and suppliers, their places, and events as facts.

Evidence of anything lies in a record, whose id follows from its own key; some of it is out of date.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.functions import ids, text
from tallyrook.operators import store
from tallyrook.schemas import DAY_MS, NOW_MS, POLICY
from tallyrook.sources import tables
from tallyrook.sources.tables import RECORDS_SQL, table

c = F.col
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def millis(column: str) -> Column:
    """Milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What graph evidence may rest on, one unit a record: doc_id, unit, content_hash, revision, scope, scope_key, at_ms, eligible, remote."""
    from tallyrook.jobs.records import eligible

    rows = tables.records(spark, sf_dir)
    live = eligible(spark, sf_dir, pending=tables.pending_deletes(rows), stale=store.stale(tables.anchors(rows), tables.files(spark, sf_dir)))
    hashed = rows.select("doc_id", "scope", "scope_key", c("updated_ms").alias("at_ms"), F.sha2("content", 256).alias("content_hash"), F.coalesce(F.get("tags", 1), F.lit("")).alias("source"), (F.pmod("doc_id", F.lit(4)) == 0).alias("anchored"))
    unit = ids.unit_id(c("doc_id").cast("string"), c("content_hash"), c("scope"), F.lit("manual"), c("source"))
    revision = ids.revision(c("content_hash"), c("scope"), c("scope_key"), F.lit("manual"), c("source"), F.lit(POLICY))
    met = hashed.join(live.select("doc_id", F.lit(True).alias("live")), "doc_id", "left").withColumn("eligible", F.coalesce("live", F.lit(False)))
    remote = c("eligible") & (c("scope") != "repository") & ~c("anchored") & ~text.code_like(c("source"))
    return met.select("doc_id", unit.alias("unit"), "content_hash", revision.alias("revision"), "scope", "scope_key", "at_ms", "eligible", remote.alias("remote"))


def _evidence(rows: DataFrame, of: DataFrame, key: str, n: int, every: int) -> DataFrame:
    """rows with the binding of their evidence: of the record that their key falls to; every so many are of an older text."""
    met = rows.withColumn("doc_id", F.pmod(c(key), F.lit(n))).join(store.shuffled(of.select("doc_id", "unit", "content_hash", "revision", "scope", "scope_key")), "doc_id")
    old = F.pmod(c(key), F.lit(every)) == 0
    return met.withColumn("content_hash", F.when(old, F.sha2(F.concat(F.lit("old "), "content_hash"), 256)).otherwise(c("content_hash")))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, key, name, type and aliases."""

    def one(name: str, key: str, letter: str, label: str, kind: str) -> DataFrame:
        number = c(key).cast("string")
        return table(spark, sf_dir, name).select(F.concat(F.lit(letter), number).alias("entity"), c(key).cast("long").alias("key"), text.normal_name(F.regexp_replace(label, "[^A-Za-z0-9]+", " ")).alias("name"), F.lit(kind).alias("type"), F.array(F.concat(F.lit(f"{kind} "), number)).alias("aliases"))

    return reduce(DataFrame.unionByName, (one("region", "r_regionkey", "r", "r_name", "region"), one("nation", "n_nationkey", "n", "n_name", "nation"), one("customer", "c_custkey", "c", "c_name", "customer"), one("supplier", "s_suppkey", "s", "s_name", "supplier")))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation, subject, predicate, object, valid_ms, invalid_ms and extracted_ms."""

    def one(name: str, base: int, key: str, letter: str, to: str, to_letter: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select((F.lit(base) + c(key)).cast("long").alias("relation"), F.concat(F.lit(letter), c(key).cast("string")).alias("subject"), F.lit(kind).alias("predicate"), F.concat(F.lit(to_letter), c(to).cast("string")).alias("object"))

    rows = one("nation", 0, "n_nationkey", "n", "n_regionkey", "r", "part_of").unionByName(one("supplier", 1000, "s_suppkey", "s", "s_nationkey", "n", "located_in")).unionByName(one("customer", 10**9, "c_custkey", "c", "c_nationkey", "n", "located_in"))
    k = c("relation")
    valid = F.when(k % 5 != 0, F.lit(NOW_MS) - (k % 700) * DAY_MS)
    return rows.withColumns({"valid_ms": valid, "invalid_ms": F.when(k % 7 == 0, F.lit(NOW_MS) - (k % 300 - 100) * DAY_MS), "extracted_ms": F.lit(NOW_MS) - (k % 400) * DAY_MS})


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact, text, context, type, user, start_ms, end_ms, learned_ms and cause (the fact it follows from)."""
    i, at = c("event_id"), millis("ts")
    end = F.when((i % 3 == 1) | (i % 15 == 0), None).otherwise(at + F.floor("value").cast("long") * 60_000)
    said = F.concat_ws(" ", "event_type", F.lit("of user"), c("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(i.cast("long").alias("fact"), said.alias("text"), F.lit("").alias("context"), F.when(i % 2 == 0, "world").otherwise("experience").alias("type"), c("user_id").alias("user"), "event_type", F.when(i % 3 != 0, at).alias("start_ms"), end.alias("end_ms"), (at + 1000).alias("learned_ms"), F.when(i % 4 == 0, i - 1).alias("cause"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observation, statement and fact, a row for each fact that one rests on; and its freshness."""
    f = facts(spark, sf_dir)
    kind = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), c("event_type"))
    own = (c("user") * 10 + kind).cast("long")
    fresh = F.when(own % 9 == 0, "retired").otherwise("current")
    return f.select(own.alias("observation"), F.concat(F.lit("user "), c("user").cast("string"), F.lit(" did "), c("event_type")).alias("statement"), "fact", fresh.alias("freshness"))


def evidence(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> dict[str, DataFrame]:
    """The evidence of entities (their mentions), relations and facts: the id, and the binding."""
    of = store.written(sources(spark, sf_dir)) if of is None else of
    n = max(table(spark, sf_dir, "documents").count(), 1)
    own = {"entity": (entities(spark, sf_dir).select("entity", "key"), "key", 13), "relation": (relations(spark, sf_dir).select("relation"), "relation", 11), "fact": (facts(spark, sf_dir).select("fact"), "fact", 7)}
    return {kind: _evidence(rows, of, key, n, every) for kind, (rows, key, every) in own.items()}


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid and text: the names of regions and nations, and the kinds of events."""
    name = lambda x: text.normal_name(F.regexp_replace(x, "[^A-Za-z0-9]+", " "))
    regions = table(spark, sf_dir, "region").select((100 + c("r_regionkey")).cast("int").alias("qid"), name("r_name").alias("text"))
    nations = table(spark, sf_dir, "nation").select(c("n_nationkey").cast("int").alias("qid"), name("n_name").alias("text"))
    kinds = table(spark, sf_dir, "events").select("event_type").distinct().select((200 + F.array_position(F.array(*map(F.lit, EVENT_TYPES)), c("event_type"))).cast("int").alias("qid"), c("event_type").alias("text"))
    return regions.unionByName(nations).unionByName(kinds)


def meaning(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of queries (qid, vector) and of customers and suppliers (entity, number, vector, generation): two of three are of g2."""
    held = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    own = entities(spark, sf_dir).filter("type IN ('customer', 'supplier')").join(store.shuffled(held), "key")
    number = c("key") * 2 + F.when(c("type") == "supplier", 1).otherwise(0)
    of = own.select("entity", number.alias("number"), "vector", F.when(c("key") % 3 == 0, "g1").otherwise("g2").alias("generation"))
    return queries(spark, sf_dir).join(held.withColumnRenamed("key", "qid"), "qid").select("qid", "vector"), of


# --- the same in SQL ---------------------------------------------------------------------------------------------
_NAME = lambda x: f"trim(lower(regexp_replace({x}, '[^A-Za-z0-9]+', ' ', 'g')))"
_ONE = lambda t, key, letter, label, kind: f"SELECT '{letter}' || {key} AS entity, CAST({key} AS BIGINT) AS key, {_NAME(label)} AS name, '{kind}' AS type, ['{kind} ' || {key}] AS aliases FROM {t}"
_REV = f"sha256(concat_ws(chr(0), content_hash, scope, coalesce(scope_key, ''), 'manual', source, '{POLICY}'))"
_LIVE = "doc_id % 61 <> 5 AND (scope NOT IN ('session', 'agent') OR (scope = 'session' AND scope_key = 's3') OR (scope = 'agent' AND scope_key = 'a1'))"
_BOUND = lambda kind, t, key, every: f"SELECT t.{kind} AS id, s.doc_id, unit, revision, scope, scope_key, t.{key} % {every} = 0 AS old FROM {t} t JOIN src s ON s.doc_id = t.{key} % (SELECT count(*) FROM documents)"
GRAPH_SQL = f"""{RECORDS_SQL}, src AS (
  SELECT doc_id, scope, scope_key, at_ms, content_hash, eligible, eligible AND scope <> 'repository' AND doc_id % 4 <> 0 AND NOT ({text.code_like_sql("source")}) AS remote,
    'unit_' || substr(sha256(concat_ws(chr(0), doc_id, content_hash, scope, 'manual', source)), 1, 32) AS unit, {_REV} AS revision
  FROM (SELECT doc_id, scope, scope_key, updated_ms AS at_ms, sha256(content) AS content_hash, coalesce(tags[2], '') AS source,
    {_LIVE} AND NOT (NOT pinned AND coalesce(expires_ms <= {NOW_MS}, false)) AND doc_id NOT IN (SELECT doc_id FROM superseded) AND doc_id NOT IN (SELECT doc_id FROM stale) AS eligible FROM mem)
), ent AS ({" UNION ALL ".join((_ONE("region", "r_regionkey", "r", "r_name", "region"), _ONE("nation", "n_nationkey", "n", "n_name", "nation"), _ONE("customer", "c_custkey", "c", "c_name", "customer"), _ONE("supplier", "s_suppkey", "s", "s_name", "supplier")))}
), rel AS (SELECT *, CASE WHEN relation % 5 <> 0 THEN {NOW_MS} - (relation % 700) * {DAY_MS} END AS valid_ms, CASE WHEN relation % 7 = 0 THEN {NOW_MS} - (relation % 300 - 100) * {DAY_MS} END AS invalid_ms, {NOW_MS} - (relation % 400) * {DAY_MS} AS extracted_ms FROM (
  SELECT CAST(n_nationkey AS BIGINT) AS relation, 'n' || n_nationkey AS subject, 'part_of' AS predicate, 'r' || n_regionkey AS object FROM nation
  UNION ALL SELECT 1000 + s_suppkey, 's' || s_suppkey, 'located_in', 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 1000000000 + c_custkey, 'c' || c_custkey, 'located_in', 'n' || c_nationkey FROM customer)
), fct AS (
  SELECT CAST(event_id AS BIGINT) AS fact, event_type || ' of user ' || user_id AS text, CASE WHEN event_id % 2 = 0 THEN 'world' ELSE 'experience' END AS type, user_id AS "user", event_type, CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) // 1000 END AS start_ms,
    CASE WHEN event_id % 3 = 1 OR event_id % 15 = 0 THEN NULL ELSE (epoch_us(ts) // 1000) + CAST(floor(value) AS BIGINT) * 60000 END AS end_ms, epoch_us(ts) // 1000 + 1000 AS learned_ms, CASE WHEN event_id % 4 = 0 THEN event_id - 1 END AS cause FROM events
), obs AS (
  SELECT CAST("user" * 10 + list_position([{", ".join(f"'{x}'" for x in EVENT_TYPES)}], event_type) AS BIGINT) AS observation, 'user ' || "user" || ' did ' || event_type AS statement, fact, CASE WHEN observation % 9 = 0 THEN 'retired' ELSE 'current' END AS freshness FROM fct
), ev_entity AS ({_BOUND("entity", "ent", "key", 13)}), ev_relation AS ({_BOUND("relation", "rel", "relation", 11)}), ev_fact AS ({_BOUND("fact", "fct", "fact", 7)}
), gq AS (SELECT CAST(100 + r_regionkey AS INT) AS qid, {_NAME("r_name")} AS text FROM region UNION ALL SELECT n_nationkey, {_NAME("n_name")} FROM nation UNION ALL SELECT DISTINCT 200 + list_position([{", ".join(f"'{x}'" for x in EVENT_TYPES)}], event_type), event_type FROM events
), cur_entity AS (SELECT id, doc_id FROM ev_entity WHERE NOT old AND scope = 'project' AND doc_id IN (SELECT doc_id FROM src WHERE eligible)
), cur_relation AS (SELECT id, doc_id FROM ev_relation WHERE NOT old AND doc_id IN (SELECT doc_id FROM src WHERE eligible)
), cur_fact AS (SELECT id, doc_id FROM ev_fact WHERE NOT old AND doc_id IN (SELECT doc_id FROM src WHERE eligible)
), ok_entity AS (SELECT DISTINCT id FROM cur_entity
), ok_relation AS (SELECT * FROM rel WHERE relation IN (SELECT id FROM cur_relation) AND subject IN (SELECT id FROM ok_entity) AND object IN (SELECT id FROM ok_entity) AND (valid_ms IS NULL OR valid_ms <= {NOW_MS}) AND (invalid_ms IS NULL OR {NOW_MS} < invalid_ms)
), ok_fact AS (SELECT * FROM fct WHERE fact IN (SELECT id FROM cur_fact)
), ok_obs AS (SELECT DISTINCT observation, statement FROM obs WHERE freshness = 'current' AND fact IN (SELECT fact FROM ok_fact)
)"""
