"""Queries on the store: index diffs, links, repairs, feedback, snapshots, jobs, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrook.functions import ids
from tallyrook.jobs.catalog import query
from tallyrook.operators import store
from tallyrook.operators.channels import dot
from tallyrook.schemas import DAY_MS, NOW_MS
from tallyrook.sources import tables
from tallyrook.sources.graph import millis
from tallyrook.sources.tables import RECORDS_SQL

c = F.col


@query(
    """WITH known AS (SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN sha256('old ' || coalesce(text, '')) ELSE sha256(coalesce(text, '')) END AS digest, doc_id % 17 <> 0 AS alive FROM documents WHERE doc_id % 7 <> 0
), found AS (SELECT 'doc/' || doc_id AS path, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 11 <> 0)
SELECT path, CASE WHEN known.digest IS NULL THEN 'added' WHEN found.digest IS NULL THEN 'removed' WHEN known.digest = found.digest AND alive THEN 'unchanged' ELSE 'updated' END AS action FROM known FULL JOIN found USING (path)"""
)
def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index run does with each path: the table as it was known, against the table as it is found."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    old = F.when(c("doc_id") % 5 == 0, F.concat(F.lit("old "), "text")).otherwise(c("text"))
    known = d.filter("doc_id % 7 != 0").select("path", F.sha2(old, 256).alias("digest"), (c("doc_id") % 17 != 0).alias("alive"))
    return store.index_diff(known, d.filter("doc_id % 11 != 0").select("path", F.sha2("text", 256).alias("digest")))


@query(
    f"""WITH {RECORDS_SQL}, shared AS (SELECT *, 'shared/' || (doc_id // 2) AS src, 'mem_' || substr(sha256(concat_ws(chr(0), kind, scope, coalesce(scope_key, ''), content)), 1, 32) AS mid FROM mem WHERE scope = 'repository')
, old AS (SELECT src, mid AS old_id FROM shared WHERE doc_id % 3 <> 0), new AS (SELECT src, CASE WHEN doc_id % 4 = 0 THEN mid || 'x' ELSE mid END AS new_id FROM shared WHERE doc_id % 5 <> 0)
SELECT src, old_id, new_id, CASE WHEN old_id IS NULL THEN 'insert' WHEN new_id IS NULL THEN 'remove' WHEN old_id = new_id THEN 'keep' ELSE 'replace' END AS action FROM old FULL JOIN new USING (src)"""
)
def shared_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared records by source: insert, keep, replace (the id changed) or remove."""
    rows = tables.records(spark, sf_dir).filter("scope = 'repository'")
    rows = rows.select("doc_id", F.concat(F.lit("shared/"), F.expr("doc_id div 2")).alias("src"), ids.memory_id(c("kind"), c("scope"), c("scope_key"), c("content")).alias("mid"))
    old = rows.filter("doc_id % 3 != 0").select("src", c("mid").alias("old_id"))
    new = rows.filter("doc_id % 5 != 0").select("src", F.when(c("doc_id") % 4 == 0, F.concat("mid", F.lit("x"))).otherwise(c("mid")).alias("new_id"))
    action = F.when(c("old_id").isNull(), "insert").when(c("new_id").isNull(), "remove").when(c("old_id") == c("new_id"), "keep").otherwise("replace")
    return old.join(new, "src", "full_outer").select("src", "old_id", "new_id", action.alias("action"))


@query(
    f"""WITH {RECORDS_SQL}, said AS (SELECT doc_id AS a, doc_id + 3 AS b FROM mem WHERE doc_id % 6 = 1 AND doc_id + 3 IN (SELECT doc_id FROM mem))
, conflict AS (SELECT a, b FROM said UNION SELECT b, a FROM said), n AS (SELECT a AS doc_id, count(*) AS conflicts, min(b) AS first_conflict FROM conflict GROUP BY a)
SELECT doc_id, coalesce(conflicts, 0) AS conflicts, first_conflict, round(CASE WHEN conflicts > 0 THEN least(confidence, 0.5) ELSE confidence END, 9) AS confidence, superseded_by FROM mem LEFT JOIN n USING (doc_id) LEFT JOIN superseded USING (doc_id)"""
)
def upsert_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts hold both ways and bound the confidence of both; superseded records name their successor."""
    rows = tables.records(spark, sf_dir)
    known = rows.select("doc_id")
    said = known.filter("doc_id % 6 = 1").select(c("doc_id").alias("a"), (c("doc_id") + 3).alias("b")).join(known.withColumnRenamed("doc_id", "b"), "b", "left_semi")
    n = store.symmetric(said, "a", "b").groupBy(c("a").alias("doc_id")).agg(F.count("*").alias("conflicts"), F.min("b").alias("first_conflict"))
    met = rows.select("doc_id", "confidence").join(n, "doc_id", "left").join(tables.superseded(rows), "doc_id", "left")
    bound = F.when(c("conflicts") > 0, F.least("confidence", F.lit(0.5))).otherwise(c("confidence"))
    return met.select("doc_id", F.coalesce("conflicts", F.lit(0)).alias("conflicts"), "first_conflict", F.round(bound, 9).alias("confidence"), "superseded_by")


_CHAIN_SQL = "chain AS (SELECT o_orderkey AS node, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next, o_custkey FROM orders)"


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as versions: each is superseded by the next."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return tables.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("node"), after.alias("next")).filter("next IS NOT NULL")


@query(f"WITH {_CHAIN_SQL} SELECT node, max(node) OVER (PARTITION BY o_custkey) AS head, count(*) OVER (PARTITION BY o_custkey ORDER BY node DESC) - 1 AS steps FROM chain QUALIFY next IS NOT NULL")
def supersession_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of each superseded version's chain, and how far it is."""
    return store.chain_heads(_chain(spark, sf_dir))


@query(
    """WITH left_ AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0)
SELECT node, next FROM (SELECT o_orderkey AS node, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM left_) WHERE next IS NOT NULL"""
)
def delete_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between versions after every third is deleted: predecessors are bridged to what is left."""
    chain = _chain(spark, sf_dir)
    deleted = tables.table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(c("o_orderkey").alias("node"))
    return store.bridged(chain, deleted)


@query(
    """WITH n AS (SELECT count(*) * 2 AS n FROM events), link AS (SELECT event_id AS node, CASE WHEN event_id % 50 = 0 THEN event_id WHEN event_id % 31 = 0 THEN -event_id ELSE (event_id * 7 + 3) % n END AS target FROM events, n)
SELECT node, target, CASE WHEN node = target THEN 'self' WHEN target NOT IN (SELECT event_id FROM events) THEN 'dangling' WHEN (target, node) NOT IN (SELECT (node, target) FROM link) THEN 'one_way' ELSE 'ok' END AS verdict FROM link"""
)
def relation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of events to others: to itself, to nothing, not returned, or well."""
    events = tables.table(spark, sf_dir, "events")
    i, n = c("event_id"), 2 * events.count()
    target = F.when(i % 50 == 0, i).when(i % 31 == 0, -i).otherwise((i * 7 + 3) % n)
    link = events.select(i.alias("node"), target.alias("target"))
    exists = events.select(i.alias("target"), F.lit(True).alias("there"))
    back = link.select(c("node").alias("target"), c("target").alias("node"), F.lit(True).alias("back")).distinct()
    met = link.join(exists, "target", "left").join(back, ["node", "target"], "left")
    verdict = F.when(c("node") == c("target"), "self").when(c("there").isNull(), "dangling").when(c("back").isNull(), "one_way").otherwise("ok")
    return met.select("node", "target", verdict.alias("verdict"))


_FEEDBACK_SQL = "told AS (SELECT DISTINCT user_id AS retrieval, (event_id * 31) % 97 AS record, event_type AS event FROM events WHERE (event_id * 31) % 97 % 3 <> user_id % 3)"


@query(f"WITH {_FEEDBACK_SQL}, kept AS (SELECT * FROM told t WHERE event <> 'click' OR NOT EXISTS (SELECT 1 FROM told u WHERE u.retrieval = t.retrieval AND u.record = t.record AND u.event = 'purchase')) SELECT record, event, count(*) AS n FROM kept WHERE event <> 'signup' GROUP BY record, event")
def feedback_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of feedback: once for a retrieval, record and event; what was used is not ignored; what the retrieval did not return is refused
    (of every three records, here, two were returned)."""
    returned = ((c("event_id") * 31) % 97 % 3) != (c("user_id") % 3)
    told = tables.table(spark, sf_dir, "events").filter(returned).select(c("user_id").alias("retrieval"), ((c("event_id") * 31) % 97).alias("record"), c("event_type").alias("event")).distinct()
    used = told.filter("event = 'purchase'").select("retrieval", "record")
    ignored = told.filter("event = 'click'").join(used, ["retrieval", "record"], "left_anti").select(*told.columns)
    return told.filter("event NOT IN ('click', 'signup')").unionByName(ignored).groupBy("record", "event").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT event_id, (epoch_us(ts) // 1000) AS at_ms FROM events), n AS (SELECT max(at_ms) AS latest FROM t) SELECT event_id, at_ms FROM t, n WHERE at_ms >= latest - 20 * 86400000::BIGINT ORDER BY at_ms DESC, event_id LIMIT 1000")
def retrieval_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrievals that stay: of the last days, the newest thousand."""
    rows = tables.table(spark, sf_dir, "events").select("event_id", millis("ts").alias("at_ms"))
    latest = rows.agg(F.max("at_ms").alias("latest"))
    return store.newest(rows.crossJoin(F.broadcast(latest)).filter(c("at_ms") >= c("latest") - 20 * DAY_MS).drop("latest"), c("at_ms"), 1000, "event_id")


@query(
    f"""WITH {RECORDS_SQL} SELECT doc_id, sha256(concat_ws('|', doc_id, kind, scope, coalesce(scope_key, ''), title, content, array_to_string(tags, ','), updated_ms, CASE WHEN superseded_by % 2 = 0 THEN superseded_by END)) AS row_sha256
FROM mem LEFT JOIN superseded USING (doc_id) WHERE doc_id % 2 = 0 OR scope <> 'session'"""
)
def snapshot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each exported row; links to rows that are not exported are dropped."""
    rows = tables.records(spark, sf_dir)
    met = rows.join(tables.superseded(rows), "doc_id", "left").filter("doc_id % 2 = 0 OR scope != 'session'")
    link = F.when(c("superseded_by") % 2 == 0, c("superseded_by").cast("string"))
    parts = [c("doc_id").cast("string"), c("kind"), c("scope"), F.coalesce("scope_key", F.lit("")), c("title"), c("content"), F.array_join("tags", ","), c("updated_ms").cast("string"), link]
    return met.select("doc_id", F.sha2(F.concat_ws("|", *parts), 256).alias("row_sha256"))


@query(
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT label, count(*) AS vectors, count(*) FILTER (abs(sqrt(list_inner_product(v, v)) - 1) <= 0.02) AS unit, count(*) FILTER (len(v) = 64) AS fitting, min(vec_id) AS first_id, max(vec_id) AS last_id FROM v GROUP BY label"""
)
def generation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a generation of vectors may go live: dimensions and norms, by label."""
    v = tables.embeddings(spark, sf_dir).withColumn("norm", F.sqrt(dot(c("vector"), c("vector"))))
    return v.groupBy("label").agg(F.count("*").alias("vectors"), F.count_if(F.abs(c("norm") - 1) <= 0.02).alias("unit"), F.count_if(F.size("vector") == 64).alias("fitting"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


_JOBS_SQL = f"""job AS (SELECT o_orderkey AS job, o_custkey % 40 AS source, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'claimed' ELSE 'retry' END AS state, 1 + o_orderkey % 4 AS attempts, {NOW_MS} - (o_orderkey % 997) * 1000 AS updated FROM orders)"""


@query(
    f"""WITH {_JOBS_SQL}, r AS (SELECT job, source, attempts, updated, CASE WHEN state = 'claimed' AND updated + 60000 <= {NOW_MS} THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'retry' END ELSE state END AS state, least(1000 * (1 << least(attempts - 1, 6)), 60000) AS backoff FROM job)
SELECT job, state, CASE WHEN state = 'retry' THEN updated + backoff END AS ready, CASE WHEN state = 'retry' AND updated + backoff <= {NOW_MS} THEN row_number() OVER (PARTITION BY state = 'retry' AND updated + backoff <= {NOW_MS}, source ORDER BY updated, job) = 1 ELSE false END AS claimed_next FROM r"""
)
def job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction jobs after expired leases are recovered; of the ready ones, each source's oldest is claimed next."""
    k = c("o_orderkey")
    jobs = tables.table(spark, sf_dir, "orders").select(
        k.alias("job"),
        (c("o_custkey") % 40).alias("source"),
        F.when(c("o_orderstatus") == "F", "succeeded").when(c("o_orderstatus") == "O", "claimed").otherwise("retry").alias("state"),
        (1 + k % 4).alias("attempts"),
        (F.lit(NOW_MS) - (k % 997) * 1000).alias("updated"),
    )
    lost = (c("state") == "claimed") & (c("updated") + 60_000 <= NOW_MS)
    state = F.when(lost, F.when(c("attempts") >= 3, "failed").otherwise("retry")).otherwise(c("state"))
    backoff = F.least(1000 * F.pow(F.lit(2), F.least(c("attempts") - 1, F.lit(6))).cast("long"), F.lit(60_000))
    rows = jobs.select("job", "source", state.alias("state"), "updated", (c("updated") + backoff).alias("due"))
    rows = rows.withColumn("ready", F.when(c("state") == "retry", c("due"))).withColumn("open", F.coalesce(c("ready") <= NOW_MS, F.lit(False)))
    # the oldest of a source is an aggregate: a source with very many jobs is not sorted
    first = rows.filter("open").groupBy("source").agg(F.min(F.struct("updated", "job")).alias("first")).select("source", c("first.job").alias("next_job"))
    met = rows.join(first, "source", "left")
    return met.select("job", "state", "ready", (c("open") & F.coalesce(c("job") == c("next_job"), F.lit(False))).alias("claimed_next"))
