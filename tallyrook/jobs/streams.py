"""Queries that run as streams, and queries on sessions and extraction jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.functions import safety
from tallyrook.jobs.catalog import query
from tallyrook.jobs.records import INJECTED_SQL, SECRET_SQL
from tallyrook.operators import queue
from tallyrook.schemas import NOW_MS
from tallyrook.sources.graph import millis
from tallyrook.sources.tables import table
from tallyrook.streaming import capture, feedback, timers

c = F.col


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def feedback_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of events by day and type, of a stream that is run to its end."""
    path = f"{sf_dir}/events.parquet"
    return feedback.run_to_end(spark, path, spark.read.parquet(path).schema)


@query(
    """WITH known AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(coalesce(text, '')) END AS digest, doc_id % 17 <> 0 AS alive FROM documents WHERE doc_id % 7 <> 0)
SELECT 'doc/' || d.doc_id AS path, CASE WHEN digest IS NULL THEN 'added' WHEN digest = sha256(coalesce(text, '')) AND alive THEN 'unchanged' ELSE 'updated' END AS action FROM documents d LEFT JOIN known USING (doc_id)"""
)
def index_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index does with documents that come as a stream."""
    path = f"{sf_dir}/documents.parquet"
    docs = spark.read.parquet(path)
    name, digest = F.concat(F.lit("doc/"), c("doc_id").cast("string")), F.sha2(F.coalesce("text", F.lit("")), 256)
    known = docs.filter("doc_id % 7 != 0").select(name.alias("path"), F.when(c("doc_id") % 5 == 0, "old").otherwise(digest).alias("digest"), (c("doc_id") % 17 != 0).alias("alive"))
    return capture.indexed(spark, capture.opened(spark, path, docs.schema).select(name.alias("path"), digest.alias("digest")), known)


@query("SELECT user_id, count(*) AS n, arg_max(event_type, (ts, event_id)) AS last, arg_max(event_type, (ts, event_id)) IN ('view', 'click') AS waits FROM events GROUP BY user_id")
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user's session after a stream of events."""
    path = f"{sf_dir}/events.parquet"
    stream = capture.opened(spark, path, spark.read.parquet(path).schema)
    return capture.session_state(spark, stream, "user_id", F.struct("ts", "event_id"), "event_type", ("view", "click"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS content, CAST((conv_id + turn) % 11 AS DOUBLE) / 10 AS significance, 0.4::DOUBLE * ((conv_id % 10) / 10.0::DOUBLE) + 0.3::DOUBLE * ((turn % 8) / 8.0::DOUBLE) + 0.3::DOUBLE * ((conv_id % 16) / 16.0::DOUBLE) AS act FROM conversations)
SELECT conv_id, turn, role, sha256(content) AS sha256 FROM t WHERE NOT {SECRET_SQL} AND NOT {INJECTED_SQL} AND (role = 'user' OR (conv_id + turn) % 2 = 0) AND significance >= 0.5 AND round(act, 9) >= 0.5"""
)
def capture_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, as a stream, that pass the gate: safe, from the user or with evidence, significant, actionable."""
    path = f"{sf_dir}/conversations.parquet"
    turns = capture.opened(spark, path, spark.read.parquet(path).schema).withColumn("content", F.coalesce("text", F.lit("")))
    both = c("conv_id") + c("turn")
    trusted, evidence = F.coalesce(c("role") == "user", F.lit(False)), both % 2 == 0
    act = F.round(safety.actionability((c("conv_id") % 10) / 10, (c("turn") % 8) / 8, (c("conv_id") % 16) / 16), 9)
    decision = safety.capture_decision(safety.safety_class(c("content"), trusted, evidence), trusted, evidence, F.lit("novel"), (both % 11) / 10, act)
    return capture.kept(spark, turns, decision).select("conv_id", "turn", "role", F.sha2("content", 256).alias("sha256"))


#: How late events may come, how long a run is put off, and how long a recall stays open, in milliseconds.
_LATE, _PUT_OFF, _OPEN = 6 * 3_600_000, 3_600_000, 12 * 3_600_000
_EVENTS_SQL = f"e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS ms FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), w AS (SELECT max(ms) - {_LATE} AS now FROM e)"


def _ended(spark: SparkSession, sf_dir: str, processor: timers.Debounced | timers.Recalls) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    stream = capture.opened(spark, path, spark.read.parquet(path).schema)
    return timers.ended(spark, stream, processor, millis("ts"), c("event_id"), c("event_type"), f"{_LATE} milliseconds")


@query(
    f"""WITH RECURSIVE {_EVENTS_SQL}, run(user_id, opened_ms) AS (
  SELECT user_id, min(ms) FROM e GROUP BY user_id
  UNION ALL SELECT run.user_id, min(ms) FROM run JOIN e ON e.user_id = run.user_id AND e.ms > run.opened_ms + {_PUT_OFF} GROUP BY run.user_id)
SELECT user_id, opened_ms, opened_ms + {_PUT_OFF} AS ended_ms, count(*) AS n, 'run' AS how FROM run JOIN e USING (user_id), w WHERE ms BETWEEN opened_ms AND opened_ms + {_PUT_OFF} AND opened_ms + {_PUT_OFF} <= now GROUP BY user_id, opened_ms"""
)
def coalesced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of upkeep that a stream of events asks for: put off, one for all that asked meanwhile, started by timers."""
    return _ended(spark, sf_dir, timers.Debounced(_PUT_OFF, "user_id"))


@query(
    f"""WITH {_EVENTS_SQL}, x AS (SELECT *, event_type IN ('view', 'purchase', 'error') AS counts FROM e
), g AS (SELECT *, count(*) FILTER (counts) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS g FROM x
), o AS (SELECT user_id, ms, event_type, lead(ms) OVER q AS next_ms, lead(event_type) OVER q AS next_type, g FROM g WHERE counts WINDOW q AS (PARTITION BY user_id ORDER BY ms, event_id)
), t AS (SELECT o.*, next_ms IS NULL OR next_ms > o.ms + {_OPEN} AS over FROM o WHERE event_type = 'view'
), r AS (SELECT t.user_id, t.ms AS opened_ms, CASE WHEN over THEN t.ms + {_OPEN} ELSE next_ms END AS ended_ms, CASE WHEN over THEN 'expired' WHEN next_type = 'view' THEN 'replaced' WHEN next_type = 'purchase' THEN 'closed' ELSE 'discarded' END AS how, count(*) FILTER (g.ms <= t.ms + {_OPEN}) AS n
  FROM t JOIN g ON g.user_id = t.user_id AND g.g = t.g GROUP BY ALL)
SELECT user_id, opened_ms, ended_ms, n, how FROM r, w WHERE ended_ms <= now"""
)
def recall_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each recall of a session ended: closed, discarded, replaced by the next, or given up by its timer."""
    return _ended(spark, sf_dir, timers.Recalls(_OPEN, "user_id", ("view",), ("purchase",), ("error",)))


_SESSIONS_SQL = """s AS (SELECT c_custkey AS session, CASE WHEN c_custkey % 50 = 1 THEN c_custkey + 1 WHEN c_custkey % 50 = 2 THEN c_custkey - 1 WHEN c_custkey % 31 = 0 THEN -c_custkey WHEN c_custkey % 7 <> 0 AND c_custkey // 4 > 0 THEN c_custkey // 4 END AS parent FROM customer
), walk(session, here, path, root) AS (
  SELECT session, session, [session], NULL::BIGINT FROM s
  UNION ALL
  SELECT w.session, s.parent, list_append(path, s.parent), CASE WHEN s.session IS NULL THEN w.session WHEN s.parent IS NULL THEN w.here WHEN list_contains(path, s.parent) THEN s.parent WHEN len(path) = 32 THEN s.parent END
  FROM walk w LEFT JOIN s ON s.session = w.here WHERE w.root IS NULL)"""


@query(f"WITH RECURSIVE {_SESSIONS_SQL} SELECT session, root FROM walk WHERE root IS NOT NULL")
def session_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of each session: its ancestors may end, be unknown, or run in a circle."""
    k = c("c_custkey")
    up = F.expr("c_custkey div 4")
    parent = F.when(k % 50 == 1, k + 1).when(k % 50 == 2, k - 1).when(k % 31 == 0, -k).when((k % 7 != 0) & (up > 0), up)
    return queue.roots(table(spark, sf_dir, "customer").select(k.alias("session"), parent.alias("parent")))


_JOBS_SQL = f"""j AS (SELECT o_orderkey AS job, ['queued', 'claimed', 'running', 'completed', 'failed', 'cancelled'][1 + o_orderkey % 6] AS state, CAST(o_orderkey % 4 AS INT) AS attempts, 3 AS max_attempts, CASE WHEN o_orderkey % 6 IN (1, 2) THEN {NOW_MS} + (o_orderkey % 100 - 40) * 1000 END AS lease_ms,
    CASE WHEN o_orderkey % 6 IN (1, 2) THEN 't' || o_orderkey END AS token, o_orderkey % 6 IN (1, 2) AND o_orderkey % 5 = 0 AS cancel, CASE WHEN o_orderkey % 6 = 0 THEN {NOW_MS} + (o_orderkey % 60 - 30) * 1000 END AS next_ms, NULL::VARCHAR AS error, 'd' || (o_orderkey % 3) AS digest FROM orders WHERE o_orderkey % 20 <> 19
), rec AS (SELECT * REPLACE (CASE WHEN lost THEN CASE WHEN cancel THEN 'cancelled' WHEN attempts < 3 THEN 'queued' ELSE 'failed' END ELSE state END AS state, CASE WHEN lost THEN CASE WHEN NOT cancel AND attempts < 3 THEN {NOW_MS} + least(1000 * (1 << least(greatest(attempts - 1, 0), 6)), 60000) END ELSE next_ms END AS next_ms,
    CASE WHEN lost THEN NULL ELSE lease_ms END AS lease_ms, CASE WHEN lost THEN NULL ELSE token END AS token) FROM (SELECT *, state IN ('claimed', 'running') AND coalesce(lease_ms <= {NOW_MS}, false) AS lost FROM j)
), cmd AS (SELECT o_orderkey AS job, ['enqueue', 'claim', 'renew', 'complete', 'retry', 'fail', 'cancel', 'source_changed', 'nonsense'][1 + o_orderkey % 9] AS command, CASE WHEN o_orderkey % 11 = 0 THEN 'other' ELSE 't' || o_orderkey END AS given, 60000 AS ttl_ms, 'd' || (o_orderkey % 4 % 3) AS material FROM orders WHERE o_orderkey % 8 <> 7
), met AS (SELECT rec.* EXCLUDE (job), coalesce(rec.job, cmd.job) AS job, command, given, ttl_ms, material, rec.job IS NOT NULL AS known FROM rec FULL JOIN cmd ON rec.job = cmd.job
), told AS (SELECT *, CASE WHEN command IS NULL THEN 'kept' WHEN command = 'enqueue' THEN CASE WHEN NOT known THEN 'queued' WHEN material = digest THEN 'already_queued' ELSE 'id_reused' END WHEN NOT known THEN 'not_found'
  WHEN command = 'claim' THEN CASE WHEN state = 'queued' AND NOT cancel AND attempts < max_attempts AND (next_ms IS NULL OR next_ms <= {NOW_MS}) THEN 'claimed' ELSE 'not_claimable' END
  WHEN command = 'complete' AND state = 'completed' THEN CASE WHEN material = digest THEN 'already_completed' ELSE 'material_changed' END
  WHEN command IN ('renew', 'complete', 'retry', 'fail') AND state NOT IN ('claimed', 'running') THEN 'not_active' WHEN command IN ('renew', 'complete', 'retry', 'fail') AND token <> given THEN 'stale_token'
  WHEN command IN ('cancel', 'source_changed') AND state IN ('completed', 'failed', 'cancelled') THEN 'already_terminal' WHEN command IN ('complete', 'retry', 'fail') AND cancel THEN 'cancelled'
  WHEN command = 'renew' THEN 'renewed' WHEN command = 'complete' THEN 'completed' WHEN command = 'retry' THEN 'requeued' WHEN command = 'fail' THEN 'failed' WHEN command = 'cancel' THEN CASE WHEN state IN ('claimed', 'running') THEN 'cancel_requested' ELSE 'cancelled' END
  WHEN command = 'source_changed' THEN 'source_changed' ELSE 'unknown_command' END AS outcome FROM met)"""


@query(
    f"""WITH {_JOBS_SQL} SELECT job, outcome, CASE outcome WHEN 'queued' THEN 'queued' WHEN 'claimed' THEN 'claimed' WHEN 'renewed' THEN 'running' WHEN 'completed' THEN 'completed' WHEN 'cancelled' THEN 'cancelled' WHEN 'failed' THEN 'failed' WHEN 'requeued' THEN CASE WHEN attempts < max_attempts THEN 'queued' ELSE 'failed' END WHEN 'source_changed' THEN 'failed' ELSE state END AS state,
  CASE outcome WHEN 'queued' THEN 0 WHEN 'claimed' THEN attempts + 1 ELSE attempts END AS attempts,
  CASE WHEN outcome = 'claimed' THEN {NOW_MS} + ttl_ms WHEN outcome = 'renewed' THEN greatest(lease_ms, {NOW_MS} + ttl_ms) WHEN outcome NOT IN ('completed', 'cancelled', 'failed', 'requeued', 'source_changed') THEN lease_ms END AS lease_ms,
  CASE WHEN outcome = 'requeued' THEN CASE WHEN attempts < max_attempts THEN {NOW_MS} + least(1000 * (1 << least(greatest(attempts - 1, 0), 6)), 60000) END WHEN outcome NOT IN ('completed', 'cancelled', 'failed', 'requeued', 'source_changed', 'claimed') THEN next_ms END AS next_ms FROM told"""
)
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after lost leases are recovered and commands applied: enqueue, claim, renew, finish, cancel, a changed source."""
    k = c("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (k % n).cast("int"))
    held = (k % 6).isin(1, 2)
    jobs = orders.filter("o_orderkey % 20 != 19").select(
        k.alias("job"), pick(("queued", "claimed", "running", "completed", "failed", "cancelled"), 6).alias("state"), (k % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
        F.when(held, F.lit(NOW_MS) + (k % 100 - 40) * 1000).alias("lease_ms"), F.when(held, F.concat(F.lit("t"), k.cast("string"))).alias("token"), (held & (k % 5 == 0)).alias("cancel"),
        F.when(k % 6 == 0, F.lit(NOW_MS) + (k % 60 - 30) * 1000).alias("next_ms"), F.lit(None).cast("string").alias("error"), F.concat(F.lit("d"), (k % 3).cast("string")).alias("digest"),
    )
    names = ("enqueue", "claim", "renew", "complete", "retry", "fail", "cancel", "source_changed", "nonsense")
    given = F.when(k % 11 == 0, "other").otherwise(F.concat(F.lit("t"), k.cast("string")))
    commands = orders.filter("o_orderkey % 8 != 7").select(k.alias("job"), pick(names, 9).alias("command"), given.alias("given"), F.lit(60_000).alias("ttl_ms"), F.concat(F.lit("d"), (k % 4 % 3).cast("string")).alias("material"))
    return queue.applied(jobs, commands, NOW_MS).select("job", "outcome", "state", "attempts", "lease_ms", "next_ms")


@query(
    """WITH j AS (SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS state, epoch_us(o_orderdate) // 1000 AS updated_ms FROM orders)
, gone AS (SELECT job FROM (SELECT job, row_number() OVER (ORDER BY updated_ms, job) AS n FROM j WHERE state <> 'queued') WHERE n <= (SELECT count(*) - 1024 + 1 FROM j)) SELECT job, state FROM j WHERE job NOT IN (SELECT job FROM gone)"""
)
def job_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after the oldest ended ones are dropped to make room."""
    state = F.when(c("o_orderstatus") == "F", "completed").when(c("o_orderstatus") == "O", "queued").otherwise("failed")
    return queue.pruned(table(spark, sf_dir, "orders").select(c("o_orderkey").alias("job"), state.alias("state"), millis("o_orderdate").alias("updated_ms"))).select("job", "state")
